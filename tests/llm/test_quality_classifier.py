"""The quality classifier: features and gradient against plain versions, held-out accuracy, edge rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagelore.llm import subword_vectors
from pagelore.llm.common import distinct_by_hash
from pagelore.llm.language import held_out
from pagelore.llm.quality_classifier import LONG_BYTES, SAMPLE_BYTES, learn_quality, score_quality
from pagelore.llm.subword_vectors import Scorer, features, train

SCHEMA = "doc_id long, text string, score double, held_out string"


def plain(text):
    """Names of all features of a text."""
    names, words = ["end"], text.split()
    for word in words:
        names.append(("word", word))
        bordered = f" {word} "
        names += [("run", bordered[i : i + n]) for n in (2, 3, 4) for i in range(len(bordered) - n + 1)]
    names += [("words", a, b) for a, b in zip(words, words[1:])]
    names += ["twice"] * sum(a == b for a, b in zip(words, words[1:]))
    return names


def test_features_are_those_of_the_text(monkeypatch):
    texts = ["", " ", "a", "one two two", "ünï 漢字 \U0001f600\n\tx  y\x0b", "the same the same", "I I I I"]
    monkeypatch.setattr(subword_vectors, "_AT_ONCE", 5)
    cut = [np.concatenate(list(features(t, 1 << 40))) for t in texts]
    monkeypatch.undo()
    number = {}
    for text, in_parts in zip(texts, cut):
        found = np.concatenate(list(features(text, 1 << 40)))
        assert sorted(found) == sorted(in_parts)
        names = plain(text)
        kinds, times = np.unique(found, return_counts=True)
        assert sorted(times) == sorted(names.count(n) for n in set(names)), text
        if len(set(names)) == 1:
            number[names[0]] = kinds[0]
    # Equal features of different texts have equal buckets.
    one, other = (set(np.concatenate(list(features(t, 1 << 40)))) for t in ("house boat", "boat house"))
    assert len(one & other) == len(set(plain("house boat")) & set(plain("boat house")))
    assert number["end"] in one


def test_step_follows_the_gradient():
    """One step of training equals minus the numerical gradient of the loss of one text."""
    text, rng = "some small text", np.random.default_rng(12)
    start = rng.uniform(-1 / 16, 1 / 16, (64, 16)).astype(np.float32).astype(np.float64)
    output = np.zeros((2, 16))
    found = np.concatenate(list(features(text, 64)))

    def loss(vectors, output):
        odds = output @ vectors[found].mean(axis=0)
        return -(odds[1] - np.log(np.exp(odds).sum()))

    change = np.zeros_like(output)
    for at in np.ndindex(*output.shape):
        moved = output.copy()
        moved[at] += 1e-6
        change[at] = (loss(start, moved) - loss(start, output)) / 1e-6
    # Outputs start at zero, so vectors stay; they move a tenth of the step, which halves for a single class.
    scorer = train([text], [1], buckets=64, epochs=1, least_steps=1, rate=1.0)
    moved = -0.1 * 0.5 * change
    assert np.allclose(scorer.moves, start @ (moved[1] - moved[0]), atol=1e-5)


def table(spark, n=600):
    rng = random.Random(5)
    words = "the of and house river stone bridge cloud water light".split()
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        said = [rng.choice(words) + rng.choice(["", "s", "ed", "ing"]) for _ in range(rng.randint(5, 80))]
        text = " ".join(said if good else [w + rng.choice(["$$$", "***", "!!"]) for w in said])
        rows.append((i, text, 0.5, "x"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = table(spark)
    rows += [(9001, None, 0.0, "x"), (9002, "", 0.0, "x"), (None, "good words", 0.0, "x")]
    rows += [(9003, "word " * 200_000, 0.0, "x")] * 2
    documents = spark.createDataFrame(rows, SCHEMA)
    # A label of no class, one of both, and one of a document that is not there.
    marked = spark.createDataFrame([*labels, (9001, 5), (9002, 1), (9002, 0), (77777, 1)], "doc_id long, quality int")
    model = learn_quality(documents.where(~held_out()), marked)
    found = score_quality(documents, model)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    tested = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id in dict(labels)]
    assert len(tested) > 100 and sum(a == b for a, b in tested) > 0.97 * len(tested)
    assert len({r.score for r in got if r.doc_id in (9001, 9002)}) == 1
    again = score_quality(documents, learn_quality(documents.where(~held_out()), marked)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_repeated_rows_teach_once(spark):
    good, bad = "a plain good text", "bad $$$ bad *** text"
    rows = [(i, good if i % 2 else bad) for i in range(3000)]
    documents = spark.createDataFrame(rows + [(5000 + i, f"{good} {i}") for i in range(20)], "doc_id long, text string")
    marked = documents.select("doc_id", F.when(F.col("text") == bad, 0).otherwise(1).alias("quality"))
    sample = distinct_by_hash(documents, "text", 10).collect()
    assert len({r.text for r in sample}) == len(sample) == 10
    model = learn_quality(documents, marked, sample_texts=10)
    assert model.score(good) > 0.7 > model.score(bad)


def test_classes_of_long_texts_or_none(spark):
    long_text = "$$$ *** " * (SAMPLE_BYTES // 8 + 1)
    documents = spark.createDataFrame(
        [(1, "good text"), (2, "good words"), (3, long_text), (4, "x" * (LONG_BYTES + 1))], "doc_id long, text string"
    )
    marked = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    assert learn_quality(documents, marked).score(long_text) < 0.5
    assert learn_quality(documents, marked.where("quality = 1")).score("any") == 1
    assert learn_quality(documents, marked.where("quality = 0")).score("any") < 1e-9
    nothing = learn_quality(documents, marked.where("false"))
    assert isinstance(nothing, Scorer) and nothing.score("any") == 0.5
    assert score_quality(documents.where("false"), nothing).collect() == []
