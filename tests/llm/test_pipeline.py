"""The pipeline, stage by stage, over a small table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from pagelore.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of that with house river stone bridge cloud", "de": "der und die das mit haus fluss stein wolke nicht"}


def prose(rng, lang, n=90):
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice(["", "s", "en", "a"]) for _ in range(n)) + "."


def documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        text = prose(rng, lang)
        rows.append((i, text, lang, f"src{i % 5}", len(text)))
    rows += [(500, None, "en", "src0", None), (501, "123 456", "en", "src1", 7), (502, "too short", "en", None, 9)]
    rows += [(600 + i, rows[7][1], None, "src1", 1) for i in range(3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark):
    docs = documents(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, "unused"), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r.doc_id for r in frame.select("doc_id").collect()} for name, frame in seen.items()}
    assert ids["language"] - {502} == set(range(120)) | {600, 601, 602}
    assert ids["quality"] == set(range(120)) | {600, 601, 602}
    assert ids["near_dedup"] == set(range(120))
    assert ids["mixing"] < ids["near_dedup"] and ids["packing"] == ids["mixing"]
    size = F.sum(F.floor((F.octet_length("text") + 3) / 4))
    whole, taken = (seen[n].select(size).first()[0] for n in ("near_dedup", "mixing"))
    assert abs(taken - 0.8 * whole) < 0.06 * whole


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "unused"), "none")
    assert docs.collect() == []
