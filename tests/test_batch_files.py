import json

import pytest

from pagelore.operators.embed import HashedWords
from pagelore.plans.dataset import export_batch, import_batch, make_chunks
from pagelore.sources.batch_files import (
    attach_embeddings,
    batch_progress,
    batch_requests,
    missing_results,
    parse_results,
    read_results,
    write_requests,
)
from pagelore.sources.points import read_points

CHUNK = "title string, content string, tokens int"


def chunks(spark):
    rows = [("A", 'say "hi"\n\\', 2), ("B (1)", "x", 1), ("B (2)", "é", 1)]
    return spark.createDataFrame(rows, CHUNK)


def result_line(key, vector):
    body = {"object": "list", "data": [{"index": 0, "embedding": vector}, {"index": 1, "embedding": [9.0]}]}
    return json.dumps({"id": "r", "custom_id": key, "response": {"status_code": 200, "body": body}, "error": None})


def test_request_lines(spark, tmp_path):
    write_requests(batch_requests(chunks(spark), "m"), str(tmp_path / "r"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(lines, key=lambda r: r["custom_id"])[0] == {
        "custom_id": "A",
        "method": "POST",
        "url": "/v1/embeddings",
        "body": {"input": 'say "hi"\n\\', "model": "m"},
    }
    assert len(lines) == 3


def test_empty_batch_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no requests"):
        write_requests(batch_requests(chunks(spark).limit(0), "m"), str(tmp_path / "r"))


def test_results_give_the_first_data_item(spark, tmp_path):
    path = tmp_path / "out.jsonl"
    path.write_text("\n".join([result_line("A", [1.0, 2.0]), result_line("B (1)", [0.5, 0.25])]))
    want = {("A", (1.0, 2.0)), ("B (1)", (0.5, 0.25))}
    assert {(r[0], tuple(r[1])) for r in read_results(spark, str(path)).collect()} == want
    assert {(r[0], tuple(r[1])) for r in parse_results(spark.read.text(str(path))).collect()} == want


def test_attach_strict_and_lenient(spark):
    rows = [("A", [1.0]), ("B (1)", [2.0])]
    some = spark.createDataFrame(rows, "custom_id string, embedding array<float>")
    with pytest.raises(Exception, match=r"no embedding for B \(2\)"):
        attach_embeddings(chunks(spark), some).collect()
    lenient = attach_embeddings(chunks(spark), some, strict=False)
    assert {(r.title, tuple(r.embedding or ())) for r in lenient.collect()} == {
        ("A", (1.0,)), ("B (1)", (2.0,)), ("B (2)", ())
    }
    assert [r.title for r in missing_results(chunks(spark), some).collect()] == ["B (2)"]
    progress = batch_progress(batch_requests(chunks(spark), "m"), some)
    assert tuple(progress.first()) == (3, 2, False)
    full = some.union(spark.createDataFrame([("B (2)", [3.0])], some.schema))
    assert attach_embeddings(chunks(spark), full).count() == 3
    assert tuple(batch_progress(batch_requests(chunks(spark), "m"), full).first()) == (3, 3, True)


def test_batch_route_equals_direct_route(spark, tmp_path):
    pages = spark.createDataFrame([(1, "A", "a b c"), (2, "B", "d")], "page_id int, title string, content string")
    made = make_chunks(pages, 2)
    export_batch(made, str(tmp_path / "req"), "m")
    requests = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "req")).collect()]
    embedder = HashedWords(4)
    out = tmp_path / "res.jsonl"
    out.write_text(
        "\n".join(
            result_line(r["custom_id"], [float(x) for x in embedder._unit_counts([r["body"]["input"]])[0]])
            for r in requests
        )
    )
    assert import_batch(made, read_results(spark, str(out)), str(tmp_path / "points"), 4) == 1
    points = read_points(spark, str(tmp_path / "points")).orderBy("title").collect()
    assert [(p.title, p.content, p.tokens) for p in points] == [("A (1)", "a b", 2), ("A (2)", " c", 1), ("B", "d", 1)]


def test_duplicate_titles_stop_the_batch(spark, tmp_path):
    twice = chunks(spark).union(chunks(spark))
    with pytest.raises(ValueError, match="duplicate title"):
        export_batch(twice, str(tmp_path / "req"), "m")


def test_strict_attach_takes_no_result_twice(spark):
    chunks = spark.createDataFrame([("a",), ("b",)], "title string")
    results = spark.createDataFrame([("a", [1.0]), ("a", [2.0]), ("b", [3.0])], "custom_id string, embedding array<float>")
    with pytest.raises(Exception, match="more than one"):
        attach_embeddings(chunks, results).collect()
    assert attach_embeddings(chunks, results, strict=False).count() == 2


def test_result_without_key(spark):
    """Fails a strict import; a lenient one leaves it out."""
    chunks = spark.createDataFrame([("A",)], "title string")
    results = spark.createDataFrame([("A", [1.0]), (None, [2.0])], "custom_id string, embedding array<float>")
    with pytest.raises(Exception, match="without custom_id"):
        attach_embeddings(chunks, results).collect()
    lenient = attach_embeddings(chunks, results, strict=False).collect()
    assert [tuple(r) for r in lenient] == [("A", [1.0])]
