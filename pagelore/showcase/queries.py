"""One query per operator; each takes ``(spark, sf_dir)`` and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions.names import clean_username, pseudonym
from pagelore.functions.tokens import CallableTokenizer, SpaceTokenizer
from pagelore.functions.vectors import SCORE_DIGITS, cosine
from pagelore.operators.answers import attach_completions, count_response_tokens
from pagelore.operators.checks import split_outcome, validate
from pagelore.operators.chunk import chunk_pages, duplicate_keys
from pagelore.operators.clean import clean_pages, drop_empty
from pagelore.operators.clustered import top_k_clustered
from pagelore.operators.conversation import (
    append_reply,
    explode_turns,
    known_roles,
    last_user_turn,
    nest_turns,
    rewrite_followup,
)
from pagelore.operators.embed import HashedWords, embed, embedding
from pagelore.operators.lookup import lookup
from pagelore.operators.moderate import gate
from pagelore.operators.prompts import messages
from pagelore.operators.retrieve import build_context, retrieve, top_k, top_k_batch
from pagelore.plans.ask import ask, check, prepare
from pagelore.plans.dataset import build_points, import_batch, make_chunks, with_ids
from pagelore.plans.followup import follow_up, follow_up_nested, to_chat_responses
from pagelore.session import scratch_path, spread
from pagelore.showcase import inputs as given
from pagelore.showcase.inputs import CHUNK_TOKENS, DIM, table
from pagelore.sources.batch_files import (
    attach_embeddings,
    batch_progress,
    batch_requests,
    missing_results,
    parse_results,
    read_results,
    write_requests,
)
from pagelore.sources.clusters import write_clusters
from pagelore.sources.dump import read_dump, write_dump
from pagelore.sources.points import read_points, rebuild
from pagelore.sources.requests import (
    parse_conversations,
    parse_requests,
    read_requests,
    to_responses,
    write_answer_lines,
    write_answers,
)
from pagelore.sources.wiki import current_text
from pagelore.streaming.jobs import stream_ask, stream_follow_up

Query = Callable[[SparkSession, str], DataFrame]
_EMBEDDER = HashedWords(DIM)
_OUTCOME = ("status", "reason", "error")
# Fixed value: how many splits of the documents make one file of a dump that is read in blocks.
_SPLITS_A_FILE = 4


# Cleaning and chunking


def clean_pages_html(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pages(spread(given.web_pages(spark, sf)))


def clean_pages_wiki(spark: SparkSession, sf: str) -> DataFrame:
    return clean_pages(spread(given.wiki_pages(spark, sf)))


def drop_empty_pages(spark: SparkSession, sf: str) -> DataFrame:
    return drop_empty(given.sparse_pages(spark, sf))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return make_chunks(spread(given.document_pages(spark, sf)), CHUNK_TOKENS)


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("page_id", "chunk_no", "n_chunks", "content")


def chunk_titles(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("page_id", "chunk_no", "title")


def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("page_id", "chunk_no", "tokens")


def chunk_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks cut and counted by a caller's tokenizer."""
    chunks = chunk_pages(spread(given.document_pages(spark, sf)), CHUNK_TOKENS, CallableTokenizer(_word_ends))
    return chunks.select("page_id", "chunk_no", "n_chunks", "content", "tokens")


def _word_ends(texts):
    import re

    return [[m.end() for m in re.finditer(" ?[^ ]+| ", text)] for text in texts]


def token_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", SpaceTokenizer().count(F.col("text")).alias("tokens"))


def duplicate_chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("source").alias("title"), F.col("text").alias("content")
    )
    return duplicate_keys(chunk_pages(pages, CHUNK_TOKENS))


# Embedding


def embed_hashed(spark: SparkSession, sf: str) -> DataFrame:
    documents = embed(spread(table(spark, sf, "documents")), _EMBEDDER, DIM, text="text")
    cells = documents.select("doc_id", F.posexplode("embedding").alias("bucket", "weight"))
    return cells.where("weight <> 0").select("doc_id", "bucket", F.round("weight", 5).alias("weight"))


def batch_request_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "requests")
    write_requests(batch_requests(_chunks(spark, sf), given.MODEL), path)
    schema = "custom_id string, method string, url string, body map<string,string>"
    return spark.read.schema(schema).json(path).select(
        "custom_id", "method", "url", F.col("body")["input"].alias("input"), F.col("body")["model"].alias("model")
    )


def _result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vectors as the result lines of a batch over the documents."""
    data = F.array(F.struct("embedding"))
    response = F.struct(F.struct(data.alias("data")).alias("body"))
    line = F.struct(given.doc_title(F.col("vec_id")).alias("custom_id"), response.alias("response"))
    return table(spark, sf, "embeddings").select(F.to_json(line).alias("value"))


def _total(vector: str):
    return F.round(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 4)


def batch_results(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "results")
    _result_lines(spark, sf).write.text(path)
    return read_results(spark, path).select(
        "custom_id", F.size("embedding").alias("n_values"), _total("embedding").alias("total")
    )


def batch_attach(spark: SparkSession, sf: str) -> DataFrame:
    pages = given.document_pages(spark, sf)
    attached = attach_embeddings(pages, parse_results(_result_lines(spark, sf)), strict=False)
    return attached.select("page_id", "title", "content", _total("embedding").alias("total"))


def batch_missing(spark: SparkSession, sf: str) -> DataFrame:
    return missing_results(given.document_pages(spark, sf), parse_results(_result_lines(spark, sf)))


def batch_progress_report(spark: SparkSession, sf: str) -> DataFrame:
    requests = batch_requests(given.document_pages(spark, sf), given.MODEL)
    return batch_progress(requests, parse_results(_result_lines(spark, sf)))


# The points table


def _stored_for_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    tokens = SpaceTokenizer().count(F.col("content")).alias("tokens")
    return given.stored_points(spark, sf).select(
        F.col("id").alias("page_id"), F.lit(0).alias("chunk_no"), "title", "content", tokens, "embedding"
    )


def rebuild_points(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "points")
    rebuild(_stored_for_rebuild(spark, sf), path, DIM)
    return read_points(spark, path).select("title", "content", "tokens", _total("embedding").alias("total"))


def snapshot_points(spark: SparkSession, sf: str) -> DataFrame:
    """The first version, read after a second one has replaced it."""
    path = scratch_path(spark, "points")
    first = rebuild(_stored_for_rebuild(spark, sf), path, DIM)
    rebuild(_stored_for_rebuild(spark, sf).withColumn("title", F.lit("replaced")), path, DIM)
    return read_points(spark, path, first, vectors=False).drop("id")


def build_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Wiki pages to dump, dump to points: the whole dataset job."""
    dump, path = scratch_path(spark, "dump"), scratch_path(spark, "points")
    pages = given.wiki_pages(spark, sf)
    write_dump(pages.withColumnRenamed("title", "page_title"), dump, "2024-01-01")
    build_points(read_dump(spark, dump), path, _EMBEDDER, DIM, CHUNK_TOKENS)
    points = read_points(spark, path)
    return points.select("title", "content", "tokens", F.size("embedding").alias("n_values"))


def build_dataset_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Two dumps of mostly the same pages: every page of every date is a point."""
    dump, path = scratch_path(spark, "dump"), scratch_path(spark, "points")
    pages = given.document_pages(spark, sf).withColumnRenamed("title", "page_title")
    changed = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("New: "), F.col("content"))).otherwise(F.col("content"))
    write_dump(pages, dump, "2024-01-01", compression="gzip")
    write_dump(pages.withColumn("content", changed), dump, "2024-02-01", compression="gzip")
    build_points(read_dump(spark, dump, all_dates=True), path, _EMBEDDER, DIM, CHUNK_TOKENS)
    # Counted by digest: of equal contents, one is looked up and moves, the others do not.
    digest = F.unhex(F.sha2(F.to_json(F.struct("title", "content")), 256))
    points = read_points(spark, path).select("id", "title", "content", digest.alias("digest"))
    counts = points.select("digest", "id").repartition("digest").groupBy("digest").agg(
        F.count_distinct("id").cast("int").alias("n_points"), F.min("id").alias("id")
    )
    found = lookup(points, counts.withColumnRenamed("digest", "wanted"), "id").where("digest = wanted")
    return found.select("title", "content", "n_points")


def topk_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Points of which a third comes twice: each is one hit."""
    path = scratch_path(spark, "points")
    points = _stored_for_rebuild(spark, sf)
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("page_id") % 3 == 0, 2).otherwise(1)))
    rebuild(points.withColumn("copy", copies), path, DIM)
    hits = retrieve(read_points(spark, path), given.stored_questions(spark, sf))
    return hits.select("question_id", "rank", "score", "title", "content")


def batch_import(spark: SparkSession, sf: str) -> DataFrame:
    """Results joined to their chunks, strictly, and made the points table."""
    path = scratch_path(spark, "points")
    chunks = _stored_for_rebuild(spark, sf).drop("embedding")
    import_batch(chunks, parse_results(_result_lines(spark, sf)), path, DIM)
    return read_points(spark, path).select("title", "content", "tokens", _total("embedding").alias("total"))


def _hashed_points(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "points")
    build_points(spread(given.document_pages(spark, sf)), path, _EMBEDDER, DIM, CHUNK_TOKENS)
    return read_points(spark, path)


# Retrieval


def cosine_score(spark: SparkSession, sf: str) -> DataFrame:
    """Each stored vector against its successor."""
    vectors = table(spark, sf, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    score = F.round(cosine(F.col("embedding"), F.col("other")), SCORE_DIGITS)
    return vectors.join(following, "vec_id").select("vec_id", score.alias("score"))


def topk_one(spark: SparkSession, sf: str) -> DataFrame:
    """The ten points nearest to the mean of all stored vectors."""
    return top_k(given.stored_points(spark, sf), _mean(spark, sf), 10)


def _mean(spark: SparkSession, sf: str) -> list[float]:
    cells = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("place", "value"))
    means = cells.groupBy("place").agg(F.avg("value").alias("mean")).orderBy("place").collect()
    return [row["mean"] for row in means]


def topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return top_k_batch(given.stored_points(spark, sf), given.stored_questions(spark, sf))


def topk_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The same from vectors laid out by direction, of which each question reads a part."""
    path = scratch_path(spark, "clusters")
    write_clusters(given.stored_points(spark, sf), path, clusters=64)
    return top_k_clustered(spark, path, given.stored_questions(spark, sf))


def topk_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every point ranked by its nearness to the mean, in ranges: no task gets them all."""
    question = spark.createDataFrame(
        [(0, _mean(spark, sf), 1 << 40)], "question_id int, embedding array<float>, k bigint"
    )
    return top_k_batch(given.stored_points(spark, sf), question)


def topk_batch_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The same in several passes of questions, with payload."""
    points, questions = given.stored_points(spark, sf), given.stored_questions(spark, sf)
    return retrieve(points, questions, pass_bytes=4000, max_broadcast_hits=0)


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    questions = given.stored_questions(spark, sf)
    return build_context(retrieve(given.stored_points(spark, sf), questions), questions)


def question_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ready, _ = split_outcome(validate(read_requests(given.requests(spark, sf))))
    return ready.select("request_id", SpaceTokenizer().count(F.col("prompt")).alias("question_tokens"))


def retrieved_context(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text against all document chunks, with hashed vectors."""
    points = with_ids(embed(_chunks(spark, sf), _EMBEDDER, DIM))
    questions = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"),
        embedding(F.col("text"), _EMBEDDER, DIM).alias("embedding"),
        F.lit(None).cast("bigint").alias("k"),
    )
    return build_context(retrieve(points, questions), questions)


# Requests, moderation, prompts, answers


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Requests through their JSON form."""
    return parse_requests(given.request_lines(spark, sf))


def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    return validate(read_requests(given.requests(spark, sf))).select("request_id", *_OUTCOME)


def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    requests = read_requests(given.requests(spark, sf))
    _, rejects = split_outcome(check(requests, given.verdicts(spark, sf, "request_id")))
    return rejects.select("request_id", "prompt", "model", *_OUTCOME)


def _document_requests(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return validate(read_requests(documents.select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"))))


def moderate_inputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _document_requests(spark, sf)
    gated = gate(rows, given.verdicts(spark, sf, "request_id"), "request_id", "prompt", "input")
    return gated.select("request_id", *_OUTCOME, "input_moderated")


def moderate_outputs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _document_requests(spark, sf)
    gated = gate(rows, given.quality_verdicts(spark, sf, "request_id"), "request_id", "prompt", "output")
    return gated.select("request_id", *_OUTCOME, "output_moderated")


def moderate_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts from a function over batches of texts."""
    gated = gate(_document_requests(spark, sf), _long_text, "request_id", "prompt", "input")
    return gated.select("request_id", *_OUTCOME, "input_moderated")


def _long_text(texts):
    return texts.str.len() > 5000


def unmoderated(spark: SparkSession, sf: str) -> DataFrame:
    gated = gate(_document_requests(spark, sf), None, "request_id", "prompt", "input")
    return gated.select("request_id", *_OUTCOME, "input_moderated")


def usernames(spark: SparkSession, sf: str) -> DataFrame:
    name = clean_username(F.col("username"))
    return given.requests(spark, sf).select(
        "request_id", "username", name.alias("clean_name"), pseudonym(name).alias("participant")
    )


def oneoff_messages(spark: SparkSession, sf: str) -> DataFrame:
    requests = read_requests(given.requests(spark, sf))
    prepared = prepare(
        requests, _hashed_points(spark, sf), _EMBEDDER, DIM, given.verdicts(spark, sf, "request_id")
    )
    return messages(prepared, given.ONEOFF_SYSTEM)


def attach_answers(spark: SparkSession, sf: str) -> DataFrame:
    requests = validate(read_requests(given.requests(spark, sf)))
    answered = attach_completions(requests, given.completions(spark, sf), "request_id")
    return count_response_tokens(answered).select("request_id", "completion", "response_tokens", *_OUTCOME)


def _ask(spark: SparkSession, sf: str, requests: DataFrame) -> DataFrame:
    answered = ask(requests, _hashed_points(spark, sf), **_ask_options(spark, sf))
    return to_responses(answered, given.VERSION)


def _ask_options(spark: SparkSession, sf: str) -> dict:
    return {
        "embedder": _EMBEDDER,
        "dim": DIM,
        "system_text": given.ONEOFF_SYSTEM,
        "completions": given.completions(spark, sf),
        "input_verdicts": given.verdicts(spark, sf, "request_id"),
        "output_verdicts": given.quality_verdicts(spark, sf, "request_id"),
    }


def ask_all(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, read_requests(given.requests(spark, sf))).drop("duration")


def ask_given_context(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of which some bring their context."""
    requests = read_requests(given.requests(spark, sf)).withColumn(
        "given_context", given.given_context(F.col("request_id"))
    )
    return _ask(spark, sf, requests).drop("duration")


def ask_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Answers from a function over batches, which is told the model and the output limit."""
    options = _ask_options(spark, sf) | {"completions": _echo}
    answered = ask(read_requests(given.requests(spark, sf)), _hashed_points(spark, sf), **options)
    return to_responses(answered, given.VERSION).select("request_id", "answer", *_OUTCOME)


def _echo(asked):
    import json

    return [
        f"{len(json.loads(row.messages))} messages for {row.model}, at most {-1 if row.max_length != row.max_length or row.max_length is None else int(row.max_length)}"
        for row in asked.itertuples()
    ]


def answers_written(spark: SparkSession, sf: str) -> DataFrame:
    """Responses written and read back."""
    path = scratch_path(spark, "answers")
    write_answers(_ask(spark, sf, read_requests(given.requests(spark, sf))), path)
    return spark.read.parquet(path).drop("duration")


def answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as JSON lines, read back."""
    path = scratch_path(spark, "answers")
    responses = _ask(spark, sf, read_requests(given.requests(spark, sf)))
    write_answer_lines(responses, path)
    return spark.read.schema(responses.schema).json(path).drop("duration")


# Conversations


def known_role_turns(spark: SparkSession, sf: str) -> DataFrame:
    return known_roles(given.mixed_turns(spark, sf))


def nested_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to payloads and back: turns are renumbered from zero."""
    return explode_turns(nest_turns(table(spark, sf, "conversations")))


def conversation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads through their JSON form."""
    nested = nest_turns(table(spark, sf, "conversations"))
    line = F.to_json(F.struct(F.col("conv_id").alias("conversationId"), "conversation"))
    return explode_turns(parse_conversations(nested.select(line.alias("value"))))


def last_questions(spark: SparkSession, sf: str) -> DataFrame:
    return last_user_turn(given.mixed_turns(spark, sf))


def followup_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    contexts = turns.groupBy("conv_id").agg(
        F.concat(F.lit("Context of "), F.col("conv_id").cast("string")).alias("context")
    )
    return rewrite_followup(turns, contexts, given.CHAT_SYSTEM)


def append_replies(spark: SparkSession, sf: str) -> DataFrame:
    return append_reply(table(spark, sf, "conversations"), given.replies(spark, sf))


def _chat_options(spark: SparkSession, sf: str) -> dict:
    return {
        "embedder": _EMBEDDER,
        "dim": DIM,
        "system_text": given.CHAT_SYSTEM,
        "completions": given.replies(spark, sf),
        "input_verdicts": given.verdicts(spark, sf, "conv_id"),
        "output_verdicts": given.quality_verdicts(spark, sf, "conv_id"),
    }


def followup_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = given.mixed_turns(spark, sf)
    return follow_up(turns, _hashed_points(spark, sf), **_chat_options(spark, sf)).turns


def followup_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    turns = given.mixed_turns(spark, sf)
    return follow_up(turns, _hashed_points(spark, sf), **_chat_options(spark, sf)).outcomes


def followup_given_context(spark: SparkSession, sf: str) -> DataFrame:
    turns = given.mixed_turns(spark, sf)
    contexts = turns.select("conv_id", given.given_context(F.col("conv_id")).alias("context"))
    contexts = contexts.where("context is not null").distinct()
    return follow_up(turns, _hashed_points(spark, sf), given_contexts=contexts, **_chat_options(spark, sf)).turns


def _numbered(answered: DataFrame) -> DataFrame:
    """Payloads as rows, numbered from zero."""
    return explode_turns(answered.where("status = 'ok'").select("conv_id", "conversation"))


def followup_payloads(spark: SparkSession, sf: str) -> DataFrame:
    payloads = nest_turns(given.mixed_turns(spark, sf))
    return _numbered(follow_up_nested(payloads, _hashed_points(spark, sf), **_chat_options(spark, sf)))


def followup_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations answered by a function, with an output limit each."""
    payloads = nest_turns(given.mixed_turns(spark, sf)).withColumn("max_length", (F.col("conv_id") % 7).cast("int"))
    options = _chat_options(spark, sf) | {"completions": _echo}
    answered = follow_up_nested(payloads, _hashed_points(spark, sf), **options)
    return answered.select("conv_id", *_OUTCOME, F.element_at("conversation", -1)["message"].alias("reply"))


def followup_rows_by_function(spark: SparkSession, sf: str) -> DataFrame:
    """Turn rows answered by a function, with an output limit each: every outcome, and the reply."""
    turns = given.mixed_turns(spark, sf)
    limits = turns.select("conv_id", (F.col("conv_id") % 7).alias("max_length")).distinct()
    options = _chat_options(spark, sf) | {"completions": _echo, "limits": limits}
    found = follow_up(turns, _hashed_points(spark, sf), **options)
    replies = found.turns.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("reply"), F.count("*").cast("int").alias("n_turns")
    )
    return found.outcomes.select("conv_id", *_OUTCOME).join(replies, "conv_id", "left")


def chat_answer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Responses of conversations, rejected ones included, as JSON lines, read back."""
    path = scratch_path(spark, "chats")
    answered = follow_up_nested(nest_turns(given.mixed_turns(spark, sf)), _hashed_points(spark, sf), **_chat_options(spark, sf))
    responses = to_chat_responses(answered, given.VERSION)
    write_answer_lines(responses, path)
    return _as_text(spark.read.schema(responses.schema).json(path))


def _as_text(responses: DataFrame) -> DataFrame:
    said = F.transform("conversation", lambda m: F.concat(m["role"], F.lit(": "), m["message"]))
    return responses.withColumn("conversation", F.array_join(said, "\n"))


# Streams


def _points_table(spark: SparkSession, sf: str):
    path = scratch_path(spark, "points")
    build_points(spread(given.document_pages(spark, sf)), path, _EMBEDDER, DIM, CHUNK_TOKENS)
    return lambda session: read_points(session, path)


def _by_text(options: dict, key: str) -> dict:
    """The same tables under the key as JSON lines give it, a string."""
    return {
        name: value.withColumn(key, F.col(key).cast("string")) if isinstance(value, DataFrame) else value
        for name, value in options.items()
    }


def stream_of_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as a stream of JSON lines, some of them malformed; all fields of all responses."""
    source, output, checkpoint = (scratch_path(spark, name) for name in ("lines", "answers", "progress"))
    given.request_lines(spark, sf).union(given.bad_lines(spark, sf, "requestId")).write.text(source)
    stream_ask(
        parse_requests(spark.readStream.text(source)),
        _points_table(spark, sf),
        output,
        checkpoint,
        given.VERSION,
        **_by_text(_ask_options(spark, sf), "request_id"),
    ).awaitTermination()
    return spark.read.parquet(output).drop("duration", "batch_id")


def stream_of_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a stream of JSON lines, some of them malformed; all fields of all responses."""
    source, output, checkpoint = (scratch_path(spark, name) for name in ("lines", "answers", "progress"))
    nested = nest_turns(given.mixed_turns(spark, sf))
    line = F.to_json(F.struct(F.col("conv_id").alias("conversationId"), "conversation"))
    nested.select(line.alias("value")).union(given.bad_lines(spark, sf, "conversationId")).write.text(source)
    stream_follow_up(
        parse_conversations(spark.readStream.text(source)),
        _points_table(spark, sf),
        output,
        checkpoint,
        given.VERSION,
        **_by_text(_chat_options(spark, sf), "conv_id"),
    ).awaitTermination()
    return _as_text(spark.read.parquet(output).drop("batch_id"))


# Wiki tables and dumps


def wiki_current_text(spark: SparkSession, sf: str) -> DataFrame:
    return current_text(**given.wiki_tables(spark, sf))


def dump_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dump")
    pages = given.wiki_pages(spark, sf).withColumnRenamed("title", "page_title")
    write_dump(pages.withColumn("content", F.lit("older")), path, "2023-12-01")
    write_dump(pages, path, "2024-01-01")
    return read_dump(spark, path).drop("page_id")


def dump_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Large files of the dump, line breaks and all, each read by many tasks."""
    path = scratch_path(spark, "dump")
    pages = given.wiki_pages(spark, sf).withColumnRenamed("title", "page_title")
    # Each file holds what several tasks read, so it is cut inside fields, but no task writes everything.
    files = max(1, -(-pages.rdd.getNumPartitions() // _SPLITS_A_FILE))
    write_dump(pages.coalesce(files), path, "2024-01-01", max_rows_per_file=0)
    return read_dump(spark, path, in_blocks=True).drop("page_id")


QUERIES: dict[str, Query] = {
    "clean_pages_html": clean_pages_html,
    "clean_pages_wiki": clean_pages_wiki,
    "drop_empty_pages": drop_empty_pages,
    "chunk_documents": chunk_documents,
    "chunk_titles": chunk_titles,
    "chunk_tokens": chunk_tokens,
    "chunk_by_function": chunk_by_function,
    "token_count": token_count,
    "duplicate_chunk_keys": duplicate_chunk_keys,
    "embed_hashed": embed_hashed,
    "batch_requests": batch_request_lines,
    "batch_results": batch_results,
    "batch_attach": batch_attach,
    "batch_missing": batch_missing,
    "batch_progress": batch_progress_report,
    "rebuild_points": rebuild_points,
    "snapshot_points": snapshot_points,
    "build_dataset_dates": build_dataset_dates,
    "batch_import": batch_import,
    "build_dataset": build_dataset,
    "cosine_score": cosine_score,
    "topk_one": topk_one,
    "topk_batch": topk_batch,
    "topk_clustered": topk_clustered,
    "topk_whole": topk_whole,
    "topk_batch_blocked": topk_batch_blocked,
    "topk_repeated": topk_repeated,
    "context_text": context_text,
    "retrieved_context": retrieved_context,
    "question_tokens": question_tokens,
    "request_lines": request_lines,
    "validate_requests": validate_requests,
    "rejected_requests": rejected_requests,
    "moderate_inputs": moderate_inputs,
    "moderate_outputs": moderate_outputs,
    "moderate_by_function": moderate_by_function,
    "unmoderated": unmoderated,
    "usernames": usernames,
    "oneoff_messages": oneoff_messages,
    "attach_answers": attach_answers,
    "ask": ask_all,
    "ask_given_context": ask_given_context,
    "ask_by_function": ask_by_function,
    "answers_written": answers_written,
    "answer_lines": answer_lines,
    "known_roles": known_role_turns,
    "nested_turns": nested_turns,
    "conversation_lines": conversation_lines,
    "last_user_turn": last_questions,
    "followup_rewrite": followup_rewrite,
    "append_reply": append_replies,
    "followup": followup_turns,
    "followup_outcomes": followup_outcomes,
    "followup_given_context": followup_given_context,
    "followup_payloads": followup_payloads,
    "followup_by_function": followup_by_function,
    "followup_rows_by_function": followup_rows_by_function,
    "chat_answer_lines": chat_answer_lines,
    "stream_ask": stream_of_questions,
    "stream_followup": stream_of_conversations,
    "wiki_current_text": wiki_current_text,
    "dump_roundtrip": dump_roundtrip,
    "dump_in_blocks": dump_in_blocks,
}
