"""The given tables, and the operators' inputs derived from them by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64
CHUNK_TOKENS = 100
ONEOFF_SYSTEM = "Answer the question from the information given, and from nothing else."
CHAT_SYSTEM = "Go on with the conversation; use the information given with the last question."
MODEL = "some-embedding-model"
VERSION = "1"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def doc_title(number: Column) -> Column:
    return F.concat(F.lit("Doc_"), number.cast("string"))


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a raw page."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), doc_title(F.col("doc_id")).alias("title"), F.col("text").alias("content")
    )


def web_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("content"))


def wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document inside every kind of wiki markup."""
    body = F.concat(
        F.lit("__NOTOC__<!-- note -->{{Box|image = <gallery mode=slideshow>a.png|A\nb.png</gallery>\\\n}}"),
        F.lit("'''"),
        F.col("source"),
        F.lit("''' is ''in'' [[Lang "),
        F.col("lang"),
        F.lit("|the language]] and [[Plain link]].\n[[File:x.png|thumb|see [[cap]]]]\\<br />\r\n"),
        F.lit('<div class="c"><span style="x">'),
        F.col("text"),
        F.lit("</span></div>\u00a0\u2028 end__TOC__ "),
    )
    title = F.concat(F.lit(" Doc_"), F.col("doc_id").cast("string"), F.lit("_\u00a0"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"),
        title.alias("title"),
        # Of some pages nothing is left but markup.
        F.when(F.col("doc_id") % 29 == 3, "__TOC__ <br>").otherwise(body).alias("content"),
    )


def sparse_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which some lack a title or a text."""
    title = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("source"))
    content = F.when(F.col("doc_id") % 11 == 0, "").when(F.col("doc_id") % 13 == 0, None).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), title.alias("title"), content.alias("content")
    )


def stored_points(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vectors with the document of the same number as payload."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    texts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), doc_title(F.col("doc_id")).alias("title"), F.col("text").alias("content")
    )
    return vectors.join(texts, "id")


def stored_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items with the stored vector of the same number; some name no ``k``."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    k = F.when(F.col("question_id") % 4 != 1, F.col("question_id") % 9)
    return items.join(vectors, "question_id").withColumn("k", k)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return as_requests(table(spark, sf, "benchmark"))


def as_requests(items: DataFrame) -> DataFrame:
    """Benchmark items (a table or a stream) as ask requests, some faulty or unusual."""
    number = F.col("item_id")
    username = (
        F.when(number % 5 == 0, None)
        .when(number % 5 == 1, F.lit("Éloïse M."))
        .when(number % 5 == 2, F.lit("!?*"))
        .when(number % 5 == 3, F.lit(" \u00a0"))
        .otherwise(F.concat(F.lit("user-"), number.cast("string"), F.lit("_x y")))
    )
    prompt = (
        F.when(number % 17 == 3, F.lit("\u00a0 \n"))
        .when(number % 17 == 7, None)
        .otherwise(F.col("text"))
    )
    return items.select(
        number.alias("request_id"),
        prompt.alias("prompt"),
        F.when(number % 3 == 0, F.lit("other-model")).alias("model"),
        username.alias("username"),
        F.when(number % 6 != 0, number % 11).cast("int").alias("max_length"),
        F.when(number % 4 != 0, number % 7).alias("max_context_length"),
    )


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as JSON lines ``value``, under names in several ways of writing."""
    wire = F.struct(
        F.col("request_id").alias("requestId"),
        F.col("prompt").alias("Prompt"),
        "model",
        "username",
        F.col("max_length").cast("string").alias("maxLength"),
        F.col("max_context_length").alias("MaxContextLength"),
    )
    return requests(spark, sf).select(F.to_json(wire).alias("value"))


def bad_lines(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Lines that are no request or conversation: no JSON, or an id with what cannot be read."""
    number = F.col("item_id")
    name = F.concat(F.lit(f'{{"{key}":"bad-'), number.cast("string"), F.lit('","maxLength":"many"}'))
    broken = F.concat(F.lit("{not JSON "), number.cast("string"))
    items = table(spark, sf, "benchmark").where("item_id % 4 = 1")
    return items.select(F.when(number % 8 == 1, name).otherwise(broken).alias("value"))


def verdicts(spark: SparkSession, sf: str, key: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias(key), (F.col("toxic") == 1).alias("flagged"))


def quality_verdicts(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """A second set of verdicts, for answers."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias(key), (F.col("quality") == 0).alias("flagged"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions of benchmark items, with white space to trim; some have none, some have two."""
    text = F.concat(F.lit(" \n\u00a0In short:  "), F.col("text"), F.lit("\n "))
    number = F.col("item_id")
    copies = F.sequence(F.lit(1), F.when(number % 13 == 6, 2).otherwise(1))
    given = table(spark, sf, "benchmark").where(number % 11 != 8)
    return given.select(number.alias("request_id"), text.alias("completion"), F.explode(copies).alias("copy")).drop("copy")


def given_context(number: Column) -> Column:
    """A context that the caller brings, for every other number."""
    return F.when(number % 2 == 0, F.concat(F.lit("Known about "), number.cast("string")))


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """A completion per conversation."""
    text = F.concat(F.lit("Reply to "), F.col("conv_id").cast("string"), F.lit(" "))
    turns = table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", text.alias("completion"))


def mixed_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns of which some have a role that is not known; some conversations have no other."""
    strange = ((F.col("conv_id") + F.col("turn")) % 6 == 5) | (F.col("conv_id") % 9 == 4)
    role = F.when(strange, F.concat(F.lit("x-"), F.col("role")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(role, F.col("role")).alias("role"), "text"
    )


def wiki_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The wiki's base tables, derived from the documents."""
    documents = table(spark, sf, "documents")
    number = F.col("doc_id")
    roles = table(spark, sf, "documents").select(
        F.when(number % 2 == 0, 1).otherwise(2).alias("role_id"),
        F.when(number % 2 == 0, "main").otherwise("aux").alias("role_name"),
    ).distinct()
    slots = documents.select(number, F.explode(F.array(F.lit(1), F.lit(2))).alias("role"))
    content_id = number * 2 + F.col("role")
    scheme = F.when(number % 11 == 0, "es:").otherwise("tt:")
    return {
        "page": documents.select(
            doc_title(number).alias("page_title"),
            number.alias("page_latest"),
            (number % 5).cast("int").alias("page_namespace"),
            F.when(number % 7 == 0, 1).otherwise(0).alias("page_is_redirect"),
        ),
        "slots": slots.select(
            number.alias("slot_revision_id"), F.col("role").alias("slot_role_id"), content_id.alias("slot_content_id")
        ),
        "slot_roles": roles,
        "content": slots.select(
            content_id.alias("content_id"), F.concat(scheme, number.cast("string")).alias("content_address")
        ),
        "text": documents.select(number.alias("old_id"), F.col("text").alias("old_text")),
    }
