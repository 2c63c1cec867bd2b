"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm.common import free_prefix, table
from pagelore.llm.conversation_repair import damage, digests, repair
from pagelore.llm.html_text import extract_pages
from pagelore.llm.language import held_out, identify, learn
from pagelore.llm.mixing import mix
from pagelore.llm.near_copies import near_copies
from pagelore.llm.oracles import ORACLES  # noqa: F401  (registered with the queries)
from pagelore.llm.packing import pack
from pagelore.llm.permutation_index import build_index, search
from pagelore.llm.quality import quality
from pagelore.llm.quality_classifier import learn_quality, score_quality
from pagelore.llm.token_counts import token_counts
from pagelore.llm.tokenizer_alignment import align_tokenizers
from pagelore.llm.url_filter import Rule, judge_urls
from pagelore.llm.warc import read_archives, with_revisits, write_archives
from pagelore.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def packed(documents: DataFrame) -> DataFrame:
    """``pack`` with the 50k byte-level vocabulary, the faster way."""
    return pack(
        documents,
        public_tokenizers.path("byte_bpe_50k.json"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        ranks_pattern=public_tokenizers.PATTERN,
    )


def op1_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return identify(documents, learn(documents.where(~held_out())))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "archives")
    write_archives(with_revisits(table(spark, sf, "pages"), "page_id", "url", "html"), path)
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(table(spark, sf, "pages"))


# The rules the urls are judged by.
URL_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return judge_urls(table(spark, sf, "pages"), URL_RULES)


# The tree of sources: every source is in one of three domains, by the number in its name.
def levels() -> dict[str, Column]:
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.concat(F.lit("d"), (number % 3).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "de": 2, "fr": 2}}


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    prefix = free_prefix(documents, "_")
    mixed = mix(documents, levels(), WEIGHTS, percent=70, max_epochs=3, prefix=prefix)
    names = {"epoch": "epoch", "tokens": "n_tokens", "domain": "domain", "lang": "language", "source": "source_name"}
    return mixed.select("doc_id", *(F.col(prefix + own).alias(name) for own, name in names.items()))


def op8_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    index = build_index(table(spark, sf, "embeddings"))
    return search(index, F.col("vec_id") % 50 == 0)


def op9_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    return near_copies(table(spark, sf, "documents"))


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    found = digests(repair(damage(conversations))).withColumnRenamed("conv_id", "id")
    every = conversations.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    empty = hashlib.sha256().hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def op12_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return score_quality(documents, learn_quality(documents.where(~held_out()), table(spark, sf, "labels")))


def op13_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align_tokenizers(
        table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
        ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"),
        ranks_pattern=public_tokenizers.PATTERN,
    )


QUERIES: dict[str, Query] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_neighbours": op8_neighbours,
    "op9_near_copies": op9_near_copies,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
