"""Line-first cleaning by quality rules (operator 2); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import every_column, free_prefix

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# A line fails by any of these rules.
# Punctuation: a short line that does not end as a sentence does, or a line full of signs.
SHORT_LINE_WORDS = 6
SENTENCE_END = r"[.!?:;…。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
SIGNS = r"[#*$%&|<>{}!~^=_\\]"
MAX_SIGNS_PERCENT = 10
# Navigation: a row of entries between separators.
SEPARATOR = r"[|>/·•›»](?<![^\x20\x09-\x0D].)(?![^\x20\x09-\x0D])"
MAX_SEPARATORS_PERCENT = 20
# Boilerplate: what sites put on every page, in a line that is no long paragraph.
BOILERPLATE_WORDS = 30
BOILERPLATE = (
    r"(?i)all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum"
    r"|newsletter|click here|read more|sign (in|up)|log ?in|^[\x20\x09-\x0D]*(©|\(c\)|copyright)"
)

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_KEPT_PERCENT = 50


def judge(documents: DataFrame, text: str = "text", name: str = "_quality") -> DataFrame:
    """``documents`` with a struct ``name`` of what the rules found; other columns stay.

    Its fields: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (longs), ``base_failed``, ``kept``, ``kept_chars`` (characters in
    words of the lines that pass), ``clean`` (the text without failing lines; null for
    null). A document is kept if the base rules pass and its passing lines hold at least
    half of the characters in its words. All of it is computed within the row.

    A null or empty text has no words and fails. Repeated rows get equal answers, no rows
    give no rows. No column of ``documents`` may begin with ``name`` (see ``free_prefix``).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    split = documents.withColumns(
        {
            f"{name}_words": F.filter(F.split(whole, SPACE), lambda w: w != ""),
            f"{name}_lines": F.split(whole, "\n"),
        }
    )
    n = F.size(f"{name}_words")
    # Windows of three words as sorted longs: a hash, and in the low bits their place.
    hashed = split.withColumns(
        {
            f"{name}_hashes": F.transform(f"{name}_words", lambda w: F.xxhash64(w)),
            f"{name}_bits": F.length(F.bin(n)),
            f"{name}_full": F.filter(f"{name}_lines", lambda line: line.rlike(WORD)),
            f"{name}_good": F.filter(f"{name}_lines", lambda line: ~_fails(line)),
        }
    )

    def packed(h: Column, i: Column) -> Column:
        window = F.xxhash64(h, F.get(f"{name}_hashes", i + 1), F.get(f"{name}_hashes", i + 2))
        placed = F.call_function("shiftleft", window, F.col(f"{name}_bits")).bitwiseOR(i.cast("long"))
        return F.coalesce(placed, F.lit(0).cast("long"))  # never null, and so sorted as plain longs

    windows = F.transform(F.slice(f"{name}_hashes", 1, F.greatest(n - 2, F.lit(0))), packed)
    sorted_hashes = hashed.withColumn(f"{name}_sorted", F.sort_array(windows))

    def hash_of(x: Column) -> Column:
        return F.call_function("shiftright", x, F.col(f"{name}_bits"))

    def met(x: Column, i: Column) -> Column:
        before = (i > 0) & (hash_of(F.get(f"{name}_sorted", i - 1)) == hash_of(x))
        return F.coalesce(before, F.lit(False)) | F.coalesce(hash_of(F.get(f"{name}_sorted", i + 1)) == hash_of(x), F.lit(False))

    # Only where hashes agree are the words compared: with their place, sorted, equal ones are neighbours.
    def spelled(x: Column) -> Column:
        at = (x - F.call_function("shiftleft", hash_of(x), F.col(f"{name}_bits"))).cast("int")
        words = (F.get(f"{name}_words", at + k) for k in range(3))
        return F.struct(F.concat_ws(" ", *words).alias("w"), at.alias("at"))

    sorted_windows = sorted_hashes.withColumn(f"{name}_met", F.filter(f"{name}_sorted", met)).withColumn(
        f"{name}_windows", F.sort_array(F.transform(f"{name}_met", spelled))
    )

    def repeated(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(f"{name}_windows", i - 1)["w"] == x["w"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(f"{name}_windows", i + 1)["w"] == x["w"], F.lit(False))

    places = sorted_windows.withColumn(
        f"{name}_places", F.sort_array(F.transform(F.filter(f"{name}_windows", repeated), lambda x: x["at"]))
    )
    # Each repeated window adds the words up to the next one, three at most.
    steps = F.transform(
        f"{name}_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(f"{name}_places", i + 1) - p, F.lit(3)))
    )
    # Behind a generator: else a filter on the outcome would be moved below, and with it
    # all of the above, to be computed for each window anew.
    chars = F.length(F.array_join(f"{name}_words", "")).cast("long")
    counted = places.select(
        *every_column(documents),
        _once(
            n.cast("long").alias("n_words"),
            chars.alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(f"{name}_full") - F.size(F.array_distinct(f"{name}_full"))).cast("long").alias("n_dup_lines"),
            F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
            F.when(F.size(f"{name}_good") == F.size(f"{name}_lines"), chars)
            .otherwise(F.aggregate(f"{name}_good", F.lit(0), lambda a, line: a + _word_chars(line)).cast("long"))
            .alias("kept_chars"),
            F.when(F.col(text).isNotNull(), F.array_join(f"{name}_good", "\n")).alias("clean"),
        ).alias(name),
    )
    q = F.col(name)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])
    kept = ~failed & (100 * q["kept_chars"] >= MIN_KEPT_PERCENT * q["word_chars"])
    return counted.withColumn(name, q.withField("base_failed", failed).withField("kept", kept))


def _once(*fields: Column) -> Column:
    return F.explode(F.array(F.struct(*fields)))


def _word_chars(line: Column) -> Column:
    return F.length(F.regexp_replace(line, SPACE, ""))


def _has_words(line: Column, n: int) -> Column:
    return line.rlike(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}" % n)


def _fails(line: Column) -> Column:
    """Whether a line is to be removed; a line without words is not."""
    # Counts only where a cheaper look leaves them open.
    signs = F.regexp_count(line, F.lit(SIGNS))
    separators = F.regexp_count(line, F.lit(SEPARATOR))
    punctuation = (~_has_words(line, SHORT_LINE_WORDS) & ~line.rlike(SENTENCE_END)) | (
        line.rlike(SIGNS) & (100 * signs > MAX_SIGNS_PERCENT * _word_chars(line))
    )
    navigation = line.rlike(SEPARATOR) & (100 * separators > MAX_SEPARATORS_PERCENT * F.regexp_count(line, F.lit(WORD)))
    boilerplate = ~_has_words(line, BOILERPLATE_WORDS + 1) & line.rlike(BOILERPLATE)
    return line.rlike(WORD) & (punctuation | navigation | boilerplate)


def quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars``.

    One per row of ``documents``; see ``judge``. Other columns are left out, whatever
    their names; a null ``doc_id`` stays null.
    """
    given = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")
    return judge(given).select("doc_id", *(F.col("_quality")[x].alias(x) for x in names))


def clean(documents: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without their failing lines, ``n_chars`` set anew if there; see ``judge``."""
    name = free_prefix(documents, "_quality")
    kept = judge(documents, text, name).where(F.col(f"{name}.kept"))
    changed = {text: F.col(f"{name}.clean")}
    if n_chars in documents.columns:
        changed[n_chars] = F.length(f"{name}.clean").cast(documents.schema[n_chars].dataType)
    return kept.withColumns(changed).select(every_column(documents))
