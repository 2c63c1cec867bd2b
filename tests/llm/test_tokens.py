"""Token counts and packing against the tokenizer itself."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagelore.llm.differencing import difference, windows
from pagelore.llm.packing import pack
from pagelore.llm.pretokens import Pieces, RankedPieces, halves, keys, literal
from pagelore.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PIECES = Pieces(PATH)
RANKED = RankedPieces(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

TEXTS = [
    (1, "Two words, and more words.\n\nA  wide   gap \n"),
    (2, ""),
    (3, None),
    (4, "x <|endoftext|>  y<|endoftext|><|endoftext|> "),
    (5, "ünïcode – 漢字     tab\there 123's don't"),
    (6, "long word " * 3000),
    (6, "long word " * 3000),
    (None, "no id"),
    (8, "   "),
]


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab' .,\n\t\x1f\u00a0\u2003\u00e91\u5b57\r|\u00d7\u0301", "  ", "<|endoftext|>", "'s"]), max_size=30))
def test_keys_are_encoded_independently(parts):
    text = "".join(parts)
    ids = [i for k in keys(text, PIECES.specials) for i in TOKENIZER.encode(literal(k), add_special_tokens=False).ids]
    assert ids == whole(text)
    assert ids == [
        i
        for k in keys(text, PIECES.specials)
        for h in halves(k)
        for i in TOKENIZER.encode(literal(h), add_special_tokens=False).ids
    ]
    for way in (PIECES, RANKED):
        assert np.frombuffer(way.ids([text, "x"])[0], "<u4").tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ranks_give_the_same_ids(text):
    assert RANKED.ids([text, ""]) == PIECES.ids([text, ""])


def test_ranks_leave_long_words_to_the_tokenizer():
    long = ["a" * 50_000, " " * 50_000, "b " * 20_000]
    assert RANKED.ids(long) == PIECES.ids(long)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_windows_hold_all_within_capacity(sizes):
    label = windows(np.array(sizes, np.int64), 100)
    assert len(label) == len(sizes)
    if sizes:
        assert np.bincount(label, weights=sizes).max() <= 100


def test_differencing_by_hand():
    # 8, 7, 6, 5, 4 in two: 8-7, 6-5, then 4 against them; sums 16 and 14.
    label = difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(np.bincount(label, weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_counts_equal_the_tokenizer(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, n_tokens string")
    for frequent in (100_000, 3, 0):
        got = token_counts(rows, PATH, max_frequent=frequent).collect()
        want = sorted(((i, len((t or "").encode()), len(whole(t)), len(whole(t)) > 1024) for i, t in TEXTS), key=str)
        assert sorted(map(tuple, got), key=str) == want


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(rows, PATH).collect() == []
    assert pack(rows, PATH).collect() == []


def test_pack_is_whole_and_tight(spark):
    many = TEXTS + [(100 + i, f"text number {i} " * (i % 97)) for i in range(2000)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in many], "doc_id long, text string, offset int").coalesce(2)
    got = pack(
        frame, PATH, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), ranks_pattern=public_tokenizers.PATTERN
    ).collect()
    texts = {}
    for i, t in many:
        texts.setdefault(i, []).append(t)
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = whole(texts[i][0]) + [0]
        copies = len(texts[i])
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids) and 0 < p.length
            body = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert len(body) == 4 * p.length and p.ids_crc32 == zlib.crc32(body)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert total > 0.97 * 1024 * len(by_sequence)
