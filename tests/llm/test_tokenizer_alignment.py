"""Aligned tokenizers against a plain alignment, token by token."""

import hashlib
from collections import Counter, defaultdict

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import sentencepiece
from tokenizers import Tokenizer

from pagelore.llm.tokenizer_alignment import align_tokenizers

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(PATHS[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

TEXTS = [
    (1, "Two words, and more words.\n\nA  wide   gap \n"),
    (2, ""),
    (3, None),
    (4, "x <|endoftext|>  y</s><s> <0x41> <unk>"),
    (5, "ünïcode – 漢字 \U0001f600 \t here 123's don't"),
    (6, "long word " * 5000),
    (6, "long word " * 5000),
    (None, "no id"),
    (8, "   "),
    (9, "this ▁ sign is not spelled"),
    (10, "\x00 null \x01"),
    *[(100 + i, "the text of a third of all rows, again and again") for i in range(40)],
    *[(200 + i, f"Unbelievably tokenisable wordings {i}: lorem-ipsumming antidisestablishment") for i in range(30)],
]


def ends(parts):
    found, at = [], 0
    for part in parts:
        found.append((at, at + len(part)))
        at += len(part)
    return found


def plain(rows):
    """What the operator tells, in its own words: A's offsets by decoding, all pairs of tokens compared nearby."""
    # Latin-1 characters that a byte-level entry is written in, from the usual table.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = dict(zip(map(chr, own), own)) | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
    aligned, counts = [], Counter()
    for doc_id, text in rows:
        pairs, groups, a, b = [], [], [], []
        if text:
            a = [(i, bytes(chars[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
            for i in B.encode(text):
                piece = B.id_to_piece(i)
                b.append((i, bytes([int(piece[1:-1], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
                a, b = [], []
        at_a, at_b = ends([t for _, t in a]), ends([t for _, t in b])
        i = j = 0
        group = ([], [])
        while i < len(a) and j < len(b):
            pairs.append((a[i][0], b[j][0]))
            end_a, end_b = at_a[i][1], at_b[j][1]
            if end_a <= end_b:
                group[0].append(a[i][0])
                i += 1
            if end_b <= end_a:
                group[1].append(b[j][0])
                j += 1
            if end_a == end_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        counts.update(pairs)
        aligned.append((doc_id, len(a), len(b), groups, pairs))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (
                doc_id, n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs),
                sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
            )
            for doc_id, n_a, n_b, groups, pairs in aligned
        ),
        key=repr,
    )


@pytest.mark.parametrize("max_frequent", [0, 40, 500_000])
def test_equals_plain_alignment(spark, max_frequent):
    frame = spark.createDataFrame([(*r, 1, "k") for r in TEXTS], "doc_id long, text string, row int, digest string")
    found = align_tokenizers(frame, *PATHS, max_frequent=max_frequent)
    assert sorted(map(tuple, found.collect()), key=repr) == plain(TEXTS)


def test_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        found = align_tokenizers(frame, *PATHS).collect()
        assert sorted(map(tuple, found)) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_ranks_make_the_same_tokens():
    import public_tokenizers

    from pagelore.llm.tokenizer_alignment import TwoTokenizers

    texts = ["plain words, here.", "<|endoftext|> a <|endoftext|>", "a\u0085b  c　d", "é" * 20, "日本語", "  two ", "\t\n x" * 9, "", "x" * 3000]
    ranked = TwoTokenizers(*PATHS, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert ranked.align(texts).equals(TwoTokenizers(*PATHS).align(texts))
