"""Token counts and BPE against the library."""

import hashlib
import random
import struct

import numpy as np
import pytest

from lumenframe.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
NAME = "word_bpe_49k.json"
ODD = ["", " ", "a" * 3000, "<|endoftext|>x <|startoftext|> <|ENDOFTEXT|>", "don't DON'T I'll", "é é Å ﬁ Σας İi", "a b c\x85d\x1ce", "日本語 ж 12345 ½", "!!!??...\n\n\t--", "<" * 50, "x" * 9000 + " " + "word " * 4000]


def library():
    t = tokenizers.Tokenizer.from_file(public.path(NAME))
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrstl") for _ in range(rng.randint(1, 16))) for _ in range(3000)]
    mixed = ["".join(rng.choice(["a", "é", "'", "!", "-", "ing", "th", "ж", "語", "1", " ", "́", "<|", "|>"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    return ODD + words + mixed + ["a%sb" % chr(c) for c in range(0x20, 0x3000)]


def test_encoding_equals_the_library():
    rows = texts()
    want = [e.ids for e in library().encode_batch(rows, add_special_tokens=False)]
    b = bpe.WordBPE(public.path(NAME))
    assert [np.frombuffer(x, "<u4").tolist() for x in b.encode_batch(rows)] == want
    assert 0 < b.exact_words < b.all_words  # both ways of encoding a word were taken


def test_counts_equal_the_library():
    rows = texts()
    want = [len(e.ids) for e in library().encode_batch(rows, add_special_tokens=False)]
    assert token_counts.LengthCounter(public.path(NAME), True)(rows) == want
    assert token_counts.LengthCounter(public.path(NAME), False)(rows) == want


def test_compatible_pairs_by_merging():
    b = bpe.WordBPE(public.path(NAME))
    rng = random.Random(8)
    inner = [i for t, i in b.inner.items() if t.isascii() and t.isalpha()]
    final = [i for t, i in b.final.items() if t.isascii() and t.isalpha()]
    pairs = [(rng.choice(inner), rng.choice(final)) for _ in range(4000)]
    whole = [b.tokens[x] + b.tokens[y][: -len(b.suffix)] for x, y in pairs]
    want = [b.merge(s) == [x, y] for s, (x, y) in zip(whole, pairs)]
    got = b.compatible(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
    assert got.tolist() == want and any(want) and not all(want)


def test_pieces_join_to_the_text():
    for t in ODD + ["word " * 9000]:
        assert "".join(token_counts.pieces(t, 100)) == t
    assert len(token_counts.pieces("word " * 9000, 100)) > 100


SCHEMA = "doc_id long, text string, n_tokens int, extra string"


def test_queries_over_nulls_ties_and_extra_columns(spark):
    rows = [(1, t, 0, "x") for t in ODD[:6]] + [(None, None, None, None), (1, "a b", 1, "y"), (1, "a b", 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    lib = library()
    want = sorted((len(lib.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for _, t, _, _ in rows)
    got = token_counts.token_counts(docs, NAME).collect()
    assert sorted((r["n_tokens"], r["n_bytes"]) for r in got) == want
    ids = [lib.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in rows]
    sha = sorted((hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256(lib.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in ids)
    assert sorted((r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs, NAME).collect()) == sha
    kept = bpe.decode(bpe.encode(docs, NAME), NAME)
    assert {"extra", "n_tokens", "ids", "decoded"} <= set(kept.columns) and kept.count() == len(rows)
    empty = docs.where("false")
    assert token_counts.token_counts(empty, NAME).count() == 0 and bpe.digests(empty, NAME).count() == 0
