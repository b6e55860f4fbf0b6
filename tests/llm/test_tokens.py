from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from conftest import texts
from tokenizers import Tokenizer

from tessella.llm import tokens
from tessella.llm.packing import differencing, packed, windows
from tessella.llm.tokens import count_huge, token_counts
from tessella.llm.wordbpe import WordBpe

PATH = P.path("word_bpe_49k.json")
ODD = [t or "" for t in texts()] + ["İstanbul ΑΣ ΣΑΣ it's 'S x'LL <|endoftext|>a<|startoftext|> <|endof", "a b\u0085c é \x1c\x1d z ½ ² ª º 中文字 ́a ﬁ ǅ don't''s'd!!'s 12a3", "ÀÉ×÷Ÿ œŒ ÿ", "q" * 700 + " " + "r" * 900]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_are_the_library_s(library):
    bpe = WordBpe.at(PATH)
    arr = pa.array(ODD, pa.large_string())
    ids, at = bpe.encode(arr)
    assert [list(ids[a:b]) for a, b in zip(at[:-1], at[1:])] == [library(t) for t in ODD]
    assert list(bpe.count(arr)) == [len(library(t)) for t in ODD]


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (500, 16), (5000, 64)])
def test_splicing_chunks(library, chunk, overlap):
    whole = WordBpe.at(PATH).whole
    assert [count_huge(whole, t, chunk, overlap) for t in ODD] == [len(library(t)) for t in ODD]


class _Unsteady:
    """A tokenizer whose ids depend on where a chunk starts, for its first 40 characters: what an overlap is there to outlast."""

    def __init__(self, whole):
        self.whole = whole

    def encode(self, text, add_special_tokens=False):
        e = self.whole.encode(text, add_special_tokens=False)
        return type("E", (), {"ids": [i + 1 if a < 40 else i for i, (a, _) in zip(e.ids, e.offsets)], "offsets": e.offsets})


def test_overlaps_are_widened_until_chunks_align(library):
    whole = WordBpe.at(PATH).whole
    text = " ".join(f"word{i} it's" for i in range(400))
    seen = []
    real = tokens.splice

    def splice(*a):
        seen.append(real(*a))
        return seen[-1]

    tokens.splice = splice
    try:
        assert count_huge(_Unsteady(whole), text, 300, 16) == len(library(text))
    finally:
        tokens.splice = real
    assert None in seen and any(x is not None for x in seen)
    assert count_huge(whole, "é" * 5000, 64, 4) == len(library("é" * 5000)) and count_huge(whole, "", 64, 4) == 0


def test_counts(odd, none, library):
    got = sorted((tuple(r) for r in token_counts(odd, PATH, chunk=100, overlap=8).collect()), key=str)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library(r.text or "")), len(library(r.text or "")) > 2048) for r in odd.collect()), key=str)
    assert got == want and token_counts(none, PATH).collect() == []


def test_differencing():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 200):
        sizes = rng.integers(1, 513, n)
        out = windows(sizes)
        assert sorted(i for w in out for i in w) == list(range(n)) and max(sizes[w].sum() for w in out) <= 2048
    dealt = [int(np.array([8, 7, 6, 5, 4])[w].sum()) for w in differencing(np.array([8, 7, 6, 5, 4]), 2)]
    assert sorted(dealt) == [14, 16]  # what differencing gives; the optimum is 15, 15


def test_packing(odd, none, library):
    docs = odd.withColumn("doc_id", odd.name)
    got = packed(docs, PATH, with_ids=True).collect()
    want = {r.doc_id: [*library(r.text or ""), 1] for r in docs.collect()}
    for d, ids in want.items():
        own = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) and r.length == len(r.ids) for r in own)
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in own)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packed(none, PATH).collect() == []
