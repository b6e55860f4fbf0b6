from __future__ import annotations

import random

import pytest


def lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def texts(seed: int = 5) -> list[str | None]:
    """Odd texts: null, empty, white space, long, repeated, beyond ASCII, control strings."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgéß") for _ in range(rng.randrange(1, 8)))
    long_ = " ".join(word() for _ in range(9000))
    twice = " ".join(word() for _ in range(150))
    return [None, "", " \n\t", "a", "Ab aB\x0bAB", twice, twice, twice + " end", "x" * 3000, "中文 текст word", "<|endoftext|> it's 'LL!!", "line one\nline one\n\nline one", long_]


@pytest.fixture(scope="session")
def odd(spark):
    """Those texts with null and repeated ids, null sources, and columns whose names clash with the operators' own."""
    rows = [(None if i == 3 else i // 2, t, "en" if i % 2 else None, None if i == 4 else f"s{i % 3}", i, i) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, name long, n int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
