"""Token counts: exact, with huge documents encoded in overlapping chunks that are spliced where both chunks provably agree.

A document longer than `chunk` characters is cut into chunks that overlap by `overlap` characters, and each is encoded by the library
itself, with the offsets of its tokens. A boundary inside an overlap is proven stable where

* ASCII white space stands before it: the tokenizer drops white space before it merges, so nothing left of it changes an id right of it,
  and in both encodings one token starts there and none lies across it; and
* from there to the last white space that both chunks hold, both encodings have the same tokens: ids, starts and ends.

The left chunk's ids count up to the boundary, the right chunk's from there on. Where an overlap has no such boundary, or the encodings
don't align, it is doubled, up to the whole chunk; where that doesn't help, the chunk is.

Null and empty texts count 0 tokens. Rows with a null id are counted like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import few, raw, ship, strings, table
from .wordbpe import WordBpe

CHUNK, OVERLAP = 16_384, 256
_SPACE = " \t\n\x0b\x0c\r"


class Chunk:
    """One encoded chunk: where its tokens start and end in the document, and their ids."""

    def __init__(self, library: Tokenizer, text: str, start: int, end: int):
        e = library.encode(text[start:end], add_special_tokens=False)
        place = np.array(e.offsets, np.int64).reshape(-1, 2) + start
        self.start, self.end = place[:, 0], place[:, 1]
        self.ids = np.array(e.ids, np.int64)
        self.to = end

    def before(self, at: int) -> int:
        """How many tokens start before at."""
        return int(np.searchsorted(self.start, at))

    def stable(self, at: int) -> bool:
        """One token starts at `at`, and none lies across it."""
        i = self.before(at)
        return i < len(self.start) and self.start[i] == at and (i == 0 or self.end[i - 1] <= at)


def splice(text: str, left: Chunk, right: Chunk, lo: int, resume: int) -> int | None:
    """A stable boundary of left and right, whose chunk starts at lo; None if there is none, or if they don't align after it."""
    last = max(text.rfind(c, lo, left.to) for c in _SPACE)  # what stands before it is whole in both
    common = np.intersect1d(left.start[left.start > max(lo, resume)], right.start)
    common = [c for c in common[common < last].tolist() if text[c - 1] in _SPACE and left.stable(c) and right.stable(c)]
    for at in common:
        own, other = (slice(x.before(at), x.before(last)) for x in (left, right))
        if all(np.array_equal(x[own], y[other]) for x, y in ((left.ids, right.ids), (left.start, right.start), (left.end, right.end))):
            return at
    return None


def count_huge(library: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of ids of text, from overlapping chunks."""
    total, start, resume = 0, 0, 0  # the chunk from start counts from resume on
    left = Chunk(library, text, 0, min(len(text), chunk))
    while left.to < len(text):
        wide, at = overlap, None
        while at is None:
            lo = max(start, left.to - wide)
            right = Chunk(library, text, lo, min(len(text), lo + max(chunk, 2 * wide)))
            at = splice(text, left, right, lo, resume) if lo > start else None
            if at is None and lo == start:  # the right chunk holds the left one and reaches further
                left, wide = right, overlap
                if left.to == len(text):
                    return total + len(left.ids) - left.before(resume)
            elif at is None:
                wide *= 2
        total += left.before(at) - left.before(resume)
        left, start, resume = right, lo, at
    return total + len(left.ids) - left.before(resume)


def token_counts(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs. No shuffle."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.at(path)
        for b in few(batches, owner="tokens"):
            t = strings(b.column(1))
            chars = pc.utf8_length(t).to_numpy(zero_copy_only=False)
            huge = np.flatnonzero(chars > chunk)
            small = pc.if_else(pa.array(chars > chunk), "", t)
            n = bpe.count(small)
            for i in huge:
                n[i] = count_huge(bpe.whole, t[int(i)].as_py(), chunk, overlap)
            _, at = raw(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], [id, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(count, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
