"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every document's ids, with an end id, are cut: full windows leave as they are, the remainder joins a
group of `group` remainders of the same input partition, cut into pieces of `piece` ids. A group with T ids starts with ceil(T / size)
windows. Each piece is a partial partition (one filled window, the rest empty); the two partial
partitions with the largest imbalance merge, the fullest window of one with the emptiest of the other,
until one is left. Its windows are near-equal. If one exceeds the size, the window count rises by
one and the group is solved again.

No shuffle: memory is one Arrow batch, 2 MB of texts at work (or one longer text) and one group. A null text is empty and packs as its end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import few, ship, strings, table
from .wordbpe import WordBpe

SIZE, GROUP, PIECE = 2048, 256, 512


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Deal the indexes of sizes to k windows by Karmarkar-Karp multiway differencing."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[int], list[list[int]]]] = []
    # a partial partition: its k' filled windows, largest sum first; the other k - k' are empty
    for i, s in enumerate(sizes):
        heap.append((-int(s), i, [int(s)], [[i]]))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, sa, pa_ = heapq.heappop(heap)
        _, _, sb, pb = heapq.heappop(heap)
        if len(sa) + len(sb) <= k:  # enough empty windows: nothing meets
            both = sorted(zip(sa + sb, pa_ + pb), key=lambda x: -x[0])
        else:
            # window k-1-j of a (emptiest first) takes window j of b (fullest first)
            s, p = sa + [0] * (k - len(sa)), pa_ + [[] for _ in range(k - len(pa_))]
            for j in range(len(sb)):
                s[k - 1 - j] += sb[j]
                p[k - 1 - j] = p[k - 1 - j] + pb[j]
            both = sorted(((x, y) for x, y in zip(s, p) if y), key=lambda x: -x[0])
        s, p = [x for x, _ in both], [y for _, y in both]
        low = s[-1] if len(s) == k else 0
        heapq.heappush(heap, (low - s[0], tick, s, p))
        tick += 1
    return heap[0][3] if heap else []


def windows(sizes: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Indexes of sizes (each at most size) in windows of at most size; the count rises until all fit."""
    if not len(sizes):
        return []
    k = max(1, -(-int(sizes.sum()) // size))
    while True:
        out = differencing(sizes, k)
        if max(int(sizes[x].sum()) for x in out) <= size:
            return out
        k += 1


def packed(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", size: int = SIZE, group: int = GROUP, piece: int = PIECE, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds the ids."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.at(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        for b in few(batches, 2 << 20, "tokens"):
            ids, at = bpe.encode(strings(b.column(1)))
            n = np.diff(at)
            n_docs = len(n)
            total = n + 1
            new_at = np.concatenate([[0], np.cumsum(total)])
            full = np.full(new_at[-1], end_id, "<u4")
            full[np.arange(len(ids)) + np.repeat(np.arange(n_docs), n)] = ids
            whole = total // size
            rest = total - whole * size
            doc = np.repeat(np.arange(n_docs), whole)
            first = np.concatenate([[0], np.cumsum(whole)])
            start = (np.arange(len(doc)) - np.repeat(first[:-1], whole)) * size
            rows = [(doc, start, np.full(len(doc), size), sequence + np.arange(len(doc)), np.zeros(len(doc), np.int64))]
            sequence += len(doc)
            left = np.flatnonzero(rest)
            for g in range(0, len(left), group):
                own = left[g : g + group]
                parts = -(-rest[own] // piece)
                own = np.repeat(own, parts)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(piece, rest[own] - nth * piece)
                for w in windows(length, size):
                    d, r = own[w], length[w]
                    rows.append((d, whole[d] * size + nth[w] * piece, r, np.full(len(d), sequence), np.concatenate([[0], np.cumsum(r)[:-1]])))
                    sequence += 1
            doc, start, length, seq, offset = (np.concatenate([r[i] for r in rows]).astype(np.int64) for i in range(5))
            lo = new_at[doc] + start
            data = memoryview(full).cast("B")
            crc = np.fromiter((zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(lo.tolist(), length.tolist())), np.int64, len(doc))
            out = [b.column(0).take(pa.array(doc)), *(pa.array(x) for x in (start, length, crc, total[doc], seq, offset))]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(length)])
                take = np.repeat(lo - ends[:-1], length) + np.arange(ends[-1])
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full[take].view(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    names = [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return docs.select(id, text).mapInArrow(pack, f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
