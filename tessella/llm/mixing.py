"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. One scan gives each document its size in words, a seeded spot of its source and a seeded order key.
2. Sources are cut into shards of about `shard_words` words (of 1/65,536 of all words if that is more) by the spots of their documents.
   The driver sees the totals of sources and shards: at most `max_sources` + 65,536 rows. It sets
   the target of each source, apportions blocks of `block` words to sources by highest quotients
   target / (2 * blocks + 1), and each source's blocks to its shards the same way.
3. In a shard, documents stand in seeded order. Its words are cut into equal blocks, and a quota of q of
   its b blocks takes q div b whole passes and q mod b consecutive blocks from a seeded start, around the end.

Empty documents have size 0 and are never taken. A null source is a source of its own, the last.
Repeated rows are separate documents; of rows with equal id, size, source and text any may be taken. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import hashlib
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, place, table, written

BLOCK, SHARD_WORDS, SHARDS, MAX_PASSES, MAX_SOURCES, SEED = 16, 1 << 20, 1 << 16, 3, 1 << 20, 17
SPOTS = 1 << 30


def targets(sizes: list[int], weights: list[int], times: int = MAX_PASSES) -> list[Fraction]:
    """Shares of sum(sizes) by weight; a share stops at times its size, and the excess is shared again."""
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(sum(sizes))
    while open_:
        per = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if per * weights[i] > times * sizes[i]}
        for i in over or open_:
            out[i] = Fraction(times * sizes[i]) if over else per * weights[i]
            left -= out[i]
        open_ -= over or set(open_)
    return out


def sainte_lague(seats: int, votes: list[Fraction]) -> list[int]:
    """Seats by highest quotients votes / (2 * seats + 1); the first of equals comes first."""
    total = sum(votes)
    if not total or not seats:
        return [0] * len(votes)
    # rounding at any one divisor is a state that the method passes through; from there it takes few steps
    out = [int(v * seats / total + Fraction(1, 2)) for v in votes]
    diff = seats - sum(out)
    if diff > 0:
        heap = [(-v / (2 * n + 1), i) for i, (v, n) in enumerate(zip(votes, out)) if v]
        heapq.heapify(heap)
        for _ in range(diff):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif diff < 0:
        heap = [(v / (2 * n - 1), -i) for i, (v, n) in enumerate(zip(votes, out)) if n]
        heapq.heapify(heap)
        for _ in range(-diff):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * out[-i] - 1), i))
    return out


def _start(seed: int, source: str | None, shard: int, blocks: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}/{shard}/{source!r}".encode()).digest()[:8]) % blocks


def _small(rows: DataFrame, n: int) -> DataFrame:
    """rows as a side to send if there are few (under 100 bytes each, so 26 MB); else Spark shuffles."""
    return F.broadcast(rows) if n <= 1 << 18 else rows


def mixed_sizes(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), block: int = BLOCK, shard_words: int = SHARD_WORDS, times: int = MAX_PASSES, max_sources: int = MAX_SOURCES, seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken, source and print (a hash of the text), a row for each document."""
    spark = docs.sparkSession
    key = F.coalesce(F.col(id).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    sized = written(
        docs.select(
            F.col(id).alias("id"),
            F.col(source).cast("string").alias("source"),
            F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
            F.pmod(F.xxhash64(F.lit(seed), key), F.lit(SPOTS)).alias("spot"),
            F.xxhash64(F.lit(seed + 1), key).alias("turn"),
            F.xxhash64(body).alias("print"),
        ),
        "mix",
    )
    totals = sized.groupBy("source").agg(F.sum("size")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    totals = sorted(map(tuple, totals), key=lambda r: (r[0] is None, r[0] or ""))
    names, sizes = [r[0] for r in totals], [r[1] for r in totals]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], times)
    quotas = sainte_lague(round(Fraction(sum(sizes), block)), target)
    per = max(shard_words, -(-sum(sizes) // SHARDS))
    shards = {s: max(1, -(-n // per)) for s, n in zip(names, sizes)}
    cut = spark.createDataFrame(list(shards.items()), "c_source string, shards long")
    sharded = sized.join(_small(cut, len(names)), sized.source.eqNullSafe(cut.c_source), "left")
    sharded = sharded.withColumn("shard", F.shiftright(F.col("spot") * F.col("shards"), 30)).drop("c_source")
    words_in: dict[tuple, int] = {}
    for s, h, n in sharded.where("shards > 1").groupBy("source", "shard").agg(F.sum("size")).collect():
        words_in[s, h] = n
    rows = []
    for s, size, t, quota in zip(names, sizes, target, quotas):
        own = [words_in.get((s, h), 0) for h in range(shards[s])] if shards[s] > 1 else [size]
        for h, (words, q) in enumerate(zip(own, sainte_lague(quota, [Fraction(x) for x in own]))):
            blocks = max(1, round(Fraction(words, block)))
            passes, r = divmod(min(q, times * blocks), blocks)
            at = _start(seed, s, h, blocks)
            edge = lambda i: i * words // blocks  # noqa: E731, B023
            rows.append((s, h, size, float(t), passes, edge(at), edge(min(at + r, blocks)), edge(max(0, at + r - blocks))))
    quota = spark.createDataFrame(rows, "q_source string, q_shard long, source_size long, target double, passes long, lo long, hi long, wrap long")
    placed = sharded.join(_small(quota, len(rows)), sharded.source.eqNullSafe(quota.q_source) & (sharded.shard == quota.q_shard), "left")
    w = Window.partitionBy("source", "shard").orderBy("turn", "id", "size", "print").rowsBetween(Window.unboundedPreceding, 0)
    end, zero = F.sum("size").over(w), F.lit(0).cast("long")
    placed = placed.withColumn("end", end).withColumn("at", F.col("end") - F.col("size"))
    taken = F.col("passes") * F.col("size") + F.greatest(zero, F.least("end", "hi") - F.greatest("at", "lo")) + F.greatest(zero, F.least("end", "wrap") - F.col("at"))
    return placed.select(F.col("id").alias(id), "size", "source_size", "target", taken.alias("taken"), "source", "print")


def mixed_documents(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it, rounded to whole documents. Columns may have any names.

    A taken run of blocks breaks at most four documents a shard. Rows with equal id, source and text share what they were given.
    """
    columns = docs.columns
    id, text, source, docs = place(docs, id), place(docs, text), place(docs, source), numbered(docs)
    given = mixed_sizes(docs, id=id, text=text, source=source, **how)
    copies = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + F.lit(0.5)).cast("int")
    given = given.groupBy(F.col(id).alias("id"), "print", "source").agg(copies.alias("copies")).where("copies > 0")
    same = F.col(id).eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("print")) & F.col(source).cast("string").eqNullSafe(F.col("source"))
    both = docs.join(given, same)
    return both.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns).toDF(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
