"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is coded as its words (A-Z lower-cased) with a space between two, then one end, a line feed, which no word holds. Each byte is
eight binary choices down a tree of 255 nodes. Its context is the DEPTH bytes before it; ends stand before a text's start. Every
context of every depth has, at every node, a Krichevsky-Trofimov estimate from its counts; context-tree weighting
mixes the estimates over all depths: P(s) = 1/2 KT(s) + 1/2 prod P(children of s), and the prediction takes each depth with the
posterior weight that follows. A context never seen leaves the prediction to its parent.

Counts come from all training rows and are exact: a node of a context has its own entry, named by the bytes themselves (48 bits), so
no two contexts share counts and the tables grow with the contexts there are. Tasks send their distinct strings of DEPTH + 1 bytes
with counts, dealt by the two nearest bytes of context, so that contexts of two bytes or more are whole in one reducer; the sums for
the contexts of no byte and of one (at most 65,535 nodes) are added up on the driver and sent back. Every distinct string of all
rows, learnt from or not, gets its logarithm there once. The most frequent strings, at most HEAD, are sent to the scan; the others go
through a join, as the words do.

The base score's vocabulary is a distributed table of exact counts. Its most frequent words, at most HEAD, are sent to the scan; the other
words of each row go through a join, so every count is exact at any vocabulary.

A null text is the end alone. Repeated rows count and are scored each. Without training rows every bit has probability 1/2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, few, hash_strings, raw, release, ship, strings, sums, table, words_of, written

DEPTH, HEAD, SLICE, CHUNK, PARTS, TASKS = 5, 1 << 20, 3 << 20, 1 << 17, 256, 64
END = "\n"  # no word holds it
_A = np.uint64(0x9E3779B97F4A7C15)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2: Stirling's series after six steps of the recurrence."""
    y = x + 6
    low = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def coded_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Strings of DEPTH + 1 bytes (48 bits) that end at each coded byte of the texts, end to end, and the n + 1 offsets of the texts."""
    joined = pc.binary_join(_word_lists(texts), pa.scalar(" ", pa.large_string()))
    start = END * DEPTH
    data, at = raw(pc.binary_join_element_wise(*(x if isinstance(x, pa.Array) else pa.scalar(x, pa.large_string()) for x in (start, joined, END, ""))))
    code = np.zeros(len(data), np.uint64)
    for j in range(DEPTH + 1):
        code[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    n = np.diff(at) - DEPTH
    ends = np.concatenate([[0], np.cumsum(n)])
    return code[np.repeat(at[:-1] + DEPTH - ends[:-1], n) + np.arange(ends[-1])], ends


def _word_lists(texts: pa.Array) -> pa.Array:
    flat, at = words_of(pc.ascii_lower(texts))
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), flat)


def _low(n: int) -> np.uint64:
    """A mask of the n lowest bytes."""
    return np.uint64((1 << 8 * n) - 1)


def _nodes(grams: np.ndarray, k: int) -> np.ndarray:
    """Of strings: the bytes before the last, and in the last byte's place the node of its choice k."""
    return (grams & ~_low(1)) | np.uint64(1 << k) | ((grams & _low(1)) >> np.uint64(8 - k))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


_GRAMS = "p int, grams binary, counts binary, uses binary"


def _dealt(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), *[pa.binary()] * 3)
    return pa.table([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=["p", "grams", "counts", "uses"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct strings of one task's texts, with how often they are learnt and how often they occur, in a binary for each reducer."""
    seen, counts, uses = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in few(batches, SLICE):
        code, ends = coded_bytes(strings(b.column(0)))
        learn = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        coded = pa.array(code).dictionary_encode()
        index = coded.indices.to_numpy()
        n = np.bincount(index, minlength=len(coded.dictionary))
        m = np.bincount(index, np.repeat(learn, np.diff(ends)), len(coded.dictionary))
        both = np.concatenate([seen, coded.dictionary.to_numpy()])
        seen, at = np.unique(both, return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, m]), len(seen)).astype(np.int64)
        uses = np.bincount(at, np.concatenate([uses, n]), len(seen)).astype(np.int64)
    near = (seen >> np.uint64(8)) & _low(2)
    part = ((near * _A) >> np.uint64(40)).astype(np.int64) % PARTS
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
    yield from _dealt([(p, *(_planes(x[order[i:j]]) for x in (seen, counts, uses))) for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]).to_batches()


def _merge(group: pa.Table) -> pa.Table:
    """The distinct strings of one reducer, in one row."""
    seen, counts, uses = (np.concatenate([_unplanes(x) for x in group.column(j).to_pylist()]) for j in (1, 2, 3))
    seen, at = np.unique(seen, return_inverse=True)
    counts, uses = (np.bincount(at, x, len(seen)) for x in (counts, uses))
    return _dealt([(group.column(0)[0].as_py(), _planes(seen), _planes(counts), _planes(uses))])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Strings, counts and uses of whole reducers, from CHUNK strings on at a time."""
    held, n = [], 0
    for b in few(batches, SLICE):
        for row in zip(*(b.column(j).to_pylist() for j in range(4))):
            held.append((row[0], *map(_unplanes, row[1:])))
            n += len(held[-1][1])
            if n >= CHUNK:
                yield (held[0][0], *(np.concatenate([h[j] for h in held]) for j in (1, 2, 3)))
                held, n = [], 0
    if held:
        yield (held[0][0], *(np.concatenate([h[j] for h in held]) for j in (1, 2, 3)))


def _totals(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the Krichevsky-Trofimov estimate of counts, and of the weighted probability; below is that of the deeper contexts (under 0, as any bit costs), or 0 without any."""
    kt = _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)
    return kt, np.where(below < 0, np.logaddexp(kt, below) - np.log(2), kt)


def _below(node: np.ndarray, depth: int, deeper: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums, for the sorted nodes of a depth, of the logarithms of the nodes one byte deeper."""
    return np.bincount(np.searchsorted(node, deeper & _low(depth + 1)), total, len(node)).astype(np.float64)


def _counted(p: int, seen: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Counts of all contexts and nodes of strings with whole contexts of two bytes, a row for each depth; what is below depth 0 is left to weighted()."""
    rows = []
    seen = seen.astype(np.uint64)[counts > 0]
    counts = counts[counts > 0]
    deeper, total = np.zeros(0, np.uint64), np.zeros(0)
    for d in range(DEPTH, -1, -1):
        seen, at = np.unique(seen & _low(d + 1), return_inverse=True)
        counts = np.bincount(at, counts, len(seen))
        found = []
        for k in range(8):
            node = _nodes(seen, k)
            first = np.append(True, node[1:] != node[:-1])[: len(node)]
            nth, bit = np.cumsum(first) - 1, (seen >> np.uint64(7 - k)) & np.uint64(1)
            found.append((node[first], *(np.bincount(nth, counts * (bit == x), first.sum()) for x in (0, 1))))
        node, zeros, ones = (np.concatenate([f[j] for f in found]) for j in range(3))
        order = np.argsort(node, kind="stable")
        node, zeros, ones = node[order], zeros[order], ones[order]
        below = _below(node, d, deeper, total) if d else np.zeros(len(node))
        deeper, total = node, _totals(zeros, ones, below)[1]
        rows.append((d, p, node.astype("<u8").tobytes(), *(x.astype("<f8").tobytes() for x in (zeros, ones, below))))
    return rows


def weighted(rows: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every depth, from one row each: the sorted nodes, the Krichevsky-Trofimov probability of a one, and the weight of this depth against the deeper ones."""
    model = []
    deeper, total = np.zeros(0, np.uint64), np.zeros(0)
    for d, _, *columns in sorted(rows, reverse=True):
        node, zeros, ones, below = (np.frombuffer(x, t) for x, t in zip(columns, ("<u8", "<f8", "<f8", "<f8")))
        if d == 0:
            below = _below(node, d, deeper, total)
        kt, total = _totals(zeros, ones, below)
        deeper = node
        model.append((node, (ones + 0.5) / (zeros + ones + 1), np.where(below < 0, np.exp(kt - np.log(2) - total), 1.0)))
    return model[::-1]


def logs(grams: np.ndarray, model: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 of the probability of the last byte of each string, given the bytes before it."""
    out = np.zeros(len(grams))
    for a in range(0, len(grams), CHUNK):
        part = grams[a : a + CHUNK]
        for k in range(8):
            bit = ((part >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            own_nodes = _nodes(part, k)
            mix, known = np.full(len(part), 0.5), np.zeros(len(part), bool)
            for d in range(len(model) - 1, -1, -1):
                node, p, w = model[d]
                if not len(node):
                    continue
                key = own_nodes & _low(d + 1)
                at = np.minimum(np.searchsorted(node, key), len(node) - 1)
                own = node[at] == key
                weight = np.where(known, w[at], 1.0)
                mix = np.where(own, weight * p[at] + (1 - weight) * mix, mix)
                known |= own
            out[a : a + CHUNK] += np.log10(np.where(bit, mix, 1 - mix))
    return out


def _frequent(types: DataFrame, count: str, head: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the largest counts, from a power of two that leaves at most `head`, and the others."""
    size = F.length(F.bin(count))
    per = dict(types.where(F.col(count) > 0).groupBy(size.alias("k")).count().collect())
    least, n = 65, 0
    while least > 1 and n + per.get(least - 1, 0) <= head:
        least -= 1
        n += per.get(least, 0)
    top = (F.col(count) > 0) & (size >= least)
    return types.where(top), types.where(~top)


def _sorted(rows: DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    found = rows.select(*names).toArrow()
    order = np.argsort(found.column(0).to_numpy())
    return tuple(found.column(x).to_numpy()[order] for x in names)


def _find(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values are in a sorted array, and whether they are."""
    place = np.minimum(np.searchsorted(h, own), max(0, len(h) - 1))
    return place, h[place] == own if len(h) else np.zeros(len(own), bool)


def gram_logs(rows: DataFrame) -> DataFrame:
    """gram, uses, log of every distinct string of the rows (text, held)."""
    grams = rows.select("text", "held").mapInArrow(_grams, _GRAMS).repartition(TASKS, "p").groupBy("p").applyInArrow(_merge, _GRAMS)
    grams = written(grams, "grams")

    def shallow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, seen, counts, _ in _parts(batches):
            for d, _, *columns in _counted(p, seen, counts):
                if d < 2:
                    node, zeros, ones, below = (np.frombuffer(x, t) for x, t in zip(columns, ("<i8", "<f8", "<f8", "<f8")))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), d, np.int32)), *map(pa.array, (node, zeros, ones, below))], ["depth", "node", "zeros", "ones", "below"])

    # at most 65,535 nodes, summed before they come to the driver
    met = grams.mapInArrow(shallow, "depth int, node long, zeros double, ones double, below double").groupBy("depth", "node").agg(*[F.sum(x).alias(x) for x in ("zeros", "ones", "below")])
    found = met.toArrow().sort_by("node")
    top = []
    for d in (0, 1):
        own = found.filter(pc.equal(found.column("depth"), d))
        if own.num_rows:
            top.append((d, 0, own.column("node").to_numpy().astype("<u8").tobytes(), *(own.column(x).to_numpy().astype("<f8").tobytes() for x in ("zeros", "ones", "below"))))
    sent = rows.sparkSession.sparkContext.broadcast(top)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, seen, counts, uses in _parts(batches):
            model = weighted([*sent.value, *(r for r in _counted(p, seen, counts) if r[0] > 1)])
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(uses), pa.array(logs(seen.astype(np.uint64), model))], ["gram", "uses", "log"])

    return written(grams.mapInArrow(deep, "gram long, uses long, log double"), "logs")


def scores(docs: DataFrame, held_out: Column, *, id: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits_per_byte for every row; rows that are not held out are learnt from."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            flat, at = words_of(pc.ascii_lower(strings(b.column(0))))
            learn = ~b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            coded = flat.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), np.repeat(learn, np.diff(at)), len(coded.dictionary))
            words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END], pa.string())])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, learn.sum()).astype(np.int64))], ["word", "c"])

    counted = rows.select("text", "held").mapInArrow(tally, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocab = written(counted, "vocab")
    release(spark)
    n_train, v_train = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).head()
    grams = gram_logs(rows)
    release(spark)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hash_strings(strings(b.column(0))).view(np.int64)), b.column(1)], ["h", "c"])

    types = written(vocab.mapInArrow(name, "h long, c long"), "types")
    den = n_train + v_train + 1
    common, others = _frequent(types, "c", head)
    frequent = spark.sparkContext.broadcast(_sorted(common, "h", "c"))
    often, seldom = _frequent(grams, "uses", head)
    sent = spark.sparkContext.broadcast(_sorted(often, "gram", "log"))
    end = types.where(F.col("h") == int(hash_strings(pa.array([END])).view(np.int64)[0])).head()
    end_c = end.c if end else 0

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = frequent.value
        base = np.log10((c + 1) / den)
        context = TaskContext.get()
        next_ = (context.partitionId() if context else 0) << 40
        for b in few(batches, SLICE):
            flat, at = words_of(pc.ascii_lower(strings(b.column(1))))
            coded = flat.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            own = hash_strings(coded.dictionary).view(np.int64)
            place, hit = _find(h, own)
            pick = lambda x: np.where(hit, x[place] if len(h) else 0.0, 0.0)[index]
            sure = hit[index]
            rare = np.flatnonzero(~sure)
            cuts = np.searchsorted(rare, at)
            rare_h = own[index[rare]]
            code, ends = coded_bytes(strings(b.column(1)))
            grams = pa.array(code.view(np.int64)).dictionary_encode()
            gram, log_of = sent.value
            of = grams.indices.to_numpy()
            place_g, hit_g = _find(gram, grams.dictionary.to_numpy())
            log = np.where(hit_g, log_of[place_g] if len(gram) else 0.0, 0.0)[of]
            seldom_at = np.flatnonzero(~hit_g[of])
            out = [
                pa.array(np.arange(next_, next_ + b.num_rows)),
                b.column(0),
                b.column(2),
                pa.array(np.diff(at) + 1),
                pa.array(sums(sure.astype(np.int64), at) + (end_c > 0)),
                pa.array(sums(pick(base), at) + np.log10((end_c + 1) / den)),
                pa.array(sums(log, ends)),
                pa.array(np.diff(ends)),
                pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare_h)),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(seldom_at, ends), pa.int32()), pa.array(code.view(np.int64)[seldom_at])),
            ]
            next_ += b.num_rows
            yield pa.RecordBatch.from_arrays(out, ["row", "id", "held", "n_tokens", "known", "base", "log", "n_bytes", "rare", "seldom"])

    scored = written(rows.mapInArrow(total, f"row long, id {kind}, held boolean, n_tokens long, known long, base double, log double, n_bytes long, rare array<long>, seldom array<long>"), "scored")
    words = scored.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count(F.lit(1)).alias("n"))
    rest = words.join(others, "h").groupBy(F.col("row").alias("of")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(den)))).alias("more_base"),
    )
    deep = scored.select("row", F.explode("seldom").alias("gram")).groupBy("row", "gram").agg(F.count(F.lit(1)).alias("n"))
    deep = deep.join(seldom, "gram").groupBy(F.col("row").alias("by")).agg(F.sum(F.col("n") * F.col("log")).alias("more_log"))
    zero = F.lit(0)
    log = F.col("log") + F.coalesce("more_log", zero)
    return scored.join(rest, F.col("row") == F.col("of"), "left").join(deep, F.col("row") == F.col("by"), "left").select(
        F.col("id").alias(id),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("more_base", zero), 6).alias("base_score"),
        F.round(log, 6).alias("score"),
        F.round(-log * F.lit(float(np.log2(10))) / F.col("n_bytes"), 6).alias("code_bits_per_byte"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)
