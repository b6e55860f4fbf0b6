"""Repeated-passage removal by prefix-free parsing: every byte covered by a `LENGTH`-byte string that starts anywhere else, too.

Parsing. A rolling hash over TRIGGER bytes cuts texts into phrases at the same places wherever the same bytes stand. Two equal
strings of LENGTH bytes so have the same triggers at the same offsets, and a string is known by its phrase suffix (from its start to
its first trigger) and by the parse that follows. All string starts that share a first trigger are one block.

* Parse, first: a block's core (the CORE bytes from its trigger on, which all its strings hold) is compared with all other cores by hashes. A core
  seen once settles its block: nothing repeats. Where also the whole block (all bytes its strings reach) is seen again, all its strings repeat.
* Corpus order: blocks that share only the core, at the edges of a repeat, meet with their bytes, and one block of each class that is settled
  with them. The suffix array of the parse (what follows each trigger, in lexicographic order, with common prefixes) and that of the
  dictionary (the phrases, in order of their suffixes) combine into the order of all the strings: under each phrase
  suffix, the strings stand in the order of the parse that follows, and one repeats if it shares LENGTH bytes with its neighbour.
* Strings whose first trigger is over LENGTH - CORE bytes away are compared one by one, by hashes.

Equal whole texts are one text with a count: all of a text of LENGTH bytes or more goes if it has copies. Null and short texts lose nothing. Strings never cross texts.
Hashes have 88 bits or more. Ids may repeat or be null. Reducers hold about ENTRIES keys each, whatever the size of the corpus; a text with over COPIES copies
sends its keys once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_bytes, each_once, few, forget, mix64, numbered, place, powers, prefix_hash, raw, release, ship, span_hash, strings, table, text_hash, written

LENGTH, CORE, TRIGGER, RATE, ENTRIES, BLOCKS, SLICE, SENT, SENT_ROWS = 400, 200, 8, 5, 1_000_000, 20_000, 2 << 20, 2_000_000, 200_000
REACH = LENGTH - CORE
#: Codes of the parse level: position << 2 | code.
REPEATS, EDGE, SETTLED, ALONE = 0, 1, 2, 3


def blocks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts end to end: prefix hashes; trigger, first and last start of each block; starts without a trigger in reach."""
    prefix = prefix_hash(data)
    n = len(data)
    _, down = powers(n)
    window = (prefix[TRIGGER:] - prefix[: n + 1 - TRIGGER]) * down[: n + 1 - TRIGGER] if n >= TRIGGER else np.zeros(0, np.uint64)
    trigger = np.flatnonzero((window * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - RATE) == 0)
    doc = np.searchsorted(at, trigger, side="right") - 1
    inside = trigger + TRIGGER <= at[doc + 1]
    trigger, doc = trigger[inside], doc[inside]
    before = np.concatenate([[-1], trigger[:-1]]) if len(trigger) else trigger
    first = np.maximum(np.maximum(before + 1, trigger - REACH), at[doc])
    last = np.minimum(trigger, at[doc + 1] - LENGTH)
    ok = first <= last
    trigger, first, last = trigger[ok], first[ok], last[ok]
    step = np.zeros(n + 1, np.int32)
    lone = np.flatnonzero(np.diff(at) >= LENGTH)
    np.add.at(step, at[lone], 1)
    np.add.at(step, at[lone + 1] - LENGTH + 1, -1)
    np.add.at(step, first, -1)
    np.add.at(step, last + 1, 1)
    return prefix, trigger, first, last, np.flatnonzero(np.cumsum(step[:-1]) > 0)


def _eligible(texts: pa.Array, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, bytes and offsets of the distinct texts of at least LENGTH bytes."""
    own = each_bytes(texts)
    at = np.flatnonzero(np.array([len(x) >= LENGTH for x in own], bool))
    at = at[np.unique(names[at], return_index=True)[1]]
    parts = [own[i] for i in at.tolist()]
    return names[at], np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _spans(part: np.ndarray) -> list[tuple[int, slice]]:
    """The values of a sorted array that occur, and where."""
    heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]).tolist()
    return [(int(part[i]), slice(i, j)) for i, j in zip(heads, [*heads[1:], len(part)])]


def _parsed(parts: int):
    """Keys of the parse level, dealt to reducers in one binary for each slice and reducer."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            names, data, at = _eligible(strings(b.column(0)), b.column(1).to_numpy())
            if not len(data):
                continue
            prefix, trigger, first, last, lone = blocks(data, at)
            core = span_hash(prefix, trigger, trigger + CORE)
            whole = span_hash(prefix, first, last + LENGTH) ^ mix64(((trigger - first) << 20 | (trigger - last)).astype(np.uint64))
            single = mix64(span_hash(prefix, lone, lone + LENGTH) ^ np.uint64(0x9FB21C651E98DF25))
            key, more = np.concatenate([core, single]), np.concatenate([whole, mix64(single + np.uint64(1)) ^ span_hash(prefix, lone + 1, lone + LENGTH)])
            pos = np.concatenate([trigger, lone])
            alone = np.concatenate([np.zeros(len(core), np.uint64), np.ones(len(single), np.uint64)])
            doc = np.searchsorted(at, pos, side="right") - 1
            order = np.argsort(key, kind="stable")
            key, more, pos, alone, doc = key[order], more[order], pos[order], alone[order], doc[order]
            part = (key >> np.uint64(48)).astype(np.int64) * parts >> 16
            rows = []
            for p, s in _spans(part):
                if s.stop > s.start:
                    used, local = np.unique(doc[s], return_inverse=True)
                    rows.append((p, _planes(key[s], 6), _planes(more[s], 5), _planes(local.astype(np.uint64) << np.uint64(1) | alone[s], 3), _planes((pos[s] - at[doc[s]]).astype(np.uint64), 4), names[used].tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["p", "key", "more", "local", "pos", "names"])

    return emit


_P = "p int, key binary, more binary, local binary, pos binary, names binary"


def _parse_level(group: pa.Table) -> pa.Table:
    """What equal cores say: name and position << 2 | code of the blocks whose core is seen again."""
    key, more, alone, name, pos = [], [], [], [], []
    for _, k, m, local, at, names in zip(*(c.to_pylist() for c in group.columns)):
        x = _unplanes(local, 3)
        key.append(_unplanes(k, 6))
        more.append(_unplanes(m, 5))
        alone.append((x & np.uint64(1)).astype(bool))
        name.append(np.frombuffer(names, "<i8")[(x >> np.uint64(1)).astype(np.int64)])
        pos.append(_unplanes(at, 4).astype(np.int64))
    key, more, alone, name, pos = (np.concatenate(x) for x in (key, more, alone, name, pos))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    order = order[np.lexsort((pos[order], name[order], more[order], key[order]))]
    key, more, alone, name, pos = key[order], more[order], alone[order], name[order], pos[order]
    if len(key):  # copies of a text in several slices gave the same entry
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1]) | (name[1:] != name[:-1]) | (pos[1:] != pos[:-1])])
        key, more, alone, name, pos = key[new], more[new], alone[new], name[new], pos[new]
    head = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    sub = head | np.concatenate([[True], more[1:] != more[:-1]])[: len(key)]
    size = lambda starts: np.repeat(x := np.diff(np.append(np.flatnonzero(starts), len(starts))), x)
    in_core, in_class = size(head), size(sub)
    repeats = in_class > 1
    edge = ~repeats & (in_core > 1) & ~alone
    core_at = np.cumsum(head) - 1
    has_edge = np.zeros(len(key), bool) if not len(key) else (np.bincount(core_at, edge) > 0)[core_at]
    settled = repeats & sub & has_edge & ~alone
    name = np.concatenate([name[repeats & ~alone], name[edge], name[settled], name[repeats & alone]])
    code = np.concatenate([pos[repeats & ~alone] << 2 | REPEATS, pos[edge] << 2 | EDGE, pos[settled] << 2 | SETTLED, pos[repeats & alone] << 2 | ALONE])
    return pa.table([pa.array(name), pa.array(code)], names=["name", "code"])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start:start + size], end to end."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]


def _edges(parts: int):
    """For the blocks at edges, and one of each settled class: the bytes of their phrases and of what follows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            names, (data, at) = b.column(0).to_numpy(), raw(strings(b.column(1)))
            prefix, trigger, first, last, _ = blocks(data, at)
            codes, ends = b.column(2).flatten().to_numpy(), np.asarray(b.column(2).offsets)
            code = codes & 3
            owner = np.repeat(np.arange(len(names)), np.diff(ends))
            wanted = np.unique((at[owner] + (codes >> 2))[(code == EDGE) | (code == SETTLED)])
            i = np.searchsorted(trigger, wanted)
            core = span_hash(prefix, trigger[i], trigger[i] + CORE)
            part = (core >> np.uint64(48)).astype(np.int64) * parts >> 16
            order = np.argsort(part, kind="stable")
            core, part, i = core[order], part[order], i[order]
            trigger, first, last = trigger[i], first[i], last[i]
            doc = np.searchsorted(at, trigger, side="right") - 1
            rows = []
            for p, s in _spans(part):
                t, f, z, own = trigger[s], first[s], last[s], at[doc[s]]
                places = np.stack([t - own, f - own, z - own]).astype("<u4").tobytes()
                rows.append((p, core[s].tobytes(), names[doc[s]].tobytes(), places, _gathered(data, f, t - f).tobytes(), _gathered(data, t, z + LENGTH - t).tobytes()))
            kinds = (pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["p", "core", "names", "places", "phrases", "tails"])

    return emit


_S = "p int, core binary, names binary, places binary, phrases binary, tails binary"


def suffix_array(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lexicographic order of the rows (bytes above 0, padded by zeros) inside each group, and the common prefix of each, in that order, with the one before; -1 at a group's first."""
    order = np.lexsort((np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), group))
    common = np.full(len(rows), -1, np.int64)
    step = max(1, (8 << 20) // rows.shape[1])
    for a in range(1, len(rows), step):
        z = min(a + step, len(rows))
        differ = rows[order[a:z]] != rows[order[a - 1 : z - 1]]
        common[a:z] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    common[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, common


def _padded(data: list[np.ndarray], size: np.ndarray, wide: int, reverse: bool) -> np.ndarray:
    """Rows of bytes one higher (UTF-8 has no 255), padded by zeros; reversed on request."""
    out = np.zeros((len(size), wide), np.uint8)
    place = np.arange(wide)[None, ::-1] if reverse else np.arange(wide)[None, :]
    out[place < size[:, None]] = np.concatenate([*data, np.zeros(0, np.uint8)])
    out += place < size[:, None]
    return np.ascontiguousarray(out[:, ::-1]) if reverse else out


def corpus_order(group: np.ndarray, phrase: np.ndarray, tail: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings that repeat, as row and bytes before the trigger, from the suffix arrays of dictionary and parse.

    Row i stands for the strings of `length` bytes that start least[i] to most[i] bytes before its trigger; phrase has the bytes before it, nearest first, and tail
    those from it on. Rows of one group only are compared.
    """
    by_phrase, phrase_common = suffix_array(phrase, group)
    by_tail, tail_common = suffix_array(tail, group)
    # of each row, its class among the phrase suffixes of d bytes, and among the parses of length - d bytes: the first rank of the class
    phrase_at, tail_at = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    rank = np.arange(len(group))
    phrase_at[by_phrase], tail_at[by_tail] = rank, rank
    one, two = [], []
    for d in range(int(least.min()), int(most.max()) + 1):
        own = np.flatnonzero((least <= d) & (d <= most))
        if len(own) < 2:
            continue
        suffix = np.maximum.accumulate(np.where(phrase_common < d, rank, 0))[phrase_at[own]]
        parse = np.maximum.accumulate(np.where(tail_common < length - d, rank, 0))[tail_at[own]]
        key = suffix * len(group) + parse
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        hit = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        one.append(own[hit])
        two.append(np.full(len(hit), d, np.int64))
    none = np.zeros(0, np.int64)
    return np.concatenate([*one, none]), np.concatenate([*two, none])


def _dictionary_level(group: pa.Table) -> pa.Table:
    """Runs of starts whose strings are seen again: name, first, last."""
    core, name, place, phrases, tails = [], [], [], [], []
    for _, c, m, x, f, t in zip(*(c.to_pylist() for c in group.columns)):
        core.append(np.frombuffer(c, "<u8"))
        name.append(np.frombuffer(m, "<i8"))
        place.append(np.frombuffer(x, "<u4").reshape(3, -1).astype(np.int64))
        phrases.append(np.frombuffer(f, np.uint8))
        tails.append(np.frombuffer(t, np.uint8))
    core, name, (trigger, first, last) = np.concatenate(core), np.concatenate(name), np.concatenate(place, 1)
    phrase = _padded(phrases, trigger - first, max(1, int((trigger - first).max())), True)
    tail = _padded(tails, last + LENGTH - trigger, LENGTH, False)
    row, before = corpus_order(core, phrase, tail, trigger - last, trigger - first, LENGTH)
    start = trigger[row] - before
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    head = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)])[: len(row)]
    z = np.concatenate([head[1:], [True]])[: len(row)]
    return pa.table([pa.array(name[row[head]]), pa.array(start[head]), pa.array(start[z])], names=["name", "first", "last"])


def _removal(text: bytes, codes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, int]:
    """Which bytes go, and in how many runs."""
    data = np.frombuffer(text, np.uint8)
    _, trigger, first, last, _ = blocks(data, np.array([0, len(data)], np.int64))
    step = np.zeros(len(data) + 1, np.int64)
    i = np.searchsorted(trigger, codes[codes & 3 == REPEATS] >> 2)
    alone = codes[codes & 3 == ALONE] >> 2
    lo = np.concatenate([first[i], alone, runs[0]])
    hi = np.concatenate([last[i], alone, runs[1]])
    np.add.at(step, lo, 1)
    np.add.at(step, hi + LENGTH, -1)
    gone = np.cumsum(step[:-1]) > 0
    return gone, int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


_EMPTY = hashlib.sha256(b"").hexdigest()


def repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_bytes, name, sha256), and what is left of each text that loses bytes: name, n_removed, n_spans, kept_sha256, kept."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id].dataType.simpleString()
    name = text_hash(F.col(text))

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            own = each_bytes(strings(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in own], pa.int64()), b.column(2), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())], [id, "n_bytes", "name", "sha256"])

    members = written(docs.select(id, text, name).mapInArrow(size, f"`{id}` {kind}, n_bytes long, name long, sha256 string"), "members")
    total = members.agg(F.sum("n_bytes")).head()[0] or 0
    parts = max(8, -(-total // ((1 << RATE) * ENTRIES)))
    once = each_once(docs, text, members.select(F.col("name").alias("hash")))
    codes = written(once.select("text", "hash").mapInArrow(_parsed(parts), _P).groupBy("p").applyInArrow(_parse_level, "name long, code long"), "codes")
    release(spark)
    wanted = codes.groupBy("name").agg(F.collect_list("code").alias("codes"))
    hit = written(codes.select("name").distinct(), "hit")
    hint = F.broadcast if hit.count() <= SENT else (lambda x: x)  # 8 bytes each: then only texts with repeats are shuffled
    found = once.select(F.col("hash").alias("name"), "text").join(hint(hit), "name", "left_semi").dropDuplicates(["name"])
    work = written(found.join(wanted, "name"), "work")
    release(spark)
    edges = codes.where((F.col("code") % 4).isin(EDGE, SETTLED)).count()
    sorted_ = work.where(F.exists("codes", lambda c: (c % 4).isin(EDGE, SETTLED))).mapInArrow(_edges(max(8, -(-edges // BLOCKS))), _S)
    runs = written(sorted_.groupBy("p").applyInArrow(_dictionary_level, "name long, first long, last long"), "runs")
    forget(codes)
    release(spark)
    runs = runs.groupBy(F.col("name").alias("_name")).agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    none = F.array().cast("array<long>")
    both = work.join(runs, F.col("name") == F.col("_name"), "left").select("name", "text", "codes", F.coalesce("first", none).alias("first"), F.coalesce("last", none).alias("last"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            rows = []
            own = each_bytes(strings(b.column(1)))
            for name, x, c, f, z in zip(b.column(0).to_pylist(), own, *(b.column(j).to_numpy(zero_copy_only=False) for j in (2, 3, 4))):
                gone, spans = _removal(x, np.asarray(c, np.int64), np.array([f, z], np.int64))
                if spans:
                    left = np.frombuffer(x, np.uint8)[~gone].tobytes()
                    rows.append((name, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["name", "n_removed", "n_spans", "kept_sha256", "kept"])

    return members, both.mapInArrow(cut, "name long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _copies(members: DataFrame) -> DataFrame:
    """Names of texts of LENGTH bytes or more that have copies."""
    return members.where(F.col("n_bytes") >= LENGTH).groupBy(F.col("name").alias("copied")).count().where("count > 1").select("copied")


def removed(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    members, left = repeats(docs, id=id, text=text)
    copied = _copies(members)
    cut = left.select(F.col("name").alias("cut"), "n_removed", "n_spans", "kept_sha256").join(copied, F.col("cut") == F.col("copied"), "left_anti")
    whole = copied.select(F.col("copied").alias("cut"), F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(_EMPTY).alias("kept_sha256"))
    cut = written(cut.unionByName(whole), "cut")
    # sent whole if small, so that the rows of a text with thousands of copies stay where they are; else Spark shuffles and splits skewed keys
    hint = F.broadcast if cut.count() <= SENT_ROWS else (lambda x: x)
    at = members.join(hint(cut), F.col("name") == F.col("cut"), "left")
    same, zero = F.col("cut").isNull(), F.lit(0).cast("long")
    return at.select(
        id,
        "n_bytes",
        F.when(same, zero).otherwise(F.coalesce("n_removed", "n_bytes")).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes gone from the texts; broken characters at the edges of what is left go, too.

    A null text stays null, an empty one empty; a text all of whose bytes go is left empty. Columns may have any names.
    """
    columns = docs.columns
    id, text, docs = place(docs, id), place(docs, text), numbered(docs)
    members, left = repeats(docs, id=id, text=text)
    copied = _copies(members)
    left = left.join(copied, F.col("name") == F.col("copied"), "left_anti").select(F.col("name").alias("cut"), "kept")
    every = left.unionByName(copied.select(F.col("copied").alias("cut"), F.lit(b"").alias("kept")))
    left = written(every, "left")
    forget(every)  # members, work and runs
    release(docs.sparkSession)
    names = left.select(F.col("cut").alias("hit"))
    hint = F.broadcast if left.count() <= SENT else (lambda x: x)  # 8 bytes each: texts that stay whole are not shuffled
    named = docs.withColumn("name", text_hash(F.col(text))).join(hint(names), F.col("name") == F.col("hit"), "left")
    changed = named.where("hit IS NOT NULL").join(left, F.col("name") == F.col("cut"), "left")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([None if x is None else x.decode("utf-8", "ignore") for x in b.column(b.num_columns - 1).to_pylist()], pa.string())], [*b.schema.names[:-1], "fixed"])

    others = [f for f in docs.schema.fields if f.name != text]
    null = F.col(text).isNull()
    changed = changed.select(*[f.name for f in others], F.when(~null, F.col("kept")).alias("kept"))
    changed = changed.mapInArrow(decode, T.StructType([*others, T.StructField("fixed", T.StringType())])).withColumnRenamed("fixed", text)
    return named.where("hit IS NULL").select(*docs.columns).unionByName(changed.select(*docs.columns)).toDF(*columns)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
