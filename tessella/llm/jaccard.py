"""N-gram Jaccard self-join by universe partition and pigeonhole, exact.

A document's set holds the 64-bit hashes of its distinct 5-word shingles; documents with equal sets are one class, and only
classes are joined. Sizes fall into bands so wide that linked sets are in one band or in two neighbours. Each band k cuts
the hash universe into m segments, more than the symmetric difference H that two linked sets of the band can have, so that two
linked sets agree on whole segments.

* Index: a set emits, in its own band, a key for each non-empty segment; for the first few (reserve) segments also the
  one-deletion neighbourhood, a key for the segment without each of its hashes.
* Probe: the smaller set of a pair needs allocations that add up to H + 1: 1 asks for an equal segment, 2 for one that
  differs by at most one hash (the segment, its deletions, and the index's deletions). All non-empty segments get 1, in the next band only
  EXTRA more than are needed, those with most hashes, which are shared least; empty segments, which most sets share, get 0; what is then missing is
  raised to 2 on the cheapest reserve segments. Sets for which even that is too little go through a join
  on all their hashes: these are looked for in the texts, and only those found are shuffled.
* A key's sets meet in a reducer; a text with over COPIES copies emits its keys once. Keys are dealt band by band: a set's keys, which are of two
  bands, go to the reducers of these, so that its name and size are sent to few. Small runs give their pairs. A long run gives the
  pairs of its least set and keeps its members. A set that asked for e segments more than H + 1 shares at least e + 1 of them with each that it links
  with, so it leaves out its e longest runs: a passage that many texts hold brings no comparisons of texts that have more to tell them by.
  In a run whose members these links don't connect, sketches tell which members may link with one of another component, in blocks of about
  WIDE probes and WIDE others; the whole sets of these give, in blocks of about 2 * ENTRIES hashes, links
  that join all that links join, at most one fewer than the members, not all pairs.
* A sketch holds the parities of a set's hashes in 2^k >= 2n bits. The bits in which two sketches differ are a lower bound of the symmetric
  difference, so a pair with more than a seventh of its sizes' sum cannot link: no text is fetched for it, and no link is lost.
* Every pair left is verified on the shingles of both texts. What pairs connect meets in one bucket, so that each text is sent once there, not once
  a pair. Links make components.

Null and empty texts have no set and link with nothing. Ids may repeat or be null; classes go by texts. The number of reducers follows the number of shingles.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import each_once, few, forget, hash_strings, mix64, numbered, place, raw, release, ship, strings, sums, table, text_hash, words_of, written
from .components import components

WORDS, RUN, WIDE, STRIP, EXTRA, ENTRIES, SUBPARTS, SENT_CLASSES, SLICE = 5, 16, 16_384, 64, 8, 1_000_000, 4, 2_000_000, 2 << 20
#: Similarity 3/4: linked sizes differ by 4/3 at most, and the symmetric difference is at most a seventh of the sizes' sum.
_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(4 * _EDGES[-1] // 3 + 1)
EDGES = np.array(_EDGES, np.int64)
_K = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(64)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, at = words_of(pc.ascii_lower(texts))
    coded = flat.dictionary_encode()
    w = hash_strings(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(w) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        rolled += w[j : j + len(rolled)] * _K[j]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:  # fewer words: the whole sequence is one shingle
            x = sum(int(w[a + j]) * int(_K[j]) for j in range(b - a)) + (b - a)
            out.append(mix64(np.array([x % (1 << 64)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _class(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets, and a 64-bit name for each: equal sets, equal names."""
    n = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    ends = np.concatenate([[0], np.cumsum(n)])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(np.concatenate([*sets, np.zeros(0, np.uint64)]) ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return n, mix64((total[ends[1:]] - total[ends[:-1]]) + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in 2^k bits, k by its size."""
    bits = 1 << min(16, max(6, (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words, all of one length) with fewer bits: their halves over each other."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs a, b whose sketches leave room for a link; rows a, b, n and sketch of both."""
    for b in batches:
        ok = []
        for m, n, x, y in zip(*(b.column(j).to_pylist() for j in (2, 3, 4, 5))):
            w = min(len(x), len(y)) // 8
            ok.append(int(np.bitwise_count(_folded(np.frombuffer(x, "<u8"), w) ^ _folded(np.frombuffer(y, "<u8"), w)).sum()) <= (m + n) // 7)
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _active(group: pa.Table) -> pa.Table:
    """Of one block of a long run: the members that may link with one of another component, by roles, sizes and sketches.

    A probe is no larger than the set it looks for. Members of the largest component are not compared with each other.
    """
    order = np.argsort(group.column("n").to_numpy(), kind="stable")
    n, component, role = (group.column(c).to_numpy()[order] for c in ("n", "component", "role"))
    taken = group.column("sketch").take(pa.array(order))
    data, at = raw(pa.concat_arrays([*(x.cast(pa.large_binary()) for x in taken.chunks), pa.array([], pa.large_binary())]))
    data, at = data.copy().view("<u8"), at // 8
    words, on = np.diff(at), np.zeros(len(n), bool)

    def sketches(own: np.ndarray, level: int) -> np.ndarray:
        """Of members in order of size, a row for each word of the sketches folded to `level` words."""
        out = [_folded(data[at[x][:, None] + np.arange(w)], level) for w in np.unique(words[own]).tolist() if len(x := own[words[own] == w])]
        return np.ascontiguousarray(np.concatenate(out).T)

    def compare(one: np.ndarray, two: np.ndarray) -> None:
        for level in np.unique(words[one]).tolist() if len(two) else []:
            own = one[words[one] == level]
            near = two[(n[two] >= n[own[0]]) & (3 * n[two] <= 4 * n[own[-1]]) & (words[two] >= level)]
            if not len(near):
                continue
            a, b = sketches(own, level), sketches(near, level)
            step = max(STRIP, (STRIP << 10) // len(near))
            for i in range(0, len(own), step):
                x = own[i : i + step]
                lo, hi = np.searchsorted(n[near], n[x[0]]), np.searchsorted(3 * n[near], 4 * n[x[-1]], side="right")
                y = near[lo:hi]
                differ = np.zeros((len(x), len(y)), np.int32)
                for k in range(level):
                    differ += np.bitwise_count(a[k, i : i + step][:, None] ^ b[k, lo:hi][None, :])
                m, o = n[x][:, None], n[y][None, :]
                ok = (7 * differ <= m + o) & (m <= o) & (3 * o <= 4 * m) & (component[x][:, None] != component[y][None, :])
                on[x[ok.any(1)]] = True
                on[y[ok.any(0)]] = True

    kinds, place_, size = np.unique(component, return_inverse=True, return_counts=True)
    large = place_ == size.argmax()
    probe, index = role & PROBE != 0, role & INDEX != 0
    compare(np.flatnonzero(probe & ~large), np.flatnonzero(index))
    compare(np.flatnonzero(probe & large), np.flatnonzero(index & ~large))
    return group.select(["run", "name", "component", "n"]).take(pa.array(np.sort(order[on])))


def _star(group: pa.Table) -> pa.Table:
    """Of one block of a long run: links that join all its members that links join, at most one fewer than the members.

    From each member in turn, the members not reached yet whose sets link with its own are reached, and so are those already in its component.
    """
    name, component = group.column("name").to_numpy(), group.column("component").to_numpy()
    sets = [np.frombuffer(x, "<u8") for x in group.column("hashes").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(int(code.max()) + 1, np.int64)
    waiting, one, two = np.arange(len(name)), [], []
    queue: list[int] = []
    while len(waiting):
        if not queue:
            queue.append(int(waiting[0]))
            waiting = waiting[1:]
        x = queue.pop()
        same = component[waiting] == component[x]
        queue += waiting[same].tolist()
        waiting = waiting[~same]
        if not len(waiting):
            break
        own = code[ends[x] : ends[x + 1]]
        mark[own] = 1
        m = n[waiting]
        at = np.concatenate([[0], np.cumsum(m)])
        both = sums(mark[code[np.repeat(ends[waiting] - at[:-1], m) + np.arange(at[-1])]], at)
        mark[own] = 0
        hit = (both > 0) & (100 * both >= 75 * (n[x] + m - both))
        one += [x] * int(hit.sum())
        two += waiting[hit].tolist()
        queue += waiting[hit].tolist()
        waiting = waiting[~hit]
    a, b = name[np.array(one, np.int64)], name[np.array(two, np.int64)]
    return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _plan(band: int) -> tuple[int, int, int]:
    """Of a band: its largest size, its segments, its reserve segments."""
    high = int(EDGES[band + 1]) - 1
    need = 2 * high // 7 + 1
    m = need + -(-need * 4 // 25) + 2
    return high, m, min(m, 8 + m // 32)


def _cut(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted set: the segment of each hash, and the ends of the segments."""
    seg = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # segments of equal width, in order
    return seg, np.flatnonzero(np.concatenate([seg[1:] != seg[:-1], [True]])) + 1


def _segments(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a sorted set: the non-empty segments, the end of each, and the sums of scrambled hashes before each end."""
    seg, end = _cut(s, m)
    return seg[end - 1].astype(np.int64), end, np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(s ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])


def _keys(band: int, seg: np.ndarray, sum_: np.ndarray, deleted: bool) -> np.ndarray:
    return mix64(sum_ + (seg.astype(np.uint64) * np.uint64(4) + np.uint64(2 * band << 40) + np.uint64(deleted)) * np.uint64(0x9FB21C651E98DF25))


#: NEXT marks a probe in the band after its own.
INDEX, PROBE, NEXT = 1, 2, 4


def _asked(band: int, own: int, n: int, segments: int) -> tuple[int, int]:
    """Of a set of n hashes in so many non-empty segments: the allocations it needs in a band, and the segments it asks for."""
    need = (n + min(_plan(band)[0], 4 * n // 3)) // 7 + 1
    return need, segments if band == own else min(segments, need + EXTRA + need // EXTRA)


def slack(s: np.ndarray) -> tuple[int, int]:
    """How many of the keys that a set asks for it may leave out, in its own band and in the next."""
    out, n = [0, 0], len(s)
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    for band in (own, own + 1) if n else ():
        if 4 * n // 3 >= EDGES[band]:
            need, asked = _asked(band, own, n, len(_cut(s, _plan(band)[1])[1]))
            out[band - own] = max(0, asked - need)
    return out[0], out[1]


def signatures(s: np.ndarray) -> tuple[list[tuple[np.ndarray, int]], bool]:
    """Keys of a set with their roles; False if its allocations don't add up in some band, so that the set needs the join on all hashes."""
    out, enough = _banded(s)
    return [(keys, role) for keys, role, _ in out], enough


def _banded(s: np.ndarray) -> tuple[list[tuple[np.ndarray, int, int]], bool]:
    """What signatures() returns, with the band of the keys after their role."""
    n, out, enough = len(s), [], True
    own = int(np.searchsorted(EDGES, n, side="right")) - 1
    for band in (own, own + 1):
        _, m, reserve = _plan(band)
        if 4 * n // 3 < EDGES[band]:
            continue
        seg, end, total = _segments(s, m)
        begin = np.concatenate([[0], end[:-1]])
        size, sum_ = end - begin, total[end] - total[begin]
        whole = _keys(band, seg, sum_, False)
        need, many = _asked(band, own, n, len(seg))
        asked = np.argsort(-size, kind="stable")[:many]
        in_reserve = np.flatnonzero(seg < reserve)
        # one-deletion neighbourhoods of the reserve segments
        reps = size[in_reserve]
        each = np.repeat(in_reserve, reps)
        at = np.arange(len(each)) - np.repeat(np.cumsum(reps) - reps, reps) + begin[each]
        without = sum_[each] - (total[at + 1] - total[at])
        if band == own:
            far = size[each] >= 3  # raised segments have two hashes or more: no other is asked for
            out += [(whole, INDEX | PROBE, band), (_keys(band, seg[each[far]], without[far], True), INDEX, band)]
        else:
            out.append((whole[asked], PROBE | NEXT, band))
        lack = need - len(seg)
        if lack > 0:
            able = in_reserve[size[in_reserve] >= 2]
            able = able[np.argsort(size[able], kind="stable")][:lack]
            enough &= len(able) == lack
            raised = np.isin(each, able)
            out += [(_keys(band, seg[able], sum_[able], True), PROBE, band), (_keys(band, seg[each[raised]], without[raised], False), PROBE, band)]
    return out, enough


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of uint64 values, byte by byte: what is alike compresses."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def band_keys(sizes: list[tuple[int, int, int]]) -> np.ndarray:
    """About how many keys each band gets, from its number, sets and hashes, where sets are spread over segments at random."""
    out = np.zeros(len(EDGES))
    for band, sets, hashes in sizes:
        n = hashes / sets
        _, m, reserve = _plan(band)
        full = lambda m: m * (1 - math.exp(-n / m))
        a = n / m  # hashes a segment; those in segments of three or more have deletions
        out[band] += sets * (full(m) + reserve * (a - (a + a * a) * math.exp(-a)))
        out[band + 1] += sets * _asked(band + 1, band, int(n), int(full(_plan(band + 1)[1])))[1]
    return out


def _shares(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each band's share of 2^32 begins, and how wide it is."""
    ends = np.floor(np.concatenate([[0], np.cumsum(weights)]) / max(1.0, weights.sum()) * (1 << 32)).astype(np.int64)
    return ends[:-1], np.diff(ends)


def _part(key: np.ndarray, band: np.ndarray, shares: tuple[np.ndarray, np.ndarray], parts: int) -> np.ndarray:
    """The part of a key, by the place of its upper 24 of 48 bits in its band's share."""
    begin, wide = shares
    place_ = begin[band] + (wide[band] * (key >> np.uint64(24)).astype(np.int64) >> 24)
    return np.minimum(place_ * parts >> 32, parts - 1)


def _emit(weights: np.ndarray, parts: int):
    shares = _shares(weights)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            sets = shingle_sets(strings(b.column(0)))
            n, names = _class(sets)
            keys, docs, roles, bands, rest = [], [], [], [], []
            _, first = np.unique(names, return_index=True)
            for i in first[n[first] > 0].tolist():
                found, enough = _banded(sets[i])
                for k, role, band in found:
                    keys.append(k)
                    bands.append(np.full(len(k), band, np.int64))
                    docs.append(np.full(len(k), i, np.int64))
                    roles.append(np.full(len(k), role, np.uint8))
                if not enough:
                    rest.append(i)
            if not keys:
                continue
            key, doc, role = np.concatenate(keys), np.concatenate(docs), np.concatenate(roles)
            key &= np.uint64((1 << 48) - 1)
            part = _part(key, np.concatenate(bands), shares, parts)
            order = np.argsort(key, kind="stable")
            order = order[np.argsort(part[order] * SUBPARTS + (key[order] % np.uint64(SUBPARTS)).astype(np.int64), kind="stable")]
            key, doc, role, part = key[order], doc[order], role[order], part[order]
            rows: list[tuple] = []
            heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])).tolist()
            for lo, hi in zip(heads, [*heads[1:], len(part)]):
                p = int(part[lo])
                used, local = np.unique(doc[lo:hi], return_inverse=True)
                rows.append((p, _planes(key[lo:hi], 6), _planes(local.astype(np.uint64) << np.uint64(3) | role[lo:hi].astype(np.uint64), 3), names[used].tobytes(), n[used].astype("<u4").tobytes()))
            rows += [(-1, b"", b"", names[[i]].tobytes(), n[[i]].astype("<u4").tobytes()) for i in rest]
            kinds = (pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["p", "keys", "local", "names", "sizes"])

    return emit


_MET = "kind int, a long, b long, n long, role int, often long"


def _meet(group: pa.Table) -> pa.Table:
    """What the keys of one part say. A reducer takes SUBPARTS times ENTRIES keys, in which a set's name and size stand once, and unpacks one class of keys modulo SUBPARTS after the other."""
    if group.num_rows and group.column(0)[0].as_py() < 0:
        short = np.concatenate([np.frombuffer(x, "<i8") for x in group.column(3).to_pylist()])
        z = np.zeros(len(short), np.int64)
        return pa.table([pa.array(x) for x in ((z + 2).astype(np.int32), z, short, z, z.astype(np.int32), z)], names=["kind", "a", "b", "n", "role", "often"])
    rows = []
    for _, k, local, names, sizes in zip(*(c.to_pylist() for c in group.columns)):
        planes = np.frombuffer(k, np.uint8).reshape(6, -1)
        ends = np.searchsorted(planes[0] % SUBPARTS, np.arange(SUBPARTS + 1))
        rows.append((planes, np.frombuffer(local, np.uint8).reshape(3, -1), np.frombuffer(names, "<i8"), np.frombuffer(sizes, "<u4"), ends))
    return pa.concat_tables([_runs(rows, i) for i in range(SUBPARTS)])


def _runs(rows: list[tuple], nth_range: int) -> pa.Table:
    """Pairs of the runs of equal keys (kind 0: a < b); members of long runs (kind 1: a is the run, b the class, often the length); kind 2, from _meet: b needs the join on all hashes."""
    key, name, size, role = [], [], [], []
    for k, local, names, sizes, ends in rows:
        own = slice(ends[nth_range], ends[nth_range + 1])
        x = _unplanes(local[:, own].tobytes(), 3)
        d = (x >> np.uint64(3)).astype(np.int64)
        key.append(_unplanes(k[:, own].tobytes(), 6))
        name.append(names[d])
        size.append(sizes[d].astype(np.int64))
        role.append((x & np.uint64(7)).astype(np.int64))
    key, name, size, role = (np.concatenate(x) for x in (key, name, size, role))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = (np.concatenate([same, [False]]) | np.concatenate([[False], same]))[: len(key)]
    order, key = order[shared], key[shared]  # keys of one set only are gone
    order = order[np.lexsort((name[order], key))]
    key = np.sort(key)
    name, size, role = name[order], size[order], role[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])])
        role = np.bitwise_or.reduceat(role, np.flatnonzero(new))
        key, name, size = key[new], name[new], size[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    length = np.diff(np.append(starts, len(key)))
    if len(key):  # keys that no set asks for, or that none has that is asked, are gone
        met = np.repeat((np.bitwise_or.reduceat(role, starts) & (INDEX | PROBE)) == INDEX | PROBE, length)
        key, name, size, role = key[met], name[met], size[met], role[met]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        length = np.diff(np.append(starts, len(key)))
    run = np.repeat(length, length)
    nth = np.arange(len(key)) - np.repeat(starts, length)
    one, two = [], []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        ok = ((role[i] & PROBE) & ((role[j] & INDEX) << 1) != 0) | ((role[j] & PROBE) & ((role[i] & INDEX) << 1) != 0)
        ok &= 4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])
        one.append(name[i[ok]])
        two.append(name[j[ok]])

    for d in range(1, RUN):
        i = np.flatnonzero((run <= RUN) & (nth + d < run))
        if not len(i):
            break
        meet(i, i + d)
    long_ = run > RUN
    i = np.flatnonzero(long_ & (nth > 0))
    meet(i - nth[i], i)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    own = np.flatnonzero(long_)
    z = np.zeros(len(pairs), np.int64)
    cols = [
        np.concatenate([z, np.ones(len(own), np.int64)]).astype(np.int32),
        np.concatenate([pairs[:, 0], key[own].view(np.int64)]),
        np.concatenate([pairs[:, 1], name[own]]),
        np.concatenate([z, size[own]]),
        np.concatenate([z, role[own]]).astype(np.int32),
        np.concatenate([z, run[own]]),
    ]
    return pa.table([pa.array(c) for c in cols], names=["kind", "a", "b", "n", "role", "often"])


def _verified(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Of one bucket: the pairs (a, b) whose sets link, 100 * intersection >= 75 * union. Texts by name, repeats allowed."""
    name, first = np.unique(texts.column("name").to_numpy(), return_index=True)
    text = texts.column("text").take(pa.array(first))
    sets = []
    for part in few(pa.table([text], ["text"]).to_batches(), 4 << 20):
        sets += shingle_sets(strings(part.column(0)))
    one, two = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    ok = []
    for i, j in zip(np.searchsorted(name, one).tolist(), np.searchsorted(name, two).tolist()):
        x, y = sets[i], sets[j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        ok.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
    keep = np.array(ok, bool)
    return pa.table([pa.array(one[keep]), pa.array(two[keep])], names=["a", "b"])


def _seen_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, without those whose bucket and name this task has had."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        keep = []
        for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            keep.append(x not in seen)
            seen.add(x)
        yield b.filter(pa.array(keep, pa.bool_()))


def _in_buckets(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """bucket, a, b: pairs dealt so that few texts are needed in two buckets. sizes: name, n.

    What pairs connect goes to one bucket. Where that is over ENTRIES hashes, its pairs are dealt by b: each b is in one bucket, and the few
    that others were held against (a long run's least set) are in many.
    """
    spark = pairs.sparkSession
    at = components(pairs).select(F.col("node").alias("name"), "component")
    held = written(at.join(sizes, "name").groupBy("component").agg(F.sum("n").alias("held")), "held")
    large = held.where(F.col("held") > ENTRIES).select("component", F.lit(True).alias("large"))
    weight = held.where(F.col("held") <= ENTRIES).agg(F.coalesce(F.sum("held"), F.lit(0))).head()[0]
    dealt = pairs.join(at.withColumnRenamed("name", "a"), "a")
    own = F.col("component")
    if large.head(1):
        few_ = large.count() <= SENT_CLASSES
        dealt = dealt.join(F.broadcast(large) if few_ else large, "component", "left")
        own = F.when(F.col("large"), F.col("b")).otherwise(own)
        one, two = (sizes.select(F.col("name").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
        weight += dealt.where("large").join(one, "a").join(two, "b").agg(F.sum(F.col("na") + F.col("nb"))).head()[0]
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(weight / ENTRIES))
    return dealt.select(F.pmod(F.xxhash64(own), F.lit(many)).cast("int").alias("bucket"), "a", "b")


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """name, text of the wanted classes (name, and the hash of one text of it). A small list is broadcast, so that only wanted texts are shuffled."""
    wanted = written(wanted, "wanted")
    hint = F.broadcast if wanted.count() <= SENT_CLASSES else (lambda x: x)  # 16 bytes each
    hashed = docs.select(text_hash(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(hashed.join(hint(wanted), "hash").select("name", "text").dropDuplicates(["name"]), "texts")


def _rest(sets: DataFrame, rest: DataFrame) -> DataFrame:
    """Candidates (a < b) of the sets whose allocations fell short: exact, and as rare as such sets.

    A set of n hashes that links shares at least 3n/4 of them, so it shares one of any n - ceil(3n/4) + 1; the rarest are taken, so that
    a passage of many documents brings no pairs.
    """
    own = sets.join(rest.select("name").distinct(), "name", "left_semi").select(F.col("name").alias("a"), F.col("n").alias("an"), "h")
    held = sets.join(own.select("h").distinct(), "h", "left_semi")
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("often", "h"))
    few_ = own.join(often, "h").withColumn("rank", rank).where("rank <= an - ceil(an * 3 / 4) + 1")
    met = few_.join(held.select(F.col("name").alias("b"), F.col("n").alias("bn"), "h"), "h").where("a <> b AND 4 * least(an, bn) >= 3 * greatest(an, bn)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _set_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few(batches, SLICE):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(strings(b.column(1)))], pa.binary())], ["name", "hashes"])


def _all_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few(batches, 1 << 20):
        sets = shingle_sets(strings(b.column(0)))
        n, names = _class(sets)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["name", "n", "h"])


def _hashes_of(sizes: np.ndarray, some: np.ndarray):
    """As _all_hashes, but of sets that may link with one of those sizes (sorted) only, and of their hashes only some (sorted)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, 1 << 20):
            sets = shingle_sets(strings(b.column(0)))
            n, names = _class(sets)
            _, first = np.unique(names, return_index=True)
            least = sizes[np.minimum(np.searchsorted(sizes, -(-3 * n[first] // 4)), len(sizes) - 1)]
            first = first[(4 * least >= 3 * n[first]) & (3 * least <= 4 * n[first])]
            own = [sets[i] for i in first.tolist()]
            own = [s[some[np.minimum(np.searchsorted(some, s), len(some) - 1)] == s] for s in own]
            m = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[first], m)), pa.array(np.repeat(n[first], m)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64))], ["name", "n", "h"])

    return hashes


def _sharing(docs: DataFrame, text: str, rest: DataFrame, sketches: DataFrame) -> DataFrame:
    """name, n, h: of the sets in rest all hashes, of the sets that may link with one of them those that stand in one.

    Only these hashes are shuffled, not those of all sets. Each pass over the texts looks for ENTRIES hashes at most.
    """
    texts = _texts(docs, text, rest.select("name").distinct().join(sketches.select("name", "hash"), "name"))
    own = written(texts.select("text").mapInArrow(_all_hashes, "name long, n long, h long"), "own")
    forget(texts)
    sizes = np.sort(own.select("n").distinct().toArrow().column(0).to_numpy())
    passes = math.ceil(own.select("h").distinct().count() / ENTRIES)
    out = []
    for i in range(passes):
        h = own.where(F.pmod("h", F.lit(passes)) == i).select("h").distinct().toArrow().column(0).to_numpy()
        some = np.sort(h.view(np.uint64))
        out.append(written(docs.select(text).mapInArrow(_hashes_of(sizes, some), "name long, n long, h long").distinct(), "sets"))
    return functools.reduce(DataFrame.union, out)


def _dealt(runs: DataFrame) -> DataFrame:
    """Members of runs, cut into `blocks` parts, once in each pair of parts that holds their own: part, block."""
    part = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    dealt = runs.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("block", F.least("part", "other") * F.col("blocks") + F.greatest("part", "other"))


def _grid(runs: DataFrame) -> DataFrame:
    """Members of runs in `down` parts of probes and `across` parts of others, once in each block of the grid that their roles need."""
    spread = F.xxhash64("name")
    i, j = F.pmod(spread, F.col("down")).cast("int"), F.pmod(spread, F.col("across")).cast("int")
    asks, has, none = F.col("role").bitwiseAND(PROBE) != 0, F.col("role").bitwiseAND(INDEX) != 0, F.array().cast("array<int>")
    row = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda y: i * F.col("across") + y)
    column = F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda x: x * F.col("across") + j)
    dealt = runs.withColumn("block", F.explode(F.array_union(F.when(asks, row).otherwise(none), F.when(has, column).otherwise(none))))
    here = F.when(asks & (F.floor(F.col("block") / F.col("across")) == i), PROBE).otherwise(0) + F.when(has & (F.col("block") % F.col("across") == j), INDEX).otherwise(0)
    return dealt.withColumn("role", here)


def jaccard_links(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Membership (id, n_shingles, name: the class, null without a set), and the component of each linked class (node, component)."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id].dataType.simpleString()

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            sets = shingle_sets(strings(b.column(1)))
            n, names = _class(sets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(names, mask=n == 0), pa.array([_sketch(x) if len(x) else None for x in sets], pa.binary()), pa.array([slack(x) for x in sets], pa.list_(pa.int32())), b.column(2)], [id, "n_shingles", "name", "sketch", "slack", "hash"])

    members = written(docs.select(id, text, text_hash(F.col(text))).mapInArrow(size, f"`{id}` {kind}, n_shingles long, name long, sketch binary, slack array<int>, hash long"), "members")
    band = F.size(F.filter(F.lit(EDGES.tolist()), lambda e: e <= F.col("n_shingles"))) - 1
    often = members.where("n_shingles > 0").groupBy("n_shingles").count()
    sizes = often.groupBy(band.alias("band")).agg(F.sum("count"), F.sum(F.col("count") * F.col("n_shingles"))).collect()
    weights = band_keys([tuple(r) for r in sizes])
    parts = max(8, math.ceil(weights.sum() / (SUBPARTS * ENTRIES)))
    once = each_once(docs, text, members.select("hash"))
    sent = once.select("text").mapInArrow(_emit(weights, parts), "p int, keys binary, local binary, names binary, sizes binary")
    met = written(sent.groupBy("p").applyInArrow(_meet, _MET), "met")
    release(spark)
    sketches = written(members.where("name IS NOT NULL").select("name", F.col("n_shingles").alias("n"), "sketch", "slack", "hash").dropDuplicates(["name"]), "sketches")
    one = sketches.select(F.col("name").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("ak"))
    two = sketches.select(F.col("name").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bk"))

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "ak", "bk").mapInArrow(_may_link, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        dealt = written(_in_buckets(pairs, sketches.select("name", "n")), "dealt")
        wanted = dealt.select("bucket", F.col("a").alias("name")).union(dealt.select("bucket", "b")).distinct()
        wanted = written(wanted.join(sketches.select("name", "hash"), "name"), "wanted")
        release(spark)
        hint = F.broadcast if wanted.count() <= SENT_CLASSES else (lambda x: x)  # 20 bytes each
        hashed = docs.select(text_hash(F.col(text)).alias("hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        texts = hashed.join(hint(wanted), "hash").select("bucket", "name", "text").mapInArrow(_seen_once, "bucket int, name long, text string")
        out = written(texts.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(_verified, "a long, b long"), "links")
        for used in (dealt, wanted):
            forget(used)
        return out

    links = verified(written(near(met.where("kind = 0").select("a", "b").distinct()), "pairs"))
    release(spark)
    names = components(links)
    runs = met.where("kind = 1").select(F.col("a").alias("run"), F.col("b").alias("name"), "n", "role", "often")
    asks, has = F.col("role").bitwiseAND(PROBE) != 0, F.col("role").bitwiseAND(INDEX) != 0
    # the probes that remain: each set leaves out as many of its longest runs as it has slack, in either band
    probes = runs.where(asks).select("run", "name", "often", F.when(F.col("role").bitwiseAND(NEXT) != 0, 1).otherwise(0).alias("next"))
    rank = F.row_number().over(Window.partitionBy("name", "next").orderBy(F.desc("often"), "run"))
    ranked = probes.join(sketches.select("name", "slack"), "name").withColumn("rank", rank)
    probes = written(ranked.where(F.col("rank") > F.get("slack", F.col("next"))).select("run", "name", F.lit(PROBE).alias("asks")), "probes")
    left = written(probes.select("run").distinct(), "left")
    hint = F.broadcast if left.count() <= SENT_CLASSES else (lambda x: x)  # 8 bytes each
    runs = runs.join(hint(left), "run", "left_semi").join(probes, ["run", "name"], "left")
    role = F.col("role").bitwiseAND(INDEX).bitwiseOR(F.coalesce("asks", F.lit(0)))
    runs = runs.select("run", "name", "n", role.alias("role")).where("role <> 0")
    # runs whose members are not all connected yet
    at = runs.join(names, runs.name == names.node, "left").select("run", "name", "n", "role", F.coalesce("component", "name").alias("component"))
    blocks = lambda of: F.greatest(F.lit(1), F.ceil(F.count_if(of) / WIDE), F.ceil(F.sum(F.when(of, F.col("n"))) / (16 * ENTRIES))).cast("int")  # noqa: E731  # sketches have at most four bits a hash
    open_ = at.groupBy("run").agg((F.min("component") != F.max("component")).alias("open"), blocks(asks).alias("down"), blocks(has).alias("across")).where("open").drop("open")
    runs = written(at.join(open_, "run"), "runs")
    if runs.head(1):
        full = _grid(runs).join(sketches.select("name", "sketch"), "name").select("run", "block", "name", "n", "role", "component", "sketch")
        active = full.groupBy("run", "block").applyInArrow(_active, "run long, name long, component long, n long").distinct()
        active = written(active, "active")
        # runs with the same active members need one look
        like = active.groupBy("run").agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("name").cast("decimal(38,0)"))).alias("like"), F.ceil(F.sum("n") / ENTRIES).cast("int").alias("blocks"))
        looks = like.groupBy("like").agg(F.min(F.struct("run", "blocks")).alias("look")).select("look.*")
        wanted = active.select("name").distinct().join(sketches.select("name", "hash"), "name")
        sets = _texts(docs, text, wanted).mapInArrow(_set_bytes, "name long, hashes binary")
        fresh = _dealt(active.join(looks, "run")).join(sets, "name").select("run", "block", "name", "component", "hashes")
        fresh = written(fresh.groupBy("run", "block").applyInArrow(_star, "a long, b long").distinct(), "links")
        if fresh.head(1):
            links = links.union(fresh)
            names = components(links)
    rest = met.where("kind = 2").select(F.col("b").alias("name"))
    if rest.head(1):
        links = links.union(verified(written(_rest(_sharing(docs, text, rest, sketches), rest), "pairs")))
        names = components(links)
    for used in (met, runs, sketches):
        forget(used)
    return members, names


SALTS = 16


def linked(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id that links reach) and name (the class) for every row."""
    members, names = jaccard_links(docs, id=id, text=text)
    own = members.where("name IS NOT NULL").groupBy("name").agg(F.min(id).alias("least"))
    own = written(own.join(names, own.name == names.node, "left").select("name", "least", F.coalesce("component", "name").alias("component")), "classes")
    # a component may hold a large part of all classes: its rows go to SALTS tasks, its least id with each of them
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")
    part = own.groupBy("component", salt.alias("salt")).agg(F.min("least").alias("least")).groupBy("component").agg(F.min("least").alias("component_id"))
    part = part.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = own.withColumn("salt", salt).join(part, ["component", "salt"]).select(F.col("name").alias("node"), "component_id")
    out = members.join(ids, F.col("name") == F.col("node"), "left")
    return out.select(id, "n_shingles", F.when(F.col("name").isNull(), F.col(id)).otherwise(F.col("component_id")).alias("component_id"), "name")


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row whose id is its component_id.

    Rows without a set (null or empty texts, no words) stay. Of rows that share that id and the class, one stays: that with the least
    text, then in the order of the other columns as text. Columns may have any names.
    """
    columns = docs.columns
    id, text, docs = place(docs, id), place(docs, text), numbered(docs)
    key = F.coalesce(F.col(id).cast("string"), F.lit("null"))
    every = linked(docs, id=id, text=text)
    at = written(every.where("name IS NOT NULL"), "linked")
    forget(every)  # members and classes
    first = F.col(id).eqNullSafe(F.col("component_id"))
    mark = F.xxhash64(key, "name").alias("mark")
    gone = written(at.where(~first).select(mark).distinct(), "gone")
    many = written(at.where(first).groupBy(id, "name").count().where("count > 1").select(mark), "many")
    marked = docs.mapInArrow(_named(docs.columns.index(text)), T.StructType([*docs.schema.fields, T.StructField("name", T.LongType())]))
    hint = F.broadcast if gone.count() <= SENT_CLASSES else (lambda x: x)  # 8 bytes each; beyond that Spark shuffles
    kept = marked.withColumn("own", F.xxhash64(key, "name")).join(hint(gone), F.col("own") == F.col("mark"), "left_anti")
    if many.head(1):  # whole rows repeat
        hint = F.broadcast if many.count() <= SENT_CLASSES else (lambda x: x)
        order = F.struct(F.col(text), *[F.col(c).cast("string") for c in docs.columns])
        again = kept.join(hint(many), F.col("own") == F.col("mark"), "left_semi")
        again = again.groupBy("own").agg(F.min_by(F.struct(*again.columns), order).alias("least")).select("least.*")
        kept = kept.join(hint(many), F.col("own") == F.col("mark"), "left_anti").unionByName(again)
    return kept.select(*docs.columns).toDF(*columns)


def _named(at: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches, SLICE):
            n, names = _class(shingle_sets(strings(b.column(at))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, mask=n == 0)], [*b.schema.names, "name"])

    return name


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
