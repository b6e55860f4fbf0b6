from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import chat, flac
from tessella.llm.mixing import mixed_documents, mixed_sizes, sainte_lague, targets


@given(st.integers(0, 80), st.lists(st.integers(0, 60), min_size=1, max_size=8).filter(any))
@settings(max_examples=200, deadline=None)
def test_highest_quotients(seats, votes):
    out = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * out[i] + 1), -i))
        out[i] += 1
    assert sainte_lague(seats, [Fraction(v) for v in votes]) == out


def test_targets():
    assert [float(x) for x in targets([10, 100, 1000, 0, 5], [5, 2, 1, 5, 2])] == [30, 300, 770, 0, 15]
    assert targets([], []) == [] and targets([0], [5]) == [0]


def test_mix(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 200)), rng.choice(["a"] * 8 + ["b", "c", "Z"]) if i % 50 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_sizes(docs, shard_words=20_000).collect()
    assert len(got) == 2000 and sorted(map(tuple, got)) == sorted(map(tuple, mixed_sizes(docs.repartition(7), shard_words=20_000).collect()))
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    names = sorted(size, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == [float(x) for x in targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in names)
    assert mixed_sizes(none).collect() == [] and len(mixed_sizes(odd).collect()) == odd.count()
    out = mixed_documents(docs)
    assert out.columns == docs.columns and abs(out.count() - 2000) < 1500
    mixed_documents(odd).collect()


def test_template_is_reversible():
    turns = [("user", "a<b\\</turn>\n<turn>x"), ("assi\nst\\", "\\"), ("assistant", ""), ("assistant", chat.TRICKY)]
    text, spans = chat.formatted(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == ["", chat.TRICKY]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<b\n"]), st.text("ab<\\/turn>\n#é", max_size=30)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_turns(turns):
    assert chat.parse(chat.formatted(turns)[0]) == turns


def test_layouts(spark):
    records = [
        {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "n", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"what": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(6, None), (7, "no json")], "id long, r string")
    got = {r.id: r.turns and [tuple(t) for t in r.turns] for r in chat.canonical_json(df, id="id", record="r").collect()}
    u, a = "user", "assistant"
    assert got == {0: [(u, "p"), (a, "r")], 1: [(u, "i"), (a, "o")], 2: [(u, "i\n\nn"), (a, "o")], 3: [(u, "u"), (a, "a")], 4: [(u, "h"), (a, "g")], 5: None, 6: None, 7: None}
    assert chat.read_back(chat.format_chat(chat.canonical_json(df, id="id", record="r"), id="id"), id="id").count() == 8


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, 0, None, "x", 0), (2, 0, "user", "q", 0), (2, 0, "user", "q", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_chat(chat.canonical_rows(df), id="conv_id"), id="conv_id").collect()}
    assert got == {1: 2, None: 1, 2: 2}
    assert chat.canonical_rows(df.where("false")).collect() == []


PAYLOADS = [b"", b"a", b"a" * 576, bytes([255]) * 576, np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8).tobytes(), bytes([0, 255]) * 3000, bytes(range(256)) * 30, b"\x00" * 575 + b"\xff" + b"\x80" * 576, (b"\x7f" * 40 + b"\x80") * 200, b"hello world " * 900]


def test_flac_round_trip():
    payloads = [flac.padded(x) for x in PAYLOADS]
    streams = flac.encode(payloads)
    assert [(x.view(np.uint8) ^ 0x80).tobytes() for x in flac.decode(streams)] == payloads
    assert flac.encode([payloads[-1]])[0] == streams[-1]  # the same alone as among others
    assert len(streams[-1]) < len(payloads[-1])


@given(st.binary(max_size=2000))
@settings(max_examples=40, deadline=None)
def test_flac_any_bytes(data):
    p = flac.padded(data)
    assert (flac.decode(flac.encode([p]))[0].view(np.uint8) ^ 0x80).tobytes() == p


@pytest.mark.parametrize("at", [0.3, 0.6, 0.99])
def test_flac_checksums(at):
    stream = bytearray(flac.encode([flac.padded(b"some text to be stored " * 60)])[0])
    start = 42 + 4 + 18 * 3  # past the metadata
    stream[start + int(at * (len(stream) - start))] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(stream)])


def test_flac_columns(odd, none):
    media = flac.to_flac(odd)
    got = flac.media_digest(media).collect()
    want = sorted(len((r.text or "").encode()) for r in odd.collect())
    assert sorted(r.n_bytes for r in got) == want and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in got)
    # the digests by brute force: the payload from the text, the stored bytes read by the frame-by-frame decoder
    payload = lambda t: (x := (t or "").encode()) + b"\xff" * (-len(x) % 576 or (0 if x else 576))
    stored = {hashlib.sha256(bytes(r.media)).hexdigest(): bytes(r.media) for r in media.collect()}
    brute = []
    for r in odd.collect():
        p = payload(r.text)
        y = [b - 128 for b in p]
        cross = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
        brute.append((r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), f"sum={sum(y)};energy={sum(v * v for v in y)};crossings={cross};peak={max(map(abs, y))}"))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got if r.doc_id is not None) == sorted(x for x in brute if x[0] is not None)
    for r in got:
        again = (flac.decode_any(stored[r.media_sha256])[:, 0] + 128).astype(np.uint8).tobytes()
        assert len(stored[r.media_sha256]) == r.media_bytes and hashlib.sha256(again).hexdigest() == r.payload_sha256
    long_ = next(r for r in odd.collect() if len(r.text or "") > 30_000)
    blocks = flac.to_pcm(media).where(F.col("doc_id").eqNullSafe(F.lit(long_.doc_id))).orderBy("sample_offset").collect()
    assert all(r.sample_offset % flac.PCM_BLOCK == 0 and (r.channels, r.bits) == (1, 8) for r in blocks) and blocks[0].sample_offset == 0 and len(blocks) > 1
    assert flac.to_pcm(media.withColumn("media", F.lit(None).cast("binary"))).collect() == []
    assert flac.media_digest(flac.to_flac(none)).collect() == []


class Bits:
    """A writer of FLAC frames of its own, to read by the decoder."""

    def __init__(self):
        self.s = ""

    def put(self, x, n):
        self.s += format(x & ((1 << n) - 1), f"0{n}b") if n else ""
        return self

    def bytes(self):
        return int(self.s + "0" * (-len(self.s) % 8), 2).to_bytes((len(self.s) + 7) // 8)


def crc(data, poly, bits):
    c = 0
    for x in data:
        c ^= x << bits - 8
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> bits - 1 else 0)
            c &= (1 << bits) - 1
    return c


def subframe(w, x, bits, kind, wasted=0):
    w.put(0, 1).put({"constant": 0, "verbatim": 1, "fixed3": 11, "lpc2": 33}[kind], 6).put(bool(wasted), 1)
    if wasted:
        w.put(1, wasted)
        x, bits = [v >> wasted for v in x], bits - wasted
    if kind == "constant":
        return w.put(x[0], bits)
    if kind == "verbatim":
        for v in x:
            w.put(v, bits)
        return w
    order = 3 if kind == "fixed3" else 2
    for v in x[:order]:
        w.put(v, bits)
    if kind == "lpc2":
        w.put(9, 4).put(4, 5).put(30, 10).put(-15, 10)
        r = [x[i] - ((30 * x[i - 1] - 15 * x[i - 2]) >> 4) for i in range(2, len(x))]
        w.put(1, 2).put(2, 4)  # 5-bit parameters, four partitions
        parts, width = 4, 5
    else:
        r = [x[i] - 3 * x[i - 1] + 3 * x[i - 2] - x[i - 3] for i in range(3, len(x))]
        w.put(0, 2).put(0, 4)
        parts, width = 1, 4
    at = 0
    for p in range(parts):
        m = len(x) // parts - (order if p == 0 else 0)
        own, at = r[at : at + m], at + m
        if p == 2:  # an escaped partition
            w.put((1 << width) - 1, width).put(28, 5)
            for v in own:
                w.put(v, 28)
        else:
            k = 9
            w.put(k, width)
            for v in own:
                u = v << 1 if v >= 0 else -2 * v - 1
                w.put(1, (u >> k) + 1).put(u, k)
    return w


def stream_of(frames, total, rate, channels, bits, samples):
    pcm = b"".join(int(v).to_bytes(-(-bits // 8), "little", signed=True) for row in samples for v in row)
    info = (16).to_bytes(2) + (4096).to_bytes(2) + bytes(6) + ((rate << 44) | (channels - 1 << 41) | (bits - 1 << 36) | total).to_bytes(8) + hashlib.md5(pcm).digest()
    return b"fLaC" + b"\x00" + (34).to_bytes(3) + info + b"\x84" + (4).to_bytes(3) + b"note" + b"".join(frames)


def frame(number, n, place, size_code, subframes):
    w = Bits().put(0xFFF8, 16).put(7, 4).put(9, 4).put(place, 4).put(size_code, 3).put(0, 1)
    if number < 128:
        w.put(number, 8)
    else:
        w.put(0xC0 | number >> 6, 8).put(0x80 | number & 63, 8)
    w.put(n - 1, 16)
    w.put(crc(w.bytes(), 0x07, 8), 8)
    for args in subframes:
        subframe(w, *args)
    data = w.bytes()
    return data + crc(data, 0x8005, 16).to_bytes(2)


def test_flac_of_another_encoder(spark):
    """16 bits, stereo in all four codings, other block sizes, wasted bits, partitions, escapes, no seek table; mono with 24 bits."""
    rng = np.random.default_rng(3)
    left = (8000 * np.sin(np.arange(400) / 9) + rng.integers(-300, 300, 400)).astype(int)
    right = (left * 0.9 + rng.integers(-50, 50, 400)).astype(int)
    frames, want = [], []
    for i, (place, kinds) in enumerate([(1, ("lpc2", "fixed3")), (8, ("fixed3", "lpc2")), (9, ("lpc2", "verbatim")), (10, ("verbatim", "lpc2"))]):
        a, b = left[100 * i : 100 * i + 100].tolist(), right[100 * i : 100 * i + 100].tolist()
        side = [x - y for x, y in zip(a, b)]
        coded = {1: (a, b), 8: (a, side), 9: (side, b), 10: ([x + y >> 1 for x, y in zip(a, b)], side)}[place]
        bits = {1: (16, 16), 8: (16, 17), 9: (17, 16), 10: (16, 17)}[place]
        frames.append(frame(127 + i, 100, place, 4, list(zip(coded, bits, kinds))))
        want += list(zip(a, b))
    quiet = [64 * x for x in range(-8, 8)]
    frames.append(frame(200, 16, 1, 0, [(quiet, 16, "verbatim", 6), ([5] * 16, 16, "constant")]))
    want += [(x, 5) for x in quiet]
    stream = stream_of(frames, len(want), 44100, 2, 16, want)
    assert flac.decode_any(stream).tolist() == [list(x) for x in want]
    high = rng.integers(-(1 << 23), 1 << 23, 40).tolist()
    mono = stream_of([frame(0, 40, 0, 6, [(high, 24, "verbatim")])], 0, 96000, 1, 24, [(x,) for x in high])
    assert flac.decode_any(mono)[:, 0].tolist() == high
    own = flac.encode([flac.padded(b"between two strangers")])[0]
    assert [len(x) for x in flac.decode([stream, own, mono])] == [416, 576, 40]
    got = flac.to_pcm(spark.createDataFrame([(1, bytearray(stream)), (2, None), (3, bytearray(mono))], "doc_id int, media binary")).collect()
    pcm = b"".join(int(v).to_bytes(2, "little", signed=True) for row in want for v in row)
    assert [(r.doc_id, r.sample_offset, r.channels, r.bits) for r in got] == [(1, 0, 2, 16), (3, 0, 1, 24)] and bytes(got[0].pcm) == pcm
    for at in (60, 120, len(stream) - 5):
        broken = bytearray(stream)
        broken[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode_any(bytes(broken))
    for bad in (b"", b"RIFF", stream[:30], stream[:-40]):
        with pytest.raises(ValueError):
            flac.decode_any(bad)


def test_flac_with_few_seek_points(monkeypatch):
    monkeypatch.setattr(flac, "SEEK_BYTES", 18 * 3)
    p = flac.padded(bytes(range(200)) * 40)
    stream = flac.encode([p])[0]
    assert 0 < len(flac.head_of(stream).samples) <= 3 and (flac.decode([stream])[0][:, 0] + 128).astype(np.uint8).tobytes() == p


def test_sizes_and_shares_of_many_sources(spark):
    """No cap that a dirty source column reaches; what is taken follows from blocks and quotas by brute force."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w ', repeat('v ', int(id % 7))) AS text", "concat('s', id % 1500) AS source")
    got = mixed_sizes(docs, block=2).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    names = sorted(sizes)
    want = targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    quota = dict(zip(names, sainte_lague(round(sum(sizes.values()) / 2), want)))
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.target == float(want[names.index(r.source)]) and r.source_size == sizes[r.source]
    for s in names:
        blocks = max(1, round(Fraction(sizes[s], 2)))
        passes, rest = divmod(min(quota[s], 3 * blocks), blocks)
        low, high = passes * sizes[s] + rest * (sizes[s] // blocks), passes * sizes[s] + rest * -(-sizes[s] // blocks)
        assert low <= taken[s] <= high, s


def test_mix_with_clashing_names(spark):
    rows = [(i, "word " * 20, "ab"[i % 2], i, "x", 1, 2, "s", 3, 4) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long, _source string, _id int, _print int, print string, nth int, copies int")
    out = mixed_documents(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(map(tuple, docs.collect()))


def test_deeply_nested_json(spark):
    deep = "[" * 200_000 + "]" * 200_000
    df = spark.createDataFrame([(1, deep), (2, None), (3, "{"), (4, '{"a":' * 5000 + "1" + "}" * 5000), (5, '{"prompt": "p", "response": "r"}')], "id int, r string")
    got = {r.id: r.turns for r in chat.canonical_json(df, id="id", record="r").collect()}
    assert all(got[i] is None for i in (1, 2, 3, 4)) and [tuple(t) for t in got[5]] == [("user", "p"), ("assistant", "r")]


def test_turn_rows_with_more_columns(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "b", "x"), (1, 1, "user", "a", "y"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.canonical_rows(df).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], None: [("", "")]}
    with pytest.raises(ValueError):
        chat.canonical_rows(df.drop("role"))


def test_records_with_more_fields(spark):
    said, turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], [("user", "a"), ("assistant", "b")]
    cases = [
        ({"messages": said, "id": 7, "source": "web", "meta": {"k": [1]}}, turns),
        ({"messages": [said[0] | {"name": "Ann"}, said[1]]}, turns),
        ({"messages": []}, []),
        ({"system": "s", "messages": [], "id": 1}, [("system", "s")]),
        ({"messages": [], "prompt": "a", "response": "b"}, turns),
        ({"prompt": "a", "response": "b", "system": "s", "id": 1}, [("system", "s"), *turns]),
        ({"conversations": [{"from": "human", "value": "a", "weight": 1}, {"from": "gpt", "value": "b"}], "id": "x"}, turns),
        ({"messages": [said[0], {"role": "user", "content": [{"type": "text", "text": "b"}]}]}, None),
        ({"messages": [said[0], "b"]}, None),
        ({"id": 1, "title": "t"}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "id int, r string")
    got = {r.id: r.turns if r.turns is None else [tuple(t) for t in r.turns] for r in chat.canonical_json(df, id="id", record="r").collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
