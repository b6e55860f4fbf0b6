"""FLAC columns: byte payloads as lossless 8-bit mono FLAC, and FLAC streams back to PCM blocks with seekable sample offsets.

encode() writes frames of 576 samples. It tries the constant, fixed (order 0, 1) and a quantised order-4 linear predictor
for each frame, Rice-codes the residual, and falls back to verbatim. A seek point for each frame (for every k-th, where the table would pass the
format's 16 MB) lets decode() read all frames of a batch side by side. Any other stream (8 to 24 bits, up to 8 channels, any block size, side
channels, wasted bits, partitions, with or without a seek table) is read frame by frame by decode_any().
Both check each frame header's CRC-8, each frame's CRC-16 and the stream's MD5, and raise on the first that differs.

A null or empty text is stored as one frame of bytes 255. Memory is bounded by one Arrow batch, or one longer stream, plus LANES frames at work.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import few, raw, ship, strings, table

BLOCK, RATE, PAD, LANES, ORDER, PRECISION, SHIFT, SEEK_BYTES = 576, 8000, 255, 4096, 4, 9, 6, (1 << 24) - 18
#: Fixed predictors of orders 0 to 4, as the format defines them.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEAD16 = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _crc8(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint16)
    for j in range(rows.shape[1]):
        crc = np.where(j < sizes, _CRC8[crc ^ rows[:, j]], crc)
    return crc


def _crc16(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    crc, cols = np.zeros(len(rows), np.uint16), np.ascontiguousarray(rows.T)
    least = int(sizes.min()) if len(sizes) else 0
    for j in range(rows.shape[1]):
        new = (crc << np.uint16(8)) ^ _CRC16[(crc >> np.uint16(8)) ^ cols[j]]
        crc = new if j < least else np.where(j < sizes, new, crc)
    return crc


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantised order-4 predictors of the rows of x, by Levinson-Durbin on their autocorrelations."""
    f = x.astype(np.float32)
    r = np.stack([(f[:, j:] * f[:, : BLOCK - j]).sum(1, dtype=np.float64) for j in range(ORDER + 1)], 1)
    a, err = np.zeros((len(x), ORDER + 1)), r[:, 0] * (1 + 1e-9) + 1e-9
    a[:, 0] = 1
    for i in range(1, ORDER + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(1) / err
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i] if i > 0 else 0
        err = err * (1 - k * k) + 1e-12
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(-a[:, 1:] * (1 << SHIFT)), -top, top).astype(np.int64)


def _residual(x: np.ndarray, coefs: np.ndarray, order: int, shift: int) -> np.ndarray:
    """Residuals from sample `order` on."""
    guess = np.zeros((len(x), BLOCK - order), np.int32)
    for j in range(order):
        guess += coefs[:, j : j + 1].astype(np.int32) * x[:, order - 1 - j : BLOCK - 1 - j]
    return x[:, order:] - (guess >> shift)


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A good Rice parameter for each row, and the bits it takes."""
    n = u.shape[1]
    mean = u.mean(1)
    best = np.full(len(u), 1 << 40, np.int64)
    k = np.zeros(len(u), np.int64)
    guess = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7)).astype(np.int64), 0, 13)
    for d in (0, 1):
        kk = np.minimum(guess + d, 14)
        bits = (u >> kk[:, None].astype(np.int32)).sum(1, dtype=np.int64) + n * (1 + kk)
        k, best = np.where(bits < best, kk, k), np.minimum(bits, best)
    return k, best


def _number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: up to 5 bytes, and how many."""
    out, size = np.zeros((len(n), 5), np.uint8), np.ones(len(n), np.int64)
    for bytes_, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8)):
        low = 0 if bytes_ == 1 else 1 << (7 if bytes_ == 2 else 5 * bytes_ - 4)
        top = 1 << (7 if bytes_ == 1 else 5 * bytes_ + 1)
        on = (n >= low) & (n < top)
        size[on] = bytes_
        for j in range(bytes_):
            part = n[on] >> (6 * (bytes_ - 1 - j))
            out[on, j] = (part if bytes_ == 1 else (lead | part) if j == 0 else 0x80 | (part & 0x3F)).astype(np.uint8)
    return out, size


def _frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Encoded frames of the rows of x (int32 samples)."""
    n = len(x)
    none = np.zeros((n, ORDER), np.int64)
    tries = [(o, _residual(x, np.tile(FIXED[o], (n, 1)), o, 0)) for o in range(2)]
    coefs = _linear(x)
    tries.append((ORDER, _residual(x, coefs, ORDER, SHIFT)))
    cost, ks, us = [], [], []
    for i, (o, r) in enumerate(tries):
        u = _zigzag(r)
        k, bits = _rice(u)
        cost.append(bits + 8 * o + 10 + (9 + ORDER * PRECISION if i == 2 else 0))
        ks.append(k)
        us.append(u)
    cost.append(np.full(n, 8 * BLOCK))
    pick = np.argmin(np.stack(cost), 0)
    pick[(x == x[:, :1]).all(1)] = 4
    head, head_size = np.zeros((n, 9), np.uint8), None
    head[:, :4] = (0xFF, 0xF8, 0x24, 0x02)  # 576 samples, 8 kHz, mono, 8 bits
    code, code_size = _number(number)
    head[:, 4:] = code
    head_size = 4 + code_size
    crc8 = _crc8(head, head_size)
    out: list[bytes] = [b""] * n
    for kind in range(5):
        rows = np.flatnonzero(pick == kind)
        if not len(rows):
            continue
        g, own = len(rows), x[rows]
        values, widths = [], []

        def put(value, width):
            values.append(np.broadcast_to(np.asarray(value, np.int32).reshape(-1, 1) if np.ndim(value) < 2 else value, (g, np.shape(value)[1] if np.ndim(value) == 2 else 1)))
            widths.append(np.broadcast_to(np.asarray(width, np.int32).reshape(-1, 1) if np.ndim(width) < 2 else width, values[-1].shape))

        put(head[rows].astype(np.int32), np.where(np.arange(9) < head_size[rows, None], 8, 0))
        put(crc8[rows], 8)
        if kind == 4:
            put(0, 8)
            put(own[:, 0] & 255, 8)
        elif kind == 3:
            put(2, 8)
            put(own & 255, 8)
        else:
            o = tries[kind][0]
            put((0x20 | (ORDER - 1) if kind == 2 else 8 | o) << 1, 8)
            if o:
                put(own[:, :o] & 255, 8)
            if kind == 2:
                put(PRECISION - 1, 4)
                put(SHIFT, 5)
                put(coefs[rows] & ((1 << PRECISION) - 1), PRECISION)
            k = ks[kind][rows][:, None].astype(np.int32)
            put(0, 6)  # 4-bit Rice parameters, one partition
            put(k, 4)
            u = us[kind][rows]
            put((1 << k) | (u & ((1 << k) - 1)), (u >> k) + 1 + k)
        value, width = np.concatenate(values, 1).astype(np.uint64), np.concatenate(widths, 1)
        end = np.cumsum(width, 1, dtype=np.int64)
        size = (end[:, -1] + 7) // 8
        wide = int(size.max())
        slots = (wide + 3) // 4  # 32-bit words a row; fields don't overlap, so sums of their parts are exact
        end += np.arange(g)[:, None] * (slots * 32) - 1
        placed = value << (31 - (end & 31)).astype(np.uint64)
        word = (end >> 5).ravel()
        low = np.bincount(word, (placed & np.uint64(0xFFFFFFFF)).ravel().astype(np.float64), g * slots)
        over = np.bincount(np.maximum(word - 1, 0), (placed >> np.uint64(32)).ravel().astype(np.float64), g * slots)
        data = (low + over).astype(">u4").view(np.uint8).reshape(g, slots * 4)[:, :wide]
        crc = _crc16(data, size)
        whole = np.zeros((g, wide + 2), np.uint8)
        whole[:, :wide] = data
        whole[np.arange(g), size] = crc >> 8
        whole[np.arange(g), size + 1] = crc & 255
        for i, row, m in zip(rows.tolist(), whole, (size + 2).tolist()):
            out[i] = row[:m].tobytes()
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; their sizes are positive multiples of 576. Bytes are samples, the top bit flipped."""
    all_ = np.frombuffer(b"".join(payloads), np.uint8)
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    frames: list[bytes] = []
    for a in range(0, len(number), LANES):
        x = (all_[a * BLOCK : (a + LANES) * BLOCK] ^ 0x80).view(np.int8).astype(np.int32).reshape(-1, BLOCK)
        frames += _frames(x, number[a : a + LANES])
    out, at = [], 0
    for p, n in zip(payloads, counts.tolist()):
        own = frames[at : at + n]
        at += n
        sizes = [len(f) for f in own]
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3) + ((RATE << 44) | (7 << 36) | len(p)).to_bytes(8) + hashlib.md5(pcm).digest()
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["n"] = np.arange(n) * BLOCK, BLOCK
        seek["offset"][1:] = np.cumsum(sizes[:-1])
        seek = seek[:: -(-seek.nbytes // SEEK_BYTES)]
        out.append(b"".join([b"fLaC\x00\x00\x00\x22", info, b"\x83", seek.nbytes.to_bytes(3), seek.tobytes(), *own]))
    return out


@dataclass
class Info:
    """What the head of a stream says; first is where its frames begin."""

    first: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    samples: np.ndarray
    offsets: np.ndarray


def head_of(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, info, seek = 4, False, b"", np.zeros(0, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the head of a stream is cut short")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        elif kind == 3:
            seek = np.frombuffer(stream, seek.dtype, size // 18, at + 4)
        at += 4 + size
    if len(info) < 34:
        raise ValueError("no stream information")
    x = int.from_bytes(info[10:18])
    return Info(at, x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & ((1 << 36) - 1), info[18:34], seek["sample"].astype(np.int64), seek["offset"].astype(np.int64) + at)


def _own(head: Info, stream: bytes) -> bool:
    """Whether decode() can read the stream's frames side by side: this encoder's profile, and a seek point for each frame."""
    return (head.channels, head.bits, head.rate) == (1, 8, RATE) and len(head.samples) * BLOCK == head.total > 0 and stream[head.first : head.first + 4] == b"\xff\xf8\x24\x02"


def _decode_frames(data: np.ndarray, start: np.ndarray, end: np.ndarray, checked: bool = False) -> np.ndarray:
    """Samples (frames by 576) of the frames data[start:end]; data has 16 bytes to spare."""
    n = len(start)
    size = end - start
    wide = int(size.max())
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(wide, np.uint8)]), wide)[start]
    if (rows[:, :4] != np.array([0xFF, 0xF8, 0x24, 0x02], np.uint8)).any():
        raise ValueError("frame header: 576 samples of 8 bits, mono, are read")
    lead = rows[:, 4]
    digits = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8], [1, 2, 3, 4], 5)
    head = 4 + digits
    lanes = np.arange(n)
    if not checked and (_crc8(rows[:, :9], head) != rows[lanes, head]).any():
        raise ValueError("CRC-8 of a frame header differs")
    if not checked and (_crc16(rows, size) != 0).any():  # over the frame with its own CRC
        raise ValueError("CRC-16 of a frame differs")
    words = np.ndarray((len(data) - 8,), ">u8", data, 0, (1,))  # 64 bits from any byte on
    pos = (start + head + 1) * 8

    def peek() -> np.ndarray:
        return words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def take(bits) -> np.ndarray:
        nonlocal pos
        w = np.broadcast_to(np.asarray(bits, np.int64), n)
        v = np.where(w > 0, peek() >> (64 - np.maximum(w, 1)).astype(np.uint64), np.uint64(0)).astype(np.int64)
        pos = pos + w
        return v

    def signed(v: np.ndarray, bits) -> np.ndarray:
        return np.where(v >> (np.maximum(bits, 1) - 1) & 1, v - (np.int64(1) << np.asarray(bits, np.int64)), v)

    kind = take(8)
    if (kind & 0x81).any():
        raise ValueError("subframe header")
    kind >>= 1
    constant, verbatim, lpc = kind == 0, kind == 1, kind >= 0x20
    fixed = (kind >= 8) & (kind <= 12)
    if not (constant | verbatim | lpc | fixed).all():
        raise ValueError("subframe type")
    plain = constant | verbatim
    if plain.any():
        got = np.zeros((n, BLOCK), np.int64)
        at = (head + 2)[plain, None] + np.where(verbatim[plain, None], np.arange(BLOCK), 0)
        got[plain] = rows[np.flatnonzero(plain)[:, None], at].view(np.int8)
        if not plain.all():
            got[~plain] = _decode_frames(data, start[~plain], end[~plain], True)
        return got
    order = np.where(lpc, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    most = int(order.max())
    out = np.zeros((BLOCK + most, n), np.int64)  # time by lane; `most` zeros before the first sample
    for t in range(most):
        out[most + t] = signed(take(np.where(t < order, 8, 0)), np.where(t < order, 8, 1))
    coefs, shift = np.zeros((max(most, ORDER), n), np.int64), np.zeros(n, np.int64)
    coefs[:ORDER, fixed] = FIXED[order[fixed]].T
    if lpc.any():
        precision = take(np.where(lpc, 4, 0)) + 1
        shift = signed(take(np.where(lpc, 5, 0)), np.where(lpc, 5, 1))
        for j in range(most):
            on = lpc & (j < order)
            c = signed(take(np.where(on, precision, 0)), np.where(on, precision, 1))
            coefs[j] = np.where(on, c, coefs[j])
    coded = np.ones(n, bool)
    method, parts = take(2), take(4)
    if (method > 1).any():
        raise ValueError("residual coding method")
    k_bits = np.where(method == 1, 5, 4)
    k, escape, raw_bits = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64)
    part = BLOCK >> parts
    any_parts, used = bool(parts.any()), [j for j in range(most) if coefs[j].any()]
    # the common case runs on 32-bit lanes; `ahead` holds 32 bits from every byte on
    byte = data.astype(np.uint32)
    ahead = (byte[:-3] << 24) | (byte[1:-2] << 16) | (byte[2:-1] << 8) | byte[3:]
    del byte
    out, coefs, shift = out.astype(np.int32), coefs.astype(np.int32), shift.astype(np.int32)
    live, all_live, any_escape = np.zeros(n, bool), False, False

    def unary(p: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Zeros before the next one, 16 bits at a time."""
        q = np.zeros(n, np.int64)
        while on.any():
            w = words[np.minimum((p + q) >> 3, len(words) - 1)].astype(np.uint64) << ((p + q) & 7).astype(np.uint64)
            add = _LEAD16[(w >> np.uint64(48)).astype(np.int64)]
            q = np.where(on, q + add, q)
            on = on & (add == 16)
        return q

    lead16 = _LEAD16.astype(np.int32)
    k32 = mask = km = one_more = None
    for t in range(BLOCK):
        if t == 0 or any_parts:
            new = coded & (t % part == 0)
            if new.any():
                p = take(np.where(new, k_bits, 0))
                k = np.where(new, p, k)
                escape = np.where(new, p == np.where(method == 1, 31, 15), escape)
                raw_bits = np.where(new, take(np.where(new & escape, 5, 0)), raw_bits)
                live = coded & ~escape
                all_live, any_escape = bool(live.all()), bool((coded & escape).any())
                k32 = k.astype(np.int32)
                mask, km, one_more = ((1 << k32) - 1).astype(np.uint32), 31 - k32, k32 + 1
                pos = pos.astype(np.int32)
        fast = all_live and t >= most
        if fast:
            v = ahead[pos >> 3] << (pos & 7).astype(np.uint32)
            q = lead16[v >> 16]
            fast = bool(q.max() < 16 and (q - km).max() <= -7)
        if fast:
            low = ((v >> (km - q).astype(np.uint32)) & mask).astype(np.int32)
            u = (q << k32) | low
            r = (u >> 1) ^ -(u & 1)
            pos = pos + q
            pos += one_more
            on = None
        else:
            on = live & (t >= order)
            wide_pos = pos.astype(np.int64)
            q = unary(wide_pos, on)
            pos = wide_pos + np.where(on, q + 1, 0)
            u = (q << k) | take(np.where(on, k, 0))
            r = (u >> 1) ^ -(u & 1)
            if any_escape:
                raw_on = coded & escape & (t >= order)
                r = np.where(raw_on, signed(take(np.where(raw_on, raw_bits, 0)), np.where(raw_on, raw_bits, 1)), r)
            pos = pos.astype(np.int32)
        guess = np.int32(0)
        for j in used:
            guess = guess + coefs[j] * out[most + t - 1 - j]
        s = r + (guess >> shift)
        out[most + t] = s if on is None else np.where(coded & (t >= order), s, out[most + t])
    return np.ascontiguousarray(out[most:].T)


#: Fixed values of the format: block sizes, and bits a sample, by their codes in a frame header.
_BLOCKS = {1: 192} | {c: 576 << c - 2 for c in range(2, 6)} | {c: 256 << c - 8 for c in range(8, 16)}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


class _Short(ValueError):
    """The bits of a frame end too early."""


class _Reader:
    """Bits of one frame, as text of 0s and 1s: where the next 1 stands is one search."""

    def __init__(self, data: bytes):
        self.bits, self.at = bin(int.from_bytes(b"\x01" + data))[3:], 0

    def take(self, n: int) -> int:
        self.at += n
        if self.at > len(self.bits):
            raise _Short("a frame is cut short")
        return int(self.bits[self.at - n : self.at], 2) if n else 0

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def unary(self) -> int:
        one = self.bits.find("1", self.at)
        if one < 0:
            raise _Short("a frame is cut short")
        n, self.at = one - self.at, one + 1
        return n

    def number(self) -> None:
        """Skip a frame or sample number: its first byte says how many follow."""
        lead = self.take(8)
        for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length()) if lead >= 0xC0 else 0):
            self.take(8)


def _residuals(r: _Reader, n: int, order: int) -> list[int]:
    method, parts = r.take(2), r.take(4)
    if method > 1:
        raise ValueError("residual coding method")
    if n % (1 << parts) or n >> parts < order:
        raise ValueError("residual partitions")
    width, out = 4 + method, []
    for p in range(1 << parts):
        k = r.take(width)
        m = (n >> parts) - (order if p == 0 else 0)
        if k == (1 << width) - 1:
            raw_bits = r.take(5)
            out += [r.signed(raw_bits) for _ in range(m)]
        else:
            for _ in range(m):
                u = r.unary() << k | r.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(r: _Reader, n: int, bits: int) -> np.ndarray:
    if r.take(1):
        raise ValueError("subframe header")
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * n
    elif kind == 1:
        out = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind & 7 if kind < 32 else (kind & 31) + 1
        out = [r.signed(bits) for _ in range(order)]
        if kind < 32:
            coefs, shift = FIXED[order][:order].tolist(), 0
        else:
            precision = r.take(4) + 1
            shift = r.signed(5)
            if precision > 15 or shift < 0:
                raise ValueError("predictor")
            coefs = [r.signed(precision) for _ in range(order)]
        for x in _residuals(r, n, order):
            out.append(x + (sum(c * y for c, y in zip(coefs, out[: -order - 1 : -1])) >> shift) if order else x)
    else:
        raise ValueError("subframe type")
    return np.array(out, np.int64) << wasted


def _frame(stream: bytes, at: int, head: Info, times: int = 2) -> tuple[np.ndarray, int]:
    """Samples (time by channel) of the frame at a place, and where it ends; it is looked for in `times` the bytes of its bare samples, then in more."""
    try:
        return _frame_within(stream, at, head, times)
    except _Short:
        if at + times * 4096 > len(stream):
            raise
        return _frame(stream, at, head, 8 * times)


def _frame_within(stream: bytes, at: int, head: Info, times: int) -> tuple[np.ndarray, int]:
    if at + 6 > len(stream) or stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
        raise ValueError("frame header")
    code, place = stream[at + 2] >> 4, stream[at + 3] >> 4
    most = 65536 if code in (6, 7) else _BLOCKS.get(code, 0)
    bits = _BITS.get(stream[at + 3] >> 1 & 7, head.bits)
    r = _Reader(stream[at : at + 64 + times * most * head.channels * (bits + 1) // 8])
    r.take(32)
    r.number()
    n = r.take(8) + 1 if code == 6 else r.take(16) + 1 if code == 7 else most
    rate = stream[at + 2] & 15
    r.take(8 if rate == 12 else 16 if rate in (13, 14) else 0)
    if not n or place > 10:
        raise ValueError("frame header")
    size = r.at // 8
    if _crc(stream[at : at + size], _CRC8, 8) != r.take(8):
        raise ValueError("CRC-8 of a frame header differs")
    channels = place + 1 if place < 8 else 2
    x = np.stack([_subframe(r, n, bits + ((place, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(channels)], 1)
    if place == 8:
        x[:, 1] = x[:, 0] - x[:, 1]
    elif place == 9:
        x[:, 0] += x[:, 1]
    elif place == 10:
        mid, side = x[:, 0] << 1 | x[:, 1] & 1, x[:, 1].copy()
        x = np.stack([mid + side >> 1, mid - side >> 1], 1)
    end = at + -(-r.at // 8) + 2
    if _crc(stream[at:end], _CRC16, 16):
        raise ValueError("CRC-16 of a frame differs")
    return x, end


def _crc(data: bytes, table_: np.ndarray, bits: int) -> int:
    crc, steps, mask = 0, table_.tolist(), (1 << bits) - 1
    for b in data:
        crc = (crc << 8 & mask) ^ steps[(crc >> bits - 8) ^ b]
    return crc


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Samples as signed little-endian whole bytes, channel by channel within a moment."""
    width = -(-bits // 8)
    if width == 1:
        return samples.astype(np.int8).tobytes()
    return np.ascontiguousarray(samples.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def decode_any(stream: bytes) -> np.ndarray:
    """Samples (time by channel) of any FLAC stream, checked against its checksums."""
    head = head_of(stream)
    at, parts = head.first, []
    while at < len(stream):
        x, at = _frame(stream, at, head)
        parts.append(x)
    out = np.concatenate(parts) if parts else np.zeros((0, head.channels), np.int64)
    if head.total and len(out) != head.total:
        raise ValueError("a stream is cut short")
    if any(head.md5) and hashlib.md5(pcm_bytes(out, head.bits)).digest() != head.md5:
        raise ValueError("MD5 of a stream differs")
    return out


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream, checked against its checksums: int8 for this encoder's, time by channel for others."""
    heads = [head_of(s) for s in streams]
    own = [i for i, (h, s) in enumerate(zip(heads, streams)) if _own(h, s)]
    starts, ends, at = [], [], 0
    for i in own:
        starts.append(heads[i].offsets + at)
        ends.append(np.append(heads[i].offsets[1:], len(streams[i])) + at)
        at += len(streams[i])
    data = np.frombuffer(b"".join([*(streams[i] for i in own), bytes(16)]), np.uint8)
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    parts = []
    for a in range(0, len(start), LANES):
        lo, hi = int(start[a]), int(end[min(a + LANES, len(start)) - 1])
        parts.append(_decode_frames(data[lo : hi + 16], start[a : a + LANES] - lo, end[a : a + LANES] - lo).astype(np.int8).ravel())
    samples = np.concatenate(parts) if parts else np.zeros(0, np.int8)
    found = dict(zip(own, np.split(samples, np.cumsum([heads[i].total for i in own])[:-1]))) if own else {}
    for i, x in found.items():
        if hashlib.md5(x.tobytes()).digest() != heads[i].md5:
            raise ValueError("MD5 of a stream differs")
    return [found[i] if i in found else decode_any(s) for i, s in enumerate(streams)]


PCM_BLOCK = 64 * BLOCK


def pcm_blocks(samples: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Blocks of PCM with the offset, in samples of one channel, at which each can be sought."""
    for a in range(0, len(samples), PCM_BLOCK):
        yield a, pcm_bytes(samples[a : a + PCM_BLOCK], bits)


def padded(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (-len(text) % BLOCK if text else BLOCK)


def to_flac(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes and media, the FLAC stream of the padded text."""
    ship(docs.sparkSession)
    kind = docs.schema[id].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            data, at = raw(strings(b.column(1)))
            all_ = data.tobytes()
            texts = [all_[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), pa.array(encode([padded(t) for t in texts]), pa.binary())], [id, "n_bytes", "media"])

    return docs.select(id, text).mapInArrow(write, f"`{id}` {kind}, n_bytes long, media binary")


def to_pcm(media: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """A row for each block of PCM: id, sample_offset (seekable), channels, bits, pcm (signed little-endian samples); the file's checksums hold. Null media have no blocks."""
    ship(media.sparkSession)
    kind = media.schema[id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            some = pc.is_valid(b.column(1)).to_numpy(zero_copy_only=False).nonzero()[0]
            streams, rows = b.column(1).take(pa.array(some)).to_pylist(), []
            for i, s, x in zip(some.tolist(), streams, decode(streams)):
                head = head_of(s)
                rows += [(i, a, head.channels, head.bits, block) for a, block in pcm_blocks(x, head.bits)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            i, *columns = (pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), *columns], [id, "sample_offset", "channels", "bits", "pcm"])

    return media.select(id, "media").mapInArrow(read, f"`{id}` {kind}, sample_offset long, channels int, bits int, pcm binary")


def features(x: np.ndarray) -> str:
    """Sum, energy and zero crossings of the samples: integers, so equal samples give equal text."""
    y = x.astype(np.int64)
    return f"sum={int(y.sum())};energy={int((y * y).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(y).max())}"


def media_digest(media: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Digests and features of FLAC columns, from what decoding the stored bytes gives."""
    kind = media.schema[id].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows = []
            streams = b.column(2).to_pylist()
            for s, x in zip(streams, decode(streams)):
                size, digest, tail = 0, hashlib.sha256(), b""
                for _, block in pcm_blocks(x, 8):  # the payload, from the blocks of PCM: their bytes with the top bit flipped back
                    p = (np.frombuffer(block, np.uint8) ^ 0x80).tobytes()
                    digest.update(p)
                    size, tail = size + len(p), (tail + p[-32:])[-32:]
                rows.append((size, digest.hexdigest(), zlib.crc32(tail), len(s), hashlib.sha256(s).hexdigest(), features(x)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    names = [id, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return media.select(id, "n_bytes", "media").mapInArrow(read, f"`{id}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(to_flac(table(spark, sf_dir, "documents")))
