"""Media columns: FLAC streams in a binary column, written and decoded with checked frames.

Streams are mono with 8 bits a sample and fixed blocks of 192 samples, as the public FLAC
format defines them: STREAMINFO (with the MD5 of the samples), a SEEKTABLE with one point
per frame, then frames. A frame has a header closed by CRC-8, one subframe and a CRC-16.

* Writer: constant blocks, or fixed linear predictors of order 0 to 4, or a quantized linear
  predictor of order 2 where that is shorter, or plain samples where no prediction pays;
  residuals are Rice-coded with the best parameter.
* Reader: constant, plain, fixed and general linear predictors up to order 32, Rice residuals
  with 4- and 5-bit parameters, any partition order and escaped partitions. Header CRC-8,
  frame CRC-16 and the stream's MD5 are verified; a mismatch raises ``ValueError``.

Frames of a batch are independent, so both run in lock step over all frames of many streams:
one NumPy step handles sample i of every frame. The reader's fast path does that for streams
whose frames the seek table places; anything unusual goes to the plain bit reader, which
follows the same format one frame at a time.

``pcm_blocks`` returns the decoded blocks with their sample offsets, so that a reader can
seek: block b of a stream starts at sample ``sample_offset`` and holds ``n_samples``.

Defined results: null and empty texts are one block of blanks; equal texts give equal bytes;
repeated rows give equal rows; ids of any type, null or not, come through unchanged; extra
columns, whatever their names, are ignored; texts are stored whole, whatever their length; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.runtime import in_batches, materialized

BLOCK, RATE = 192, 8000
#: Samples of a block that a reader can seek to.
BLOCK_SAMPLES = 65_536
#: Coefficients of the fixed predictors: sample i is foretold from those before it, nearest first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_LPC_PRECISION, _LPC_SHIFT = 8, 6
_WORDS = 32  # 64-bit words of a frame's buffer: 192 plain samples and all headers fit in 26
_MAX_UNARY = 24


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint32)
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out[byte] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _crc16_rows(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of the first ``lengths`` bytes of each row."""
    c = np.zeros(len(rows), np.uint32)
    shortest, longest = int(lengths.min()), int(lengths.max())
    columns = np.ascontiguousarray(rows[:, :longest].T)
    for i in range(longest):
        new = ((c << np.uint32(8)) & np.uint32(0xFFFF)) ^ _CRC16[(c >> np.uint32(8)) ^ columns[i]]
        c = new if i < shortest else np.where(i < lengths, new, c)
    return c


def _utf8(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    head = (0xFF << (8 - size)) & 0xFF
    tail = [0x80 | (n >> (6 * k)) & 0x3F for k in range(size - 2, -1, -1)]
    return bytes([head | n >> (6 * (size - 1)), *tail])


_HEADERS: dict[int, bytes] = {}


def _header(number: int) -> bytes:
    """Frame header: fixed blocks of 192 samples, rate of the stream, one channel, 8 bits."""
    held = _HEADERS.get(number)
    if held is None:
        head = bytes([0xFF, 0xF8, 0x10, 0x02]) + _utf8(number)
        held = head + bytes([_crc8(head)])
        if number < 4096:
            _HEADERS[number] = held
    return held


class _Bits:
    """Bit buffers of many frames, written in lock step."""

    def __init__(self, n: int) -> None:
        self.words = np.zeros((n, _WORDS), np.uint64)
        self.at = np.zeros(n, np.int64)
        self.rows = np.arange(n)

    def put(self, values: np.ndarray, sizes, rows: np.ndarray | None = None) -> None:
        """Appends the low ``sizes`` bits (1 to 57) of each value."""
        rows = self.rows if rows is None else rows
        at = self.at[rows]
        sizes = np.broadcast_to(np.asarray(sizes, np.int64), at.shape)
        word, used = at >> 6, at & 63
        high = values.astype(np.uint64) << (np.uint64(64) - sizes.astype(np.uint64))
        self.words[rows, word] |= high >> used.astype(np.uint64)
        spill = used + sizes > 64
        if spill.any():
            r = rows[spill]
            self.words[r, word[spill] + 1] |= high[spill] << (np.uint64(64) - used[spill].astype(np.uint64))
        self.at[rows] = at + sizes


def _residuals(x: np.ndarray) -> list[np.ndarray]:
    """Residuals of the fixed predictors; the first ``order`` columns are meaningless."""
    out = [x]
    for _ in range(4):
        last = out[-1]
        step = np.zeros_like(last)
        step[:, 1:] = last[:, 1:] - last[:, :-1]
        out.append(step)
    return out


def _folded(e: np.ndarray) -> np.ndarray:
    return np.where(e >= 0, 2 * e, -2 * e - 1)


def _rice_cost(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter of each row and its bits; parameters that need too long a run are out."""
    n = u.shape[1]
    best, cost = np.zeros(len(u), np.int64), np.full(len(u), 1 << 40)
    worst = u.max(axis=1)
    for k in range(2, 11):
        bits = (u >> k).sum(axis=1) + n * (k + 1)
        bits = np.where(worst >> k > _MAX_UNARY, 1 << 40, bits)
        better = bits < cost
        best, cost = np.where(better, k, best), np.where(better, bits, cost)
    return best, cost


def _lpc_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized order-2 coefficients of each row and the residuals they leave."""
    f = x.astype(np.float64)
    r0, r1, r2 = ((f[:, : BLOCK - k] * f[:, k:]).sum(axis=1) for k in range(3))
    det = r0 * r0 - r1 * r1
    safe = np.where(np.abs(det) < 1e-9, 1.0, det)
    a = np.where(np.abs(det) < 1e-9, 0.0, (r1 * r0 - r1 * r2) / safe)
    b = np.where(np.abs(det) < 1e-9, 0.0, (r0 * r2 - r1 * r1) / safe)
    top = (1 << (_LPC_PRECISION - 1)) - 1
    q = np.clip(np.rint(np.stack([a, b], axis=1) * (1 << _LPC_SHIFT)), -top - 1, top).astype(np.int32)
    e = x.copy()
    e[:, 2:] = x[:, 2:] - ((q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> _LPC_SHIFT)
    return q, e


def _encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of frame bytes (padded) and their lengths. ``x``: (frames, 192) int32 samples."""
    n = len(x)
    fixed = _residuals(x)
    choices = []  # (bits, kind, order, parameter, folded residuals)
    for order in range(5):
        u = _folded(fixed[order])
        k, cost = _rice_cost(u[:, order:])
        choices.append((cost + 8 * order + 10, order, k, u))
    q, e = _lpc_of(x)
    u = _folded(e)
    k, cost = _rice_cost(u[:, 2:])
    choices.append((cost + 8 * 2 + 10 + 9 + 2 * _LPC_PRECISION, 5, k, u))
    costs = np.stack([c[0] for c in choices])
    pick = costs.argmin(axis=0)
    pick[costs.min(axis=0) >= 8 * BLOCK] = 6  # plain samples
    pick[(x == x[:, :1]).all(axis=1)] = 7  # constant

    bits = _Bits(n)
    heads = [_header(i) for i in numbers.tolist()]
    sizes = np.array([len(h) for h in heads])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        table = np.frombuffer(b"".join(heads[r] for r in rows), np.uint8).reshape(len(rows), size)
        for j in range(size):
            bits.put(table[:, j], 8, rows)
    for kind in range(8):
        rows = np.flatnonzero(pick == kind)
        if not len(rows):
            continue
        if kind == 7:
            bits.put(np.zeros(len(rows), np.uint64), 8, rows)
            bits.put(x[rows, 0] & 255, 8, rows)
            continue
        if kind == 6:
            bits.put(np.full(len(rows), 0b00000010), 8, rows)
            for i in range(BLOCK):
                bits.put(x[rows, i] & 255, 8, rows)
            continue
        order = 2 if kind == 5 else kind
        bits.put(np.full(len(rows), ((0b100001 if kind == 5 else 0b001000 | order) << 1)), 8, rows)
        for i in range(order):
            bits.put(x[rows, i] & 255, 8, rows)
        if kind == 5:
            bits.put(np.full(len(rows), (_LPC_PRECISION - 1) << 5 | _LPC_SHIFT), 9, rows)
            for j in range(2):
                bits.put(q[rows, j] & ((1 << _LPC_PRECISION) - 1), _LPC_PRECISION, rows)
        k = choices[kind][2][rows]
        bits.put(k, 10, rows)  # method 0 (2 bits), partition order 0 (4 bits), parameter (4 bits)
        u = np.ascontiguousarray(choices[kind][3][rows].T)
        mask, one = (1 << k) - 1, 1 << k
        for i in range(order, BLOCK):
            v = u[i]
            bits.put((v & mask) | one, (v >> k) + 1 + k, rows)
    lengths = (bits.at + 7) >> 3
    out = bits.words.byteswap().view(np.uint8).reshape(n, _WORDS * 8)
    crc = _crc16_rows(out, lengths)
    rows = np.arange(n)
    out[rows, lengths] = crc >> 8
    out[rows, lengths + 1] = crc & 255
    return out, lengths + 2


def encode(payloads: list[bytes], frames_at_once: int = 4096) -> list[bytes]:
    """A FLAC stream for each payload; a payload is a positive multiple of 192 bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    frames, sizes = [], []
    for at in range(0, len(samples), frames_at_once):
        # bytes are stored as signed samples around zero
        rows, lengths = _encode_frames(samples[at : at + frames_at_once].astype(np.int32) - 128, numbers[at : at + frames_at_once])
        keep = np.arange(rows.shape[1])[None, :] < lengths[:, None]
        frames.append(rows[keep].tobytes())
        sizes.append(lengths)
    body, length = b"".join(frames), np.concatenate(sizes)
    starts = np.concatenate([[0], np.cumsum(length)])
    out, frame = [], 0
    for payload, c in zip(payloads, counts, strict=True):
        own = length[frame : frame + c]
        first = int(starts[frame])
        md5 = hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest()
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
        points = np.zeros(c, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(c) * BLOCK, starts[frame : frame + c] - first, BLOCK
        # a metadata block holds 24 bits of length: longer tables are thinned evenly, the reader scans between points
        step = -(-c * 18 // (1 << 23))
        table = points[::step].tobytes()
        head = b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table
        out.append(head + body[first : int(starts[frame + c])])
        frame += c
    return out


class _Reader:
    """Plain bit reader of one frame, for any stream of the format's mono 8-bit kind."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at * 8

    def bits(self, n: int) -> int:
        if n == 0:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream ends inside a frame")
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.bits(1):
            q += 1
        return q


def _read_frame(data: bytes, at: int) -> tuple[np.ndarray, int]:
    """Samples of the frame at byte ``at`` and the byte after it."""
    r = _Reader(data, at)
    if r.bits(15) != 0x7FFC:
        raise ValueError("no frame begins here")
    r.bits(1)
    size_code, rate_code, channels, depth = r.bits(4), r.bits(4), r.bits(4), r.bits(3)
    r.bits(1)
    if channels or depth not in (0, 1):
        raise ValueError("only mono streams of 8-bit samples are read")
    lead = r.bits(8)
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1) if lead >= 0xC0 else 0):
        r.bits(8)
    if size_code == 1:
        n = 192
    elif size_code in (2, 3, 4, 5):
        n = 576 << (size_code - 2)
    elif size_code in (6, 7):
        n = r.bits(8 if size_code == 6 else 16) + 1
    elif size_code >= 8:
        n = 256 << (size_code - 8)
    else:
        raise ValueError("reserved block size")
    r.bits({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    end = r.at >> 3
    if r.bits(8) != _crc8(data[at:end]):
        raise ValueError("frame header CRC-8 mismatch")
    r.bits(1)
    kind = r.bits(6)
    wasted = r.unary() + 1 if r.bits(1) else 0
    width = 8 - wasted
    if kind == 0:
        x = [r.signed(width)] * n
    elif kind == 1:
        x = [r.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [r.signed(width) for _ in range(order)]
        coefficients, shift = FIXED[order] if kind < 32 else None, 0
        if coefficients is None:
            precision = r.bits(4) + 1
            shift = r.signed(5)
            coefficients = tuple(r.signed(precision) for _ in range(order))
        wide = 4 + r.bits(2)
        parts = r.bits(4)
        for part in range(1 << parts):
            k = r.bits(wide)
            raw = r.bits(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if part == 0 else 0)):
                if raw is not None:
                    e = r.signed(raw)
                else:
                    u = r.unary() << k | r.bits(k)
                    e = u >> 1 if not u & 1 else -(u >> 1) - 1
                told = sum(c * v for c, v in zip(coefficients, reversed(x[-order:] if order else []), strict=False))
                x.append(e + (told >> shift))
    else:
        raise ValueError("reserved subframe kind")
    r.at = -(-r.at // 8) * 8
    end = r.at >> 3
    if r.bits(16) != int(_crc16_rows(np.frombuffer(data[at:end], np.uint8)[None, :], np.array([end - at]))[0]):
        raise ValueError("frame CRC-16 mismatch")
    return np.array(x, np.int32) << wasted, end + 2


def _layout(stream: bytes) -> tuple[int, int, bytes, np.ndarray]:
    """First frame's byte, samples, MD5, and byte offsets of the frames if the table has them all (else empty)."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, md5, offsets, last = 4, 0, b"", np.empty(0, np.int64), False
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & ((1 << 36) - 1), body[18:34]
            fixed = body[:2] == body[2:4] == struct.pack(">H", BLOCK)
        elif kind == 3 and fixed and size == total // BLOCK * 18 and total % BLOCK == 0:
            points = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            if (points["sample"] == np.arange(len(points)) * BLOCK).all():
                offsets = points["offset"].astype(np.int64)
        at += 4 + size
    return at, total, md5, offsets


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, 192) samples, and which frames this fast path read; checks both CRCs of all."""
    n = len(starts)
    lengths = ends - starts
    longest = int(lengths.max())
    index = starts[:, None] + np.arange(longest + 16)[None, :]
    rows = data[np.minimum(index, len(data) - 1)]
    body = lengths - 2
    if (lengths < 10).any() or (_crc16_rows(rows, body) != rows[np.arange(n), body].astype(np.uint32) << 8 | rows[np.arange(n), body + 1]).any():
        raise ValueError("frame CRC-16 mismatch")
    heads = [_header(i) for i in numbers.tolist()]
    sizes = np.array([len(h) for h in heads])
    plain = np.zeros(n, bool)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        plain[at] = (rows[at, :size] == np.frombuffer(b"".join(heads[i] for i in at), np.uint8).reshape(len(at), size)).all(axis=1)
    # big-endian windows of 64 bits at each byte, so that one look-up sees at least 57 bits
    wide = np.zeros((n, longest + 8), np.uint64)
    for j in range(8):
        wide |= rows[:, j : j + longest + 8].astype(np.uint64) << np.uint64(56 - 8 * j)
    flat, span = wide.ravel(), wide.shape[1]
    x = np.zeros((n, BLOCK), np.int32)
    every = np.arange(n)

    def look(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        return flat[r * span + (at >> 3)] << (at & 7).astype(np.uint64)

    def signed(v: np.ndarray, bits) -> np.ndarray:
        return (v.astype(np.int64) ^ (1 << (bits - 1))) - (1 << (bits - 1))

    at = sizes * 8
    head = look(every, at) >> np.uint64(56)
    kind = ((head >> np.uint64(1)) & np.uint64(63)).astype(np.int64)
    plain &= (head & np.uint64(0x81)) == 0
    done = plain & (kind == 0)
    x[done] = signed(look(every[done], at[done] + 8) >> np.uint64(56), 8)[:, None]
    verbatim = np.flatnonzero(plain & (kind == 1))
    if len(verbatim):
        columns = (sizes[verbatim] + 1)[:, None] + np.arange(BLOCK)[None, :]
        x[verbatim] = signed(rows[verbatim[:, None], columns], 8)
        done[verbatim] = True
    for order, of_kind, lpc in [(o, 8 + o, False) for o in range(5)] + [(o, 31 + o, True) for o in range(1, 33)]:
        r = np.flatnonzero(plain & (kind == of_kind))
        if not len(r):
            continue
        p = at[r] + 8
        for i in range(order):
            x[r, i] = signed(look(r, p) >> np.uint64(56), 8)
            p = p + 8
        shift, coefficients = np.zeros(len(r), np.int64), np.tile(np.array(FIXED[order] if not lpc else [0] * order, np.int64), (len(r), 1))
        if lpc:
            v = (look(r, p) >> np.uint64(55)).astype(np.int64)
            precision, shift = (v >> 5) + 1, signed(v & 31, 5)
            p = p + 9
            for j in range(order):
                raw = (look(r, p) >> (np.uint64(64) - precision.astype(np.uint64))).astype(np.int64)
                coefficients[:, j] = signed(raw, precision)
                p = p + precision
        v = (look(r, p) >> np.uint64(54)).astype(np.int64)
        p, k = p + 10, v & 15
        simple = (v >> 4 == 0) & (k < 15) & (shift >= 0)  # method 0 and one partition that isn't escaped
        ok = simple.copy()
        r, p, k, shift, coefficients = r[simple], p[simple], k[simple], shift[simple], coefficients[simple]
        if not len(r):
            continue
        base = r * span
        e = np.empty((BLOCK, len(r)), np.int64)
        uk, low = k.astype(np.uint64), ((np.uint64(1) << k.astype(np.uint64)) - np.uint64(1))
        slow = np.zeros(len(r), bool)
        limit = span * 8 - 64
        for i in range(order, BLOCK):
            w = flat[base + (p >> 3)] << (p & 7).astype(np.uint64)
            # leading zeros from the exponent of the top 32 bits as a float
            q = 31 - ((w >> np.uint64(32)).astype(np.float64).view(np.int64) >> 52) + 1023
            far = q > 31
            if far.any():  # a longer run: left to the plain reader
                slow |= far
                q = np.where(far, 0, q)
            u = (q << k) | ((w << (q + 1).astype(np.uint64)) >> (np.uint64(64) - uk) & low).astype(np.int64) if (k > 0).all() else (q << k) | np.where(k > 0, ((w << (q + 1).astype(np.uint64)) >> np.where(k > 0, np.uint64(64) - uk, np.uint64(63)) & low), 0).astype(np.int64)
            e[i] = (u >> 1) ^ -(u & 1)
            p = np.minimum(p + q + 1 + k, limit)
        y = np.empty((BLOCK, len(r)), np.int64)
        y[:order] = x[r, :order].T
        if lpc:
            for i in range(order, BLOCK):
                told = np.zeros(len(r), np.int64)
                for j in range(order):
                    told += coefficients[:, j] * y[i - 1 - j]
                y[i] = e[i] + (told >> shift)
        else:
            # each order of a fixed predictor is one running sum from a known first value
            e[:order] = 0
            warm = y[:order].copy()
            level = e
            for d in range(order, 0, -1):
                first = warm.copy()
                for _ in range(d - 1):
                    first[1:] = first[1:] - first[:-1]
                level[d - 1] = first[d - 1]
                level[d - 1 :] = np.cumsum(level[d - 1 :], axis=0)
            level[:order] = warm
            y = level
        good = ~slow
        x[r[good]] = y[:, good].T
        done[r[good]] = True
        del ok
    return x, done


def decode(streams: list[bytes], frames_at_once: int = 4096) -> list[bytes]:
    """Payload bytes of each stream; raises if a checksum fails."""
    layouts = [_layout(s) for s in streams]
    out: list[bytes | None] = [None] * len(streams)
    fast = [k for k, (_, total, _, offsets) in enumerate(layouts) if len(offsets) and len(offsets) * BLOCK == total]
    if fast:
        data = np.frombuffer(b"".join(streams[k] for k in fast) + bytes(32), np.uint8)
        starts, ends, numbers, at = [], [], [], 0
        for k in fast:
            first, _, _, offsets = layouts[k]
            starts.append(offsets + (at + first))
            ends.append(np.append(offsets[1:] + (at + first), at + len(streams[k])))
            numbers.append(np.arange(len(offsets)))
            at += len(streams[k])
        start, end, number = np.concatenate(starts), np.concatenate(ends), np.concatenate(numbers)
        samples = []
        for a in range(0, len(start), frames_at_once):
            x, done = _decode_frames(data, start[a : a + frames_at_once], end[a : a + frames_at_once], number[a : a + frames_at_once])
            for i in np.flatnonzero(~done):
                x[i] = _read_frame(data[start[a + i] : end[a + i]].tobytes(), 0)[0]
            samples.append(x.astype(np.int8))
        whole, frame = np.concatenate(samples), 0
        for k in fast:
            c = len(layouts[k][3])
            out[k] = whole[frame : frame + c].tobytes()
            frame += c
    for k, (first, total, _, _) in enumerate(layouts):
        if out[k] is None:
            parts, at, n = [], first, 0
            while n < total:
                x, at = _read_frame(streams[k], at)
                parts.append(x.astype(np.int8))
                n += len(x)
            out[k] = np.concatenate(parts).tobytes() if parts else b""
    for k, (_, _, md5, _) in enumerate(layouts):
        if md5 != bytes(16) and hashlib.md5(out[k]).digest() != md5:
            raise ValueError("the samples' MD5 differs from the stream's")
    return [(np.frombuffer(p, np.uint8) ^ 0x80).tobytes() for p in out]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, padded with blanks to a positive multiple of 192, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def with_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's stream."""

    def compute(texts: list) -> list[list]:
        made = [payload_of(t) for t in texts]
        return [[n for _, n in made], encode([p for p, _ in made]) if made else []]

    return in_batches(docs, [text_col], [(id_col, id_col)], "n_bytes long, media binary", compute)


def blocks_of(payload: bytes, block_samples: int) -> list[tuple[int, int, bytes]]:
    """(block, sample offset, samples) of a decoded stream."""
    return [(k // block_samples, k, payload[k : k + block_samples]) for k in range(0, len(payload), block_samples)]


def pcm_blocks(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """(id, block, sample_offset, n_samples, pcm): decoded samples as unsigned bytes, in seekable blocks; a null stream has none."""

    def compute(streams: list) -> list[list]:
        payloads = decode(streams) if streams else []
        return [[[{"block": b, "sample_offset": at, "n_samples": len(pcm), "pcm": pcm} for b, at, pcm in blocks_of(p, block_samples)] for p in payloads]]

    there = media.where(F.col(f"`{media_col}`").isNotNull())
    blocks = in_batches(there, [media_col], [(id_col, id_col)], "blocks array<struct<block: long, sample_offset: long, n_samples: long, pcm: binary>>", compute)
    return blocks.select(id_col, F.explode("blocks").alias("b")).select(id_col, "b.*")


def features(payload: bytes, media: bytes) -> str:
    """Mean level, root mean square, zero crossings and peak of the samples read back, and the ratio of compression."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    return f"blocks={len(x) // BLOCK};mean={float(x.mean()):.4f};rms={rms:.4f};zero_crossings={crossings};peak={int(np.abs(x).max())};ratio={len(media) / len(payload):.4f}"


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def read_back(media: list) -> list[list]:
        # the payload is what the blocks of the decoded stream hold
        blocks = [blocks_of(p, BLOCK_SAMPLES) for p in (decode(media) if media else [])]
        payloads = [b"".join(pcm for _, _, pcm in b) for b in blocks]
        return [
            [len(p) for p in payloads],
            [hashlib.sha256(p).hexdigest() for p in payloads],
            [zlib.crc32(p[-16:]) for p in payloads],
            [len(m) for m in media],
            [hashlib.sha256(m).hexdigest() for m in media],
            [features(p, m) for p, m in zip(payloads, media, strict=True)],
            [len(b) for b in blocks],
            [[at for _, at, _ in b] for b in blocks],
        ]

    measured = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, block_offsets array<long>"
    # the streams are stored; what follows reads the stored bytes
    return in_batches(materialized(with_media(docs)), ["media"], [("doc_id", "doc_id"), ("n_bytes", "n_bytes")], measured, read_back)
