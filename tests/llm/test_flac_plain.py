"""Stored streams against a plain reader of the published format, written bit by bit and apart from the library."""

import hashlib
import math
import zlib

import pytest

from seqloom.llm import flac

TEXTS = ["", None, "abc", "word " * 500, "Grüße 漢字 " * 60, "".join(chr(33 + i * i % 90) for i in range(3000)), "\x00\x7f" * 700, "a" * 9000]


class Bits:
    def __init__(self, data: bytes) -> None:
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n: int) -> int:
        self.at += n
        return int(self.text[self.at - n : self.at] or "0", 2)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        one = self.text.index("1", self.at)
        n, self.at = one - self.at, one + 1
        return n


def crc(data: bytes, poly: int, width: int) -> int:
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1) ^ (poly if value >> (width - 1) else 0)
            value &= (1 << width) - 1
    return value


def rice(b: Bits, order: int, size: int) -> list[int]:
    wide = b.take(2)
    assert wide in (0, 1)
    field, parts = 5 if wide else 4, 1 << b.take(4)
    out = []
    for k in range(parts):
        n, p = size // parts - (order if k == 0 else 0), b.take(field)
        if p == (1 << field) - 1:
            raw = b.take(5)
            out += [b.signed(raw) for _ in range(n)]
            continue
        for _ in range(n):
            u = b.zeros() << p | b.take(p)
            out.append(u >> 1 if u % 2 == 0 else -(u >> 1) - 1)
    return out


def subframe(b: Bits, size: int, depth: int) -> list[int]:
    assert b.take(1) == 0
    kind = b.take(6)
    wasted = b.zeros() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = [b.signed(depth)] * size
    elif kind == 1:
        x = [b.signed(depth) for _ in range(size)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [b.signed(depth) for _ in range(order)]
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        else:
            assert 0 <= order <= 4
            shift, weights = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
        for e in rice(b, order, size):
            x.append(e + (sum(w * x[-1 - i] for i, w in enumerate(weights)) >> shift))
    return [v << wasted for v in x]


def plain_samples(stream: bytes) -> list[int]:
    assert stream[:4] == b"fLaC"
    at, last, info, seek = 4, False, None, []
    while not last:
        last, kind, n = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + n]
        if kind == 0:
            b = Bits(body)
            info = {"least": b.take(16), "most": b.take(16), "frames": (b.take(24), b.take(24)), "rate": b.take(20), "channels": b.take(3) + 1, "depth": b.take(5) + 1, "total": b.take(36), "md5": body[18:34]}
        elif kind == 3:
            seek = [(int.from_bytes(body[k : k + 8], "big"), int.from_bytes(body[k + 8 : k + 16], "big"), int.from_bytes(body[k + 16 : k + 18], "big")) for k in range(0, n, 18)]
        at += 4 + n
    assert info["channels"] == 1 and info["depth"] == 8
    first, samples, starts = at, [], {}
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.take(14) == 0b11111111111110 and b.take(1) == 0
        b.take(1)
        size, rate, channels, depth = b.take(4), b.take(4), b.take(4), b.take(3)
        assert channels == 0 and depth in (0, 1) and b.take(1) == 0
        lead = b.take(8)
        b.take(8 * max(0, f"{lead:08b}".index("0") - 1))
        n = b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        assert crc(stream[at : at + b.at // 8], 0x07, 8) == b.take(8)
        starts[len(samples)] = (at - first, n)
        samples += subframe(b, n, 8)
        b.at += -b.at % 8
        assert crc(stream[at : at + b.at // 8], 0x8005, 16) == b.take(16)
        at += b.at // 8
    assert len(samples) == info["total"]
    assert info["md5"] == bytes(16) or info["md5"] == hashlib.md5(bytes(v & 255 for v in samples)).digest()
    assert all((where, n) == starts[sample] for sample, where, n in seek if sample != 2**64 - 1)
    return samples


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_a_plain_reader_finds_the_payload(k):
    payload, n = flac.payload_of(TEXTS[k])
    raw = (TEXTS[k] or "").encode()
    assert n == len(raw) and payload.startswith(raw) and set(payload[n:]) <= {32} and len(payload) % 192 == 0 and 0 < len(payload) <= max(192, n + 191)
    (stream,) = flac.encode([payload])
    assert bytes(v + 128 for v in plain_samples(stream)) == payload


def test_the_query_against_plain_readings_of_the_stored_streams(spark, tmp_path, monkeypatch):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stored = []
    monkeypatch.setattr(flac, "materialized", lambda df, f=flac.materialized: stored.append(f(df)) or stored[-1])
    rows = {r["doc_id"]: r for r in flac.op8_flac_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, media in ((r["doc_id"], bytes(r["media"])) for r in stored[0].collect()):
        r, x = rows[i], plain_samples(media)
        payload = bytes(v + 128 for v in x)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(x), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        told = dict(part.split("=") for part in r["feature"].split(";"))
        assert int(told["zero_crossings"]) == sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:])) and int(told["peak"]) == max(map(abs, x))
        assert abs(float(told["mean"]) - sum(x) / len(x)) < 1e-3 and abs(float(told["rms"]) - math.sqrt(sum(v * v for v in x) / len(x))) < 1e-3
        assert abs(float(told["ratio"]) - len(media) / len(x)) < 1e-3 and int(told["blocks"]) == len(x) // 192
