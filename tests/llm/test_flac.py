import hashlib
import zlib

import numpy as np
import pytest

from plumbline.llm import flac
from tests.conftest import SMALL

PAYLOADS = [flac.payload_of(x) for x in (b"", None, b"a" * 577, bytes(range(256)) * 9, np.random.default_rng(1).integers(0, 256, 3000, np.uint8).tobytes(), "漢字😀".encode() * 300, b"\x00\xff" * 700, b"word " * 40000)]


def back(own):
    return (np.concatenate([x[0] for _, x in own]).astype(np.int8).view(np.uint8) ^ np.uint8(0x80)).tobytes()


def test_round_trip_with_and_without_seek_table():
    media = flac.streams(PAYLOADS)
    for p, m, (s, own) in zip(PAYLOADS, media, flac.decode(media)):
        assert back(own) == p and s.total == len(p) and [f for f, _ in own] == list(range(0, len(p), flac.FRAME))
        bare = m[:4] + b"\x80" + m[5:42] + m[s.first :]
        if len(p) < 10000:
            assert back(flac.decode([bare])[0][1]) == p
    assert flac.streams(PAYLOADS, group=1000) == media


def test_damage_is_found():
    m = bytearray(flac.streams([PAYLOADS[3]])[0])
    first = flac.Stream(bytes(m)).first
    for at in (0, first + 4, first + 200, len(m) - 1):
        bad = bytearray(m)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


class Bits:
    """A slow writer of any subframe, to hold the reader against."""

    def __init__(self):
        self.b = ""

    def put(self, v, n):
        self.b += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = v << 1 if v >= 0 else (-v << 1) - 1
        self.b += "0" * (u >> k) + "1"
        self.put(u, k)


def frame(channels, size, bits, code, no):
    """channels: (kind, values, extra) as the format stores them."""
    head = Bits()
    for v, n in ((0xFFF8, 16), (7, 4), (0, 4), (code, 4), ({8: 1, 16: 4}[bits], 3), (0, 1)):
        head.put(v, n)
    raw = bytes(int(head.b[i : i + 8], 2) for i in range(0, len(head.b), 8)) + flac.coded(no) + (size - 1).to_bytes(2, "big")
    raw += bytes([int(flac.crc(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 8)[0])])
    w = Bits()
    for c, (kind, x, extra) in enumerate(channels):
        depth = bits + (code in (8, 10) and c == 1 or code == 9 and c == 0)
        if kind == "constant":
            w.put(0, 8), w.put(x[0], depth)
        elif kind == "verbatim":
            w.put(2, 8)
            for v in x:
                w.put(v, depth)
        elif kind == "wasted":
            w.put(2 | 1, 8), w.put(1, extra)
            for v in x:
                w.put(v >> extra, depth - extra)
        else:
            coef, shift = (flac.FIXED[extra], 0) if kind == "fixed" else extra
            p = len(coef)
            w.put((8 | p if kind == "fixed" else 31 + p) << 1, 8)
            for v in x[:p]:
                w.put(v, depth)
            if kind == "lpc":
                w.put(11, 4), w.put(shift, 5)
                for a in coef:
                    w.put(a, 12)
            r = [x[i] - (sum(a * x[i - 1 - j] for j, a in enumerate(coef)) >> shift) for i in range(p, size)]
            w.put(0, 2), w.put(2, 4)  # four partitions: Rice 5, raw, Rice 0, Rice 9
            at = 0
            for part, k in enumerate((5, None, 0, 9)):
                n = size // 4 - (p if part == 0 else 0)
                if k is None:
                    w.put(15, 4), w.put(20, 5)
                    for v in r[at : at + n]:
                        w.put(v, 20)
                else:
                    w.put(k, 4)
                    for v in r[at : at + n]:
                        w.rice(v, k)
                at += n
    w.b += "0" * (-len(w.b) % 8)
    raw += bytes(int(w.b[i : i + 8], 2) for i in range(0, len(w.b), 8))
    return raw + int(flac.crc(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), 16)[0]).to_bytes(2, "big")


def test_all_subframes_and_stereo():
    draw = np.random.default_rng(2)
    n = 64
    wave = lambda: np.cumsum(draw.integers(-40, 41, n)).tolist()
    left, right = wave(), wave()
    side = [a - b for a, b in zip(left, right)]
    mid = [(a + b) >> 1 for a, b in zip(left, right)]
    lpc = ("lpc", left, ((1900, -700, 300), 10))
    frames = [
        frame([lpc, ("fixed", right, 3)], n, 16, 1, 0),
        frame([("fixed", left, 0), ("fixed", side, 4)], n, 16, 8, 1),
        frame([("fixed", side, 1), ("verbatim", right, 0)], n, 16, 9, 2),
        frame([("fixed", mid, 2), ("verbatim", side, 0)], n, 16, 10, 3),
        frame([("constant", [-5] * n, 0), ("wasted", [8 * v for v in right], 3)], n, 16, 1, 4),
    ]
    info = (n).to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | 1 << 41 | 15 << 36 | 5 * n).to_bytes(8, "big") + bytes(16)
    (s, own), = flac.decode([b"fLaC\x80" + (34).to_bytes(3, "big") + info + b"".join(frames)])
    assert s.channels == 2 and [f for f, _ in own] == [0, n, 2 * n, 3 * n, 4 * n]
    for i, (_, x) in enumerate(own[:4]):
        assert x[0].tolist() == left and x[1].tolist() == right, i
    assert own[4][1][0].tolist() == [-5] * n and own[4][1][1].tolist() == [8 * v for v in right]


def test_query_rows(spark):
    docs = spark.createDataFrame([(1, "hello", 1), (2, None, 2), (3, "", 3), (1, "hello", 4), (None, "é" * 500, 5)], "doc_id long, text string, media int")
    stored = flac.store_texts(docs)
    rows = flac.media_digests(stored).collect()
    assert len(rows) == 5
    for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), ("hello", "hello", "", "", "é" * 500)):
        p = flac.payload_of(t.encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    blocks = flac.pcm_blocks(stored).where("doc_id is null").orderBy("block").collect()
    assert [(b["sample_offset"], b["n_samples"]) for b in blocks] == [(0, 576), (576, 448)]
    assert flac.media_digests(flac.store_texts(docs.where("false"))).count() == 0
    assert flac.pcm_blocks(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_query_against_hashlib(spark):
    from plumbline.llm.queries import op2_flac_media

    want = {r["doc_id"]: hashlib.sha256(flac.payload_of((r["text"] or "").encode())).hexdigest() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: r["payload_sha256"] for r in op2_flac_media(spark, SMALL).collect()} == want


def test_blocks_hold_whole_frames_and_say_where_they_begin(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(50_000))
    docs = spark.createDataFrame([(1, long, "x"), (2, "short", "y"), (1, long, "x")], "doc_id long, text string, block string")
    rows = flac.pcm_blocks(flac.store_texts(docs), most_samples=4096, group=1 << 13, carry=["n_bytes"]).collect()
    want = flac.payload_of(long.encode())
    first = [r for r in rows if r["doc_id"] == 1]
    whole = [r for r in first if r["last"]]
    assert len(whole) == 2 and {r["n_frames"] for r in whole} == {-(-len(want) // 576)}
    for r in first:
        assert r["sample_offset"] % 576 == 0 and r["n_samples"] <= 4096 and r["n_bytes"] == 50_000
        assert bytes(x ^ 0x80 for x in r["pcm"]) == want[r["sample_offset"] : r["sample_offset"] + r["n_samples"]]
    assert sum(r["n_samples"] for r in first) == 2 * len(want)
    blocks = flac.pcm_blocks(flac.store_texts(docs), most_samples=4096, carry=["n_bytes"])
    assert sorted(flac.block_digests(blocks).collect()) == sorted(flac.media_digests(flac.store_texts(docs)).collect())


def test_a_long_stream_is_decoded_in_groups(monkeypatch):
    draw = np.random.default_rng(1)
    text = draw.integers(0, 256, 700_000, dtype=np.uint8).tobytes() + bytes(64 - 700_000 % 64)
    raw = flac.streams([text])[0]
    sizes = []
    plain = flac.samples_of
    monkeypatch.setattr(flac, "samples_of", lambda r, *a: sizes.append(len(r)) or plain(r, *a))
    got = b"".join(x[0].astype(np.int8).tobytes() for _, _, _, x, _ in flac.decoded([raw], 1 << 16))
    assert bytes(got).translate(flac.FLIP) == text and max(sizes) <= (1 << 16) + 16 and len(sizes) > 8
    bad = bytearray(raw)
    bad[len(raw) // 2] ^= 1
    with pytest.raises(flac.FlacError):
        list(flac.decoded([bytes(bad)], 1 << 16))
