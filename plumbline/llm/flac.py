"""FLAC (RFC 9639) written and read many frames at a time.

Frames are independent, so a batch decodes all its frames in step: sample i of every frame comes out of a handful of
NumPy operations. Each frame's start comes from the seek table, or, without one, from sync codes whose header check
holds and whose predecessor's footer check holds. A frame that fails a check raises FlacError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_bytes, slices, use_workers

U = np.uint64
#: Samples in a frame that this module writes.
FRAME = 576
#: Fixed values of the format: predictor coefficients by order, sample sizes by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class FlacError(ValueError):
    pass


def crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) & 1 else 0)
        out[i] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """The checks of many stretches of raw, in step; longest first while it runs."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    alive = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right") if len(left) else []
    c = np.zeros(len(at), np.uint32)
    for i, m in enumerate(alive):
        b = raw[at[:m] + i]
        c[:m] = CRC8[c[:m] ^ b] if bits == 8 else CRC16[(c[:m] >> np.uint32(8)) ^ b] ^ ((c[:m] << np.uint32(8)) & np.uint32(0xFFFF))
    out = np.empty_like(c)
    out[order] = c
    return out


def coded(number: int) -> bytes:
    """A frame number as the format codes it."""
    if number < 0x80:
        return bytes([number])
    tail = []
    lead = 0x3F
    while number > lead:
        tail.append(0x80 | number & 0x3F)
        number >>= 6
        lead >>= 1
    return bytes([0xFF ^ (lead << 1 | 1) | number, *reversed(tail)])


def put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def frames(samples: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One frame for each stretch of 8-bit samples (at least 16, at most FRAME but for any stretch alone in its stream)."""
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    which = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(len(samples)) - starts[which]
    s = samples.astype(np.int32)
    one, two = np.zeros_like(s), np.zeros_like(s)
    one[1:], two[2:] = s[:-1], s[:-2]
    add = lambda x: np.add.reduceat(x, starts)
    body = inside >= 2
    r0, r1, r2 = (add(np.where(body, x, 0).astype(np.float64)) for x in (one * one, s * one, s * two))
    r11, r12, r22 = r0, add(np.where(body, one * two, 0).astype(np.float64)), add(np.where(body, two * two, 0).astype(np.float64))
    det = r11 * r22 - r12 * r12
    det = np.where(np.abs(det) < 1e-6, 1, det)
    a, b = (r1 * r22 - r2 * r12) / det, (r2 * r11 - r1 * r12) / det
    ca, cb = (np.clip(np.round(x * 32), -64, 63).astype(np.int32) for x in (a, b))
    tries = (s, s - one, s - ((ca[which] * one + cb[which] * two) >> 5))
    zig = [(t << 1) ^ (t >> 31) for t in tries]
    cost = np.stack([add(np.where(inside >= p, z, 0)) for p, z in zip((0, 1, 2), zig)])
    best = np.argmin(cost, axis=0)
    order = best
    u = np.choose(best[which], zig)
    n = lengths - order
    mean = cost[best, np.arange(len(lengths))] / np.maximum(n, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 14).astype(np.int32)
    ks = k[which]
    q = u >> ks
    size = np.where(inside >= order[which], q + 1 + ks, 0)
    heads = []
    for m, no in zip(lengths.tolist(), numbers.tolist()):
        code, tail = (2, b"") if m == 576 else (6, bytes([m - 1])) if m <= 256 else (7, (m - 1).to_bytes(2, "big"))
        heads.append(bytes([0xFF, 0xF8, code << 4, 0 << 4 | 1 << 1]) + coded(no) + tail + b"\0")
    hlen = np.array([len(h) for h in heads])
    lpc = best == 2
    fixed_bits = 8 * hlen + 8 + 8 * order + np.where(lpc, 9 + 14, 0) + 10
    total = add(size) + fixed_bits
    nbytes = (total + 7) // 8 + 2
    fstart = np.concatenate(([0], np.cumsum(nbytes)))
    bits = np.zeros(8 * int(fstart[-1]), np.uint8)
    f0 = 8 * fstart[:-1]
    at = f0 + 8 * hlen
    put(bits, at, np.where(lpc, 0x20 | 1, 8 | order) << 1, 8)
    at = at + 8
    for j in range(2):
        has = order > j
        put(bits, at[has], s[starts[has] + j] & 0xFF, 8)
        at = at + 8 * has
    put(bits, at[lpc], np.full(lpc.sum(), 6 << 5 | 5), 9)
    put(bits, at[lpc] + 9, ca[lpc] & 0x7F, 7)
    put(bits, at[lpc] + 16, cb[lpc] & 0x7F, 7)
    at = at + 23 * lpc
    put(bits, at + 6, k, 4)
    ends = np.cumsum(size)
    pos = ends - size
    pos = pos + np.repeat(f0 + fixed_bits - (pos[starts]), lengths)
    coded_here = size > 0
    pos, q, u, ks = pos[coded_here], q[coded_here], u[coded_here], ks[coded_here]
    stop = pos + q
    bits[stop] = 1
    for j in range(int(k.max(initial=0))):
        has = ks > j
        if has.all():
            bits[stop + 1 + j] = (u >> (ks - 1 - j)) & 1
        else:
            bits[stop[has] + 1 + j] = (u[has] >> (ks[has] - 1 - j)) & 1
    raw = np.packbits(bits)
    del bits
    at = np.repeat(fstart[:-1] - np.concatenate(([0], np.cumsum(hlen)))[:-1], hlen) + np.arange(hlen.sum())
    raw[at] = np.frombuffer(b"".join(heads), np.uint8)
    raw[fstart[:-1] + hlen - 1] = crc(raw, fstart[:-1], hlen - 1, 8)
    check = crc(raw, fstart[:-1], nbytes - 2, 16)
    raw[fstart[1:] - 2], raw[fstart[1:] - 1] = check >> np.uint32(8), check & np.uint32(0xFF)
    whole = raw.tobytes()
    return [whole[i:j] for i, j in zip(fstart[:-1].tolist(), fstart[1:].tolist())]


def streams(payloads: list[bytes], rate: int = 8000, group: int = 1 << 20) -> list[bytes]:
    """FLAC streams of 8-bit mono, each with a seek point for every frame; payloads hold at least 16 bytes each."""
    lengths, owner, numbers = [], [], []
    for i, p in enumerate(payloads):
        m = len(p)
        cut = [FRAME] * (m // FRAME) + ([m % FRAME] if m % FRAME else [])
        if len(cut) > 1 and cut[-1] < 16:
            raise ValueError("the last frame would be too short")
        lengths += cut
        owner += [i] * len(cut)
        numbers += range(len(cut))
    flat = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), np.uint8)
    length = np.array(lengths, np.int64)
    begin = np.concatenate(([0], np.cumsum(length)))
    number = np.array(numbers, np.int64)
    done: list[bytes] = []
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + group, side="right")) - 1)
        done += frames((flat[begin[i] : begin[j]] ^ np.uint8(0x80)).view(np.int8), length[i:j], number[i:j])
        i = j
    out, at = [], 0
    for p in payloads:
        n = -(-len(p) // FRAME)
        own = done[at : at + n]
        at += n
        spots, offset = [], 0
        for x, f in enumerate(own):
            spots.append((x * FRAME).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(FRAME, len(p) - x * FRAME).to_bytes(2, "big"))
            offset += len(f)
        sizes = [len(f) for f in own]
        md5 = hashlib.md5()
        for x in range(0, len(p), group):
            md5.update(p[x : x + group].translate(FLIP))
        info = FRAME.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + (rate << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + md5.digest()
        seek = b"".join(spots)
        tables = b"".join((0x80 * (y + 932067 >= len(seek)) | 3).to_bytes(1, "big") + len(seek[y : y + 932067]).to_bytes(3, "big") + seek[y : y + 932067] for y in range(0, len(seek), 932067)) if len(seek) > 16_000_000 else b"\x83" + len(seek).to_bytes(3, "big") + seek
        out.append(b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + tables + b"".join(own))
    return out


FLIP = bytes(i ^ 0x80 for i in range(256))


class Stream:
    """What the metadata of one stream says, and where its frames lie."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"fLaC":
            raise FlacError("no FLAC marker")
        at, self.seek = 4, []
        while True:
            if at + 4 > len(raw):
                raise FlacError("metadata cut off")
            last, kind, n = raw[at] >> 7, raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
            block = raw[at + 4 : at + 4 + n]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.rate, self.channels, self.bits, self.total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
                self.md5 = block[18:34]
            elif kind == 3:
                for x in range(0, n - 17, 18):
                    if (first := int.from_bytes(block[x : x + 8], "big")) != (1 << 64) - 1:
                        self.seek.append((first, int.from_bytes(block[x + 8 : x + 16], "big"), int.from_bytes(block[x + 16 : x + 18], "big")))
            at += 4 + n
            if last:
                break
        self.first = at
        if not hasattr(self, "bits"):
            raise FlacError("no stream information")


def header(raw: bytes, at: int, bits: int) -> tuple[int, int, int, int, int, int] | None:
    """(bytes, block size, channel code, sample bits, number, numbers samples) of a frame header, if its check holds."""
    h = raw[at : at + 16]
    if len(h) < 6 or h[0] != 0xFF or h[1] & 0xFE != 0xF8:
        return None
    size, rate, channels, depth = h[2] >> 4, h[2] & 15, h[3] >> 4, h[3] >> 1 & 7
    if not size or rate == 15 or channels > 10 or depth == 3 or h[3] & 1:
        return None
    lead, i = h[4], 5
    more = 0
    while more < 7 and lead & 0x80 >> more:
        more += 1
    number = lead & (0x7F >> more)
    for _ in range(max(0, more - 1)):
        if i >= len(h) or h[i] & 0xC0 != 0x80:
            return None
        number = number << 6 | h[i] & 0x3F
        i += 1
    extra = {6: 1, 7: 2}.get(size, 0)
    n = 192 if size == 1 else 144 << size if size < 6 else int.from_bytes(h[i : i + extra], "big") + 1 if extra else 1 << size
    i += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if i >= len(h):
        return None
    c = 0
    for b in h[:i]:
        c = int(CRC8[c ^ b])
    return (i + 1, n, channels, SIZES.get(depth, bits), number, h[1] & 1) if c == h[i] else None


def frame_starts(raw: bytes, s: Stream) -> list[int]:
    """Offsets of all frames: the seek table's where it covers the stream, else those that sync codes and checks agree on."""
    if s.seek and s.total and s.seek[0][:2] == (0, 0) and all(a[0] + a[2] == b[0] for a, b in zip(s.seek, s.seek[1:])) and s.seek[-1][0] + s.seek[-1][2] == s.total:
        return [s.first + x[1] for x in s.seek]
    b = np.frombuffer(raw, np.uint8)
    maybe = np.flatnonzero((b[s.first : -1] == 0xFF) & (b[s.first + 1 :] & 0xFE == 0xF8)) + s.first
    maybe = [int(x) for x in maybe if header(raw, int(x), s.bits)]
    starts, i = [], 0
    if not maybe or maybe[0] != s.first:
        raise FlacError("no frame where the frames should begin")
    while i < len(maybe):
        starts.append(maybe[i])
        c, at = 0, maybe[i]
        for j in range(i + 1, len(maybe) + 1):
            end = maybe[j] if j < len(maybe) else len(raw)
            for x in raw[at : end - 2]:
                c = int(CRC16[c >> 8 ^ x]) ^ c << 8 & 0xFFFF
            at = end - 2
            if c == int.from_bytes(raw[end - 2 : end], "big"):
                i = j
                break
        else:
            raise FlacError("a frame's check fails")
    return starts


def frame_list(raw: bytes, s: Stream) -> list[tuple[int, int, int, tuple]]:
    """(start, end, first sample, header) of every frame, in order; an error if headers and the stream disagree."""
    own = frame_starts(raw, s) if s.first < len(raw) else []
    found, at = [], 0
    for no, (a, z) in enumerate(zip(own, [*own[1:], len(raw)])):
        h = header(raw, a, s.bits)
        if h is None or not h[5] and h[4] != no or h[5] and h[4] != at:
            raise FlacError(f"frame {no}: its header check fails or it is out of turn")
        found.append((a, z, at, h))
        at += h[1]
    if s.total and at != s.total:
        raise FlacError(f"{at} samples; the stream says {s.total}")
    return found


def decoded(raws: list[bytes], group: int = 1 << 20) -> Iterator[tuple[int, Stream, int, np.ndarray, bool]]:
    """(stream's place, its information, first sample, samples by channel, whether the last) of every frame, in order.

    Frames are decoded some at a time, as many as group bytes hold, so a long stream takes no more work space than short
    ones. All checks are verified; a stream's own hash, once its last frame is read, before that frame is given out. A
    stream without frames gives nothing.
    """
    known = [Stream(r) for r in raws]
    todo = [(i, *f) for i, (r, s) in enumerate(zip(raws, known)) for f in frame_list(r, s)]
    at = 0
    hashes: dict[int, object] = {}
    while at < len(todo):
        n, upto = 0, at
        while upto < len(todo) and (upto == at or n + todo[upto][2] - todo[upto][1] <= group):
            n += todo[upto][2] - todo[upto][1]
            upto += 1
        own = todo[at:upto]
        whole = np.frombuffer(b"".join(raws[i][a:z] for i, a, z, _, _ in own) + b"\0" * 16, np.uint8)
        end = np.cumsum([z - a for _, a, z, _, _ in own])
        start = np.concatenate(([0], end[:-1]))
        check = crc(whole, start, end - start - 2, 16)
        if (check != (whole[end - 2].astype(np.uint32) << np.uint32(8) | whole[end - 1])).any():
            raise FlacError("a frame's check fails")
        for x, ((i, _, _, first, _), block) in enumerate(zip(own, samples_of(whole, start, end, [f[4] for f in own]))):
            s = known[i]
            last = at + x + 1 == len(todo) or todo[at + x + 1][0] != i
            if s.bits == 8 and s.channels == 1 and any(s.md5):
                h = hashes.setdefault(i, hashlib.md5())
                h.update(block[0].astype(np.int8).tobytes())
                if last and hashes.pop(i).digest() != s.md5:
                    raise FlacError("the samples' hash differs")
            yield i, s, first, block, last
        at = upto


def decode(raws: list[bytes]) -> list[tuple[Stream, list[tuple[int, np.ndarray]]]]:
    """Of each stream: its information, and (first sample, samples by channel) of every frame, all checks held."""
    out: list[tuple[Stream, list[tuple[int, np.ndarray]]]] = [(Stream(r), []) for r in raws]
    for i, _, first, block, _ in decoded(raws):
        out[i][1].append((first, block))
    return out


def samples_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray, heads: list[tuple]) -> list[np.ndarray]:
    """Samples of every frame, [channels, block size], all frames in step."""
    order = sorted(range(len(heads)), key=lambda i: (-heads[i][1], heads[i][2]))
    h = np.array([heads[i][:4] for i in order], np.int64)
    size, code, depth = h[:, 1], h[:, 2], h[:, 3]
    channels = np.where(code < 8, code + 1, 2)
    window = np.zeros(len(raw) - 8, U)
    for j in range(8):
        window |= raw[j : len(raw) - 8 + j].astype(U) << U(56 - 8 * j)
    at = 8 * (start[order] + h[:, 0])
    most, nc = int(size[0]), int(channels.max())
    out = np.zeros((nc, most, len(order)), np.int64)
    for c in range(nc):
        on = np.flatnonzero(channels > c)
        side = (code == 8) & (c == 1) | (code == 9) & (c == 0) | (code == 10) & (c == 1)
        values, at[on] = subframes(window, at[on], size[on], (depth + side)[on])
        out[c][: len(values), on] = values
    if ((at + 7) // 8 != end[order] - 2).any():
        raise FlacError("a frame does not end at its check")
    result: list[np.ndarray] = [None] * len(order)  # type: ignore[list-item]
    for x, i in enumerate(order):
        v = out[: channels[x], : size[x], x].copy()
        if code[x] == 8:
            v[1] = v[0] - v[1]
        elif code[x] == 9:
            v[0] = v[0] + v[1]
        elif code[x] == 10:
            mid, d = v[0] << 1 | v[1] & 1, v[1]
            v = np.stack(((mid + d) >> 1, (mid - d) >> 1))
        result[i] = v
    return result


def subframes(window: np.ndarray, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One subframe of each frame, frames sorted by falling size: [samples, frames], and where each ends in bits."""
    at, f = at.copy(), len(at)

    def peek(where, width):
        return ((window[where >> 3] << (where & 7).astype(U)) >> (64 - width).astype(U)).astype(np.int64)

    def take(which, width):
        width = np.broadcast_to(np.asarray(width, np.int64), at[which].shape)
        got = np.where(width > 0, peek(at[which], np.maximum(width, 1)), 0)
        at[which] += width
        return got

    def signed(x, width):
        return np.where((width > 0) & (x >> np.maximum(width - 1, 0) == 1), x - (1 << width), x)

    def ones(where):
        """Zeros before the next one at each place."""
        w = (window[where >> 3] << (where & 7).astype(U)) >> U(12)
        zeros = 52 - np.frexp(w.astype(np.float64))[1].astype(np.int64)
        for i in np.flatnonzero(w == 0):  # a long run: step through it
            n, p = 0, int(where[i])
            while not int(window[p >> 3]) >> (63 - (p & 7)) & 1:
                n, p = n + 1, p + 1
            zeros[i] = n
        return zeros

    every = np.arange(f)
    kind = take(every, 8)
    if (kind >> 7).any():
        raise FlacError("a subframe begins with a set bit")
    wasted = np.zeros(f, np.int64)
    few = np.flatnonzero(kind & 1)
    if len(few):
        z = ones(at[few])
        wasted[few] = z + 1
        at[few] += z + 1
    kind, depth = kind >> 1, depth - wasted
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise FlacError("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    top = int(order.max(initial=0))
    out = np.zeros((int(size[0]), f), np.int64)
    coef, shift = np.zeros((max(top, 1), f), np.int64), np.zeros(f, np.int64)
    for j in range(top):
        has = np.flatnonzero(order > j)
        out[j, has] = signed(take(has, depth[has]), depth[has])
    for p in range(1, min(top, 4) + 1):
        has = fixed & (order == p)
        coef[:p, has] = np.array(FIXED[p])[:, None]
    has = np.flatnonzero(lpc)
    if len(has):
        precision = take(has, 4) + 1
        if (precision == 16).any():
            raise FlacError("a reserved precision")
        shift[has] = signed(take(has, 5), np.full(len(has), 5))
        for j in range(top):
            own = order[has] > j
            coef[j, has[own]] = signed(take(has[own], precision[own]), precision[own])
    flat = np.flatnonzero(constant)
    out[:, flat] = signed(take(flat, depth[flat]), depth[flat])
    rice = np.flatnonzero(fixed | lpc)
    method, parts = np.zeros(f, np.int64), np.zeros(f, np.int64)
    method[rice], parts[rice] = take(rice, 2), take(rice, 4)
    if (method > 1).any() or (size[rice] % (1 << parts[rice])).any() or ((size[rice] >> parts[rice]) < order[rice]).any():
        raise FlacError("a reserved residual method or an uneven partition")
    span = size >> parts
    k, plain = np.zeros(f, np.int64), np.where(verbatim, depth, -1)  # plain: bits of unencoded values, or -1

    def parameters(which):
        if not len(which):
            return
        width = 4 + method[which]
        k[which] = take(which, width)
        escaped = which[k[which] == (1 << width) - 1]
        plain[which] = -1
        if len(escaped):
            plain[escaped] = take(escaped, 5)

    opens: dict[int, list[np.ndarray]] = {}
    for (o, p, m), own in ((t, rice[(order[rice] == t[0]) & (span[rice] == t[1]) & (size[rice] == t[2])]) for t in set(zip(order[rice].tolist(), span[rice].tolist(), size[rice].tolist()))):
        for i in {o, *range(p, m, p)} if o < m else ():
            opens.setdefault(i, []).append(own)
    whole_size = size.tolist()
    live = f
    mixed = bool(constant.any()) or len(set(order.tolist())) > 1
    for i in range(int(size[0])):
        while live and whole_size[live - 1] <= i:
            live -= 1
        if i in opens:
            for own in opens[i]:
                parameters(own)
        if mixed or i < top:
            now = np.flatnonzero((order[:live] <= i) & ~constant[:live])
        else:
            now = slice(0, live)
        if isinstance(now, np.ndarray) and len(now) == live:
            now = slice(0, live)
        where, kk = at[now], k[now]
        w = window[where >> 3] << (where & 7).astype(U)
        zeros = 52 - np.frexp((w >> U(12)).astype(np.float64))[1].astype(np.int64)
        slow = zeros + 1 + kk > 52
        raw = plain[now]
        special = slow.any() or (raw >= 0).any()
        low = ((w << (zeros + 1).astype(U)) >> U(1)) >> (63 - kk).astype(U)
        if special:
            bits = np.maximum(raw, 0)
            is_raw = raw >= 0
            long_run = np.flatnonzero(slow & ~is_raw)
            if len(long_run):
                zeros[long_run] = ones(where[long_run])
                p = where[long_run] + zeros[long_run] + 1
                low[long_run] = ((window[p >> 3] << (p & 7).astype(U)) >> U(1)) >> (63 - kk[long_run]).astype(U)
        v = zeros << kk | low.astype(np.int64)
        value = (v >> 1) ^ -(v & 1)
        step = zeros + 1 + kk
        if special:
            value = np.where(is_raw, signed(np.where(bits > 0, peek(where, np.maximum(bits, 1)), 0), bits), value)
            step = np.where(is_raw, bits, step)
        at[now] = where + step
        if top:
            guess = 0
            for j in range(min(top, i)):
                guess = guess + coef[j, now] * out[i - 1 - j, now]
            value = value + (guess >> shift[now])
        out[i, now] = value
    return out << wasted, at


def payload_of(text: bytes | None) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text", group: int = 1 << 20) -> DataFrame:
    """(key, n_bytes, media): every whole text (null: empty), padded to a multiple of 64, as a FLAC stream of 8-bit samples.

    Repeated rows give repeated rows; equal texts give equal media. Columns other than key and text are ignored.
    """
    use_workers(df.sparkSession)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", group):
                texts = as_bytes(b.column("text"))
                media = streams([payload_of(t) for t in texts]) if texts else []
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, media binary").withColumnRenamed("key", key)


#: What a PCM block says beside its stream's key; what tells of the stream stands on its last block.
BLOCK = (("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("pcm", pa.binary()), ("last", pa.bool_()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()))
BLOCK_KINDS = "block long, sample_offset long, n_samples long, pcm binary, last boolean, media_bytes long, media_sha256 string, n_frames long"
DIGEST_KINDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_blocks(batches: Iterator[pa.RecordBatch], group: int, most_samples: int) -> Iterator[pa.RecordBatch]:
    """PCM blocks of the streams in the last column, media, with the columns before it."""
    for b in (x for whole in batches for x in slices(whole, "media", group)):
        names = b.schema.names[:-1]
        stored = b.column("media").to_pylist()
        at = [i for i, x in enumerate(stored) if x is not None]
        row, rows, n = [], [], 0  # finished blocks of the batch that goes out next
        held: list[bytes] = []
        start = no = count = frames_read = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in names), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), BLOCK))], names=[*names, *(c for c, _ in BLOCK)])

        for i, s, first, samples, last in decoded([stored[i] for i in at], group):
            if held and count + samples.shape[1] > most_samples:
                row.append(at[i]), rows.append((no, start, count, b"".join(held), False, None, None, None))
                n += len(rows[-1][3])
                no, held = no + 1, []
            if not held:
                start, count = first, 0
            width = np.int8 if s.bits <= 8 else "<i2" if s.bits <= 16 else "<i4"
            held.append(samples.T.astype(width).tobytes())
            count, frames_read = count + samples.shape[1], frames_read + 1
            if last:
                raw = stored[at[i]]
                row.append(at[i]), rows.append((no, start, count, b"".join(held), True, len(raw), hashlib.sha256(raw).hexdigest(), frames_read))
                n += len(rows[-1][3])
                no = frames_read = 0
                held = []
            if n >= group:
                yield out()
                row, rows, n = [], [], 0
        if rows:
            yield out()


def digest_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stream of 8-bit mono, from its PCM blocks in order; no more than one block's samples are held."""
    sha, tail, size, low, high, energy, turns, before = None, b"", 0, 0, 0, 0, 0, None
    for b in batches:
        at, rows = [], []
        columns = [b.column(c).to_pylist() for c in ("sample_offset", "last", "media_bytes", "media_sha256", "n_frames")]
        for i, (offset, last, media_bytes, media_sha256, n_frames) in enumerate(zip(*columns)):
            signal = np.frombuffer(b.column("pcm")[i].as_buffer(), np.int8)
            if not offset:
                sha, tail, size, low, high, energy, turns, before = hashlib.sha256(), b"", 0, 127, -128, 0, 0, None
            if offset != size:
                raise FlacError(f"a block begins at sample {offset}, not at {size}")
            payload = (signal.view(np.uint8) ^ np.uint8(0x80)).tobytes()
            sha.update(payload)
            tail, size = (tail + payload[-64:])[-64:], size + len(payload)
            low, high = min(low, int(signal.min())), max(high, int(signal.max()))
            wide = signal.astype(np.int64)
            up = signal >= 0
            energy += int(wide @ wide)
            turns += int(np.count_nonzero(up[1:] != up[:-1])) + (before is not None and bool(before != up[0]))
            before = up[-1]
            if last:
                at.append(i), rows.append((size, sha.hexdigest(), zlib.crc32(tail), media_bytes, media_sha256, f"frames={n_frames};low={low};high={high};energy={energy};turns={turns}"))
        if rows:
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            which = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("key").take(which), b.column("n_bytes").take(which), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def pcm_blocks(df: DataFrame, key: str = "doc_id", media: str = "media", group: int = 1 << 20, most_samples: int = FRAME, carry: list[str] | None = None) -> DataFrame:
    """(key, *carry, block, sample_offset, n_samples, pcm, last, ...): every stream's samples as blocks one can seek to.

    A block holds whole frames, as many as most_samples hold, one at least; sample_offset is its first sample's place in
    the stream. pcm interleaves the channels as little-endian signed integers of 8, 16 or 32 bits, the least that holds a
    sample. Blocks of a stream come in order and within one task; its last one also has media_bytes and media_sha256 of
    the stored stream and n_frames. A null stream gives no blocks, nor does one without frames; a damaged one raises
    FlacError. Every header, frame and (for 8-bit mono) stream check is verified. Repeated rows each give their blocks;
    other columns are dropped unless named in carry; an empty table gives none.
    """
    use_workers(df.sparkSession)
    carry = list(carry or [])
    picked = df.select(F.col(key).alias("key"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)), F.col(media).alias("media"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    done = picked.mapInArrow(lambda it: read_blocks(it, group, most_samples), f"{', '.join(kinds)}, {BLOCK_KINDS}")
    return done.withColumnsRenamed({"key": key} | {f"c{i}": c for i, c in enumerate(carry)})


def block_digests(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per stream of 8-bit mono, from the blocks of pcm_blocks with n_bytes carried: hashes of its payload and features.

    Nothing is shuffled: blocks are read in the tasks that made them, so they must come straight from pcm_blocks.
    Repeated rows each give a row; an empty table gives none.
    """
    picked = blocks.select(F.col(key).alias("key"), "n_bytes", "sample_offset", "pcm", "last", "media_bytes", "media_sha256", "n_frames")
    return picked.mapInArrow(digest_blocks, f"key {picked.schema['key'].dataType.simpleString()}, {DIGEST_KINDS}").withColumnRenamed("key", key)


def media_digests(df: DataFrame, key: str = "doc_id", media: str = "media", group: int = 1 << 20) -> DataFrame:
    """block_digests of pcm_blocks of every stored text (key, n_bytes, media), in one pass through Python."""
    use_workers(df.sparkSession)
    picked = df.select(F.col(key).alias("key"), F.col("n_bytes"), F.col(media).alias("media"))
    both = lambda it: digest_blocks(read_blocks(it, group, 1 << 16))
    return picked.mapInArrow(both, f"key {picked.schema['key'].dataType.simpleString()}, {DIGEST_KINDS}").withColumnRenamed("key", key)
