"""Sequential JPEG (ITU-T T.81, Huffman coding, 8 bits) in NumPy: pixels of a file's bytes, and bytes of pixels.

Progressive, lossless and arithmetic files are not read. Colour at half size is widened smoothly, as common libraries do.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

#: Fixed values of the standard's annex K: steps of quantisation at quality 50 for brightness and colour, by rows.
BRIGHTNESS = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
COLOUR = np.array([17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99])
#: Places of an 8 x 8 block from low to high frequency: diagonal after diagonal, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
COSINES = np.array([[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class JpegError(ValueError):
    pass


def lookup(lengths: list[int], symbols: list[int]) -> tuple[list[int], list[int]]:
    """For each 16 bits that may come next: the length of the code they begin with (0: none) and its symbol."""
    size, value, code = [0] * 65536, [0] * 65536, 0
    at = 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first, last = code << (16 - n), (code + 1) << (16 - n)
            if last > 65536:
                raise JpegError("a code table is overfull")
            size[first:last], value[first:last] = [n] * (last - first), [symbols[at]] * (last - first)
            at, code = at + 1, code + 1
        code <<= 1
    return size, value


class Bits:
    """The entropy-coded bits of one restart interval."""

    def __init__(self, data: bytes):
        self.window, self.have, self.data, self.at = 0, 0, data + b"\xff" * 8, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 6]
        if not part:
            raise JpegError("the data end within a block")
        self.at += len(part)
        self.window = self.window << 8 * len(part) | int.from_bytes(part, "big")
        self.have += 8 * len(part)

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.have < 16:
            self.fill()
        top = self.window >> (self.have - 16)
        n = table[0][top]
        if not n:
            raise JpegError("no such code")
        self.have -= n
        self.window &= (1 << self.have) - 1
        return table[1][top]

    def number(self, n: int) -> int:
        """A signed number of n bits as the standard codes it."""
        if not n:
            return 0
        if self.have < n:
            self.fill()
        self.have -= n
        v = self.window >> self.have
        self.window &= (1 << self.have) - 1
        return v if v >> (n - 1) else v - (1 << n) + 1


def segments(raw: bytes) -> tuple[dict, list[bytes]]:
    """What the markers say, and the restart intervals of the one scan."""
    said: dict = {"steps": {}, "dc": {}, "ac": {}, "restart": 0, "adobe": None}
    at = 2
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise JpegError("no marker where one should be")
        kind = raw[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        n = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + n]
        if kind == 0xDB:
            i = 0
            while i < len(body):
                wide, name = body[i] >> 4, body[i] & 15
                said["steps"][name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, i + 1).astype(np.int64)
                i += 1 + 64 * (1 + wide)
        elif kind == 0xC4:
            i = 0
            while i < len(body):
                lengths = list(body[i + 1 : i + 17])
                m = sum(lengths)
                said["ac" if body[i] >> 4 else "dc"][body[i] & 15] = lookup(lengths, list(body[i + 17 : i + 17 + m]))
                i += 17 + m
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("not 8 bits")
            said["height"], said["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            said["parts"] = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise JpegError("not sequential")
        elif kind == 0xDD:
            said["restart"] = int.from_bytes(body[:2], "big")
        elif kind == 0xEE and body[:5] == b"Adobe":
            said["adobe"] = body[11]
        elif kind == 0xDA:
            said["tables"] = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)}
            start, parts = at + 2 + n, []
            i = start
            while True:
                i = raw.find(b"\xff", i)
                if i < 0 or i + 1 >= len(raw):
                    parts.append(raw[start:])
                    break
                follow = raw[i + 1]
                if follow == 0:
                    i += 2
                elif 0xD0 <= follow <= 0xD7:
                    parts.append(raw[start:i])
                    start = i = i + 2
                elif follow == 0xFF:
                    i += 1
                else:
                    parts.append(raw[start:i])
                    break
            return said, [p.replace(b"\xff\x00", b"\xff") for p in parts]
        at += 2 + n
    raise JpegError("no scan")


def frame(raw: bytes) -> tuple[int, int, bool] | None:
    """(width, height, whether decoded() is meant for it) by the frame header, of any kind of JPEG; None without one."""
    at = 2
    while at + 9 <= len(raw) and raw[at] == 0xFF:
        kind = raw[at + 1]
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(raw[at + 7 : at + 9], "big"), int.from_bytes(raw[at + 5 : at + 7], "big"), kind < 0xC2
        else:
            at += 2 + int.from_bytes(raw[at + 2 : at + 4], "big")
    return None


def widened(plane: np.ndarray, times: int) -> np.ndarray:
    """Rows made so many times as many: twice as many by three parts of the nearer and one of the farther row, else repeated."""
    if times != 2:
        return plane.repeat(times, axis=0)
    wide = np.pad(plane, ((1, 1), (0, 0)), mode="edge")
    out = np.empty((2 * len(plane), plane.shape[1]))
    out[::2], out[1::2] = (3 * plane + wide[:-2]) / 4, (3 * plane + wide[2:]) / 4
    return out


def decoded(raw: bytes) -> np.ndarray:
    """Pixels [h, w, 1 or 3], blue first; JpegError for what is not a sequential JPEG of one or three components."""
    said, intervals = segments(raw)
    if "parts" not in said or len(said["parts"]) not in (1, 3) or not said["width"] or not said["height"]:
        raise JpegError("no frame of one or three components")
    if set(said["tables"]) != {p[0] for p in said["parts"]}:
        raise JpegError("not one scan of all components")
    h, w = said["height"], said["width"]
    parts = said["parts"] if len(said["parts"]) > 1 else [(said["parts"][0][0], 1, 1, said["parts"][0][3])]
    top, wide = max(p[2] for p in parts), max(p[1] for p in parts)
    across, down = -(-w // (8 * wide)), -(-h // (8 * top))
    planes = [np.zeros((down * p[2], across * p[1], 64), np.int64) for p in parts]
    tables = [(said["dc"][said["tables"][p[0]][0]], said["ac"][said["tables"][p[0]][1]]) for p in parts]
    units = across * down
    every = said["restart"] or units
    order = ZIGZAG.tolist()
    if len(intervals) < -(-units // every):
        raise JpegError("restart intervals are missing")
    for no in range(-(-units // every)):
        bits, before = Bits(intervals[no]), [0] * len(parts)
        for unit in range(no * every, min(units, (no + 1) * every)):
            y, x = divmod(unit, across)
            for c, (_, ph, pv, _) in enumerate(parts):
                dc, ac = tables[c]
                for i in range(ph * pv):
                    own = planes[c][y * pv + i // ph, x * ph + i % ph]
                    before[c] += bits.number(bits.symbol(dc))
                    own[0] = before[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        if k > 63:
                            raise JpegError("a block is overfull")
                        own[order[k]] = bits.number(s & 15)
                        k += 1
    out = []
    for plane, (_, ph, pv, q) in zip(planes, parts):
        steps = np.zeros(64, np.int64)
        steps[ZIGZAG] = said["steps"][q]
        blocks = (plane * steps).reshape(*plane.shape[:2], 8, 8).astype(float)
        flat = (COSINES.T @ blocks @ COSINES).transpose(0, 2, 1, 3).reshape(8 * plane.shape[0], 8 * plane.shape[1]) + 128
        flat = flat[: -(-h * pv // top), : -(-w * ph // wide)]
        out.append(widened(widened(flat, top // pv).T, wide // ph).T[:h, :w])
    if len(out) == 1:
        rgb = [out[0]]
    elif said["adobe"] == 0:
        rgb = out[::-1]
    else:
        b, r = out[1] - 128, out[2] - 128
        rgb = [out[0] + 1.772 * b, out[0] - 0.344136 * b - 0.714136 * r, out[0] + 1.402 * r]
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


def code_lengths(counts: Counter) -> dict[int, int]:
    """Lengths of a Huffman code of at most 16 bits that leaves the code of all ones free."""
    weight = dict(counts) or {0: 1}
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(weight.items()))] + [(0, -1, (256,))]
        heapq.heapify(heap)
        depth = Counter({s: 0 for _, _, (s,) in heap})
        turn = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            depth.update(both)
            heapq.heappush(heap, (a[0] + b[0], turn, both))
            turn += 1
        if max(depth.values()) <= 16:
            break
        weight = {s: n // 2 + 1 for s, n in weight.items()}
    last = max(depth, key=lambda s: (depth[s], s))
    depth[256], depth[last] = depth[last], depth[256]  # the spare symbol takes a longest code
    return {s: n for s, n in depth.items() if s != 256}


def codes_of(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table as the file holds it, and (code, bits) of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = Counter(lengths.values())
    table = bytes(counts[n] for n in range(1, 17)) + bytes(order)
    found, code, before = {}, 0, 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        found[s] = (code, lengths[s])
        code += 1
    return table, found


def encoded(image: np.ndarray, quality: int = 70) -> bytes:
    """The JPEG of [h, w], [h, w, 1] or [h, w, 3] 8-bit pixels, blue first; colour is kept at full size."""
    p = image[:, :, None] if image.ndim == 2 else image
    h, w = p.shape[:2]
    if p.shape[2] == 1:
        planes = [p[:, :, 0].astype(float)]
    else:
        b, g, r = (p[:, :, i].astype(float) for i in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    colour = np.full((8, 8), 99)
    colour[:4, :4] = COLOUR.reshape(4, 4)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    steps = [np.clip((t.reshape(64) * scale + 50) // 100, 1, 255) for t in (BRIGHTNESS, colour)]
    rows, columns = -(-h // 8), -(-w // 8)
    blocks = []
    for i, plane in enumerate(planes):
        full = np.pad(plane, ((0, 8 * rows - h), (0, 8 * columns - w)), mode="edge") - 128
        cut = full.reshape(rows, 8, columns, 8).transpose(0, 2, 1, 3)
        spectrum = (COSINES @ cut @ COSINES.T).reshape(rows * columns, 64)
        blocks.append(np.rint(spectrum / steps[min(i, 1)])[:, ZIGZAG].astype(np.int64).tolist())
    size = lambda v: abs(v).bit_length()
    words: list[tuple[int, int, int, int]] = []  # (table, symbol, value, bits)
    before = [0] * len(planes)
    for n in range(rows * columns):
        for c in range(len(planes)):
            own, kind = blocks[c][n], 2 * min(c, 1)
            d, before[c] = own[0] - before[c], own[0]
            words.append((kind, size(d), d, size(d)))
            run = 0
            last = max((k for k in range(1, 64) if own[k]), default=0)
            for k in range(1, last + 1):
                if not own[k]:
                    run += 1
                    continue
                while run > 15:
                    words.append((kind + 1, 0xF0, 0, 0))
                    run -= 16
                words.append((kind + 1, run << 4 | size(own[k]), own[k], size(own[k])))
                run = 0
            if last < 63:
                words.append((kind + 1, 0, 0, 0))
    tables = [codes_of(code_lengths(Counter(s for t, s, _, _ in words if t == kind))) for kind in range(2 * min(2, len(planes)))]
    text = []
    for t, s, v, n in words:
        code, m = tables[t][1][s]
        text.append(f"{code:0{m}b}" + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""))
    line = "".join(text)
    line += "1" * (-len(line) % 8)
    data = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00")
    part = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for i in range(min(2, len(planes))):
        out += part(0xDB, bytes([i]) + bytes(steps[i][ZIGZAG].tolist()))
    out += part(0xC0, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(len(planes))))
    for t, (table, _) in enumerate(tables):
        out += part(0xC4, bytes([(t % 2) << 4 | t // 2]) + table)
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(len(planes))) + b"\0\x3f\0")
    return out + data + b"\xff\xd9"
