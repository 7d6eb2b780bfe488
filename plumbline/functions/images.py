"""Image kernels in NumPy: gray scale, area resizing, thumbnails, properties, preprocessing, augmentation, mask agreement."""

from __future__ import annotations

import zlib

import numpy as np

from plumbline.functions import jpeg

#: Luminance weights of blue, green and red; preprocessing profiles as (side, normalisation).
LUMINANCE = (0.114, 0.587, 0.299)
CHANNEL_MEANS = (103.939, 116.779, 123.68)
PROFILES = {"legacy_64": (64, "rows_l2"), "standard_224": (224, "unit"), "resnet50_224": (224, "centred"), "efficientnet_224": (224, "none")}


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance as 8-bit values."""
    p = pixels(data, height, width, channels)
    return p[:, :, 0] if channels == 1 else np.rint(p[:, :, :3].astype(float) @ np.array(LUMINANCE)).astype(np.uint8)


def area_weights(n: int, m: int) -> np.ndarray:
    """[m, n]: how much of each of n cells lies in each of m equal cells over the same length."""
    edges = np.linspace(0, n, m + 1)
    low, high = np.maximum.outer(edges[:-1], np.arange(n)), np.minimum.outer(edges[1:], np.arange(1, n + 1))
    return np.maximum(high - low, 0) * (m / n)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each new pixel covers."""
    rows, columns = area_weights(image.shape[0], height), area_weights(image.shape[1], width)
    flat = image.astype(float)
    return np.einsum("hi,ij...,wj->hw...", rows, flat, columns, optimize=True)


def thumbnail(g: np.ndarray, size: int = 32) -> np.ndarray:
    """A size x size thumbnail less its mean over its deviation; zeros if it is constant."""
    t = np.rint(area_resize(g, size, size)).ravel()
    s = t.std()
    return (t - t.mean()) / s if s > 1e-8 else np.zeros_like(t)


def _shifted(g: np.ndarray) -> np.ndarray:
    return np.pad(g.astype(float), 1, mode="reflect")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _shifted(g)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Thinned gradient edges above low that touch one above high: 3x3 Sobel, non-maximum suppression, hysteresis."""
    p = np.pad(g.astype(float), 1, mode="edge")
    dx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    dy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    strength = np.abs(dx) + np.abs(dy)
    around = np.pad(strength, 1)
    h, w = strength.shape
    turn = np.round(np.arctan2(dy, dx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros_like(strength, bool)
    for t, (y, x) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a, b = around[1 + y : 1 + y + h, 1 + x : 1 + x + w], around[1 - y : 1 - y + h, 1 - x : 1 - x + w]
        thin |= (turn == t) & (strength > b) & (strength >= a)
    weak = thin & (strength > low)
    keep = weak & (strength > high)
    while True:
        wide = np.pad(keep, 1)
        grown = weak & np.logical_or.reduce([wide[y : y + h, x : x + w] for y in range(3) for x in range(3)])
        if (grown == keep).all():
            return keep
        keep = grown


def properties(g: np.ndarray) -> dict[str, float]:
    """Sides, mean, deviation, contrast, sharpness, share of dark pixels and of edges."""
    mean, std = float(g.mean()), float(g.std())
    return {"width": float(g.shape[1]), "height": float(g.shape[0]), "mean_intensity": mean, "std_intensity": std, "rms_contrast": std / mean if mean > 1e-6 else 0.0, "laplacian_variance": float(laplacian(g).var()), "dark_fraction": float((g < 40).mean()), "edge_density": float(edges(g).mean())}


def normalised(batch: np.ndarray, kind: str) -> np.ndarray:
    """[n, h, w, 3] red first, as a profile's model wants it."""
    if kind == "unit":
        return batch / np.float32(255)
    if kind == "none":
        return batch
    if kind == "centred":
        return batch[..., ::-1] - np.array(CHANNEL_MEANS, np.float32)
    if kind == "rows_l2":
        norm = np.sqrt((batch**2).sum(axis=1, keepdims=True))
        return batch / np.where(norm == 0, 1, norm)
    raise KeyError(kind)


def preprocess(image: np.ndarray, profile: str) -> np.ndarray:
    """One image, blue first with 1, 3 or 4 channels, as a float32 batch of one in the profile's form."""
    side, kind = PROFILES[profile]
    three = np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] == 1 else image[:, :, 2::-1]
    return normalised(np.rint(area_resize(three, side, side)).astype(np.float32)[None], kind)


def varied(image: np.ndarray, draw: np.random.Generator, flip: bool = True, degrees: float = 15, zoom: float = 0.1, shift: float = 0.1, brightness: float = 0.1) -> np.ndarray:
    """One random variant, not rounded: flip, rotation, zoom and shift by nearest pixels, and brightness."""
    h, w = image.shape[:2]
    a = np.deg2rad(draw.uniform(-degrees, degrees))
    z = draw.uniform(1 - zoom, 1 + zoom)
    ty, tx = draw.uniform(-shift, shift, 2) * (h, w)
    y, x = np.mgrid[:h, :w].astype(float)
    y, x = y - (h - 1) / 2 - ty, x - (w - 1) / 2 - tx
    sy = np.clip(np.rint((np.cos(a) * y - np.sin(a) * x) / z + (h - 1) / 2), 0, h - 1).astype(int)
    sx = np.clip(np.rint((np.sin(a) * y + np.cos(a) * x) / z + (w - 1) / 2), 0, w - 1).astype(int)
    out = image[sy, sx].astype(float) * draw.uniform(1 - brightness, 1 + brightness)
    return out[:, ::-1] if flip and draw.random() < 0.5 else out


def augmented(image: np.ndarray, seed: int, **how: float) -> np.ndarray:
    """One random variant of 8-bit pixels."""
    return np.clip(np.rint(varied(image, np.random.default_rng(seed), **how)), 0, 255).astype(np.uint8)


def variation(settings: dict) -> dict[str, float]:
    """What varied() is to do, from a configuration's augmentation."""
    own = settings.get("augmentation") or {}
    return {"flip": bool(own.get("horizontal_flip", True)), "degrees": own.get("rotation_range", 15), "zoom": own.get("zoom_range", 0.1), "shift": own.get("width_shift_range", 0.1), "brightness": own.get("brightness", 0.1)}


def cubic_weights(n: int, m: int, a: float = -0.75) -> np.ndarray:
    """[m, n]: the share of each of n cells in each of m cells, by cubic convolution around the new cell's centre; beyond the
    ends the last cell goes on. a is the usual sharpness."""
    at = (np.arange(m) + 0.5) * (n / m) - 0.5
    first = np.floor(at).astype(int)
    out = np.zeros((m, n))
    for k in range(-1, 3):
        x = np.abs(at - (first + k))
        w = np.where(x <= 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, a * (x**3 - 5 * x**2 + 8 * x - 4))
        np.add.at(out, (np.arange(m), np.clip(first + k, 0, n - 1)), w)
    return out


def cubic_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, by cubic weights of rows and of columns; at its own size it stays as it is."""
    if image.shape[:2] == (height, width):
        return image.astype(float)
    return np.einsum("hi,ij...,wj->hw...", cubic_weights(image.shape[0], height), image.astype(float), cubic_weights(image.shape[1], width), optimize=True)


def heat_colours() -> np.ndarray:
    """[256, 3]: red, green and blue from cold to hot: blue, cyan, yellow, red, each a ramp over half the way."""
    x = np.arange(256) / 255
    return np.rint(255 * np.clip(1.5 - np.abs(4 * x[:, None] - np.array([3, 2, 1])), 0, 1)).astype(np.uint8)


def overlaid(rgb: np.ndarray, heatmap: np.ndarray, alpha: float = 0.4) -> np.ndarray:
    """8-bit pixels under the colours of a heat map from 0 to 1, which count alpha."""
    hot = np.clip(cubic_resize(heatmap, *rgb.shape[:2]), 0, 1)
    return np.clip(np.rint(rgb * (1.0 - alpha) + heat_colours()[(255 * hot).astype(np.uint8)] * alpha), 0, 255).astype(np.uint8)


def class_heatmaps(activations: np.ndarray, gradients: np.ndarray) -> np.ndarray:
    """[n, h, w] from 0 to 1 of [n, h, w, channels]: channels weighed by their mean gradient, what speaks against the class
    cut off, over the peak; all 0 where nothing speaks for it."""
    weights = gradients.mean(axis=(1, 2))
    heat = np.maximum(np.einsum("nhwc,nc->nhw", activations, weights), 0)
    peak = heat.max(axis=(1, 2), initial=0)[:, None, None]
    return np.divide(heat, peak, out=np.zeros_like(heat), where=peak > 1e-12)


def mask_agreement(heatmap: np.ndarray, mask: np.ndarray, percentile: float = 80) -> dict[str, float | bool]:
    """How a heat map, brought to the mask's size, agrees with a mask (above 127): whether its peak lies inside, overlap over
    union of its hottest pixels (at the percentile or above, never 0) with the mask, the mask's share of the image, and
    whether there is no hot pixel."""
    return {name: of[0].item() for name, of in mask_agreements(heatmap[None], mask[None], percentile).items()}


def mask_agreements(heatmaps: np.ndarray, masks: np.ndarray, percentile: float = 80) -> dict[str, np.ndarray]:
    """mask_agreement() of each of n heat maps of one size with its mask, and masks are of one size too."""
    m = (masks > 127).reshape(len(masks), -1)
    h = np.stack([cubic_resize(x, *masks.shape[1:]).ravel() for x in heatmaps])
    hot = (h >= np.percentile(h, percentile, axis=1)[:, None]) & (h > 0)
    union, inside, some = (hot | m).sum(axis=1), (hot & m).sum(axis=1), hot.any(axis=1)
    iou = np.where(some, inside / np.maximum(union, 1), 0.0)
    return {"pointing_hit": m[np.arange(len(m)), h.argmax(axis=1)], "iou": iou, "mask_coverage": m.mean(axis=1), "degenerate": ~some}


def decoded(payload: bytes | None) -> np.ndarray | None:
    """Pixels [h, w, channels], blue first, of a PNG (16 bits are cut to 8), a sequential JPEG or an uncompressed BMP;
    else None."""
    try:
        if payload and payload[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(payload)
        if payload and payload[:3] == b"\xff\xd8\xff":
            return jpeg.decoded(payload)
        if payload and payload[:2] == b"BM":
            return _bmp(payload)
    except (ValueError, IndexError, KeyError, zlib.error):
        pass
    return None


def sides(payload: bytes | None) -> tuple[int, int] | None:
    """(width, height) of an image that decodes; of a JPEG that is not sequential, those its header states; else None."""
    p = decoded(payload)
    if p is not None:
        return p.shape[1], p.shape[0]
    stated = jpeg.frame(payload) if payload and payload[:3] == b"\xff\xd8\xff" else None
    return stated[:2] if stated and not stated[2] else None


def _unfiltered(raw: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """Bytes [rows, line] of PNG scan lines, whose filters look step bytes to the left."""
    raw = raw.reshape(rows, 1 + line)
    out = np.zeros((rows + 1, line + step), np.uint8)  # one row above and one pixel to the left are zero
    for y in range(rows):
        way, given, above, row = int(raw[y, 0]), raw[y, 1:], out[y], out[y + 1]
        if way == 0:
            row[step:] = given
        elif way == 1:
            for i in range(step):
                row[step + i :: step] = np.cumsum(given[i::step], dtype=np.uint8)
        elif way == 2:
            row[step:] = given + above[step:]
        elif way in (3, 4):
            own, over, new = row.tolist(), above.tolist(), given.tolist()
            for x in range(line):
                left, up, corner = own[x], over[x + step], over[x]
                if way == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = left if a <= b and a <= c else up if b <= c else corner
                own[x + step] = (new[x] + guess) & 255
            row[:] = own
        else:
            raise ValueError("unknown row filter")
    return out[1:, step:]


#: First column and row, and steps between them, of the seven passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(b: bytes) -> np.ndarray:
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(b):
        n, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or not int.from_bytes(head[:4], "big") or not int.from_bytes(head[4:8], "big"):
        raise ValueError("no PNG header")
    w, h, depth, kind, laced = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9], head[12]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)

    def part(start: int, wide: int, high: int) -> tuple[np.ndarray, int]:
        line = -(-wide * c * depth // 8)
        end = start + high * (1 + line)
        rows = _unfiltered(raw[start:end], high, line, max(1, c * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(high, -1, depth)
            rows = bits.dot(1 << np.arange(depth)[::-1])[:, : wide * c].astype(np.uint8)
            if kind != 3:
                rows = rows * np.uint8(255 // ((1 << depth) - 1))
        return rows.reshape(high, wide, c), end

    if not laced:
        p = part(0, w, h)[0]
    else:
        p, start = np.zeros((h, w, c), np.uint8), 0
        for x, y, dx, dy in PASSES:
            wide, high = -(-(w - x) // dx), -(-(h - y) // dy)
            if wide > 0 and high > 0:
                p[y::dy, x::dx], start = part(start, wide, high)
    if kind == 3:
        return palette[p[:, :, 0]][:, :, ::-1]
    return p[:, :, :1] if c < 3 else p[:, :, 2::-1] if c == 3 else p[:, :, [2, 1, 0, 3]]


def _bmp(b: bytes) -> np.ndarray:
    word = lambda i, n=4: int.from_bytes(b[i : i + n], "little", signed=n == 4)
    start, head, w, h, bits = word(10), word(14), word(18), word(22), word(28, 2)
    if bits not in (1, 4, 8, 24, 32) or word(30) or w <= 0 or not h:
        raise ValueError("not a plain BMP")
    stride = (bits * w + 31) // 32 * 4
    rows = np.frombuffer(b, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    if bits > 8:
        p = rows[:, : bits // 8 * w].reshape(abs(h), w, bits // 8)[:, :, :3]
    else:
        colours = np.frombuffer(b, np.uint8, 4 * (word(46) or 1 << bits), 14 + head).reshape(-1, 4)[:, :3]
        at = np.unpackbits(rows, axis=1).reshape(abs(h), -1, bits).dot(1 << np.arange(bits)[::-1])[:, :w]
        p = colours[at]
    return p[::-1] if h > 0 else p


def png(image: np.ndarray) -> bytes:
    """The PNG of [h, w] or [h, w, 1] gray or [h, w, 3 or 4] pixels, blue first; values are cut to 0 to 255."""
    p = np.clip(np.rint(image.astype(float)), 0, 255).astype(np.uint8)
    p = p[:, :, None] if p.ndim == 2 else p
    h, w, c = p.shape
    if c > 1:
        p = p[:, :, [2, 1, 0, 3][:c]]
    rows = np.concatenate((np.zeros((h, 1), np.uint8), p.reshape(h, w * c)), axis=1)
    part = lambda name, data: len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def shown(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size for display: red first, 8 bits, not normalised."""
    three = np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] == 1 else image[:, :, 2::-1]
    return np.rint(area_resize(three, height, width)).astype(np.uint8)


def small_copy(image: np.ndarray, longest: int = 128) -> np.ndarray:
    """The image with its longer side at most longest; never larger than it was."""
    h, w = image.shape[:2]
    scale = longest / max(h, w)
    if scale >= 1:
        return image
    return np.rint(area_resize(image, max(1, int(h * scale)), max(1, int(w * scale)))).astype(np.uint8)
