"""Raster work on 8-bit PNGs, in numpy behind Arrow batches; other codecs give an error row."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """Pixels (h, w, channels) of an 8-bit, non-interlaced PNG without a palette."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("only 8-bit PNGs without palette or interlace are read")
    w, h, channels = head[0], head[1], _CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), np.uint8)
    before = np.zeros(w * channels, np.int64)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + before
        elif kind in (1, 3, 4):
            line = _unfilter(int(kind), line, before, channels)
        out[y] = before = line & 255
    return out.reshape(h, w, channels)


def _unfilter(kind: int, line: np.ndarray, up: np.ndarray, step: int) -> np.ndarray:
    for x in range(len(line)):
        a = line[x - step] if x >= step else 0
        c = up[x - step] if x >= step else 0
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + up[x]) // 2
        else:
            p = a + up[x] - c
            pa_, pb, pc = abs(p - a), abs(p - up[x]), abs(p - c)
            guess = a if pa_ <= pb and pa_ <= pc else up[x] if pb <= pc else c
        line[x] = (line[x] + guess) & 255
    return line


def write_png(pixels: np.ndarray) -> bytes:
    h, w, channels = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1).astype(np.uint8)], axis=1)

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(np.int64)
    r, g, b = (pixels[:, :, k].astype(np.int64) for k in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def content_box(mask: np.ndarray, margin: int) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) of the true part of a mask, and a margin; null of none."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(ys):
        return None
    h, w = mask.shape
    return max(0, int(xs[0]) - margin), max(0, int(ys[0]) - margin), min(w, int(xs[-1]) + 1 + margin), min(h, int(ys[-1]) + 1 + margin)


def figure_crop(data: bytes) -> bytes:
    """A rendered figure without the white around it: pixels with a channel over 30 from white, and 6 around them."""
    pixels = read_png(data)
    colour = rgba(pixels)[:, :, :3].astype(np.int64)
    box = content_box((255 - colour > 30).any(axis=2), 6)
    return write_png(pixels[box[1] : box[3], box[0] : box[2]]) if box else data


def flatten(pixels: np.ndarray, format: str, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    """Pixels as a format stores them: PNG with alpha, JPEG and BMP laid on the background, others without alpha."""
    full = rgba(pixels)
    if format.lower() == "png":
        return full
    if format.lower() not in ("jpeg", "jpg", "bmp"):
        return full[:, :, :3]
    alpha = full[:, :, 3:].astype(np.int64)
    mixed = full[:, :, :3].astype(np.int64) * alpha + np.array(background) * (255 - alpha)
    return ((mixed + 127) // 255).astype(np.uint8)


def resize(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Lanczos resampling, one axis after the other."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        x = (np.arange(n)[None, :] - centre[:, None]) / scale
        k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return k / k.sum(axis=1, keepdims=True)

    out = np.einsum("yi,ijc->yjc", weights(pixels.shape[0], h), pixels.astype(np.float64))
    out = np.einsum("xj,yjc->yxc", weights(pixels.shape[1], w), out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def rgba(pixels: np.ndarray, background: tuple[int, int, int] = (255, 255, 255)) -> np.ndarray:
    n = pixels.shape[2]
    colour = pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)
    alpha = pixels[:, :, n - 1 :] if n in (2, 4) else np.full((*pixels.shape[:2], 1), 255, np.uint8)
    return np.concatenate([colour, alpha], axis=2)


def frame(pixels: np.ndarray, width: int, colour: tuple[int, int, int], over: bool = False) -> np.ndarray:
    """Pixels with a frame of one colour around."""
    h, w, _ = pixels.shape
    out = np.empty((h + 2 * width, w + 2 * width, 4), np.uint8)
    out[:] = (*colour, 255)
    out[width : width + h, width : width + w] = pixels
    return out


def colour(text: str) -> tuple[int, int, int]:
    digits = text.lstrip("#")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:6], 16)


def process(data: bytes, crop: bool = False, padding: int = 0, border: int = 0, border_colour: str = "#000000", pad_colour: str = "#ffffff", width: int = 0, height: int = 0) -> bytes:
    """Crop, scale, pad, border; unchanged bytes where there is nothing to do."""
    if not crop and not padding and not border and not (width and height):
        return data
    pixels = read_png(data)
    if crop and (box := content_box(grey(rgba(pixels)) < 220, 4)):
        pixels = pixels[box[1] : box[3], box[0] : box[2]]
    if width and height:
        h, w, _ = pixels.shape
        new_w, new_h = width, int(h * (width / w))
        if new_h > height:
            new_w, new_h = int(w * (height / h)), height
        pixels = resize(pixels, max(1, new_w), max(1, new_h))
    pixels = rgba(pixels)
    if padding:
        pixels = frame(pixels, padding, colour(pad_colour))
    return write_png(frame(pixels, border, colour(border_colour)) if border else pixels)


def dark_margin(data: bytes, side: str, ratio: float = 0.55) -> bool:
    """Whether a dark bar stands in the outer 3% of a page image."""
    g = grey(read_png(data))
    h, w = g.shape
    n = max(3, int(w * 0.03))
    columns = g[int(h * 0.15) : int(h * 0.85), :n] if side == "left" else g[int(h * 0.15) : int(h * 0.85), w - n :]
    dark = (columns < 60).sum(axis=0) / max(1, int(h * 0.70)) >= ratio
    return int(dark.sum()) >= max(1, n // 4)


def process_images(images: DataFrame, **options: object) -> DataFrame:
    """id, w, h, content, error of each row (id, content); a bad image is an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    done = process(data, **options)
                    h, w, _ = read_png(done).shape
                    out.append((name, w, h, done, None))
                except (ValueError, struct.error, zlib.error, TypeError, AttributeError) as wrong:
                    out.append((name, None, None, None, str(wrong)))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["id", "w", "h", "content", "error"])

    return images.select(F.col("id").cast("long").alias("id"), "content").mapInArrow(run, "id long, w int, h int, content binary, error string")
