"""Tiles as PNG images: class colours on hard pixels or squares, and the blend of four heat tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import styles

AT = ("mapKey", "z", "tileX", "tileY")
IMAGE = "mapKey string, z int, tileX int, tileY int, png binary"


def blank(size: int) -> np.ndarray:
    """A clear image: rows, columns, and red, green, blue and opacity."""
    return np.zeros((size, size, 4), np.uint8)


def png(image: np.ndarray) -> bytes:
    high, wide, _ = image.shape
    lines = np.zeros((high, 1 + 4 * wide), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = image.reshape(high, 4 * wide)

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def pixels_of(data: bytes) -> np.ndarray:
    """The image in a PNG as ``png`` writes it."""
    wide, high = struct.unpack(">II", data[16:24])
    at, packed = 8, b""
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + n] if name == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(high, 1 + 4 * wide)
    return lines[:, 1:].reshape(high, wide, 4).copy()


def paint(image: np.ndarray, x: int, y: int, colour: str, width: int = 1) -> None:
    """An opaque square of ``width`` around a pixel; what reaches over the edge is cut."""
    left, top, size = x - (width - 1) // 2, y - (width - 1) // 2, len(image)
    rgb = [int(colour[k : k + 2], 16) for k in (1, 3, 5)]
    image[max(0, top) : max(0, min(size, top + width)), max(0, left) : max(0, min(size, left + width))] = [*rgb, 255]


def rendered(rows: DataFrame, style: str | None = None, size: int = 512, width: int = 1) -> DataFrame:
    """(mapKey, z, tileX, tileY, png) from flattened tile rows; colours are column expressions, images are made in order.

    Pixels of a tile's buffer count as far as their squares reach into it. Where squares overlap, the greater total is on top.
    """
    drawn = rows.select(*AT, "pixelX", "pixelY", "total", styles.colour(F.col("total"), styles.style_name(style)).alias("colour"))
    dealt = drawn.repartition(*AT).sortWithinPartitions(*AT, "total", "pixelY", "pixelX")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, image = None, None

        def finished():
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), *(pa.array([v], pa.int32()) for v in at[1:]), pa.array([png(image)], pa.binary())], names=[*AT, "png"])

        for batch in batches:
            for *place, x, y, colour in zip(*(batch[c].to_pylist() for c in (*AT, "pixelX", "pixelY", "colour")), strict=True):
                if place != at:
                    if at is not None:
                        yield finished()
                    at, image = place, blank(size)
                paint(image, x, y, colour, width)
        if at is not None:
            yield finished()

    return dealt.mapInArrow(draw, IMAGE)


def multiplied(over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Colours multiplied where both images have them, else the one that has; opacity adds up."""
    a, b = over.astype(np.float64) / 255, under.astype(np.float64) / 255
    oa, ob = a[..., 3:], b[..., 3:]
    opacity = oa + ob - oa * ob
    colour = a[..., :3] * oa * (1 - ob) + b[..., :3] * ob * (1 - oa) + a[..., :3] * b[..., :3] * oa * ob
    out = np.concatenate([np.divide(colour, opacity, out=np.zeros_like(colour), where=opacity > 0), opacity], axis=2)
    return np.floor(out * 255 + 0.5).astype(np.uint8)


def heat_composite(children: dict[tuple[int, int], np.ndarray], size: int = 512) -> np.ndarray:
    """A tile from its four children, by (column, row): laid side by side, and each two by two pixels made one."""
    whole = blank(2 * size)
    for (column, row), image in children.items():
        part = (slice(row * size, row * size + size), slice(column * size, column * size + size))
        whole[part] = multiplied(image, whole[part])
    parts = whole.astype(np.float64).reshape(size, 2, size, 2, 4)
    weight = parts[..., 3:]
    opacity = weight.mean((1, 3))
    colour = np.divide((parts[..., :3] * weight).sum((1, 3)), weight.sum((1, 3)), out=np.zeros((size, size, 3)), where=opacity > 0)
    return np.floor(np.concatenate([colour, opacity], axis=2) + 0.5).astype(np.uint8)
