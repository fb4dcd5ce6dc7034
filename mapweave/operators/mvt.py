"""Vector tiles and point lists as protobuf bytes, written and read by hand."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of the bases of record in point lists.
NUMBERS = {"UNKNOWN": 0, "PRESERVED_SPECIMEN": 1, "FOSSIL_SPECIMEN": 2, "LIVING_SPECIMEN": 3, "OBSERVATION": 4, "HUMAN_OBSERVATION": 5, "MACHINE_OBSERVATION": 6, "MATERIAL_SAMPLE": 7, "LITERATURE": 8, "OCCURRENCE": 9, "MATERIAL_CITATION": 10}
NAMES = {v: k for k, v in NUMBERS.items()}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            at += 8
            yield tag >> 3, struct.unpack("<d", data[at - 8 : at])[0]
        elif kind == 2:
            n = varint()
            at += n
            yield tag >> 3, data[at - n : at]
        elif kind == 5:
            at += 4
            yield tag >> 3, data[at - 4 : at]
        else:
            raise ValueError("not a vector tile")


def _packed(numbers: list[int]) -> bytes:
    return b"".join(map(_varint, numbers))


def _unpacked(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(n)
            n = shift = 0
    return out


def _zigzag(n: int) -> int:
    return n << 1 ^ n >> 63


def _unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


#: A geometry: one point, or the closed ring of a polygon without its last point.
Shape = tuple[int, int] | list[tuple[int, int]]


class _Layer:
    """A layer in the making; its parts are joined once, so a tile costs time in proportion to its bytes."""

    def __init__(self, name: str) -> None:
        self.name, self.keys, self.values, self.features = name, {}, {}, []

    def add(self, shape: Shape, attributes: dict[str, int | str]) -> None:
        tags = []
        for k, v in attributes.items():
            tags += [self.keys.setdefault(k, len(self.keys)), self.values.setdefault(v, len(self.values))]
        point = isinstance(shape, tuple)
        self.features.append(_field(2, _field(2, _packed(tags)) + _field(3, 1 if point else 3) + _field(4, _packed(_commands([shape] if point else _clockwise(shape))))))

    def bytes(self, size: int) -> bytes:
        names = [_field(3, k.encode()) for k in self.keys]
        values = [_field(4, _field(1, v.encode()) if isinstance(v, str) else _field(4, v)) for v in self.values]
        return _field(3, b"".join([_field(15, 2), _field(1, self.name.encode()), *self.features, *names, *values, _field(5, size)]))


def _clockwise(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An outer ring turns to the right, with y downwards."""
    area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True))
    return ring if area >= 0 else ring[::-1]


def _commands(points: list[tuple[int, int]]) -> list[int]:
    """Move to the first point; a ring goes on by lines and closes. Positions are steps from the last one."""
    out, (x, y) = [1 << 3 | 1], points[0]
    out += [_zigzag(x), _zigzag(y)]
    if len(points) > 1:
        out.append(len(points) - 1 << 3 | 2)
        for x1, y1 in points[1:]:
            out += [_zigzag(x1 - x), _zigzag(y1 - y)]
            x, y = x1, y1
        out.append(1 << 3 | 7)
    return out


def _points_of(commands: list[int]) -> list[tuple[int, int]]:
    """The points of a geometry's first part."""
    out, at, x, y = [], 0, 0, 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == 7 or (what == 1 and out):
            break
        for _ in range(times):
            x, y = x + _unzigzag(commands[at]), y + _unzigzag(commands[at + 1])
            out.append((x, y))
            at += 2
    return out


def encode_tile(layers: dict[str, list[tuple[int, int, dict[str, int]]]], size: int = 512) -> bytes:
    """Layers of point features (x, y, attributes with whole values)."""
    return encode_shapes({name: [((x, y), attributes) for x, y, attributes in features] for name, features in layers.items()}, size)


def encode_shapes(layers: dict[str, list[tuple[Shape, dict[str, int]]]], size: int) -> bytes:
    """Layers of points and polygons with whole-valued attributes."""
    out = []
    for name, features in layers.items():
        layer = _Layer(name)
        for shape, attributes in features:
            layer.add(shape, attributes)
        out.append(layer.bytes(size))
    return b"".join(out)


def lenient(value: int | bytes | float, kind: int) -> int | None:
    """An attribute's value as a whole number, from any of the format's types; None if it is none."""
    if kind == 1:
        text = value.decode("utf-8", "replace").strip()
        return int(text) if text.lstrip("+-").isdigit() and text.isascii() else None
    if kind == 2:
        value = struct.unpack("<f", value)[0]
    if kind in (2, 3):
        return int(value) if value == int(value) else None
    return _unzigzag(value) if kind == 6 else value if kind in (4, 5, 7) else None


def decode_shapes(data: bytes, only: set[str] | None = None) -> Iterator[tuple[str, Shape, dict[str, int]]]:
    """(layer, shape, attributes) of all layers or those named; attributes that are no whole numbers are left out."""
    for number, layer in _fields(data):
        if number != 3:
            continue
        name, features, keys, values = "", [], [], []
        for k, v in _fields(layer):
            if k == 1:
                name = v.decode()
            elif k == 2:
                features.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(next((lenient(x, kind) for kind, x in _fields(v)), None))
        if only is not None and name not in only:
            continue
        for feature in features:
            parts = dict(_fields(feature))
            tags, points = _unpacked(parts.get(2, b"")), _points_of(_unpacked(parts.get(4, b"")))
            attributes = {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True) if values[b] is not None}
            if points and parts.get(3) in (1, 3):
                yield name, points[0] if parts[3] == 1 else points, attributes


def described(data: bytes) -> list[str]:
    """A tile as lines of text, for looking into it: its layers, and each feature's shape and attributes."""
    out, layer = [], None
    for name, shape, attributes in decode_shapes(data):
        if name != layer:
            out.append(f"layer {name}")
            layer = name
        points = [shape] if isinstance(shape, tuple) else shape
        out.append(f"  {'point' if isinstance(shape, tuple) else 'polygon'} {','.join(f'{x} {y}' for x, y in points)} {' '.join(f'{k}={v}' for k, v in sorted(attributes.items()))}".rstrip())
    return out


def decode_tile(data: bytes, only: set[str] | None = None) -> dict[str, list[tuple[int, int, dict[str, int]]]]:
    """Layers of points, all or those named."""
    out: dict[str, list] = {}
    for name, shape, attributes in decode_shapes(data, only):
        if isinstance(shape, tuple):
            out.setdefault(name, []).append((*shape, attributes))
    return out


def encode_points(points: list[tuple[float, float, str, int, int]]) -> bytes:
    """Point lists (latitude, longitude, basis, year, count) with their real counts."""
    one = lambda lat, lng, basis, year, count: _field(1, float(lat)) + _field(2, float(lng)) + _field(3, NUMBERS[basis]) + (_field(4, year) if year else b"") + (_field(5, count) if count != 1 else b"")
    return b"".join([_field(1, one(*p)) for p in points])


def decode_points(data: bytes) -> list[tuple[float, float, str, int, int]]:
    out = []
    for _, one in _fields(data):
        f = dict(_fields(one))
        out.append((f[1], f[2], NAMES[f[3]], f.get(4, 0), f.get(5, 1)))
    return out


AT = ("mapKey", "z", "tileX", "tileY")
TILE = "mapKey string, z int, tileX int, tileY int, tile binary"


def _streamed(rows: DataFrame, order: list[str], grow: Callable[[dict[str, _Layer], dict[str, list], int, int], None], size: int) -> DataFrame:
    """Tiles from rows dealt by tile and sorted; ``grow(layers, columns, from, to)`` adds one tile's rows, as they come.

    Nothing is gathered in the engine: a task holds the bytes of the tile that it is writing.
    """
    dealt = rows.repartition(*AT).sortWithinPartitions(*AT, *order)

    def encode(batches):
        at, layers = None, {}

        def finished():
            tile = b"".join(layer.bytes(size) for layer in layers.values())
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.string()), *(pa.array([v], pa.int32()) for v in at[1:]), pa.array([tile], pa.binary())], names=[*AT, "tile"])

        for batch in batches:
            columns = batch.to_pydict()
            places = list(zip(*(columns[c] for c in AT), strict=True))
            edges = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if places[a] != at:
                    if at is not None:
                        yield finished()
                    at, layers = places[a], {}
                grow(layers, columns, a, b)
        if at is not None:
            yield finished()

    return dealt.mapInArrow(encode, TILE)


def encoded_tiles(rows: DataFrame, size: int = 512) -> DataFrame:
    """(mapKey, z, tileX, tileY, tile): one layer per basis of record, years as attributes."""
    counted = rows.groupBy(*AT, "bor", "pixelX", "pixelY", "year").agg(F.sum("cnt").alias("cnt"))
    held: dict = {}

    def grow(layers, columns, a, b):
        if not layers:
            held.clear()
        while a < b:
            bor, place = columns["bor"][a], (columns["pixelX"][a], columns["pixelY"][a])
            layer, years = layers.setdefault(bor, _Layer(bor)), {}
            if held.get("place") == (bor, place):  # a pixel's rows follow each other, but a batch may part them
                layer.features.pop()
                years = held["years"]
            while a < b and (columns["bor"][a], (columns["pixelX"][a], columns["pixelY"][a])) == (bor, place):
                years[str(columns["year"][a])] = int(columns["cnt"][a])
                a += 1
            held.update(place=(bor, place), years=years)
            layer.add(place, years)

    return _streamed(counted, ["bor", "pixelX", "pixelY", "year"], grow, size)


def encoded_polygons(cells: DataFrame, size: int = 4096, layer: str = "occurrence") -> DataFrame:
    """(mapKey, z, tileX, tileY, tile) from rows with ``ring`` (an array of whole x and y, not closed) and ``total``.

    A ring of one point is a point. A column ``years`` (a map of counts) becomes further attributes, named by year,
    and a column ``texts`` (a map of strings) others.
    """
    rows = cells if "mapKey" in cells.columns else cells.withColumn("mapKey", F.lit(""))
    maps = [c for c in ("years", "texts") if c in rows.columns]
    rows = rows.select(*AT, F.transform("ring", lambda p: F.array(p.x.cast("int"), p.y.cast("int"))).alias("ring"), F.col("total").cast("long").alias("total"), *(F.map_entries(c).alias(c) for c in maps))

    def grow(layers, columns, a, b):
        one = layers.setdefault(layer, _Layer(layer))
        for i in range(a, b):
            more = {str(e["key"]): e["value"] if c == "texts" else int(e["value"]) for c in maps for e in columns[c][i] or ()}
            ring = [tuple(p) for p in columns["ring"][i]]
            one.add(ring if len(ring) > 1 else ring[0], {"total": int(columns["total"][i]), **more})

    return _streamed(rows, ["ring"], grow, size)


def decoded_polygons(stored: DataFrame) -> DataFrame:
    """(mapKey, z, tileX, tileY, ring, total) of what is in encoded tiles; ``ring`` as text, ``x y,x y,...``, of a point ``x y``."""

    def decode(batches):
        for batch in batches:
            rows = []
            for *place, data in zip(*(batch[c].to_pylist() for c in (*AT, "tile")), strict=True):
                rows += [(*place, ",".join(f"{x} {y}" for x, y in (shape if isinstance(shape, list) else [shape])), attributes.get("total")) for _, shape, attributes in decode_shapes(data)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*AT, "ring", "total"])

    return stored.select(*AT, "tile").mapInArrow(decode, "mapKey string, z int, tileX int, tileY int, ring string, total long")


def decoded_tiles(stored: DataFrame, only: set[str] | None = None) -> DataFrame:
    """The rows of encoded tiles again."""

    def decode(parts):
        for part in parts:
            rows = []
            for key, z, x, y, data in part[["mapKey", "z", "tileX", "tileY", "tile"]].itertuples(index=False):
                for bor, features in decode_tile(bytes(data), only).items():
                    rows += [(key, z, x, y, px, py, bor, int(k), v) for px, py, years in features for k, v in years.items() if k.lstrip("-").isdigit()]
            yield pd.DataFrame(rows, columns=["mapKey", "z", "tileX", "tileY", "pixelX", "pixelY", "bor", "year", "cnt"])

    return stored.mapInPandas(decode, "mapKey string, z int, tileX int, tileY int, pixelX int, pixelY int, bor string, year int, cnt long")


POINT = "mapKey string, lat double, lng double, bor string, year int, cnt long"


def encoded_points(listed: DataFrame) -> DataFrame:
    """(mapKey, points) from unpacked point rows, streamed in order; keys are small ones, whose lists are under the tile threshold."""
    dealt = listed.select("mapKey", "lat", "lng", "bor", "year", "cnt").repartition("mapKey").sortWithinPartitions("mapKey", "lat", "lng", "bor", "year")

    def encode(batches):
        key, parts = None, []

        def finished():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([b"".join(parts)], pa.binary())], names=["mapKey", "points"])

        for batch in batches:
            for k, *point in zip(*(batch[c].to_pylist() for c in ("mapKey", "lat", "lng", "bor", "year", "cnt")), strict=True):
                if k != key:
                    if parts:
                        yield finished()
                    key, parts = k, []
                parts.append(encode_points([tuple(point)]))
        if parts:
            yield finished()

    return dealt.mapInArrow(encode, "mapKey string, points binary")


def decoded_points(stored: DataFrame) -> DataFrame:
    """The rows of encoded point lists again: (mapKey, lat, lng, bor, year, cnt)."""

    def decode(batches):
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int64())
        for batch in batches:
            rows = [(k, *p) for k, data in zip(batch["mapKey"].to_pylist(), batch["points"].to_pylist(), strict=True) for p in decode_points(data)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["mapKey", "lat", "lng", "bor", "year", "cnt"])

    return stored.select("mapKey", "points").mapInArrow(decode, POINT)
