"""Where prepared data lie: salted and sorted layouts, pointers to the live tables, and their retention."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.functions.keys import row_key, salt, salted, tile_key

_STAMP = re.compile(r"(\d{8}_\d{4})$")


#: Where a nested settings file has what a build needs.
SETTINGS = {
    "source": ("sourceSubdirectory", "snapshotDirectory"),
    "target": ("targetDirectory",),
    "table": ("hbase.tableName",),
    "threshold": ("tilesThreshold",),
    "modulus": ("hbase.keySaltModulusTiles",),
    "tile_size": ("tileSize",),
    "buffer": ("tileBufferSize",),
    "max_zoom": ("maxZoom",),
    "checklists": ("checklistsToProcess",),
}


def nested(text: str) -> dict:
    """Settings from indented lines ``name: value``, where a name without a value holds the deeper lines or ``- item`` lines below it.

    Values are JSON or bare text; `` #`` begins a remark.
    """

    def value(raw: str):
        raw = raw.strip()
        try:
            return json.loads(raw)
        except ValueError:
            return raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] == "'" else raw

    lines = []
    for line in text.splitlines():
        body = "" if line.lstrip().startswith("#") else line.split(" #")[0].rstrip()
        if body.strip() and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(at: int, indent: int) -> tuple[dict | list, int]:
        """What the lines of one indentation from ``at`` hold, and the line after them."""
        out: dict | list = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- ") == isinstance(out, list):
            body = lines[at][1]
            at += 1
            if isinstance(out, list):
                out.append(value(body[2:]))
                continue
            key, _, raw = body.partition(":")
            found = value(raw) if raw.strip() else None
            if not raw.strip() and at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- ")):
                found, at = block(at, lines[at][0])
            out[key.strip().strip("\"'")] = found
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


@dataclass
class Config:
    """Settings of a build."""

    source: str
    target: str
    mode: str = "all"
    timestamp: str = "19700101_0000"
    table: str = "maps"
    threshold: int = 250_000
    modulus: int = 100
    tile_size: int = 512
    buffer: int = 64
    max_zoom: int = 16
    projections: tuple[str, ...] = ("EPSG:3857", "EPSG:4326", "EPSG:3575", "EPSG:3031")
    checklists: tuple[str, ...] = ()
    records_per_file: int = 10_000_000
    #: Files that the filtered records are written to at most; 0 leaves that to Spark.
    input_files: int = 0

    @classmethod
    def read(cls, text: str) -> Config:
        """From settings by this class's names, or nested ones by the names in ``SETTINGS``; others are ignored."""
        found, out = nested(text), {}
        for name in cls.__dataclass_fields__:
            value = found.get(name)
            for path in SETTINGS.get(name, ()):
                at = found
                for part in path.split("."):
                    at = at.get(part) if isinstance(at, dict) else None
                value = at if value is None else value
            if value is not None:
                out[name] = tuple(value) if isinstance(value, (list, dict)) else str(value) if cls.__dataclass_fields__[name].type == "str" else value
        return cls(**out)

    def table_name(self, checklist: str | None = None) -> str:
        return "_".join(x for x in (self.table, self.mode, checklist, self.timestamp) if x)

    def directory(self) -> str:
        return f"{self.target}_{self.mode}_{self.timestamp}"


@dataclass
class Pointers:
    """Names of the live tables: ``points|tiles|checklist,table|...``."""

    points: str | None = None
    tiles: str | None = None
    checklists: dict[str, str] = field(default_factory=dict)

    def encode(self) -> str:
        return "|".join([self.points or "", self.tiles or "", *(f"{k},{v}" for k, v in self.checklists.items())])

    @classmethod
    def decode(cls, text: str | None) -> Pointers:
        if not text:
            return cls()
        parts = text.split("|")
        if len(parts) < 2:
            raise ValueError("pointers need points and tiles")
        pairs = [p.split(",", 1) for p in parts[2:] if p]
        if any(len(p) != 2 for p in pairs):
            raise ValueError("a checklist needs a table")
        return cls(parts[0] or None, parts[1] or None, dict(pairs))

    def table_of(self, key: str) -> str | None:
        """The table with a key's tiles: that of its checklist, if it has one."""
        found = re.match(r"1:([^|]*)\|", key)
        return self.checklists.get(found[1]) if found and found[1] in self.checklists else self.tiles


def table_date(name: str | None) -> str | None:
    found = _STAMP.search(name or "")
    return datetime.strptime(found[1], "%Y%m%d_%H%M").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%MZ") if found else None


def table_date_column(name: Column) -> Column:
    stamp = F.regexp_extract(name, r"(\d{8}_\d{4})$", 1)
    return F.when(stamp != "", F.date_format(F.to_timestamp(stamp, "yyyyMMdd_HHmm"), "yyyy-MM-dd'T'HH:mm'Z'"))


def write_pointers(spark: SparkSession, path: str, new: Pointers) -> Pointers:
    """Merge with what the file ``path`` points to, and replace it.

    The new file is written beside the old one and renamed over it, so a reader finds one or the other, never none.
    """
    old = read_pointers(spark, path)
    merged = Pointers(new.points or old.points, new.tiles or old.tiles, old.checklists | new.checklists)
    jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = beside.getFileSystem(settings).create(beside, True)
    out.write(bytearray(merged.encode().encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), settings).rename(beside, target, options)
    return merged


def read_pointers(spark: SparkSession, path: str) -> Pointers:
    try:
        rows = spark.read.text(path).collect()  # one line
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return Pointers()
    return Pointers.decode(rows[0][0] if rows else None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that ``spark.checkpoint.dir`` names; a temporary one where none is set and all runs in one process."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def watched(spark: SparkSession, path: str, seconds: float = 60.0, rounds: int | None = None) -> Iterator[Pointers]:
    """The pointers now, and again whenever they have changed; looks every so many seconds, ``rounds`` times if given."""
    seen = None
    while rounds is None or rounds > 0:
        now = read_pointers(spark, path)
        if now != seen:
            yield now
            seen = now
        rounds = None if rounds is None else rounds - 1
        if rounds != 0:
            time.sleep(seconds)


def retention(tables: DataFrame, built: str) -> DataFrame:
    """(name, action) by age: of the tables of one name but for the time the newest is kept, the one before it disabled, older ones deleted; never ``built``."""
    family = F.regexp_replace("name", r"\d{8}_\d{4}$", "")
    place = F.row_number().over(Window.partitionBy(family).orderBy(F.desc("name")))  # a listing of tables, a few rows
    action = F.when((F.col("place") == 1) | (F.lower("name") == built.lower()), "keep").when(F.col("place") == 2, "disable").otherwise("delete")
    return tables.select("name", place.alias("place")).select("name", action.alias("action"))


def laid_out(rows: DataFrame, key: Column, modulus: int, first: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``salt`` and ``rowKey``, dealt in ranges of (``first``, salt, key) and sorted so within each.

    Ranges are balanced by a sample, so a salt with many rows, or few salts, still give as many tasks as there are partitions.
    """
    order = (*first, "salt", "rowKey")
    return rows.withColumns({"salt": salt(key, modulus).cast("int"), "rowKey": salted(key, modulus)}).repartitionByRange(*order).sortWithinPartitions(*order)


def write_tiles(tiles: DataFrame, path: str, modulus: int, epsg: str, kind: str, records_per_file: int = 10_000_000) -> None:
    """Tiles under ``epsg=/kind=/z=/salt=``; a read of one tile touches one folder, and each file is in row-key order.

    The order begins with the folders' columns, as the writer wants it, so it does not sort again.
    """
    rows = laid_out(tiles, tile_key(F.col("mapKey"), F.col("z"), F.col("tileX"), F.col("tileY")), modulus, ("z",))
    folder = f"{path}/epsg={epsg.replace(':', '_')}/kind={kind}"
    rows.write.mode("append").option("maxRecordsPerFile", records_per_file).option("compression", "snappy").partitionBy("z", "salt").parquet(folder)


def write_points(points: DataFrame, path: str, modulus: int, records_per_file: int = 10_000_000) -> None:
    rows = laid_out(points, F.col("mapKey"), modulus)
    rows.write.mode("append").option("maxRecordsPerFile", records_per_file).option("compression", "snappy").partitionBy("salt").parquet(path)


#: Columns of the layouts, the folders' ones last; a layout without any tile is read too.
TILE_SCHEMA = "mapKey string, tileX int, tileY int, pixelX int, pixelY int, bor string, year int, cnt long, rowKey string, epsg string, kind string, z int, salt int"
POINT_SCHEMA = "mapKey string, lat double, lng double, borYear int, occCount long, rowKey string, salt int"


def kind_of(key: str) -> str:
    """The part of a projection's tiles that a key is in: its checklist's, or that of all keys without one."""
    found = re.match(r"1:([^|]*)\|", key)
    return found[1] if found else "nonTaxon"


def stored_tile(spark: SparkSession, path: str, epsg: str, key: str, z: int, x: int, y: int, modulus: int) -> DataFrame:
    """Rows of one tile: a filter on the folders' columns, which prunes to one folder, and on the row key."""
    number, place = row_key(f"{key}:{z}:{x}:{y}", modulus)
    folder = (F.col("epsg") == epsg.replace(":", "_")) & (F.col("kind") == kind_of(key)) & (F.col("z") == z) & (F.col("salt") == number)
    return spark.read.schema(TILE_SCHEMA).parquet(path).where(folder & (F.col("rowKey") == place))


def stored_points(spark: SparkSession, path: str, key: str, modulus: int) -> DataFrame:
    number, place = row_key(key, modulus)
    return spark.read.schema(POINT_SCHEMA).parquet(path).where((F.col("salt") == number) & (F.col("rowKey") == place))
