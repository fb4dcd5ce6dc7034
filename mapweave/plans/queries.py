"""The registered queries: each beside the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import keys as K
from mapweave.functions import params, styles
from mapweave.functions.projection import SCHEMAS, inverse_xy, pixel, plottable
from mapweave.functions.tiling import buffered_addresses, local_xy, tile_xy
from mapweave.operators import adhoc, binning, extent, mvt, pixels, regression, tiles
from mapweave.plans import build
from mapweave.plans import oracle as O
from mapweave.sources import store
from mapweave.sources.occurrence import EVENTS_SQL, events, fixture, mapped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
THRESHOLD, ZOOM, SIZE, BUFFER, SALT = 1000, 4, 512, 64, 28
ALL_KEYS = f"list_concat({O.NON_TAXON}, {O.TAXON})"
#: A country with records on the tile of the density queries.
COUNTRY = "4:NATION_3"


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _everything(spark, sf, keys=None):
    return pixels.keyed(mapped(spark, sf), F.array(F.lit(K.ALL_KEY)) if keys is None else keys)


def _pyramid(spark, sf, epsg="EPSG:3857", zoom=ZOOM, lowest=0, keys=None):
    return pixels.pyramid(pixels.pixels(_everything(spark, sf, keys), epsg, SIZE, zoom), zoom, lowest)


def _tiles(spark, sf, epsg="EPSG:3857", zoom=ZOOM, lowest=0, keys=None):
    return tiles.tiles(_pyramid(spark, sf, epsg, zoom, lowest, keys), epsg, SIZE, BUFFER)


def _tiles_sql(epsg="EPSG:3857", zoom=ZOOM, lowest=0, keys="['0:0']"):
    return O.pixels(epsg, zoom, keys), O.pyramid(zoom, lowest), O.tiles(epsg, "pyramid", SIZE, BUFFER)


_VIEW = "datasetKey, publishingOrgKey, publishingCountry, countryCode, basisOfRecord, decimalLatitude, decimalLongitude, year"
register("base_filter", lambda s, d: mapped(s, d).select(*_VIEW.split(", ")), O.with_() + f"select {_VIEW} from occ")
register("encode_bor_year", lambda s, d: fixture(s, d).select("basisOfRecord", "year", K.encode_bor_year(F.col("basisOfRecord"), F.col("year")).alias("borYear")), O.with_() + f"select basisOfRecord, year, {O.BOR_YEAR} as borYear from allocc")
register(
    "decode_bor_year",
    lambda s, d: fixture(s, d).select(K.encode_bor_year(F.col("basisOfRecord"), F.col("year")).alias("borYear")).groupBy("borYear").agg(F.count("*").alias("n")).select("borYear", "n", K.decode_year(F.col("borYear")).alias("year"), K.decode_bor(F.col("borYear")).alias("bor")),
    O.with_() + f"select {O.BOR_YEAR} as borYear, count(*) as n, coalesce(year, 0) as year, basisOfRecord as bor from allocc group by all",
)
for _name, _keys, _sql in (("map_keys_all", None, ALL_KEYS), ("map_keys_taxon", lambda: K.taxon_keys(F.col("classifications")), O.TAXON), ("map_keys_non_taxon", K.non_taxon_keys, O.NON_TAXON)):
    register(_name, lambda s, d, keys=_keys: pixels.key_counts(pixels.keyed(mapped(s, d), keys() if keys else None)), O.with_() + f"select mapKey, count(*) as n from (select unnest({_sql}) as mapKey from occ) group by all")
register("checklist_keys", lambda s, d: pixels.key_counts(pixels.keyed(mapped(s, d), K.checklist_keys(F.col("classifications"), "chk-b"))), O.with_() + "select mapKey, count(*) as n from (select unnest(list_distinct(list_transform(list_filter(classifications['chk-b'], lambda t: t is not null), lambda t: '1:chk-b|'||t))) as mapKey from occ) group by all")
register("key_checklist", lambda s, d: pixels.key_counts(pixels.keyed(mapped(s, d))).select("mapKey", K.checklist_of(F.col("mapKey")).alias("checklist")), O.with_() + f"select distinct mapKey, case when mapKey like '1:%' then split_part(substr(mapKey, 3), '|', 1) end as checklist from (select unnest({ALL_KEYS}) as mapKey from occ)")

_KEYED = f"keyed as (select decimalLatitude, decimalLongitude, basisOfRecord, year, unnest({ALL_KEYS}) as mapKey from occ)"
_LARGE = f"large as (select mapKey, count(*) as n from keyed group by all having count(*) >= {THRESHOLD})"


def _split(allow: bool):
    def query(spark, sf):
        rows = pixels.keyed(mapped(spark, sf))
        return pixels.key_counts(pixels.with_keys(rows, pixels.large_keys(rows, THRESHOLD), allow))

    return query


register("large_keys", lambda s, d: pixels.large_keys(pixels.keyed(mapped(s, d)), THRESHOLD), O.with_(_KEYED, _LARGE) + "select * from large")
register("keys_semi", _split(True), O.with_(_KEYED, _LARGE) + "select mapKey, count(*) as n from keyed where mapKey in (select mapKey from large) group by all")
register("keys_anti", _split(False), O.with_(_KEYED, _LARGE) + "select mapKey, count(*) as n from keyed where mapKey not in (select mapKey from large) group by all")
register("dictionary_encode", lambda s, d: pixels.dictionary(pixels.large_keys(pixels.keyed(mapped(s, d)), THRESHOLD)), O.with_(_KEYED, _LARGE) + "select mapKey, cast(row_number() over (order by mapKey) - 1 as int) as code from large")

for _epsg in SCHEMAS:
    _x, _y = O.xy(_epsg, SIZE, 16)
    register(
        f"pixel_{_epsg[5:]}",
        lambda s, d, e=_epsg: mapped(s, d).select(pixel(e, SIZE, 16, F.col("decimalLatitude"), F.col("decimalLongitude")).alias("xy")).where(F.col("xy").isNotNull()).groupBy("xy.x", "xy.y").agg(F.count("*").alias("n")),
        O.with_() + f"select cast(trunc({_x}) as int) as x, cast(trunc({_y}) as int) as y, count(*) as n from occ where {O.plottable(_epsg)} group by all",
    )
register("plottable", lambda s, d: mapped(s, d).agg(*(F.count_if(plottable(e, F.col("decimalLatitude"), F.col("decimalLongitude"))).alias(f"n{e[5:]}") for e in SCHEMAS)), O.with_() + "select " + ", ".join(f"count(*) filter ({O.plottable(e)}) as n{e[5:]}" for e in SCHEMAS) + " from occ")
register("pixel_counts", lambda s, d: pixels.pixels(_everything(s, d, K.non_taxon_keys()), "EPSG:3857", SIZE, 16), O.with_(O.pixels("EPSG:3857", 16, O.NON_TAXON)) + "select * from pixels")
register("zoom_pyramid", lambda s, d: _pyramid(s, d, "EPSG:4326", 16), O.with_(O.pixels("EPSG:4326", 16), O.pyramid(16, 0)) + "select * from pyramid")
register("zoom_pyramid_keys", lambda s, d: _pyramid(s, d, "EPSG:3857", 6, 0, K.non_taxon_keys()), O.with_(O.pixels("EPSG:3857", 6, O.NON_TAXON), O.pyramid(6, 0)) + "select * from pyramid")


def _addressed(spark, sf):
    rows = _pyramid(spark, sf, "EPSG:4326")
    tx, ty = tile_xy("EPSG:4326", F.col("z"), F.col("x"), F.col("y"), SIZE)
    return rows.select("z", "x", "y", tx.alias("tileX"), ty.alias("tileY")).distinct()


def _local(spark, sf):
    rows = _addressed(spark, sf)
    px, py = local_xy("EPSG:4326", F.col("z"), F.col("x"), F.col("y"), F.col("tileX"), F.col("tileY"), SIZE, BUFFER)
    return rows.select("z", "tileX", "tileY", px.alias("pixelX"), py.alias("pixelY"))


register("tile_address", _addressed, O.with_(O.pixels("EPSG:4326", ZOOM), O.pyramid(ZOOM, 0)) + f"select distinct z, x, y, x // {SIZE} as tileX, y // {SIZE} as tileY from pyramid")
register("tile_local", _local, O.with_(O.pixels("EPSG:4326", ZOOM), O.pyramid(ZOOM, 0)) + f"select distinct z, x // {SIZE} as tileX, y // {SIZE} as tileY, x % {SIZE} as pixelX, y % {SIZE} as pixelY from pyramid")
for _epsg in SCHEMAS:
    register(f"tiles_{_epsg[5:]}", lambda s, d, e=_epsg: _tiles(s, d, e), O.with_(*_tiles_sql(_epsg)) + "select mapKey, z, tileX, tileY, pixelX, pixelY, bor, year, cnt from tiles")
register(
    "tile_address_buffered",
    lambda s, d: _pyramid(s, d).select("z", "x", "y").distinct().select("z", "x", "y", F.inline(buffered_addresses("EPSG:3857", F.col("z"), F.col("x"), F.col("y"), SIZE, BUFFER))),
    O.with_(O.pixels("EPSG:3857", ZOOM), O.pyramid(ZOOM, 0), O.tiles("EPSG:3857", "(select distinct '' as mapKey, z, x, y, x * 100000 as borYear0, 0 as borYear, y as occCount from pyramid)", SIZE, BUFFER, "t")) + "select z, x, y, tileX, tileY, pixelX, pixelY from (select distinct z, tileX, tileY, pixelX, pixelY, ((tileX * 512 + pixelX) % (512 << z) + (512 << z)) % (512 << z) as x, tileY * 512 + pixelY as y from t)",
)

register("point_map", lambda s, d: pixels.points(pixels.keyed(mapped(s, d), K.non_taxon_keys())), O.with_() + f"select mapKey, lat, lng, borYear, count(*) as occCount from (select unnest({O.NON_TAXON}) as mapKey, decimalLatitude as lat, decimalLongitude as lng, {O.BOR_YEAR} as borYear from occ) group by all")
_TILE = "z = 2 and tileX = 2 and tileY = 1"
_AT = "mapKey, z, tileX, tileY, pixelX, pixelY"


#: A tile's buffer as a share, and two pixels more: records beyond it cannot be on the tile.
_NEAR = (BUFFER + 2) / SIZE


def _tile_rows(spark, sf, keys=None, epsg="EPSG:3857", z=2, x=2, y=1):
    """Rows around one tile: records near it only, counted at its own zoom."""
    near = mapped(spark, sf).where(adhoc.near_tile(epsg, z, x, y, _NEAR))
    rows = pixels.keyed(near, F.array(F.lit(K.ALL_KEY)) if keys is None else keys)
    return tiles.tiles(pixels.pixels(rows, epsg, SIZE, z).withColumn("z", F.lit(z)), epsg, SIZE, BUFFER)


def _density(spark, sf, **options):
    return build.density_tile(_tile_rows(spark, sf), None, K.ALL_KEY, "EPSG:3857", 2, 2, 1, **options)


register("density_tile", _density, O.with_(*_tiles_sql(lowest=2)) + f"select {_AT}, sum(cnt) as total from tiles where {_TILE} group by all")
register("density_tile_verbose", lambda s, d: _density(s, d, verbose=True), O.with_(*_tiles_sql(lowest=2)) + f"select {_AT}, year, cnt, sum(cnt) over (partition by {_AT}) as total from (select {_AT}, year, sum(cnt) as cnt from tiles where {_TILE} group by all)")
register("density_bor_year", lambda s, d: _density(s, d, years=(1996, 1998), bases=["observation", "HUMAN_OBSERVATION"]), O.with_(*_tiles_sql(lowest=2)) + f"select {_AT}, sum(cnt) as total from tiles where {_TILE} and year between 1996 and 1998 and bor in ('OBSERVATION', 'HUMAN_OBSERVATION') group by all")
register("density_open_range", lambda s, d: _density(s, d, years=params.years(",1996")), O.with_(*_tiles_sql(lowest=2)) + f"select {_AT}, sum(cnt) as total from tiles where {_TILE} and year <= 1996 group by all")
register("density_square", lambda s, d: _density(s, d, bin="square"), O.with_(*_tiles_sql(lowest=2)) + f"select z, tileX, tileY, pixelX * 8 // 16 as cellX, pixelY * 8 // 16 as cellY, sum(cnt) as total from tiles where {_TILE} and pixelX between 0 and 511 and pixelY between 0 and 511 group by all")


def _points_density(spark, sf):
    listed = pixels.points(_everything(spark, sf))
    return tiles.flattened(tiles.point_tile(listed, K.ALL_KEY, "EPSG:3857", 2, 2, 1, SIZE, BUFFER))


_PX, _PY = O.xy("EPSG:3857", SIZE, 2)
register("density_points", _points_density, O.with_() + f"select '0:0' as mapKey, 2 as z, 2 as tileX, 1 as tileY, cast(floor(gx - 1024) as int) as pixelX, cast(floor(gy - 512) as int) as pixelY, count(*) as total from (select {_PX} as gx, {_PY} as gy from occ where {O.plottable('EPSG:3857')}) where gx between 1024 - {BUFFER} and 1536 + {BUFFER} and gy between 512 - {BUFFER} and 1024 + {BUFFER} group by all")
_MASK_KEYS = f"['0:0', '{COUNTRY}']"


def _mask(spark, sf):
    only = F.filter(K.non_taxon_keys(), lambda k: k.isin(K.ALL_KEY, COUNTRY))
    return build.density_tile(_tile_rows(spark, sf, only), None, K.ALL_KEY, "EPSG:3857", 2, 2, 1, mask=COUNTRY)


register("country_mask", _mask, O.with_(*_tiles_sql(lowest=2, keys=f"list_filter({O.NON_TAXON}, lambda k: k in ('0:0', '{COUNTRY}'))")) + f"select {_AT}, sum(cnt) as total from tiles t where {_TILE} and mapKey = '0:0' and (pixelX, pixelY) in (select (pixelX, pixelY) from tiles where {_TILE} and mapKey = '{COUNTRY}') group by all")


def _fallback(spark, sf):
    """Large keys from the pyramid, the others from their point lists."""
    rows = pixels.keyed(mapped(spark, sf), K.non_taxon_keys())
    large = pixels.large_keys(rows, THRESHOLD)
    prepared = tiles.tiles(pixels.pyramid(pixels.pixels(pixels.with_keys(rows, large, True), "EPSG:4326", SIZE, 3), 3, 1).where("z = 1"), "EPSG:4326", SIZE, BUFFER)
    listed = tiles.from_points(pixels.points(pixels.with_keys(rows, large, False)), "EPSG:4326", 1, SIZE, BUFFER)
    return tiles.flattened(tiles.tiles_or_points(prepared, listed))


register("tile_or_points", _fallback, O.with_(*(O.pixels("EPSG:4326", 1, O.NON_TAXON), O.pyramid(1, 1), O.tiles("EPSG:4326", "pyramid", SIZE, BUFFER))) + f"select {_AT}, sum(cnt) as total from tiles group by all")
register("flatten_layers", lambda s, d: tiles.flattened(_tiles(s, d, lowest=ZOOM)), O.with_(*_tiles_sql(lowest=ZOOM)) + f"select {_AT}, sum(cnt) as total from tiles group by all")
register("square_bin", lambda s, d: binning.square_bins(_tiles(s, d, lowest=2)), O.with_(*_tiles_sql(lowest=2)) + "select z, tileX, tileY, pixelX * 8 // 16 as cellX, pixelY * 8 // 16 as cellY, sum(cnt) as total from tiles where pixelX between 0 and 511 and pixelY between 0 and 511 group by all")

_R, _H = binning.hex_size()
_HEX = f"""cells as (select *, case when dq > dr and dq > ds then -rr - rs else rq end::bigint as q, case when dq > dr and dq > ds then rr when dr > ds then -rq - rs else rr end::bigint as r from (
  select *, abs(rq - qf) as dq, abs(rr - rf) as dr, abs(rs - sf) as ds from (select *, floor(qf + 0.5::double) as rq, floor(rf + 0.5::double) as rr, floor(sf + 0.5::double) as rs from (
  select *, -qf - rf as sf from (select *, yy / {_H!r}::double - qf / 2 as rf from (select *, xx / {1.5 * _R!r}::double as qf from (select *, tileX * 4096.0::double + pixelX * 8.0::double as xx, tileY * 4096.0::double + pixelY * 8.0::double as yy from tiles)))))))"""
_ACROSS, _DOWN = binning.HEX_PER_TILE + binning.GRID_MARGIN, math.ceil(4096 / _H) + binning.GRID_MARGIN
_HEX += f""", hexed as (select * exclude (gx, gy, hexcol) from (select *, floor((gx - {_R!r}::double) / {1.5 * _R!r}::double + 0.5::double)::bigint as hexcol from (
  select *, q * {1.5 * _R!r}::double - tileX * 4096.0::double + (tileX * 4096.0::double) % {3 * _R!r}::double + {2.5 * _R!r}::double as gx,
    (r + q / 2::double) * {_H!r}::double - tileY * 4096.0::double + (tileY * 4096.0::double) % {_H!r}::double + {2 * _H!r}::double as gy from cells))
  where hexcol between 0 and {_ACROSS - 1} and floor((gy - {_H / 2!r}::double * (1 + ((hexcol % 2) + 2) % 2)) / {_H!r}::double + 0.5::double) between 0 and {_DOWN - 1})"""


def _ring_sql(corners: list[tuple[str, str]]) -> str:
    """Corners as the text of a ring that turns to the right, which all rings here do."""
    return " || ',' || ".join(f"floor({x} + 0.5::double)::int || ' ' || floor({y} + 0.5::double)::int" for x, y in corners)


_HEX_RING = _ring_sql([(f"(q * {1.5 * _R!r}::double - tileX * 4096.0::double + {_R * math.cos(math.pi / 3 * k)!r}::double)", f"((r + q / 2::double) * {_H!r}::double - tileY * 4096.0::double + {_R * math.sin(math.pi / 3 * k)!r}::double)") for k in range(6)])
_SQUARE_RING = _ring_sql([(f"(cellX * 16 + {i})", f"(cellY * 16 + {j})") for i, j in ((0, 0), (16, 0), (16, 16), (0, 16))])


def _polygons(rows, ring, size=binning.EXTENT):
    return mvt.decoded_polygons(mvt.encoded_polygons(rows.withColumn("ring", ring), size)).drop("mapKey")


register("hex_bin", lambda s, d: binning.hex_bins(_tiles(s, d, lowest=2)), O.with_(*_tiles_sql(lowest=2), _HEX) + "select z, tileX, tileY, q, r, sum(cnt) as total from hexed group by all")
register("hex_bin_years", lambda s, d: binning.hex_bins(_tiles(s, d, lowest=2, zoom=3), yearly=True), O.with_(*_tiles_sql(zoom=3, lowest=2), _HEX) + "select z, tileX, tileY, q, r, year, sum(cnt) as total from hexed group by all")

register("hex_tile_roundtrip", lambda s, d: _polygons(_density(s, d, bin="hex"), binning.hex_ring()), O.with_(*_tiles_sql(lowest=2), _HEX) + f"select z, tileX, tileY, {_HEX_RING} as ring, total from (select z, tileX, tileY, q, r, sum(cnt) as total from hexed where {_TILE} group by all)")
register("square_tile_roundtrip", lambda s, d: _polygons(_density(s, d, bin="square"), binning.square_ring()), O.with_(*_tiles_sql(lowest=2)) + f"select z, tileX, tileY, {_SQUARE_RING} as ring, total from (select z, tileX, tileY, pixelX * 8 // 16 as cellX, pixelY * 8 // 16 as cellY, sum(cnt) as total from tiles where {_TILE} and pixelX between 0 and 511 and pixelY between 0 and 511 group by all)")

_SPREAD = """vals as (select distinct cast(floor((-180 + 180 * tileX + 180 * pixelX / 512.0::double) * 512 + 0.5::double) as bigint) as v from tiles where pixelX between 0 and 511 and pixelY between 0 and 511),
  gaps as (select v, row_number() over (order by v) as pos, coalesce(lead(v) over (order by v), min(v) over ()) as nxt, coalesce(lead(v) over (order by v), min(v) over () + 184320) - v as gap from vals),
  spread as (select nxt as lft, v as rgt from gaps order by gap desc, pos desc limit 1)"""
register("capabilities", lambda s, d: extent.capabilities(_tiles(s, d, "EPSG:4326", 0)), O.with_(*_tiles_sql("EPSG:4326", 0), _SPREAD) + """select cast(floor(min(90 - 180 * pixelY / 512.0::double)) as int) as minLat, cast(floor(any_value(lft) / 512.0::double) as int) as minLng, cast(ceil(max(90 - 180 * pixelY / 512.0::double)) as int) as maxLat,
  cast(ceil((any_value(rgt) + case when any_value(lft) > any_value(rgt) then 184320 else 0 end) / 512.0::double) as int) as maxLng, min(case when year > 0 then year end) as minYear, max(case when year > 0 then year end) as maxYear, sum(cnt) as total
  from tiles, spread where pixelX between 0 and 511 and pixelY between 0 and 511""")
register("first_interface_extent", lambda s, d: extent.first_interface(extent.capabilities(_tiles(s, d, "EPSG:4326", 0))), O.with_(*_tiles_sql("EPSG:4326", 0), _SPREAD) + """select sum(cnt) as count, floor(min(90 - 180 * pixelY / 512.0::double)) as minimumLatitude, floor(any_value(lft) / 512.0::double) as minimumLongitude, ceil(max(90 - 180 * pixelY / 512.0::double)) as maximumLatitude,
  ceil((any_value(rgt) + case when any_value(lft) > any_value(rgt) then 184320 else 0 end) / 512.0::double) as maximumLongitude from tiles, spread where pixelX between 0 and 511 and pixelY between 0 and 511""")
register("square_cell_keys", lambda s, d: binning.square_bins(_tiles(s, d, lowest=2)).groupBy(binning.cell_key(F.col("cellX"), F.col("cellY")).alias("cell")).agg(F.sum("total").alias("total")), O.with_(*_tiles_sql(lowest=2)) + "select (pixelX * 8 // 16)::bigint << 32 | (pixelY * 8 // 16) as cell, sum(cnt) as total from tiles where pixelX between 0 and 511 and pixelY between 0 and 511 group by all")
register("years_by_basis", lambda s, d: tiles.years_by_basis(_tiles(s, d, lowest=2)).select("bor", F.explode("years").alias("year", "cnt")).groupBy("bor", "year").agg(F.sum("cnt").alias("cnt")), O.with_(*_tiles_sql(lowest=2)) + "select bor, year, sum(cnt) as cnt from tiles group by all")
register("longitude_spread", lambda s, d: extent.centred_spread(mapped(s, d).select(F.floor(F.col("decimalLongitude") * 512 + 0.5).alias("v")), 360 * 512), O.with_() + """, vals as (select distinct cast(floor(decimalLongitude * 512 + 0.5::double) as bigint) as v from occ),
  gaps as (select v, row_number() over (order by v) as pos, coalesce(lead(v) over (order by v), min(v) over ()) as nxt, coalesce(lead(v) over (order by v), min(v) over () + 184320) - v as gap from vals)
  select nxt as "left", v as "right" from gaps order by gap desc, pos desc limit 1""".replace(", vals", ", vals", 1))

_BITS = 6
_CELL = f"least(cast(floor((decimalLongitude + 180) / (360.0::double / {1 << _BITS})) as int), {(1 << _BITS) - 1}) as cellX, least(cast(floor((decimalLatitude + 90) / (180.0::double / {1 << _BITS})) as int), {(1 << _BITS) - 1}) as cellY"
register("adhoc_bounds", lambda s, d: adhoc.bounds(mapped(s, d), _BITS), O.with_() + f"select cellX, cellY, count(*) as total, -180 + cellX * (360.0::double / 64) as west, -90 + cellY * (180.0::double / 64) as south, -180 + (cellX + 1) * (360.0::double / 64) as east, -90 + (cellY + 1) * (180.0::double / 64) as north from (select {_CELL} from occ) group by all")
_ROUNDED = lambda df: df.select("cellX", "cellY", "total", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))
register("adhoc_centroid", lambda s, d: _ROUNDED(adhoc.centroids(mapped(s, d), _BITS)), O.with_() + f"select cellX, cellY, count(*) as total, round(avg(decimalLatitude), 6) as lat, round(avg(decimalLongitude), 6) as lng from (select {_CELL}, decimalLatitude, decimalLongitude from occ) group by all")
register("adhoc_predicate", lambda s, d: adhoc.bounds(mapped(s, d).where((F.col("countryCode") == "NATION_3") & (F.col("year") >= 1996)), _BITS).select("cellX", "cellY", "total"), O.with_() + f"select cellX, cellY, count(*) as total from (select {_CELL} from occ where countryCode = 'NATION_3' and year >= 1996) group by all")
_BOXES = adhoc.request_boxes("EPSG:3575", 1, 0, 0)
_INSIDE = " or ".join(f"(decimalLatitude between {b!r} and {n!r} and " + (f"(decimalLongitude >= {w!r} or decimalLongitude <= {e!r})" if w > e else f"decimalLongitude between {w!r} and {e!r}") + ")" for w, b, e, n in _BOXES)
register("pole_union", lambda s, d: adhoc.tile(mapped(s, d), "EPSG:3575", 1, 0, 0, _BITS).select("cellX", "cellY", "total"), O.with_() + f"select cellX, cellY, count(*) as total from (select {_CELL} from occ where {_INSIDE}) group by all")
register("adhoc_largest", lambda s, d: adhoc.largest(adhoc.bounds(mapped(s, d), _BITS).select("cellX", "cellY", "total"), 100), O.with_() + f"select * from (select cellX, cellY, count(*) as total from (select {_CELL} from occ) group by all) order by total desc, cellX, cellY limit 100")


def _box_px(epsg, z, x, y, lat, lng):
    """Pixels of a corner as seen from one tile that does not touch the date line."""
    px, py = (c.replace("decimalLatitude", lat).replace("decimalLongitude", lng) for c in O.xy(epsg, SIZE, z))
    return f"floor({px} - {x * SIZE})::int", f"floor({py} - {y * SIZE})::int"


def _adhoc_sql(source: str, inside: str) -> str:
    """Rectangles around the records of each cell, points where they have no area."""
    (x0, y0), (x1, y1) = _box_px("EPSG:4326", 2, 5, 1, "maxLat", "minLng"), _box_px("EPSG:4326", 2, 5, 1, "minLat", "maxLng")
    centre = "floor(x0 + (x1 - x0) / 2::double + 0.5::double)::int || ' ' || floor(y0 + (y1 - y0) / 2::double + 0.5::double)::int"
    return f"""select 2 as z, 5 as tileX, 1 as tileY, case when x0 = x1 or y0 = y1 then {centre} else {_ring_sql([("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")])} end as ring, total from (
      select {x0} as x0, {y0} as y0, {x1} as x1, {y1} as y1, total from (select cellX, cellY, count(*) as total, min(lat) as minLat, max(lat) as maxLat, min(lng) as minLng, max(lng) as maxLng
        from (select {_CELL}, decimalLatitude as lat, decimalLongitude as lng from {source} where {inside}) group by cellX, cellY))"""


_W, _S, _E, _N = adhoc.request_boxes("EPSG:4326", 2, 5, 1)[0]
_INBOX = f"decimalLatitude between {_S!r} and {_N!r} and decimalLongitude between {_W!r} and {_E!r}"
_adhoc_tile = lambda rows: mvt.decoded_polygons(adhoc.encoded(adhoc.tile(rows, "EPSG:4326", 2, 5, 1, _BITS), "EPSG:4326", 2, 5, 1)).drop("mapKey")
register("adhoc_tile_roundtrip", lambda s, d: _adhoc_tile(mapped(s, d)), O.with_() + _adhoc_sql("occ", _INBOX))
register("event_tile_roundtrip", lambda s, d: _adhoc_tile(events(s, d)), f"with evt as ({EVENTS_SQL}) " + _adhoc_sql("evt", _INBOX))
register("event_density", lambda s, d: adhoc.bounds(events(s, d), _BITS).select("cellX", "cellY", "total"), f"with evt as ({EVENTS_SQL}) select cellX, cellY, count(*) as total from (select {_CELL} from evt) group by all")
_GEO = 3
_LNG, _LAT = f"least(floor((decimalLongitude + 180) / (360.0::double / 256)), 255)::bigint", f"least(floor((decimalLatitude + 90) / (180.0::double / 128)), 127)::bigint"
_DIGIT = lambda bits: f"substr('{adhoc.GEOHASH}', (" + " + ".join(f"((({v} >> {n}) & 1) << {4 - k})" for k, (v, n) in enumerate(bits)) + ")::int + 1, 1)"
_HASHED = " || ".join(_DIGIT([("gx", 7 - k // 2) if k % 2 == 0 else ("gy", 6 - k // 2) for k in range(5 * d, 5 * d + 5)]) for d in range(_GEO))
register("geohash_cells", lambda s, d: adhoc.geohash_cells(mapped(s, d), _GEO).select("geohash", "total", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")), O.with_() + f"select {_HASHED} as geohash, count(*) as total, round(avg(decimalLatitude), 6) as lat, round(avg(decimalLongitude), 6) as lng from (select {_LNG} as gx, {_LAT} as gy, decimalLatitude, decimalLongitude from occ) group by all")


_SUIT = "('" + "','".join(regression.SUITABLE) + "')"
register("year_facet_topk", lambda s, d: regression.year_facet(mapped(s, d), 5), O.with_() + f"select year, count(*) as n from occ where basisOfRecord in {_SUIT} and year > 0 group by all order by n desc, year limit 5")


def _fit(out: DataFrame) -> DataFrame:
    return out.select(*(c for c in out.columns if c not in ("significance",)))


def _search_trend(spark, sf):
    rows = mapped(spark, sf).where(F.col("basisOfRecord").isin(*regression.SUITABLE) & (F.col("year") > 0))
    by_year = lambda df: df.groupBy("year").agg(F.count("*").alias("n"))
    return regression.trends(by_year(rows.where(F.col("countryCode") == "NATION_3")), by_year(rows), [])


def _hex_counts(spark, sf, taxon):
    rows = tiles.filtered(_tile_rows(spark, sf, F.filter(K.map_keys(), lambda k: k.isin(K.ALL_KEY, taxon))), bases=list(regression.SUITABLE)).where(F.col("year") > 0)
    rows = rows.where((F.col("z") == 2) & (F.col("tileX") == 2) & (F.col("tileY") == 1))
    one = lambda key: binning.hex_bins(rows.where(F.col("mapKey") == key), yearly=True).select("q", "r", "year", F.col("total").alias("n"))
    return one(taxon), one(K.ALL_KEY)


def _hex_trend(spark, sf):
    return regression.trends(*_hex_counts(spark, sf, COUNTRY), ["q", "r"])


def _fit_sql(by: str, source: str) -> str:
    group = f"group by {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""select {lead}n, round(slope, 9) as slope, round(intercept, 9) as intercept, round(sse, 9) as sse, round(mse, 9) as mse, round(sqrt(mse / sxx), 9) as slopeStdErr, round(sqrt(mse * (1.0::double / n + mean * mean / sxx)), 9) as interceptStdErr from (
      select *, case when n > 2 then sse / (n - 2) end as mse from (select *, case when sxx is not null then greatest(0.0::double, syy - sxy * sxy / sxx) end as sse from (
      select {lead}regr_count(y, x) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, nullif(regr_sxx(y, x), 0) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, avg(x) as mean from {source} {group})))"""


register("regression_adhoc", lambda s, d: _fit(_search_trend(s, d)), O.with_(f"pts as (select year::double as x, count(*) filter (countryCode = 'NATION_3') / count(*)::double as y from occ where basisOfRecord in {_SUIT} and year > 0 group by year)") + _fit_sql("", "pts"))
_RKEYS = f"list_filter({ALL_KEYS}, lambda k: k in ('0:0', '{COUNTRY}'))"
register("regression_hex", lambda s, d: _fit(_hex_trend(s, d)), O.with_(*_tiles_sql(lowest=2, keys=_RKEYS), _HEX, f"hc as (select mapKey, q, r, year, sum(cnt) as n from hexed where {_TILE} and year > 0 and bor in {_SUIT} group by all)", f"enough as (select q, r from hc where mapKey = '{COUNTRY}' group by all having count(distinct year) >= 2)", f"pts as (select g.q, g.r, g.year::double as x, coalesce(s.n, 0) / g.n::double as y from hc g left join hc s on s.mapKey = '{COUNTRY}' and s.q = g.q and s.r = g.r and s.year = g.year where g.mapKey = '0:0' and (g.q, g.r) in (select (q, r) from enough))") + _fit_sql("q, r", "pts"))
_T, _ANGLE = "(abs(slope) / slopeStdErr)", "atan(abs(slope) / slopeStdErr / sqrt(free))"
_COS = f"cos({_ANGLE})"
#: Student's t has closed forms for whole degrees of freedom: sums of powers of the cosine, after an angle where they are odd.
_SIGNIFICANCE = f"""case when n < 3 or slopeStdErr is null then null when slopeStdErr = 0 then case when slope <> 0 then 0.0::double end when free % 2 = 1 then
    1 - 2 / pi() * ({_ANGLE} + sin({_ANGLE}) * list_sum(list_transform(range(1, (free - 1) // 2 + 1), lambda k: pow({_COS}, 2 * k - 1) * list_product(list_concat([1.0::double], list_transform(range(1, k), lambda j: 2.0::double * j / (2 * j + 1)))))))
  else 1 - sin({_ANGLE}) * list_sum(list_transform(range(0, free // 2), lambda k: pow({_COS}, 2 * k) * list_product(list_concat([1.0::double], list_transform(range(1, k + 1), lambda j: (2.0::double * j - 1) / (2 * j)))))) end"""
register("regression_significance", lambda s, d: _hex_trend(s, d).select("q", "r", "n", F.round("significance", 5).alias("significance")), ORACLES["regression_hex"].replace("select q, r, n, round(slope, 9)", f"select q, r, n, round(coalesce({_SIGNIFICANCE}, 'nan'::double), 5) as significance from (select *, n - 2 as free from (select q, r, n, round(slope, 9)", 1) + "))")

_HASH = "list_reduce(list_concat([0::bigint], list_transform(string_split(mapKey, ''), lambda c: ord(c)::bigint)), lambda h, c: (h * 31 + c) & 4294967295::bigint)"
_SALTS = f"salted as (select mapKey, (({_HASH}) & 268435455) % {SALT} as salt from (select distinct unnest({ALL_KEYS}) as mapKey from occ))"
_all_keys = lambda s, d: pixels.keyed(mapped(s, d)).select("mapKey").distinct()
register("salt_key", lambda s, d: _all_keys(s, d).select("mapKey", K.salted(F.col("mapKey"), SALT).alias("rowKey")), O.with_(_SALTS) + "select mapKey, lpad(salt::varchar, 2, '0') || ':' || mapKey as rowKey from salted")
register("salt_sorted_layout", lambda s, d: store.laid_out(_all_keys(s, d), F.col("mapKey"), SALT).groupBy("salt").agg(F.count("*").alias("n"), F.min("rowKey").alias("first"), F.max("rowKey").alias("last")), O.with_(_SALTS) + "select salt::int as salt, count(*) as n, min(lpad(salt::varchar, 2, '0') || ':' || mapKey) as first, max(lpad(salt::varchar, 2, '0') || ':' || mapKey) as last from salted group by all")
register("heat_children", lambda s, d: tiles.heat_children(_pyramid(s, d, "EPSG:3857", 3, 3)), O.with_(O.pixels("EPSG:3857", 3), O.pyramid(3, 3)) + "select mapKey, z - 1 as z, (x // 512) >> 1 as tileX, (y // 512) >> 1 as tileY, x // 512 as childX, y // 512 as childY, sum(occCount) as total from pyramid group by all")

_TILE_HASH = _HASH.replace("mapKey", "place")
register(
    "tile_row_key",
    lambda s, d: _tiles(s, d, lowest=2).select("mapKey", "z", "tileX", "tileY").distinct().withColumn("rowKey", K.salted(K.tile_key(F.col("mapKey"), F.col("z"), F.col("tileX"), F.col("tileY")), SALT)),
    O.with_(*_tiles_sql(lowest=2)) + f"select mapKey, z, tileX, tileY, lpad(((({_TILE_HASH}) & 268435455) % {SALT})::varchar, 2, '0') || ':' || place as rowKey from (select distinct mapKey, z, tileX, tileY, mapKey || ':' || z || ':' || tileX || ':' || tileY as place from tiles)",
)
register(
    "tiles_of_all_zooms",
    lambda s, d: _tiles(s, d, zoom=16, keys=K.non_taxon_keys()).groupBy("mapKey", "z").agg(F.count("*").alias("n"), F.sum("cnt").alias("total")),
    O.with_(*_tiles_sql(zoom=16, keys=O.NON_TAXON)) + "select mapKey, z, count(*) as n, sum(cnt) as total from tiles group by all",
)
_PX16, _PY16 = O.xy("EPSG:3857", SIZE, 16)
register(
    "inverse_3857",
    lambda s, d: _inverted(s, d),
    O.with_() + f"select x, y, round(degrees(atan((exp(u) - exp(-u)) / 2)), 6) as lat, round(x / {float(SIZE << 16)!r}::double * 360 - 180, 6) as lng from (select x, y, pi() * (1 - 2 * y / {float(SIZE << 16)!r}::double) as u from (select distinct cast(trunc({_PX16}) as int) as x, cast(trunc({_PY16}) as int) as y from occ where {O.plottable('EPSG:3857')}))",
)


def _inverted(spark, sf):
    at = mapped(spark, sf).select(pixel("EPSG:3857", SIZE, 16, F.col("decimalLatitude"), F.col("decimalLongitude")).alias("xy")).where(F.col("xy").isNotNull()).select("xy.x", "xy.y").distinct()
    lat, lng = inverse_xy("EPSG:3857", SIZE, 16, F.col("x"), F.col("y"))
    return at.select("x", "y", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


_NAMES = "select concat('maps_', lower(c_mktsegment), '_', strftime(o_orderdate, '%Y%m%d_%H%M')) as name from customer join orders on c_custkey = o_custkey"


def _names(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    joined = read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.select(F.concat(F.lit("maps_"), F.lower("c_mktsegment"), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmm")).alias("name"))


register("table_date", lambda s, d: _names(s, d).distinct().select("name", store.table_date_column(F.col("name")).alias("date")), f"select distinct name, strftime(strptime(right(name, 13), '%Y%m%d_%H%M'), '%Y-%m-%dT%H:%MZ') as date from ({_NAMES})")
_AGE = "row_number() over (partition by left(name, len(name) - 13) order by name desc)"
register("retention", lambda s, d: store.retention(_names(s, d).distinct(), "maps_none"), f"select name, case when {_AGE} = 1 then 'keep' when {_AGE} = 2 then 'disable' else 'delete' end as action from (select distinct name from ({_NAMES}))")
register("metastore_encode", lambda s, d: _pointers(s, d), "select 'points|tiles|' || string_agg(n_name || ',tiles_' || lower(n_name), '|' order by n_name) as value from nation")
_RAMP = styles.RAMPS["classic"]
_CASE = "case " + " ".join(f"when total <= {e} then '{c}'" for e, c in zip(_RAMP[0], _RAMP[1], strict=False)) + f" else '{_RAMP[1][-1]}' end"
register("style_classes", lambda s, d: tiles.flattened(_tiles(s, d, lowest=2)).groupBy(styles.colour(F.col("total"), "classic.point").alias("colour"), styles.style_class(F.col("total"), "classic.point").alias("class")).agg(F.count("*").alias("n")), O.with_(*_tiles_sql(lowest=2)) + f"select {_CASE} as colour, case when total <= 10 then 0 when total <= 100 then 1 when total <= 1000 then 2 when total <= 10000 then 3 when total <= 100000 then 4 else 5 end as class, count(*) as n from (select {_AT}, sum(cnt) as total from tiles group by all) group by all")
register("v1_key", lambda s, d: pixels.key_counts(_everything(s, d, K.non_taxon_keys())).where(F.col("mapKey").isin(params.v1_map_key("COUNTRY", "NATION_3"), params.v1_map_key("DATASET", "BUILDING"), params.v1_map_key("ALL", "x"))), O.with_() + f"select mapKey, count(*) as n from (select unnest({O.NON_TAXON}) as mapKey from occ) where mapKey in ('4:NATION_3', '2:BUILDING', '0:0') group by all")
register("mvt_roundtrip", lambda s, d: mvt.decoded_tiles(mvt.encoded_tiles(_tiles(s, d, lowest=2))), O.with_(*_tiles_sql(lowest=2)) + "select mapKey, z, tileX, tileY, pixelX, pixelY, bor, year, cnt from tiles")
register(
    "point_lists",
    lambda s, d: mvt.decoded_points(mvt.encoded_points(pixels.unpacked(pixels.points(_everything(s, d, K.non_taxon_keys()))))),
    O.with_() + f"select mapKey, decimalLatitude as lat, decimalLongitude as lng, basisOfRecord as bor, coalesce(year, 0) as year, count(*) as cnt from (select unnest({O.NON_TAXON}) as mapKey, decimalLatitude, decimalLongitude, basisOfRecord, year from occ) group by all",
)


def _built(spark, sf, **options) -> store.Config:
    """A small build in a folder of its own, on the session's shared storage."""
    config = store.Config("", store.scratch(spark, "build"), **{"modulus": 4, "max_zoom": 2, "projections": ("EPSG:3857",)} | options)
    build.build(spark, mapped(spark, sf).select("*"), config)
    return config


def _stored(spark, sf):
    config = _built(spark, sf, threshold=THRESHOLD)
    tile = store.stored_tile(spark, store.read_pointers(spark, build.pointers_of(config)).tiles, "EPSG:3857", K.ALL_KEY, 2, 2, 1, config.modulus)
    return tile.groupBy(*tiles.COLUMNS[:-1]).agg(F.sum("cnt").alias("cnt"))


def _served(threshold, **request):
    """A request by its parameters; with an endless threshold every key has a point list and no tiles."""
    return lambda s, d: build.served(s, _built(s, d, threshold=threshold), "EPSG:3857", 2, 2, 1, request)


_ASKED = {"country": ["NATION_3"], "year": ["1996,"], "basisOfRecord": ["OBSERVATION", "HUMAN_OBSERVATION"]}
_ANSWER = O.with_(*_tiles_sql(lowest=2, keys=O.NON_TAXON)) + f"select {_AT}, sum(cnt) as total from tiles where {_TILE} and mapKey = '{COUNTRY}' and year >= 1996 and bor in ('OBSERVATION', 'HUMAN_OBSERVATION') group by all"
register("stored_tile", _stored, O.with_(*_tiles_sql(lowest=2)) + f"select {_AT}, bor, year, sum(cnt) as cnt from tiles where {_TILE} group by all")
register("served_tile", _served(1, **_ASKED), _ANSWER)
register("served_trends", lambda s, d: _fit(build.served_trends(s, _built(s, d, threshold=1), "EPSG:3857", 2, 2, 1, {"country": ["NATION_3"]}, K.ALL_KEY)), ORACLES["regression_hex"])
register("served_capabilities", lambda s, d: build.served_capabilities(s, _built(s, d, threshold=1, projections=("EPSG:4326",), max_zoom=0), {}), ORACLES["capabilities"])
register("served_points", _served(10**12, **_ASKED), _ANSWER)


def _pointers(spark, sf):
    rows = spark.read.parquet(f"{sf}/nation.parquet").orderBy("n_name").collect()  # 25 rows
    made = store.Pointers("points", "tiles", {r["n_name"]: "tiles_" + r["n_name"].lower() for r in rows})
    return spark.createDataFrame([(store.Pointers.decode(made.encode()).encode(),)], "value string")
