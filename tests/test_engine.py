import glob
import json
import math

import pytest
from pyspark.sql import functions as F

from mapweave.functions import keys as K
from mapweave.functions import params, projection, styles
from mapweave.operators import adhoc, binning, extent, mvt, pixels, raster, regression, tiles
from mapweave.plans import build
from mapweave.sources import store
from mapweave.sources.occurrence import BASES, COLUMNS, base_filter, fixture, mapped, read_occurrences
from mapweave.streaming.density import windowed


@pytest.fixture(scope="module")
def levels(spark, sf):
    rows = pixels.keyed(mapped(spark, sf), F.array(F.lit(K.ALL_KEY)))
    return pixels.pyramid(pixels.pixels(rows, "EPSG:4326", 512, 6), 6).cache()


def total(df, column="total"):
    return df.agg(F.sum(column)).first()[0]


def test_parent_is_the_sum_of_its_children(levels):
    sums = {r.z: r.n for r in levels.groupBy("z").agg(F.sum("occCount").alias("n")).collect()}
    assert len(set(sums.values())) == 1 and set(sums) == set(range(7))
    rows = levels.where("z = 3").select("z", F.shiftright("x", 1).alias("px"), F.shiftright("y", 1).alias("py"), "borYear", "occCount")
    up = rows.groupBy("px", "py", "borYear").agg(F.sum("occCount").alias("n"))
    parents = levels.where("z = 2").select(F.col("x").alias("px"), F.col("y").alias("py"), "borYear", F.col("occCount").alias("n"))
    assert up.exceptAll(parents).count() == parents.exceptAll(up).count() == 0


def test_tiles_without_buffers_hold_every_pixel_once(levels):
    rows = tiles.tiles(levels.where("z = 4"), "EPSG:4326")
    assert total(tiles.without_buffer(rows), "cnt") == total(levels.where("z = 4"), "occCount") < total(rows, "cnt")
    both = tiles.flattened(rows, verbose=True).groupBy("tileX", "tileY", "pixelX", "pixelY").agg(F.sum("cnt").alias("years"), F.max("total").alias("total"))
    assert both.where("years <> total").count() == 0
    assert total(binning.square_bins(rows)) == total(tiles.without_buffer(rows), "cnt")
    assert total(tiles.without_buffer(rows), "cnt") <= total(binning.hex_bins(rows)) <= total(rows, "cnt")


def test_year_filter_is_the_year_of_the_unfiltered(levels):
    rows = tiles.tiles(levels.where("z = 2"), "EPSG:4326")
    assert total(tiles.flattened(tiles.filtered(rows, (1996, 1996)))) == total(rows.where("year = 1996"), "cnt")


def test_semi_and_anti_split_all(spark, sf):
    rows = pixels.keyed(mapped(spark, sf))
    large = pixels.large_keys(rows, 500)
    assert pixels.with_keys(rows, large, True, 10).count() + pixels.with_keys(rows, large, False).count() == rows.count()


def test_point_path_and_tile_path_agree(spark, sf):
    rows = pixels.keyed(mapped(spark, sf), F.array(F.lit(K.ALL_KEY)))
    made = tiles.tiles(pixels.pyramid(pixels.pixels(rows, "EPSG:3857", 512, 2), 2, 2), "EPSG:3857")
    a = tiles.flattened(tiles.one_tile(made, K.ALL_KEY, 2, 1, 1))
    b = tiles.flattened(tiles.point_tile(pixels.points(rows), K.ALL_KEY, "EPSG:3857", 2, 1, 1)).select(*a.columns)
    assert a.count() > 0 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_bor_year_codes(spark):
    rows = spark.createDataFrame([(b, 1990) for b in BASES] + [("OBSERVATION", None), ("NONE", 2000), (None, 2000), ("OBSERVATION", -5)], "bor string, year int")
    got = [r[0] for r in rows.select(K.encode_bor_year(F.col("bor"), F.col("year"))).collect()]
    assert got == [199000 + i for i in range(9)] + [5, None, None, None]


@pytest.mark.parametrize(("modulus", "key", "row"), [(28, "bingo", "03:bingo")])
def test_salt(spark, modulus, key, row):
    got = spark.range(1).select(K.salted(F.lit(key), modulus).alias("k")).select("k", K.salt_from(F.col("k")).alias("s")).first()
    assert got.k == row and got.s == int(row.split(":")[0])
    texts = [key, "0:0", "4:DK:3:2:1", "1:a|b c", "", "é"]
    columns = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.salt(F.col("t"), 100).alias("s"), K.salted(F.col("t"), 100).alias("k")).collect()
    assert all(K.row_key(r.t, 100) == (r.s, r.k) for r in columns) and K.row_key(key, modulus) == (got.s, row)
    assert K.region_splits(3) == ["1", "2"] and K.region_splits(11)[0] == "01"
    with pytest.raises(ValueError):
        K.salt(F.lit(key), 1)


@pytest.mark.parametrize(("values", "spread"), [([50, 88, 132, 170, -178, -155, -20, -2], (-20, -155)), ([5], (5, 5)), ([], None), ([-180, 0], (-180, 0)), ([10, 20, 30], (10, 30)), ([170, -170], (170, -170))])
def test_spread(spark, values, spread):
    got = extent.centred_spread(spark.createDataFrame([(v,) for v in values], "v long"), 360).collect()
    assert [tuple(r) for r in got] == ([spread] if spread else [])


def test_capabilities(spark):
    row = lambda tx, px, py, year, n: ("k", 0, tx, 0, px, py, "OBSERVATION", year, n)
    schema = "mapKey string, z int, tileX int, tileY int, pixelX int, pixelY int, bor string, year int, cnt long"
    rows = spark.createDataFrame([row(0, 156, 446, 1900, 10), row(0, 156, 446, 0, 20), row(1, 36, 207, 1930, 20), row(1, 513, 10, 1700, 5)], schema)
    got = extent.capabilities(rows).first().asDict()
    assert got == {"minLat": -67, "minLng": -126, "maxLat": 18, "maxLng": 13, "minYear": 1900, "maxYear": 1930, "total": 50}
    assert tuple(extent.capabilities(rows.limit(0)).first()) == (-90, -180, 90, 180, None, None, 0)


def test_year_parameters():
    assert params.years("") == params.years(None) == (None, None)
    assert params.years("1900") == (1900, 1900) and params.years("1900,") == (1900, None) and params.years(",1950") == (None, 1950)
    for bad in ("1,2,3", ",", "x", "1950,1900"):
        with pytest.raises(ValueError):
            params.years(bad)


def test_ranges(spark):
    rows = spark.createDataFrame([(2014,), (2010,), (None,)], "year int")
    kept = lambda lo, hi: [r.year for r in rows.where(tiles.in_years(F.col("year"), lo, hi)).collect()]
    assert kept(None, 2014) == [2014, 2010] and kept(2014, None) == [2014] and kept(None, None) == [2014, 2010, None]


def test_map_key_parameters():
    assert params.map_keys({}) == ("0:0", None)
    assert params.map_keys({"country": ["DK"]}) == ("4:DK", None)
    assert params.map_keys({"country": ["DK"], "datasetKey": ["a"], "networkKey": [""]}) == ("2:a", "4:DK")
    assert params.map_keys({"taxonKey": ["1"], "checklistKey": ["c"]}) == ("1:c|1", None)
    for bad in ({"datasetKey": ["a", "b"]}, {"datasetKey": ["a"], "publishingOrg": ["b"]}):
        with pytest.raises(ValueError):
            params.map_keys(bad)
    assert params.search({"year": [" 1990 ", ""], "x": ["1"]}, {"year": int}) == {"year": [1990]}


def test_first_interface():
    assert params.v1_map_key("DATASET", "a-1") == "2:a-1" and params.v1_map_key("ANY", "1") == "0:0"
    with pytest.raises(ValueError):
        params.v1_map_key("DATASET", "a b")
    assert params.v1_layers(["OBS_1950_1960", "OBS_1960_1970", "LIVING"]) == ({*params.LAYERS["OBS"], "LIVING_SPECIMEN"}, (1950, 1970))
    assert params.v1_layers(["SP_NO_YEAR", "SP_PRE_1900", "SP_1900_2030"]) == ({"PRESERVED_SPECIMEN"}, None)
    with pytest.raises(ValueError):
        params.v1_layers(["OBS_1950_1960", "SP_1940_1950"])
    assert params.tile_address("/a/3/2/1@Hx.png") == (3, 2, 1, 0.5) and params.tile_address("/3/2/1@9x.png")[3] == 4
    assert params.vector_path("/3/2/1@2x.png") == "/3/2/1.mvt"


def test_styles(spark):
    row = spark.range(1).select(styles.colour(F.lit(10), "classic.point"), styles.colour(F.lit(11), "classic"), styles.style_class(F.lit(10**6), "green.poly"), styles.colour(F.lit(1), "red.poly"), styles.width(F.lit(500), "marker")).first()
    assert tuple(row) == ("#FFFF00", "#FFCC00", 9, "#cc0000", 12)
    assert styles.style_name("nope") == "classic.point" and styles.heat_width(12) == 6.25


def test_pointers(spark, tmp_path):
    text = "dots_20240301_0615|grid_20240302_0930|birds,birds_20240303_1200|plants,plants_20240304_2359"
    p = store.Pointers.decode(text)
    assert p.encode() == text and p.table_of("1:birds|5") == "birds_20240303_1200" and p.table_of("1:fungi|5") == p.table_of("2:x") == "grid_20240302_0930"
    assert store.table_date(p.tiles) == "2024-03-02T09:30Z" and store.table_date("x") is None
    assert store.Pointers.decode("") == store.Pointers()
    with pytest.raises(ValueError):
        store.Pointers.decode("a")
    path = str(tmp_path / "pointers")
    assert store.read_pointers(spark, path) == store.Pointers()
    store.write_pointers(spark, path, store.Pointers(tiles="t1", checklists={"A": "a1"}))
    assert store.write_pointers(spark, path, store.Pointers(points="p1", checklists={"B": "b1"})).encode() == "p1|t1|A,a1|B,b1"
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["pointers"]  # a file renamed into place, nothing beside it


def test_retention(spark):
    names = spark.createDataFrame([(f"t_2020010{i}_0000",) for i in range(1, 5)], "name string")
    got = {r.name[9]: r.action for r in store.retention(names, "t_20200101_0000").collect()}
    assert got == {"4": "keep", "3": "disable", "2": "delete", "1": "keep"}


def test_config():
    c = store.Config.read('source: occ\ntarget: /x/maps # out\nthreshold: 5\nprojections: ["EPSG:3857"]\n')
    assert (c.source, c.threshold, c.projections) == ("occ", 5, ("EPSG:3857",)) and c.table_name("A") == "maps_all_A_19700101_0000"


def test_nested_config():
    text = """---
# a whole file
sourceSubdirectory: "occurrence"
targetDirectory: /data/maps
mode: nightly
timestamp: "20240102_0304"
tilesThreshold: 250
maxZoom: 7
tileBufferSize: 32   # pixels
checklistsToProcess:
  birds: https://a.example/x
  plants: y
hbase:
  keySaltModulusTiles: 9
  tableName: nightly_maps
lock:
  paths:
    - /a
    - '/b c'
  retries: 3
skip: true
"""
    found = store.nested(text)
    assert found["lock"] == {"paths": ["/a", "/b c"], "retries": 3} and found["skip"] is True and found["hbase"]["tableName"] == "nightly_maps"
    c = store.Config.read(text)
    assert (c.source, c.target, c.mode, c.threshold, c.max_zoom, c.buffer, c.modulus, c.table, c.checklists) == ("occurrence", "/data/maps", "nightly", 250, 7, 32, 9, "nightly_maps", ("birds", "plants"))
    assert c.table_name() == "nightly_maps_nightly_20240102_0304" and c.directory() == "/data/maps_nightly_20240102_0304"
    assert store.nested("a:\n  - 1\n  - 2\nb:\n  c:\n    d: 1\ne: x") == {"a": [1, 2], "b": {"c": {"d": 1}}, "e": "x"}


def test_bytes_round_trip():
    layers = {"OBSERVATION": [(10, 10, {"2012": 1, "2013": 2}), (-3, 511, {"2011": 1 << 40})], "OCCURRENCE": [(0, 0, {"0": 7})]}
    data = mvt.encode_tile(layers)
    assert mvt.decode_tile(data) == layers and list(mvt.decode_tile(data, {"OCCURRENCE"})) == ["OCCURRENCE"] and mvt.decode_tile(b"") == {}
    points = [(1.5, -2.25, "OBSERVATION", 1990, 3), (0.0, 0.0, "FOSSIL_SPECIMEN", 0, 1)]
    assert mvt.decode_points(mvt.encode_points(points)) == points


def test_polygons_round_trip():
    ring = [(0, 0), (0, 16), (16, 16), (16, -5)]
    data = mvt.encode_shapes({"a": [(ring, {"total": 3, "2012": 1, "hash": "u4p"}), ((7, -9), {"total": 1})]}, 4096)
    (_, shape, attributes), (_, point, _) = list(mvt.decode_shapes(data))
    area = sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(shape, [*shape[1:], shape[0]], strict=True))
    assert set(shape) == set(ring) and area > 0 and point == (7, -9)  # an outer ring turns to the right
    assert attributes == {"total": 3, "2012": 1}  # a text that is no number is no count
    assert [mvt.lenient(v, k) for v, k in ((b" 12 ", 1), (b"x", 1), (2.0, 3), (2.5, 3), (5, 4), (5, 6), (True, 7))] == [12, None, 2, None, 5, -3, 1]


def test_encoding_takes_time_in_proportion():
    """A tile of all its pixels: ten times the features take nowhere near a hundred times as long."""
    import time

    def seconds(n):
        features = [(i % 512, i // 512, {"2000": 1 + i % 7, "2001": 2}) for i in range(n)]
        began = time.process_time()
        mvt.encode_tile({"OBSERVATION": features})
        return time.process_time() - began

    seconds(1000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.05)


def test_encoding_across_batches(spark, levels):
    """A pixel whose years come in two batches is one feature."""
    rows = tiles.tiles(levels.where("z = 1"), "EPSG:4326")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        tile = {(r.z, r.tileX, r.tileY): bytes(r.tile) for r in mvt.encoded_tiles(rows).collect()}
        again = mvt.decoded_tiles(mvt.encoded_tiles(rows))
        counted = rows.groupBy(*tiles.COLUMNS[:-1]).agg(F.sum("cnt").alias("cnt"))
        assert again.exceptAll(counted.select(*again.columns)).count() == counted.select(*again.columns).exceptAll(again).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    places = [(bor, *shape) for data in list(tile.values())[:1] for bor, shape, _ in mvt.decode_shapes(data)]
    assert len(places) == len(set(places)) > 10


def test_significance():
    # Student's t: 2.228 at ten degrees of freedom is five per cent.
    assert regression.significance(2.228139, 1.0, 12) == pytest.approx(0.05, abs=1e-6)
    assert regression.significance(1.0, 1.0, 3) == pytest.approx(0.5) and regression.significance(0.0, 1.0, 30) == pytest.approx(1)
    assert math.isnan(regression.significance(1.0, 1.0, 2)) and regression.significance(1.0, 0.0, 5) == 0


def test_trend(spark):
    group = spark.createDataFrame([(y, 10) for y in range(2000, 2006)], "year int, n long")
    species = spark.createDataFrame([(2000 + i, i) for i in range(1, 6)], "year int, n long")
    row = regression.trends(species, group, []).first()
    assert (row.n, row.slope) == (6, 0.1) and row.sse == pytest.approx(0, abs=1e-9)
    short = regression.trends(species.limit(1), group.limit(1), []).first()
    assert short.slope is None and short.mse is None


def test_hexagons_are_nearest(spark):
    radius, height = binning.hex_size()
    points = spark.createDataFrame([(float(i * 37 % 9000), float(i * 91 % 7000)) for i in range(300)], "x double, y double")
    q, r = binning.hex_cell(F.col("x"), F.col("y"))
    centre = lambda q, r: (1.5 * radius * q, height * (r + q / 2))
    for p in points.select("x", "y", q.alias("q"), r.alias("r")).collect():
        away = lambda dq, dr: math.dist((p.x, p.y), centre(p.q + dq, p.r + dr))  # noqa: E731, B023
        assert away(0, 0) <= min(away(*d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1))) + 1e-9
    assert len(binning.hex_polygon(0, 0)) == 7


@pytest.mark.parametrize("per_tile", [51, 9, 34])
def test_hexagons_of_a_tile_s_own_grid(spark, per_tile):
    """Of an explicit grid for each tile the nearest centre has the pixel; where that lies off the grid, none has."""
    import random

    radius, height = binning.hex_size(per_tile)
    width, r = 2 * radius, random.Random(per_tile)
    odd = per_tile + (per_tile % 2 == 0)
    columns, rows_down = odd + 8, math.ceil(4096 / height) + 8
    points = [(x, y, r.randint(-512, 4608), r.randint(-512, 4608)) for x, y in ((0, 0), (1, 0), (3, 2), (0, 5), (13, 7)) for _ in range(60)]
    want = []
    for tx, ty, px, py in points:
        off_x, off_y = math.fmod(tx * 4096.0, 1.5 * width) - 0.25 * width, math.fmod(ty * 4096.0, height)
        gx, gy = px + off_x + 1.5 * width, py + off_y + 2 * height
        centres = {(c, k): (radius + 1.5 * radius * c, height / 2 * (1 + c % 2) + height * k) for c in range(-12, columns + 12) for k in range(max(-14, int(gy / height) - 3), int(gy / height) + 4)}
        best = min(centres, key=lambda c: math.dist(centres[c], (gx, gy)))
        x, y = centres[best]
        want.append((round(x - off_x - 1.5 * width, 6), round(y - off_y - 2 * height, 6)) if 0 <= best[0] < columns and 0 <= best[1] < rows_down else None)
    df = spark.createDataFrame([(i, 0, tx, ty, px / 8, py / 8, 1) for i, (tx, ty, px, py) in enumerate(points)], "i int, z int, tileX int, tileY int, pixelX double, pixelY double, cnt long")
    q, rr = binning.hex_cell(F.col("tileX") * 4096.0 + F.col("pixelX") * 8.0, F.col("tileY") * 4096.0 + F.col("pixelY") * 8.0, per_tile)
    got = {}
    for row in df.select("i", "tileX", "tileY", q.alias("q"), rr.alias("r")).where(binning.on_grid(F.col("q"), F.col("r"), F.col("tileX"), F.col("tileY"), per_tile)).collect():
        got[row.i] = (round(1.5 * radius * row.q - 4096 * row.tileX, 6), round(height * (row.r + row.q / 2) - 4096 * row.tileY, 6))
    for i, place in enumerate(want):
        assert (got.get(i) is None) == (place is None) and (place is None or got[i] == pytest.approx(place, abs=1e-4)), points[i]
    assert (None in want or per_tile == 9) and sum(p is not None for p in want) > 150


def test_images(spark, levels):
    rows = tiles.flattened(tiles.tiles(levels.where("z = 1"), "EPSG:4326"))
    images = {(r.tileX, r.tileY): raster.pixels_of(bytes(r.png)) for r in raster.rendered(rows, "classic.point").collect()}
    inside = [r for r in rows.where("pixelX between 0 and 511 and pixelY between 0 and 511").withColumn("colour", styles.colour(F.col("total"), "classic.point")).collect()]
    for r in inside:
        assert "#%02X%02X%02X" % tuple(images[r.tileX, r.tileY][r.pixelY, r.pixelX, :3]) == r.colour
    assert sum(int((i[..., 3] > 0).sum()) for i in images.values()) == len(inside)
    image = raster.blank(8)
    raster.paint(image, -1, 3, "#102030", 4)
    assert (image[..., 3] > 0).sum() == 8 and (raster.pixels_of(raster.png(image)) == image).all()
    half, full = raster.blank(2), raster.blank(2)
    half[0, 0], full[:] = (255, 128, 0, 255), (128, 128, 128, 255)
    assert raster.multiplied(half, full)[0, 0].tolist() == [128, 64, 0, 255] and raster.multiplied(half, full)[1, 1].tolist() == [128, 128, 128, 255]
    whole = raster.heat_composite({(0, 0): half, (1, 1): full}, 2)
    assert whole[0, 0].tolist() == [255, 128, 0, 64] and whole[1, 1].tolist() == [128, 128, 128, 255] and whole[0, 1, 3] == 0


def test_sources(spark, sf, tmp_path):
    """A table of the catalog and a folder of files give the same records, and only the columns that are used."""
    fixture(spark, sf).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "occ"))
    spark.read.parquet(str(tmp_path / "occ")).createOrReplaceTempView("occurrence_source")
    a, b = read_occurrences(spark, str(tmp_path / "occ")), read_occurrences(spark, "occurrence_source")
    assert a.columns == b.columns == list(COLUMNS) and a.count() == b.count() > 0
    assert a.select("countryCode", "year").exceptAll(b.select("countryCode", "year")).count() == 0


def test_watched_pointers(spark, tmp_path):
    path = str(tmp_path / "pointers")
    seen = store.watched(spark, path, 0.0, rounds=4)
    assert next(seen) == store.Pointers()
    store.write_pointers(spark, path, store.Pointers(tiles="t1"))
    assert next(seen).tiles == "t1" and list(seen) == []


def test_inverse_of_every_map(spark):
    for epsg, lat, lng in (("EPSG:3857", 60.25, 24.5), ("EPSG:4326", -12.5, 179.0), ("EPSG:3575", 70.0, -100.0), ("EPSG:3031", -80.0, 15.0)):
        assert projection.inverse(epsg, 512, 3, *projection.forward(epsg, 512, 3, lat, lng)) == pytest.approx((lat, lng), abs=1e-6)


def test_described_tiles():
    assert mvt.described(mvt.encode_shapes({"a": [((1, 2), {"total": 3})], "b": [([(0, 0), (4, 0), (4, 4)], {})]}, 512)) == ["layer a", "  point 1 2 total=3", "layer b", "  polygon 0 0,4 0,4 4"]


def test_geohash(spark):
    row = spark.range(1).select(adhoc.geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("h"), adhoc.geohash(F.lit(-90.0), F.lit(-180.0), 4).alias("low"), adhoc.geohash(F.lit(90.0), F.lit(180.0), 3).alias("high")).first()
    assert tuple(row) == ("u4pruydqqvj", "0000", "zzz")
    assert adhoc.box_text((-180.0, -90, 0.5, 90)) == "-180.0,-90.0,0.5,90.0"


def test_adhoc_tiles(spark, sf):
    records = mapped(spark, sf)
    cells = adhoc.tile(records, "EPSG:4326", 2, 5, 1, 6)
    decoded = lambda **o: mvt.decoded_polygons(adhoc.encoded(cells, "EPSG:4326", 2, 5, 1, **o)).collect()
    boxes, points, hexes, squares = decoded(), decoded(mode="centroid"), decoded(bin="hex"), decoded(bin="square")
    assert sum(r.total for r in boxes) == sum(r.total for r in points) == total(cells) and all("," not in r.ring for r in points) and any(r.ring.count(",") == 3 for r in boxes)
    assert all(r.ring.count(",") == 5 for r in hexes) and all(r.ring.count(",") == 3 for r in squares) and sum(r.total for r in squares) <= total(cells)
    assert adhoc.encoded(cells.limit(0), "EPSG:4326", 2, 5, 1).count() == 0
    with pytest.raises(ValueError):
        adhoc.encoded(cells, "EPSG:4326", 2, 5, 1, bin="round")


def test_trend_as_json_and_tile(spark):
    group = spark.createDataFrame([(y, 10) for y in range(2000, 2006)], "year int, n long")
    species = spark.createDataFrame([(2000 + i, i) for i in range(1, 6)], "year int, n long")
    made = json.loads(regression.as_json(species, group).first().json)
    assert made["n"] == 6 and made["slope"] == 0.1 and json.loads(made["groupCounts"]) == {str(y): 10 for y in range(2000, 2006)} and json.loads(made["speciesCounts"])["2005"] == 5
    both = [df.crossJoin(spark.createDataFrame([(1, 2)], "q long, r long")) for df in (species, group)]
    tile = regression.encoded(regression.trends(*both, ["q", "r"]), 2, 0, 0).first()
    (layer, shape, attributes), = mvt.decode_shapes(bytes(tile.tile))
    assert layer == "regression" and len(shape) == 6 and attributes["total"] == 6 and attributes["n"] == 6


def test_boxes(spark, sf):
    records = mapped(spark, sf)
    assert len(adhoc.request_boxes("EPSG:3575", 1, 0, 0)) == 4 and len(adhoc.request_boxes("EPSG:3857", 1, 0, 0)) == 1
    assert adhoc.bounds(records, 4, (10.0, 0.0, 10.0, 5.0)).count() == 0
    east, west = (total(adhoc.bounds(records, 4, b)) or 0 for b in ((0.0, -90.0, 180.0, 90.0), (-180.0, -90.0, -0.0001, 90.0)))
    assert east + west == records.count()
    saved = adhoc.Predicates()
    assert records.where(saved.get(saved.save("year = 1996"))).count() == records.where("year = 1996").count()


def test_unmapped_records_go(spark, sf):
    rows = fixture(spark, sf)
    assert base_filter(rows).count() < rows.count() and base_filter(rows.limit(0)).count() == 0


def test_filters_reach_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "occ")
    fixture(spark, sf).write.parquet(path)
    plan = base_filter(spark.read.parquet(path)).select("decimalLatitude")._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(decimalLatitude)" in plan and "EqualTo(occurrenceStatus,PRESENT)" in plan and "classifications" not in plan


def test_build(spark, sf, tmp_path):
    config = store.Config("", str(tmp_path / "maps"), threshold=1000, modulus=4, max_zoom=2, projections=("EPSG:4326",), checklists=("chk-b",), input_files=2)
    pointers = build.build(spark, fixture(spark, sf), config)
    tile = store.stored_tile(spark, pointers.tiles, "EPSG:4326", K.ALL_KEY, 0, 0, 0, 4)
    plan = tile._jdf.queryExecution().executedPlan().toString()
    assert all(f"isnotnull({c}#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0] for c in ("epsg", "kind", "z", "salt")) and "EqualTo(rowKey," in plan
    prepared = spark.read.parquet(pointers.tiles).where("epsg = 'EPSG_4326'")
    both = sum(total(build.density_tile(prepared, None, K.ALL_KEY, "EPSG:4326", 0, x, 0, buffer=0).where("pixelX between 0 and 511")) for x in (0, 1))
    assert both == mapped(spark, sf).count()
    assert build.capabilities(prepared, K.ALL_KEY).first().total == both
    key = spark.read.parquet(pointers.points).select("mapKey").first()[0]
    assert store.stored_points(spark, pointers.points, key, 4).count() > 0
    listed = spark.read.parquet(pointers.points)
    assert build.density_tile(prepared, listed, key, "EPSG:4326", 0, 0, 0).count() + build.density_tile(prepared, listed, key, "EPSG:4326", 0, 1, 0).count() > 0
    # A second build goes to a folder of its own; the first stays readable, and requests find the second.
    again = build.build(spark, fixture(spark, sf), config)
    assert len([f for f in glob.glob(f"{again.tiles}/../input/*.parquet")]) <= 2
    assert again.tiles != pointers.tiles and store.stored_tile(spark, pointers.tiles, "EPSG:4326", K.ALL_KEY, 0, 0, 0, 4).count() == tile.count() > 0
    served = build.served(spark, config, "EPSG:4326", 0, 0, 0, {"verbose": ["true"]})
    assert served.groupBy().agg(F.sum("cnt")).first()[0] == total(tile, "cnt")
    text = json.loads(build.tile_json(spark, config, "ALL", "").first().json)
    assert text["count"] == both and build.served_capabilities(spark, config, {}).first().total == both and text["maximumLatitude"] <= 85.06
    some = json.loads(build.tile_json(spark, config, "COUNTRY", "NATION_3").first().json)
    assert 0 < some["count"] < both and json.loads(build.tile_json(spark, config, "COUNTRY", "none").first().json)["count"] == 0
    image = raster.pixels_of(bytes(build.served_image(spark, config, "EPSG:4326", 0, 0, 0, {"style": ["green.point"], "bin": ["hex"]}).first().png))
    assert 0 < (image[..., 3] == 255).sum() <= tile.select("pixelX", "pixelY").distinct().count()
    for request in ({}, {"verbose": ["true"]}, {"bin": ["hex"]}, {"bin": ["square"], "squareSize": ["64"]}):
        decoded = mvt.decoded_polygons(build.served_bytes(spark, config, "EPSG:4326", 0, 0, 0, request))
        inside = {} == request or "verbose" in request
        assert total(decoded) == total(tile, "cnt") if inside else 0 < total(decoded) <= total(tile, "cnt")


def test_files_are_in_key_order(spark, sf, tmp_path):
    """Each file by itself, as it lies on the disk, and each in one folder of a projection, kind, zoom and salt."""
    import pyarrow.parquet as pq

    rows = pixels.keyed(mapped(spark, sf), K.non_taxon_keys())
    levels = pixels.pyramid(pixels.pixels(rows, "EPSG:3857", 512, 3), 3)
    store.write_tiles(tiles.tiles(levels, "EPSG:3857"), str(tmp_path / "t"), 4, "EPSG:3857", "nonTaxon")
    store.write_points(pixels.points(rows), str(tmp_path / "p"), 4)
    files = [*(tmp_path / "t").rglob("*.parquet"), *(tmp_path / "p").rglob("*.parquet")]
    for file in files:
        keys = pq.ParquetFile(file).read(["rowKey"])["rowKey"].to_pylist()
        assert keys == sorted(keys)
    assert len(files) >= 16 and {f.parent.name.split("=")[0] for f in files} == {"salt"}


def test_polar_builds_compare_the_bare_latitude(spark, sf, tmp_path):
    path = str(tmp_path / "occ")
    mapped(spark, sf).write.parquet(path)
    for epsg, found in (("EPSG:3575", "GreaterThan(decimalLatitude,-1.0)"), ("EPSG:3031", "LessThan(decimalLatitude,1.0)")):
        rows = pixels.keyed(spark.read.parquet(path), F.array(F.lit(K.ALL_KEY)))
        assert found in pixels.pixels(rows, epsg)._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = windowed(stream, "ts", ["event_type"], "365 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("total")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_views_of_tiles_and_extents(spark, levels):
    rows = tiles.tiles(levels.where("z = 1"), "EPSG:4326")
    near = tiles.readdressed(tiles.without_buffer(rows), 1, 0)
    own = tiles.one_tile(rows, K.ALL_KEY, 1, 1, 0)
    assert near.select(*tiles.COLUMNS).exceptAll(own).where("pixelX <= 512 and pixelY <= 512 and pixelX >= -64 and pixelY >= -64").count() == 0
    x, y = binning.cell_of(binning.cell_key(F.lit(7), F.lit(9)))
    assert tuple(spark.range(1).select(x, y).first()) == (7, 9)
    text = extent.as_json(extent.capabilities(rows.limit(0))).first().json
    assert text == '{"minLat":-90,"minLng":-180,"maxLat":90,"maxLng":180,"total":0}'
    assert extent.first_interface(extent.capabilities(rows.limit(0))).first().maximumLatitude < 85.06


def test_legacy_point_counts(spark, sf):
    rows = pixels.keyed(mapped(spark, sf), F.array(F.lit(K.ALL_KEY)))
    old = pixels.points(rows, legacy_counts=True)
    assert total(old, "occCount") == pixels.points(rows).count() < rows.count()
