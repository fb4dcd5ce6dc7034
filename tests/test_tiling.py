import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mapweave.functions import tiling as T


def local(spark, epsg, z, tx, ty, x, y, size=512, buffer=32):
    px, py = T.local_xy(epsg, z, F.lit(float(x)), F.lit(float(y)), F.lit(tx), F.lit(ty), size, buffer)
    return tuple(spark.range(1).select(px, py).first())


# Positions that any engine of these tiles must give.
@pytest.mark.parametrize(
    ("epsg", "z", "tile", "point", "expected"),
    [
        ("EPSG:3857", 1, (0, 0), (0, 0), (0, 0)), ("EPSG:3857", 1, (1, 0), (522, 522), (10, 522)), ("EPSG:3857", 1, (1, 0), (1025, 10), (513, 10)), ("EPSG:3857", 1, (0, 0), (-1, 10), (-1, 10)),
        ("EPSG:3857", 1, (1, 0), (0, 0), (512, 0)), ("EPSG:3857", 1, (0, 0), (1025, 10), (1, 10)), ("EPSG:3857", 1, (1, 0), (2, 10), (514, 10)),
        ("EPSG:3575", 1, (1, 0), (0, 0), (-512, 0)), ("EPSG:3575", 1, (0, 0), (1025, 10), (1025, 10)), ("EPSG:4326", 1, (1, 0), (2, 10), (-510, 10)), ("EPSG:4326", 1, (3, 0), (0, 0), (512, 0)), ("EPSG:4326", 1, (2, 0), (1025, 10), (1, 10)),
    ],
)
def test_local_pixels(spark, epsg, z, tile, point, expected):
    assert local(spark, epsg, z, *tile, *point) == expected


# Fixed values, as above.
@pytest.mark.parametrize(("epsg", "z", "point", "expected"), [("EPSG:3857", 1, (522, 522), (1, 1)), ("EPSG:3857", 0, (612, 50), (0, 0)), ("EPSG:4326", 0, (612, 50), (1, 0)), ("EPSG:3575", 5, (4125.7778, 2199.1111), (8, 4)), ("EPSG:3575", 5, (9625.7778, 10199.1111), (18, 19))])
def test_tiles(spark, epsg, z, point, expected):
    assert tuple(spark.range(1).select(*T.tile_xy(epsg, z, F.lit(point[0]), F.lit(point[1]), 512)).first()) == expected


def test_containment(spark):
    held = lambda z, tx, ty, x, y, size, buffer: spark.range(1).select(T.tile_contains("EPSG:3857", z, tx, ty, F.lit(x), F.lit(y), size, buffer)).first()[0]
    assert held(1, 0, 0, 256, 256, 512, 0) and held(1, 1, 1, 250, 250, 256, 10) and not held(1, 1, 1, 245, 245, 256, 10)
    assert held(1, 1, 0, 10, 10, 512, 64) and held(1, 0, 0, 1023, 10, 512, 64)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(epsg=st.sampled_from(["EPSG:3857", "EPSG:4326", "EPSG:3575"]), z=st.integers(0, 5), fx=st.floats(0, 0.999999), fy=st.floats(0, 0.999999))
def test_addresses_are_the_tiles_near_a_pixel(spark, epsg, z, fx, fy):
    schema, size, buffer = T.SCHEMAS[epsg], 512, 64
    wide, high = schema.wide << z, schema.high << z
    x, y = int(fx * wide * size), int(fy * high * size)
    got = {tuple(a) for a in spark.range(1).select(T.buffered_addresses(epsg, z, F.lit(x), F.lit(y), size, buffer)).first()[0]}
    assert 1 <= len(got) <= 4 and (x // size, y // size, x % size, y % size) in got
    for tx, ty, px, py in got:
        assert -buffer <= px <= size + buffer and -buffer <= py <= size + buffer
        assert ty * size + py == y and (tx * size + px - x) % (wide * size) == 0


def test_single_tile_has_no_copies(spark):
    got = spark.range(1).select(T.buffered_addresses("EPSG:3857", 0, F.lit(3), F.lit(500), 512, 64)).first()[0]
    assert [tuple(a) for a in got] == [(0, 0, 3, 500)]
