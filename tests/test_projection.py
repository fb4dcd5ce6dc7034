import math

import pytest
from pyspark.sql import functions as F

from mapweave.functions import projection as P


@pytest.mark.parametrize(
    ("epsg", "lat", "lng", "z", "x", "y"),
    [
        ("EPSG:3857", 0, 0, 0, 256, 256), ("EPSG:3857", 60.170833, 24.9375, 0, 291.46666, 148.19743), ("EPSG:4326", 90, -180, 0, 0, 0), ("EPSG:4326", -90, 180, 0, 1024, 512), ("EPSG:4326", 0, 0, 1, 1024, 512),
        ("EPSG:3575", 90, 0, 0, 256, 256), ("EPSG:3575", 0, -80, 0, 0, 256), ("EPSG:3575", 0, 100, 0, 512, 256), ("EPSG:3575", 0, -170, 2, 1024, 0), ("EPSG:3575", 0, 10, 2, 1024, 2048),
        ("EPSG:3031", -90, 0, 0, 256, 256), ("EPSG:3031", 0, -90, 0, 0, 256), ("EPSG:3031", 0, 90, 2, 2048, 1024), ("EPSG:3031", 0, 0, 2, 1024, 0), ("EPSG:3031", 0, 180, 2, 1024, 2048),
    ],
)
def test_known_points(spark, epsg, lat, lng, z, x, y):
    # On the edge of the Arctic map, half the width comes from a sphere and the pixel from the ellipsoid: a few metres.
    assert P.forward(epsg, 512, z, lat, lng) == pytest.approx((x, y), abs=1e-4)
    gx, gy = P.global_xy(epsg, 512, z, F.lit(float(lat)), F.lit(float(lng)))
    row = spark.range(1).select(gx.alias("x"), gy.alias("y")).first()
    assert (row.x, row.y) == pytest.approx((x, y), abs=1e-4)


@pytest.mark.parametrize("epsg", ["EPSG:3575", "EPSG:3031"])
def test_polar_inverse(epsg):
    sign = 1 if epsg == "EPSG:3575" else -1
    for lat in (1.0, 30.5, 66.6, 89.0):
        for lng in (-179.5, -90.0, 0.0, 45.25, 179.0):
            back = P.inverse(epsg, 512, 3, *P.forward(epsg, 512, 3, sign * lat, lng))
            assert back == pytest.approx((sign * lat, lng), abs=1e-7)
    assert math.isnan(P.inverse("EPSG:3575", 512, 0, 0, 0)[0])


def test_plottable_edges(spark):
    limit = P.MERCATOR_LIMIT
    rows = spark.createDataFrame([(limit, 180.0), (-limit, -180.0), (85.06, 0.0), (0.0, 179.99), (90.0, 0.0), (0.0, 180.01)], "lat double, lng double")
    got = rows.select(*(P.plottable(e, F.col("lat"), F.col("lng")).alias(e) for e in P.SCHEMAS)).collect()
    assert [r["EPSG:3857"] for r in got] == [True, True, False, True, False, False]
    assert [r["EPSG:4326"] for r in got] == [True, True, True, True, True, False]
    assert [r["EPSG:3575"] for r in got] == [True, False, True, True, True, False]
    assert [r["EPSG:3031"] for r in got] == [False, True, False, True, False, False]


def test_pixels_off_the_map_are_null(spark):
    rows = spark.createDataFrame([(89.0, 0.0), (10.0, 10.0)], "lat double, lng double")
    got = [r[0] for r in rows.select(P.pixel("EPSG:3857", 512, 16, F.col("lat"), F.col("lng"))).collect()]
    assert got[0] is None and got[1].x == int(P.forward("EPSG:3857", 512, 16, 10.0, 10.0)[0])


def test_boundaries():
    assert P.tile_boundary("EPSG:4326", 0, 1, 0) == (0, -90, 180, 90)
    assert P.tile_boundary("EPSG:3857", 1, 1, 0) == pytest.approx((0, 0, 180, P.MERCATOR_LIMIT))
    assert P.tile_boundary("EPSG:3575", 0, 0, 0) == (-180, 0, 180, 90)
    assert P.tile_boundary("EPSG:3031", 0, 0, 0) == (-180, -90, 180, 0)
    west, south, east, north = P.tile_boundary("EPSG:3575", 1, 1, 1)
    assert (west, south, east, north) == pytest.approx((10, 0, 100, 90), abs=1e-5)
    west, south, east, north = P.tile_boundary("EPSG:3031", 1, 1, 0)
    assert (west, south, east, north) == pytest.approx((0, -90, 90, 0), abs=1e-5)


@pytest.mark.parametrize("epsg", ["EPSG:3575", "EPSG:3031"])
def test_points_of_a_tile_lie_in_its_boundary(epsg):
    sign = 1 if epsg == "EPSG:3575" else -1
    for z in (1, 2, 3):
        for lat in range(1, 90, 7):
            for lng in range(-179, 180, 11):
                x, y = P.forward(epsg, 512, z, sign * lat, lng)
                west, south, east, north = P.tile_boundary(epsg, z, int(x // 512), int(y // 512))
                assert south - 1e-6 <= sign * lat <= north + 1e-6
                assert west - 1e-6 <= lng <= east + 1e-6 if west <= east else lng >= west - 1e-6 or lng <= east + 1e-6


def test_pole_tiles():
    assert not P.is_pole_tile("EPSG:3575", 0, 0, 0)
    assert P.is_pole_tile("EPSG:3575", 1, 0, 1) and P.is_pole_tile("EPSG:3031", 2, 2, 1)
    assert not P.is_pole_tile("EPSG:3575", 2, 3, 1) and not P.is_pole_tile("EPSG:3857", 1, 0, 0)
