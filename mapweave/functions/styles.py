"""Map styles as class breaks: what colour, or what width, a total has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLASSIC = (10, 100, 1000, 10_000, 100_000)
_PURPLE = (5, 10, 50, 100, 500, 1000, 5000, 10_000)
_FOUR = (10, 100, 1000, 10_000)
#: Upper ends of the classes, and their colours.
RAMPS = {
    "classic": (_CLASSIC, ("#FFFF00", "#FFCC00", "#FF9900", "#FF6600", "#D60A00", "#C2002D")),
    "purpleYellow": (_PURPLE, ("#5e0063", "#851362", "#a42e61", "#be4c60", "#d26b63", "#e28b6b", "#eeab79", "#f7cb8e", "#ffebaa")),
    "purpleWhite": (_PURPLE, ("#a000a0", "#ab1fab", "#b73fb7", "#c35fc3", "#cf7fcf", "#db9fdb", "#e7bfe7", "#f3dff3", "#ffffff")),
    "green": ((*_PURPLE, 100_000), ("#4D7C40", "#608A50", "#70955E", "#85A36F", "#95AD7C", "#AABA8D", "#BAC599", "#CCD0A8", "#DFDCB7", "#EFE6C4")),
    "green2": (_FOUR, ("#edf8e9", "#bae4b3", "#74c476", "#31a354", "#006d2c")),
    "fire": (_FOUR, ("#5E0700", "#EF4712", "#DC6902", "#F09C00", "#F2F7F0")),
    "glacier": (_FOUR, ("#045a8d", "#2b8cbe", "#74a9cf", "#bdc9e1", "#f1eef6")),
    "scaled": (_FOUR, ("#fed976", "#fd8d3c", "#fd8d3c", "#f03b20", "#bd0026")),
    "iNaturalist": (_CLASSIC, ("#F7005A", "#D50067", "#B5006C", "#94006A", "#72005F", "#52034E")),
    "red": ((), ("#cc0000",)),
    "outline": ((), ("#7b7b7b",)),
    "blue": ((), ("#209fff",)),
    "orange": ((), ("#FF6347",)),
    "purpleHeat": ((), ("#FF21FD",)),
    "blueHeat": ((), ("#206EFF",)),
    "orangeHeat": ((), ("#C06719",)),
    "greenHeat": ((), ("#369617",)),
}
WIDTHS = {"marker": (_CLASSIC, (4, 8, 12, 14, 16, 25)), "scaled": (_FOUR, (6, 7, 10, 16, 30))}
#: From which zoom a heat point has what width.
HEAT = ((11, 3.45), (12, 6.25), (13, 9.88), (14, 15.63), (15, 24.71))
#: The ramp of each named style.
STYLES = {
    "classic.point": "classic", "classic.poly": "classic", "classic-noborder.poly": "classic", "purpleYellow.point": "purpleYellow", "purpleYellow.poly": "purpleYellow", "purpleYellow-noborder.poly": "purpleYellow",
    "green.point": "green", "green.poly": "green", "green-noborder.poly": "green", "outline.poly": "outline", "blue.marker": "blue", "orange.marker": "orange", "scaled.circles": "scaled", "fire.point": "fire", "glacier.point": "glacier",
    "green2.poly": "green2", "green2-noborder.poly": "green2", "iNaturalist.poly": "iNaturalist", "purpleWhite.poly": "purpleWhite", "red.poly": "red",
    "purpleHeat.point": "purpleHeat", "blueHeat.point": "blueHeat", "orangeHeat.point": "orangeHeat", "greenHeat.point": "greenHeat",
}


def _step(total: Column, ends: tuple, values: tuple) -> Column:
    out = F.lit(values[-1])
    for end, value in reversed(list(zip(ends, values, strict=False))):
        out = F.when(total <= end, F.lit(value)).otherwise(out)
    return out


def style_name(name: str | None) -> str:
    return name if name in STYLES else "classic.point"


def style_class(total: Column, style: str) -> Column:
    """Number of a total's class, from 0."""
    ends = RAMPS.get(STYLES.get(style, style), ((), ()))[0]
    return _step(total, ends, tuple(range(len(ends) + 1)))


def colour(total: Column, style: str) -> Column:
    return _step(total, *RAMPS[STYLES.get(style, style)])


def width(total: Column, kind: str) -> Column:
    return _step(total, *WIDTHS[kind])


def heat_width(zoom: int, least: float = 3.45) -> float:
    return max([least, *(w for z, w in HEAT if zoom >= z)])
