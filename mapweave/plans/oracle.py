"""DuckDB SQL for the registered queries, over the raw tables."""

from __future__ import annotations

import math

from mapweave.functions import projection as P
from mapweave.sources.occurrence import BASES


def occurrences() -> str:
    """The occurrence view and what the base filter leaves of it, as ``occ``."""
    bases = " ".join(f"when {i} then '{b}'" for i, b in enumerate(BASES))
    return f"""
    allocc as (select c_mktsegment as datasetKey, concat('org-', cast(s_suppkey % 20 as varchar)) as publishingOrgKey, sn.n_name as publishingCountry,
      case l_returnflag when 'A' then [sr.r_name] when 'R' then [sr.r_name, o_orderpriority] end as networkKey, cn.n_name as countryCode,
      case l_partkey % 9 {bases} end as basisOfRecord,
      case when l_suppkey % 50 = 0 then null else (cn.n_nationkey*37 % 151) - 75 + ((l_orderkey*31 + l_linenumber*7) % 21 - 10)/8.0::double + 0.0137::double end as decimalLatitude,
      (cn.n_nationkey*83 % 355) - 178 + ((l_partkey*13 + l_suppkey) % 21 - 10)/8.0::double + 0.0071::double as decimalLongitude,
      case when l_orderkey % 11 = 0 then null else cast(year(l_shipdate) as int) end as year,
      case when o_orderstatus = 'P' then 'ABSENT' else 'PRESENT' end as occurrenceStatus, l_linenumber = 7 as hasGeospatialIssues,
      map {{'chk-a': [p_type, p_brand, concat('part-', cast(p_partkey as varchar))], 'chk-b': [p_brand, cast(null as varchar)]}} as classifications
      from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
      join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join region sr on sn.n_regionkey = sr.r_regionkey join part on l_partkey = p_partkey),
    occ as (select * from allocc where decimalLatitude is not null and decimalLongitude is not null and hasGeospatialIssues = false and occurrenceStatus = 'PRESENT')"""


CODE = "case basisOfRecord " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(BASES)) + " end"
BOR_YEAR = f"(coalesce(year, 0) * 100 + {CODE})"
NON_TAXON = "list_distinct(list_filter(list_concat(['0:0', '2:'||datasetKey, '3:'||publishingOrgKey, '4:'||countryCode, '5:'||publishingCountry], list_transform(coalesce(networkKey, []), lambda n: '6:'||n)), lambda k: k is not null))"
TAXON = "list_distinct(list_filter(flatten(list_transform(map_entries(classifications), lambda e: list_transform(e.value, lambda t: '1:'||e.key||'|'||t))), lambda k: k is not null))"


def xy(epsg: str, size: int, z: int) -> tuple[str, str]:
    """Global pixels as doubles."""
    pixels = repr(float(size << z)) + "::double"
    d = lambda v: f"{v!r}::double"
    lat, lng = "decimalLatitude", "decimalLongitude"
    rad = d(math.pi / 180)
    if epsg == "EPSG:3857":
        s = f"sin({lat} * {rad})"
        return f"(({lng} + 180) / 360 * {pixels})", f"(({d(0.5)} - ln((1 + {s}) / (1 - {s})) / {d(4 * math.pi)}) * {pixels})"
    if epsg == "EPSG:4326":
        per = d(float(size << z) / 180)
        return f"(({lng} + 180) * {per})", f"((-{lat} + 90) * {per})"
    if epsg == "EPSG:3575":
        s = f"sin({lat} * {rad})"
        q = f"({d(1 - P.E2)} * ({s} / (1 - {d(P.E2)} * {s} * {s}) - ln((1 - {d(P.E)} * {s}) / (1 + {d(P.E)} * {s})) / {d(2 * P.E)}))"
        rho, turn, extent = f"({d(P.A)} * sqrt(greatest({d(P.Q_POLE)} - {q}, 0.0::double)))", f"(({lng} - 10) * {rad})", P.ARCTIC_EXTENT
        x, y = f"{rho} * sin({turn})", f"-{rho} * cos({turn})"
    else:
        phi = f"(-{lat} * {rad})"
        s = f"({d(P.E)} * sin({phi}))"
        rho, turn, extent = f"({d(P.STEREO)} * (tan({d(math.pi / 4)} - {phi} / 2) / pow((1 - {s}) / (1 + {s}), {d(P.E / 2)})))", f"({lng} * {rad})", P.ANTARCTIC_EXTENT
        x, y = f"{rho} * sin({turn})", f"{rho} * cos({turn})"
    k = d(float(size << z) / (2 * extent))
    return f"(({x} + {d(extent)}) * {k})", f"({pixels} - ({y} + {d(extent)}) * {k})"


def plottable(epsg: str) -> str:
    low, high = {"EPSG:3857": (-P.MERCATOR_LIMIT, P.MERCATOR_LIMIT), "EPSG:4326": (-90.0, 90.0), "EPSG:3575": (0.0, 90.0), "EPSG:3031": (-90.0, 0.0)}[epsg]
    return f"(decimalLatitude between {low!r}::double and {high!r}::double and decimalLongitude between -180 and 180)"


def pixels(epsg: str, z: int, keys: str = "['0:0']", size: int = 512, name: str = "pixels") -> str:
    """Counted pixels as a common table after ``occurrences``."""
    x, y = xy(epsg, size, z)
    return f"""{name} as (select mapKey, x, y, borYear, count(*) as occCount from (select unnest({keys}) as mapKey, cast(trunc({x}) as int) as x, cast(trunc({y}) as int) as y, {BOR_YEAR} as borYear
      from occ where {plottable(epsg)}) group by all)"""


def tiles(epsg: str, source: str, size: int = 512, buffer: int = 64, name: str = "tiles") -> str:
    """Buffered and clipped tile rows of (mapKey, z, x, y, borYear, occCount) rows: every tile that a pixel is near.

    Written from the other side than the engine does: of the nine tiles around the pixel's own, those
    in whose buffered square it lies, the date line taken into account.
    """
    s = P.SCHEMAS[epsg]
    lx = "(x - nx * %d)" % size
    wrap = f"case when {str(s.wraps).lower()} and ({s.wide} > 1 or z > 0) and nx = 0 and x >= w * {size} - {buffer} then x - w * {size} when {str(s.wraps).lower()} and ({s.wide} > 1 or z > 0) and nx = w - 1 and x < {buffer} then x + w * {size} - nx * {size} else {lx} end"
    return f"""{name} as (select mapKey, z, tileX, tileY, pixelX, pixelY, bor, year, sum(occCount) as cnt from (
      select distinct mapKey, z, x, y, borYear, occCount, nx as tileX, ny as tileY, {wrap} as pixelX, y - ny * {size} as pixelY, ['{"','".join(BASES)}'][borYear % 100 + 1] as bor, borYear // 100 as year from (
        select *, ((tx + dx) % w + w) % w as nx, ((ty + dy) % h + h) % h as ny from (
          select *, {s.wide} << z as w, {s.high} << z as h, least(x // {size}, ({s.wide} << z) - 1) as tx, least(y // {size}, ({s.high} << z) - 1) as ty from {source}), (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy)
        where (dx = 0 or (dx = -1 and x - tx * {size} < {buffer}) or (dx = 1 and x - tx * {size} >= {size} - {buffer})) and (dy = 0 or (dy = -1 and y - ty * {size} < {buffer}) or (dy = 1 and y - ty * {size} >= {size} - {buffer}))))
      where pixelX between -{buffer} and {size} + {buffer} and pixelY between -{buffer} and {size} + {buffer} group by all)"""


def pyramid(zoom: int, lowest: int, source: str = "pixels", name: str = "pyramid") -> str:
    return f"""{name} as (select mapKey, z, x >> ({zoom} - z) as x, y >> ({zoom} - z) as y, borYear, sum(occCount) as occCount from {source}, (select unnest(range({lowest}, {zoom + 1}))::int as z) group by all)"""


def with_(*tables: str) -> str:
    return "with " + ", ".join([occurrences(), *tables]) + " "
