"""Occurrence records: a view derived from the test tables, the columns kept, and the base filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that anything downstream reads; the scan prunes the rest.
COLUMNS = ("datasetKey", "publishingOrgKey", "publishingCountry", "networkKey", "countryCode", "basisOfRecord", "decimalLatitude", "decimalLongitude", "year", "occurrenceStatus", "hasGeospatialIssues", "classifications")
#: Code of each basis of record in the packed year, which is its place in this list.
BASES = ("PRESERVED_SPECIMEN", "MACHINE_OBSERVATION", "OCCURRENCE", "HUMAN_OBSERVATION", "LIVING_SPECIMEN", "OBSERVATION", "MATERIAL_CITATION", "MATERIAL_SAMPLE", "FOSSIL_SPECIMEN")

_VIEW = """
select c_mktsegment as datasetKey,
  concat('org-', cast(s_suppkey % 20 as string)) as publishingOrgKey,
  sn.n_name as publishingCountry,
  case l_returnflag when 'A' then array(sr.r_name) when 'R' then array(sr.r_name, o_orderpriority) end as networkKey,
  cn.n_name as countryCode,
  case l_partkey % 9 {bases} end as basisOfRecord,
  case when l_suppkey % 50 = 0 then null else (cn.n_nationkey*37 % 151) - 75
    + ((l_orderkey*31 + l_linenumber*7) % 21 - 10)/8.0D + 0.0137D end as decimalLatitude,
  (cn.n_nationkey*83 % 355) - 178 + ((l_partkey*13 + l_suppkey) % 21 - 10)/8.0D + 0.0071D as decimalLongitude,
  case when l_orderkey % 11 = 0 then null else cast(year(l_shipdate) as int) end as year,
  case when o_orderstatus = 'P' then 'ABSENT' else 'PRESENT' end as occurrenceStatus,
  l_linenumber = 7 as hasGeospatialIssues,
  map('chk-a', array(p_type, p_brand, concat('part-', cast(p_partkey as string))), 'chk-b', array(p_brand, cast(null as string))) as classifications
from {lineitem}
join {orders} on l_orderkey = o_orderkey
join {customer} on o_custkey = c_custkey
join {nation} cn on c_nationkey = cn.n_nationkey
join {supplier} on l_suppkey = s_suppkey
join {nation} sn on s_nationkey = sn.n_nationkey
join {region} sr on sn.n_regionkey = sr.r_regionkey
join {part} on l_partkey = p_partkey
"""


def read_occurrences(spark: SparkSession, source: str) -> DataFrame:
    """A table of the catalog, or a folder of Parquet files."""
    return (spark.read.parquet(source) if "/" in source else spark.table(source)).select(*COLUMNS)


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view over the tables of ``sf_dir``."""
    bases = " ".join(f"when {i} then '{b}'" for i, b in enumerate(BASES))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "nation", "supplier", "region", "part")}
    return spark.sql(_VIEW.replace("{bases}", bases), **tables)


def base_filter(occurrences: DataFrame) -> DataFrame:
    """Records that can be on a map, with comparisons on bare columns so that they reach the scan."""
    return occurrences.where(F.col("decimalLatitude").isNotNull() & F.col("decimalLongitude").isNotNull() & (F.col("hasGeospatialIssues") == F.lit(False)) & (F.col("occurrenceStatus") == "PRESENT"))


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_filter(fixture(spark, sf_dir))


#: Events as records on a map, in SQL that both engines read: place from the user and the event, year from the time.
EVENTS_SQL = """select event_type as basisOfRecord, (user_id * 37 % 151) - 75 + (event_id % 21 - 10) / cast(8 as double) + cast('0.0137' as double) as decimalLatitude,
  (user_id * 83 % 355) - 178 + ((event_id * 13 + user_id) % 21 - 10) / cast(8 as double) + cast('0.0071' as double) as decimalLongitude, cast(year(ts) as int) as year from events where value is not null"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, for ad-hoc maps."""
    return spark.sql(EVENTS_SQL.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
