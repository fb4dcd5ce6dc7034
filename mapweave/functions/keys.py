"""Map keys, the packed year and basis of record, and salted row keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.sources.occurrence import BASES

#: Type of a map key.
ALL, TAXON, DATASET, PUBLISHER, COUNTRY, PUBLISHING_COUNTRY, NETWORK = range(7)
ALL_KEY = "0:0"


def encode_bor_year(bor: Column, year: Column) -> Column:
    """``year * 100 + code``; null years count as 0, an unknown basis or a negative year gives null."""
    code = F.lit(None).cast("int")
    for i, name in enumerate(BASES):
        code = F.when(bor == name, i).otherwise(code)
    return F.when(F.coalesce(year, F.lit(0)) >= 0, F.coalesce(year, F.lit(0)) * 100 + code).cast("int")


def decode_year(packed: Column) -> Column:
    return F.greatest(F.call_function("div", packed, F.lit(100)).cast("int"), F.lit(0))


def decode_bor(packed: Column) -> Column:
    return F.get(F.array(*(F.lit(b) for b in BASES)), F.pmod(packed, F.lit(100)))


def non_taxon_keys(row: dict[str, Column] | None = None) -> Column:
    """Distinct keys of a record but for its taxa; null parts make no key."""
    c = (row or {}).get
    one = lambda kind, name: F.concat(F.lit(f"{kind}:"), c(name, F.col(name)))
    networks = F.transform(F.coalesce(c("networkKey", F.col("networkKey")), F.array().cast("array<string>")), lambda n: F.concat(F.lit(f"{NETWORK}:"), n))
    fixed = F.array(F.lit(ALL_KEY), one(DATASET, "datasetKey"), one(PUBLISHER, "publishingOrgKey"), one(COUNTRY, "countryCode"), one(PUBLISHING_COUNTRY, "publishingCountry"))
    return F.array_distinct(F.array_compact(F.concat(fixed, networks)))


def taxon_keys(classifications: Column) -> Column:
    """Distinct taxon keys over all checklists."""
    entries = F.map_entries(F.coalesce(classifications, F.create_map().cast("map<string,array<string>>")))
    keys = F.flatten(F.transform(entries, lambda e: F.transform(F.coalesce(e.value, F.array().cast("array<string>")), lambda t: F.concat(F.lit(f"{TAXON}:"), e.key, F.lit("|"), t))))
    return F.array_distinct(F.array_compact(keys))


def checklist_keys(classifications: Column, checklist: str) -> Column:
    """Distinct taxon keys of one checklist; none where the record is not in it."""
    taxa = F.coalesce(F.try_element_at(classifications, F.lit(checklist)), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(F.transform(taxa, lambda t: F.concat(F.lit(f"{TAXON}:{checklist}|"), t))))


def map_keys() -> Column:
    return F.concat(non_taxon_keys(), taxon_keys(F.col("classifications")))


def checklist_of(key: Column) -> Column:
    """The checklist in a taxon key, else null."""
    found = F.regexp_extract(key, r"^1:([^|]*)\|", 1)
    return F.when(key.rlike(r"^1:[^|]*\|"), found)


def java_hash(text: Column) -> Column:
    """The 31-polynomial string hash modulo 2**32, for characters of the basic plane."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(0xFFFFFFFF))


def salt(key: Column, modulus: int) -> Column:
    if modulus < 2:
        raise ValueError("a salt needs a modulus of two or more")
    return java_hash(key).bitwiseAND(0xFFFFFFF) % modulus


def salted(key: Column, modulus: int) -> Column:
    """``<zero-padded salt>:<key>``."""
    return F.concat(F.lpad(salt(key, modulus).cast("string"), len(str(modulus - 1)), "0"), F.lit(":"), key)


def row_key(key: str, modulus: int) -> tuple[int, str]:
    """Salt and salted key of one text on the driver: literals, which a read can prune and push."""
    h = 0
    for c in key:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    number = (h & 0xFFFFFFF) % modulus
    return number, f"{number:0{len(str(modulus - 1))}d}:{key}"


def salt_from(row_key: Column) -> Column:
    return F.try_to_number(F.split_part(row_key, F.lit(":"), F.lit(1)), F.lit("999999999")).cast("int")


def region_splits(modulus: int) -> list[str]:
    return [str(i).zfill(len(str(modulus - 1))) for i in range(1, modulus)]


def tile_key(key: Column, z: Column, x: Column, y: Column) -> Column:
    return F.concat_ws(":", key, z.cast("string"), x.cast("string"), y.cast("string"))
