"""URL rules, and a blocked Bloom filter of listed canonical URLs in DataFrame functions only.

A canonical URL is host and path without scheme, ``www.``, query, fragment and last slash; a site is
listed as ``host/`` and stands for its subdomains too. Every page asks for its canonical URL and its
host's suffixes. The filter has blocks of eight 64-bit words, built by a grouped ``bit_or``; a key sets
one bit in each word of one block, so a probe is one equi-join on the block number and eight masks.
What passes is joined by hash with the list itself, which removes false positives: the filter decides
how much is joined, never the result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.session import checkpointed

WORDS, BITS_PER_KEY = 8, 16
#: Filters up to this many blocks of 72 bytes are broadcast; larger ones are joined by Spark's own choice.
BROADCAST_BLOCKS = 100_000
#: Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The registered query's list. First sites: the six advertising and spam names among the hosts of ``pages``, all
#: that have a hyphen, under each top-level domain that occurs there.
NAMES, TOPS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"), ("com", "net", "org")
LISTED = tuple(f"http://{name}.example.{top}/" for name in NAMES for top in TOPS)
#: Then single pages, made by rule: of each site so many numbered mirrors, each with one path.
MIRRORS, MIRROR_PATHS = 250, ("en/offer", "de/angebot", "fr/offre", "es/oferta")


def with_parts(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """The pages with host and path added; both empty where the URL is null or has no ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    out = pages.withColumn("__rest", F.coalesce(rest, F.lit("")))
    out = out.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    return out.withColumns({
        host: F.translate("__host", string.ascii_uppercase, string.ascii_lowercase),
        path: F.regexp_extract(F.substr(F.col("__rest"), F.length("__host") + 1), "^[^?#]*", 0),
    }).drop("__rest", "__host")


def canonical(host: Column, path: Column) -> Column:
    bare = F.regexp_replace(host, "^www\\.", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", ""), F.lit("/")))


def keys(host: Column, path: Column) -> Column:
    """What a page asks for: its canonical URL, and its host from each label on."""
    labels = F.split(host, "\\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.when(host != "", F.array_distinct(F.array_append(sites, canonical(host, path))))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit of each word, from six bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(6 * i)).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column ``key``: rows (block, w0 ... w7) for blocks with a key."""
    return listed.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"m{i}") for i, m in enumerate(_masks(F.col("key"))))).groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def passed(asked: DataFrame, words: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``asked`` (with a column ``key``) that the filter lets pass."""
    probe = asked.withColumn("block", _block(F.col("key"), blocks))
    hit = probe.join(words, "block")
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit.where(F.col(f"w{i}").bitwiseAND(m) == m)
    return hit.select(*asked.columns)


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, the longest rule that fits, and the verdict: the rule's, else the list's.

    ``listed`` has a column ``url``. Null and empty URLs and those without ``://`` have no host, fit no rule and are
    allowed; very long ones are judged whole. Repeated pages are judged each, null page ids too; an empty list blocks
    nothing; an empty table gives an empty result. Other columns, whatever their names, are dropped. Of rules of equal
    length the first wins.
    """
    split = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path")
    entries = with_parts(listed.select(F.col("url"))).select(canonical(F.col("host"), F.col("path")).alias("key")).where(F.col("key").isNotNull()).distinct()
    entries = checkpointed(entries)
    n = entries.count()
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS)))
    words = bloom(entries, blocks)
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    asked = split.select("host", "path").where(F.col("host") != "").withColumn("key", F.explode(keys(F.col("host"), F.col("path"))))
    possible = passed(asked, words, blocks)
    hits = possible.join(entries, "key", "left_semi").select(F.col("host").alias("hit_host"), F.col("path").alias("hit_path")).distinct()
    joined = split.join(hits, (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")), "left")
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("hit_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    for what, host, path in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def listed_urls(spark) -> DataFrame:
    """The registered query's list: the sites, and the pages of their numbered mirrors."""
    sites = spark.createDataFrame([(x,) for x in LISTED], "url string")
    names = spark.createDataFrame([(name, top) for name in NAMES for top in TOPS], "name string, top string")
    paths = F.array(*(F.lit(p) for p in MIRROR_PATHS))
    mirrors = names.select("name", "top", F.explode(F.sequence(F.lit(0), F.lit(MIRRORS - 1))).alias("k"))
    return sites.union(mirrors.select(F.concat(F.lit("http://"), "name", F.lit("-"), "k", F.lit(".example."), "top", F.lit("/"), F.get(paths, F.col("k") % len(MIRROR_PATHS)), F.lit("/"), "k")))
