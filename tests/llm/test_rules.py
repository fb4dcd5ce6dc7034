"""URL filters (7), quality rules (10) and the pipeline."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mapweave.llm import decontaminate, jaccard, quality, queries, secrets, urls


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.queries()[name](spark, sf)
    result = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(row[i] for i in at) for row in result.fetchall())


def judged(spark, rows, listed=urls.LISTED):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(rows)], "page_id long, url string, host string, path string")
    return [tuple(r)[1:] for r in urls.judged(pages, spark.createDataFrame([(u,) for u in listed], "url string")).orderBy("page_id").collect()]


def test_url_parts_and_rules(spark):
    rows = [None, "nope", "http://A.Example.org/es/x?y", "http://x.org", "a://b://c/d", "http://example.org/en/12#z", "http://sub.example.com/fr/", "http://example.com/de/?q", "", "http://", "http://org/x"]
    assert judged(spark, rows) == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"), ("x.org", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("example.org", "/en/12", "example.org/en/1", "block"), ("sub.example.com", "/fr/", "com/fr/", "allow"), ("example.com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/x", "org/", "allow"),
    ]


def test_listed_urls(spark):
    listed = ["http://www.bad.net/", "https://one.net/page/", "http://one.net/page"]
    rows = ["http://www.bad.net/x", "http://m.bad.net", "http://notbad.net/", "http://one.net/page/?q", "http://one.net/page2", "http://www.one.net/page"]
    assert [v for *_, v in judged(spark, rows, listed)] == ["block", "block", "allow", "block", "allow", "block"]
    assert [v for *_, v in judged(spark, rows, [])] == ["allow"] * 6 and judged(spark, [], listed) == []


def test_every_site_of_the_kind_is_listed(spark, sf):
    """All hosts with a hyphen are sites of this kind; one that no rule fits is blocked by the list."""
    for part in (sf, sf.replace("0.001", "0.01"), sf.replace("0.001", "0.1")):
        rows = urls.judged(spark.read.parquet(f"{part}/pages.parquet"), urls.listed_urls(spark)).where(F.col("rule").isNull()).collect()
        hosts = {r.host for r in rows if "-" in r.host}
        assert hosts and all((r.verdict == "block") == (r.host in hosts) for r in rows)


def test_list_of_many_blocks(spark):
    listed = [f"http://s{i}.example.net/" for i in range(1000)]
    rows = [f"http://{w}s{i}.example.net/x" for w in ("", "m.") for i in range(0, 2000, 50)]
    assert [v for *_, v in judged(spark, rows, listed)] == ["block" if i < 1000 else "allow" for _ in range(2) for i in range(0, 2000, 50)]


def test_registered_list_has_pages_and_sites(spark):
    """Thousands of listed pages: their own URLs are blocked in any spelling, others of the same host are not."""
    listed = urls.listed_urls(spark)
    assert listed.distinct().count() == len(urls.LISTED) + len(urls.NAMES) * len(urls.TOPS) * urls.MIRRORS > 4000
    pages = spark.createDataFrame([(1, "https://www.CASINO-win-7.example.net/es/oferta/7/?x=1"), (2, "http://casino-win-7.example.net/es/oferta/8"), (3, "http://casino-win-7.example.net/"), (4, "http://x.casino-win.example.net/any")], "page_id long, url string")
    got = urls.judged(pages.withColumns({"key": F.lit(1), "block": F.lit(2), "hit_host": F.lit("z"), "w0": F.lit(3)}), listed, rules=())
    assert [r.verdict for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow", "block"]


def test_filter_removes_most_and_the_join_the_rest(spark, sf):
    """Of the registered query's keys few pass by chance, and none of those is blocked."""
    sf = sf.replace("0.001", "0.1")
    entries = urls.with_parts(urls.listed_urls(spark)).select(urls.canonical(F.col("host"), F.col("path")).alias("key"))
    blocks = -(-entries.count() * urls.BITS_PER_KEY // 512)
    asked = urls.with_parts(spark.read.parquet(f"{sf}/pages.parquet").select("url")).where("host <> ''").select(F.explode(urls.keys(F.col("host"), F.col("path"))).alias("key")).distinct()
    passed = urls.passed(asked, urls.bloom(entries, blocks), blocks)
    n, maybe, sure = asked.count(), passed.count(), passed.join(entries, "key", "left_semi").count()
    print(f"{n} keys, {maybe} pass the filter, {maybe - sure} of them by chance")
    assert blocks > 100 and 0 < sure <= maybe <= sure + 0.01 * n


def test_filter_passes_every_listed_key_and_few_others(spark):
    listed = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 2000 * urls.BITS_PER_KEY // 512
    words = urls.bloom(listed, blocks)
    assert urls.passed(listed, words, blocks).count() == 2000
    assert urls.passed(spark.range(20_000).select(F.concat(F.lit("n"), F.col("id")).alias("key")), words, blocks).count() < 200


def brute_stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    times, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [0] * len(w)
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered[i : i + 3] = [1] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(covered), len(lines)


def test_statistics(docs, plain, edge):
    rows = Counter((i, *brute_stats(t)) for i, t in plain)
    assert Counter(map(tuple, quality.stats(docs).select("doc_id", *quality.STATS).collect())) == rows
    rows = Counter((r.doc_id, *brute_stats(r.text or "")) for r in edge.select("doc_id", "text").collect())
    assert Counter(map(tuple, quality.stats(edge).select("doc_id", *quality.STATS).collect())) == rows


def test_quality_edges(edge, empty):
    assert quality.report(edge).count() == edge.count() and quality.report(empty).count() == 0
    kept = quality.passing(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {5} and quality.passing(empty).count() == 0


def test_clean_documents_pass_and_junk_fails(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1) and not any(r.kept for r in rows if r.quality == 0)


def test_buckets_are_close(spark):
    rows = spark.range(0, 5000).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r.b <= r.id and r.id - r.b <= max(0, r.id / 32) for r in rows) and all(r.b == r.id for r in rows[:64])


def test_pipeline(spark, sf, tmp_path):
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert spark.read.parquet(str(tmp_path / str(k))).columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = spark.read.parquet(str(tmp_path / str(k)))
        ids = {r.doc_id for r in after.collect()}
        if k == 0:
            assert ids == {r.doc_id for r in quality.report(docs).where("kept").collect()}
        elif k == 1:
            assert ids == {r.doc_id for r in jaccard.joined(docs).where("doc_id = class_id").collect()}
        elif k == 2:
            assert ids == before - {r.doc_id for r in decontaminate.matches(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        else:
            assert ids == before
        if k == 3:
            assert secrets.found(after).where("n_assign + n_access + n_hex > 0").count() == 0
        docs = after
        counts.append(len(ids))
    assert counts == sorted(counts, reverse=True) and corpus_pipeline.run(spark, sf).count() == counts[-1]
