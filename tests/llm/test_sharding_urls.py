import zlib

from docloom.llm.registry import oracle_sql, queries
from docloom.llm.sharding import byte_shards
from docloom.llm.urlfilter import canonical, listed_urls, parts, rule_verdict
from pyspark.sql import functions as F

import duckdb


def test_shards_match_a_plain_walk(spark, sf):
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    got = {r.doc_id: r for r in queries()["op7_sharding"](spark, sf).collect()}
    total = sum(len(t.encode()) + 1 for _, t in docs)
    before, slots = 0, {}
    for doc_id, text in docs:
        size = len(text.encode()) + 1
        shard = min(7, 8 * (2 * before + size) // (2 * total))
        assert (got[doc_id].size, got[doc_id].shard, got[doc_id].slot) == (size, shard, slots.get(shard, 0))
        assert got[doc_id].text_crc32 == zlib.crc32(text.encode()) and got[doc_id].grown_shard is None
        slots[shard] = slots.get(shard, 0) + 1
        before += size


def test_shards_of_odd_rows(spark, odd_docs):
    rows = odd_docs.select(F.col("doc_id"), F.lit(3).cast("long").alias("size"), F.col("node").alias("tie"))
    out = byte_shards(rows, 4, ["doc_id", "tie"]).collect()
    assert len(out) == 12 and sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(4) for i in range(3)]
    assert byte_shards(rows.limit(0), 4, ["doc_id", "tie"]).count() == 0


def test_urls_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({oracle_sql()['op9_url_filter']})").fetchall()))
    got = queries()["op9_url_filter"](spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_odd_urls(spark):
    urls = [None, "", "example.net/x", "http://A.Example.NET/en/1", "http://example.net?x=/en/", "x://example.com/de/#f", "http://notexample.com/de/", "a://b://c/d", "http://org/fr/", "http://w.org/de"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = parts(F.col("url"))
    rule, verdict = rule_verdict(F.col("host"), F.col("path"))
    got = [tuple(r) for r in rows.select(host.alias("host"), path.alias("path")).select("host", "path", rule, verdict).collect()]
    assert got == [
        ("", "", None, None), ("", "", None, None), ("", "", None, None), ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "", None, None),
        ("example.com", "/de/", "example.com/de/", "block"), ("notexample.com", "/de/", None, None), ("b:", "//c/d", None, None), ("org", "/fr/", "org/fr/", "allow"), ("w.org", "/de", None, None),
    ]


def test_listed_urls_are_exact(spark):
    pages = spark.createDataFrame([(i, f"h{i % 700}.example/{i}", "x") for i in range(3000)] + [(3000, None, "x"), (3001, "", "x"), (3002, "h1.example/1", "x")], "page_id long, canonical string, url string")
    listed = spark.createDataFrame([(f"h{i % 700}.example/{i}",) for i in range(0, 3000, 3)] + [("h1.example/1",), (None,), ("",), ("h0.example/0",)], "url string")
    got = {r.page_id: r.is_listed for r in listed_urls(pages, listed).collect()}
    assert got == {i: i % 3 == 0 or i == 1 for i in range(3000)} | {3000: False, 3001: False, 3002: True}
    assert not any(r.is_listed for r in listed_urls(pages, listed.limit(0)).collect())
    spelled = spark.createDataFrame([("www.a.com:80", "/x/index.html"), ("m.a.com", "/x/")], "h string, p string")
    assert [r[0] for r in spelled.select(canonical(F.col("h"), F.col("p"))).collect()] == ["a.com/x", "a.com/x"]


def test_shards_beside_columns_of_the_same_names(spark):
    names = ["shard", "slot", "_part", "_bytes", "_sum", "_row", "_at", "_first", "_total"]
    rows = spark.createDataFrame([(i, 2 + i % 3, *["keep"] * len(names)) for i in range(40)], "doc_id long, size long, " + ", ".join(f"{n} string" for n in names))
    out = byte_shards(rows, 3, ["doc_id"])
    assert out.columns == [*rows.columns, "_shard", "_slot"]
    plain = {r.doc_id: (r.shard, r.slot) for r in byte_shards(rows.select("doc_id", "size"), 3, ["doc_id"]).collect()}
    found = out.collect()
    assert {r.doc_id: (r["_shard"], r["_slot"]) for r in found} == plain and all(r[n] == "keep" for r in found for n in names)


def test_equal_sizes_are_cut_evenly(spark):
    rows = spark.createDataFrame([(i, 7) for i in range(24)], "doc_id long, size long")
    assert sorted((r.doc_id, r.shard, r.slot) for r in byte_shards(rows, 4, ["doc_id"]).collect()) == [(i, i // 6, i % 6) for i in range(24)]


def test_listed_urls_beside_columns_of_the_same_names(spark):
    names = ["block", "b0", "f0", "hit", "possible", "is_listed", "url"]
    pages = spark.createDataFrame([(i, f"h/{i}", *["keep"] * len(names)) for i in range(50)], "page_id long, canonical string, " + ", ".join(f"{n} string" for n in names))
    listed = spark.createDataFrame([(f"h/{i}",) for i in range(0, 50, 4)], "url string")
    out = listed_urls(pages, listed)
    assert out.columns == [*pages.columns, "_is_listed"]
    assert {r.page_id: r["_is_listed"] for r in out.collect()} == {i: i % 4 == 0 for i in range(50)} and out.where("block = 'keep' AND is_listed = 'keep' AND url = 'keep'").count() == 50
    assert listed_urls(pages.limit(0), listed).collect() == []
