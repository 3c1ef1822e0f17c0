import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clausemill.llm.warc import RECORD, canonical_url, resolve_revisits, with_bodies

START = datetime(2024, 1, 1)


def brute(rows):
    out = {}
    for rid, url, ts, kind, _, etag, _, digest, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[4] in (200, None) and url and r[1] == url and ts and r[2] and (r[2], r[0]) < (ts, rid)]
        best = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        votes = [(a == b) for a, b in ((etag, best[5]), (digest, best[7])) if a and b] if best else []
        out[rid] = (best and best[0], "missing" if not best else "changed" if False in votes else "matched" if True in votes else "unchecked")
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        url = r.choice(["http://a.org/x", "http://b.org/y", "http://hot.org/z", "http://hot.org/z", None])
        ts = r.choice([START + timedelta(minutes=r.randint(0, 3000)), None]) if r.random() < 0.1 else START + timedelta(minutes=r.randint(0, 3000))
        rows.append((i, url, ts, r.choice(["response", "revisit"]), r.choice([200, 200, None, 404]), r.choice(['"a"', 'W/"a"', None]) and r.choice(['"a"', '"b"', None]), None, r.choice(["d", "e", None]), None))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {x.record_id: (x.response_id, x.outcome) for x in resolve_revisits(spark.createDataFrame(rows, RECORD).repartition(3)).collect()}
            assert got == brute(rows), parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_url_and_one_time_are_split_over_ranges(spark):
    """All captures are of one URL at one time, half of them responses: the record id alone orders and splits them."""
    from clausemill.operators.relational import range_bounds, range_of

    n = 4000
    rows = spark.range(n).select(
        F.col("id").alias("record_id"), F.lit("http://hot.org/").alias("url"), F.lit(START).alias("ts"), F.when(F.col("id") % 2 == 0, "response").otherwise("revisit").alias("kind"), F.lit(200).alias("status"),
        F.lit('"a"').alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"),
    )
    assert {(r.record_id, r.response_id, r.outcome) for r in resolve_revisits(rows).collect()} == {(i, i - 1, "matched") for i in range(1, n, 2)}
    bounds = range_bounds(rows, ["url", "ts", "record_id"])
    parts = rows.crossJoin(bounds).groupBy(range_of(F.col("__bounds"), F.struct("url", "ts", "record_id"), 100).alias("p")).count().collect()
    assert len(parts) == 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) and max(p["count"] for p in parts) < n / 2


def test_header_names_that_repeat_long_maps_and_clashing_columns(spark):
    rows = [
        (1, "http://a.org/", START, "response", 200, '"v1"', None, None, {"ETag": '"v1"', "etag": '"v1"', "Via": "b", "via": "c", "X": None}),
        (2, "http://a.org/", START + timedelta(days=1), "revisit", 304, '"v1"', None, None, {"DATE": "1", "Date": "2", "date": "1"}),
        (3, "http://b.org/" + "x" * 1_000_000, START, "response", 200, '"v1"', None, None, {f"h{i}": "v" * 1000 for i in range(300)}),
        (4, "http://b.org/" + "x" * 1_000_000, START + timedelta(days=1), "revisit", 304, '"v1"', None, None, None),
    ]
    clash = spark.createDataFrame(rows, RECORD).withColumns({"part": F.lit(1), "found": F.lit(2), "full": F.lit(3), "url_key": F.lit(4)})
    clash = clash.toDF(*clash.columns).select("*", F.lit("x").alias("URL"), F.lit("y").alias("Headers"))
    got = {r.record_id: r for r in resolve_revisits(clash).collect()}
    assert got[2].headers == {"etag": '"v1"', "via": "b, c", "x": None, "date": "1, 2"} and len(got[4].headers) == 300


def test_canonical_urls(spark):
    urls = ["HTTP://www.A.org:80/x/?b=2&a=1&utm_source=q#top", "https://a.org/x?a=1&b=2", "a.org/x/?a=1&b=2&ref=z", "http://user:pw@a.org", "https://A.org/", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(canonical_url(F.col("u"))).collect()]
    assert got == ["a.org/x?a=1&b=2"] * 3 + ["a.org/"] * 2 + [None, "/"]


def test_headers_and_bodies(spark):
    rows = [
        (1, "http://a.org/", START, "response", 200, '"v1"', None, None, {"Content-Type": "text/html", "ETag": '"v1"', "Date": "old", "X-Own": "1"}),
        (2, "https://www.a.org", START + timedelta(days=9), "revisit", 304, 'W/"v1"', None, None, {"date": "new", "content-type": "text/plain", "expires": "soon", "x-other": "2"}),
        (3, "https://www.a.org", START + timedelta(days=10), "revisit", 304, '"v2"', None, None, None),
    ]
    done = resolve_revisits(spark.createDataFrame(rows, RECORD))
    got = {x.record_id: x for x in done.collect()}
    assert got[2].headers == {"content-type": "text/html", "etag": '"v1"', "date": "new", "x-own": "1", "expires": "soon"}
    assert got[3].outcome == "changed" and got[3].headers is None
    bodies = spark.createDataFrame([(1, "<p>")], "record_id long, body string")
    assert [(x.record_id, x.body) for x in with_bodies(done, bodies).collect()] == [(2, "<p>")]
    assert resolve_revisits(spark.createDataFrame([], RECORD)).collect() == []
