"""Resolution of not-modified revisits in web archives.

A revisit record holds no body: it says that the page was as in an earlier capture. Each revisit is joined, as
of its time, to the latest earlier full response of the same canonical URL. Its validators (entity tag, last
modification, payload digest) are compared with that response's, and the headers that a 304 answer may update
replace the stored ones.

Captures are dealt into ranges of (URL, time, record id) by bounds that are fixed before, so a URL with very many
captures, also at one time, is split over tasks. The as-of join has two levels: inside a range by a window, and
from range to range by a window over one row for each range that a URL reaches, its last response there.

Outcomes: ``matched`` (a validator agrees and none differs), ``changed`` (one differs), ``unchecked`` (none can
be compared), ``missing`` (no earlier response).

Defined results for odd input: a revisit with a null URL or a null time is ``missing`` and enters no window; captures
at the same time are ordered by record id, null first, and those with one id too by their validators, kind and headers,
so a task that is run again finds the same; equal rows are captures of their own, of which any may come first; bytes of
a URL that are not UTF-8 become U+FFFD; null headers are none; header names are the same in any case of
letters, and of several fields with one name the distinct values are joined by ", " in order of the names as given; an
empty table gives an empty table; other columns are ignored, also ones whose names differ by case only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.llm.columns import let, picked, utf8
from clausemill.operators.relational import range_bounds, range_of

#: Header fields that a 304 answer may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "via", "warning")
#: Query parameters that do not name a page.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path in canonical form: no scheme, user, www, default port, fragment, tracking parameters or closing slash; sorted query."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?]*)", 1)), r"^www\d*\.", ""), r":(?:80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), r"/+$", "")
    asked = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    return F.concat(host, F.when(path == "", F.lit("/")).otherwise(path), F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(asked), "&"))).otherwise(""))


def _checked(mine: Column, theirs: Column) -> Column:
    """1 where two validators agree, -1 where they differ, 0 where one is missing. Weak entity tags compare by their value."""
    a, b = (F.regexp_replace(c, r"^W/", "") for c in (mine, theirs))
    return F.when(a.isNull() | b.isNull(), 0).when(a == b, 1).otherwise(-1)


def _by_name(headers: Column) -> Column:
    """Headers under lower-case names, one value each; none for null."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def of(e: Column) -> Column:
        told = lambda n: F.array_distinct(F.filter(F.transform(F.filter(e, lambda x: x["key"] == n), lambda x: x["value"]), lambda v: v.isNotNull()))
        names = F.array_distinct(F.transform(e, lambda x: x["key"]))
        return F.map_from_arrays(names, F.transform(names, lambda n: let(told(n), lambda v: F.when(F.size(v) > 0, F.array_join(v, ", ")))))

    return F.when(headers.isNotNull(), let(entries, of)).otherwise(F.expr("map()").cast("map<string,string>"))


def merged_headers(stored: Column, told: Column) -> Column:
    """The stored headers, with those replaced that the revisit may update; names in lower case."""
    old, new = _by_name(stored), F.map_filter(_by_name(told), lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


RECORD = "record_id long, url string, ts timestamp, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit of RECORD: record_id, url_key, ts, response_id, response_ts, outcome and headers."""
    # a total order of captures that differ in anything that is told or compared
    tie = F.struct(F.coalesce(F.to_json(F.struct("etag", "last_modified", "digest", "kind")), F.lit("")).alias("a"), F.array_sort(F.map_entries("headers")).alias("b"))
    own = F.struct("ts", "record_id", tie.alias("tie"), "etag", "last_modified", "digest", "headers")
    full = (F.col("kind") == "response") & (F.coalesce(F.col("status"), F.lit(200)) == 200)
    keyed = picked(records, **{c: c for c in (x.split()[0] for x in RECORD.split(", "))}).withColumn("url_key", canonical_url(utf8(F.col("url"))))
    placed = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    keyed = keyed.select("record_id", "kind", "ts", "etag", "last_modified", "digest", "headers", "url_key", placed.alias("placed"), tie.alias("tie"), F.when(full & placed, own).alias("full"))
    lost = keyed.where("NOT placed AND kind = 'revisit'").select("record_id", "url_key", "ts", "etag", "last_modified", "digest", "headers", F.lit(None).cast(keyed.schema["full"].dataType).alias("found"))
    keyed = keyed.where(F.col("placed") & (F.col("full").isNotNull() | (F.col("kind") == "revisit"))).drop("placed")

    by = ["url_key", "ts", "record_id"]
    bounds = range_bounds(keyed, by)
    most = len(bounds.first()["__bounds"])
    keyed = keyed.crossJoin(F.broadcast(bounds)).withColumn("part", range_of(F.col("__bounds"), F.struct(*by), most)).drop("__bounds")
    inside = Window.partitionBy("url_key", "part").orderBy("ts", "record_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    near = keyed.withColumn("near", F.last("full", ignorenulls=True).over(inside)).where("kind = 'revisit'").drop("full", "kind")
    stamp = F.struct(F.col("full.ts").alias("ts"), F.col("full.record_id").alias("id"), F.col("full.tie").alias("tie"))
    ends = keyed.where(F.col("full").isNotNull()).groupBy("url_key", "part").agg(F.max_by("full", stamp).alias("end"))
    # a range without responses still needs the last one before it
    asked = near.where(F.col("near").isNull()).select("url_key", "part").distinct()
    steps = ends.join(asked, ["url_key", "part"], "full")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.last("end", ignorenulls=True).over(before)).where(F.col("carried").isNotNull()).select("url_key", "part", "carried")
    told = near.join(carried, ["url_key", "part"], "left").withColumn("found", F.coalesce("near", "carried")).select(lost.columns).union(lost)
    votes = F.array(*[_checked(F.col(c), F.col(f"found.{c}")) for c in ("etag", "last_modified", "digest")])
    outcome = F.when(F.col("found").isNull(), "missing").when(F.array_contains(votes, -1), "changed").when(F.array_contains(votes, 1), "matched").otherwise("unchecked")
    return told.select(
        "record_id", "url_key", "ts", F.col("found.record_id").alias("response_id"), F.col("found.ts").alias("response_ts"), outcome.alias("outcome"),
        F.when(outcome == "matched", merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """The matched revisits with ``body``, from (record_id, body)."""
    known = picked(bodies, response_id="record_id", body="body")
    return resolved.where("outcome = 'matched'").join(known, "response_id")
