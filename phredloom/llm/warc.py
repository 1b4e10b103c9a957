"""Not-modified revisit resolution for WARC-style capture records.

A revisit record says "unchanged since an earlier capture". It is resolved by
an as-of join on the canonical URL to the latest full response that is
strictly earlier, then the validators of both are compared (ETag weakly, else
Last-Modified), and the headers that a 304 answer may update are merged into
those of the full response.

The as-of join keeps no URL in one task: time is cut into buckets of about as
many records each (quantiles, so that a stray date does not widen them), the
last response of each (URL, bucket) is found by a partial-aggregated maximum,
these few rows are carried forward over the buckets, and only inside (URL,
bucket) are rows ordered. Captures of one URL at the same instant collapse
first, since "strictly earlier" gives them one answer.

Record columns: record_id long, record_type string, uri string, ts timestamp,
etag string, last_modified string, headers map<string,string> (lower-case
names), digest string.

Defined results: status is ``resolved`` (validators agree), ``unverified`` (no
validator on both sides), ``mismatch`` (they differ), ``orphan`` (no earlier
response, or a null URI or time). Of several responses of one URL at one
instant the largest record_id counts. Null headers act as none. Repeated
revisits are resolved each for itself; URLs of any length count in whole; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a 304 answer may update, and query parameters that do not name a resource.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary"]
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]
TIME_BUCKETS = 1024


def canonical_url(uri: Column) -> Column:
    """Scheme dropped, host lower-cased without ``www.`` and default port, fragment and tracking parameters dropped, parameters sorted, no final slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(uri), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def time_bucket(ts: Column, records: DataFrame) -> Column:
    """Number of the quantile edges of ``records`` (at most ``TIME_BUCKETS``) up to a time, by bisection."""
    at = [i / TIME_BUCKETS for i in range(1, TIME_BUCKETS)]
    edges = records.agg(F.percentile_approx(F.unix_micros("ts"), F.array(*map(F.lit, at)), 10 * TIME_BUCKETS).alias("e")).first()["e"]  # one row
    edges = F.array(*(F.lit(x) for x in sorted(set(edges or [0]))))
    us, n = F.unix_micros(ts), F.size(edges)
    steps = F.sequence(F.lit(1), F.lit(TIME_BUCKETS.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(edges, mid) <= us)
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: its ids, the response it stands for, status and merged headers."""
    r = records.select(
        "record_id", "record_type", canonical_url(F.col("uri")).alias("url"), "ts", "etag", "last_modified",
        F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest",
    )
    usable = F.col("url").isNotNull() & F.col("ts").isNotNull()
    bucket = time_bucket(F.col("ts"), r.filter(usable))

    full = F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest")
    responses = (
        r.filter(usable & (F.col("record_type") == "response"))
        .groupBy("url", "ts")
        .agg(F.max_by(full, "record_id").alias("full"))
        .withColumn("bucket", bucket)
    )
    asked = r.filter(usable & (F.col("record_type") == "revisit")).select("url", "ts").distinct().withColumn("bucket", bucket)

    summary = responses.groupBy("url", "bucket").agg(F.max_by("full", "ts").alias("last"))
    marks = summary.unionByName(asked.select("url", "bucket").distinct(), allowMissingColumns=True)
    marks = marks.groupBy("url", "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carry"))

    events = responses.select("url", "ts", "bucket", "full").unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("url", "bucket").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    found = (
        events.withColumn("near", F.last("full", ignorenulls=True).over(before))
        .filter(F.col("full").isNull())
        .join(carried, ["url", "bucket"], "left")
        .select("url", "ts", F.coalesce("near", "carry").alias("full"))
    )
    out = r.filter(F.col("record_type") == "revisit").join(found, ["url", "ts"], "left")
    both_etag = out["etag"].isNotNull() & F.col("full.etag").isNotNull()
    both_time = out["last_modified"].isNotNull() & F.col("full.last_modified").isNotNull()
    status = (
        F.when(F.col("full").isNull(), "orphan")
        .when(both_etag, F.when(_weak(out["etag"]) == _weak(F.col("full.etag")), "resolved").otherwise("mismatch"))
        .when(both_time, F.when(out["last_modified"] == F.col("full.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    out = out.select("record_id", "url", "ts", "headers", "full", status.alias("status"))
    updates = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter(F.col("full.headers"), lambda k, v: ~F.array_contains(F.map_keys(updates), k))
    ok = F.col("status").isin("resolved", "unverified")
    return out.select(
        "record_id", "url", "ts", "status",
        F.when(ok, F.col("full.record_id")).alias("response_id"),
        F.when(ok, F.col("full.ts")).alias("response_ts"),
        F.when(ok, F.col("full.digest")).alias("digest"),
        F.when(ok, F.map_concat(kept, updates)).alias("headers"),
    )


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Capture records of a page table: each page is fetched in full, and asked for again a year later.

    Page n is fetched n minutes after the start of 2024. The second answer is a
    revisit; every fifth page has changed its ETag by then, every seventh sends
    no ETag, every third sends it weak.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), F.md5(F.coalesce(F.col("html"), F.lit(""))).alias("digest"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit('"'))
    modified = F.concat(F.lit("day "), F.pmod("page_id", F.lit(28)).cast("string"))

    def record(revisit: bool) -> DataFrame:
        sent = tag
        if revisit:
            sent = F.when(F.pmod("page_id", F.lit(5)) == 0, F.concat(F.lit('"new'), F.col("digest"), F.lit('"'))).otherwise(sent)
            sent = F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("W/"), sent)).otherwise(sent)
            sent = F.when(F.pmod("page_id", F.lit(7)) == 0, F.lit(None)).otherwise(sent)
        headers = F.create_map(
            F.lit("content-type"), F.lit("text/plain" if revisit else "text/html"),
            F.lit("server"), F.lit("edge-2" if revisit else "edge-1"),
            F.lit("expires" if revisit else "content-encoding"), F.lit("never" if revisit else "gzip"),
        )
        return p.select(
            (F.col("page_id") * 2 + int(revisit)).alias("record_id"), F.lit("revisit" if revisit else "response").alias("record_type"), "uri",
            (at + F.expr("interval 365 days") if revisit else at).alias("ts"), sent.alias("etag"), modified.alias("last_modified"), headers.alias("headers"),
            (F.lit(None).cast("string") if revisit else F.col("digest")).alias("digest"),
        )

    return record(False).unionByName(record(True))
