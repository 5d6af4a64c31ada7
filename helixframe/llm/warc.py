"""Not-modified revisit resolution over crawl records.

A server that answers 304 leaves a revisit record without a body.  It is
resolved by an as-of join on the canonical URL to the latest full response before
it.  The join is a window function in two steps, so that a URL with any part of
the records is no single task: records are range-partitioned by (URL, time), each
partition finds the latest response before each revisit inside itself, and the
last response of each (URL, partition), one row each, is carried over to the
following ones.  Only keys and validators move; bodies join last, by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import size_in_partitions, staged

RESPONSE, REVISIT = "response", "revisit"
#: Query parameters that do not name another page (fixed values).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
#: Headers of a 304 answer that never replace those of the stored response (fixed values: message framing and connection).
NOT_MERGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., port 80 or 443; no scheme, fragment, tracking parameters or closing slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.array_join(params, "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def lowered(headers: Column) -> Column:
    """Headers by their names in lower case; of names that differ in case alone, the last in byte order stays (``etag`` before ``ETag``)."""
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("k"), x["key"].alias("name"), x["value"].alias("v"))))
    last = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i + 1)["k"] != x["k"], F.lit(True)))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by those of the 304 answer that may replace them; names in lower case already."""
    new = F.map_filter(fresh, lambda k, _: ~k.isin(NOT_MERGED))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(new, k)), new)


def resolve_revisits(records: DataFrame, with_body: bool = True) -> DataFrame:
    """One row per revisit record: record_id, url_key, ts, response_id, state, headers (and body).

    ``records`` has record_id, url, ts, kind ('response' or 'revisit'), status,
    headers (map of strings) and body.  Responses count if their status is 200 and they have a
    body.  A response before a revisit is one with a smaller ts, or the same ts and a
    record_id that is not larger; null identifiers are the largest.  Of responses
    with the same ts and record_id the one with the largest SHA-256 of its body
    is the latest.  state is

        resolved         the revisit's ETag equals the response's (weak
                         comparison), or, without one, its Last-Modified
        unvalidated      it carries neither
        changed          the validator differs: headers are its own, no body
        no_response      there is none before it: headers are its own, no body

    Null URLs, times or kinds: such responses are no candidates, such revisits
    are no_response (a null kind is neither).  Bodies are found by their SHA-256, so records that share an
    identifier, or have none, keep their own.  Of header names that differ in
    case alone the last in byte order counts.  Repeated records each count and
    each give a row; bodies may be of any length and are moved once; other columns are not
    read, whatever their names.  An empty table gives an empty result.
    """
    known = F.col("ts").isNotNull() & F.col("url_key").isNotNull()
    slim = records.where(F.col("kind").isin(RESPONSE, REVISIT)).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", lowered(F.col("headers")).alias("headers"),
        F.when(F.col("kind") == RESPONSE, (F.col("status") == 200) & F.col("body").isNotNull()).otherwise(False).alias("full"),
        F.when(F.col("kind") == RESPONSE, F.unhex(F.sha2(F.col("body").cast("binary"), 256))).alias("digest"),
    )
    slim = slim.where((F.col("kind") == REVISIT) | (F.col("full") & known))
    slim = slim.withColumns({"no_id": F.col("record_id").isNull(), "etag": F.regexp_replace(F.try_element_at("headers", F.lit("etag")), "^W/", ""), "modified": F.try_element_at("headers", F.lit("last-modified"))})
    # rows that are alike in all of these may stand in any order, so they are dealt over partitions too
    order = ["ts", "no_id", "record_id", "kind", "digest"]
    timed = slim.where(known).withColumn("salt", F.monotonically_increasing_id())
    dealt = staged(timed.repartitionByRange(size_in_partitions(records), "url_key", *order, "salt").withColumn("part", F.spark_partition_id()), "records")
    at = F.struct(*order)
    response = F.when(F.col("full"), F.struct(F.col("record_id").alias("id"), "etag", "modified", "headers", "digest"))
    inside = Window.partitionBy("url_key", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("r", F.last(response, ignorenulls=True).over(inside))
    # the last response of each (URL, partition), carried on
    ends = dealt.where("full").groupBy("url_key", "part").agg(F.max_by(response, at).alias("end"))
    parts_of = dealt.select("url_key", "part").distinct().join(ends, ["url_key", "part"], "left")
    carried = parts_of.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("url_key", "part", "carried")
    found = near.where(F.col("kind") == REVISIT).join(carried.where("carried is not null"), ["url_key", "part"], "left").withColumn("r", F.coalesce("r", "carried"))
    columns = ["record_id", "url_key", "ts", "headers", "etag", "modified"]
    lost = slim.where(F.col("kind") == REVISIT).where(~known).select(*columns, F.lit(None).cast(found.schema["r"].dataType).alias("r"))
    found = found.select(*columns, "r").unionAll(lost)
    state = (
        F.when(F.col("r").isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(F.col("etag").eqNullSafe(F.col("r.etag")), "resolved").otherwise("changed"))
        .when(F.col("modified").isNotNull(), F.when(F.col("modified").eqNullSafe(F.col("r.modified")), "resolved").otherwise("changed"))
        .otherwise("unvalidated")
    )
    out = found.withColumn("state", state)
    held = F.col("state").isin("resolved", "unvalidated")
    none = F.create_map().cast("map<string,string>")
    out = out.select(
        "record_id", "url_key", "ts", F.col("r.id").alias("response_id"), "state",
        merged_headers(F.when(held, F.col("r.headers")).otherwise(none), F.col("headers")).alias("headers"), F.when(held, F.col("r.digest")).alias("digest"),
    )
    if not with_body:
        return out.drop("digest")
    out = staged(out, "resolved")
    # only bodies that a revisit resolved to are moved; revisits without one meet none
    wanted = out.where("digest is not null").select("digest").distinct()
    full = records.where((F.col("kind") == RESPONSE) & (F.col("status") == 200) & F.col("body").isNotNull())
    hashed = full.select(F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), "body").join(wanted, "digest", "left_semi")
    bodies = hashed.groupBy("digest").agg(F.first("body").alias("body"))
    columns = [*(c for c in out.columns if c != "digest"), "body"]
    return out.where("digest is not null").join(bodies, "digest", "left").select(*columns).unionAll(out.where("digest is null").withColumn("body", F.lit(None).cast(records.schema["body"].dataType)).select(*columns))
