"""Web archive records: not-modified revisits resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header fields a not-modified answer does not update (fixed values, by the HTTP caching rules).
NOT_MERGED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "content-length", "content-encoding", "content-range", "content-type")
#: Query parameters that only track visits.
TRACKING = "^(utm_|fbclid=|gclid=|sessionid=|ref=)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slashes, query sorted without trackers.

    Scheme and fragment don't tell captures apart. A null url stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(bare, "[?](.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _plain(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def _bucket(ts: Column, begins: list[int], most: int, parts: int) -> Column:
    """The number of the span that a time is in: spans begin at ``begins``, each is cut into ``parts`` of equal length."""
    starts = F.lit(begins).cast("array<long>")
    span = F.size(F.filter(starts, lambda b: b <= ts))
    if parts == 1:
        return span.cast("long")
    ends = F.lit([*begins[1:], most + 1]).cast("array<long>")
    low, high = F.element_at(starts, span), F.element_at(ends, span)
    return F.when(ts.isNull(), F.lit(0)).otherwise(span.cast("long") * parts + F.floor((ts - low) * parts / (high - low)))


def resolve_revisits(records: DataFrame, *, rows_per_bucket: int = 50_000, quantiles: int = 512) -> DataFrame:
    """Each revisit with the latest full response of its canonical URL that is strictly earlier.

    ``records`` has record_id, url, ts, kind (response or revisit), etag, last_modified and headers
    (map of lower-case names). Returns record_id, url_key, ts, response_id, status and headers, which is the
    stored response's map updated by the revisit's permitted fields.

    status is resolved (a validator both have agrees: entity tags by weak comparison, else dates), mismatch (it
    differs: the response is named but headers stay the revisit's own), unverified (they share no validator) or
    missing (no earlier response, or a null url or time).

    The as-of join is a running last value over (URL, time bucket), with what earlier buckets left carried in
    from one summary row each: a URL that holds a third of all records is spread over all buckets. Their number follows the
    table: up to ``quantiles`` are quantiles of time, and beyond that each of these is cut into equal spans. Of responses at one time the highest record_id counts;
    repeated rows each give a row; extra columns are ignored; an empty table gives no rows.
    """
    fields = ["record_id", "etag", "last_modified", "headers"]
    rows = records.select(canonical_url(F.col("url")).alias("url_key"), "ts", "kind", *fields)
    share = [i / quantiles for i in range(1, quantiles)]
    at = F.col("ts").cast("long")
    facts = rows.agg(F.count("*").alias("n"), F.min(at).alias("least"), F.max(at).alias("most"), F.percentile_approx(at, share, 4 * quantiles).alias("edges")).first()
    wanted = max(1, -(-facts.n // rows_per_bucket))
    coarse = min(wanted, quantiles)
    edges = sorted({facts.edges[int(i * quantiles / coarse) - 1] for i in range(1, coarse)} - {facts.least}) if facts.edges else []
    bucket = _bucket(at, [facts.least, *edges], facts.most, -(-wanted // coarse)) if facts.edges else F.lit(0).cast("long")
    full = (F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("url_key").isNotNull()
    rows = rows.withColumn("bucket", bucket).withColumn("own", F.when(full, F.struct("ts", *fields)))

    inside = W.partitionBy("url_key", "bucket").orderBy("ts", F.when(full, 1).otherwise(0), "record_id").rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("own", ignorenulls=True).over(inside)).where("kind = 'revisit'")
    ends = rows.groupBy("url_key", "bucket").agg(F.max_by("own", F.struct("own.ts", "own.record_id")).alias("left"))
    before = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("url_key", "bucket", F.last("left", ignorenulls=True).over(before).alias("far")).where("far IS NOT NULL")
    found = near.join(carried.hint("merge"), ["url_key", "bucket"], "left").withColumn("hit", F.when(F.col("ts").isNotNull(), F.coalesce("near", "far")))

    tags = F.col("etag").isNotNull() & F.col("hit.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("hit.last_modified").isNotNull()
    status = (
        F.when(F.col("hit").isNull(), "missing")
        .when(tags, F.when(_plain(F.col("etag")) == _plain(F.col("hit.etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("hit.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unverified")
    )
    none = F.create_map().cast("map<string,string>")
    own, stored = F.coalesce("headers", none), F.coalesce("hit.headers", none)
    fresh = F.map_filter(own, lambda k, v: ~k.isin(*NOT_MERGED))
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    headers = F.when(F.col("status") == "resolved", F.map_concat(kept, fresh)).otherwise(own)
    return found.withColumn("status", status).select("record_id", "url_key", "ts", F.col("hit.record_id").alias("response_id"), "status", headers.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made from ``pages``: each is fetched once in full and asked for again, later and under another spelling of its URL."""
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    n = F.col("page_id").cast("long")
    full = pages.select(
        (2 * n).alias("record_id"), "url", (10 * n).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), n.cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"), F.lit("etag"), tag, F.lit("date"), (10 * n).cast("string")).alias("headers"),
    )
    later = F.when(n % 7 == 3, F.lit('"changed"')).when(n % 11 == 5, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    again = pages.select(
        (2 * n + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again")).alias("url"), (10 * n + 25).alias("ts"), F.lit("revisit").alias("kind"),
        later.alias("etag"), F.when(n % 11 == 5, F.lit(None)).otherwise(n.cast("string")).alias("last_modified"),
        F.create_map(F.lit("date"), (10 * n + 25).cast("string"), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"),
    )
    return full.unionByName(again)


CAPTURES_SQL = """
WITH records AS (
  SELECT 2 * page_id AS record_id, url, 10 * page_id AS ts, 'response' AS kind, '"' || md5(coalesce(html, '')) || '"' AS etag, CAST(page_id AS VARCHAR) AS last_modified,
         CAST(length(html) AS VARCHAR) AS len FROM pages
  UNION ALL
  SELECT 2 * page_id + 1, regexp_replace(url, '^http:', 'https:') || '#again', 10 * page_id + 25, 'revisit',
         CASE WHEN page_id % 7 = 3 THEN '"changed"' WHEN page_id % 11 = 5 THEN NULL ELSE 'W/"' || md5(coalesce(html, '')) || '"' END,
         CASE WHEN page_id % 11 = 5 THEN NULL ELSE CAST(page_id AS VARCHAR) END, NULL FROM pages),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM records),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*', 0)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|fbclid=|gclid=|sessionid=|ref=)'))), '&') AS query FROM bare),
keyed AS (SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM parts),
seen AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'etag': etag, 'lm': last_modified, 'len': len, 'ts': ts} END IGNORE NULLS)
         OVER (PARTITION BY url_key ORDER BY ts, CASE WHEN kind = 'response' THEN 1 ELSE 0 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hit FROM keyed),
told AS (SELECT *, CASE WHEN hit IS NULL THEN 'missing'
         WHEN etag IS NOT NULL AND hit.etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(hit.etag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
         WHEN last_modified IS NOT NULL AND hit.lm IS NOT NULL THEN CASE WHEN last_modified = hit.lm THEN 'resolved' ELSE 'mismatch' END
         ELSE 'unverified' END AS status FROM seen WHERE kind = 'revisit')
SELECT record_id, url_key, ts, hit.id AS response_id, status,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=60; content-length=' || hit.len || '; content-type=text/html; date=' || ts || '; etag=' || hit.etag
            ELSE 'cache-control=max-age=60; content-length=0; date=' || ts END AS headers FROM told
"""


def shown_headers(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
