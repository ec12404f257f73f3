"""Not-modified revisits of web captures, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.llm.base import Scratch, column, query, table
from almanac.llm.url_rules import host_of, path_of

# The header fields a 304 answer may renew (RFC 9110, section 15.4.5, and Last-Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www., default port, closing slash and fragment; parameters sorted, utm_* and ref left out.
    Null for an address without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    asked = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    kept = F.filter(asked, lambda p: (p != "") & ~F.rlike(p, F.lit("^(utm_[^=]*|ref)(=|$)")))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, asked))


def _field(headers: Column, name: str) -> Column:
    return F.get(F.filter(headers, lambda e: e["name"] == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame, scratch: Scratch) -> DataFrame:
    """Every capture with the full response it stands for.

    ``records`` has record_id, url, captured_at (a whole number), kind (``response`` or ``revisit``), digest and headers
    (a map). A revisit looks up the latest response of the same canonical URL that is strictly earlier; of responses at one
    moment the highest record_id counts. The first validator that both carry decides: ETag (weak comparison), then
    Last-Modified, then digest. Returned: record_id, canonical_url, captured_at, response_id, status and headers, an array of
    (name, value) sorted by name, names in lower case. Status is response, resolved, mismatch (validators differ), unverified
    (no validator in common) or no_response. A resolved or unverified revisit gets the response's headers, renewed by those
    of its own that a 304 may renew; otherwise a record shows its own.

    A null url, one without a host, or a null captured_at resolves nothing and is resolved by nothing; null headers are none; a kind other than
    ``response`` is a revisit. Repeated rows each get their row. Other columns are not read, whatever their names.

    Rows are range-partitioned by (URL, moment), so a URL with a third of all captures spans many tasks; what earlier
    partitions know of a URL is carried as one row per partition.
    """
    names = F.coalesce(F.map_entries(column(records, "headers")), F.array().cast("array<struct<key:string,value:string>>"))
    entries = F.array_sort(F.transform(names, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value"))))
    url, at = column(records, "url"), column(records, "captured_at").cast("bigint")
    plain = records.select(
        column(records, "record_id").alias("record_id"), canonical_url(url).alias("canonical_url"), at.alias("captured_at"),
        (F.coalesce(column(records, "kind"), F.lit("")) == "response").alias("full"), column(records, "digest").alias("digest"),
        entries.alias("headers"),
    )
    lost = F.col("canonical_url").isNull() | F.col("captured_at").isNull()
    dealt = plain.repartitionByRange("canonical_url", "captured_at", F.when(lost, F.xxhash64("record_id")))
    kept = scratch.keep(dealt.withColumn("part", F.spark_partition_id()))
    answer = F.when(F.col("full") & ~lost, F.struct("captured_at", "record_id", "digest", "headers"))

    earlier = Window.partitionBy("part", "canonical_url").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    parts = kept.filter(~lost).groupBy("canonical_url", "part").agg(F.max(answer).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("carried", F.max("last").over(before)).filter(F.col("carried").isNotNull()).select(
        F.col("canonical_url").alias("of_url"), F.col("part").alias("of_part"), "carried"
    )
    seen = kept.withColumn("near", F.when(~lost, F.max(answer).over(earlier)))
    seen = seen.join(carried, (F.col("canonical_url") == F.col("of_url")) & (F.col("part") == F.col("of_part")), "left")
    seen = seen.withColumn("found", F.when(~F.col("full") & ~lost, F.coalesce("near", "carried")))

    strong = lambda tag: F.regexp_replace(tag, "^W/", "")
    pairs = (
        (strong(_field(F.col("headers"), "etag")), strong(_field(F.col("found.headers"), "etag"))),
        (_field(F.col("headers"), "last-modified"), _field(F.col("found.headers"), "last-modified")),
        (F.col("digest"), F.col("found.digest")),
    )
    agreed = F.coalesce(*[a == b for a, b in pairs])
    status = (
        F.when(F.col("full"), "response").when(F.col("found").isNull(), "no_response").when(agreed, "resolved")
        .when(~agreed, "mismatch").otherwise("unverified")
    )
    renewing = F.filter("headers", lambda e: e["name"].isin(*PERMITTED))
    renewed = F.transform(renewing, lambda e: e["name"])
    merged = F.array_sort(F.concat(F.filter("found.headers", lambda e: ~F.array_contains(renewed, e["name"])), renewing))
    return seen.withColumn("status", status).select(
        "record_id", "canonical_url", "captured_at", F.col("found.record_id").alias("response_id"), "status",
        F.when(F.col("status").isin("resolved", "unverified"), merged).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page, a day apart. The first is a full response unless page_id is a multiple of 5, the third
    one (with a new body) if it is a multiple of 7; all others are revisits, some with changed or missing validators."""
    k, page = F.col("k"), F.col("page_id")
    at = page * 60 + k * 86400
    full = ((k == 0) & (page % 5 != 0)) | ((k == 2) & (page % 7 == 0))
    digest = F.when(full & (k == 2), F.md5(F.concat("body", F.lit("2")))).otherwise(F.col("body"))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    etag = (
        F.when(full, tag).when(k <= 1, F.when(page % 2 == 1, F.concat(F.lit("W/"), tag)).otherwise(tag))
        .when(k == 2, F.when(page % 3 == 0, '"changed"').otherwise(tag))
    )
    changed = F.when(full, at.cast("string")).when((k == 3) & (page % 4 != 0), (page * 60).cast("string"))
    fields = {
        "Cache-Control": F.concat(F.lit("max-age="), k.cast("string")), "Content-Type": F.when(full, "text/html"),
        "Content-Length": F.when(~full, "0"), "Date": at.cast("string"), "ETag": etag, "Last-Modified": changed,
    }
    headers = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in fields.items()]), lambda e: e["value"].isNotNull())
    days = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k")
    return pages.select("page_id", "url", F.md5("html").alias("body")).select("*", days).select(
        (page * 4 + k).alias("record_id"), "url", at.alias("captured_at"), F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(full, digest).alias("digest"), F.map_from_entries(headers).alias("headers"),
    )


OP2_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(html) AS body, UNNEST([0, 1, 2, 3]) AS k FROM pages),
made AS (
  SELECT page_id * 4 + k AS record_id, url, page_id, k, page_id * 60 + k * 86400 AS captured_at,
    (k = 0 AND page_id % 5 <> 0) OR (k = 2 AND page_id % 7 = 0) AS is_full,
    CASE WHEN k = 2 AND page_id % 7 = 0 THEN md5(body || '2') ELSE body END AS digest,
    '"' || left(digest, 16) || '"' AS tag,
    CASE WHEN is_full THEN tag WHEN k <= 1 THEN CASE WHEN page_id % 2 = 1 THEN 'W/' || tag ELSE tag END
      WHEN k = 2 THEN CASE WHEN page_id % 3 = 0 THEN '"changed"' ELSE tag END END AS etag,
    CASE WHEN is_full THEN CAST(captured_at AS VARCHAR) WHEN k = 3 AND page_id % 4 <> 0 THEN CAST(page_id * 60 AS VARCHAR) END AS modified
  FROM base),
cut AS (
  SELECT *, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))) AS asked FROM made),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical_url FROM cut),
answers AS (
  SELECT canonical_url, captured_at AS answered_at, max(record_id) AS response_id, max_by(etag, record_id) AS answer_tag,
    max_by(modified, record_id) AS answer_modified, max_by(k, record_id) AS answer_k
  FROM named WHERE is_full GROUP BY ALL),
met AS (
  SELECT n.*, a.* EXCLUDE (canonical_url) FROM named n ASOF LEFT JOIN answers a
    ON n.canonical_url = a.canonical_url AND n.captured_at > a.answered_at),
judged AS (
  SELECT *, CASE WHEN is_full THEN 'response' WHEN response_id IS NULL THEN 'no_response'
      WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = answer_tag THEN 'resolved' ELSE 'mismatch' END
      WHEN modified IS NOT NULL THEN CASE WHEN modified = answer_modified THEN 'resolved' ELSE 'mismatch' END
      ELSE 'unverified' END AS status,
    status IN ('resolved', 'unverified') AS merged FROM met)
SELECT record_id, canonical_url, captured_at, CASE WHEN NOT is_full THEN response_id END AS response_id, status,
  'cache-control: max-age=' || k || CASE WHEN is_full OR merged THEN '' ELSE chr(10) || 'content-length: 0' END
    || CASE WHEN is_full OR merged THEN chr(10) || 'content-type: text/html' ELSE '' END || chr(10) || 'date: ' || captured_at
    || coalesce(chr(10) || 'etag: ' || coalesce(etag, CASE WHEN merged THEN answer_tag END), '')
    || coalesce(chr(10) || 'last-modified: ' || coalesce(modified, CASE WHEN merged THEN answer_modified END), '') AS headers
FROM judged
"""


@query("op2_revisits", OP2_SQL)
def op2_revisits(spark, sf):
    found = resolve_revisits(captures(table(spark, sf, "pages")), Scratch(spark, "op2"))
    lines = F.transform("headers", lambda e: F.concat(e["name"], F.lit(": "), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "\n"))
