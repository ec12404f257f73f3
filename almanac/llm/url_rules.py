"""URL rules by host suffix and path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.llm.base import ascii_lower, column, query, table


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _folder(path: Column) -> Column:
    """The path up to its last slash; a rule is looked up by it."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _expressions(host: Column, path: Column, labels: int, folders: int) -> Column:
    """Every host suffix of at most ``labels`` labels with every folder prefix of at most ``folders`` slashes."""
    parts, steps = _labels(host), F.split(path, "/", folders + 2)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), ".")
    )
    deepest = F.least(F.size(steps) - 1, F.lit(folders))
    prefixes = F.concat(
        F.array(F.lit("")),
        F.transform(F.sequence(F.lit(0), deepest), lambda n: F.concat(F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    prefixes = F.array_distinct(F.filter(prefixes, lambda p: F.startswith(path, p)))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains when the URL's path starts with the rule's;
    the longest rule (host and path together) wins, and of equally long ones ``block``. Rules with a null in host, path or
    verdict are left out. Each distinct URL is expanded once, only as deep as the deepest rule, joined on the first 32 bits
    of the expression's SHA-256, then confirmed by the whole digest and the whole rule path. The rules' side is left to the
    optimizer, which broadcasts it only when its size is known and small.

    A null URL, or one without ``://``, has an empty host and path; without a fitting rule the verdict is ``otherwise`` and
    the rule null. Repeated rows each get their row. Other columns of ``pages`` are not read, whatever their names.
    """
    known = rules.select("host", "path", "verdict").dropna().select(
        ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).withColumn("digest", F.sha2(F.concat("rule_host", _folder(F.col("rule_path"))), 256))
    depth = known.agg(F.max(F.size(_labels(F.col("rule_host")))), F.max(F.length(F.regexp_replace("rule_path", "[^/]", "")))).first()
    labels, folders = depth[0] or 1, depth[1] or 0
    asked = pages.select(column(pages, key).alias("asked_key"), column(pages, url).alias("asked_url"))
    asked = asked.select("asked_key", host_of(F.col("asked_url")).alias("host"), path_of(F.col("asked_url")).alias("path"))
    expanded = asked.select("host", "path").distinct().withColumn(
        "digest", F.explode(F.transform(_expressions(F.col("host"), F.col("path"), labels, folders), lambda e: F.sha2(e, 256)))
    )
    short = F.substring("digest", 1, 8)
    met = expanded.withColumn("short", short).join(known.withColumn("short", short).withColumnRenamed("digest", "rule_digest"), "short")
    met = met.filter((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
    name = F.concat("rule_host", "rule_path")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("size"), "verdict", name.alias("rule"))).alias("best"))
    return asked.join(best, ["host", "path"], "left").select(
        F.col("asked_key").alias(key), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
    )


# The rules of the query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

OP10_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
asked AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
fits AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, verdict DESC) AS place
  FROM asked JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM asked LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""


@query("op10_url_rules", OP10_SQL)
def op10_url_rules(spark, sf):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf, "pages"), rules)
