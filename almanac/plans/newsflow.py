"""The news records: relevance, tagging, mentions and the daily wide sentiment table."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import news as nw, reshape
from almanac.operators.fill import forward_fill
from almanac.operators.spine import complete_grid, data_spine
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.sources.readers import NEWS_FIELDS

THEMES = {"view": "NATURAL_DISASTER;OIL", "click": "ECON_STOCKMARKET;UNKNOWN_TOPIC", "signup": "TAX_TARIFFS;", "error": "BORDER_PATROL;;STRIKE", "purchase": "MANMADE"}
NAMES = ("Coffee Exchange", "sugar ray", "Sugarcane Board;Robusta Growers", "nobody")


def raw_news(spark, sf):
    """The events table in the form of raw news records: 27 text columns."""
    kind = F.col("event_type")
    themes = F.create_map(*[F.lit(x) for pair in THEMES.items() for x in pair])[kind]
    names = F.array(*[F.lit(n) for n in NAMES])[(F.col("user_id") % 4).cast("int")]
    v = F.col("value")
    tone = F.concat_ws(",", v.cast("string"), (v * 2).cast("string"), F.when(kind == "error", "bad").otherwise((v * 4).cast("string")))
    made = {
        "gkg_record_id": F.col("event_id").cast("string"), "date": F.date_format("ts", "yyyyMMddHHmmss"), "themes": themes, "all_names": names,
        "tone": tone, "source_url": F.concat(F.lit("u"), F.col("event_id").cast("string")),
    }
    return t.table(spark, sf, "events").select(*[made.get(f, F.lit("")).alias(f) for f in NEWS_FIELDS])


RAW = """raw AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS article_date, CASE event_type WHEN 'view' THEN 'NATURAL_DISASTER;OIL' WHEN 'click' THEN 'ECON_STOCKMARKET;UNKNOWN_TOPIC' WHEN 'signup' THEN 'TAX_TARIFFS;' WHEN 'error' THEN 'BORDER_PATROL;;STRIKE' ELSE 'MANMADE' END AS themes,
  CASE user_id % 4 WHEN 0 THEN 'Coffee Exchange' WHEN 1 THEN 'sugar ray' WHEN 2 THEN 'Sugarcane Board;Robusta Growers' ELSE 'nobody' END AS names, value AS tone_avg, value * 2 AS tone_positive, CASE WHEN event_type = 'error' THEN NULL ELSE value * 4 END AS tone_negative FROM events),
  kept AS (SELECT *, names IN ('Coffee Exchange', 'Sugarcane Board;Robusta Growers') AS has_coffee, names = 'Sugarcane Board;Robusta Growers' AS has_sugar FROM raw WHERE themes <> 'MANMADE' OR names <> 'nobody'),
  mentions AS (SELECT m.*, CASE theme WHEN 'NATURAL_DISASTER' THEN 'SUPPLY' WHEN 'STRIKE' THEN 'SUPPLY' WHEN 'OIL' THEN 'MARKET' WHEN 'ECON_STOCKMARKET' THEN 'MARKET' WHEN 'TAX_TARIFFS' THEN 'TRADE' ELSE 'OTHER' END AS theme_group FROM (
    SELECT id, article_date, commodity, unnest(string_split(themes, ';')) AS theme, tone_avg, tone_positive, tone_negative FROM (SELECT *, 'coffee' AS commodity FROM kept WHERE has_coffee UNION ALL SELECT *, 'sugar' FROM kept WHERE has_sugar)) m WHERE theme <> '')"""


def articles(spark, sf):
    raw = raw_news(spark, sf)
    return nw.tagged(nw.parsed(raw.filter(nw.relevant())))


@query("relevant_articles", "F4 X1 X2 R2", twin("", "SELECT id, article_date, tone_avg, tone_positive, tone_negative, CAST(NULL AS DOUBLE) AS tone_polarity, has_coffee, has_sugar FROM kept", RAW))
def relevant_articles(spark, sf):
    return articles(spark, sf).select(F.col("gkg_record_id").alias("id"), "article_date", *nw.TONES, "has_coffee", "has_sugar")


@query("theme_mentions", "X3 F12 F5", twin("", "SELECT id, commodity, theme, theme_group, count(*) AS n FROM mentions GROUP BY 1, 2, 3, 4", RAW))
def theme_mentions(spark, sf):
    rows = nw.mentions(articles(spark, sf))
    return rows.groupBy(F.col("gkg_record_id").alias("id"), "commodity", "theme", "theme_group").agg(F.count(F.lit(1)).alias("n"))


GROUPS, TRACKED = ("SUPPLY", "LOGISTICS", "TRADE", "MARKET", "POLICY", "CORE", "OTHER"), tuple(nw.THEME_TO_GROUP)


def _wide_sql():
    cells = []
    families = [("group_ALL", "true")] + [(f"group_{g}", f"theme_group = '{g}'") for g in GROUPS] + [(f"theme_{x}", f"theme = '{x}'") for x in TRACKED]
    for name, condition in families:
        w = f"FILTER (WHERE {condition})"
        cells += [f"count(*) {w} AS {name}_count"] + [f"round(avg({x}) {w}, 8) AS {name}_{x}" for x in ("tone_avg", "tone_positive", "tone_negative")] + [f"CAST(NULL AS DOUBLE) AS {name}_tone_polarity"]
    return ", ".join(cells)


WIDE = RAW + f", wide AS (SELECT article_date, commodity, {_wide_sql()} FROM mentions GROUP BY 1, 2)"


def wide(spark, sf):
    return nw.daily_wide(nw.mentions(articles(spark, sf)), groups=GROUPS, themes=TRACKED, digits=8)


@query("daily_wide_sentiment", "A10 J6 A14", twin("", "SELECT * FROM wide", WIDE))
def daily_wide_sentiment(spark, sf):
    return wide(spark, sf)


@query("daily_sentiment_arrays", "A12 A9", twin("", " UNION ALL ".join(f"SELECT article_date, commodity, '{g}' AS theme_group, group_{g}_count AS article_count, group_{g}_tone_avg AS tone_avg FROM wide" for g in GROUPS), WIDE))
def daily_sentiment_arrays(spark, sf):
    arrays = nw.wide_to_arrays(wide(spark, sf), ["article_date", "commodity"])
    return arrays.select("article_date", "commodity", F.inline("gdelt_themes")).select("article_date", "commodity", "theme_group", "article_count", "tone_avg")


@query("sentiment_filled_grid", "J2 W4 W1", twin("", """SELECT s.commodity, s.date, coalesce(w.group_ALL_count, 0) AS n, last_value(w.group_TRADE_tone_avg IGNORE NULLS) OVER k AS trade_tone, last_value(w.theme_OIL_tone_avg IGNORE NULLS) OVER k AS oil_tone FROM
  (SELECT commodity, CAST(unnest(generate_series((SELECT min(article_date) FROM wide), (SELECT max(article_date) FROM wide), INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT commodity FROM wide)) s LEFT JOIN wide w ON w.commodity = s.commodity AND w.article_date = s.date WINDOW k AS (PARTITION BY s.commodity ORDER BY s.date ROWS UNBOUNDED PRECEDING)""", WIDE))
def sentiment_filled_grid(spark, sf):
    """Counts of absent days are zero; tones hold their last value, every tone column under one sort."""
    daily = wide(spark, sf).withColumnRenamed("article_date", "date")
    grid = complete_grid(data_spine(daily, ["commodity"]), daily, ["commodity", "date"])
    tones = [c for c in daily.columns if "_tone_" in c]
    counted = reshape.zero_fill(grid, [c for c in daily.columns if c.endswith("_count")])
    held = forward_fill(counted, ["commodity"], tones)
    return held.select("commodity", "date", F.col("group_ALL_count").alias("n"), F.col("group_TRADE_tone_avg").alias("trade_tone"), F.col("theme_OIL_tone_avg").alias("oil_tone"))


@query("zero_filled_sentiment", "A14", twin("", "SELECT article_date, commodity, group_CORE_count, coalesce(group_CORE_tone_avg, 0) AS group_CORE_tone_avg, coalesce(theme_OIL_tone_avg, 0) AS theme_OIL_tone_avg FROM wide", WIDE))
def zero_filled_sentiment(spark, sf):
    return nw.zero_tones(wide(spark, sf)).select("article_date", "commodity", "group_CORE_count", "group_CORE_tone_avg", "theme_OIL_tone_avg")
