"""News records: relevance, tagging, theme explosion and daily theme sentiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions import dates, strings
from almanac.operators import reshape
from almanac.operators.nested import THEME_GROUPS, TONES

# The group of each theme.
THEMES_BY_GROUP = {
    "SUPPLY": ("NATURAL_DISASTER", "CLIMATE_CHANGE", "TAX_DISEASE", "TAX_PLANTDISEASE", "TAX_PESTS", "STRIKE", "ECON_UNIONS"),
    "LOGISTICS": ("CRISIS_LOGISTICS", "CRISISLEX_C04_LOGISTICS_TRANSPORT", "BLOCKADE", "DELAY", "CLOSURE", "BORDER"),
    "TRADE": ("ECON_FREETRADE", "ECON_TRADE_DISPUTE", "TAX_TARIFFS", "ECON_SUBSIDIES", "ECON_CURRENCY_EXCHANGE_RATE", "WB_698_TRADE"),
    "MARKET": (
        "ECON_STOCKMARKET", "ECON_EARNINGSREPORT", "ECON_INTEREST_RATES", "ECON_DEBT", "ECON_INFLATION", "ECON_COST_OF_LIVING", "ENERGY",
        "OIL", "ECON_BITCOIN",
    ),
    "POLICY": (
        "LEGISLATION", "GOV_REFORM", "GENERAL_GOVERNMENT", "STATE_OF_EMERGENCY", "ELECTION", "CORRUPTION", "NEGOTIATIONS", "ALLIANCE",
        "CEASEFIRE", "EPU_POLICY", "EPU_POLICY_GOVERNMENT",
    ),
    "CORE": ("AGRICULTURE", "FOOD_STAPLE", "FOOD_SECURITY", "WB_2044_RURAL_WATER"),
}
# Themes that make a record relevant.
RELEVANT_THEMES = (
    "NATURAL_DISASTER", "CLIMATE_CHANGE", "TAX_DISEASE", "TAX_PLANTDISEASE", "TAX_PESTS", "STRIKE", "ECON_UNIONS", "CRISIS_LOGISTICS", "BLOCKADE",
    "DELAY", "CLOSURE", "BORDER", "ECON_FREETRADE", "ECON_TRADE_DISPUTE", "TAX_TARIFFS", "ECON_SUBSIDIES", "ECON_CURRENCY_EXCHANGE_RATE",
    "ECON_STOCKMARKET", "ECON_EARNINGSREPORT", "ECON_INTEREST_RATES", "ECON_DEBT", "ECON_COST_OF_LIVING", "ENERGY", "OIL", "LEGISLATION", "GOV_REFORM",
    "GENERAL_GOVERNMENT", "STATE_OF_EMERGENCY", "ELECTION", "CORRUPTION", "AGRICULTURE", "FOOD_STAPLE", "FOOD_SECURITY", "WB_2044_RURAL_WATER",
    "GENERAL_HEALTH", "NEGOTIATIONS", "ALLIANCE", "CEASEFIRE", "ECON_IPO",
)
# Keywords looked for in the names field.
KEYWORDS = (
    "coffee", "arabica", "robusta", "sugar", "sugarcane", "sugar beet", "drought", "frost", "flood", "rainfall", "la nina",
    "el nino", "fertilizer", "pesticide", "water scarcity", "labor shortage", "port congestion", "shipping", "inflation",
    "recession", "ethanol", "biofuel", "crude oil", "tariff", "trade deal", "geopolitical", "political instability",
)

THEME_TO_GROUP = {theme: group for group, themes in THEMES_BY_GROUP.items() for theme in themes}


def relevant(themes: str = "themes", names: str = "all_names") -> Column:
    """A record counts when an item of its theme list starts with a known theme or its names contain a keyword."""
    return strings.any_theme_prefix(themes, RELEVANT_THEMES) | strings.any_keyword(names, KEYWORDS)


def parsed(raw: DataFrame) -> DataFrame:
    """Raw string records to typed articles with a date and four tones; unreadable parts become NULL."""
    tones = [strings.packed_number("tone", i).alias(name) for i, name in enumerate(TONES)]
    return raw.select("*", dates.packed_date("date").alias("article_date"), *tones)


def tagged(df: DataFrame, names: str = "all_names") -> DataFrame:
    """One boolean per commodity. A band named like the second commodity does not count on its own."""
    lower = F.lower(F.col(names))
    coffee = lower.rlike("coffee|arabica|robusta")
    sugar = lower.rlike("sugarcane|sugar cane") | (lower.contains("sugar") & ~lower.contains("sugar ray"))
    return df.select(
        "*", F.coalesce(coffee, F.lit(False)).alias("has_coffee"), F.coalesce(sugar, F.lit(False)).alias("has_sugar")
    )


def group_of(theme: str, mapping: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.col(theme)), F.lit("OTHER"))


def with_theme_group(df: DataFrame, mapping: Mapping[str, str], theme: str = "theme") -> DataFrame:
    """Theme to group by a literal map of fixed size; unknown themes are OTHER."""
    return df.select("*", group_of(theme, mapping).alias("theme_group"))


def mentions(df: DataFrame, mapping: Mapping[str, str] = THEME_TO_GROUP) -> DataFrame:
    """One row per article, commodity and theme mention."""
    tags = F.filter(
        F.array(F.when(F.col("has_coffee"), F.lit("coffee")), F.when(F.col("has_sugar"), F.lit("sugar"))), lambda x: x.isNotNull()
    )
    named = df.select("*", F.explode(tags).alias("commodity"))
    return with_theme_group(named.select("*", F.explode(strings.packed_items("themes")).alias("theme")), mapping)


def theme_metrics(count: str = "source_url", digits: int | None = None) -> dict[str, Column]:
    def shown(c: Column) -> Column:
        return c if digits is None else F.round(c, digits)

    return {"count": F.count(count), **{tone: shown(F.avg(tone)) for tone in TONES}}


def daily_wide(
    rows: DataFrame, keys: Sequence[str] = ("article_date", "commodity"), groups: Sequence[str] = THEME_GROUPS,
    themes: Sequence[str] = tuple(THEME_TO_GROUP), digits: int | None = None,
) -> DataFrame:
    """All mentions, each group and each tracked theme side by side, one row per key.

    Rows are first reduced to sums and counts per key and theme, which is all that is shuffled; the wide columns are
    then formed from those few rows. Counts are 0 where a theme is absent; tones stay NULL, so that a later fill can
    tell "no news" from "neutral news".
    """
    sums = [F.sum(tone).alias(f"{tone}_sum") for tone in TONES] + [F.count(tone).alias(f"{tone}_n") for tone in TONES]
    parts = rows.groupBy(*keys, "theme", "theme_group").agg(F.count("source_url").alias("n"), *sums)

    def family(condition: Column | None, name: str) -> list[Column]:
        def total(c: str) -> Column:
            return F.sum(c if condition is None else F.when(condition, F.col(c)))

        def mean(tone: str) -> Column:
            value = total(f"{tone}_sum") / F.nullif(total(f"{tone}_n"), F.lit(0))
            return value if digits is None else F.round(value, digits)

        return [F.coalesce(total("n"), F.lit(0)).alias(f"{name}_count"), *[mean(tone).alias(f"{name}_{tone}") for tone in TONES]]

    columns = family(None, "group_ALL")
    for group in groups:
        columns += family(F.col("theme_group") == group, f"group_{group}")
    for theme in themes:
        columns += family(F.col("theme") == theme, f"theme_{theme}")
    return parts.groupBy(*keys).agg(*columns)


def wide_to_arrays(wide: DataFrame, keys: Sequence[str], groups: Sequence[str] = THEME_GROUPS) -> DataFrame:
    """Group columns back into one array of structs per row."""
    structs = [
        F.struct(
            F.lit(group).alias("theme_group"), F.col(f"group_{group}_count").alias("article_count"),
            *[F.col(f"group_{group}_{tone}").alias(tone) for tone in TONES],
        )
        for group in groups
    ]
    return wide.select(*keys, F.array(*structs).alias("gdelt_themes"))


def zero_tones(wide: DataFrame) -> DataFrame:
    """The variant in which absent themes also get 0.0 tones."""
    counts = [c for c in wide.columns if c.endswith("_count")]
    tones = [c for c in wide.columns if "_tone_" in c]
    return reshape.zero_fill(wide, counts, tones)
