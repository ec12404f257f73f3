"""Arrays of structs per row: building them, folding them, and expanding them into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

# Weather fields of one region.
WEATHER_FIELDS = (
    "temp_mean_c", "temp_max_c", "temp_min_c", "precipitation_mm", "rain_mm", "snowfall_cm", "humidity_mean_pct",
    "wind_speed_max_kmh",
)
# Theme groups of the news feed.
THEME_GROUPS = ("SUPPLY", "LOGISTICS", "TRADE", "MARKET", "POLICY", "CORE", "OTHER")
TONES = ("tone_avg", "tone_positive", "tone_negative", "tone_polarity")


def nest(df: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One sorted array of structs per key. Group size is the number of regions or themes per key and day."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def field_values(array: str, field: str) -> Column:
    """Non-null values of one struct field."""
    return F.filter(F.transform(F.col(array), lambda x: x[field].cast("double")), lambda v: v.isNotNull())


def array_mean(array: str, field: str) -> Column:
    """Mean over the non-null elements; NULL for a NULL or empty array."""
    values = field_values(array, field)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return total / F.nullif(F.size(values), F.lit(0))


def array_low(array: str, field: str) -> Column:
    return F.array_min(field_values(array, field))


def array_high(array: str, field: str) -> Column:
    return F.array_max(field_values(array, field))


def element_field(array: str, key_field: str, key: str, field: str) -> Column:
    """A field of the first element whose ``key_field`` equals ``key``; NULL when there is none."""
    return F.get(F.filter(F.col(array), lambda x: x[key_field] == key), 0)[field]


def weighted_tone(array: str, tone: str, weight: str = "article_count") -> Column:
    """Count-weighted mean of a tone over elements that carry it."""
    held = F.filter(F.col(array), lambda x: x[tone].isNotNull() & x[weight].isNotNull())
    total = F.aggregate(held, F.lit(0.0), lambda acc, x: acc + x[tone] * x[weight].cast("double"))
    weights = F.aggregate(held, F.lit(0).cast("bigint"), lambda acc, x: acc + x[weight].cast("bigint"))
    return total / F.nullif(weights, F.lit(0))


def article_total(array: str, weight: str = "article_count") -> Column:
    return F.aggregate(
        F.col(array), F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x[weight].cast("bigint"), F.lit(0))
    )


def column_safe(name: str) -> str:
    return name.replace(" ", "_").replace("-", "_")


def distinct_regions(df: DataFrame, array: str, key_field: str) -> list[str]:
    """Sorted distinct element keys. They become column names, so the driver has to know them: one row for each column."""
    found = df.select(F.explode(array).alias("x")).select(F.col("x")[key_field].alias("k")).distinct()
    return sorted(row["k"] for row in found.filter("k IS NOT NULL").toLocalIterator())


class _ArrayStage(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Common base: one array column in, new columns out, one ``select``."""

    def _added(self, df: DataFrame) -> list[Column]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select("*", *self._added(df))


class RegionAggregator(_ArrayStage):
    """Mean, min/max or all three of every field over the regions of a row."""

    aggregation = Param(Params._dummy(), "aggregation", "mean, min_max or all", TypeConverters.toString)
    fields = Param(Params._dummy(), "fields", "struct fields", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol: str = "weather_data", aggregation: str = "min_max", fields=list(WEATHER_FIELDS)):
        super().__init__()
        if aggregation not in ("mean", "min_max", "all"):
            raise ValueError(f"unknown aggregation {aggregation}")
        self._set(inputCol=inputCol, aggregation=aggregation, fields=list(fields))

    def _added(self, df):
        array, kind, added = self.getInputCol(), self.getOrDefault(self.aggregation), []
        for field in self.getOrDefault(self.fields):
            if kind in ("mean", "all"):
                added.append(array_mean(array, field).alias(f"weather_{field}_avg"))
            if kind in ("min_max", "all"):
                added.append(array_low(array, field).alias(f"weather_{field}_min"))
                added.append(array_high(array, field).alias(f"weather_{field}_max"))
        return added


class RegionSelector(_ArrayStage):
    """One column per chosen region and field."""

    regions = Param(Params._dummy(), "regions", "regions kept", TypeConverters.toListString)
    fields = Param(Params._dummy(), "fields", "struct fields", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol: str = "weather_data", regions=(), fields=list(WEATHER_FIELDS)):
        super().__init__()
        self._set(inputCol=inputCol, regions=list(regions), fields=list(fields))

    def _names(self, df):
        return self.getOrDefault(self.regions)

    def _added(self, df):
        return [
            element_field(self.getInputCol(), "region", region, field).alias(f"weather_{column_safe(region)}_{field}")
            for region in self._names(df)
            for field in self.getOrDefault(self.fields)
        ]


class RegionExpander(RegionSelector):
    """Like :class:`RegionSelector` for all regions found in the data, in sorted order."""

    @keyword_only
    def __init__(self, inputCol: str = "weather_data", fields=list(WEATHER_FIELDS)):
        super().__init__(inputCol=inputCol, regions=[], fields=list(fields))

    def _names(self, df):
        return distinct_regions(df, self.getInputCol(), "region")


class ThemeAggregator(_ArrayStage):
    """Total article count and count-weighted tones over all theme groups of a row."""

    @keyword_only
    def __init__(self, inputCol: str = "gdelt_themes"):
        super().__init__()
        self._set(inputCol=inputCol)

    def _added(self, df):
        array = self.getInputCol()
        return [article_total(array).alias("gdelt_total_articles")] + [
            weighted_tone(array, tone).alias(f"gdelt_{tone}") for tone in TONES
        ]


class ThemeExpander(_ArrayStage):
    """Four columns per theme group: count, average, positive and polarity tone."""

    @keyword_only
    def __init__(self, inputCol: str = "gdelt_themes"):
        super().__init__()
        self._set(inputCol=inputCol)

    def _added(self, df):
        shown = {"count": "article_count", "tone_avg": "tone_avg", "tone_positive": "tone_positive", "tone_polarity": "tone_polarity"}
        return [
            element_field(self.getInputCol(), "theme_group", group, field).alias(f"gdelt_{group.lower()}_{name}")
            for group in THEME_GROUPS
            for name, field in shown.items()
        ]
