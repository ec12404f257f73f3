"""Readers. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from almanac.functions.dates import date_in_name, packed_timestamp

# Field names of a news record file, in file order.
NEWS_FIELDS = (
    "gkg_record_id", "date", "source_collection_id", "source_common_name", "source_url", "counts", "v2_counts", "themes", "v2_themes",
    "locations", "v2_locations", "persons", "v2_persons", "organizations", "v2_organizations", "tone", "dates", "gcam", "sharing_image",
    "related_images", "social_image_embeds", "social_video_embeds", "quotations", "all_names", "amounts", "translation_info", "extras",
)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, *, ingest: Column | None = None, header: bool = True) -> DataFrame:
    """CSV with a fixed schema and the time it was read; several folders (current and history) become one table."""
    stamp = F.current_timestamp() if ingest is None else ingest
    return spark.read.schema(schema).option("header", header).csv(paths).withColumn("ingest_ts", stamp)


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, *, packed: str | None = None) -> DataFrame:
    """JSON lines; ``packed`` names a yyyyMMddHHmmss string column that also becomes ``event_ts``."""
    rows = spark.read.schema(schema).json(paths)
    return rows if packed is None else rows.withColumn("event_ts", packed_timestamp(packed))


def read_union(spark: SparkSession, current: DataFrame, history: DataFrame) -> DataFrame:
    """Two landings of one table; a column only one of them has becomes NULL in the other."""
    return current.unionByName(history, allowMissingColumns=True)


def split_news(lines: DataFrame) -> DataFrame:
    """Tab-separated lines to the 27 named string columns; short lines are dropped. Works on streams too."""
    parts = lines.select(F.split("value", "\t", -1).alias("p")).filter(F.size("p") >= len(NEWS_FIELDS))
    return parts.select(*[F.col("p")[i].alias(name) for i, name in enumerate(NEWS_FIELDS)])


def read_news(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return split_news(spark.read.text(paths))


def read_days(spark: SparkSession, path: str, first: str, last: str, *, day: str = "article_date") -> DataFrame:
    """Only the partitions of a date range are listed and read."""
    return spark.read.parquet(path).filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def with_file_date(df: DataFrame) -> DataFrame:
    """The day in the path of each row's file: an eight-digit run right after a slash, an equals sign or a name's first part."""
    return df.withColumn("file_date", date_in_name(F.regexp_extract(F.input_file_name(), r"[/=_-](\d{8})(?:[/._-][^/]*)*$|[/=](\d{8})/[^/]*$", 0)))


def as_strings(df: DataFrame) -> DataFrame:
    """Every column as text: the raw form that never loses a value."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def normalized_names(df: DataFrame, renames: Mapping[str, str] | None = None, suffixes: Sequence[str] = ()) -> DataFrame:
    """Lower-case names with underscores, known suffixes stripped, and explicit renames first."""
    def clean(name: str) -> str:
        if renames and name in renames:
            return renames[name]
        short = name.strip().lower().replace(" ", "_").replace("-", "_")
        for suffix in suffixes:
            short = short.removesuffix(suffix)
        return short

    return df.toDF(*[clean(c) for c in df.columns])
