"""The corpus pipeline: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.llm.base import Scratch, table
from almanac.llm.lattice import decode, encode, model_path
from almanac.llm.leaks import leaks
from almanac.llm.private import personal_data, trained
from almanac.llm.quality import scored
from almanac.llm.simhash import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE, SIMILARITY, BITS, BANDS = 5, 0.8, 7, 32
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def _small_batches(stage):
    """The stage with at most ROWS rows in a batch that goes to or from Python: whole texts of Spark's 10,000 rows are there several
    times over, in the executor and in each of its Python workers. The session keeps the smaller number, as plans run later."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH)) <= ROWS:
            spark.conf.set(BATCH, ROWS)
        return stage(spark, docs, sf_dir)

    return run


def _marked(docs: DataFrame) -> DataFrame:
    """The rows with a mark made of all their columns: only rows that are the same throughout share it."""
    whole = [c for name in COLUMNS for c in (F.col(name).isNull(), F.col(name))]
    twice = [F.hex(F.xxhash64(F.lit(salt), *whole)) for salt in (1, 2)]
    return docs.select(*COLUMNS, F.concat_ws("-", *twice).alias("mark"))


def _where(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The marked rows whose mark is (not) among ``marks``."""
    return docs.join(marks.select("mark").distinct(), "mark", how)


@_small_batches
def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality model rejects go."""
    docs = _marked(docs)
    found = scored(docs, table(spark, sf_dir, "labels"), Scratch(spark, "pipeline-quality"), mark="mark")
    return _where(docs, found.filter("predicted = 0"), "left_anti").select(*COLUMNS)


@_small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays, that with the smallest doc_id (a null one only if all are): texts whose five-word
    shingles have a similarity of at least 0.8, among those whose SimHash over distinct words differs in at most seven bits or that
    share one of 32 keys of minimal shingle hashes."""
    scratch = Scratch(spark, "pipeline-simhash")
    docs = _marked(docs)
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark").alias("row"), "text")
    found = near_duplicates(
        rows, scratch, key="row", words=1, distinct=True, bits=BITS, similarity=SIMILARITY, shingle=SHINGLE, bands=BANDS
    )
    stay = found.filter("row = component_id").select("row.mark")
    return _where(docs, stay, "left_semi").dropDuplicates(["mark"]).select(*COLUMNS)


@_small_batches
def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage, also a reworded one, go."""
    docs = _marked(docs)
    found = leaks(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks"), key="mark")
    return _where(docs, found.select(F.col("doc").alias("mark")), "left_anti").select(*COLUMNS)


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the kind of its first one, in capitals and brackets."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("until"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(done, s):
        fresh = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.when(s["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"), F.greatest(done["at"], -s["until"]).alias("at")
        )

    return F.aggregate(ordered, begin, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


@_small_batches
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars is counted anew."""
    found = personal_data(docs.select(*COLUMNS), trained(docs, Scratch(spark, "pipeline-private")))
    clean = F.when(F.size("pii_spans") > 0, _redacted(F.col("text"), F.col("pii_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", clean).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


@_small_batches
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as sampled piece ids, decoded again; ``lossless`` says whether that gives the text back. The ids are written first:
    in one plan, each task would hold a Python worker for either way."""
    encoded = Scratch(spark, "pipeline-pieces").keep(encode(docs.select(*COLUMNS), model_path()))
    found = decode(encoded, model_path())
    lossless = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    return found.select("doc_id", "lang", "source", "n_chars", "pieces", lossless.alias("lossless"))


STAGES = [
    ("quality", of_quality), ("simhash", without_near_copies), ("decontamination", without_leaks),
    ("personal_data", without_personal_data), ("pieces", as_pieces),
]

# A learnt model, chained links, latent retrieval and sampling have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
