"""Documents to packed training sequences: flagged text out, boilerplate lines out, one of each near
copy, no benchmark text, packed windows. Every stage's result is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.boilerplate import strip_spread_lines
from ledgerloom.llm.fixture_leaks import find_fixture_leaks
from ledgerloom.llm.frames import staged
from ledgerloom.llm.near_pages import near_duplicate_pages, one_of_each_class
from ledgerloom.llm.queries import (
    as_fixtures,
    as_pages,
    fitted_toxicity,
    packed_documents,
    read,
)

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(pages: DataFrame) -> DataFrame:
    """Back to the columns of documents; n_chars follows the text."""
    return pages.select(
        F.col("raw_page_id").alias("doc_id"), F.col("page_text").alias("text"), "lang",
        F.col("institution").alias("source"), F.length("page_text").cast("bigint").alias("n_chars"))


def _as_institution_pages(docs: DataFrame) -> DataFrame:
    return as_pages(docs, F.col("source").alias("institution"), "lang")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text is scored under one half."""
    model = fitted_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = model.score(docs.select(*COLUMNS).withColumn("page_text", F.col("text")), "_toxic")
    return scored.filter(F.col("_toxic") < 0.5).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share; near copies count for one source."""
    pages = _as_institution_pages(docs)
    classes = staged(near_duplicate_pages(pages), "line-classes")
    return _as_documents(strip_spread_lines(pages, classes=classes))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id."""
    return _as_documents(one_of_each_class(_as_institution_pages(docs)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    # Rows of one id are told apart by their text; a null id is an id like others.
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_row"))
    pages = keyed.select(F.col("_row").alias("raw_page_id"), F.col("text").alias("page_text"))
    leaks = find_fixture_leaks(pages, as_fixtures(read(spark, sf_dir, "benchmark")))
    leaked = leaks.select(F.col("raw_page_id").alias("_row")).distinct()
    return keyed.join(leaked, "_row", "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of at most 2048 tokens."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# The first stage is a fitted classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
