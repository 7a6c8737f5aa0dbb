"""Page text and word boxes as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The page table (doc_id, page_number, page_text) from Parquet."""
    return spark.read.parquet(path).select("doc_id", "page_number", "page_text")


def pages_from_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Statement texts kept as JSON objects with a ``raw_text``; one page per file."""
    schema = "institution string, account_type string, raw_text string"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    return raw.select(
        F.substring_index(F.input_file_name(), "/", -1).alias("doc_id"),
        F.lit(1).alias("page_number"),
        F.col("raw_text").alias("page_text"),
        "institution", "account_type",
    )


def first_pages(pages: DataFrame) -> DataFrame:
    """First page of every document, kept apart from the running text."""
    return pages.filter(F.col("page_number") == 1).select(
        "doc_id", F.col("page_text").alias("page_one")
    )


def assemble_text(pages: DataFrame) -> DataFrame:
    """The text of each document in reading order, as ordered stretches of one page each.

    Joining the stretches of a document with line breaks gives its whole text; ``char_start``
    is where a stretch begins in it. The text stays in page-sized rows because one document
    may be larger than a row or a task can hold.
    """
    from ledgerloom.operators.running import running_totals

    sized = pages.select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "page_text",
        F.floor(F.col("page_number") / 4096).alias("_chunk"),
    )
    run = running_totals(
        sized, ["doc_id"], "_chunk", ["page_number"],
        {"_end": F.length("page_text") + 1},
    )
    return run.select(
        "doc_id", "page_number",
        (F.col("_end") - F.length("page_text") - 1).alias("char_start"), "page_text",
    )


def _millipoints(col: Column) -> Column:
    """Float points to integer millipoints, half to even like the text extractor's rounding."""
    return F.bround(col * 1000).cast("bigint")


def words_to_tokens(words: DataFrame) -> DataFrame:
    """Word boxes to integer geometry: no negative origin, width and height at least one."""
    x0 = F.greatest(F.lit(0).cast("bigint"), _millipoints(F.col("x0")))
    y0 = F.greatest(F.lit(0).cast("bigint"), _millipoints(F.col("top")))
    return words.select(
        "doc_id", "page_number", "word_index",
        F.lit("word").alias("token_kind"),
        F.col("text").alias("token_text"),
        x0.alias("x0_mp"), y0.alias("y0_mp"),
        F.greatest(x0 + 1, _millipoints(F.col("x1"))).alias("x1_mp"),
        F.greatest(y0 + 1, _millipoints(F.col("bottom"))).alias("y1_mp"),
    )


def nest_raw_extraction(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages of a document in order with their word and cell counts, tokens as rows beneath.

    One row per token beside its page; a page without tokens keeps one row with null token
    columns. Counts are aggregated apart from the tokens, so no page is gathered into one value.
    """
    counts = tokens.groupBy("doc_id", "page_number").agg(
        F.count_if(F.col("token_kind") == "word").alias("word_count"),
        F.count_if(F.col("token_kind") == "cell").alias("cell_count"),
    )
    header = pages.select("doc_id", "page_number", "page_text").join(
        counts, ["doc_id", "page_number"], "left"
    ).fillna(0, ["word_count", "cell_count"])
    return header.join(tokens, ["doc_id", "page_number"], "left")
