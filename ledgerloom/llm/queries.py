"""Registered queries of this subpackage: given tables mapped to the operators and back."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.boilerplate import strip_spread_lines, strip_sql
from ledgerloom.llm.fixture_leaks import find_fixture_leaks
from ledgerloom.llm.frames import shared_folder
from ledgerloom.llm.near_pages import near_duplicate_pages
from ledgerloom.llm.packing import pack_pages
from ledgerloom.llm.page_flags import PageFlags, fit_page_flags
from ledgerloom.llm.page_prints import near_print_pages
from ledgerloom.llm.page_tokens import count_page_tokens
from ledgerloom.llm.payload_archive import read_payload_archive, write_payload_archive
from ledgerloom.llm.repeated_bytes import remove_repeated_bytes
from ledgerloom.llm.resampling import resample_pages
from ledgerloom.llm.vector_tree import nearest_vectors
from ledgerloom.llm.whitening import whiten_vectors
from ledgerloom.llm.word_perplexity import page_word_perplexity


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers of a session started elsewhere import this package from where it lies."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), root])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_pages(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as pages of the library: id and text under the library's names."""
    return documents.select(
        F.col("doc_id").alias("raw_page_id"), F.col("text").alias("page_text"), *more)


def op1_near_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicate_pages(as_pages(read(spark, sf_dir, "documents")))
    return classes.select(F.col("raw_page_id").alias("doc_id"), "class_id", "n_links")


# Every pair that shares a run of words is counted, so this suits small tables.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x20]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id, doc_id AS reached FROM documents
      UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, (SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_links
FROM documents d"""


def op2_payload_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("raw_payload_id"), F.col("url").alias("original_basename"),
        F.encode("html", "UTF-8").alias("content"))
    files = write_payload_archive(payloads, shared_folder(spark, "archive"))
    records = read_payload_archive(files, with_content=False)
    return records.select(
        F.col("raw_payload_id").cast("bigint").alias("page_id"),
        F.col("byte_length").alias("payload_bytes"), F.col("content_sha256").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100
              THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f"""


def institution_pages(documents: DataFrame, *more: str) -> DataFrame:
    return as_pages(documents, F.col("source").alias("institution"), *more)


def op3_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = strip_spread_lines(institution_pages(read(spark, sf_dir, "documents")))
    return pages.select(
        F.col("raw_page_id").alias("doc_id"), "n_lines", "n_spread", "n_removed",
        F.octet_length("page_text").cast("bigint").alias("kept_bytes"),
        F.sha2("page_text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH {strip_sql("documents", "doc_id", "source", "text")}
SELECT r.doc_id, n_lines, n_spread, n_removed, strlen(kept_) AS kept_bytes,
       sha256(kept_) AS kept_sha256
FROM stripped_ s JOIN rows_ r ON s.row_ = r.row_"""


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fitted_toxicity(documents: DataFrame, labels: DataFrame) -> PageFlags:
    """The classifier of labels.toxic, learnt from the labelled rows that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).select(
        F.col("doc_id").alias("raw_page_id"), F.col("toxic").alias("flagged"))
    return fit_page_flags(as_pages(documents), known)


def op4_page_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = fitted_toxicity(documents, read(spark, sf_dir, "labels"))
    scored = model.score(as_pages(documents))
    return scored.select(
        F.col("raw_page_id").alias("doc_id"), held_out(F.col("raw_page_id")).alias("held_out"),
        "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def as_fixtures(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("fixture_id"), F.col("text").alias("raw_text"))


def op6_fixture_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_fixture_leaks(as_pages(read(spark, sf_dir, "documents")),
                               as_fixtures(read(spark, sf_dir, "benchmark")))
    return leaks.select(F.col("raw_page_id").alias("doc_id"), F.col("fixture_id").alias("item_id"),
                        "edits")


def op7_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_page_tokens(as_pages(read(spark, sf_dir, "documents")),
                               tokenizer_file("byte_bpe_50k.json"))
    return counts.select(F.col("raw_page_id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(as_pages(read(spark, sf_dir, "documents")))
    return kept.withColumnRenamed("raw_page_id", "doc_id")


def packed_documents(documents: DataFrame) -> DataFrame:
    pieces = pack_pages(as_pages(documents), tokenizer_file("word_bpe_49k.json"))
    return pieces.select(
        F.col("raw_page_id").alias("doc_id"), "start", "length", "ids_crc32",
        F.col("page_tokens").alias("doc_tokens"), "sequence_id",
        F.col("seq_offset").alias("offset"))


def op9_pack_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read(spark, sf_dir, "documents"))


def op10_page_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    trusted = labels.filter("quality = 1").select(F.col("doc_id").alias("raw_page_id"))
    scored = page_word_perplexity(as_pages(read(spark, sf_dir, "documents"), "lang"), trusted)
    return scored.select(F.col("raw_page_id").alias("doc_id"), "lang", "perplexity", "threshold",
                         F.col("keep").cast("int").alias("high_quality"))


def op11_near_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_print_pages(as_pages(read(spark, sf_dir, "documents"))).withColumnRenamed(
        "raw_page_id", "doc_id")


def op12_resample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = as_fixtures(read(spark, sf_dir, "benchmark")).withColumnRenamed("raw_text", "page_text")
    drawn = resample_pages(as_pages(read(spark, sf_dir, "documents")), target)
    return drawn.select(F.col("raw_page_id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_whiten_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A deviation beyond a long has no place in the column and comes as null.
    return whiten_vectors(read(spark, sf_dir, "embeddings")).withColumn(
        "deviation", F.col("deviation").try_cast("bigint"))


QUERIES = {
    "op1_near_pages": (op1_near_pages, OP1_SQL),
    "op2_payload_archive": (op2_payload_archive, OP2_SQL),
    "op3_spread_lines": (op3_spread_lines, OP3_SQL),
    "op4_page_toxicity": (op4_page_toxicity, None),
    "op5_nearest_vectors": (op5_nearest_vectors, None),
    "op6_fixture_leaks": (op6_fixture_leaks, None),
    "op7_page_tokens": (op7_page_tokens, None),
    "op8_repeated_bytes": (op8_repeated_bytes, None),
    "op9_pack_pages": (op9_pack_pages, None),
    "op10_page_perplexity": (op10_page_perplexity, None),
    "op11_near_prints": (op11_near_prints, None),
    "op12_resample_pages": (op12_resample_pages, None),
    "op13_whiten_vectors": (op13_whiten_vectors, None),
}
