"""Registered queries of sources, sinks and incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.ledger_queries import latest_runs
from ledgerloom.operators.outcome import parse_and_check
from ledgerloom.plans import derive as D
from ledgerloom.plans.oracle import on_ledger
from ledgerloom.plans.queries_text import rendered
from ledgerloom.sources import pages as PG
from ledgerloom.sources import payloads as PL
from ledgerloom.sources.ledger_store import read_ledger, read_month, read_table, write_ledger
from ledgerloom.sources.stage import settings, stage_folder, staged, write_settings
from ledgerloom.streaming.ingest import ingest_stream


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as uploaded files; some have a wrong name, wrong bytes or none at all."""
    key = F.col("doc_id")
    name = F.when(key % 11 == 3, F.lit(".txt")).when(key % 11 == 4, F.lit(".PDF")).otherwise(
        F.lit(".pdf")
    )
    content = F.when(key % 13 == 5, F.lit("")).when(key % 13 == 6, F.col("text")).otherwise(
        F.concat(F.lit("%PDF-1.7 "), F.col("text"))
    )
    return D.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/in/"), F.col("source"), F.lit("/doc-"), key.cast("string"), name)
        .alias("path"),
        F.encode(content, "UTF-8").alias("content"),
    )


def scan_payloads(spark, sf_dir):
    return PL.payload_facts(document_files(spark, sf_dir))


def _write_files(folder: str):
    """Writes each row's bytes under the folder; a retried task writes the same files again."""
    def run(batches):
        system, root = PL.file_system(folder)
        made = set()
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in ("path", "content")), strict=True):
                place = root + path
                parent = place.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(place) as out:
                    out.write(content)
            yield batch.select(["path"])
    return run


def scan_payload_files(spark, sf_dir):
    """Documents written as files, the empty ones too, and read back by a scan of their folder."""
    folder = _fresh_folder(spark, "uploads")
    files = document_files(spark, sf_dir)
    files.mapInArrow(_write_files(folder), "path string").write.format("noop").mode("overwrite").save()
    return PL.scan_payloads(spark, folder)


FILES = """
WITH f AS (SELECT doc_id, source, CASE doc_id % 11 WHEN 3 THEN '.txt' WHEN 4 THEN '.PDF'
    ELSE '.pdf' END AS ext, CASE WHEN doc_id % 13 = 5 THEN '' WHEN doc_id % 13 = 6 THEN text
    ELSE '%PDF-1.7 ' || text END AS content FROM documents)
SELECT sha256(content) AS content_sha256, CAST(strlen(content) AS BIGINT) AS byte_length,
  'doc-' || doc_id || ext AS original_basename, CASE WHEN ext = '.txt' THEN 'not_a_pdf_name'
    WHEN content = '' THEN 'empty_file' WHEN NOT starts_with(content, '%PDF') THEN 'not_pdf_bytes'
    END AS refused FROM f"""


def _attempts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is an upload attempt; texts of labelled documents are stored already."""
    docs = D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("attempt_id"), F.sha2(F.col("text"), 256).alias("content_sha256"),
        F.octet_length("text").cast("bigint").alias("byte_length"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
        .alias("original_basename"),
    )
    labelled = D.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("attempt_id"))
    existing = docs.join(labelled, "attempt_id", "left_semi").select(
        "content_sha256", F.concat(F.lit("old-"), "content_sha256").alias("raw_payload_id")
    ).distinct()
    return docs, existing


def dedupe_payloads(spark, sf_dir):
    inserts, _ = PL.dedupe_payloads(*_attempts(spark, sf_dir))
    return inserts


def payload_runs(spark, sf_dir):
    _, runs = PL.dedupe_payloads(*_attempts(spark, sf_dir))
    return runs


ATTEMPTS = """
WITH d AS (SELECT doc_id AS attempt_id, sha256(text) AS content_sha256,
    CAST(strlen(text) AS BIGINT) AS byte_length, 'doc-' || doc_id || '.pdf' AS original_basename
  FROM documents),
old AS (SELECT DISTINCT content_sha256 FROM d WHERE attempt_id IN (SELECT doc_id FROM labels)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY attempt_id) AS rn
  FROM d WHERE content_sha256 NOT IN (SELECT content_sha256 FROM old))
"""


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: every turn is a page, numbered from one."""
    return D.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page_number"),
        F.col("text").alias("page_text"),
    )


def assemble_text(spark, sf_dir):
    return PG.assemble_text(conversation_pages(spark, sf_dir))


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as word boxes with odd corners: negative, half and zero-width values."""
    key = F.col("l_orderkey") + F.col("l_partkey")
    x0 = F.col("l_quantity") - 5 + (key % 8).cast("double") / 16000
    return D.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_number"),
        F.col("l_linenumber").alias("word_index"), F.col("l_returnflag").alias("text"),
        x0.alias("x0"), (F.col("l_tax") * 100).alias("top"),
        F.when(key % 3 == 0, x0).otherwise(x0 + F.col("l_discount")).alias("x1"),
        (F.col("l_tax") * 100 + 0.0005 * (key % 5)).alias("bottom"),
    )


def words_to_tokens(spark, sf_dir):
    return PG.words_to_tokens(line_boxes(spark, sf_dir))


TOKENS = """
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber AS word_index, l_returnflag AS token_text,
    l_orderkey + l_partkey AS k, l_quantity - 5 + CAST((l_orderkey + l_partkey) % 8 AS DOUBLE)
      / 16000 AS x0, l_discount, l_tax * 100 AS y0 FROM lineitem),
b AS (SELECT *, CASE WHEN k % 3 = 0 THEN x0 ELSE x0 + l_discount END AS x1,
    y0 + CAST(0.0005 AS DOUBLE) * (k % 5) AS y1 FROM w),
m AS (SELECT *, greatest(0, CAST(round_even(x0 * 1000, 0) AS BIGINT)) AS mx0,
    greatest(0, CAST(round_even(y0 * 1000, 0) AS BIGINT)) AS my0,
    CAST(round_even(x1 * 1000, 0) AS BIGINT) AS rx1,
    CAST(round_even(y1 * 1000, 0) AS BIGINT) AS ry1 FROM b)
SELECT doc_id, CAST(1 AS INTEGER) AS page_number, word_index, 'word' AS token_kind, token_text,
  mx0 AS x0_mp, my0 AS y0_mp, greatest(mx0 + 1, rx1) AS x1_mp, greatest(my0 + 1, ry1) AS y1_mp
FROM m"""


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = conversation_pages(spark, sf_dir)
    words = pages.select("doc_id", "page_number",
                         F.posexplode(F.split("page_text", " ")).alias("word_index", "token_text"))
    kind = F.when(F.col("token_text").contains("e"), F.lit("word")).otherwise(F.lit("cell"))
    return words.filter(F.col("token_text") != "").withColumn("token_kind", kind)


def nest_raw_extraction(spark, sf_dir):
    return PG.nest_raw_extraction(
        conversation_pages(spark, sf_dir), page_words(spark, sf_dir)
    ).drop("page_text")


NESTED_PAGES = """
WITH p AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, text
    FROM conversations),
w AS (SELECT doc_id, page_number, CAST(i - 1 AS INTEGER) AS word_index, parts[i] AS token_text
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM
    (SELECT doc_id, page_number, string_split(text, ' ') AS parts FROM p))),
t AS (SELECT *, CASE WHEN contains(token_text, 'e') THEN 'word' ELSE 'cell' END AS token_kind
  FROM w WHERE token_text <> ''),
n AS (SELECT doc_id, page_number, count(*) FILTER (token_kind = 'word') AS word_count,
  count(*) FILTER (token_kind = 'cell') AS cell_count FROM t GROUP BY 1, 2)
SELECT p.doc_id, p.page_number, coalesce(n.word_count, 0) AS word_count,
  coalesce(n.cell_count, 0) AS cell_count, t.word_index, t.token_text, t.token_kind
FROM p LEFT JOIN n ON n.doc_id = p.doc_id AND n.page_number = p.page_number
LEFT JOIN t ON t.doc_id = p.doc_id AND t.page_number = p.page_number"""


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _table_sums(ledger) -> DataFrame:
    """Row count and one sum per stored table."""
    measured: dict[str, Column] = {
        "accounts": F.length("account_mask"),
        "statements": F.col("closing_balance_cents"),
        "depository_summaries": F.col("deposits_cents"),
        "credit_summaries": F.col("purchases_cents"),
        "brokerage_summaries": F.col("closing_cash_cents"),
        "transactions": F.col("amount_cents"),
        "holdings": F.col("market_value_cents"),
    }
    out = None
    for name, value in measured.items():
        row = getattr(ledger, name).agg(
            F.count("*").alias("n_rows"),
            F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"),
        ).select(F.lit(name).alias("table_name"), "n_rows", "total")
        out = row if out is None else out.unionByName(row)
    return out


def write_read_ledger(spark, sf_dir):
    """The derived ledger written twice to an empty store, and what is then in it."""
    path = _fresh_folder(spark, "ledger")
    ledger = D.derive_ledger(spark, sf_dir)
    write_ledger(ledger, path)
    write_ledger(ledger, path)
    return _table_sums(read_ledger(spark, path))


def read_one_month(spark, sf_dir):
    """Transactions of one month out of a stored ledger; other months are not scanned."""
    path = _fresh_folder(spark, "ledger")
    write_ledger(D.derive_ledger(spark, sf_dir), path)
    return read_month(spark, path, "transactions", "1997-05").select(
        "transaction_id", "post_date", "amount_cents"
    )


STORED = on_ledger("""
SELECT 'accounts' AS table_name, count(*) AS n_rows,
  CAST(sum(length(account_mask)) AS BIGINT) AS total FROM acc
UNION ALL SELECT 'statements', count(*), CAST(sum(closing_balance_cents) AS BIGINT) FROM st
UNION ALL SELECT 'depository_summaries', count(*), CAST(sum(deposits_cents) AS BIGINT) FROM dep
UNION ALL SELECT 'credit_summaries', count(*), CAST(sum(purchases_cents) AS BIGINT) FROM card
UNION ALL SELECT 'brokerage_summaries', count(*), CAST(sum(closing_cash_cents) AS BIGINT) FROM brok
UNION ALL SELECT 'transactions', count(*), CAST(sum(amount_cents) AS BIGINT) FROM txn
UNION ALL SELECT 'holdings', count(*), CAST(sum(market_value_cents) AS BIGINT) FROM hold""")


def read_pages_back(spark, sf_dir):
    """Printed card pages read from their page table: texts kept apart and in order."""
    path = _fresh_folder(spark, "page-table")
    rendered(spark, sf_dir, "card").write.parquet(path)
    pages = PG.read_pages(spark, path)
    first = PG.first_pages(pages).select("doc_id", F.lit(True).alias("_first"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).join(
        first, "doc_id", "left"
    ).select("doc_id", "n_pages", F.coalesce("_first", F.lit(False)).alias("has_first"))


def _arrive(pages: DataFrame, source: str) -> None:
    """Pages added to the files under ``source``."""
    spark = pages.sparkSession
    with settings(spark, write_settings(spark)):
        pages.write.mode("append").parquet(source)


def _lines_by_document(spark: SparkSession, sink: str) -> DataFrame:
    """Stored lines; a run goes back to the document that it read."""
    ledger = read_ledger(spark, sink)
    runs = read_table(spark, sink, "extraction_runs").select("run_id", F.col("doc_id").alias("_doc"))
    return ledger.transactions.join(
        ledger.statements.select("statement_id", "run_id"), "statement_id"
    ).join(runs, "run_id").select(
        F.col("_doc").alias("run_id"), "line_no", "post_date", "amount_cents", "transaction_category",
        "balance_after_cents")


def ingest_stream_ledger(spark, sf_dir):
    """Printed bank statements arriving as files in several batches, then the stored lines."""
    source, sink = _fresh_folder(spark, "arrivals"), _fresh_folder(spark, "sink")
    # A document's pages stay together in one file.
    printed = rendered(spark, sf_dir, "depository").select("doc_id", "page_number", "page_text")
    _arrive(printed.repartition(4, "doc_id"), source)
    query = ingest_stream(spark, source, sink, _fresh_folder(spark, "progress"), max_files=2)
    query.awaitTermination()
    return _lines_by_document(spark, sink)


def ingest_split_documents(spark, sf_dir):
    """The same statements, the pages of every one of several pages coming in two batches."""
    source, sink = _fresh_folder(spark, "arrivals"), _fresh_folder(spark, "sink")
    progress = _fresh_folder(spark, "progress")
    printed = rendered(spark, sf_dir, "depository").select("doc_id", "page_number", "page_text")
    counted = printed.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_pages"))
    halves = staged(printed.join(counted, "doc_id"), "halves")
    for late in (1, 0):
        _arrive(halves.filter(F.col("page_number") % 2 == late).repartition(2), source)
        ingest_stream(spark, source, sink, progress).awaitTermination()
    return _lines_by_document(spark, sink)


def ingest_repeated(spark, sf_dir):
    """The same statements arriving twice: per sound document its payloads, runs and newest lines."""
    source, sink = _fresh_folder(spark, "arrivals"), _fresh_folder(spark, "sink")
    progress = _fresh_folder(spark, "progress")
    printed = rendered(spark, sf_dir, "depository").select("doc_id", "page_number", "page_text")
    for _ in range(2):
        _arrive(printed.repartition(2, "doc_id"), source)
        ingest_stream(spark, source, sink, progress).awaitTermination()
    runs = read_table(spark, sink, "extraction_runs")
    payloads = read_table(spark, sink, "raw_payloads")
    newest = latest_runs(read_ledger(spark, sink), runs)
    lines = newest.transactions.join(newest.statements.select("statement_id", "run_id"), "statement_id")
    counted = lines.groupBy("run_id").agg(F.count("*").alias("n_lines"))
    stored = payloads.groupBy("raw_payload_id").agg(F.count("*").alias("n_payloads"))
    return (
        runs.join(stored, "raw_payload_id").join(counted, "run_id", "left")
        .groupBy(F.col("doc_id").alias("run_id")).agg(
            F.count("*").alias("n_runs"), F.max("n_payloads").alias("n_payloads"),
            F.sum("n_lines").cast("bigint").alias("n_lines"))
        # Statements that fail their checks have runs, and no lines.
        .filter("n_lines IS NOT NULL")
    )


def parsed_runs(spark, sf_dir):
    """Run table of a parse: every routed card statement with its final state."""
    _, runs, _ = parse_and_check(staged(rendered(spark, sf_dir, "card"), "again"))
    return runs.select("run_id", "adapter_id", "status", "error_code")


INGESTED = on_ledger(
    "SELECT t.statement_id AS run_id, t.line_no, t.post_date, t.amount_cents, "
    "t.transaction_category, t.balance_after_cents FROM txn t JOIN dep USING "
    "(statement_id) WHERE fees_cents >= 0")

QUERIES: dict[str, tuple] = {
    "scan_payloads": (scan_payloads, FILES),
    "scan_payload_files": (scan_payload_files, FILES),
    "dedupe_payloads": (
        dedupe_payloads,
        ATTEMPTS + "SELECT sha256('payload|' || content_sha256) AS raw_payload_id, content_sha256, "
        "byte_length, original_basename FROM fresh WHERE rn = 1",
    ),
    "payload_runs": (
        payload_runs,
        ATTEMPTS + "SELECT sha256('run|' || attempt_id) AS run_id, attempt_id, content_sha256, "
        "CASE WHEN content_sha256 IN (SELECT content_sha256 FROM old) THEN "
        "'old-' || content_sha256 ELSE sha256('payload|' || content_sha256) END "
        "AS raw_payload_id FROM d",
    ),
    "assemble_text": (
        assemble_text,
        "SELECT conv_id AS doc_id, CAST(turn + 1 AS BIGINT) AS page_number, "
        "CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, "
        "text AS page_text FROM conversations",
    ),
    "words_to_tokens": (words_to_tokens, TOKENS),
    "nest_raw_extraction": (nest_raw_extraction, NESTED_PAGES),
    "read_pages": (
        read_pages_back,
        on_ledger("SELECT statement_id AS doc_id, CAST(ceil(n_lines / 2.0) AS BIGINT) AS n_pages, "
                  "TRUE AS has_first FROM card"),
    ),
    "write_read_ledger": (write_read_ledger, STORED),
    "read_one_month": (
        read_one_month,
        on_ledger("SELECT transaction_id, post_date, amount_cents FROM txn "
                  "WHERE strftime(post_date, '%Y-%m') = '1997-05'"),
    ),
    "parsed_runs": (
        parsed_runs,
        on_ledger("SELECT statement_id AS run_id, 'standard_credit_card' AS adapter_id, CASE WHEN "
                  "fees_charged_cents < 0 THEN 'failed' ELSE 'canonical_persisted' END AS status, "
                  "CASE WHEN fees_charged_cents < 0 THEN 'InvariantError' END AS error_code "
                  "FROM card"),
    ),
    "ingest_stream": (ingest_stream_ledger, INGESTED),
    "ingest_split_documents": (ingest_split_documents, INGESTED),
    "ingest_repeated": (
        ingest_repeated,
        on_ledger("SELECT t.statement_id AS run_id, 2 AS n_runs, 1 AS n_payloads, "
                  "count(*) AS n_lines FROM txn t JOIN dep USING (statement_id) "
                  "WHERE fees_cents >= 0 GROUP BY t.statement_id"),
    ),
}
