"""What staged tables leave on disk, and what joins of them bring to the driver."""

import os

from pyspark.sql import functions as F

from ledgerloom.operators.parse import parse_statements
from ledgerloom.sources.stage import drop_staged, scratch, settings, stage_folder, staged, write_settings
from ledgerloom.streaming.ingest import ingest_batch
from tests import texts as X

PAGES = "doc_id string, page_number int, page_text string"


def _named(spark, *names):
    folder = stage_folder(spark).removeprefix("file:")
    return {n for n in os.listdir(folder) if n.rsplit("-", 1)[0] in names}


def test_broadcasts_follow_measured_sizes(spark):
    """Rows that need few bytes in a file are not taken for a small table."""
    many = staged(spark.range(200_000).select(F.lit("x" * 200).alias("k")), "many")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "4194304b"}):
        def plan():
            few = spark.range(5).select(F.col("id").cast("string").alias("k"))
            return few.join(many, "k", "left")._jdf.queryExecution().sparkPlan().toString()

        assert "BroadcastHashJoin" in plan()
        with settings(spark, write_settings(spark)):
            assert "BroadcastHashJoin" not in plan()
            assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "4194304b"


def test_holdings_need_no_join_with_documents(spark):
    """Rows carry the period's end, so a table of all documents is not brought beside them."""
    parsed = parse_statements(spark.createDataFrame([("a", 1, X.BROKERAGE)], PAGES))
    plan = parsed.ledger.holdings._jdf.queryExecution().optimizedPlan().toString()
    assert parsed.ledger.holdings.filter("as_of_date IS NOT NULL").count() > 0 and "Join" not in plan


def test_writes_leave_no_shuffle_files(spark):
    def kept():
        found = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keys().mkString(",")
        return {name for name in found.split(",") if name}

    before = kept()
    staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert kept() <= before


def test_scratch_tables_go_with_their_end(spark):
    with scratch(spark):
        inner = staged(spark.range(3), "passing")
        assert inner.count() == 3 and len(_named(spark, "passing")) == 1
    assert not _named(spark, "passing")
    kept = staged(spark.range(3), "staying")
    drop_staged(kept)
    assert not _named(spark, "staying")


def test_a_stored_batch_leaves_no_staged_tables(spark, tmp_path):
    before = set(os.listdir(stage_folder(spark).removeprefix("file:")))
    ingest_batch(spark.createDataFrame([("a", 1, X.CHECKING)], PAGES), str(tmp_path / "sink"), 1)
    assert set(os.listdir(stage_folder(spark).removeprefix("file:"))) <= before
