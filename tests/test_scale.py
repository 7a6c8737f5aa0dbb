"""Steps whose work has to grow no faster than their input."""

import os

from pyspark.sql import functions as F

from ledgerloom.operators import document_facts as FACTS
from ledgerloom.operators import layouts as L
from ledgerloom.operators import reconcile as V
from ledgerloom.operators.outcome import parse_and_check
from ledgerloom.operators.parse import parse_statements
from ledgerloom.plans import derive as D
from ledgerloom.rules import CARD
from ledgerloom.sources import payloads as PL
from ledgerloom.sources import stage as STAGE
from ledgerloom.sources.stage import stage_folder, staged
from tests import texts as X


def test_lines_of_one_domain_are_those_of_all(spark, sf_dir):
    wanted = D.derived_lines(spark, sf_dir).filter(F.col("account_domain") == CARD)
    one = D.derived_lines(spark, sf_dir, CARD)
    assert wanted.count() == one.count() > 0
    assert wanted.exceptAll(one.select(wanted.columns)).isEmpty()


def test_pages_beyond_a_chunk_and_failures_found_once(spark, monkeypatch):
    """Neighbouring lines are found over the edges of chunks, and failures are one staged table."""
    lines = X.CHECKING.split("\n")
    head = "\n".join(lines[:8])
    rows = [("whole", 1, X.CHECKING), ("cut", 1, head)]
    rows += [("cut", n, line) for n, line in enumerate(lines[8:], 2)]
    monkeypatch.setattr(FACTS, "PAGES_PER_CHUNK", 2)
    before = set(os.listdir(stage_folder(spark)))
    ledger, runs, failures = parse_and_check(
        spark.createDataFrame(rows, "doc_id string, page_number int, page_text string"))
    states = {r.run_id: (r.status, r.error_code) for r in runs.collect()}
    assert states["cut"] == states["whole"] == ("canonical_persisted", None)
    kinds = ledger.statements.drop("statement_id", "run_id", "raw_payload_id").distinct().collect()
    assert len(kinds) == 1 and ledger.statements.count() == 2
    made = [n for n in set(os.listdir(stage_folder(spark))) - before if n.startswith("failures-")]
    assert len(made) == 1 and failures.isEmpty()


def test_partitions_of_a_stage_follow_its_size(spark, monkeypatch):
    """More rows make more tasks, not larger ones, whatever number of partitions the session names."""
    monkeypatch.setattr(STAGE, "PARTITION_BYTES", 1 << 16)
    set_before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16384b")
    try:
        files = [
            len(staged(spark.range(n).groupBy(F.xxhash64("id").alias("k")).count(), "sized", by_size=True).inputFiles())
            for n in (100_000, 800_000)
        ]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", set_before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert files[0] > 2 and files[1] >= 4 * files[0]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "134217728b"


def test_contract_deals_rows_before_it_combines_them(spark, sf_dir):
    """A map that combines holds rows of one dealt part, not those of a whole file."""
    ledger = D.derive_ledger(spark, sf_dir)
    runs = ledger.statements.select("run_id", "raw_payload_id")
    plan = V._contract_entries(ledger, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [_k0") == 8


def test_only_layouts_found_have_branches(spark):
    """One layout alone reads the same as beside all others, by expressions that name no other layout."""
    with L.only([L.STANDARD_CARD]):
        assert FACTS.by_layout(lambda x: f"'{x.layout_id}'") == f"('{L.STANDARD_CARD}')"
        assert not [n for n in FACTS._text_values() if n in ("t_opening_portfolio", "t_total")]
    assert set(L.present()) == set(L.LAYOUTS)
    texts = {"card": X.CARD, "fund": X.FUND}

    def parsed(names):
        pages = spark.createDataFrame(
            [(n, 1, texts[n]) for n in names], "doc_id string, page_number int, page_text string")
        ledger, runs, _ = parse_and_check(pages)
        tables = {"transactions": ledger.transactions, "runs": runs}
        return {name: {str(r.asDict()) for r in frame.collect()} for name, frame in tables.items()}

    together, alone = parsed(texts), [parsed([name]) for name in texts]
    assert together["runs"] and {n: set().union(*(one[n] for one in alone)) for n in together} == together


def test_header_behind_totals_at_once(spark):
    """Totals right after a section's title are no header; the line behind them is."""
    title, header = "POSITIONS", "Symbol    Description    Quantity    Market Value"
    assert f"{title}\n{header}" in X.BROKERAGE
    text = X.BROKERAGE.replace(f"{title}\n{header}", f"{title}\nHoldings Total: $0.00\n{header}")
    pages = spark.createDataFrame([("a", 1, text)], "doc_id string, page_number int, page_text string")
    parsed = parse_statements(pages)
    assert parsed.ledger.holdings.count() == parse_statements(
        pages.withColumn("page_text", F.lit(X.BROKERAGE))).ledger.holdings.count() > 0


def test_small_files_share_a_task(tmp_path):
    """Small files are read by tasks of many; few files are still dealt over the tasks there are."""
    for n in range(400):
        (tmp_path / f"{n:03}.pdf").write_bytes(b"%PDF" if n % 7 else b"")
    names = sorted(str(p) for p in tmp_path.iterdir())
    one = PL._SliceReader(str(tmp_path), PL.SLICE_BYTES).partitions()
    assert [s.files for s in one] == [names]
    dealt = PL._SliceReader(str(tmp_path), PL.SLICE_BYTES, 8).partitions()
    assert [f for s in dealt for f in s.files] == names and 8 <= len(dealt) <= 9
