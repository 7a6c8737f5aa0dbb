import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import budget as B
from ledgerloom.operators import guarded as G
from ledgerloom.operators import ledger_queries as Q
from ledgerloom.operators import legacy as LG
from ledgerloom.operators import reconcile as V
from ledgerloom.operators.running import running_totals
from ledgerloom.plans.derive import derive_ledger


def test_running_totals_of_a_hot_key(spark):
    random.seed(3)
    rows = [("hot", i, random.randint(-9, 9)) for i in range(900)]
    rows += [(f"k{i % 50}", i, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    run = running_totals(frame.withColumn("c", F.floor(F.col("i") / 64)), ["k"], "c", ["i"],
                         {"s": F.col("v"), "n": F.lit(1)})
    sums, counts = {}, {}
    expected = set()
    for k, i, v in sorted(rows):
        sums[k] = sums.get(k, 0) + v
        counts[k] = counts.get(k, 0) + 1
        expected.add((k, i, sums[k], counts[k]))
    assert {(r.k, r.i, r.s, r.n) for r in run.collect()} == expected


def brute_admission(requests, available):
    taken = set()
    for budget, rest in available.items():
        for _, seq, amount in sorted(r for r in requests if r[0] == budget):
            if amount <= rest:
                rest -= amount
                taken.add((budget, seq))
    return taken


def admitted(spark, requests, available, slice_size=B._SLICE):
    r = spark.createDataFrame(requests, "budget_id string, seq bigint, amount_cents bigint")
    a = spark.createDataFrame(list(available.items()), "budget_id string, available_cents bigint")
    return {(x.budget_id, x.seq) for x in B._admit(r, a, slice_size).collect()}


def test_admission_agrees_with_brute_force(spark):
    random.seed(11)
    available = {"a": 0, "b": 900, "c": 50_000, "d": 3}
    requests = [(b, i * 40_000 + 7, int(10 ** random.uniform(0, 4)))
                for b in available for i in range(60)]
    assert admitted(spark, requests, available) == brute_admission(requests, available)


def test_admission_over_many_slices(spark):
    # Stops in many slices, larger requests that fit late, and amounts far below the rest.
    random.seed(3)
    available = {"wide": 50_000, "tight": 700, "one": 1, "hard": 2**40}
    requests = [(b, i, random.choice([1, 2, 90, 513, 4_000, int(10 ** random.uniform(0, 5))]))
                for b in available for i in range(90)]
    for slice_size in (1, 4, 16):
        assert admitted(spark, requests, available, slice_size) == brute_admission(requests, available)


def test_admission_of_sums_beyond_a_bigint(spark):
    available = {"x": 2**62 + 5, "y": 2**63 - 1}
    requests = [(b, i, 2**61 - i % 3) for b in available for i in range(12)]
    requests += [(b, 20 + i, 2**i) for b in available for i in range(0, 60, 7)]
    assert admitted(spark, requests, available) == brute_admission(requests, available)


def test_assign_batch_order_and_errors(spark):
    requests = spark.createDataFrame(
        [("b", 1, "e1", 600), ("b", 2, "e1", 500), ("b", 3, "e2", 400), ("b", 4, "e1", 0),
         ("b", 5, "e2", -5), ("b", 6, "e9", 1), ("b", 7, "e2", 1)],
        "budget_id string, seq bigint, envelope_id string, amount_cents bigint")
    envelopes = spark.createDataFrame([("e1", "Rent", 10), ("e2", "Food", 0)],
                                      "envelope_id string, name string, balance_cents bigint")
    available = spark.createDataFrame([("b", 1000)], "budget_id string, available_cents bigint")
    outcome, balances = B.assign_batch(requests, envelopes, available)
    got = {r.seq: (r.accepted, r.error) for r in outcome.collect()}
    assert got == {
        1: (True, None), 2: (False, B.EXCEEDS), 3: (True, None), 4: (False, "TokenError"),
        5: (False, "TokenError"), 6: (False, B.NOT_FOUND), 7: (False, B.EXCEEDS)}
    assert {r.envelope_id: r.balance_cents for r in balances.collect()} == {"e1": 610, "e2": 400}


def test_refused_requests(spark, sf_dir):
    ledger = derive_ledger(spark, sf_dir)
    tables = Q.named_tables(ledger)
    for bad in (
        {"table": "raw_pages", "measures": [("COUNT", "*", "n")]},
        {"table": "transactions", "measures": []},
        {"table": "transactions", "measures": [("MEDIAN", "amount_cents", "n")]},
        {"table": "transactions", "measures": [("COUNT", "*", "n")], "group_by": ["description"]},
        {"table": "accounts", "measures": [("MIN", "account_mask", "n")]},
        {"table": "transactions", "measures": [("COUNT", "*", "n")],
         "joins": [("raw_tokens", "statement_id")]},
    ):
        with pytest.raises(Q.QueryError):
            G.guarded_aggregate(tables, **bad)
    mean = G.guarded_aggregate(tables, "transactions", [("AVG", "amount_cents", "mean")])
    assert mean.count() == 1
    for month in ("1998-13", "98-01", "1998-1", None.__class__):
        with pytest.raises(Q.QueryError):
            Q.month_bounds(month)
    with pytest.raises(Q.QueryError):
        Q.financial_summary(ledger, "description")
    with pytest.raises(Q.QueryError):
        Q.recent_statements(ledger, 0)


def test_bridge_strict(spark, sf_dir):
    summaries = derive_ledger(spark, sf_dir).brokerage_summaries
    bridged = summaries.filter("opening_portfolio_cents IS NOT NULL")
    assert Q.portfolio_bridge_total(bridged, strict=True).first().status == "passed"
    off = bridged.withColumn("closing_portfolio_cents", F.col("closing_portfolio_cents") + 1)
    assert Q.portfolio_bridge_total(off).first().status == "mismatch"
    with pytest.raises(Exception, match="portfolio bridge: absent"):
        Q.portfolio_bridge_total(summaries, strict=True).collect()


def test_derived_ledger_reconciles(spark, sf_dir):
    ledger = derive_ledger(spark, sf_dir)
    assert V.reconcile(ledger).count() == 0
    assert V.check_category_domain(ledger).count() == 0


def test_month_filter_reaches_the_scan(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    derive_ledger(spark, sf_dir).transactions.write.parquet(path)
    plan = Q.monthly_aggregates(spark.read.parquet(path), "1997-05")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(post_date,1997-05-01)" in plan


def test_audit_order(spark):
    cases = {
        "": "empty", "INSERT INTO accounts VALUES (1)": "not_select",
        "SELECT 1; -- x": "injection_pattern", "SELECT 1; DROP TABLE t": "injection_pattern",
        "SELECT COUNT(*) FROM accounts WHERE 1=1 OR 1 = 1": "injection_pattern",
        "SELECT * FROM accounts": "select_star", "SELECT COUNT(*) FROM raw_pages": "raw_table",
        "SELECT COUNT(*) FROM statements JOIN users ON 1": "join_table_not_allowed",
        "SELECT COUNT(*) FROM users": "from_table_not_allowed",
        "SELECT COUNT(*) FROM statements, users": "comma_join_not_allowed",
        "SELECT page_text, COUNT(*) FROM statements": "forbidden_column",
        "SELECT account_id FROM accounts": "no_aggregate",
        "select Sum(amount_cents) from transactions": "accepted",
    }
    log = spark.createDataFrame([(q,) for q in cases], "sql_text string")
    got = {r.sql_text: r.verdict for r in G.audit_query_log(log).collect()}
    assert got == cases


def test_legacy_header_positions(spark):
    """Empty header cells do not count when a column's place is looked up."""
    rows = spark.createDataFrame(
        [("d", 0, 0, ["Date", "", "Description", "Amount"]),
         ("d", 0, 1, ["01/05/2024", "Dividend", "$5.00"]),
         ("d", 0, 2, ["", "carried forward", ""]),
         ("d", 1, 0, ["Symbol", "Value"]), ("d", 1, 1, ["ABC", "1"])],
        "doc_id string, table_index int, row_index int, cells array<string>")
    periods = spark.sql("SELECT 'd' AS doc_id, DATE'2024-01-01' AS period_start, "
                        "DATE'2024-01-31' AS period_end")
    lines, violations = LG.legacy_table_rows(rows, periods)
    assert violations.count() == 0
    assert [(r.description, r.amount_cents, r.transaction_type) for r in lines.collect()] == [
        ("Dividend", 500, "credit")]
