"""Registered queries of the balance and contract checks, each on a ledger with planted faults."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import legacy as LG
from ledgerloom.operators import outcome as OUT
from ledgerloom.operators import reconcile as V
from ledgerloom.plans import derive as D
from ledgerloom.plans.oracle import on_ledger
from ledgerloom.rules import BROKERAGE, CARD
from ledgerloom.schemas import Ledger


def _ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    return D.derive_ledger(spark, sf_dir)


def _hit(account_id: str = "account_id", rest: int = 13) -> Column:
    return F.col(account_id).cast("bigint") % 97 == rest


def _statement_hit(rest: int = 13) -> Column:
    return F.substring_index("statement_id", "-", 1).cast("bigint") % 97 == rest


def _cent_more(frame: DataFrame, column: str, hit: Column) -> DataFrame:
    return frame.withColumn(column, F.col(column) + F.when(hit, F.lit(1)).otherwise(F.lit(0)))


def closing_off(spark, sf_dir) -> Ledger:
    ledger = _ledger(spark, sf_dir)
    return replace(
        ledger, statements=_cent_more(ledger.statements, "closing_balance_cents", _hit())
    )


def bucket_off(spark, sf_dir) -> Ledger:
    """One cent too many in the first bucket of each kind of sidecar."""
    ledger = _ledger(spark, sf_dir)
    return replace(
        ledger,
        depository_summaries=_cent_more(
            ledger.depository_summaries, "deposits_cents", _statement_hit()
        ),
        credit_summaries=_cent_more(
            ledger.credit_summaries, "purchases_cents", _statement_hit()
        ),
        brokerage_summaries=_cent_more(
            ledger.brokerage_summaries, "closing_portfolio_cents", _statement_hit()
        ),
    )


def running_off(spark, sf_dir) -> Ledger:
    """A wrong first balance for some accounts, a missing second one for others."""
    ledger = _ledger(spark, sf_dir)
    balance = F.col("balance_after_cents")
    changed = (
        F.when(_statement_hit(13) & (F.col("line_no") == 1), balance + 1)
        .when(_statement_hit(14) & (F.col("line_no") == 2), F.lit(None).cast("bigint"))
        .otherwise(balance)
    )
    lines = ledger.transactions.withColumn("balance_after_cents", changed)
    return replace(ledger, transactions=lines)


def dates_off(spark, sf_dir) -> Ledger:
    ledger = _ledger(spark, sf_dir)
    hit = F.col("transaction_id").cast("bigint") % 97 == 13
    moved = F.when(hit, F.date_add("post_date", 40)).otherwise(F.col("post_date"))
    return replace(ledger, transactions=ledger.transactions.withColumn("post_date", moved))


def signs_off(spark, sf_dir) -> Ledger:
    ledger = _ledger(spark, sf_dir)
    hit = F.col("transaction_id").cast("bigint") % 97 == 13
    flipped = F.when(hit, -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    return replace(ledger, transactions=ledger.transactions.withColumn("amount_cents", flipped))


def categories_off(spark, sf_dir) -> Ledger:
    ledger = _ledger(spark, sf_dir)
    hit = F.col("transaction_id").cast("bigint") % 97 == 13
    changed = F.when(hit, F.lit("purchase")).otherwise(F.col("transaction_category"))
    return replace(
        ledger, transactions=ledger.transactions.withColumn("transaction_category", changed)
    )


def types_off(spark, sf_dir) -> DataFrame:
    accounts = _ledger(spark, sf_dir).accounts
    wrong = F.when(F.col("account_domain") == CARD, F.lit("checking")).otherwise(
        F.lit("credit_card")
    )
    return accounts.withColumn(
        "account_type", F.when(_hit(), wrong).otherwise(F.col("account_type"))
    )


def printed_holdings(spark, sf_dir) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    printed = ledger.holdings.groupBy("statement_id").agg(
        F.sum("market_value_cents").cast("bigint").alias("printed_total_cents")
    )
    return _cent_more(printed, "printed_total_cents", _statement_hit())


def check_holdings_total(spark, sf_dir):
    ledger = _ledger(spark, sf_dir)
    late = _statement_hit(14)
    holdings = ledger.holdings.withColumn(
        "as_of_date", F.when(late, F.date_add("as_of_date", 1)).otherwise(F.col("as_of_date"))
    )
    return _brief(V.check_holdings_total(
        replace(ledger, holdings=holdings), printed_holdings(spark, sf_dir)
    ))


def check_combined_total(spark, sf_dir):
    """Neighbouring accounts share one run per month; the printed total is off for some."""
    ledger = _ledger(spark, sf_dir)
    pair = F.floor(F.col("account_id").cast("bigint") / 2)
    statements = ledger.statements.withColumn(
        "run_id", F.concat_ws("-", F.lit("pair"), pair.cast("string"),
                              F.date_format("statement_start_date", "yyyyMM")),
    )
    key = F.split_part("run_id", F.lit("-"), F.lit(2)).cast("bigint")
    printed = statements.groupBy("run_id").agg(
        F.sum("closing_balance_cents").cast("bigint").alias("printed_total_cents")
    )
    printed = _cent_more(printed, "printed_total_cents", key % 97 == 13)
    return V.check_combined_total(replace(ledger, statements=statements), printed)


def broken_contract(spark, sf_dir) -> Ledger:
    """One kind of planted fault per remainder of the account or order number."""
    ledger = _ledger(spark, sf_dir)
    order = F.col("transaction_id").cast("bigint") % 97
    held = F.substring_index("holding_id", "-", 1).cast("bigint") % 97

    def swap(condition: Column, value: Column, column: str) -> Column:
        return F.when(condition, value).otherwise(F.col(column))

    statements = ledger.statements.withColumns({
        "raw_payload_id": swap(_hit(rest=14), F.lit("p-other"), "raw_payload_id"),
        "run_id": swap(_hit(rest=18), F.lit("run-none"), "run_id"),
    })
    transactions = ledger.transactions.withColumns({
        "amount_cents": swap(order == 16, F.lit(0).cast("bigint"), "amount_cents"),
        "statement_id": swap(order == 17, F.lit("s-none"), "statement_id"),
        "description": swap(order == 19, F.lit(""), "description"),
        "transaction_category": swap(order == 20, F.lit("gift"), "transaction_category"),
    })
    holdings = ledger.holdings.withColumn(
        "quantity_nanos", swap(held == 21, F.lit(0).cast("bigint"), "quantity_nanos")
    )
    twice = holdings.filter(held == 22)
    return replace(
        ledger,
        accounts=ledger.accounts.withColumn(
            "currency", swap(_hit(rest=13), F.lit("EUR"), "currency")
        ),
        statements=statements,
        transactions=transactions,
        holdings=holdings.unionByName(twice),
        depository_summaries=ledger.depository_summaries.filter(~_statement_hit(15)),
        credit_summaries=_cent_more(
            ledger.credit_summaries, "previous_balance_cents", _statement_hit(23)
        ),
        brokerage_summaries=ledger.brokerage_summaries.withColumn(
            "closing_portfolio_cents",
            swap(_statement_hit(24), F.lit(None).cast("bigint"), "closing_portfolio_cents"),
        ),
    )


def check_persistence_contract(spark, sf_dir):
    runs = _ledger(spark, sf_dir).statements.select("run_id", "raw_payload_id")
    return V.check_persistence_contract(broken_contract(spark, sf_dir), runs)


CONTRACT = on_ledger("""
SELECT *, 'PersistenceError' AS code FROM (
SELECT 'accounts' AS "table", account_id AS key, 'currency' AS rule FROM acc
  WHERE account_key % 97 = 13
UNION ALL SELECT 'accounts', institution || '|' || account_mask || '|' || account_type,
  'duplicate_institution_account_mask_account_type' FROM acc
  GROUP BY institution, account_mask, account_type HAVING count(*) > 1
UNION ALL SELECT 'statements', statement_id, 'payload_differs_from_run' FROM st
  WHERE account_key % 97 = 14
UNION ALL SELECT 'statements', statement_id, 'run_unknown' FROM st WHERE account_key % 97 = 18
UNION ALL SELECT 'statements', statement_id, 'own_sidecar_missing' FROM dep
  WHERE account_key % 97 = 15
UNION ALL SELECT 'statements', statement_id, 'depository_bucket_negative' FROM dep
  WHERE fees_cents < 0 AND account_key % 97 <> 15
UNION ALL SELECT 'statements', statement_id, 'card_bucket_negative' FROM card
  WHERE fees_charged_cents < 0
UNION ALL SELECT 'statements', statement_id, 'card_balances_differ' FROM card
  WHERE account_key % 97 = 23
UNION ALL SELECT 'statements', statement_id, 'half_portfolio' FROM brok
  WHERE account_key % 97 = 24 AND opening_portfolio_cents IS NOT NULL
UNION ALL SELECT 'transactions', transaction_id, 'amount_zero' FROM txn WHERE order_key % 97 = 16
UNION ALL SELECT 'transactions', transaction_id, 'statement_id_unknown' FROM txn
  WHERE order_key % 97 = 17
UNION ALL SELECT 'transactions', transaction_id, 'description_empty' FROM txn
  WHERE order_key % 97 = 19
UNION ALL SELECT 'transactions', transaction_id, 'category_unknown' FROM txn
  WHERE order_key % 97 = 20
UNION ALL SELECT 'holdings', holding_id, 'quantity_zero' FROM hold
  WHERE CAST(split_part(holding_id, '-', 1) AS BIGINT) % 97 = 21
UNION ALL SELECT 'holdings', holding_id, 'duplicate_holding_id' FROM hold GROUP BY holding_id
  HAVING count(*) > 1 OR CAST(split_part(holding_id, '-', 1) AS BIGINT) % 97 = 22)""")


def _brief(findings: DataFrame) -> DataFrame:
    return findings.select("statement_id", "rule", "seq", "code")


def _keyed(findings: DataFrame) -> DataFrame:
    return findings.select("statement_id", "rule", "code")


def mixed_faults(spark, sf_dir) -> Ledger:
    """Closing, running balance, date and sign faults together, for the order of findings."""
    ledger = _ledger(spark, sf_dir)
    order = F.col("transaction_id").cast("bigint") % 97
    off = running_off(spark, sf_dir).transactions
    lines = off.withColumns({
        "post_date": F.when(order.isin(13, 15), F.date_add("post_date", 40))
        .otherwise(F.col("post_date")),
        "amount_cents": F.when(order.isin(15, 17), -F.col("amount_cents"))
        .otherwise(F.col("amount_cents")),
    })
    return replace(
        ledger, transactions=lines,
        statements=_cent_more(ledger.statements, "closing_balance_cents", _hit(rest=16)),
    )


def _failures(spark, sf_dir) -> DataFrame:
    findings = V.first_findings(mixed_faults(spark, sf_dir)).withColumnRenamed(
        "statement_id", "doc_id"
    )
    return OUT.first_failure(findings.select("doc_id", "stage", "seq", "code", "message"))


def first_failure(spark, sf_dir):
    return _failures(spark, sf_dir).select("doc_id", "stage", "code")


def run_status(spark, sf_dir):
    runs = _ledger(spark, sf_dir).statements.select("run_id", "raw_payload_id")
    return OUT.run_status(runs, _failures(spark, sf_dir)).select(
        "run_id", "status", "error_code"
    )


# The lines as planted, and each statement's earliest finding.
MIXED = """ml AS (
  SELECT t.statement_id, t.account_key, t.line_no, t.account_domain, t.transaction_category,
    CASE WHEN order_key % 97 IN (13, 15) THEN CAST(t.post_date + INTERVAL 40 DAY AS DATE)
      ELSE t.post_date END AS post_date,
    CASE WHEN order_key % 97 IN (15, 17) THEN -amount_cents ELSE amount_cents END AS amount_cents,
    CASE WHEN t.account_key % 97 = 13 AND line_no = 1 THEN balance_after_cents + 1
      WHEN t.account_key % 97 = 14 AND line_no = 2 THEN NULL
      ELSE balance_after_cents END AS balance, amount_cents AS true_amount
  FROM txn t
), mr AS (
  SELECT ml.*, s.opening_balance_cents + sum(ml.amount_cents) OVER (PARTITION BY ml.statement_id
      ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS expected, s.statement_end_date AS last_day
  FROM ml JOIN st s ON s.statement_id = ml.statement_id
), mf AS (
  SELECT s.statement_id, CASE
    WHEN s.account_key % 97 = 16 THEN 60
    WHEN sum(mr.amount_cents) <> any_value(s.net_change_cents) THEN 61
    WHEN bool_or(balance IS NULL OR balance <> expected) AND bool_or(balance IS NOT NULL) THEN 62
    WHEN bool_or(post_date > last_day) OR bool_or(amount_cents <> true_amount
      AND mr.transaction_category <> 'trade_cash') THEN 63 END AS stage,
    min(CASE WHEN post_date > last_day THEN line_no * 2 END) AS first_date,
    min(CASE WHEN amount_cents <> true_amount AND mr.transaction_category <> 'trade_cash'
      THEN line_no * 2 + 1 END) AS first_sign
  FROM st s JOIN mr ON mr.statement_id = s.statement_id GROUP BY s.statement_id, s.account_key
), mc AS (
  SELECT statement_id, stage, CASE WHEN stage IS NULL THEN NULL
    WHEN stage < 63 THEN 'InvariantError'
    WHEN first_date IS NOT NULL AND (first_sign IS NULL OR first_date < first_sign)
      THEN 'InvariantError' ELSE 'TokenError' END AS code
  FROM mf
)"""


def _legacy_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Brokerage statements in the unsigned form; some lines are out of order or period."""
    ledger = _ledger(spark, sf_dir)
    mine = ledger.statements.filter(F.col("account_domain") == BROKERAGE)
    keys = mine.select("statement_id")
    early = _statement_hit(13) & (F.col("line_no") == 1)
    moved = F.when(early, F.date_sub("post_date", 40)).otherwise(F.col("post_date"))
    turned = F.when(_statement_hit(14), -F.col("line_no")).otherwise(F.col("line_no"))
    lines = ledger.transactions.join(keys, "statement_id", "left_semi").select(
        F.col("statement_id").alias("doc_id"), turned.alias("line_no"), moved.alias("post_date"),
        F.when(F.col("amount_cents") < 0, F.lit("debit")).otherwise(F.lit("credit"))
        .alias("transaction_type"),
        F.abs("amount_cents").alias("amount_cents"),
    )
    hit = _hit(rest=15)
    periods = mine.select(
        F.col("statement_id").alias("doc_id"),
        F.when(hit, F.col("statement_end_date")).otherwise(F.col("statement_start_date"))
        .alias("period_start"),
        F.when(hit, F.col("statement_start_date")).otherwise(F.col("statement_end_date"))
        .alias("period_end"),
        F.col("opening_balance_cents").alias("start_balance_cents"),
        (F.col("closing_balance_cents") - F.when(_hit(), F.lit(1)).otherwise(F.lit(0)))
        .alias("end_balance_cents"),
    )
    return lines, periods


def check_date_continuity(spark, sf_dir):
    lines, periods = _legacy_lines(spark, sf_dir)
    return LG.check_date_continuity(
        lines, periods.select("doc_id", "period_start", "period_end")
    ).select("doc_id", "rule", "code")


def check_cash_balance(spark, sf_dir):
    lines, periods = _legacy_lines(spark, sf_dir)
    return LG.check_cash_balance(
        lines, periods.select("doc_id", "start_balance_cents", "end_balance_cents")
    )


DATES = """ll AS (
  SELECT statement_id AS doc_id, account_key % 97 AS m,
    CASE WHEN account_key % 97 = 14 THEN -line_no ELSE line_no END AS line_no,
    CASE WHEN account_key % 97 = 13 AND line_no = 1 THEN CAST(post_date - INTERVAL 40 DAY AS DATE)
      ELSE post_date END AS post_date, month_start
  FROM txn WHERE account_domain = 'custodial_brokerage'
), lp AS (SELECT *, lag(post_date) OVER (PARTITION BY doc_id ORDER BY line_no) AS prior FROM ll)"""


def _sql_findings(rule: str, where: str, source: str = "st", code: str = "InvariantError") -> str:
    return on_ledger(
        f"SELECT statement_id, '{rule}' AS rule, '{code}' AS code FROM {source} WHERE {where}"
    )


_HIT = "account_key % 97 = 13"

QUERIES: dict[str, tuple] = {
    "check_net_change": (
        lambda s, d: _keyed(V.check_net_change(closing_off(s, d))),
        _sql_findings("net_change", _HIT),
    ),
    "check_balance_identity": (
        lambda s, d: _keyed(V.check_balance_identity(closing_off(s, d))),
        _sql_findings("balance_identity", _HIT),
    ),
    "check_running_balance": (
        lambda s, d: _brief(V.check_running_balance(running_off(s, d))),
        on_ledger("SELECT statement_id, 'running_balance' AS rule, line_no AS seq, "
                  "'InvariantError' AS code FROM txn WHERE (account_key % 97 = 13 AND line_no = 1) "
                  "OR (account_key % 97 = 14 AND line_no = 2)"),
    ),
    "check_post_dates": (
        lambda s, d: _brief(V.check_post_dates(dates_off(s, d))),
        on_ledger("SELECT statement_id, 'post_date' AS rule, 2 * line_no AS seq, "
                  "'InvariantError' AS code FROM txn WHERE order_key % 97 = 13"),
    ),
    "check_signs": (
        lambda s, d: _brief(V.check_signs(signs_off(s, d))),
        on_ledger("SELECT statement_id, 'category_sign' AS rule, 2 * line_no + 1 AS seq, "
                  "'TokenError' AS code FROM txn WHERE order_key % 97 = 13 "
                  "AND transaction_category <> 'trade_cash'"),
    ),
    "check_category_domain": (
        lambda s, d: V.check_category_domain(categories_off(s, d)),
        on_ledger("SELECT statement_id, line_no, account_domain, 'purchase' AS "
                  "transaction_category, 'ValueError' AS code FROM txn "
                  "WHERE order_key % 97 = 13 AND account_domain <> 'revolving_credit'"),
    ),
    "check_type_domain": (
        lambda s, d: V.check_type_domain(types_off(s, d)),
        on_ledger("SELECT account_id, account_domain, CASE WHEN account_domain = "
                  "'revolving_credit' THEN 'checking' ELSE 'credit_card' END AS account_type, "
                  f"'ValueError' AS code FROM acc WHERE {_HIT}"),
    ),
    "check_depository_equation": (
        lambda s, d: _keyed(V.check_depository_equation(bucket_off(s, d))),
        _sql_findings("depository_equation", _HIT, "dep"),
    ),
    "check_depository_buckets": (
        lambda s, d: _keyed(V.check_depository_buckets(bucket_off(s, d))),
        _sql_findings("deposits_bucket", _HIT, "dep"),
    ),
    "check_card_equation": (
        lambda s, d: _keyed(V.check_card_equation(bucket_off(s, d))),
        _sql_findings("card_equation", _HIT, "card"),
    ),
    "check_card_buckets": (
        lambda s, d: _keyed(V.check_card_buckets(bucket_off(s, d))),
        _sql_findings("purchases_bucket", _HIT, "card"),
    ),
    "check_brokerage_cash": (
        lambda s, d: _keyed(V.check_brokerage_cash(closing_off(s, d))),
        _sql_findings("cash_closing", "account_domain = 'custodial_brokerage' AND " + _HIT),
    ),
    "check_portfolio_bridge": (
        lambda s, d: _keyed(V.check_portfolio_bridge(bucket_off(s, d))),
        _sql_findings("portfolio_bridge", _HIT + " AND opening_portfolio_cents IS NOT NULL",
                      "brok"),
    ),
    "check_holdings_total": (
        check_holdings_total,
        on_ledger("SELECT DISTINCT statement_id, CASE WHEN k = 14 THEN 'holding_date' ELSE "
                  "'holdings_total' END AS rule, CAST(CASE WHEN k = 14 THEN 0 ELSE 1 END AS "
                  "BIGINT) AS seq, 'InvariantError' AS code FROM (SELECT statement_id, "
                  "CAST(split_part(statement_id, '-', 1) AS BIGINT) % 97 AS k FROM hold) "
                  "WHERE k IN (13, 14)"),
    ),
    "check_combined_total": (
        check_combined_total,
        on_ledger("SELECT 'pair-' || CAST(account_key // 2 AS VARCHAR) || '-' || "
                  "strftime(month_start, '%Y%m') AS run_id, CAST(sum(closing_balance_cents) + 1 "
                  "AS BIGINT) AS printed_total_cents, CAST(sum(closing_balance_cents) AS BIGINT) "
                  "AS closing_total_cents, 'InvariantError' AS code FROM st "
                  "WHERE (account_key // 2) % 97 = 13 GROUP BY account_key // 2, month_start"),
    ),
    "check_persistence_contract": (check_persistence_contract, CONTRACT),
    "check_date_continuity": (
        check_date_continuity,
        on_ledger("SELECT DISTINCT doc_id, CASE WHEN m = 15 THEN 'period_inverted' WHEN m = 13 "
                  "THEN 'date_outside_period' ELSE 'dates_not_ascending' END AS rule, "
                  "'ValueError' AS code FROM lp WHERE m = 15 OR post_date < month_start "
                  "OR post_date < prior", DATES),
    ),
    "check_cash_balance": (
        check_cash_balance,
        on_ledger("SELECT statement_id AS doc_id, CAST(1 AS BIGINT) AS difference_cents, "
                  "'ValueError' AS code FROM st WHERE account_domain = 'custodial_brokerage' "
                  f"AND {_HIT}"),
    ),
    "first_failure": (
        first_failure,
        on_ledger("SELECT statement_id AS doc_id, stage, code FROM mc WHERE stage IS NOT NULL",
                  MIXED),
    ),
    "run_status": (
        run_status,
        on_ledger("SELECT statement_id AS run_id, CASE WHEN code IS NULL THEN "
                  "'canonical_persisted' ELSE 'failed' END AS status, code AS error_code FROM mc",
                  MIXED),
    ),
}
