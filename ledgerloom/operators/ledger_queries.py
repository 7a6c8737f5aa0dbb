"""Queries over the canonical tables. Nested results of the source system come back flat."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schemas import PERSISTENCE, Ledger

ACCOUNT_KEY = ["institution", "account_mask", "account_type"]
# Grouping columns a financial summary accepts.
SUMMARY_GROUPS = ("transaction_category", "statement_id", "account_id")
_MONTH = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])")

_STATEMENT_VIEW = [
    "account_id", "institution", "account_mask", "account_domain", "account_type", "currency",
    "statement_id", "run_id", "raw_payload_id", "statement_start_date", "statement_end_date",
    "opening_balance_cents", "closing_balance_cents", "net_change_cents",
]


class QueryError(ValueError):
    """A request outside what the aggregate and listing queries accept."""


def resolve_accounts(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Get-or-create by (institution, mask, type): (resolved ids, rows to insert).

    An existing id wins; several new rows with one key share the smallest proposed id.
    """
    known = existing.groupBy(*ACCOUNT_KEY).agg(F.min("account_id").alias("_known"))
    fresh = new.groupBy(*ACCOUNT_KEY).agg(
        F.min("account_id").alias("account_id"),
        F.min("account_domain").alias("account_domain"),
        F.min("currency").alias("currency"),
    )
    merged = fresh.join(known, ACCOUNT_KEY, "left")
    resolved = merged.select(
        *ACCOUNT_KEY,
        F.coalesce("_known", "account_id").alias("account_id"),
        F.col("_known").isNull().alias("created"),
    )
    inserts = merged.filter(F.col("_known").isNull()).select(
        "account_id", "institution", "account_mask", "account_domain", "account_type", "currency"
    )
    return resolved, inserts


def _with_accounts(statements: DataFrame, accounts: DataFrame) -> DataFrame:
    return statements.join(accounts.drop("account_domain"), "account_id")


def _with_line_counts(statements: DataFrame, transactions: DataFrame, narrow: bool) -> DataFrame:
    """Add txn_count. ``narrow`` keeps only the lines of these statements before counting."""
    lines = transactions.select("statement_id")
    if narrow:
        lines = lines.join(statements.select("statement_id"), "statement_id", "left_semi")
    counts = lines.groupBy("statement_id").agg(F.count("*").alias("txn_count"))
    return statements.join(counts, "statement_id", "left").withColumn(
        "txn_count", F.coalesce("txn_count", F.lit(0))
    )


def _newest(statements: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return statements
    if limit < 1:
        raise QueryError("limit must be at least 1")
    return statements.orderBy(
        F.col("statement_end_date").desc(), F.col("statement_id").desc()
    ).limit(limit)


def recent_statements(ledger: Ledger, limit: int = 5) -> DataFrame:
    """Newest statements with account header and line count.

    Every statement has its account (foreign key), so the top-k runs before the joins.
    """
    top = _newest(ledger.statements, limit)
    counted = _with_line_counts(
        _with_accounts(top, ledger.accounts), ledger.transactions, narrow=True
    )
    return counted.select(*_STATEMENT_VIEW, "txn_count").orderBy(
        F.col("statement_end_date").desc(), F.col("statement_id").desc()
    )


def account_overview(ledger: Ledger, limit: int | None = None) -> DataFrame:
    """Newest statement of each account among the newest ``limit`` statements (None: all)."""
    columns = [
        "statement_id", "statement_start_date", "statement_end_date", "opening_balance_cents",
        "closing_balance_cents", "net_change_cents",
    ]
    latest = (
        _newest(ledger.statements, limit)
        .groupBy("account_id")
        .agg(F.max(F.struct("statement_end_date", "statement_id", *columns[3:],
                            "statement_start_date")).alias("s"))
        .select("account_id", *[F.col(f"s.{c}").alias(c) for c in columns])
    )
    return _with_accounts(latest, ledger.accounts).select(
        "statement_id", "account_id", "institution", "account_type", "account_mask",
        *columns[1:],
    )


def overview_totals(ledger: Ledger, limit: int | None = None,
                    liabilities_negative: bool = False) -> DataFrame:
    """Account count and summed closing balance of the overview; card debt adds by default."""
    closing = F.col("closing_balance_cents")
    if liabilities_negative:
        closing = F.when(F.col("account_type") == "credit_card", -closing).otherwise(closing)
    return account_overview(ledger, limit).agg(
        F.count("*").alias("account_count"),
        F.coalesce(F.sum(closing), F.lit(0)).cast("bigint").alias("total_closing_cents"),
    )


def run_statements(ledger: Ledger, run_id: str | None = None) -> DataFrame:
    """Statements of one run (or of every run) with account and line count, by start date."""
    statements = ledger.statements
    if run_id is not None:
        statements = statements.filter(F.col("run_id") == run_id)
    counted = _with_line_counts(
        _with_accounts(statements, ledger.accounts), ledger.transactions, narrow=run_id is not None
    )
    return counted.select(*_STATEMENT_VIEW, "txn_count").orderBy(
        "run_id", "statement_start_date", "statement_id"
    )


def run_detail(ledger: Ledger, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Run rows with the number of statements and lines they produced."""
    if run_id is not None:
        runs = runs.filter(F.col("run_id") == run_id)
    statements = ledger.statements.select("run_id", "statement_id", "account_id").join(
        ledger.accounts.select("account_id"), "account_id"
    )
    if run_id is not None:
        statements = statements.filter(F.col("run_id") == run_id)
    per_run = (
        _with_line_counts(statements, ledger.transactions, narrow=run_id is not None)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("statements_count"),
            F.sum("txn_count").cast("bigint").alias("transactions_count"),
        )
    )
    return runs.join(per_run, "run_id", "left").select(
        *runs.columns,
        F.coalesce("statements_count", F.lit(0)).alias("statements_count"),
        F.coalesce("transactions_count", F.lit(0)).alias("transactions_count"),
    )


def statement_detail(ledger: Ledger, statement_id: str | None = None) -> DataFrame:
    """Statement header beside the first sidecar that exists: depository, card, brokerage.

    A statement without any sidecar carries error ``PersistenceError``.
    """
    def only(df: DataFrame) -> DataFrame:
        return df if statement_id is None else df.filter(F.col("statement_id") == statement_id)

    depository = only(ledger.depository_summaries).withColumn("_dep", F.lit(True))
    card = only(ledger.credit_summaries).withColumn("_card", F.lit(True))
    brokerage = only(ledger.brokerage_summaries).withColumn("_brok", F.lit(True))
    joined = (
        only(ledger.statements)
        .join(depository, "statement_id", "left")
        .join(card, "statement_id", "left")
        .join(brokerage, "statement_id", "left")
    )
    kind = (
        F.when(F.col("_dep"), F.lit("depository"))
        .when(F.col("_card"), F.lit("revolving_credit"))
        .when(F.col("_brok"), F.lit("custodial_brokerage"))
    )
    return joined.withColumn("sidecar", kind).withColumn(
        "error", F.when(F.col("sidecar").isNull(), F.lit(PERSISTENCE))
    ).drop("_dep", "_card", "_brok")


def statement_lines(ledger: Ledger, statement_id: str | None = None) -> DataFrame:
    """Transactions of a statement (or all) by post date, then line."""
    lines = ledger.transactions
    if statement_id is not None:
        lines = lines.filter(F.col("statement_id") == statement_id)
    return lines.orderBy("statement_id", "post_date", "line_no")


def statement_holdings(ledger: Ledger, statement_id: str | None = None) -> DataFrame:
    """Positions of a statement (or all) by symbol."""
    rows = ledger.holdings
    if statement_id is not None:
        rows = rows.filter(F.col("statement_id") == statement_id)
    return rows.orderBy("statement_id", "symbol", "holding_id")


def ledger_blocks(ledger: Ledger, limit: int | None = 5, run_id: str | None = None,
                  statement_id: str | None = None) -> DataFrame:
    """Statement blocks in long form: one header row, then its lines, then its positions.

    Rows stay rows instead of arrays, so a block of any length is spread over tasks.
    """
    statements = ledger.statements
    if statement_id is not None:
        statements = statements.filter(F.col("statement_id") == statement_id)
    elif run_id is not None:
        statements = statements.filter(F.col("run_id") == run_id)
    else:
        statements = _newest(statements, limit)
    header = _with_accounts(statements, ledger.accounts).select(
        "statement_id", "institution", "account_type", "account_mask",
        "statement_start_date", "statement_end_date",
        "opening_balance_cents", "closing_balance_cents",
    )
    lines = header.join(
        ledger.transactions.select(
            "statement_id", "line_no", "post_date", "transaction_category", "description",
            "amount_cents",
        ),
        "statement_id",
    ).withColumn("row_kind", F.lit("2-transaction"))
    positions = header.join(
        ledger.holdings.select(
            "statement_id", "holding_id", "symbol", "description", "quantity_nanos",
            "market_value_cents",
        ),
        "statement_id",
    ).withColumn("row_kind", F.lit("3-holding"))
    return (
        header.withColumn("row_kind", F.lit("1-statement"))
        .unionByName(lines, allowMissingColumns=True)
        .unionByName(positions, allowMissingColumns=True)
        .orderBy(
            F.col("statement_end_date").desc(), F.col("statement_id").desc(), "row_kind",
            "post_date", "line_no", "symbol", "holding_id",
        )
    )


def rows_by_key(table: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is asked for, asked-for keys without a row)."""
    hits = table.join(keys.select(key), key, "left_semi")
    misses = keys.select(key).distinct().join(table.select(key), key, "left_anti")
    return hits, misses


def payloads_by_sha(payloads: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows_by_key(payloads, keys, "content_sha256")


def runs_by_id(runs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows_by_key(runs, keys, "run_id")


def _category_sum(category: str) -> Column:
    value = F.when(F.col("transaction_category") == category, F.col("amount_cents"))
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def latest_runs(ledger: Ledger, runs: DataFrame | None = None) -> Ledger:
    """Keep, per account and period, only statements of the newest run.

    ``runs`` (run_id, batch_id) tells which run came later; ids are digests and have no order in
    time. Without it the largest run id is taken. Re-ingested files otherwise count once per run.
    """
    key = ["account_id", "statement_start_date", "statement_end_date"]
    dated = ledger.statements.select(*key, "run_id")
    order = ["run_id"]
    if runs is not None:
        dated, order = dated.join(runs.select("run_id", "batch_id"), "run_id"), ["batch_id", "run_id"]
    newest = dated.groupBy(*key).agg(F.max(F.struct(*order)).alias("_last")).select(
        *key, F.col("_last.run_id").alias("run_id"))
    statements = ledger.statements.join(newest, [*key, "run_id"], "left_semi")
    ids = statements.select("statement_id")
    kept = {
        name: frame.join(ids, "statement_id", "left_semi")
        for name, frame in ledger.tables().items()
        if name not in ("accounts", "statements")
    }
    return Ledger(accounts=ledger.accounts, statements=statements, **kept)


def category_totals(transactions: DataFrame) -> DataFrame:
    return transactions.agg(
        F.count("*").alias("total_transactions"),
        _category_sum("deposit").alias("total_deposits_cents"),
        _category_sum("purchase").alias("total_purchases_cents"),
        _category_sum("withdrawal").alias("total_withdrawals_cents"),
    )


def _grouped_sums(rows: DataFrame, *group: str) -> DataFrame:
    return rows.groupBy(*group).agg(
        F.count("*").alias("txn_count"),
        _category_sum("deposit").alias("deposits_cents"),
        _category_sum("purchase").alias("purchases_cents"),
        _category_sum("withdrawal").alias("withdrawals_cents"),
    )


def financial_summary(ledger: Ledger, group_by: str) -> DataFrame:
    """Category sums per group, largest group first."""
    if group_by not in SUMMARY_GROUPS:
        raise QueryError(f"group_by must be one of {SUMMARY_GROUPS}, got {group_by!r}")
    rows = ledger.transactions
    if group_by == "account_id":
        # Collapse lines to statements before the join, so it moves one row per statement.
        per_statement = _grouped_sums(rows, "statement_id")
        summed = (
            per_statement.join(
                ledger.statements.select("statement_id", "account_id"), "statement_id"
            )
            .groupBy("account_id")
            .agg(*[
                F.sum(c).cast("bigint").alias(c)
                for c in ("txn_count", "deposits_cents", "purchases_cents", "withdrawals_cents")
            ])
        )
    else:
        summed = _grouped_sums(rows, group_by)
    return summed.orderBy(F.col("txn_count").desc(), group_by)


def month_bounds(month: str) -> tuple[date, date]:
    """First day of a YYYY-MM month and of the next one."""
    if not isinstance(month, str) or _MONTH.fullmatch(month) is None:
        raise QueryError(f"month must look like YYYY-MM, got {month!r}")
    year, number = int(month[:4]), int(month[5:])
    following = (year + 1, 1) if number == 12 else (year, number + 1)
    return date(year, number, 1), date(*following, 1)


def monthly_aggregates(transactions: DataFrame, month: str | None = None) -> DataFrame:
    """Line count and category sums per calendar month. A month filter is a date range."""
    rows = transactions
    if month is not None:
        first, following = month_bounds(month)
        rows = rows.filter((F.col("post_date") >= first) & (F.col("post_date") < following))
    return _grouped_sums(
        rows.withColumn("month", F.date_format("post_date", "yyyy-MM")), "month"
    ).orderBy("month")


# Terms of the portfolio bridge; transfers out are subtracted.
BRIDGE_TERMS = {
    "opening_portfolio_cents": 1, "transfers_in_cents": 1, "transfers_out_cents": -1,
    "income_dividends_cents": 1, "realized_gains_cents": 1, "unrealized_gains_cents": 1,
}


def portfolio_bridge_total(brokerage_summaries: DataFrame, strict: bool = False) -> DataFrame:
    """The bridge equation over all sidecars: status ``passed``, ``absent`` or ``mismatch``.

    Any null term means the bridge is absent; nulls never count as zero. ``strict`` makes the
    query itself fail on any status but ``passed``.
    """
    columns = [*BRIDGE_TERMS, "closing_portfolio_cents"]
    any_null = F.lit(False)
    for c in columns:
        any_null = any_null | F.col(c).isNull()
    totals = brokerage_summaries.agg(
        F.count("*").alias("statement_count"),
        F.count_if(any_null).alias("null_bridge_count"),
        *[F.sum(c).cast("bigint").alias(c) for c in columns],
    )
    computed = sum(
        (F.col(c) * sign for c, sign in BRIDGE_TERMS.items()), start=F.lit(0).cast("bigint")
    )
    status = (
        F.when((F.col("statement_count") == 0) | (F.col("null_bridge_count") > 0), "absent")
        .when(F.col("_computed") != F.col("closing_portfolio_cents"), "mismatch")
        .otherwise("passed")
    )
    result = totals.withColumn("_computed", computed).withColumn("status", status)
    if strict:
        failed = F.raise_error(F.concat(F.lit("portfolio bridge: "), F.col("status")))
        result = result.withColumn(
            "status", F.when(F.col("status") == "passed", F.col("status")).otherwise(failed)
        )
    shown = F.col("status") != "absent"
    return result.select(
        "status", "statement_count", "null_bridge_count",
        *[F.when(shown, F.col(c)).alias(c) for c in columns],
        F.when(shown, F.col("_computed")).alias("computed_closing_portfolio_cents"),
    )


def named_tables(ledger: Ledger, runs: DataFrame | None = None) -> Mapping[str, DataFrame]:
    """The ledger under the table names that aggregate requests use."""
    tables = {
        "statements": ledger.statements,
        "accounts": ledger.accounts,
        "transactions": ledger.transactions,
        "statement_depository_summaries": ledger.depository_summaries,
        "statement_credit_summaries": ledger.credit_summaries,
        "statement_brokerage_summaries": ledger.brokerage_summaries,
    }
    if runs is not None:
        tables["extraction_runs"] = runs
    return tables
