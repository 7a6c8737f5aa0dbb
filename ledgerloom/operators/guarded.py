"""Aggregate-only access to the ledger, and the audit of logged query text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.redact import ROW_PII_NAMES
from ledgerloom.functions.tokens import WS, strip
from ledgerloom.operators.ledger_queries import QueryError

# What an aggregate request may touch.
ALLOWED_TABLES = (
    "accounts", "extraction_runs", "statement_brokerage_summaries",
    "statement_credit_summaries", "statement_depository_summaries", "statements",
    "transactions",
)
FORBIDDEN_COLUMNS = ROW_PII_NAMES
AGGREGATE_NAMES = ("SUM", "COUNT", "AVG", "MIN", "MAX", "SUM_DISTINCT", "COUNT_DISTINCT")
INJECTION_PATTERN = (
    r"(?id)(?:--\s|;\s*DROP\s|;\s*ALTER\s|;\s*DELETE\s|;\s*INSERT\s|;\s*UPDATE\s"
    r"|\bOR\b\s+\d+\s*=.*\b\d+)"
)

_AGGREGATES = {
    "SUM": F.sum,
    "COUNT": F.count,
    "AVG": F.avg,
    "MIN": F.min,
    "MAX": F.max,
    "SUM_DISTINCT": F.sum_distinct,
    "COUNT_DISTINCT": F.count_distinct,
}
_COMPARISONS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v),
}


def _check_table(name: str) -> None:
    if name.lower() not in ALLOWED_TABLES:
        raise QueryError(f"table {name!r} is not open to aggregate requests")


def _check_column(name: str) -> None:
    if name.lower() in FORBIDDEN_COLUMNS:
        raise QueryError(f"column {name!r} is row-level and cannot be used")


def guarded_aggregate(
    tables: Mapping[str, DataFrame],
    table: str,
    measures: Sequence[tuple[str, str, str]],
    group_by: Sequence[str] = (),
    joins: Sequence[tuple[str, str]] = (),
    where: Sequence[tuple[str, str, Any]] = (),
) -> DataFrame:
    """Run one aggregate request given as data.

    ``measures`` are (function, column or ``*``, output name); ``joins`` are (table, shared
    column) inner equi joins; ``where`` are (column, comparison, literal), all required.
    """
    if not measures:
        raise QueryError("at least one aggregate measure is required")
    for name in (table, *(other for other, _ in joins)):
        _check_table(name)
    mentioned = [*group_by, *(key for _, key in joins), *(column for column, _, _ in where),
                 *(column for _, column, _ in measures)]
    for column in mentioned:
        _check_column(column)

    frame = tables[table]
    for other, key in joins:
        right = tables[other]
        shared = [c for c in right.columns if c in frame.columns and c != key]
        ambiguous = sorted(set(shared) & set(mentioned))
        if ambiguous:
            raise QueryError(f"column in more than one table: {', '.join(ambiguous)}")
        frame = frame.join(right.drop(*shared), key)
    for column, comparison, literal in where:
        if comparison not in _COMPARISONS:
            raise QueryError(f"unknown comparison {comparison!r}")
        frame = frame.filter(_COMPARISONS[comparison](F.col(column), literal))
    return frame.groupBy(*group_by).agg(*[_measure(*m) for m in measures])


def _measure(function: str, column: str, name: str) -> Column:
    build = _AGGREGATES.get(function.upper())
    if build is None:
        raise QueryError(f"aggregate {function!r} is not allowed")
    if column == "*" and function.upper() != "COUNT":
        raise QueryError(f"{function} needs a column")
    return build(F.lit(1) if column == "*" else F.col(column)).alias(name)


def audit_verdict(sql: Column) -> Column:
    """First broken rule of one logged query text, or ``accepted``."""
    text = strip(sql)
    lower = F.lower(text)
    allowed = F.array(*map(F.lit, ALLOWED_TABLES))

    def outside(pattern: str) -> Column:
        named = F.regexp_extract_all(lower, F.lit(pattern), 1)
        return F.size(F.array_except(named, allowed)) > 0

    comma = F.regexp_extract(lower, r"\bfrom\s+\w+\s*,\s*(\w+)", 1)
    words = "|".join(FORBIDDEN_COLUMNS)
    aggregates = "|".join(AGGREGATE_NAMES)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.upper(F.regexp_extract(text, rf"^[^{WS}]+", 0)) != "SELECT", "not_select")
        .when(text.rlike(INJECTION_PATTERN), "injection_pattern")
        .when(text.rlike(r"(?i)SELECT\s+\*"), "select_star")
        .when(text.rlike(r"(?i)\braw_\w+\b"), "raw_table")
        .when(outside(r"\bjoin\s+(\w+)"), "join_table_not_allowed")
        .when(outside(r"\bfrom\s+(\w+)"), "from_table_not_allowed")
        .when((comma != "") & ~F.array_contains(allowed, comma), "comma_join_not_allowed")
        .when(text.rlike(rf"(?i)\b(?:{words})\b"), "forbidden_column")
        .when(~text.rlike(rf"(?i)\b(?:{aggregates})\s*\("), "no_aggregate")
        .otherwise("accepted")
    )


def audit_query_log(log: DataFrame, column: str = "sql_text") -> DataFrame:
    """Classify every logged query text by the gate's rules, in the gate's order."""
    return log.withColumn("verdict", audit_verdict(F.col(column))).withColumn(
        "accepted", F.col("verdict") == "accepted"
    )
