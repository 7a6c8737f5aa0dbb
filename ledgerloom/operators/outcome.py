"""Per document: the first failure in reading order, the run's final state, what may be stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import reconcile as V
from ledgerloom.operators.document_checks import COMBINED_TOTAL_STAGE
from ledgerloom.operators.layouts import LAYOUT_VERSION
from ledgerloom.operators.parse import ParsedLedger, parse_statements
from ledgerloom.schemas import Ledger
from ledgerloom.sources.stage import staged


class StatementError(RuntimeError):
    """Raised in strict mode when some document failed."""


def first_failure(violations: DataFrame, key: str = "doc_id") -> DataFrame:
    """The earliest violation of each document; partial minima combine on the map side."""
    first = F.min(F.struct("stage", "seq", "code", "message")).alias("f")
    return violations.groupBy(key).agg(first).select(key, "f.*")


def run_status(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Final state of each run: failed with code and message, else canonical_persisted."""
    found = failures.select(
        F.col("doc_id").alias("run_id"), F.col("code").alias("_code"),
        F.col("message").alias("_message"),
    )
    joined = runs.drop("status", "error_code", "error_message").join(found, "run_id", "left")
    return joined.withColumns({
        "status": F.when(F.col("_code").isNotNull(), "failed").otherwise("canonical_persisted"),
        "error_code": F.col("_code"),
        "error_message": F.col("_message"),
    }).drop("_code", "_message")


def all_violations(parsed: ParsedLedger, earliest: bool = False) -> DataFrame:
    """Parse findings plus balance findings, keyed by document and ordered by stage.

    ``earliest`` keeps of each statement's balance findings the first only, which reads the lines
    once; the first failure of a document is the same.
    """
    balances = V.first_findings if earliest else V.reconcile
    checks = balances(parsed.ledger).unionByName(
        V.check_holdings_total(parsed.ledger, parsed.printed_holdings)
    )
    keyed = checks.join(parsed.parts.select("statement_id", "doc_id", "part"), "statement_id")
    balance = keyed.select(
        "doc_id", (F.col("stage") + F.col("part") * 1000).alias("stage"), "seq", "code", "message"
    )
    totals = V.check_combined_total(parsed.ledger, parsed.printed_combined).select(
        F.col("run_id").alias("doc_id"), F.lit(COMBINED_TOTAL_STAGE).alias("stage"),
        F.lit(0).cast("bigint").alias("seq"), "code",
        F.lit("combined total differs from closings").alias("message"),
    )
    return parsed.violations.unionByName(balance).unionByName(totals)


def keep_runs(ledger: Ledger, failures: DataFrame) -> Ledger:
    """The ledger without anything that belongs to a failed run."""
    bad = failures.select(F.col("doc_id").alias("run_id"))
    statements = ledger.statements.join(bad, "run_id", "left_anti")
    ids = statements.select("statement_id")
    owners = statements.select("account_id")
    kept = {
        name: frame.join(ids, "statement_id", "left_semi")
        for name, frame in ledger.tables().items()
        if name not in ("accounts", "statements")
    }
    return Ledger(
        accounts=ledger.accounts.join(owners, "account_id", "left_semi"),
        statements=statements.select(ledger.statements.columns),
        **kept,
    )


def document_runs(parsed: ParsedLedger) -> DataFrame:
    """One run row per routed document; refused documents get none."""
    return parsed.routed.select(
        F.col("doc_id").alias("run_id"),
        F.sha2(F.concat_ws("|", F.lit("payload"), "doc_id"), 256).alias("raw_payload_id"),
        F.col("layout").alias("adapter_id"),
        F.lit(LAYOUT_VERSION).alias("adapter_version"),
    )


def parse_and_check(pages: DataFrame, strict: bool = False) -> tuple[Ledger, DataFrame, DataFrame]:
    """(ledger of passing documents, runs with status, first failure per document).

    ``strict`` raises on the driver when any run failed; otherwise bad documents only show up
    in the run table.
    """
    parsed = parse_statements(pages)
    # Every table of the ledger asks for the failures: they are found once.
    failures = staged(first_failure(all_violations(parsed, earliest=True)), "failures")
    runs = run_status(document_runs(parsed), failures)
    if strict:
        failed = runs.filter(F.col("status") == "failed").select("run_id", "error_code").take(1)
        if failed:
            raise StatementError(f"run {failed[0].run_id} failed with {failed[0].error_code}")
    return keep_runs(parsed.ledger, failures), runs, failures


