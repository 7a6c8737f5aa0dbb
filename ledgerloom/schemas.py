"""Table schemas, error codes and the bundle of frames that make up a ledger."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Run states, error codes and money domains are part of the stored contract.
RUN_STATUSES = ("raw_stored", "extracted", "validated", "canonical_persisted", "failed")

INVARIANT = "InvariantError"
TOKEN = "TokenError"
SCHEMA_DRIFT = "SchemaDriftError"
MISSING_SECTION = "MissingSectionError"
AMBIGUOUS = "AmbiguousAccountsError"
PERSISTENCE = "PersistenceError"
MODEL = "ValidationError"
VALUE = "ValueError"
NO_MATCH = "ADAPTER_MATCH_FAILED"

_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema from ``name type`` pairs, without needing a running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_PAYLOADS = _schema(
    "raw_payload_id string, content_sha256 string, byte_length bigint, "
    "original_basename string, ingested_at timestamp"
)
EXTRACTION_RUNS = _schema(
    "run_id string, raw_payload_id string, adapter_id string, adapter_version string, "
    "started_at timestamp, status string, error_code string, error_message string"
)
RAW_PAGES = _schema("doc_id bigint, page_number int, page_text string")
RAW_TOKENS = _schema(
    "raw_token_id string, raw_page_id string, token_kind string, token_text string, "
    "x0_mp bigint, y0_mp bigint, x1_mp bigint, y1_mp bigint, "
    "table_index int, row_index int, col_index int"
)
ACCOUNTS = _schema(
    "account_id string, institution string, account_mask string, account_domain string, "
    "account_type string, currency string"
)
STATEMENTS = _schema(
    "statement_id string, account_id string, account_domain string, run_id string, "
    "raw_payload_id string, statement_start_date date, statement_end_date date, "
    "opening_balance_cents bigint, closing_balance_cents bigint, net_change_cents bigint"
)
DEPOSITORY_SUMMARIES = _schema(
    "statement_id string, deposits_cents bigint, withdrawals_cents bigint, "
    "interest_paid_cents bigint, fees_cents bigint"
)
CREDIT_SUMMARIES = _schema(
    "statement_id string, previous_balance_cents bigint, payments_credits_cents bigint, "
    "purchases_cents bigint, cash_advances_cents bigint, balance_transfers_cents bigint, "
    "fees_charged_cents bigint, interest_charged_cents bigint, new_balance_cents bigint, "
    "minimum_payment_due_cents bigint, payment_due_date date"
)
BROKERAGE_SUMMARIES = _schema(
    "statement_id string, opening_cash_cents bigint, closing_cash_cents bigint, "
    "opening_portfolio_cents bigint, closing_portfolio_cents bigint, "
    "realized_gains_cents bigint, unrealized_gains_cents bigint, "
    "income_dividends_cents bigint, transfers_in_cents bigint, transfers_out_cents bigint"
)
TRANSACTIONS = _schema(
    "transaction_id string, statement_id string, line_no bigint, post_date date, "
    "transaction_date date, amount_cents bigint, description string, "
    "transaction_category string, balance_after_cents bigint"
)
HOLDINGS = _schema(
    "holding_id string, statement_id string, as_of_date date, symbol string, "
    "description string, quantity_nanos bigint, market_value_cents bigint, "
    "cost_basis_cents bigint"
)
ENVELOPES = _schema("envelope_id string, name string, balance_cents bigint")
VIOLATIONS = _schema(
    "doc_id string, stage int, seq bigint, code string, message string"
)


@dataclass(frozen=True)
class Ledger:
    """The canonical tables of one ledger. Every member is a lazy DataFrame."""

    accounts: DataFrame
    statements: DataFrame
    depository_summaries: DataFrame
    credit_summaries: DataFrame
    brokerage_summaries: DataFrame
    transactions: DataFrame
    holdings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


LEDGER_SCHEMAS = {
    "accounts": ACCOUNTS,
    "statements": STATEMENTS,
    "depository_summaries": DEPOSITORY_SUMMARIES,
    "credit_summaries": CREDIT_SUMMARIES,
    "brokerage_summaries": BROKERAGE_SUMMARIES,
    "transactions": TRANSACTIONS,
    "holdings": HOLDINGS,
}
