"""Balance and contract checks. Every check returns the violations it found, never raises.

A violation row is (statement_id, rule, stage, seq, code, message); stage and seq order the
findings of one statement the way a reader would meet them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators.running import running_totals
from ledgerloom.rules import (
    BROKERAGE,
    CARD,
    CATEGORIES,
    DEPOSITORY,
    domain_of_type,
    required_sign,
    sign_violation,
)
from ledgerloom.schemas import INVARIANT, PERSISTENCE, TOKEN, VALUE, Ledger
from ledgerloom.sources.stage import staged

# Lines of one statement are windowed in slices of this many lines.
LINES_PER_CHUNK = 1 << 16

# Order of the checks.
NET, IDENTITY, RUNNING, LINES, DOMAIN, HOLDINGS_TOTAL = 60, 61, 62, 63, 70, 83

_UNPRINTED = "line without running balance"
_RUNNING_OFF = "running balance is off"
_OUTSIDE = "post date outside the period"
_SIGN = "sign contradicts category"


@dataclass(frozen=True)
class Rule:
    name: str
    stage: int
    failed: Column
    message: str
    code: str = INVARIANT


def _findings(frame: DataFrame, rules: list[Rule]) -> DataFrame:
    found = [
        F.when(
            F.coalesce(rule.failed, F.lit(False)),
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(rule.stage).alias("stage"),
                F.lit(order).cast("bigint").alias("seq"),
                F.lit(rule.code).alias("code"),
                F.lit(rule.message).alias("message"),
            ),
        )
        for order, rule in enumerate(rules)
    ]
    return frame.select(
        "statement_id", F.explode(F.array_compact(F.array(*found))).alias("v")
    ).select("statement_id", "v.*")


def _sum_of(*categories: str, sign: int = 1) -> Column:
    value = F.when(F.col("transaction_category").isin(*categories), F.col("amount_cents"))
    return (F.coalesce(F.sum(value), F.lit(0)) * sign).cast("bigint")


def _category_sums() -> list[Column]:
    return [
        F.sum("amount_cents").cast("bigint").alias("s_all"),
        _sum_of("deposit", "interest_paid", "other_credit").alias("s_credits"),
        _sum_of("withdrawal", "other_debit", sign=-1).alias("s_withdrawals"),
        _sum_of("fee", "fee_reversal").alias("s_fees"),
        _sum_of("purchase").alias("s_purchases"),
        _sum_of("payment", "credit", sign=-1).alias("s_payments"),
        _sum_of("cash_advance").alias("s_advances"),
        _sum_of("balance_transfer").alias("s_transfers"),
        _sum_of("interest_charged").alias("s_interest"),
    ]


_SUMS = ("s_all", "s_credits", "s_withdrawals", "s_fees", "s_purchases", "s_payments",
         "s_advances", "s_transfers", "s_interest")


def line_sums(transactions: DataFrame) -> DataFrame:
    """All category sums of a statement in one aggregation, shared by every bucket rule."""
    return transactions.groupBy("statement_id").agg(*_category_sums())


def _summed(ledger: Ledger) -> DataFrame:
    """Statements beside their line sums; a statement without lines sums to zero."""
    joined = ledger.statements.join(line_sums(ledger.transactions), "statement_id", "left")
    return joined.fillna(0, [c for c in joined.columns if c.startswith("s_")])


def _net_rules() -> list[Rule]:
    expected = F.col("closing_balance_cents") - F.col("opening_balance_cents")
    return [Rule("net_change", NET, F.col("net_change_cents") != expected,
                 "net change is not closing minus opening")]


def _identity_rules() -> list[Rule]:
    expected = F.col("opening_balance_cents") + F.col("s_all")
    return [Rule("balance_identity", IDENTITY, F.col("closing_balance_cents") != expected,
                 "closing is not opening plus lines")]


def _depository_equation() -> list[Rule]:
    computed = (
        F.col("opening_balance_cents") + F.col("deposits_cents") + F.col("interest_paid_cents")
        - F.col("withdrawals_cents") - F.col("fees_cents")
    )
    return [Rule("depository_equation", DOMAIN, computed != F.col("closing_balance_cents"),
                 "buckets do not lead from opening to closing")]


def _depository_buckets() -> list[Rule]:
    credits = F.col("deposits_cents") + F.col("interest_paid_cents")
    return [
        Rule("deposits_bucket", DOMAIN + 1, F.col("s_credits") != credits,
             "deposits and interest differ from credit lines"),
        Rule("withdrawals_bucket", DOMAIN + 1, F.col("s_withdrawals") != F.col("withdrawals_cents"),
             "withdrawals differ from lines"),
        Rule("fees_bucket", DOMAIN + 1, -F.col("s_fees") != F.col("fees_cents"),
             "fees differ from net fee lines"),
    ]


def _card_equation() -> list[Rule]:
    computed = (
        F.col("previous_balance_cents") + F.col("purchases_cents") + F.col("cash_advances_cents")
        + F.col("balance_transfers_cents") + F.col("fees_charged_cents")
        + F.col("interest_charged_cents") - F.col("payments_credits_cents")
    )
    return [
        Rule("card_opening", DOMAIN,
             F.col("opening_balance_cents") != F.col("previous_balance_cents"),
             "opening is not the previous balance"),
        Rule("card_closing", DOMAIN, F.col("closing_balance_cents") != F.col("new_balance_cents"),
             "closing is not the new balance"),
        Rule("card_equation", DOMAIN, computed != F.col("new_balance_cents"),
             "buckets do not lead from previous to new balance"),
    ]


def _card_buckets() -> list[Rule]:
    pairs = [
        ("purchases", "s_purchases", "purchases_cents"),
        ("payments", "s_payments", "payments_credits_cents"),
        ("cash_advances", "s_advances", "cash_advances_cents"),
        ("balance_transfers", "s_transfers", "balance_transfers_cents"),
        ("fees", "s_fees", "fees_charged_cents"),
        ("interest", "s_interest", "interest_charged_cents"),
    ]
    return [
        Rule(f"{name}_bucket", DOMAIN + 1, F.col(lines) != F.col(bucket),
             f"{name} differ from lines")
        for name, lines, bucket in pairs
    ]


def _brokerage_cash() -> list[Rule]:
    return [
        Rule("cash_opening", DOMAIN, F.col("opening_balance_cents") != F.col("opening_cash_cents"),
             "opening is not the opening cash"),
        Rule("cash_closing", DOMAIN, F.col("closing_balance_cents") != F.col("closing_cash_cents"),
             "closing is not the closing cash"),
    ]


_BRIDGE = ("transfers_in_cents", "transfers_out_cents", "income_dividends_cents",
           "realized_gains_cents", "unrealized_gains_cents")


def _portfolio_bridge() -> list[Rule]:
    opened = F.col("opening_portfolio_cents").isNotNull()
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in _BRIDGE])
    computed = (
        F.col("opening_portfolio_cents") + F.col("transfers_in_cents")
        - F.col("transfers_out_cents") + F.col("income_dividends_cents")
        + F.col("realized_gains_cents") + F.col("unrealized_gains_cents")
    )
    closing = F.col("closing_portfolio_cents")
    return [
        Rule("bridge_components", DOMAIN + 1, opened & some_null, "bridge has null components"),
        Rule("portfolio_bridge", DOMAIN + 1,
             opened & ~some_null & ~computed.eqNullSafe(closing),
             "bridge does not lead to the closing portfolio"),
    ]


def _depository(ledger: Ledger, summed: bool = True) -> DataFrame:
    base = _summed(ledger) if summed else ledger.statements
    return base.join(ledger.depository_summaries, "statement_id")


def _card(ledger: Ledger, summed: bool = True) -> DataFrame:
    base = _summed(ledger) if summed else ledger.statements
    return base.join(ledger.credit_summaries, "statement_id")


def _brokerage(ledger: Ledger) -> DataFrame:
    return ledger.statements.join(ledger.brokerage_summaries, "statement_id")


def check_net_change(ledger: Ledger) -> DataFrame:
    return _findings(ledger.statements, _net_rules())


def check_balance_identity(ledger: Ledger) -> DataFrame:
    return _findings(_summed(ledger), _identity_rules())


def check_depository_equation(ledger: Ledger) -> DataFrame:
    return _findings(_depository(ledger, summed=False), _depository_equation())


def check_depository_buckets(ledger: Ledger) -> DataFrame:
    return _findings(_depository(ledger), _depository_buckets())


def check_card_equation(ledger: Ledger) -> DataFrame:
    return _findings(_card(ledger, summed=False), _card_equation())


def check_card_buckets(ledger: Ledger) -> DataFrame:
    return _findings(_card(ledger), _card_buckets())


def check_brokerage_cash(ledger: Ledger) -> DataFrame:
    return _findings(_brokerage(ledger), _brokerage_cash())


def check_portfolio_bridge(ledger: Ledger) -> DataFrame:
    return _findings(_brokerage(ledger), _portfolio_bridge())


def _dated_lines(ledger: Ledger) -> DataFrame:
    return ledger.transactions.join(
        ledger.statements.select(
            "statement_id", "account_domain", "statement_start_date", "statement_end_date",
            "opening_balance_cents",
        ),
        "statement_id",
    )


def check_running_balance(ledger: Ledger) -> DataFrame:
    """First line whose printed balance is missing or off, where any line prints one."""
    lines = ledger.transactions.select(
        "statement_id", "line_no", "amount_cents", "balance_after_cents"
    ).withColumn("_chunk", F.floor(F.col("line_no") / LINES_PER_CHUNK))
    run = running_totals(
        lines, ["statement_id"], "_chunk", ["line_no"], {"running": F.col("amount_cents")}
    ).join(ledger.statements.select("statement_id", "opening_balance_cents"), "statement_id")
    balance = F.col("balance_after_cents")
    off = balance != F.col("opening_balance_cents") + F.col("running")
    firsts = run.groupBy("statement_id").agg(
        F.count(balance).alias("printed"),
        F.min(F.when(balance.isNull(), F.col("line_no"))).alias("missing"),
        F.min(F.when(off, F.col("line_no"))).alias("off"),
    )
    seq = F.least("missing", "off")
    return firsts.filter((F.col("printed") > 0) & seq.isNotNull()).select(
        "statement_id",
        F.lit("running_balance").alias("rule"),
        F.lit(RUNNING).alias("stage"),
        seq.cast("bigint").alias("seq"),
        F.lit(INVARIANT).alias("code"),
        F.when(F.col("missing") == seq, _UNPRINTED).otherwise(_RUNNING_OFF).alias("message"),
    )


def _line_findings(lines: DataFrame, allow_out_of_cycle: bool, dates: bool,
                   signs: bool) -> DataFrame:
    """Date then sign of each line; the sequence interleaves them line by line."""
    found = []
    seq = (F.col("line_no") * 2).cast("bigint")

    def entry(rule: str, position: Column, code: Column, message: str) -> Column:
        return F.struct(
            F.lit(rule).alias("rule"), F.lit(LINES).alias("stage"), position.alias("seq"),
            code.alias("code"), F.lit(message).alias("message"),
        )

    if dates and not allow_out_of_cycle:
        outside = ~F.col("post_date").between(
            F.col("statement_start_date"), F.col("statement_end_date")
        )
        found.append(F.when(outside, entry("post_date", seq, F.lit(INVARIANT), _OUTSIDE)))
    if signs:
        code = sign_violation(
            F.col("account_domain"), F.col("transaction_category"), F.col("amount_cents")
        )
        found.append(F.when(code.isNotNull(), entry("category_sign", seq + 1, code, _SIGN)))
    if not found:
        found = [F.lit(None).cast("struct<rule:string,stage:int,seq:bigint,code:string,"
                                  "message:string>")]
    return lines.select(
        "statement_id", F.explode(F.array_compact(F.array(*found))).alias("v")
    ).select("statement_id", "v.*")


def check_post_dates(ledger: Ledger, allow_out_of_cycle: bool = False) -> DataFrame:
    return _line_findings(_dated_lines(ledger), allow_out_of_cycle, dates=True, signs=False)


def check_signs(ledger: Ledger) -> DataFrame:
    return _line_findings(_dated_lines(ledger), False, dates=False, signs=True)


def check_category_domain(ledger: Ledger) -> DataFrame:
    """Lines whose category is not in their domain's closed set."""
    lines = _dated_lines(ledger)
    unknown = required_sign(F.col("account_domain"), F.col("transaction_category")).isNull()
    return lines.filter(unknown).select(
        "statement_id", "line_no", "account_domain", "transaction_category",
        F.lit(VALUE).alias("code"),
    )


def check_type_domain(accounts: DataFrame) -> DataFrame:
    """Accounts whose type does not belong to their domain."""
    owner = domain_of_type(F.col("account_type"))
    return accounts.filter(~owner.eqNullSafe(F.col("account_domain"))).select(
        "account_id", "account_domain", "account_type", F.lit(VALUE).alias("code")
    )


def check_holdings_total(ledger: Ledger, printed: DataFrame) -> DataFrame:
    """Positions dated inside the period and summing to the printed total.

    ``printed`` is (statement_id, printed_total_cents); statements not in it print no positions.
    """
    dated = ledger.holdings.join(
        ledger.statements.select("statement_id", "statement_start_date", "statement_end_date"),
        "statement_id",
    )
    outside = ~F.col("as_of_date").between(
        F.col("statement_start_date"), F.col("statement_end_date")
    )
    sums = dated.groupBy("statement_id").agg(
        F.sum("market_value_cents").cast("bigint").alias("market_total"),
        F.max(outside).alias("outside"),
    )
    checked = printed.join(sums, "statement_id", "left")
    return _findings(checked, [
        Rule("holding_date", HOLDINGS_TOTAL, F.col("outside"), "position dated outside period"),
        Rule("holdings_total", HOLDINGS_TOTAL,
             F.coalesce("market_total", F.lit(0)) != F.col("printed_total_cents"),
             "positions do not sum to the printed total"),
    ])


def check_combined_total(ledger: Ledger, printed: DataFrame) -> DataFrame:
    """Printed combined total against the closings of the run, where one is printed."""
    sums = ledger.statements.groupBy("run_id").agg(
        F.sum("closing_balance_cents").cast("bigint").alias("closing_total_cents")
    )
    return (
        printed.join(sums, "run_id")
        .filter(F.col("printed_total_cents") != F.col("closing_total_cents"))
        .select("run_id", "printed_total_cents", "closing_total_cents",
                F.lit(INVARIANT).alias("code"))
    )


def _statement_rules() -> list[Rule]:
    return [
        *_net_rules(), *_identity_rules(), *_depository_equation(), *_depository_buckets(),
        *_card_equation(), *_card_buckets(), *_brokerage_cash(), *_portfolio_bridge(),
    ]


def reconcile(ledger: Ledger, allow_out_of_cycle: bool = False) -> DataFrame:
    """Every balance check at once; one aggregation of the lines feeds all bucket rules.

    Sidecars hang on as outer joins: a rule over a missing sidecar is null, hence no finding.
    """
    sidecars = (
        _summed(ledger)
        .join(ledger.depository_summaries, "statement_id", "left")
        .join(ledger.credit_summaries, "statement_id", "left")
        .join(ledger.brokerage_summaries, "statement_id", "left")
    )
    per_statement = _findings(sidecars, _statement_rules())
    per_line = _line_findings(_dated_lines(ledger), allow_out_of_cycle, dates=True, signs=True)
    return per_statement.unionByName(check_running_balance(ledger)).unionByName(per_line)


def _line_states(ledger: Ledger) -> DataFrame:
    """One row per statement with lines: its sums and the first line each line rule finds.

    The lines are read once. Every slice of a statement is folded to a row of fixed size, and only
    those rows are put in order. What a slice's balances are off by is known only once the slices
    before it are summed: the slice keeps the distance of its first printed balance from its own
    running sum, where that line stands, and where the distance first changes.
    """
    amount, balance = F.col("amount_cents"), F.col("balance_after_cents")
    lines = _dated_lines(ledger).select(
        "statement_id", "line_no", "amount_cents", "balance_after_cents", "transaction_category",
        F.col("opening_balance_cents").alias("_opening"),
        F.floor(F.col("line_no") / LINES_PER_CHUNK).alias("_chunk"),
        (~F.col("post_date").between(F.col("statement_start_date"), F.col("statement_end_date")))
        .alias("_outside"),
        sign_violation(F.col("account_domain"), F.col("transaction_category"), amount)
        .alias("_sign"),
    )
    so_far = (
        W.partitionBy("statement_id", "_chunk").orderBy("line_no")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    apart = lines.withColumn("_apart", balance - F.sum(amount).over(so_far)).withColumn(
        "_first_apart", F.first("_apart", ignorenulls=True).over(so_far)
    )

    def first_line(condition: Column) -> Column:
        return F.min(F.when(condition, F.col("line_no")))

    slices = apart.groupBy("statement_id", "_chunk").agg(
        *_category_sums(),
        F.max("_opening").alias("_opening"),
        F.count(balance).alias("_printed"),
        first_line(balance.isNull()).alias("_missing"),
        first_line(F.col("_apart").isNotNull()).alias("_first_printed"),
        F.max("_first_apart").alias("_start"),
        first_line(F.col("_apart") != F.col("_first_apart")).alias("_changed"),
        first_line(F.col("_outside")).alias("_outside"),
        first_line(F.col("_sign") == VALUE).alias("_zero"),
        first_line(F.col("_sign") == TOKEN).alias("_wrong_sign"),
    )
    before = (
        W.partitionBy("statement_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    )
    placed = slices.withColumn("_before", F.coalesce(F.sum("s_all").over(before), F.lit(0)))
    off = F.when(F.col("_start") == F.col("_opening") + F.col("_before"), F.col("_changed")) \
        .otherwise(F.col("_first_printed"))
    return placed.groupBy("statement_id").agg(
        *[F.sum(name).cast("bigint").alias(name) for name in _SUMS],
        F.sum("_printed").alias("printed"),
        F.min("_missing").alias("missing"),
        F.min(F.when(F.col("_opening").isNotNull(), off)).alias("off"),
        *[F.min(name).alias(name[1:]) for name in ("_outside", "_zero", "_wrong_sign")],
    )


def first_findings(ledger: Ledger, allow_out_of_cycle: bool = False) -> DataFrame:
    """The earliest balance finding of each statement: ``reconcile`` cut to its first row.

    Returns statement_id, rule, stage, seq, code, message of the finding with the smallest
    (stage, seq, code, message); statements without findings give no row. Lines are read once.
    """
    states = (
        ledger.statements.join(_line_states(ledger), "statement_id", "left")
        .fillna(0, list(_SUMS))
        .join(ledger.depository_summaries, "statement_id", "left")
        .join(ledger.credit_summaries, "statement_id", "left")
        .join(ledger.brokerage_summaries, "statement_id", "left")
    )
    found = []

    def note(failed: Column, rule: str, stage: int, seq: Column, code: str,
             message: Column) -> None:
        found.append(F.when(failed, F.struct(
            F.lit(stage).alias("stage"), seq.cast("bigint").alias("seq"),
            F.lit(code).alias("code"), message.alias("message"), F.lit(rule).alias("rule"),
        )))

    for order, rule in enumerate(_statement_rules()):
        note(rule.failed, rule.name, rule.stage, F.lit(order), rule.code, F.lit(rule.message))
    broken = F.least("missing", "off")
    note((F.col("printed") > 0) & broken.isNotNull(), "running_balance", RUNNING, broken, INVARIANT,
         F.when(F.col("missing") == broken, _UNPRINTED).otherwise(_RUNNING_OFF))
    if not allow_out_of_cycle:
        note(F.col("outside").isNotNull(), "post_date", LINES, F.col("outside") * 2, INVARIANT,
             F.lit(_OUTSIDE))
    for column, code in (("zero", VALUE), ("wrong_sign", TOKEN)):
        note(F.col(column).isNotNull(), "category_sign", LINES, F.col(column) * 2 + 1, code,
             F.lit(_SIGN))
    return states.select(
        "statement_id", F.array_min(F.array(*found)).alias("v")
    ).filter(F.col("v").isNotNull()).select(
        "statement_id", *[F.col(f"v.{name}") for name in ("rule", "stage", "seq", "code", "message")]
    )


# ---------------------------------------------------------------- persistence contract

# What a key of the fold stands for.
STATEMENT, ACCOUNT, RUN, RUN_PAYLOAD = "statement", "account", "run", "run_payload"
PERIOD, NUMBER, LINE, POSITION = "period", "number", "line", "position"

_SIDECARS = ("depository_summaries", "credit_summaries", "brokerage_summaries")


def _broken(frame: DataFrame, table: str, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    hits = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules])
    )
    return frame.select(
        F.lit(table).alias("table"), F.col(key).alias("key"), F.explode(hits).alias("rule")
    )


def _any_below_zero(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n) < 0 for n in names])


def _key(kind: str, *columns: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.array(*[F.col(c).cast("string") for c in columns]).alias("key")
    )


# One bit of an entry for the table it comes from and for each fact about its row.
_SOURCES = ("statements", *_SIDECARS, "transactions", "holdings", "accounts", "runs")
_FLAGS = ("is_depository", "is_card", "is_brokerage", "is_other", "no_domain", "period_inverted",
          "net_change", "depository_bucket_negative", "card_bucket_negative", "due_date_missing",
          "half_portfolio", "currency", "type_outside_domain")
_BITS = {name: 1 << place for place, name in enumerate((*_SOURCES, *_FLAGS))}
_VALUES = ("opening", "closing", "previous", "new", "opening_cash", "closing_cash")


def _is_set(bits: str, name: str) -> Column:
    return F.col(bits).bitwiseAND(F.lit(_BITS[name]).cast("bigint")) != 0


def _entries(frame: DataFrame, source: str, keys: list[Column],
             flags: dict[str, Column] | None = None, values: dict[str, Column] | None = None
             ) -> DataFrame:
    """A table's rows once under each of their keys: source and facts as bits, and balances.

    Rows are dealt by their first key before they are combined: a file's rows would all be in one task's map.
    """
    bits = F.lit(_BITS[source]).cast("bigint")
    for name, flag in (flags or {}).items():
        bits = bits + F.when(flag, F.lit(_BITS[name])).otherwise(F.lit(0)).cast("bigint")
    values = values or {}
    rows = frame.select(
        *[key.alias(f"_k{i}") for i, key in enumerate(keys)], bits.alias("bits"),
        *[value.cast("bigint").alias(name) for name, value in values.items()],
    ).repartition("_k0")
    return rows.select(
        F.explode(F.array(*[F.col(f"_k{i}") for i in range(len(keys))])).alias("k"), "bits",
        *[F.col(name) if name in values else F.lit(None).cast("bigint").alias(name) for name in _VALUES],
    ).select("k.*", "bits", *_VALUES)


def _contract_entries(ledger: Ledger, runs: DataFrame) -> DataFrame:
    c = F.col
    domain = c("account_domain")
    tables = [
        _entries(ledger.statements, "statements", [
            _key(STATEMENT, "statement_id"), _key(ACCOUNT, "account_id"), _key(RUN, "run_id"),
            _key(RUN_PAYLOAD, "run_id", "raw_payload_id"),
            _key(PERIOD, "account_id", "statement_start_date", "statement_end_date", "run_id"),
        ], {
            "is_depository": domain == DEPOSITORY, "is_card": domain == CARD,
            "is_brokerage": domain == BROKERAGE,
            "is_other": ~domain.isin(DEPOSITORY, CARD, BROKERAGE), "no_domain": domain.isNull(),
            "period_inverted": c("statement_start_date") > c("statement_end_date"),
            "net_change":
                c("net_change_cents") != c("closing_balance_cents") - c("opening_balance_cents"),
        }, {"opening": c("opening_balance_cents"), "closing": c("closing_balance_cents")}),
        _entries(ledger.depository_summaries, "depository_summaries",
                 [_key(STATEMENT, "statement_id")], {
            "depository_bucket_negative": _any_below_zero(
                "deposits_cents", "withdrawals_cents", "interest_paid_cents", "fees_cents"),
        }),
        _entries(ledger.credit_summaries, "credit_summaries", [_key(STATEMENT, "statement_id")], {
            "card_bucket_negative": _any_below_zero(
                "payments_credits_cents", "purchases_cents", "cash_advances_cents",
                "balance_transfers_cents", "fees_charged_cents", "interest_charged_cents",
                "minimum_payment_due_cents"),
            "due_date_missing": c("payment_due_date").isNull(),
        }, {"previous": c("previous_balance_cents"), "new": c("new_balance_cents")}),
        _entries(ledger.brokerage_summaries, "brokerage_summaries",
                 [_key(STATEMENT, "statement_id")], {
            "half_portfolio": c("opening_portfolio_cents").isNull()
                != c("closing_portfolio_cents").isNull(),
        }, {"opening_cash": c("opening_cash_cents"), "closing_cash": c("closing_cash_cents")}),
        _entries(ledger.transactions, "transactions",
                 [_key(STATEMENT, "statement_id"), _key(LINE, "transaction_id")]),
        _entries(ledger.holdings, "holdings",
                 [_key(STATEMENT, "statement_id"), _key(POSITION, "holding_id")]),
        _entries(ledger.accounts, "accounts",
                 [_key(ACCOUNT, "account_id"),
                  _key(NUMBER, "institution", "account_mask", "account_type")], {
            "currency": c("currency") != "USD",
            "type_outside_domain": ~domain_of_type(c("account_type")).eqNullSafe(domain),
        }),
        _entries(runs.filter(c("raw_payload_id").isNotNull()), "runs",
                 [_key(RUN, "run_id"), _key(RUN_PAYLOAD, "run_id", "raw_payload_id")]),
    ]
    return reduce(DataFrame.unionByName, tables)


def _broken_keys(ledger: Ledger, runs: DataFrame) -> DataFrame:
    """Keys that break a rule: kind, key, findings (table, rule), and whether its parent is absent.

    All tables are folded by key in one shuffle with map-side combine. States have a fixed size:
    bits, counts of the tables that hold a key once, and the bounds of the balances (two sets of
    balances agree in every pair where the least of each is the greatest of the other).
    """
    owners = (F.col("kind").isin(STATEMENT, PERIOD) & _is_set("bits", "statements")) \
        | (F.col("kind").isin(ACCOUNT, NUMBER) & _is_set("bits", "accounts")) \
        | F.col("kind").isin(LINE, POSITION)
    states = _contract_entries(ledger, runs).groupBy("kind", "key").agg(
        F.bit_or("bits").alias("bits"),
        F.count(F.when(owners, 1)).alias("n_owner"),
        *[F.count(F.when(_is_set("bits", name), 1)).alias(f"n_{name}") for name in _SIDECARS],
        *[F.min(name).alias(f"{name}_low") for name in _VALUES],
        *[F.max(name).alias(f"{name}_high") for name in _VALUES],
    )
    c = F.col
    there = {name: _is_set("bits", name) for name in _BITS}

    def differ(a: str, b: str) -> Column:
        return (c(f"{a}_low") != c(f"{b}_high")) | (c(f"{a}_high") != c(f"{b}_low"))

    has = dict(zip(("is_depository", "is_card", "is_brokerage"), (there[s] for s in _SIDECARS)))
    missing = reduce(lambda a, b: a | b, [there[kind] & ~held for kind, held in has.items()])
    foreign = reduce(lambda a, b: a | b, [
        held & reduce(lambda x, y: x | y, [there[k] for k in (*has, "is_other") if k != kind])
        for kind, held in has.items()
    ])
    statement = (c("kind") == STATEMENT) & there["statements"]
    found = [
        ("statements", rule, statement & failed) for rule, failed in [
            ("own_sidecar_missing", missing | there["is_other"] | there["no_domain"]),
            ("foreign_sidecar", foreign),
            ("card_balances_differ", differ("opening", "previous") | differ("closing", "new")),
            ("cash_balances_differ",
             differ("opening", "opening_cash") | differ("closing", "closing_cash")),
            ("holdings_outside_brokerage",
             there["holdings"]
             & (there["is_depository"] | there["is_card"] | there["is_other"])),
            *[(rule, there[rule]) for rule in (
                "period_inverted", "net_change", "depository_bucket_negative",
                "card_bucket_negative", "due_date_missing", "half_portfolio")],
            ("duplicate_statement_id", c("n_owner") > 1),
        ]
    ]
    found += [("accounts", rule, (c("kind") == ACCOUNT) & there[rule])
              for rule in ("currency", "type_outside_domain")]
    found += [(table, f"duplicate_{'_'.join(columns)}", (c("kind") == kind) & (c("n_owner") > 1))
              for table, kind, columns in [
        ("statements", PERIOD,
         ("account_id", "statement_start_date", "statement_end_date", "run_id")),
        ("accounts", NUMBER, ("institution", "account_mask", "account_type")),
        ("accounts", ACCOUNT, ("account_id",)),
        ("transactions", LINE, ("transaction_id",)),
        ("holdings", POSITION, ("holding_id",)),
    ]]
    lost = (c("kind") == STATEMENT) & (~there["statements"] | c("key")[0].isNull())
    for name in _SIDECARS:
        twice = (c("kind") == STATEMENT) & (c(f"n_{name}") > 1)
        found += [(name, "duplicate_statement_id", twice),
                  (name, "statement_id_unknown", lost & there[name])]
    unknown = (
        ((c("kind") == STATEMENT) & ~there["statements"])
        | ((c("kind") == ACCOUNT) & ~there["accounts"])
        | (c("kind").isin(RUN, RUN_PAYLOAD) & ~there["runs"])
    )
    findings = F.array_compact(F.array(*[
        F.when(failed, F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule")))
        for table, rule, failed in found
    ]))
    return states.select("kind", "key", findings.alias("findings"), unknown.alias("unknown")).filter(
        (F.size("findings") > 0) | c("unknown")
    )


def check_persistence_contract(ledger: Ledger, runs: DataFrame) -> DataFrame:
    """Rules a write must meet: sidecars, keys, references and value limits, as (table, key, rule).

    A key that breaks a rule of statements, accounts, sidecars or uniqueness gives one row for that
    rule, however many rows bear it; a line or position gives one for each of its rows. A null
    reference is unknown. Every table is read at most twice: once to fold all keys, the broken ones
    of which are staged, once to name the rows that refer to those or break a rule of their own.
    """
    c = F.col
    broken = staged(_broken_keys(ledger, runs), "contract", by_size=True)
    named = broken.select(F.explode("findings").alias("f"), "key").select(
        "f.table", F.concat_ws("|", "key").alias("key"), "f.rule"
    )

    def absent(kind: str, flag: str, *columns: str) -> DataFrame:
        return broken.filter((c("kind") == kind) & c("unknown")).select(
            *[c("key")[i].alias(name) for i, name in enumerate(columns)], F.lit(True).alias(flag)
        )

    lines = ledger.transactions.select(
        "transaction_id", "statement_id", "amount_cents", "description", "transaction_category"
    ).join(absent(STATEMENT, "_lost", "statement_id"), "statement_id", "left")
    positions = ledger.holdings.select(
        "holding_id", "statement_id", "quantity_nanos", "symbol", "description"
    ).join(absent(STATEMENT, "_lost", "statement_id"), "statement_id", "left")
    statements = (
        ledger.statements.select("statement_id", "account_id", "run_id", "raw_payload_id")
        .join(absent(ACCOUNT, "_no_account", "account_id"), "account_id", "left")
        .join(absent(RUN, "_no_run", "run_id"), "run_id", "left")
        .join(absent(RUN_PAYLOAD, "_other_payload", "run_id", "raw_payload_id"),
              ["run_id", "raw_payload_id"], "left")
    )
    no_run = c("run_id").isNull() | F.coalesce("_no_run", F.lit(False))
    orphan = ("statement_id_unknown", c("statement_id").isNull() | c("_lost"))
    pieces = [
        named,
        _broken(statements, "statements", "statement_id", [
            ("account_id_unknown", c("account_id").isNull() | c("_no_account")),
            ("run_unknown", no_run),
            ("payload_differs_from_run", ~no_run & c("_other_payload")),
        ]),
        _broken(lines, "transactions", "transaction_id", [
            orphan,
            ("amount_zero", c("amount_cents") == 0),
            ("description_empty", F.length("description") < 1),
            ("category_unknown", ~c("transaction_category").isin(*CATEGORIES)),
        ]),
        _broken(positions, "holdings", "holding_id", [
            orphan,
            ("quantity_zero", c("quantity_nanos") == 0),
            ("symbol_empty", F.length("symbol") < 1),
            ("description_empty", F.length("description") < 1),
        ]),
    ]
    found = reduce(DataFrame.unionByName, pieces).withColumn("code", F.lit(PERSISTENCE))
    return staged(found, "contract-findings", by_size=True)
