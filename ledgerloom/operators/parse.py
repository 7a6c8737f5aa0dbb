"""Page text to typed ledger rows: one Spark job over the pages of all documents.

Labelled amounts, section bounds and header facts are small aggregates per document, and table
rows are the lines between two bounds. So a document (or a feed that gives one id to a third of
all pages) is spread over as many tasks as its lines need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import tokens as P
from ledgerloom.functions.categorize import (
    categorize_brokerage,
    categorize_card,
    categorize_combined,
    categorize_depository,
    categorize_vanguard,
)
from ledgerloom.operators import layouts as L
from ledgerloom.operators.document_checks import (
    PART_STRIDE,
    POSITIONS_RAGGED,
    POSITIONS_ROW,
    RAGGED,
    ROW,
    document_violations,
)
from ledgerloom.operators.document_facts import (
    BROKERAGE_LAYOUTS,
    DEPOSITORY_LAYOUTS,
    PAGES_PER_CHUNK,
    TOTAL_LINE,
    before_end,
    by_layout,
    documents,
    header_facts,
    is_layout,
    page_lines,
    tag_pages,
)
from ledgerloom.operators.routing import adapter_matches, claimed
from ledgerloom.operators.running import running_totals
from ledgerloom.rules import BROKERAGE, CARD, DEPOSITORY, domain_of_type, sign_violation
from ledgerloom.schemas import MODEL, SCHEMA_DRIFT, TOKEN, Ledger
from ledgerloom.sources.stage import drop_staged, staged


@dataclass(frozen=True)
class ParsedLedger:
    """Everything one parse yields. ``ledger`` holds all parsed documents, good or bad."""

    ledger: Ledger
    parts: DataFrame
    violations: DataFrame
    printed_holdings: DataFrame
    printed_combined: DataFrame
    routed: DataFrame
    refused: DataFrame


def _statement_parts(docs: DataFrame) -> DataFrame:
    """One row per account statement: combined documents give a checking and a savings part."""
    c = F.col
    zero = F.lit(0).cast("bigint")

    def money(name: str) -> Column:
        return c(f"v_{name}")

    mask = F.when(is_layout(L.VANGUARD), c("mask_low")).otherwise(F.get("masks", F.lit(0)))
    fund_type = F.when(c("kind_low") == "Brokerage Margin", F.lit("brokerage_margin")).otherwise(
        F.lit("brokerage_cash")
    )
    kind = F.when(is_layout(L.VANGUARD), fund_type).otherwise(c("page_type"))

    def part(number, mask, kind, prefix, buckets) -> Column:
        return F.struct(
            F.lit(number).alias("part"),
            mask.alias("account_mask"),
            kind.alias("account_type"),
            money(f"{prefix}opening").alias("opening_balance_cents"),
            money(f"{prefix}closing").alias("closing_balance_cents"),
            *[value.alias(name) for name, value in buckets.items()],
        )

    single = {
        "deposits_cents": money("deposits"), "withdrawals_cents": money("withdrawals"),
        "interest_paid_cents": money("interest_paid"), "fees_cents": money("fees"),
    }

    def several(key: str) -> dict[str, Column]:
        return {
            f"{label}_cents": F.coalesce(money(f"{key}_{label}"), zero)
            for label in ("deposits", "withdrawals", "interest_paid", "fees")
        }

    parts = F.when(
        is_layout(L.COMBINED),
        F.array(
            part(1, c("t_checking"), F.lit("checking"), "c_", several("c")),
            part(2, c("t_savings"), F.lit("savings"), "d_", several("d")),
        ),
    ).otherwise(F.array(part(0, mask, kind, "", single)))
    institution = F.expr(by_layout(lambda x: f"'{x.institution}'"))
    bridged = F.coalesce("has_bridge", F.lit(False))
    return docs.select(
        "doc_id", "layout", institution.alias("institution"), "start_date", "end_date",
        "due_date",
        *[
            money(slot).alias(f"{slot}_cents")
            for slot in ("payments_credits", "purchases", "cash_advances", "balance_transfers",
                         "interest_charged", "minimum")
        ],
        *[
            F.when(bridged, money(slot)).alias(f"{slot}_cents")
            for slot in ("opening_portfolio", "closing_portfolio", "realized_gains",
                         "unrealized_gains", "income_dividends", "transfers_in",
                         "transfers_out")
        ],
        F.explode(parts).alias("part"),
    ).select("*", "part.*").drop("part").withColumn("part", _part_number()).withColumns({
        "statement_id": statement_id(F.col("doc_id"), F.col("part")),
        "account_id": F.sha2(
            F.concat_ws("|", "institution", "account_mask", "account_type"), 256
        ),
        "account_domain": domain_of_type(F.col("account_type")),
    })


def _part_number() -> Column:
    return F.when(~is_layout(L.COMBINED), F.lit(0)).when(
        F.col("account_type") == "checking", F.lit(1)
    ).otherwise(F.lit(2))


def statement_id(doc_id: Column, part: Column) -> Column:
    """Repeatable id: a retried task gives the same one."""
    return F.sha2(F.concat_ws("|", F.lit("statement"), doc_id, part.cast("string")), 256)


# ---------------------------------------------------------------- table rows


def _section_rows(tagged: DataFrame, docs: DataFrame) -> DataFrame:
    """Data rows of every table: the lines between a section's bounds, split into cells."""
    c = F.col
    bounds = ("a_start", "a_end", "a_head_pos", "b_start", "b_end", "b_head_pos", "b_gate",
              "b_total_pos", "end_date")
    located = page_lines(tagged.join(docs.select("doc_id", *bounds), "doc_id"), *bounds)
    pos = c("pos")

    def within(key: str) -> Column:
        return (pos > c(f"{key}_start")) & (c(f"{key}_end").isNull() | (pos <= c(f"{key}_end")))

    is_combined = is_layout(L.COMBINED)
    in_b = within("b") & (is_combined | F.coalesce("b_gate", F.lit(False)))
    section = F.when(in_b, F.lit(1)).when(within("a"), F.lit(0))
    on_title = is_combined & ((pos == c("a_start")) | (pos == c("b_start")))
    section = F.when(on_title, (pos == c("b_start")).cast("int")).otherwise(section)
    text = (
        F.when(on_title, F.regexp_replace(
            c("line"), "^.*?(?:CHECKING|SAVINGS) TRANSACTION DETAILS", ""
        ))
        .when((c("section") == 1) & (pos == c("b_total_pos")),
              F.regexp_replace(c("line"), TOTAL_LINE, ""))
        .when((c("section") == 1) & (pos == c("b_end")), F.expr(before_end(1)))
        .when((c("section") == 0) & (pos == c("a_end")), F.expr(before_end(0)))
        .otherwise(c("line"))
    )
    upper = F.upper(c("text"))
    combined_header = is_combined & (
        upper.startswith("DATE") | (upper.contains("DESCRIPTION") & upper.contains("AMOUNT"))
    )
    header_pos = F.when(c("section") == 1, c("b_head_pos")).otherwise(c("a_head_pos"))
    pipe = is_layout(L.VANGUARD)
    return (
        located.withColumn("section", section)
        .filter(c("section").isNotNull())
        # Written as a generator: a filter on the text as such would be run on the line, and cut it once more.
        .select("*", F.explode(F.array(P.strip(text))).alias("text"))
        .filter((c("text") != "") & ~combined_header)
        .filter(is_combined | (pos != header_pos))
        .select(
            "doc_id", "layout", "page_number", "pos", "section", "end_date",
            F.when(pipe, P.split_pipe(c("text"))).otherwise(P.split_wide(c("text")))
            .alias("cells"),
        )
    )


def _cell(number: int) -> Column:
    return F.get("cells", F.lit(number))


def typed_rows(rows: DataFrame) -> DataFrame:
    """Table rows with typed cells and the first thing wrong with each; positions carry part -1."""
    c = F.col
    combined, fund = is_layout(L.COMBINED), is_layout(L.VANGUARD)
    bank = is_layout(*DEPOSITORY_LAYOUTS)
    width = F.expr(by_layout(
        lambda x: str(len(x.sections[0].headers)) if x.sections[0].headers else None
    ))
    is_position = (c("section") == 1) & ~combined
    typed = rows.select(
        "doc_id", "layout", "page_number", "pos",
        F.when(is_position, F.lit(-1)).when(combined, c("section") + 1).otherwise(F.lit(0))
        .alias("part"),
        F.size("cells").alias("n_cells"),
        F.coalesce(
            F.size("cells") != F.when(is_position, F.lit(4)).otherwise(width), F.lit(False)
        ).alias("ragged"),
        F.when(combined & (F.size("cells") < 3), F.lit(True)).otherwise(F.lit(False))
        .alias("short"),
        F.when(is_position, c("end_date")).alias("as_of_date"),
        _cell(0).alias("first"),
        _cell(1).alias("description"),
        _cell(2).alias("amount_text"),
        F.when(is_position | bank | combined, _cell(3)).alias("last"),
    )
    is_position = c("part") == -1
    balance = F.when(combined, P.cents(c("last"), allow_zero=True)).otherwise(P.cents(c("last")))
    typed = typed.withColumns({
        "post_date": F.when(
            ~is_position,
            F.when(fund | combined, P.iso_date(c("first"))).otherwise(
                P.statement_date(c("first"))
            ),
        ),
        "amount_cents": F.when(~is_position, P.cents(c("amount_text"))),
        "balance_after_cents": F.when(~is_position, balance),
        "quantity_nanos": F.when(is_position, P.quantity_nanos(c("amount_text"))),
        "market_value_cents": F.when(is_position, P.cents(c("last"))),
    })
    typed = typed.withColumn("transaction_category", (
        F.when(is_position, F.lit(None).cast("string"))
        .when(bank, categorize_depository(c("description")))
        .when(is_layout(L.STANDARD_CARD), categorize_card(c("description")))
        .when(is_layout(L.SCHWAB),
              categorize_brokerage(c("description"), c("amount_text")))
        .when(fund, categorize_vanguard(c("description"), c("amount_text")))
        .otherwise(categorize_combined(c("description"), c("amount_cents")))
    ))
    domain = F.expr(by_layout(lambda x: f"'{x.domain}'"))
    wrong_sign = sign_violation(domain, c("transaction_category"), c("amount_cents"))
    position_fault = (
        F.when(c("quantity_nanos").isNull(), "bad share quantity")
        .when(c("market_value_cents").isNull(), "bad market value")
        .when((c("first") == "") | (c("description") == ""), "empty position text")
    )
    # A fund row is read sign first and date last; every other row the other way round.
    line_fault = (
        F.when(c("short"), "row has fewer than three columns")
        .when(~fund & c("post_date").isNull(), "bad row date")
        .when(~P.has_explicit_sign(c("amount_text")), "amount has no explicit sign")
        .when(c("amount_cents").isNull(), "bad row amount")
        .when(c("last").isNotNull() & c("balance_after_cents").isNull(), "bad row balance")
        .when(wrong_sign.isNotNull(), "amount sign contradicts category")
        .when(c("post_date").isNull(), "bad row date")
        .when(c("description") == "", "empty description")
    )
    fault = F.when(~c("ragged"), F.when(is_position, position_fault).otherwise(line_fault))
    return typed.select(
        "doc_id", "part", "page_number", "pos", "ragged", "post_date",
        "as_of_date", F.when(is_position, c("first")).alias("symbol"), "description", "amount_cents",
        "balance_after_cents", "quantity_nanos", "market_value_cents", "transaction_category",
        fault.alias("fault"),
    )


def row_violations(rows: DataFrame) -> DataFrame:
    """Ragged rows come before any row is read; then the first fault of each row, in order."""
    position = F.col("part") == -1
    base = F.when(position, F.lit(0)).otherwise(F.col("part") * PART_STRIDE)
    ragged = F.when(position, F.lit(POSITIONS_RAGGED)).otherwise(base + RAGGED)
    fault = F.when(position, F.lit(POSITIONS_ROW)).otherwise(base + ROW)
    empty = F.col("fault").isin("empty description", "empty position text")
    return rows.filter(F.col("ragged") | F.col("fault").isNotNull()).select(
        "doc_id",
        F.when(F.col("ragged"), ragged).otherwise(fault).alias("stage"),
        F.col("pos").alias("seq"),
        F.when(F.col("ragged"), SCHEMA_DRIFT).when(empty, MODEL).otherwise(TOKEN).alias("code"),
        F.when(F.col("ragged"), "ragged row").otherwise(F.col("fault")).alias("message"),
    )


def _sound(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("ragged") & F.col("fault").isNull())


def parse_transactions(rows: DataFrame) -> DataFrame:
    """Transactions of typed rows, numbered from one inside each statement."""
    numbered = running_totals(
        _sound(rows).filter(F.col("part") >= 0).select(
            "doc_id", "part", F.floor(F.col("page_number") / PAGES_PER_CHUNK).alias("_chunk"),
            "pos", "post_date", "amount_cents", "description",
            "transaction_category", "balance_after_cents",
        ),
        ["doc_id", "part"], "_chunk", ["pos"], {"line_no": F.lit(1)},
    )
    ids = statement_id(F.col("doc_id"), F.col("part"))
    return numbered.withColumn("statement_id", ids).select(
        F.sha2(F.concat_ws("|", "statement_id", F.col("line_no").cast("string")), 256)
        .alias("transaction_id"),
        "statement_id", "line_no", "post_date",
        F.lit(None).cast("date").alias("transaction_date"),
        "amount_cents", "description", "transaction_category", "balance_after_cents",
    )


def parse_holdings(rows: DataFrame) -> DataFrame:
    """Positions of typed rows, dated at the period end."""
    good = _sound(rows).filter(F.col("part") == -1)
    return good.withColumn("statement_id", statement_id(F.col("doc_id"), F.lit(0))).select(
        F.sha2(F.concat_ws("|", F.lit("holding"), "statement_id", F.col("pos").cast("string")),
               256).alias("holding_id"),
        "statement_id", "as_of_date", "symbol", "description", "quantity_nanos",
        "market_value_cents", F.lit(None).cast("bigint").alias("cost_basis_cents"),
    )


# ---------------------------------------------------------------- whole chain


def parse_statements(pages: DataFrame) -> ParsedLedger:
    """Route, read and type every document; nothing is checked against balances yet.

    What opening pages say is staged first; then the pages of routed documents, with their text made dense,
    so the source is read no further; document facts, cut table rows and statement parts are staged too, and
    everything after works on compact typed tables. Expressions have branches only for layouts that were found.
    """
    routed, refused = claimed(staged(adapter_matches(pages, *header_facts()), "openings"))
    with L.only(row.layout for row in routed.select("layout").distinct().collect()):
        return _parsed(tag_pages(pages, routed), routed, refused)


def _parsed(tagged: DataFrame, routed: DataFrame, refused: DataFrame) -> ParsedLedger:
    docs = staged(documents(routed, tagged), "documents")
    rows = staged(typed_rows(_section_rows(tagged, docs)), "rows")
    drop_staged(tagged)
    parts = staged(_statement_parts(docs), "parts")
    violations = document_violations(docs).unionByName(row_violations(rows))
    in_domain = lambda name: parts.filter(F.col("account_domain") == name)
    ledger = Ledger(
        accounts=parts.groupBy("account_id").agg(
            *[F.min(k).alias(k) for k in ("institution", "account_mask", "account_domain",
                                          "account_type")],
            F.lit("USD").alias("currency"),
        ),
        statements=parts.select(
            "statement_id", "account_id", "account_domain",
            F.col("doc_id").alias("run_id"),
            F.sha2(F.concat_ws("|", F.lit("payload"), "doc_id"), 256).alias("raw_payload_id"),
            F.col("start_date").alias("statement_start_date"),
            F.col("end_date").alias("statement_end_date"),
            "opening_balance_cents", "closing_balance_cents",
            (F.col("closing_balance_cents") - F.col("opening_balance_cents"))
            .alias("net_change_cents"),
        ),
        depository_summaries=in_domain(DEPOSITORY).select(
            "statement_id", "deposits_cents", "withdrawals_cents", "interest_paid_cents",
            "fees_cents",
        ),
        credit_summaries=in_domain(CARD).select(
            "statement_id",
            F.col("opening_balance_cents").alias("previous_balance_cents"),
            "payments_credits_cents", "purchases_cents", "cash_advances_cents",
            "balance_transfers_cents", F.col("fees_cents").alias("fees_charged_cents"),
            "interest_charged_cents",
            F.col("closing_balance_cents").alias("new_balance_cents"),
            F.col("minimum_cents").alias("minimum_payment_due_cents"),
            F.col("due_date").alias("payment_due_date"),
        ),
        brokerage_summaries=in_domain(BROKERAGE).select(
            "statement_id",
            F.col("opening_balance_cents").alias("opening_cash_cents"),
            F.col("closing_balance_cents").alias("closing_cash_cents"),
            "opening_portfolio_cents", "closing_portfolio_cents", "realized_gains_cents",
            "unrealized_gains_cents", "income_dividends_cents", "transfers_in_cents",
            "transfers_out_cents",
        ),
        transactions=staged(parse_transactions(rows), "transactions"),
        holdings=parse_holdings(rows),
    )
    printed = F.coalesce("b_gate", F.lit(False)) & F.col("layout").isin(*BROKERAGE_LAYOUTS)
    return ParsedLedger(
        ledger=ledger,
        parts=parts.select("doc_id", "layout", "part", "statement_id"),
        violations=violations,
        printed_holdings=docs.filter(printed).select(
            statement_id(F.col("doc_id"), F.lit(0)).alias("statement_id"),
            F.col("v_holdings").alias("printed_total_cents"),
        ),
        printed_combined=docs.filter(
            (F.col("layout") == L.COMBINED) & F.col("t_total").isNotNull()
        ).select(
            F.col("doc_id").alias("run_id"), F.col("v_total").alias("printed_total_cents")
        ),
        routed=docs.select("doc_id", "layout"),
        refused=refused,
    )

