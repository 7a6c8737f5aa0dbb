"""Registered queries that read text: tokens, categories, routing, parsing, redaction."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import categorize as C
from ledgerloom.functions import redact as R
from ledgerloom.functions import tokens as P
from ledgerloom.operators import legacy as LG
from ledgerloom.operators import document_checks as CHECKS
from ledgerloom.operators import routing as ROUTE
from ledgerloom.operators.ledger_queries import statement_detail
from ledgerloom.operators.outcome import all_violations, first_failure, parse_and_check
from ledgerloom.operators.parse import parse_statements
from ledgerloom.plans import derive as D
from ledgerloom.plans import render as RENDER
from ledgerloom.plans.oracle import on_ledger
from ledgerloom.rules import BROKERAGE, CARD, DEPOSITORY
from ledgerloom.sources.stage import staged

# ---------------------------------------------------------------- tokens


def _pick(key: Column, shapes: list[Column]) -> Column:
    return F.element_at(F.array(*shapes), (key % len(shapes) + 1).cast("int"))


def _amount_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Orders with their total in cents, and that total printed as 1,234.56."""
    orders = D.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", D.price_cents(F.col("o_totalprice")).alias("c")
    )
    whole = F.format_number(F.floor(F.col("c") / 100).cast("bigint"), 0)
    cents = F.lpad((F.col("c") % 100).cast("string"), 2, "0")
    return orders, whole, cents


def cents(spark, sf_dir):
    orders, whole, part = _amount_texts(spark, sf_dir)
    text = F.concat(whole, F.lit("."), part)
    shapes = [
        F.concat(F.lit("$"), text), F.concat(F.lit("("), text, F.lit(")")),
        F.concat(F.lit(" -$"), text), F.concat(F.lit("$-"), text), F.concat(F.lit("+$ "), text),
        whole, F.concat(text, F.lit("0")), F.concat(F.lit("(-"), text, F.lit(")")),
        F.lit("0.00"),
    ]
    read = orders.select("o_orderkey", P.cents(_pick(F.col("o_orderkey"), shapes)).alias("value"))
    return P.with_error(read, "value")


CENTS = """
SELECT o_orderkey, value, CASE WHEN value IS NULL THEN 'TokenError' END AS error FROM (
SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN -c WHEN 3 THEN -c
  WHEN 4 THEN c WHEN 7 THEN -c END AS value
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""


def quantity_nanos(spark, sf_dir):
    items = D.table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    q = F.col("q").cast("string")
    shapes = [
        q, F.concat(q, F.lit(".5")), F.concat(F.lit("("), q, F.lit(")")),
        F.concat(F.lit("-"), q, F.lit(".000000001")), F.concat(q, F.lit(".")),
        F.concat(F.lit("1,"), q), F.concat(q, F.lit(".0000000001")), F.concat(F.lit("--"), q),
        F.lit("0"), F.concat(F.lit("+"), q, F.lit(".25")),
    ]
    key = F.col("l_orderkey") + F.col("l_linenumber")
    read = items.select("l_orderkey", "l_linenumber",
                        P.quantity_nanos(_pick(key, shapes)).alias("value"))
    grouped = P.with_error(read, "value").groupBy("l_orderkey", "l_linenumber")
    return grouped.agg(F.sum("value").alias("nanos"), F.count("error").alias("errors"))


QUANTITY = """
SELECT l_orderkey, l_linenumber, CAST(sum(value) AS BIGINT) AS nanos,
  count(*) - count(value) AS errors FROM (
SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 10
  WHEN 0 THEN q * 1000000000 WHEN 1 THEN q * 1000000000 + 500000000
  WHEN 2 THEN -q * 1000000000 WHEN 3 THEN -q * 1000000000 - 1
  WHEN 9 THEN q * 1000000000 + 250000000 END AS value
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)) GROUP BY 1, 2"""


def usd_form(spark, sf_dir):
    orders, whole, part = _amount_texts(spark, sf_dir)
    text = F.concat(whole, F.lit("."), part)
    shapes = [
        whole, F.concat(F.lit("$"), whole), text, F.concat(F.lit(" $"), text, F.lit(" ")),
        F.concat(F.lit("-"), text), F.concat(text, F.lit("9")), F.concat(whole, F.lit(".5")),
    ]
    read = orders.select(
        "o_orderkey", P.usd_form_cents(_pick(F.col("o_orderkey"), shapes)).alias("value")
    )
    return P.with_error(read, "value")


USD_FORM = """
SELECT o_orderkey, value, CASE WHEN value IS NULL THEN 'TokenError' END AS error FROM (
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1) THEN c // 100 * 100
  WHEN o_orderkey % 7 IN (2, 3) THEN c END AS value
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""


def legacy_cents(spark, sf_dir):
    orders, whole, part = _amount_texts(spark, sf_dir)
    text = F.concat(whole, F.lit("."), part)
    shapes = [
        whole, F.concat(whole, F.lit(".5")), F.concat(F.lit("("), text, F.lit(")")),
        F.concat(F.lit("-$"), text), F.concat(text, F.lit("1")), F.concat(text, F.lit(".1")),
        F.lit("x"), F.concat(F.lit("$ "), text),
    ]
    read = orders.select(
        "o_orderkey", P.legacy_cents(_pick(F.col("o_orderkey"), shapes)).alias("value")
    )
    return P.with_error(read, "value")


LEGACY = """
SELECT o_orderkey, value, CASE WHEN value IS NULL THEN 'TokenError' END AS error FROM (
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN c // 100 * 100 WHEN 1 THEN c // 100 * 100 + 50
  WHEN 2 THEN c WHEN 3 THEN c WHEN 7 THEN c END AS value
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))"""


def dates(spark, sf_dir):
    orders = D.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("d")
    )
    shapes = [
        F.date_format("d", pattern)
        for pattern in ("yyyy-MM-dd", "yyyy-M-d", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "M/d/yy",
                        "MMM d, yyyy", "'2/30/'yyyy", "M/d/'0'yy", "yyyyMMdd")
    ]
    text = _pick(F.col("o_orderkey"), shapes)
    return orders.select("o_orderkey", P.statement_date(text).alias("statement_date"),
                         P.iso_date(text).alias("iso_date"))


DATE_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN d END AS statement_date,
  CASE WHEN o_orderkey % 10 IN (0, 9) OR (o_orderkey % 10 = 1 AND month(d) > 9 AND day(d) > 9)
    THEN d END AS iso_date
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def signs_and_columns(spark, sf_dir):
    """Explicit signs, and both ways to cut a printed line into cells."""
    orders, whole, _ = _amount_texts(spark, sf_dir)
    key = F.col("o_orderkey")
    amount = _pick(key, [
        F.concat(F.lit("+"), whole), F.concat(F.lit("-"), whole),
        F.concat(F.lit("("), whole, F.lit(")")), whole, F.concat(F.lit("("), whole),
    ])
    gap = _pick(key, [F.lit("  "), F.lit("\t"), F.lit(" | "), F.lit("|   |"), F.lit(" ")])
    line = F.concat(F.lit(" a b"), gap, amount, gap, F.lit("z "))
    wide, pipe = P.split_wide(line), P.split_pipe(line)
    return orders.select(
        "o_orderkey", P.has_explicit_sign(amount).alias("signed"),
        F.array_join(wide, "^").alias("wide"), F.size(wide).alias("n_wide"),
        F.array_join(pipe, "^").alias("pipe"), F.size(pipe).alias("n_pipe"),
    )


SIGNS = r"""
WITH t AS (SELECT o_orderkey, o_orderkey % 5 AS k,
  format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT) // 100) AS w FROM orders),
x AS (SELECT *, CASE k WHEN 0 THEN '+' || w WHEN 1 THEN '-' || w WHEN 2 THEN '(' || w || ')'
    WHEN 3 THEN w ELSE '(' || w END AS a,
  CASE k WHEN 0 THEN '  ' WHEN 1 THEN chr(9) WHEN 2 THEN ' | ' WHEN 3 THEN '|   |'
    ELSE ' ' END AS g FROM t),
y AS (SELECT *, ' a b' || g || a || g || 'z ' AS line FROM x),
c AS (SELECT *,
  list_filter(list_transform(regexp_split_to_array(line, '\s{2,}|\t|\|'), lambda p: trim(p)),
    lambda p: p <> '') AS wide,
  list_transform(string_split(trim(line), '|'), lambda p: trim(p)) AS pipe FROM y)
SELECT o_orderkey, k < 3 AS signed, array_to_string(wide, '^') AS wide,
  CAST(len(wide) AS INTEGER) AS n_wide, array_to_string(pipe, '^') AS pipe,
  CAST(len(pipe) AS INTEGER) AS n_pipe FROM c"""

# ---------------------------------------------------------------- categories


def _lines(spark, sf_dir, domain: str) -> DataFrame:
    return D.derived_entries(spark, sf_dir).filter(F.col("account_domain") == domain)


def categorize_depository(spark, sf_dir):
    return _lines(spark, sf_dir, DEPOSITORY).select(
        "transaction_id", C.categorize_depository(F.col("description")).alias("category")
    )


def categorize_card(spark, sf_dir):
    return _lines(spark, sf_dir, CARD).select(
        "transaction_id", C.categorize_card(F.col("description")).alias("category")
    )


def _plus(amount: Column) -> Column:
    return F.when(amount > 0, F.lit("+1.00")).otherwise(F.lit("-1.00"))


def categorize_brokerage(spark, sf_dir):
    return _lines(spark, sf_dir, BROKERAGE).select(
        "transaction_id",
        C.categorize_brokerage(F.col("description"), _plus(F.col("amount_cents")))
        .alias("category"),
    )


def categorize_vanguard(spark, sf_dir):
    """General phrases read by the fund chain: it knows neither wires nor share words."""
    return _lines(spark, sf_dir, BROKERAGE).select(
        "transaction_id",
        C.categorize_vanguard(F.col("description"), _plus(F.col("amount_cents")))
        .alias("category"),
    )


def categorize_combined(spark, sf_dir):
    return _lines(spark, sf_dir, DEPOSITORY).select(
        "transaction_id",
        C.categorize_combined(F.col("description"), F.col("amount_cents")).alias("category"),
    )


def _category_sql(domain: str, expression: str) -> str:
    return on_ledger(
        f"SELECT transaction_id, {expression} AS category FROM txn "
        f"WHERE account_domain = '{domain}'"
    )


# ---------------------------------------------------------------- routing and tables

_RENDERED = ("depository", "card", "brokerage", "fund", "combined")


@lru_cache(maxsize=16)
def rendered(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Printed pages of one layout, written once as the page table a parse starts from."""
    return staged(getattr(RENDER, f"render_{layout}")(spark, sf_dir), f"pages-{layout}", by_size=True)


def routing(spark, sf_dir):
    """First pages of every printed statement and of every document text."""
    prose = D.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("prose-"), "doc_id").alias("doc_id"), F.lit(1).alias("page_number"),
        F.col("text").alias("page_text"),
    )
    pages = prose
    for layout in _RENDERED:
        pages = pages.unionByName(rendered(spark, sf_dir, layout).select(
            F.concat(F.lit(f"{layout}-"), "doc_id").alias("doc_id"), "page_number", "page_text"
        ))
    routed, refused = ROUTE.route_exclusive(pages)
    return routed.select("doc_id", "layout").unionByName(
        refused.select("doc_id", F.col("error_code").alias("layout"))
    )


ROUTING = on_ledger("""
SELECT 'depository-' || statement_id AS doc_id, CASE WHEN account_type = 'checking'
  THEN 'standard_depository' ELSE 'chase_depository' END AS layout FROM dep
UNION ALL SELECT 'card-' || statement_id, 'standard_credit_card' FROM card
UNION ALL SELECT 'brokerage-' || statement_id, 'schwab_brokerage' FROM brok
UNION ALL SELECT 'fund-' || statement_id, 'vanguard_brokerage' FROM brok
UNION ALL SELECT DISTINCT 'combined-pair-' || CAST(account_key // 2 AS VARCHAR) || '-'
  || strftime(month_start, '%Y%m'), 'standard_combined_depository' FROM dep
UNION ALL SELECT 'prose-' || CAST(doc_id AS VARCHAR), CASE WHEN len(m) = 1 THEN m[1]
  ELSE 'ADAPTER_MATCH_FAILED' END FROM (
  SELECT doc_id, list_filter([
    CASE WHEN sb AND NOT several AND acct THEN 'standard_depository' END,
    CASE WHEN NOT sb AND NOT several AND acct AND (contains(u, 'JPMORGAN CHASE')
      OR contains(u, 'CHASE BANK') OR contains(u, 'CHASE CHECKING')
      OR contains(u, 'CHASE SAVINGS') OR starts_with(trim(u), 'CHASE')) THEN 'chase_depository' END,
    CASE WHEN contains(u, 'STANDARD CARD') AND (contains(u, 'CREDIT CARD')
      OR contains(u, 'CARD STATEMENT')) THEN 'standard_credit_card' END,
    CASE WHEN contains(u, 'CHARLES SCHWAB') THEN 'schwab_brokerage' END,
    CASE WHEN contains(u, 'VANGUARD') THEN 'vanguard_brokerage' END,
    CASE WHEN sb AND several THEN 'standard_combined_depository' END], lambda x: x IS NOT NULL) AS m
  FROM (SELECT doc_id, u, contains(u, 'STANDARD BANK') AS sb,
      contains(u, 'COMBINED') OR (contains(u, 'CHECKING SUMMARY') AND contains(u, 'SAVINGS SUMMARY'))
        AS several,
      contains(u, 'CHECKING') OR contains(u, 'SAVINGS') AS acct
    FROM (SELECT doc_id, upper(text) AS u FROM documents)))""")


def check_table(spark, sf_dir):
    """Orders as table rows: some with a drifted header, some with a cell too many or few."""
    key = F.col("o_orderkey")
    cell = F.col("o_orderstatus")
    orders = D.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 1, F.array(F.lit("date"), F.lit("text")))
        .when(key % 7 == 2, F.array(F.lit("Date"), F.lit("DESCRIPTION"), F.lit("Amount")))
        .otherwise(F.array(F.lit("date"), F.lit("description"), F.lit("amount")))
        .alias("headers"),
        F.when(key % 5 == 3, F.array(cell, cell)).when(
            key % 5 == 4, F.array(cell, cell, cell, cell)
        ).otherwise(F.array(cell, cell, cell)).alias("cells"),
    )
    return CHECKS.check_table(
        orders, F.col("headers"), F.col("cells"), ("date", "description", "amount")
    ).select("o_orderkey", "drift", "code")


def legacy_inputs(spark, sf_dir):
    """Brokerage statements as extracted cell tables, with the faults such tables have."""
    lines = D.derived_lines(spark, sf_dir, BROKERAGE)
    key = F.col("order_key")
    size = F.abs("amount_cents")
    amount = F.concat(
        F.when(F.col("amount_cents") < 0, F.lit("-$")).otherwise(F.lit("$")),
        F.format_number(F.floor(size / 100).cast("bigint"), 0), F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )
    day = F.date_format("post_date", "MM/dd/yyyy")
    text = F.col("description")
    cells = (
        F.when(key % 11 == 1, F.array(text, F.lit("June 1"), amount, F.lit("")))
        .when(key % 11 == 2, F.array(text, day, F.lit("n/a"), F.lit("")))
        .when(key % 11 == 3, F.array(text, day))
        .when(key % 11 == 4, F.array(text, F.lit(""), F.lit(""), F.lit("")))
        .when(key % 11 == 5, F.array(F.lit(" "), F.lit(""), F.lit(""), F.lit("")))
        .when(key % 11 == 6, F.array(
            text, F.date_format(F.date_add("post_date", 40), "M/d/yy"), amount, F.lit("")))
        .otherwise(F.array(text, day, amount, F.col("transaction_category")))
    )
    body = lines.select(
        F.col("statement_id").alias("doc_id"), F.lit(0).alias("table_index"),
        F.col("line_no").cast("int").alias("row_index"), cells.alias("cells"),
    )
    docs = lines.select(F.col("statement_id").alias("doc_id"), "month_start").distinct()
    header = docs.select(
        "doc_id", F.lit(0).alias("table_index"), F.lit(0).alias("row_index"),
        F.array(*map(F.lit, ("Description", "Date", " Amount", "Category"))).alias("cells"),
    )
    periods = docs.select(
        "doc_id", F.col("month_start").alias("period_start"),
        F.last_day("month_start").alias("period_end"),
    )
    return header.unionByName(body), periods


def legacy_table_rows(spark, sf_dir):
    lines, violations = LG.legacy_table_rows(*legacy_inputs(spark, sf_dir))
    kept = lines.select(
        "doc_id", "line_no", "post_date", "description", "transaction_type", "amount_cents",
        "category",
    )
    return kept.unionByName(violations.select("doc_id", "code"), allowMissingColumns=True)


LEGACY_ROWS = on_ledger("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS line_no,
  post_date, description, transaction_type, amount_cents, category, CAST(NULL AS VARCHAR) AS code
FROM lg WHERE k NOT IN (1, 2, 3, 4, 5, 6)
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k = 3 THEN 'SchemaDriftError'
  WHEN k = 6 THEN 'InvariantError' ELSE 'TokenError' END FROM lg WHERE k IN (1, 2, 3, 6)""",
    """lg AS (SELECT statement_id AS doc_id, line_no, post_date, description,
  CASE WHEN amount_cents < 0 THEN 'debit' ELSE 'credit' END AS transaction_type,
  abs(amount_cents) AS amount_cents, transaction_category AS category, order_key % 11 AS k
  FROM txn WHERE account_domain = 'custodial_brokerage')""")

# ---------------------------------------------------------------- parsing

_LINE = ["run_id", "institution", "account_mask", "account_type", "statement_start_date",
         "statement_end_date", "opening_balance_cents", "closing_balance_cents"]


def _read_back(pages: DataFrame, sidecar: list[str]) -> DataFrame:
    """Parsed and checked documents, one row per line with its statement and sidecar."""
    ledger, _, _ = parse_and_check(pages)
    statements = statement_detail(ledger).join(
        ledger.accounts.drop("account_domain"), "account_id"
    )
    lines = ledger.transactions.select(
        "statement_id", "line_no", "post_date", "amount_cents", "transaction_category",
        "balance_after_cents",
    )
    return statements.select("statement_id", *_LINE, *sidecar).join(
        lines, "statement_id", "left"
    ).drop("statement_id")


_DEP = ["deposits_cents", "withdrawals_cents", "interest_paid_cents", "fees_cents"]
_CARD = ["payments_credits_cents", "purchases_cents", "cash_advances_cents",
         "balance_transfers_cents", "fees_charged_cents", "interest_charged_cents",
         "minimum_payment_due_cents", "payment_due_date"]
_BROK = ["opening_portfolio_cents", "closing_portfolio_cents", "realized_gains_cents",
         "unrealized_gains_cents", "income_dividends_cents", "transfers_in_cents",
         "transfers_out_cents"]


def parse_depository(spark, sf_dir):
    return _read_back(rendered(spark, sf_dir, "depository"), _DEP)


def parse_card(spark, sf_dir):
    return _read_back(rendered(spark, sf_dir, "card"), _CARD)


def parse_brokerage(spark, sf_dir):
    return _read_back(rendered(spark, sf_dir, "brokerage"), _BROK)


def parse_vanguard(spark, sf_dir):
    return _read_back(rendered(spark, sf_dir, "fund"), _BROK)


def parse_combined(spark, sf_dir):
    return _read_back(rendered(spark, sf_dir, "combined"), _DEP)


def parse_holdings(spark, sf_dir):
    """Positions of both brokerage layouts, read back from their printed tables."""
    out = None
    for layout in ("brokerage", "fund"):
        pages = rendered(spark, sf_dir, layout)
        ledger, _, _ = parse_and_check(pages)
        rows = ledger.holdings.join(
            ledger.statements.select("statement_id", "run_id"), "statement_id"
        ).select(F.lit(layout).alias("layout"), "run_id", "as_of_date", "symbol", "description",
                 "quantity_nanos", "market_value_cents")
        out = rows if out is None else out.unionByName(rows)
    return out


def _parsed_sql(source: str, institution: str, sidecar: list[str], where: str,
                category: str = "t.transaction_category",
                balance: str = "CAST(NULL AS BIGINT)") -> str:
    buckets = ", ".join(f"s.{c}" for c in sidecar)
    return on_ledger(f"""
SELECT st.run_id, {institution} AS institution, a.account_mask, a.account_type,
  st.statement_start_date, st.statement_end_date, st.opening_balance_cents,
  st.closing_balance_cents, {buckets}, t.line_no, t.post_date, t.amount_cents,
  {category} AS transaction_category, {balance} AS balance_after_cents
FROM {source} s JOIN st USING (statement_id) JOIN acc a ON a.account_key = st.account_key
LEFT JOIN txn t ON t.statement_id = st.statement_id WHERE {where}""")


COMBINED = on_ledger("""
SELECT 'pair-' || CAST(pair AS VARCHAR) || '-' || strftime(month_start, '%Y%m') AS run_id,
  'standard_bank' AS institution, account_mask, account_type, month_start AS statement_start_date,
  CAST(last_day(month_start) AS DATE) AS statement_end_date, opening_balance_cents,
  closing_balance_cents, deposits_cents, withdrawals_cents, interest_paid_cents, fees_cents,
  t.line_no, t.post_date, t.amount_cents, CASE t.transaction_category WHEN 'other_debit'
    THEN 'withdrawal' ELSE t.transaction_category END AS transaction_category,
  t.balance_after_cents
FROM sides LEFT JOIN (SELECT statement_id, line_no, post_date, amount_cents, transaction_category,
    balance_after_cents FROM txn) t USING (statement_id)
WHERE NOT pair_fails""", """
pairs AS (SELECT account_key // 2 AS pair, month_start, bool_or(fees_cents < 0) AS pair_fails
  FROM dep GROUP BY 1, 2),
sides AS (
  SELECT p.pair, p.month_start, p.pair_fails, d.statement_id,
    coalesce('*' || lpad(CAST(d.account_key % 10000 AS VARCHAR), 4, '0'), '*0000') AS account_mask,
    CASE WHEN odd = 0 THEN 'checking' ELSE 'savings' END AS account_type,
    coalesce(d.opening_balance_cents, 0) AS opening_balance_cents,
    coalesce(d.closing_balance_cents, 0) AS closing_balance_cents,
    coalesce(d.deposits_cents, 0) AS deposits_cents,
    coalesce(d.withdrawals_cents, 0) AS withdrawals_cents,
    coalesce(d.interest_paid_cents, 0) AS interest_paid_cents,
    coalesce(d.fees_cents, 0) AS fees_cents
  FROM pairs p CROSS JOIN (VALUES (0), (1)) AS o(odd)
  LEFT JOIN dep d ON d.account_key = 2 * p.pair + odd AND d.month_start = p.month_start)""")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed bank statements, most of them damaged in one of nine ways by account number."""
    pages = rendered(spark, sf_dir, "depository")
    kind = F.substring_index("doc_id", "-", 1).cast("bigint") % 10
    text = F.col("page_text")
    first = F.col("page_number") == 1

    def edit(number: int, pattern: str, replacement: str):
        return F.when((kind == number) & first, F.regexp_replace(text, pattern, replacement))

    edits = [
        edit(1, r"STANDARD BANK|CHASE BANK", "SOME BANK"),
        edit(2, r"ACCOUNT SUMMARY", "SUMMARY OF ACCOUNT"),
        edit(3, r"(Account Number: )(\*\d{4})", "$1$2\n$1*99999"),
        edit(4, r"Statement Period: (\S+) to", "Statement Period: 13/45/1999 to"),
        edit(5, r"Interest Paid: \S+\n", ""),
        edit(6, r"Date    Description    Amount    Balance", "Date    Memo    Amount    Balance"),
        edit(7, r"(?m)^(\d{4}-\d{2}-\d{2}    [A-Za-z ]+    )[+-]", "$1"),
        edit(8, r"(Ending Balance: -?\$[\d,]+\.)\d\d", "$1xx"),
        edit(9, r"(?m)^(\d{4}-\d{2}-\d{2}    [A-Za-z ]+    \S+    .*)$", "$1    extra"),
    ]
    return pages.withColumn("page_text", F.coalesce(*edits, text))


def parse_failures(spark, sf_dir):
    """First failure of each damaged document; refused documents carry the match code."""
    parsed = parse_statements(damaged(spark, sf_dir))
    failed = first_failure(all_violations(parsed, earliest=True)).select("doc_id", "code")
    return failed.unionByName(parsed.refused.select("doc_id", F.col("error_code").alias("code")))


FAILURES = on_ledger("""
SELECT statement_id AS doc_id, code FROM (
SELECT statement_id, CASE k WHEN 1 THEN 'ADAPTER_MATCH_FAILED' WHEN 2 THEN 'MissingSectionError'
    WHEN 3 THEN 'AmbiguousAccountsError' WHEN 4 THEN 'TokenError'
    WHEN 5 THEN 'MissingSectionError'
    WHEN 6 THEN CASE WHEN fees_cents < 0 THEN 'InvariantError' ELSE 'SchemaDriftError' END
    WHEN 7 THEN CASE WHEN fees_cents < 0 THEN 'InvariantError' ELSE 'TokenError' END
    WHEN 8 THEN CASE WHEN fees_cents < 0 THEN 'InvariantError' ELSE 'MissingSectionError' END
    WHEN 9 THEN CASE WHEN fees_cents < 0 THEN 'InvariantError' ELSE 'SchemaDriftError' END
    ELSE CASE WHEN fees_cents < 0 THEN 'InvariantError' END END AS code
FROM (SELECT *, account_key % 10 AS k FROM dep)) WHERE code IS NOT NULL""")

# ---------------------------------------------------------------- redaction

# The redaction patterns, for the other engine.
_SQL_PATTERNS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[REDACTED]"),
    (r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b", "[REDACTED]"),
    (r"\b\d{16,}\b", "[REDACTED]"),
    (r"(?i)\b\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Street|St|Avenue|Ave|Boulevard|Blvd"
     r"|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct)\b", "[REDACTED]"),
    (r"(?i)(\b(?:amount|balance|payment|charge|fee|total)\b\s*[:=]?\s*)(?:\$)?"
     r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)", r"\1[REDACTED_AMOUNT]"),
]


def redact_sql(column: str) -> str:
    out = column
    for pattern, mask in _SQL_PATTERNS:
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return out


def redact_documents(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("text", R.redact_text(F.col("text")))


def redact_pages(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.withColumn("html", R.redact_text(F.col("html")))


def redact_conversations(spark, sf_dir):
    turns = D.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.withColumn("text", R.redact_text(F.col("text")))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written into sentences with every kind of personal data."""
    key = F.col("c_custkey")
    digits = F.lpad((key % 10000).cast("string"), 4, "0")
    shapes = [
        F.concat(F.lit("SSN 123-45-"), digits, F.lit(" and 987-65-"), digits),
        F.concat(F.lit("write to c"), key.cast("string"), F.lit("@mail.example.org, please")),
        F.concat(F.lit("call (555) 123-"), digits, F.lit(" or 555-"), digits),
        F.concat(F.lit("account 123456789012"), digits, F.lit(" or 12345678901"), digits),
        F.concat((key % 900 + 1).cast("string"), F.lit(" Oak Hill Road is a quiet Lane")),
        F.concat(F.lit("balance: $"), F.format_number(key, 0), F.lit(".50, total "),
                 (key + 10000).cast("string")),
        F.concat(F.lit("8fee1234-5678-4abc-8def-01234567"), digits),
    ]
    return D.table(spark, sf_dir, "customer").select(
        "c_custkey", _pick(key, shapes).alias("text")
    )


PLANTED = """planted AS (SELECT c_custkey, CASE c_custkey % 7
  WHEN 0 THEN 'SSN 123-45-' || d || ' and 987-65-' || d
  WHEN 1 THEN 'write to c' || c_custkey || '@mail.example.org, please'
  WHEN 2 THEN 'call (555) 123-' || d || ' or 555-' || d
  WHEN 3 THEN 'account 123456789012' || d || ' or 12345678901' || d
  WHEN 4 THEN (c_custkey % 900 + 1) || ' Oak Hill Road is a quiet Lane'
  WHEN 5 THEN 'balance: $' || format('{:,}', c_custkey) || '.50, total ' || (c_custkey + 10000)
  ELSE '8fee1234-5678-4abc-8def-01234567' || d END AS text
  FROM (SELECT c_custkey, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS d FROM customer))"""


def redact_planted(spark, sf_dir):
    return planted(spark, sf_dir).withColumn("text", R.redact_text(F.col("text")))


def redaction_counts(spark, sf_dir):
    """Occurrences per pattern over documents, pages and the planted sentences together."""
    texts = (
        D.table(spark, sf_dir, "documents").select("text")
        .unionByName(D.table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
        .unionByName(planted(spark, sf_dir).select("text"))
    )
    return R.redaction_counts(texts, "text")


def _counts_sql() -> str:
    parts, text = [], "text"
    for name, (pattern, mask) in zip(R.PATTERN_NAMES, _SQL_PATTERNS, strict=True):
        parts.append(f"SELECT '{name}' AS pattern, CAST(coalesce(sum(len(regexp_extract_all({text}, "
                     f"'{pattern}'))), 0) AS BIGINT) AS occurrences FROM texts")
        text = f"regexp_replace({text}, '{pattern}', '{mask}', 'g')"
    return (f"WITH {PLANTED}, texts AS (SELECT text FROM documents UNION ALL SELECT html FROM pages "
            "UNION ALL SELECT text FROM planted WHERE c_custkey % 7 <> 6) "
            + " UNION ALL ".join(parts))


def redact_nested(spark, sf_dir):
    """Nested customer records, scrubbed and not, with their leaves laid out flat again."""
    key = F.col("c_custkey")
    nested = planted(spark, sf_dir).join(
        D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey"
    ).select(
        "c_custkey",
        F.struct(
            F.concat(F.lit("call 555-"), F.lpad(key.cast("string"), 4, "0")).alias("run_id"),
            D.price_cents(F.col("c_acctbal")).alias("amount_cents"),
            F.col("c_acctbal").alias("amount"),
            F.col("text").alias("description"),
            F.array("text", "c_name").alias("notes"),
            F.create_map(F.lit("fee"), F.lit("12.00"), F.lit("memo"), F.col("text"),
                         F.lit("page_text"), F.col("c_name")).alias("extra"),
        ).alias("record"),
    )
    out = None
    for scrub in (False, True):
        flat = R.redact_frame(nested, scrub_row_pii=scrub).select(
            "c_custkey", F.lit(scrub).alias("scrubbed"), "record.run_id", "record.amount_cents",
            "record.amount", "record.description",
            F.col("record.notes")[0].alias("note_0"), F.col("record.notes")[1].alias("note_1"),
            F.col("record.extra")["fee"].alias("fee"), F.col("record.extra")["memo"].alias("memo"),
            F.col("record.extra")["page_text"].alias("page_text"),
        )
        out = flat if out is None else out.unionByName(flat)
    return out


NESTED = f"""
WITH {PLANTED}, r AS (SELECT c_custkey, c_name, c_acctbal,
  CASE WHEN c_custkey % 7 = 6 THEN text ELSE {redact_sql('text')} END AS red,
  'call 555-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS run_id,
  {redact_sql('c_name')} AS name FROM planted JOIN customer USING (c_custkey))
SELECT c_custkey, scrubbed, run_id, CAST(round(c_acctbal * 100) AS BIGINT) AS amount_cents,
  '[REDACTED_AMOUNT]' AS amount, CASE WHEN scrubbed THEN '[REDACTED]' ELSE red END AS description,
  red AS note_0, name AS note_1, '[REDACTED_AMOUNT]' AS fee, red AS memo,
  CASE WHEN scrubbed THEN '[REDACTED]' ELSE name END AS page_text
FROM r, (VALUES (FALSE), (TRUE)) AS v(scrubbed)"""

_FUND_CATEGORY = ("CASE t.transaction_category WHEN 'interest' THEN 'other_credit' "
                  "ELSE t.transaction_category END")

QUERIES: dict[str, tuple] = {
    "cents": (cents, CENTS),
    "quantity_nanos": (quantity_nanos, QUANTITY),
    "usd_form": (usd_form, USD_FORM),
    "legacy_cents": (legacy_cents, LEGACY),
    "dates": (dates, DATE_SQL),
    "signs_and_columns": (signs_and_columns, SIGNS),
    "categorize_depository": (
        categorize_depository, _category_sql(DEPOSITORY, "transaction_category")
    ),
    "categorize_card": (categorize_card, _category_sql(CARD, "transaction_category")),
    "categorize_brokerage": (
        categorize_brokerage, _category_sql(BROKERAGE, "transaction_category")
    ),
    "categorize_vanguard": (
        categorize_vanguard,
        _category_sql(BROKERAGE, "CASE WHEN transaction_category IN ('dividend', 'fee') THEN "
                      "transaction_category WHEN amount_cents > 0 THEN 'other_credit' "
                      "ELSE 'other_debit' END"),
    ),
    "categorize_combined": (
        categorize_combined,
        _category_sql(DEPOSITORY, "CASE WHEN transaction_category IN ('fee', 'fee_reversal') THEN "
                      "'fee' WHEN transaction_category = 'interest_paid' THEN 'interest_paid' "
                      "WHEN amount_cents > 0 THEN 'deposit' ELSE 'withdrawal' END"),
    ),
    "routing": (routing, ROUTING),
    "check_table": (
        check_table,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 1 THEN 'header_drift' ELSE 'ragged_row' END "
        "AS drift, 'SchemaDriftError' AS code FROM orders "
        "WHERE o_orderkey % 7 = 1 OR o_orderkey % 5 IN (3, 4)",
    ),
    "legacy_table_rows": (legacy_table_rows, LEGACY_ROWS),
    "parse_depository": (
        parse_depository,
        _parsed_sql("dep", "CASE WHEN a.account_type = 'checking' THEN 'Standard Bank' "
                    "ELSE 'Chase' END", _DEP, "s.fees_cents >= 0",
                    balance="t.balance_after_cents"),
    ),
    "parse_card": (
        parse_card, _parsed_sql("card", "'Standard Card'", _CARD, "s.fees_charged_cents >= 0")
    ),
    "parse_brokerage": (
        parse_brokerage, _parsed_sql("brok", "'Charles Schwab'", _BROK, "TRUE")
    ),
    "parse_vanguard": (
        parse_vanguard, _parsed_sql("brok", "'Vanguard'", _BROK, "TRUE", category=_FUND_CATEGORY)
    ),
    "parse_combined": (parse_combined, COMBINED),
    "parse_holdings": (
        parse_holdings,
        on_ledger("SELECT layout, statement_id AS run_id, as_of_date, symbol, description, "
                  "quantity_nanos, market_value_cents FROM hold, "
                  "(VALUES ('brokerage'), ('fund')) AS v(layout)"),
    ),
    "parse_failures": (parse_failures, FAILURES),
    "redact_documents": (
        redact_documents, f"SELECT doc_id, {redact_sql('text')} AS text FROM documents"
    ),
    "redact_pages": (redact_pages, f"SELECT page_id, {redact_sql('html')} AS html FROM pages"),
    "redact_conversations": (
        redact_conversations,
        f"SELECT conv_id, turn, {redact_sql('text')} AS text FROM conversations",
    ),
    "redact_planted": (
        redact_planted,
        f"WITH {PLANTED} SELECT c_custkey, CASE WHEN c_custkey % 7 = 6 THEN text ELSE "
        f"{redact_sql('text')} END AS text FROM planted",
    ),
    "redaction_counts": (redaction_counts, _counts_sql()),
    "redact_nested": (redact_nested, NESTED),
}
