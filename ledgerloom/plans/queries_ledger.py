"""Registered queries over the derived ledger: listings, aggregates, budgets, guarded access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import budget as B
from ledgerloom.operators import guarded as G
from ledgerloom.operators import ledger_queries as Q
from ledgerloom.plans import derive as D
from ledgerloom.plans.oracle import NEWEST_50, OVERVIEW, SUMS, TOTALS, VIEW, on_ledger


def _ledger(spark: SparkSession, sf_dir: str):
    return D.derive_ledger(spark, sf_dir)


def derived_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per statement, plus one run per account that produced nothing."""
    ledger = _ledger(spark, sf_dir)
    done = ledger.statements.select("run_id", "raw_payload_id", F.lit("canonical_persisted")
                                    .alias("status"))
    idle = ledger.accounts.select(
        F.concat(F.lit("idle-"), "account_id").alias("run_id"),
        F.concat(F.lit("p-idle-"), "account_id").alias("raw_payload_id"),
        F.lit("failed").alias("status"),
    )
    return done.unionByName(idle)


RUNS = """runs AS (
  SELECT run_id, raw_payload_id, 'canonical_persisted' AS status FROM st
  UNION ALL SELECT 'idle-' || account_id, 'p-idle-' || account_id, 'failed' FROM acc)"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = D.table(spark, sf_dir, "customer")
    nation = D.table(spark, sf_dir, "nation")
    cents = D.price_cents(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_nationkey", "n_name", "c_mktsegment")
        .agg(F.coalesce(F.sum(cents), F.lit(0)).cast("bigint").alias("balance_cents"))
        .select(
            F.concat_ws("-", F.lit("e"), F.col("n_nationkey").cast("string"), "c_mktsegment")
            .alias("envelope_id"),
            F.concat_ws(" ", F.initcap("n_name"), F.lower("c_mktsegment")).alias("name"),
            "balance_cents",
        )
    )


ENVELOPES = """env AS (
  SELECT 'e-' || CAST(n_nationkey AS VARCHAR) || '-' || c_mktsegment AS envelope_id,
    upper(n_name[1]) || lower(n_name[2:]) || ' ' || lower(c_mktsegment) AS name,
    CAST(coalesce(sum(CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT) END), 0)
      AS BIGINT) AS balance_cents
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_nationkey, n_name, c_mktsegment)"""


def budget_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assign request per order: the customer's nation is the budget."""
    orders = D.table(spark, sf_dir, "orders")
    customer = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey",
                                                         "c_mktsegment")
    cents = D.price_cents(F.col("o_totalprice"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("c_nationkey").cast("string").alias("budget_id"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority").startswith("5"), F.lit("e-none")).otherwise(
            F.concat_ws("-", F.lit("e"), F.col("c_nationkey").cast("string"), "c_mktsegment")
        ).alias("envelope_id"),
        F.when(F.col("o_orderstatus") == "P", -cents).otherwise(cents).alias("amount_cents"),
    )


def budget_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = D.price_cents(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return D.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        (F.coalesce(F.sum(cents), F.lit(0)) * 10).cast("bigint").alias("available_cents")
    ).select(F.col("c_nationkey").cast("string").alias("budget_id"), "available_cents")


def assign_batch(spark, sf_dir):
    outcome, _ = B.assign_batch(
        budget_requests(spark, sf_dir), envelopes(spark, sf_dir), budget_available(spark, sf_dir)
    )
    return outcome


def assigned_balances(spark, sf_dir):
    _, balances = B.assign_batch(
        budget_requests(spark, sf_dir), envelopes(spark, sf_dir), budget_available(spark, sf_dir)
    )
    return balances.select("envelope_id", "balance_cents")


def assign_batch_hot(spark, sf_dir):
    """All requests draw on one budget, in the order of their numbers."""
    one = F.lit("all").alias("budget_id")
    requests = budget_requests(spark, sf_dir).select(one, "seq", "envelope_id", "amount_cents")
    available = budget_available(spark, sf_dir).agg(
        F.sum("available_cents").cast("bigint").alias("available_cents")
    ).select(one, "available_cents")
    return B.assign_batch(requests, envelopes(spark, sf_dir), available)[0]


ADMISSION = """
WITH RECURSIVE """ + ENVELOPES + """, req AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS budget_id, o_orderkey AS seq,
    CASE WHEN o_orderpriority LIKE '5%' THEN 'e-none'
      ELSE 'e-' || CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment END AS envelope_id,
    CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END
      * CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents
  FROM orders JOIN customer ON o_custkey = c_custkey
), avail AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS budget_id,
    CAST(10 * coalesce(sum(CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 100) AS BIGINT)
      END), 0) AS BIGINT) AS available_cents
  FROM customer GROUP BY c_nationkey
), open AS (
  SELECT budget_id, seq, amount_cents,
    row_number() OVER (PARTITION BY budget_id ORDER BY seq) AS n
  FROM req WHERE amount_cents > 0 AND envelope_id IN (SELECT envelope_id FROM env)
), fold AS (
  SELECT budget_id, CAST(0 AS BIGINT) AS n, available_cents AS rest, FALSE AS ok,
    CAST(NULL AS BIGINT) AS seq FROM avail
  UNION ALL
  SELECT o.budget_id, o.n, CASE WHEN o.amount_cents <= f.rest THEN f.rest - o.amount_cents
    ELSE f.rest END, o.amount_cents <= f.rest, o.seq
  FROM fold f JOIN open o ON o.budget_id = f.budget_id AND o.n = f.n + 1
), outcome AS (
  SELECT r.*, coalesce(f.ok, FALSE) AS accepted,
    CASE WHEN coalesce(f.ok, FALSE) THEN NULL WHEN amount_cents <= 0 THEN 'TokenError'
      WHEN envelope_id NOT IN (SELECT envelope_id FROM env) THEN 'ENVELOPE_NOT_FOUND'
      ELSE 'ASSIGN_EXCEEDS_AVAILABLE' END AS error
  FROM req r LEFT JOIN fold f ON f.budget_id = r.budget_id AND f.seq = r.seq
)
"""


def envelope_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One creation request per customer, with stray blanks, mixed case and blank names."""
    customer = D.table(spark, sf_dir, "customer")
    nation = D.table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    name = F.concat_ws(" ", "n_name", "c_mktsegment", F.lit("fund"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("request_id"),
        F.when(key % 5 == 0, F.upper(name)).when(key % 5 == 1, F.concat(F.lit("  "), name))
        .when(key % 5 == 2, F.lit("   ")).otherwise(F.lower(name)).alias("name"),
    )


def existing_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = D.table(spark, sf_dir, "nation")
    region = D.table(spark, sf_dir, "region").filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" BUILDING Fund ")).alias("name")
    )


def create_envelopes(spark, sf_dir):
    created, refused = B.create_envelopes(
        envelope_requests(spark, sf_dir), existing_envelopes(spark, sf_dir)
    )
    return created.select(
        "request_id", "name", F.lit(None).cast("string").alias("error")
    ).unionByName(refused)


CREATE_ENVELOPES = """
WITH req AS (
  SELECT c_custkey AS request_id,
    trim(CASE c_custkey % 5 WHEN 0 THEN upper(n_name || ' ' || c_mktsegment || ' fund')
      WHEN 1 THEN '  ' || n_name || ' ' || c_mktsegment || ' fund' WHEN 2 THEN '   '
      ELSE lower(n_name || ' ' || c_mktsegment || ' fund') END) AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), taken AS (
  SELECT lower(n_name) || ' building fund' AS k FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE r_name IN ('ASIA', 'EUROPE')
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY request_id) AS rn FROM req
)
SELECT request_id, name, CASE WHEN name = '' THEN 'TokenError'
  WHEN rn > 1 OR lower(name) IN (SELECT k FROM taken) THEN 'DUPLICATE_NAME' END AS error
FROM ranked"""


def resolve_accounts(spark, sf_dir):
    """A batch with every account, against a ledger that holds only bank and card accounts."""
    accounts = _ledger(spark, sf_dir).accounts
    existing = accounts.filter(F.col("account_domain") != "custodial_brokerage")
    new = accounts.withColumn("account_id", F.concat(F.lit("new-"), "account_id"))
    resolved, _ = Q.resolve_accounts(new, existing)
    return resolved


def inserted_accounts(spark, sf_dir):
    accounts = _ledger(spark, sf_dir).accounts
    existing = accounts.filter(F.col("account_domain") != "custodial_brokerage")
    new = accounts.withColumn("account_id", F.concat(F.lit("new-"), "account_id"))
    _, inserts = Q.resolve_accounts(new, existing)
    return inserts


def statement_detail(spark, sf_dir):
    return Q.statement_detail(_ledger(spark, sf_dir))


def ledger_blocks_all(spark, sf_dir):
    """Every statement block, as a run-wide listing would print it."""
    return Q.ledger_blocks(_ledger(spark, sf_dir), limit=None)


BLOCKS = """
SELECT statement_id, institution, s.account_type, account_mask, statement_start_date,
  statement_end_date, opening_balance_cents, closing_balance_cents, row_kind, line_no, post_date,
  transaction_category, description, amount_cents, holding_id, symbol, quantity_nanos,
  market_value_cents
FROM {source} s JOIN acc USING (account_id) JOIN (
  SELECT statement_id, '1-statement' AS row_kind, CAST(NULL AS BIGINT) AS line_no,
    CAST(NULL AS DATE) AS post_date, CAST(NULL AS VARCHAR) AS transaction_category,
    CAST(NULL AS VARCHAR) AS description, CAST(NULL AS BIGINT) AS amount_cents,
    CAST(NULL AS VARCHAR) AS holding_id, CAST(NULL AS VARCHAR) AS symbol,
    CAST(NULL AS BIGINT) AS quantity_nanos, CAST(NULL AS BIGINT) AS market_value_cents FROM st
  UNION ALL SELECT statement_id, '2-transaction', line_no, post_date, transaction_category,
    description, amount_cents, NULL, NULL, NULL, NULL FROM txn
  UNION ALL SELECT statement_id, '3-holding', NULL, NULL, NULL, description, NULL, holding_id,
    symbol, quantity_nanos, market_value_cents FROM hold) USING (statement_id)"""


def asked_keys(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    """Keys of every account's last months, known or not: account, month pairs of all years."""
    accounts = _ledger(spark, sf_dir).accounts.select("account_id")
    return accounts.select(F.explode(F.array(*[
        F.concat(F.lit(prefix), "account_id", F.lit(f"-{year}12")) for year in range(1995, 2001)
    ])).alias("run_id"))


def runs_by_id(spark, sf_dir):
    hits, misses = Q.runs_by_id(derived_runs(spark, sf_dir), asked_keys(spark, sf_dir, ""))
    return hits.select("run_id", F.lit(True).alias("found")).unionByName(
        misses.select("run_id", F.lit(False).alias("found"))
    )


def payloads_by_sha(spark, sf_dir):
    """Payloads are document texts; asked for are the digests of the benchmark texts and theirs."""
    docs = D.table(spark, sf_dir, "documents").select(
        F.sha2(F.col("text"), 256).alias("content_sha256"), "doc_id"
    )
    labelled = D.table(spark, sf_dir, "documents").join(
        D.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"
    ).select(F.sha2(F.col("text"), 256).alias("content_sha256"))
    asked = labelled.unionByName(D.table(spark, sf_dir, "benchmark").select(
        F.sha2(F.col("text"), 256).alias("content_sha256")
    ))
    hits, misses = Q.payloads_by_sha(docs, asked)
    return hits.select("content_sha256", "doc_id").unionByName(
        misses.select("content_sha256", F.lit(None).cast("bigint").alias("doc_id"))
    )


PAYLOADS_BY_SHA = """
WITH d AS (SELECT sha256(text) AS content_sha256, doc_id FROM documents),
asked AS (SELECT sha256(text) AS content_sha256 FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION SELECT sha256(text) FROM benchmark)
SELECT a.content_sha256, d.doc_id FROM asked a LEFT JOIN d ON a.content_sha256 = d.content_sha256"""


def guarded_aggregate(spark, sf_dir):
    return G.guarded_aggregate(
        Q.named_tables(_ledger(spark, sf_dir)), "transactions",
        measures=[
            ("COUNT", "*", "lines"), ("SUM", "amount_cents", "total_cents"),
            ("MIN", "amount_cents", "low_cents"), ("MAX", "amount_cents", "high_cents"),
            ("COUNT_DISTINCT", "statement_id", "statements"),
            ("SUM_DISTINCT", "line_no", "line_number_sum"),
        ],
        group_by=["account_domain", "transaction_category"],
        joins=[("statements", "statement_id")],
        where=[("transaction_category", "<>", "fee"), ("line_no", "<=", 3)],
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged query text per event: a shape picked by the event, its values filled in."""
    n = F.col("event_id")
    value = F.col("user_id").cast("string")
    shapes = [
        F.lit("   "),
        F.concat(F.lit("DELETE FROM accounts WHERE account_id = "), value),
        F.concat(F.lit("SELECT COUNT(*) FROM accounts WHERE 1=1 OR 1 = "), value),
        F.concat(F.lit("SELECT COUNT(*) FROM statements -- "), "event_type"),
        F.lit("select  * from transactions"),
        F.lit("SELECT COUNT(*) FROM transactions t JOIN raw_pages r ON t.statement_id = r.run_id"),
        F.concat(F.lit("SELECT SUM(amount_cents) FROM transactions JOIN "), "event_type",
                 F.lit(" ON TRUE")),
        F.concat(F.lit("SELECT MAX(value) FROM "), "event_type"),
        F.concat(F.lit("SELECT MIN(net_change_cents) FROM statements , "), "event_type"),
        F.lit("SELECT description, COUNT(*) FROM transactions GROUP BY description"),
        F.concat(F.lit("SELECT account_id FROM accounts WHERE account_id = "), value),
        F.concat(F.lit("SELECT SUM(amount_cents) FROM transactions WHERE amount_cents > "), value),
        F.lit("Select avg(net_change_cents) From statements s Join accounts a Using (account_id)"),
        F.concat(F.lit("SELECT COUNT(*) FROM statements; DROP TABLE "), "event_type"),
    ]
    picked = F.element_at(F.array(*shapes), (n % len(shapes) + 1).cast("int"))
    return D.table(spark, sf_dir, "events").select("event_id", picked.alias("sql_text"))


def query_log_audit(spark, sf_dir):
    return G.audit_query_log(query_log(spark, sf_dir)).select("event_id", "verdict", "accepted")


AUDIT = r"""
WITH log AS (SELECT event_id, CASE event_id % 14
  WHEN 0 THEN '   '
  WHEN 1 THEN 'DELETE FROM accounts WHERE account_id = ' || user_id
  WHEN 2 THEN 'SELECT COUNT(*) FROM accounts WHERE 1=1 OR 1 = ' || user_id
  WHEN 3 THEN 'SELECT COUNT(*) FROM statements -- ' || event_type
  WHEN 4 THEN 'select  * from transactions'
  WHEN 5 THEN 'SELECT COUNT(*) FROM transactions t JOIN raw_pages r ON t.statement_id = r.run_id'
  WHEN 6 THEN 'SELECT SUM(amount_cents) FROM transactions JOIN ' || event_type || ' ON TRUE'
  WHEN 7 THEN 'SELECT MAX(value) FROM ' || event_type
  WHEN 8 THEN 'SELECT MIN(net_change_cents) FROM statements , ' || event_type
  WHEN 9 THEN 'SELECT description, COUNT(*) FROM transactions GROUP BY description'
  WHEN 10 THEN 'SELECT account_id FROM accounts WHERE account_id = ' || user_id
  WHEN 11 THEN 'SELECT SUM(amount_cents) FROM transactions WHERE amount_cents > ' || user_id
  WHEN 12 THEN
    'Select avg(net_change_cents) From statements s Join accounts a Using (account_id)'
  ELSE 'SELECT COUNT(*) FROM statements; DROP TABLE ' || event_type END AS q FROM events),
ok AS (SELECT ['statements', 'accounts', 'extraction_runs', 'transactions',
  'statement_depository_summaries', 'statement_credit_summaries',
  'statement_brokerage_summaries'] AS names),
v AS (SELECT event_id, CASE
  WHEN trim(q) = '' THEN 'empty'
  WHEN upper(regexp_extract(trim(q), '^\S+')) <> 'SELECT' THEN 'not_select'
  WHEN regexp_matches(q, '(?i)--\s|;\s*(DROP|ALTER|DELETE|INSERT|UPDATE)\s|\bOR\b\s+\d+\s*=.*\b\d+')
    THEN 'injection_pattern'
  WHEN regexp_matches(q, '(?i)SELECT\s+\*') THEN 'select_star'
  WHEN regexp_matches(q, '(?i)\braw_\w+\b') THEN 'raw_table'
  WHEN NOT list_has_all(names, regexp_extract_all(lower(q), '\bjoin\s+(\w+)', 1))
    THEN 'join_table_not_allowed'
  WHEN NOT list_has_all(names, regexp_extract_all(lower(q), '\bfrom\s+(\w+)', 1))
    THEN 'from_table_not_allowed'
  WHEN NOT list_has_all(names, regexp_extract_all(lower(q), '\bfrom\s+\w+\s*,\s*(\w+)', 1))
    THEN 'comma_join_not_allowed'
  WHEN regexp_matches(q, '(?i)\b(description|account_mask|page_text|original_basename|content_sha256)\b')
    THEN 'forbidden_column'
  WHEN NOT regexp_matches(q, '(?i)\b(SUM|COUNT|AVG|MIN|MAX|SUM_DISTINCT|COUNT_DISTINCT)\s*\(')
    THEN 'no_aggregate'
  ELSE 'accepted' END AS verdict FROM log, ok)
SELECT event_id, verdict, verdict = 'accepted' AS accepted FROM v"""


def sign_rule_usage(spark, sf_dir):
    """Lines and money per rule of the closed sign table."""
    from ledgerloom.rules import sign_rules

    ledger = _ledger(spark, sf_dir)
    lines = ledger.transactions.join(
        ledger.statements.select("statement_id", "account_domain"), "statement_id"
    )
    used = lines.groupBy("account_domain", "transaction_category").agg(
        F.count("*").alias("lines"), F.sum("amount_cents").cast("bigint").alias("total_cents")
    )
    return sign_rules(spark).join(
        used, ["account_domain", "transaction_category"], "left"
    ).select("account_domain", "transaction_category", "required_sign",
             F.coalesce("lines", F.lit(0)).alias("lines"), "total_cents")


SIGN_RULE_USAGE = """, rules(account_domain, transaction_category, required_sign) AS (VALUES
  ('depository', 'deposit', 1), ('depository', 'interest_paid', 1),
  ('depository', 'fee_reversal', 1), ('depository', 'other_credit', 1),
  ('depository', 'withdrawal', -1), ('depository', 'fee', -1), ('depository', 'other_debit', -1),
  ('revolving_credit', 'purchase', 1), ('revolving_credit', 'cash_advance', 1),
  ('revolving_credit', 'balance_transfer', 1), ('revolving_credit', 'fee', 1),
  ('revolving_credit', 'interest_charged', 1), ('revolving_credit', 'payment', -1),
  ('revolving_credit', 'credit', -1), ('revolving_credit', 'fee_reversal', -1),
  ('custodial_brokerage', 'dividend', 1), ('custodial_brokerage', 'interest', 1),
  ('custodial_brokerage', 'transfer_in', 1), ('custodial_brokerage', 'other_credit', 1),
  ('custodial_brokerage', 'transfer_out', -1), ('custodial_brokerage', 'fee', -1),
  ('custodial_brokerage', 'other_debit', -1), ('custodial_brokerage', 'trade_cash', 0))
SELECT r.account_domain, r.transaction_category, r.required_sign, count(t.transaction_id) AS lines,
  CAST(sum(t.amount_cents) AS BIGINT) AS total_cents
FROM rules r LEFT JOIN txn t ON t.account_domain = r.account_domain
  AND t.transaction_category = r.transaction_category
GROUP BY 1, 2, 3"""


def latest_run_totals(spark, sf_dir):
    """Totals after every brokerage file was ingested twice: only the newest run counts."""
    ledger = _ledger(spark, sf_dir)
    again = ledger.statements.filter(F.col("account_domain") == "custodial_brokerage")
    second = again.select(
        *[c for c in again.columns if c not in ("statement_id", "run_id")],
        F.concat("statement_id", F.lit("-again")).alias("statement_id"),
        F.concat("run_id", F.lit("-again")).alias("run_id"),
    )
    copied = ledger.transactions.join(again.select("statement_id"), "statement_id", "left_semi")
    copied = copied.withColumn("statement_id", F.concat("statement_id", F.lit("-again")))
    from dataclasses import replace

    doubled = replace(
        ledger,
        statements=ledger.statements.unionByName(second),
        transactions=ledger.transactions.unionByName(copied),
    )
    return Q.category_totals(Q.latest_runs(doubled).transactions)




QUERIES: dict[str, tuple] = {
    "monthly_aggregates": (
        lambda s, d: Q.monthly_aggregates(_ledger(s, d).transactions),
        on_ledger(f"SELECT strftime(post_date, '%Y-%m') AS month, {SUMS} FROM txn GROUP BY 1"),
    ),
    "monthly_one": (
        lambda s, d: Q.monthly_aggregates(_ledger(s, d).transactions, "1998-02"),
        on_ledger(f"SELECT strftime(post_date, '%Y-%m') AS month, {SUMS} FROM txn "
                  "WHERE strftime(post_date, '%Y-%m') = '1998-02' GROUP BY 1"),
    ),
    "category_totals": (
        lambda s, d: Q.category_totals(_ledger(s, d).transactions),
        on_ledger("SELECT " + TOTALS.format(count="total_transactions", p="total_") + " FROM txn"),
    ),
    "summary_by_category": (
        lambda s, d: Q.financial_summary(_ledger(s, d), "transaction_category"),
        on_ledger(f"SELECT transaction_category, {SUMS} FROM txn GROUP BY 1"),
    ),
    "summary_by_statement": (
        lambda s, d: Q.financial_summary(_ledger(s, d), "statement_id"),
        on_ledger(f"SELECT statement_id, {SUMS} FROM txn GROUP BY 1"),
    ),
    "summary_by_account": (
        lambda s, d: Q.financial_summary(_ledger(s, d), "account_id"),
        on_ledger(f"SELECT account_id, {SUMS} FROM txn GROUP BY 1"),
    ),
    "latest_run_totals": (
        latest_run_totals,
        on_ledger("SELECT " + TOTALS.format(count="total_transactions", p="total_") + " FROM txn"),
    ),
    "recent_statements": (
        lambda s, d: Q.recent_statements(_ledger(s, d), 5),
        on_ledger(f"SELECT {VIEW} FROM st s JOIN acc a ON s.account_id = a.account_id "
                  "ORDER BY s.statement_end_date DESC, s.statement_id DESC LIMIT 5"),
    ),
    "account_overview": (
        lambda s, d: Q.account_overview(_ledger(s, d)),
        on_ledger(OVERVIEW.format(source="st")),
    ),
    # The window of the newest 50 statements is what this form is for.
    "account_overview_newest_50": (
        lambda s, d: Q.account_overview(_ledger(s, d), 50),
        on_ledger(OVERVIEW.format(source="n50"), NEWEST_50),
    ),
    "overview_unbounded": (
        lambda s, d: Q.account_overview(_ledger(s, d), None),
        on_ledger(OVERVIEW.format(source="st")),
    ),
    "overview_totals": (
        lambda s, d: Q.overview_totals(_ledger(s, d), None),
        on_ledger("SELECT count(*) AS account_count, CAST(sum(closing_balance_cents) AS BIGINT) "
                  "AS total_closing_cents FROM (" + OVERVIEW.format(source="st") + ")"),
    ),
    "run_statements": (
        lambda s, d: Q.run_statements(_ledger(s, d)),
        on_ledger(f"SELECT {VIEW} FROM st s JOIN acc a ON s.account_id = a.account_id"),
    ),
    "run_detail": (
        lambda s, d: Q.run_detail(_ledger(s, d), derived_runs(s, d)),
        on_ledger("SELECT r.run_id, r.raw_payload_id, r.status, count(st.statement_id) AS "
                  "statements_count, CAST(coalesce(sum(n_lines), 0) AS BIGINT) AS "
                  "transactions_count FROM runs r LEFT JOIN st ON st.run_id = r.run_id "
                  "GROUP BY 1, 2, 3", RUNS),
    ),
    "statement_detail": (
        statement_detail,
        on_ledger("""SELECT s.statement_id, s.account_id, s.account_domain, s.run_id,
  s.raw_payload_id, s.statement_start_date, s.statement_end_date, s.opening_balance_cents,
  s.closing_balance_cents, s.net_change_cents, d.deposits_cents, d.withdrawals_cents,
  d.interest_paid_cents, d.fees_cents, c.previous_balance_cents, c.payments_credits_cents,
  c.purchases_cents, c.cash_advances_cents, c.balance_transfers_cents, c.fees_charged_cents,
  c.interest_charged_cents, c.new_balance_cents, c.minimum_payment_due_cents, c.payment_due_date,
  b.opening_cash_cents, b.closing_cash_cents, b.opening_portfolio_cents, b.closing_portfolio_cents,
  b.realized_gains_cents, b.unrealized_gains_cents, b.income_dividends_cents,
  b.transfers_in_cents, b.transfers_out_cents, s.account_domain AS sidecar,
  CAST(NULL AS VARCHAR) AS error
FROM st s LEFT JOIN dep d USING (statement_id) LEFT JOIN card c USING (statement_id)
LEFT JOIN brok b USING (statement_id)"""),
    ),
    "statement_lines": (
        lambda s, d: Q.statement_lines(_ledger(s, d)),
        on_ledger("SELECT transaction_id, statement_id, line_no, post_date, CAST(NULL AS DATE) "
                  "AS transaction_date, amount_cents, description, transaction_category, "
                  "balance_after_cents FROM txn"),
    ),
    "statement_holdings": (
        lambda s, d: Q.statement_holdings(_ledger(s, d)),
        on_ledger("SELECT holding_id, statement_id, as_of_date, symbol, description, "
                  "quantity_nanos, market_value_cents, CAST(NULL AS BIGINT) AS cost_basis_cents "
                  "FROM hold"),
    ),
    "ledger_blocks": (
        lambda s, d: Q.ledger_blocks(_ledger(s, d), 5),
        on_ledger(BLOCKS.format(source="n5"), "n5 AS (SELECT * FROM st ORDER BY "
                  "statement_end_date DESC, statement_id DESC LIMIT 5)"),
    ),
    "ledger_blocks_all": (ledger_blocks_all, on_ledger(BLOCKS.format(source="st"))),
    "payloads_by_sha": (payloads_by_sha, PAYLOADS_BY_SHA),
    "runs_by_id": (
        runs_by_id,
        on_ledger("SELECT k AS run_id, EXISTS (SELECT 1 FROM runs r WHERE r.run_id = k) AS found "
                  "FROM (SELECT account_id || '-' || y || '12' AS k FROM acc, "
                  "(VALUES (1995), (1996), (1997), (1998), (1999), (2000)) AS v(y))", RUNS),
    ),
    "resolve_accounts": (
        resolve_accounts,
        on_ledger("SELECT institution, account_mask, account_type, coalesce(min(CASE WHEN "
                  "account_domain <> 'custodial_brokerage' THEN account_id END), "
                  "min('new-' || account_id)) AS account_id, "
                  "bool_and(account_domain = 'custodial_brokerage') AS created "
                  "FROM acc GROUP BY 1, 2, 3"),
    ),
    "inserted_accounts": (
        inserted_accounts,
        on_ledger("SELECT min('new-' || account_id) AS account_id, institution, account_mask, "
                  "account_domain, account_type, currency FROM acc "
                  "WHERE account_domain = 'custodial_brokerage' GROUP BY ALL"),
    ),
    "bridge_total": (
        lambda s, d: Q.portfolio_bridge_total(
            _ledger(s, d).brokerage_summaries.filter(F.col("opening_portfolio_cents").isNotNull())
        ),
        on_ledger("""SELECT CASE WHEN c = o + i - x + d + r + u THEN 'passed' ELSE 'mismatch' END
  AS status, n AS statement_count, CAST(0 AS BIGINT) AS null_bridge_count,
  o AS opening_portfolio_cents, i AS transfers_in_cents, x AS transfers_out_cents,
  d AS income_dividends_cents, r AS realized_gains_cents, u AS unrealized_gains_cents,
  c AS closing_portfolio_cents, o + i - x + d + r + u AS computed_closing_portfolio_cents
FROM (SELECT count(*) AS n, CAST(sum(opening_portfolio_cents) AS BIGINT) AS o,
  CAST(sum(transfers_in_cents) AS BIGINT) AS i, CAST(sum(transfers_out_cents) AS BIGINT) AS x,
  CAST(sum(income_dividends_cents) AS BIGINT) AS d, CAST(sum(realized_gains_cents) AS BIGINT) AS r,
  CAST(sum(unrealized_gains_cents) AS BIGINT) AS u,
  CAST(sum(closing_portfolio_cents) AS BIGINT) AS c
  FROM brok WHERE opening_portfolio_cents IS NOT NULL)"""),
    ),
    "bridge_total_absent": (
        lambda s, d: Q.portfolio_bridge_total(_ledger(s, d).brokerage_summaries).select(
            "status", "statement_count", "null_bridge_count"
        ),
        on_ledger("SELECT 'absent' AS status, count(*) AS statement_count, "
                  "count(*) FILTER (opening_portfolio_cents IS NULL) AS null_bridge_count "
                  "FROM brok"),
    ),
    "guarded_aggregate": (
        guarded_aggregate,
        on_ledger("SELECT account_domain, transaction_category, count(*) AS lines, "
                  "CAST(sum(amount_cents) AS BIGINT) AS total_cents, "
                  "min(amount_cents) AS low_cents, max(amount_cents) AS high_cents, "
                  "count(DISTINCT statement_id) AS statements, "
                  "CAST(sum(DISTINCT line_no) AS BIGINT) AS line_number_sum "
                  "FROM txn WHERE transaction_category <> 'fee' AND line_no <= 3 GROUP BY 1, 2"),
    ),
    "query_log_audit": (query_log_audit, AUDIT),
    "sign_rule_usage": (sign_rule_usage, on_ledger(SIGN_RULE_USAGE)),
    "envelopes": (
        lambda s, d: B.list_envelopes(envelopes(s, d)),
        f"WITH {ENVELOPES} SELECT envelope_id, name, balance_cents FROM env",
    ),
    "create_envelopes": (create_envelopes, CREATE_ENVELOPES),
    "ready_to_assign": (
        lambda s, d: B.ready_to_assign(_ledger(s, d), envelopes(s, d)),
        on_ledger("SELECT CAST(coalesce((SELECT sum(closing_balance_cents) FROM ("
                  + OVERVIEW.format(source="st") + ")), 0) - coalesce((SELECT "
                  "sum(balance_cents) FROM env), 0) AS BIGINT) AS ready_to_assign_cents",
                  ENVELOPES),
    ),
    "ready_to_assign_newest_50": (
        lambda s, d: B.ready_to_assign(_ledger(s, d), envelopes(s, d), 50),
        on_ledger("SELECT CAST(coalesce((SELECT sum(closing_balance_cents) FROM ("
                  + OVERVIEW.format(source="n50") + ")), 0) - coalesce((SELECT "
                  "sum(balance_cents) FROM env), 0) AS BIGINT) AS ready_to_assign_cents",
                  NEWEST_50 + ", " + ENVELOPES),
    ),
    "ready_to_assign_unbounded": (
        lambda s, d: B.ready_to_assign(_ledger(s, d), envelopes(s, d), None, True),
        on_ledger("SELECT CAST(coalesce((SELECT sum(CASE WHEN account_type = 'credit_card' THEN "
                  "-closing_balance_cents ELSE closing_balance_cents END) FROM ("
                  + OVERVIEW.format(source="st") + ")), 0) - coalesce((SELECT "
                  "sum(balance_cents) FROM env), 0) AS BIGINT) AS ready_to_assign_cents",
                  ENVELOPES),
    ),
    "assign_batch": (
        assign_batch,
        ADMISSION + "SELECT budget_id, seq, envelope_id, amount_cents, accepted, error "
        "FROM outcome",
    ),
    "assign_batch_hot": (
        assign_batch_hot,
        ADMISSION.replace("CAST(c_nationkey AS VARCHAR) AS budget_id", "'all' AS budget_id")
        .replace("FROM customer GROUP BY c_nationkey", "FROM customer")
        + "SELECT budget_id, seq, envelope_id, amount_cents, accepted, error FROM outcome",
    ),
    "assigned_balances": (
        assigned_balances,
        ADMISSION + "SELECT e.envelope_id, CAST(balance_cents + coalesce((SELECT "
        "sum(amount_cents) FROM outcome o WHERE o.accepted AND o.envelope_id = e.envelope_id), 0) "
        "AS BIGINT) AS balance_cents FROM env e",
    ),
}
