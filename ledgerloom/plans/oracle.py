"""The derived ledger and every check of it in plain SQL, for comparison on another engine."""

from __future__ import annotations

LEDGER = """
WITH acc AS (
  SELECT c_custkey AS account_key, CAST(c_custkey AS VARCHAR) AS account_id,
    n_name AS institution,
    '*' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS account_mask,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'depository'
      WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'revolving_credit'
      ELSE 'custodial_brokerage' END AS account_domain,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
        THEN CASE WHEN c_custkey % 2 = 0 THEN 'checking' ELSE 'savings' END
      WHEN c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'credit_card'
      ELSE CASE WHEN c_custkey % 2 = 0 THEN 'brokerage_cash' ELSE 'brokerage_margin' END
    END AS account_type,
    'USD' AS currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), raw AS (
  SELECT o_orderkey AS order_key, account_key, account_id, account_domain, account_type,
    CAST(o_orderdate AS DATE) AS post_date,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
    CAST(round(o_totalprice * 100) AS BIGINT) AS size,
    CASE account_domain
      WHEN 'depository' THEN CASE o_orderkey % 7 WHEN 0 THEN 'deposit' WHEN 1 THEN 'withdrawal'
        WHEN 2 THEN 'interest_paid' WHEN 3 THEN 'fee' WHEN 4 THEN 'fee_reversal'
        WHEN 5 THEN 'deposit' ELSE 'other_debit' END
      WHEN 'revolving_credit' THEN CASE o_orderkey % 8 WHEN 0 THEN 'purchase'
        WHEN 1 THEN 'payment' WHEN 2 THEN 'credit' WHEN 3 THEN 'cash_advance'
        WHEN 4 THEN 'balance_transfer' WHEN 5 THEN 'fee' WHEN 6 THEN 'interest_charged'
        ELSE 'fee_reversal' END
      ELSE CASE o_orderkey % 8 WHEN 0 THEN 'dividend' WHEN 1 THEN 'interest'
        WHEN 2 THEN 'transfer_in' WHEN 3 THEN 'transfer_out' WHEN 4 THEN 'fee'
        WHEN 5 THEN 'trade_cash' WHEN 6 THEN 'other_credit' ELSE 'other_debit' END
    END AS category
  FROM orders JOIN acc ON o_custkey = account_key
), ent AS (
  SELECT *, account_id || '-' || strftime(month_start, '%Y%m') AS statement_id,
    CASE WHEN category IN ('withdrawal', 'other_debit', 'payment', 'credit', 'transfer_out')
        OR (category = 'fee' AND account_domain <> 'revolving_credit')
        OR (category = 'fee_reversal' AND account_domain = 'revolving_credit')
        OR (category = 'trade_cash' AND order_key % 16 >= 8)
      THEN -size ELSE size END AS amount_cents
  FROM raw
), txn AS (
  SELECT CAST(order_key AS VARCHAR) AS transaction_id, statement_id, order_key, account_key,
    account_id, account_domain, account_type, month_start, post_date, amount_cents,
    category AS transaction_category,
    CAST(row_number() OVER (PARTITION BY statement_id ORDER BY post_date, order_key) AS BIGINT)
      AS line_no,
    CAST(sum(amount_cents) OVER (PARTITION BY account_id ORDER BY post_date, order_key
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after_cents,
    CASE WHEN category = 'trade_cash'
        THEN CASE WHEN amount_cents > 0 THEN 'Sold Shares' ELSE 'Bought Shares' END
      WHEN account_domain = 'depository' AND category = 'fee' THEN 'Monthly Service Fee'
      WHEN account_domain = 'depository' AND category = 'fee_reversal'
        THEN 'Service Fee Refund'
      WHEN account_domain = 'revolving_credit' AND category = 'fee' THEN 'Late Fee'
      WHEN account_domain = 'revolving_credit' AND category = 'fee_reversal'
        THEN 'Late Fee Reversal'
      WHEN category = 'fee' THEN 'Account Fee'
      WHEN category = 'deposit' THEN 'Payroll Deposit'
      WHEN category = 'withdrawal' THEN 'ATM Withdrawal'
      WHEN category = 'interest_paid' THEN 'Interest Earned'
      WHEN category = 'purchase' THEN 'Grocery Store Purchase'
      WHEN category = 'payment' THEN 'Payment Received'
      WHEN category = 'credit' THEN 'Merchandise Return'
      WHEN category = 'cash_advance' THEN 'Cash Advance'
      WHEN category = 'balance_transfer' THEN 'Balance Transfer'
      WHEN category = 'interest_charged' THEN 'Interest Charge'
      WHEN category = 'dividend' THEN 'Qualified Dividend'
      WHEN category = 'interest' THEN 'Credit Interest'
      WHEN category = 'transfer_in' THEN 'Wire In'
      WHEN category = 'transfer_out' THEN 'Wire Out'
      WHEN category = 'other_credit' THEN 'Misc Credit'
      ELSE 'Misc Debit' END AS description
  FROM ent
), sums AS (
  SELECT statement_id, account_id, account_key, account_domain, account_type, month_start,
    count(*) AS n_lines,
    CAST(sum(amount_cents) AS BIGINT) AS net_change_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category IN ('deposit', 'other_credit')), 0)
      AS BIGINT) AS deposits_cents,
    CAST(-coalesce(sum(amount_cents) FILTER (category IN ('withdrawal', 'other_debit')), 0)
      AS BIGINT) AS withdrawals_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'interest_paid'), 0) AS BIGINT)
      AS interest_paid_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category IN ('fee', 'fee_reversal')), 0) AS BIGINT)
      AS fees_net,
    CAST(-coalesce(sum(amount_cents) FILTER (category IN ('payment', 'credit')), 0) AS BIGINT)
      AS payments_credits_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'purchase'), 0) AS BIGINT)
      AS purchases_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'cash_advance'), 0) AS BIGINT)
      AS cash_advances_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'balance_transfer'), 0) AS BIGINT)
      AS balance_transfers_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'interest_charged'), 0) AS BIGINT)
      AS interest_charged_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'transfer_in'), 0) AS BIGINT)
      AS transfers_in_cents,
    CAST(-coalesce(sum(amount_cents) FILTER (category = 'transfer_out'), 0) AS BIGINT)
      AS transfers_out_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category IN ('dividend', 'interest')), 0) AS BIGINT)
      AS income_dividends_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category = 'trade_cash'), 0) AS BIGINT)
      AS realized_gains_cents,
    CAST(coalesce(sum(amount_cents) FILTER (category IN ('other_credit', 'other_debit')), 0)
      AS BIGINT) AS unrealized_gains_cents
  FROM ent GROUP BY ALL
), st AS (
  SELECT *, closing_balance_cents - net_change_cents AS opening_balance_cents,
    statement_id AS run_id, 'p-' || statement_id AS raw_payload_id,
    month_start AS statement_start_date,
    CAST(last_day(month_start) AS DATE) AS statement_end_date
  FROM (SELECT *, CAST(sum(net_change_cents) OVER (PARTITION BY account_id ORDER BY month_start
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS closing_balance_cents FROM sums)
), dep AS (
  SELECT *, -fees_net AS fees_cents FROM st WHERE account_domain = 'depository'
), card AS (
  SELECT *, opening_balance_cents AS previous_balance_cents, fees_net AS fees_charged_cents,
    closing_balance_cents AS new_balance_cents, CAST(2500 AS BIGINT) AS minimum_payment_due_cents,
    CAST(statement_end_date + INTERVAL 25 DAY AS DATE) AS payment_due_date
  FROM st WHERE account_domain = 'revolving_credit'
), brok AS (
  SELECT statement_id, account_key, opening_balance_cents AS opening_cash_cents,
    closing_balance_cents AS closing_cash_cents,
    CASE WHEN account_key % 2 = 0 THEN opening_balance_cents * 10 END AS opening_portfolio_cents,
    CASE WHEN account_key % 2 = 0 THEN opening_balance_cents * 10 + transfers_in_cents
      - transfers_out_cents + income_dividends_cents + realized_gains_cents
      + unrealized_gains_cents END AS closing_portfolio_cents,
    CASE WHEN account_key % 2 = 0 THEN realized_gains_cents END AS realized_gains_cents,
    CASE WHEN account_key % 2 = 0 THEN unrealized_gains_cents END AS unrealized_gains_cents,
    CASE WHEN account_key % 2 = 0 THEN income_dividends_cents END AS income_dividends_cents,
    CASE WHEN account_key % 2 = 0 THEN transfers_in_cents END AS transfers_in_cents,
    CASE WHEN account_key % 2 = 0 THEN transfers_out_cents END AS transfers_out_cents
  FROM st WHERE account_domain = 'custodial_brokerage'
), hold AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS holding_id,
    statement_id, CAST(last_day(month_start) AS DATE) AS as_of_date,
    'P' || CAST(l_partkey AS VARCHAR) AS symbol, p_name AS description,
    CAST(l_quantity AS BIGINT) * 1000000000 AS quantity_nanos,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS market_value_cents
  FROM lineitem JOIN ent ON l_orderkey = order_key JOIN part ON l_partkey = p_partkey
  WHERE account_domain = 'custodial_brokerage'
)
"""


def on_ledger(select: str, more: str = "") -> str:
    """A query over the derived ledger; ``more`` adds further named parts."""
    return LEDGER + (f", {more}" if more else "") + select


TOTALS = """count(*) AS {count},
  CAST(coalesce(sum(amount_cents) FILTER (transaction_category = 'deposit'), 0) AS BIGINT)
    AS {p}deposits_cents,
  CAST(coalesce(sum(amount_cents) FILTER (transaction_category = 'purchase'), 0) AS BIGINT)
    AS {p}purchases_cents,
  CAST(coalesce(sum(amount_cents) FILTER (transaction_category = 'withdrawal'), 0) AS BIGINT)
    AS {p}withdrawals_cents"""

SUMS = TOTALS.format(count="txn_count", p="")

VIEW = """a.account_id, a.institution, a.account_mask, a.account_domain, a.account_type, a.currency,
  s.statement_id, s.run_id, s.raw_payload_id, s.statement_start_date, s.statement_end_date,
  s.opening_balance_cents, s.closing_balance_cents, s.net_change_cents, s.n_lines AS txn_count"""

OVERVIEW = """
SELECT s.statement_id, s.account_id, a.institution, a.account_type, a.account_mask,
  s.statement_start_date, s.statement_end_date, s.opening_balance_cents,
  s.closing_balance_cents, s.net_change_cents
FROM (SELECT *, row_number() OVER (PARTITION BY account_id
        ORDER BY statement_end_date DESC, statement_id DESC) AS rn
      FROM {source}) s JOIN acc a ON s.account_id = a.account_id WHERE rn = 1"""

NEWEST_50 = """n50 AS (SELECT * FROM st ORDER BY statement_end_date DESC, statement_id DESC
  LIMIT 50)"""
