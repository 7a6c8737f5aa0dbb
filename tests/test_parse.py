"""Texts of every layout, good and broken, parsed together in one job."""

import datetime as dt

import pytest

from ledgerloom.operators.outcome import StatementError, parse_and_check
from tests import texts as X

BROKEN = {
    "marker": (X.CHECKING.replace("ACCOUNT SUMMARY", "Summary"), "MissingSectionError"),
    "two-masks": (X.CHECKING.replace("*4411\n", "*4411\nAccount Number: *9\n"),
                  "AmbiguousAccountsError"),
    "two-summaries": (X.CHECKING.replace(
        "ACCOUNT SUMMARY", "Checking  Summary\nSavings Account Summary\nACCOUNT SUMMARY"),
        "AmbiguousAccountsError"),
    "no-mask": (X.CHECKING.replace("Account Number: *4411", "Acct *4411"), "MissingSectionError"),
    "bad-period": (X.CHECKING.replace("2024-03-01 to", "2024-13-01 to"), "TokenError"),
    "inverted": (X.CHECKING.replace("2024-03-01 to", "2024-04-02 to"), "ValidationError"),
    "no-label": (X.CHECKING.replace("Interest Paid: $3.50\n", ""), "MissingSectionError"),
    "negative-bucket": (X.CHECKING.replace("Fees Charged: $", "Fees Charged: -$"),
                        "InvariantError"),
    "bad-money": (X.CHECKING.replace("Starting Balance: $2,000.00", "Starting Balance: ($2,000.00"),
                  "TokenError"),
    "header-drift": (X.CHECKING.replace("Date    Desc", "Day    Desc"), "SchemaDriftError"),
    "ragged": (X.CHECKING.replace("+$750.00    $2,750.00", "+$750.00"), "SchemaDriftError"),
    "unsigned": (X.CHECKING.replace("+$750.00    ", "$750.00    "), "TokenError"),
    "row-date": (X.CHECKING.replace("3/15/24", "3/45/24"), "TokenError"),
    "zero-balance": (X.CHECKING.replace("$2,750.00", "$0.00"), "TokenError"),
    "wrong-sign": (X.CHECKING.replace("Payroll Deposit    +", "Payroll Deposit    -"),
                   "TokenError"),
    "one-cent": (X.CHECKING.replace("Ending Balance: $2,625.50", "Ending Balance: $2,625.51"),
                 "InvariantError"),
    "running": (X.CHECKING.replace("$2,630.00", "$2,630.01"), "InvariantError"),
    "late-line": (X.CHECKING.replace("03/09/2024", "04/09/2024"), "InvariantError"),
    "no-due-date": (X.CARD.replace("Payment Due Date: 2024-04-25\n", ""), "MissingSectionError"),
    "no-minimum": (X.CARD.replace("Minimum Payment Due: $35.00\n", ""), "MissingSectionError"),
    "minimum-negative": (X.CARD.replace("Due: $35.00", "Due: -$35.00"), "InvariantError"),
    "card-sign": (X.CARD.replace("Late Fee    +", "Late Fee    -"), "TokenError"),
    "no-bridge-term": (X.BROKERAGE.replace("Transfers Out: $200.00\n", ""), "MissingSectionError"),
    "bridge-off": (X.BROKERAGE.replace("$22,040.00", "$22,040.01"), "InvariantError"),
    "holdings-off": (X.BROKERAGE.replace("Total: $2,000.50", "Total: $2,000.51"),
                     "InvariantError"),
    "no-holdings-total": (X.BROKERAGE.replace("Holdings Total: $2,000.50\n", ""),
                          "MissingSectionError"),
    "bad-quantity": (X.BROKERAGE.replace("    2.5    ", "    2,5    "), "TokenError"),
    "fund-empty": (X.FUND[:X.FUND.index("Date | Activity")], "MissingSectionError"),
    "fund-two-kinds": (X.FUND.replace("Margin\n", "Margin\nRegistration: Brokerage Cash\n"),
                       "AmbiguousAccountsError"),
    "fund-no-text": (X.FUND.replace("Buy Fund", ""), "ValidationError"),
    "combined-total": (X.COMBINED.replace("$3,526.75", "$3,526.76"), "InvariantError"),
    "combined-short": (X.COMBINED.replace("Interest    +$1.25    $901.25", "Interest"),
                       "TokenError"),
    "combined-date": (X.COMBINED.replace("2024-03-09", "03/09/2024"), "TokenError"),
    "combined-period": (X.COMBINED.replace("2024-03-01 to", "2024-02-31 to"), "ValueError"),
}
GOOD = {"checking": X.CHECKING, "savings": X.SAVINGS, "card": X.CARD, "brokerage": X.BROKERAGE,
        "fund": X.FUND, "combined": X.COMBINED,
        "chase": X.CHECKING.replace("STANDARD BANK", "CHASE BANK")}


def split_pages(text, name):
    """Several pages for some: cut after a label, inside a table, and with a blank page end."""
    if name != "savings":
        return [text]
    a = text.index("Interest Paid:") + len("Interest Paid:")
    b = text.index("2024-03-31 |")
    return [text[:a], " $1.25" + text[a + len(" $1.25"):b] + "\n  ", text[b:]]


@pytest.fixture(scope="module")
def outcome(spark):
    rows = []
    for name, text in {**GOOD, **{k: v[0] for k, v in BROKEN.items()}}.items():
        rows += [(name, i + 1, t) for i, t in enumerate(split_pages(text, name))]
    rows.append(("nobody", 1, "A letter about nothing."))
    rows.append(("two-claims", 1, "VANGUARD and CHARLES SCHWAB"))
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, page_text string")
    ledger, runs, failures = parse_and_check(pages)
    return {
        "runs": {r.run_id: r for r in runs.collect()},
        "failures": {r.doc_id: r for r in failures.collect()},
        "statements": ledger.statements.collect(),
        "accounts": {r.account_id: r for r in ledger.accounts.collect()},
        "transactions": ledger.transactions.collect(),
        "holdings": ledger.holdings.collect(),
        "pages": pages,
    }


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_first_failure(outcome, name):
    run = outcome["runs"][name]
    assert (run.status, run.error_code) == ("failed", BROKEN[name][1]), run


@pytest.mark.parametrize("name", sorted(GOOD))
def test_good_documents_pass(outcome, name):
    assert outcome["runs"][name].status == "canonical_persisted", outcome["failures"].get(name)


def test_unrouted_documents_get_no_run(outcome):
    assert not {"nobody", "two-claims"} & set(outcome["runs"])


def test_only_good_documents_are_kept(outcome):
    assert {s.run_id for s in outcome["statements"]} == set(GOOD)
    assert len(outcome["statements"]) == len(GOOD) + 1


def by_run(outcome, name):
    statements = [s for s in outcome["statements"] if s.run_id == name]
    ids = [s.statement_id for s in statements]
    lines = [t for t in outcome["transactions"] if t.statement_id in ids]
    return statements, sorted(lines, key=lambda t: (t.statement_id, t.line_no))


def test_checking_lines(outcome):
    (statement,), lines = by_run(outcome, "checking")
    assert (statement.opening_balance_cents, statement.closing_balance_cents) == (200000, 262550)
    assert [(t.line_no, t.amount_cents, t.transaction_category) for t in lines] == [
        (1, 75000, "deposit"), (2, -12000, "withdrawal"), (3, -800, "fee"),
        (4, 350, "interest_paid")]
    assert lines[1].post_date == dt.date(2024, 3, 9)


def test_institutions(outcome):
    names = {n: outcome["accounts"][by_run(outcome, n)[0][0].account_id].institution
             for n in ("checking", "chase", "combined")}
    assert names == {"checking": "Standard Bank", "chase": "Chase", "combined": "standard_bank"}


def test_text_across_pages(outcome):
    (statement,), lines = by_run(outcome, "savings")
    assert statement.closing_balance_cents == 90125
    assert [t.amount_cents for t in lines] == [125]


def test_holdings(outcome):
    rows = sorted((h.symbol, h.quantity_nanos, h.market_value_cents, h.as_of_date)
                  for h in outcome["holdings"])
    end = dt.date(2024, 3, 31)
    assert rows == [("ABC", 10 * 10**9, 120000, end), ("VTX", 3_250_000_000, 32500, end),
                    ("XYZ", 2_500_000_000, 80050, end)]


def test_combined_statements(outcome):
    statements, lines = by_run(outcome, "combined")
    assert sorted(s.closing_balance_cents for s in statements) == [90125, 262550]
    assert sorted(t.amount_cents for t in lines) == [-12000, -450, 125, 75000]


def test_strict_mode_raises(outcome):
    pages = outcome["pages"].filter("doc_id = 'one-cent'")
    with pytest.raises(StatementError, match="InvariantError"):
        parse_and_check(pages, strict=True)
