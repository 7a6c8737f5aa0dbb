"""The contract as one fold and the earliest finding of each statement, held against plain forms."""

import random
from datetime import date, timedelta

import pytest

from ledgerloom import schemas as S
from ledgerloom.operators import reconcile as V
from ledgerloom.operators.outcome import first_failure
from ledgerloom.plans import derive as D
from ledgerloom.rules import BROKERAGE, CARD, DEPOSITORY, SIGN_RULES
from ledgerloom.schemas import LEDGER_SCHEMAS, Ledger

DAY = date(2024, 3, 1)


def _rows(schema, rows):
    names = schema.fieldNames()
    return [tuple(row.get(name) for name in names) for row in rows]


def _ledger(spark, **tables) -> Ledger:
    return Ledger(**{
        name: spark.createDataFrame(_rows(schema, tables.get(name, [])), schema)
        for name, schema in LEDGER_SCHEMAS.items()
    })


def _statement(key, domain=DEPOSITORY, **changes):
    return {
        "statement_id": key, "account_id": "a1", "account_domain": domain, "run_id": f"r-{key}",
        "raw_payload_id": "p1", "statement_start_date": DAY,
        "statement_end_date": DAY + timedelta(days=30), "opening_balance_cents": 100,
        "closing_balance_cents": 100, "net_change_cents": 0,
    } | changes


def _dep(key, **changes):
    return {"statement_id": key, "deposits_cents": 0, "withdrawals_cents": 0,
            "interest_paid_cents": 0, "fees_cents": 0} | changes


def _card(key, **changes):
    names = [n for n in S.CREDIT_SUMMARIES.fieldNames() if n.endswith("_cents")]
    return {"statement_id": key, "payment_due_date": DAY} | dict.fromkeys(names, 0) | {
        "previous_balance_cents": 100, "new_balance_cents": 100} | changes


def _line(key, statement, **changes):
    return {"transaction_id": key, "statement_id": statement, "line_no": 1, "post_date": DAY,
            "amount_cents": 5, "description": "x", "transaction_category": "deposit"} | changes


def _position(key, statement, **changes):
    return {"holding_id": key, "statement_id": statement, "as_of_date": DAY, "symbol": "S",
            "description": "d", "quantity_nanos": 1, "market_value_cents": 1} | changes


ACCOUNT = {"account_id": "a1", "institution": "i", "account_mask": "1",
           "account_domain": DEPOSITORY, "account_type": "checking", "currency": "USD"}


def _found(spark, ledger, runs):
    frame = spark.createDataFrame(runs, "run_id string, raw_payload_id string")
    rows = V.check_persistence_contract(ledger, frame).collect()
    assert {r.code for r in rows} <= {S.PERSISTENCE}
    return sorted((r.table, r.key, r.rule) for r in rows)


def test_contract_of_good_and_empty_tables(spark):
    good = _ledger(spark, accounts=[ACCOUNT], statements=[_statement("s1")],
                   depository_summaries=[_dep("s1")],
                   transactions=[_line("t1", "s1"), _line("t2", "s1")])
    assert _found(spark, good, [("r-s1", "p1")]) == []
    assert _found(spark, _ledger(spark), []) == []


def test_contract_names_every_broken_rule(spark):
    statements = [
        _statement("s1"),                                      # no sidecar
        _statement("s2", account_id="a9"),                     # unknown account
        _statement("s3", account_id=None, run_id=None),        # null references
        _statement("s4", raw_payload_id="p2"),                 # payload of another run
        _statement("s5", closing_balance_cents=101),           # net change
        _statement("s6", CARD),                                # two card rows, one differs
        _statement("s7", statement_end_date=DAY - timedelta(days=1)),
        _statement("s8", "barter"),                            # unknown domain
        _statement("s9", BROKERAGE), _statement("s9", BROKERAGE, run_id="r-other"),
    ]
    ledger = _ledger(
        spark, statements=statements,
        accounts=[ACCOUNT, ACCOUNT | {"account_id": "a2", "currency": "EUR"}],
        depository_summaries=[_dep(f"s{i}") for i in (2, 3, 4, 5, 7)]
        + [_dep("s6"), _dep("none", fees_cents=-1)],
        credit_summaries=[_card("s6"), _card("s6", new_balance_cents=99, payment_due_date=None)],
        brokerage_summaries=[{"statement_id": "s9", "opening_cash_cents": 100,
                              "closing_cash_cents": 100, "opening_portfolio_cents": 1}],
        transactions=[_line("t1", "none"), _line("t2", None), _line("t3", "s2", amount_cents=0),
                      _line("t3", "s2", description=""),
                      _line("t4", "s2", transaction_category="gift")],
        holdings=[_position("h1", "s2"), _position("h2", "none", quantity_nanos=0),
                  _position("h3", "s9", symbol="", description="")],
    )
    runs = [(f"r-s{i}", "p1") for i in (1, 2, 4, 5, 6, 7, 8, 9)] + [("r-other", "p1")]
    assert _found(spark, ledger, runs) == sorted([
        ("statements", "s1", "own_sidecar_missing"),
        ("statements", "s2", "account_id_unknown"),
        ("statements", "s2", "holdings_outside_brokerage"),
        ("statements", "s3", "account_id_unknown"),
        ("statements", "s3", "run_unknown"),
        ("statements", "s4", "payload_differs_from_run"),
        ("statements", "s5", "net_change"),
        ("statements", "s6", "card_balances_differ"),
        ("statements", "s6", "due_date_missing"),
        ("statements", "s6", "foreign_sidecar"),
        ("credit_summaries", "s6", "duplicate_statement_id"),
        ("statements", "s7", "period_inverted"),
        ("statements", "s8", "own_sidecar_missing"),
        ("statements", "s9", "duplicate_statement_id"),
        ("statements", "s9", "half_portfolio"),
        ("depository_summaries", "none", "statement_id_unknown"),
        ("transactions", "t1", "statement_id_unknown"),
        ("transactions", "t2", "statement_id_unknown"),
        ("transactions", "t3", "amount_zero"),
        ("transactions", "t3", "description_empty"),
        ("transactions", "t3", "duplicate_transaction_id"),
        ("transactions", "t4", "category_unknown"),
        ("holdings", "h2", "statement_id_unknown"),
        ("holdings", "h2", "quantity_zero"),
        ("holdings", "h3", "symbol_empty"),
        ("holdings", "h3", "description_empty"),
        ("accounts", "i|1|checking", "duplicate_institution_account_mask_account_type"),
        ("accounts", "a2", "currency"),
    ])


def _scans(frame, spark):
    """How often each file of a folder is opened in the optimised plan."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_each_line_is_read_once(spark, sf_dir, tmp_path):
    ledger = D.derive_ledger(spark, sf_dir)
    stored = {}
    for name, frame in ledger.tables().items():
        frame.limit(50).write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    # Statements are read beside their lines and beside their sums; every other table once.
    assert _scans(V.first_findings(Ledger(**stored)), spark) == 6
    runs = stored["statements"].select("run_id", "raw_payload_id")
    assert _scans(V._broken_keys(Ledger(**stored), runs), spark) == 8


@pytest.mark.parametrize("per_chunk", [1, 3, 1 << 16])
def test_first_findings_are_the_first_of_all(spark, monkeypatch, per_chunk):
    monkeypatch.setattr(V, "LINES_PER_CHUNK", per_chunk)
    dice = random.Random(7 + per_chunk)
    statements, lines, deps, cards = [], [], [], []
    for i in range(150):
        key, domain = f"s{i:03}", dice.choice([DEPOSITORY, CARD, BROKERAGE])
        opening = balance = dice.randrange(-500, 500)
        printed = dice.choice(["all", "none", "some"])
        for number in range(dice.randrange(0, 9)):
            category = dice.choice(sorted(SIGN_RULES[domain]))
            amount = (SIGN_RULES[domain][category] or 1) * dice.randrange(1, 90)
            if dice.random() < 0.05:
                amount = dice.choice([0, -amount])
            balance += amount
            shown = balance + (dice.random() < 0.08)
            if printed == "none" or (printed == "some" and dice.random() < 0.2):
                shown = None
            lines.append(_line(
                f"{key}-{number}", key, line_no=number + 1, amount_cents=amount,
                transaction_category=category, balance_after_cents=shown,
                post_date=DAY + timedelta(days=40 * (dice.random() < 0.05)),
            ))
        closing = balance + (dice.random() < 0.1)
        statements.append(_statement(
            key, domain, opening_balance_cents=None if dice.random() < 0.03 else opening,
            closing_balance_cents=closing,
            net_change_cents=closing - opening + (dice.random() < 0.1)))
        if domain == DEPOSITORY and dice.random() < 0.5:
            deps.append(_dep(key, deposits_cents=closing - opening))
        if domain == CARD and dice.random() < 0.5:
            cards.append(_card(key, previous_balance_cents=opening, new_balance_cents=closing))
    lines.append(_line("stray", "none", amount_cents=0))
    ledger = _ledger(spark, statements=statements, transactions=lines,
                     depository_summaries=deps, credit_summaries=cards)
    for lenient in (False, True):
        every = V.reconcile(ledger, lenient)
        wanted = {tuple(r) for r in first_failure(every, "statement_id").collect()}
        first = V.first_findings(ledger, lenient).select(
            "statement_id", "stage", "seq", "code", "message"
        ).collect()
        assert len(first) == len(wanted) > 50
        assert {tuple(r) for r in first} == wanted
    stages = {r.stage for r in V.first_findings(ledger).collect()}
    assert {V.NET, V.IDENTITY, V.RUNNING, V.LINES} <= stages
