import pytest
from pyspark.sql import functions as F

from ledgerloom import rules
from ledgerloom.functions import categorize as C


def test_sign_table(spark):
    rows = rules.sign_rules(spark).collect()
    assert len(rows) == 23
    assert len({r.transaction_category for r in rows}) == 18
    either = [r for r in rows if r.required_sign == 0]
    assert [(r.account_domain, r.transaction_category) for r in either] == [
        (rules.BROKERAGE, "trade_cash")]


def test_sign_violation(spark):
    cases = [
        ("depository", "fee", -1, None), ("depository", "fee", 1, "TokenError"),
        ("revolving_credit", "fee", 1, None), ("revolving_credit", "fee", -1, "TokenError"),
        ("custodial_brokerage", "trade_cash", -1, None), ("depository", "deposit", 0, "ValueError"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "d string, c string, a bigint")
    got = rows.select(rules.sign_violation(F.col("d"), F.col("c"), F.col("a")).alias("v")).collect()
    assert [r.v for r in got] == [c[3] for c in cases]


def test_type_domains(spark):
    rows = spark.createDataFrame([("savings",), ("brokerage_margin",), ("loan",)], "t string")
    got = [r.v for r in rows.select(rules.domain_of_type(F.col("t")).alias("v")).collect()]
    assert got == ["depository", "custodial_brokerage", None]
    assert rules.domain_types(spark).count() == 5


@pytest.mark.parametrize(("text", "category"), [
    ("COFFEE bar", "fee"), ("Fee Refund", "fee_reversal"), ("deposit fee", "deposit"),
    ("Check 12", "withdrawal"), ("Gift", "other_debit"),
])
def test_depository_words(spark, text, category):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(C.categorize_depository(F.col("t"))).first()[0] == category


@pytest.mark.parametrize(("text", "category"), [
    ("COFFEE bar", "purchase"), ("Fee Refund", "credit"), ("Fee Reversal", "fee_reversal"),
    ("Annual membership", "fee"), ("Repayments", "purchase"), ("balance transfer fee",
                                                                "balance_transfer"),
])
def test_card_words(spark, text, category):
    row = spark.createDataFrame([(text,)], "t string")
    assert row.select(C.categorize_card(F.col("t"))).first()[0] == category


def test_brokerage_words(spark):
    rows = spark.createDataFrame(
        [("Div payout", "+1"), ("Sale of ABC", "+1"), ("Gift", "+1"), ("Gift", "-1"),
         ("Credit adjustment", "-1")], "t string, a string")
    got = rows.select(C.categorize_brokerage(F.col("t"), F.col("a")).alias("s"),
                      C.categorize_vanguard(F.col("t"), F.col("a")).alias("v")).collect()
    assert [r.s for r in got] == ["dividend", "trade_cash", "other_credit", "other_debit",
                                  "other_credit"]
    assert [r.v for r in got] == ["other_credit", "other_credit", "other_credit", "other_debit",
                                  "other_debit"]
