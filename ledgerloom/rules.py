"""Closed rule sets: account types and required amount sign per (domain, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPOSITORY = "depository"
CARD = "revolving_credit"
BROKERAGE = "custodial_brokerage"

# Which account types a domain owns.
DOMAIN_TYPES = {
    DEPOSITORY: ("checking", "savings"),
    CARD: ("credit_card",),
    BROKERAGE: ("brokerage_cash", "brokerage_margin"),
}

# Sign an amount must carry, by domain and category; 0 means either sign.
SIGN_RULES = {
    DEPOSITORY: {
        "deposit": 1, "withdrawal": -1, "interest_paid": 1, "fee": -1,
        "fee_reversal": 1, "other_credit": 1, "other_debit": -1,
    },
    CARD: {
        "purchase": 1, "payment": -1, "credit": -1, "cash_advance": 1,
        "balance_transfer": 1, "fee": 1, "interest_charged": 1, "fee_reversal": -1,
    },
    BROKERAGE: {
        "dividend": 1, "interest": 1, "transfer_in": 1, "transfer_out": -1,
        "fee": -1, "trade_cash": 0, "other_credit": 1, "other_debit": -1,
    },
}

CATEGORIES = tuple(sorted({c for cats in SIGN_RULES.values() for c in cats}))


def sign_rules(spark: SparkSession) -> DataFrame:
    """The 23 (domain, category, required_sign) rows; a local relation, so joins broadcast it."""
    rows = ", ".join(
        f"('{domain}', '{category}', {sign})"
        for domain, cats in SIGN_RULES.items()
        for category, sign in cats.items()
    )
    return spark.sql(
        f"SELECT * FROM VALUES {rows} AS t(account_domain, transaction_category, required_sign)"
    )


def domain_types(spark: SparkSession) -> DataFrame:
    rows = ", ".join(
        f"('{domain}', '{kind}')" for domain, kinds in DOMAIN_TYPES.items() for kind in kinds
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(account_domain, account_type)")


def required_sign(domain: Column, category: Column) -> Column:
    """+1, -1 or 0 (either); NULL when the category does not belong to the domain."""
    out = None
    for name, cats in SIGN_RULES.items():
        for sign in (1, -1, 0):
            members = [c for c, s in cats.items() if s == sign]
            if not members:
                continue
            hit = (domain == F.lit(name)) & category.isin(*members)
            out = F.when(hit, F.lit(sign)) if out is None else out.when(hit, F.lit(sign))
    return out


def domain_of_type(account_type: Column) -> Column:
    """The only domain that owns an account type; NULL for an unknown type."""
    out = None
    for name, kinds in DOMAIN_TYPES.items():
        hit = account_type.isin(*kinds)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def sign_violation(domain: Column, category: Column, amount: Column) -> Column:
    """Error code of one line's sign, in check order, or NULL when it agrees."""
    sign = required_sign(domain, category)
    return (
        F.when(amount == 0, F.lit("ValueError"))
        .when((sign == 1) & (amount < 0), F.lit("TokenError"))
        .when((sign == -1) & (amount > 0), F.lit("TokenError"))
    )
