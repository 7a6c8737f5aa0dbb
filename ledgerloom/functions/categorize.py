"""Description to category, one first-match chain per statement layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First matching word list wins, in this order. Plain substrings.
DEPOSITORY_WORDS = [
    (("DEPOSIT", "PAYROLL"), "deposit"),
    (("INTEREST",), "interest_paid"),
    (("FEE REFUND", "REVERSAL"), "fee_reversal"),
    (("FEE",), "fee"),
    (("WITHDRAWAL", "ATM", "CHECK", "PURCHASE"), "withdrawal"),
]
BROKERAGE_WORDS = [
    (("DIVIDEND", "DIV "), "dividend"),
    (("INTEREST",), "interest"),
    (("DEPOSIT", "WIRE IN", "TRANSFER IN"), "transfer_in"),
    (("WITHDRAWAL", "WIRE OUT", "TRANSFER OUT"), "transfer_out"),
    (("FEE",), "fee"),
    (("BOUGHT", "PURCHASE", "BUY", "SOLD", "SALE", "SELL"), "trade_cash"),
    (("CREDIT",), "other_credit"),
]
FUND_WORDS = [
    (("DIVIDEND",), "dividend"),
    (("FEE",), "fee"),
    (("TRANSFER IN", "DEPOSIT"), "transfer_in"),
    (("TRANSFER OUT", "WITHDRAWAL"), "transfer_out"),
    (("BUY", "SELL"), "trade_cash"),
]
COMBINED_WORDS = [
    (("FEE REVERSAL",), "fee_reversal"),
    (("FEE",), "fee"),
    (("INTEREST",), "interest_paid"),
]
# Whole words on card statements, in this order.
CARD_WORDS = [
    (("PAYMENT",), "payment"),
    (("REFUND", "RETURN"), "credit"),
    (("FEE REFUND", "FEE REVERSAL", "WAIVER"), "fee_reversal"),
    (("CASH ADVANCE",), "cash_advance"),
    (("BALANCE TRANSFER",), "balance_transfer"),
    (("INTEREST",), "interest_charged"),
    (("FEE", "LATE", "ANNUAL"), "fee"),
]


def _first_match(text: Column, chain, otherwise: Column, whole_words: bool = False) -> Column:
    out = F
    for words, category in chain:
        pattern = "|".join(words)
        if whole_words:
            hit = text.rlike(rf"\b(?:{pattern})\b")
        elif len(words) == 1:
            hit = text.contains(words[0])
        else:
            hit = text.rlike(pattern)
        out = out.when(hit, F.lit(category))
    return out.otherwise(otherwise)


def _by_printed_plus(amount_text: Column) -> Column:
    return F.when(amount_text.startswith("+"), F.lit("other_credit")).otherwise(
        F.lit("other_debit")
    )


def categorize_depository(description: Column) -> Column:
    return _first_match(F.upper(description), DEPOSITORY_WORDS, F.lit("other_debit"))


def categorize_card(description: Column) -> Column:
    return _first_match(F.upper(description), CARD_WORDS, F.lit("purchase"), whole_words=True)


def categorize_brokerage(description: Column, amount_text: Column) -> Column:
    return _first_match(F.upper(description), BROKERAGE_WORDS, _by_printed_plus(amount_text))


def categorize_vanguard(description: Column, amount_text: Column) -> Column:
    return _first_match(F.upper(description), FUND_WORDS, _by_printed_plus(amount_text))


def categorize_combined(description: Column, amount_cents: Column) -> Column:
    by_sign = F.when(amount_cents > 0, F.lit("deposit")).otherwise(F.lit("withdrawal"))
    return _first_match(F.upper(description), COMBINED_WORDS, by_sign)
