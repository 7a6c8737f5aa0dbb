"""Token parsers as column expressions. NULL means the token was refused (a ``TokenError``).

Each parser reads its input column as few times as it can, because Catalyst repeats the input
expression at every mention inside a CASE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schemas import TOKEN

# Every character a text trim removes: ASCII blanks, separators and Unicode spaces.
WS = r"\s\x1c-\x1f\x85\p{Z}"
_SP = f"[{WS}]*"
_SIGNED = rf"(?:[+-]{_SP})?"
_MONEY_BODY = rf"{_SIGNED}(?:\${_SP})?{_SIGNED},*\d[\d,]*\.,*\d,*\d,*"
_MONEY = rf"{_SP}(?:\({_SP}{_MONEY_BODY}{_SP}\)|{_MONEY_BODY}){_SP}\z"
_SHARES_BODY = rf"{_SIGNED}\d+(?:\.\d{{1,9}})?"
_SHARES = rf"{_SP}(?:\({_SP}{_SHARES_BODY}{_SP}\)|{_SHARES_BODY}){_SP}\z"
_LEGACY_BODY = rf"[$-]*[{WS},]*\d[\d,]*(?:\.,*\d,*(?:\d,*)?)?[{WS},]*"
_LEGACY = rf"{_SP}(?:\({_SP}{_LEGACY_BODY}{_SP}\)|{_LEGACY_BODY})\z"
_NOT_ZERO = "(?=[^1-9]*[1-9])"
_NEGATIVE = rf"^{_SP}\(|-"
_WIDE_GAP = rf"[{WS}|]*(?:[{WS}]{{2,}}|\t|\|)[{WS}|]*"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{WS}]+|[{WS}]+\z", "")


def with_error(df, value: str, error: str = "error"):
    """Add the error code of a parsed column: ``TokenError`` where the value is NULL."""
    return df.withColumn(error, F.when(F.col(value).isNull(), F.lit(TOKEN)))


def _sign(col: Column) -> Column:
    return F.when(col.rlike(_NEGATIVE), F.lit(-1)).otherwise(F.lit(1))


def _scaled(col: Column, decimals: int) -> Column:
    """Digits and point of a number as one integer with a fixed count of decimals."""
    plain = F.regexp_replace(F.regexp_replace(col, r"[^0-9.]", ""), r"^(\d+)\z", "$1.")
    padded = F.concat(plain, F.lit("0" * decimals))
    digits = F.regexp_replace(padded, rf"^(\d+)\.(\d{{{decimals}}}).*\z", "$1$2")
    return digits.try_cast("bigint")


def cents(col: Column, allow_zero: bool = False) -> Column:
    """Strict two-decimal USD text to signed cents."""
    valid = "^" + ("" if allow_zero else _NOT_ZERO) + _MONEY
    size = F.regexp_replace(col, r"[^0-9]", "").try_cast("bigint")
    return F.when(col.rlike(valid), size * _sign(col))


def quantity_nanos(col: Column) -> Column:
    """Printed share count to integer nanos, at most nine decimals, never zero."""
    return F.when(col.rlike("^" + _NOT_ZERO + _SHARES), _scaled(col, 9) * _sign(col))


def usd_form_cents(col: Column) -> Column:
    """Typed amount: cents part optional, result must be positive."""
    full = F.regexp_replace(strip(col), r"^([^.]*)\z", "$1.00")
    return F.when(~col.rlike(_NEGATIVE), cents(full))


def legacy_cents(col: Column) -> Column:
    """Lenient positive magnitude: zero, one or two decimals, sign and brackets ignored."""
    return F.when(col.rlike("^" + _NOT_ZERO + _LEGACY), _scaled(col, 2))


def statement_date(col: Column) -> Column:
    """ISO or month-first date; two-digit years 69-99 are 19xx, 00-68 are 20xx. NULL if bad."""
    month_day = r"^(\d{1,2})/(?: (?=\d/))?(\d{1,2})/"
    iso = F.regexp_replace(col, month_day + r"(\d{4})\z", "$3-$1-$2")
    iso = F.regexp_replace(iso, month_day + r"(69|[7-9]\d)\z", "19$3-$1-$2")
    iso = F.regexp_replace(iso, month_day + r"(\d{2})\z", "20$3-$1-$2")
    iso = F.regexp_replace(iso, r"-(?: (?=\d\z))(\d)\z", "-$1")
    return F.regexp_extract(iso, r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}\z", 0).try_cast("date")


def us_date(col: Column) -> Column:
    """Month-first date only (legacy tables)."""
    return F.when(col.contains("/"), statement_date(col))


def iso_date(col: Column) -> Column:
    """Calendar date as YYYY-MM-DD or YYYYMMDD, else NULL."""
    iso = F.regexp_replace(col, r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")
    return F.regexp_extract(iso, r"^(?!0000)\d{4}-\d{2}-\d{2}\z", 0).try_cast("date")


def has_explicit_sign(col: Column) -> Column:
    return (
        col.startswith("+")
        | col.startswith("-")
        | (col.startswith("(") & col.endswith(")"))
    )


def split_wide(col: Column) -> Column:
    """Columns set apart by two or more blanks, a tab or a bar; empty cells vanish."""
    body = F.regexp_replace(col, rf"^[{WS}|]+|[{WS}|]+\z", "")
    return F.array_remove(F.split(body, _WIDE_GAP), F.lit(""))


def split_pipe(col: Column) -> Column:
    """Bar-separated columns, trimmed, empty cells kept."""
    return F.split(strip(col), rf"{_SP}\|{_SP}")
