"""Redaction of personal data in text columns and in nested frames."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.tokens import WS

MASK = "[REDACTED]"
AMOUNT_MASK = "[REDACTED_AMOUNT]"

# Names that decide a whole field.
ROW_PII_NAMES = (
    "account_mask", "content_sha256", "description", "original_basename", "page_text",
)
ID_NAMES = (
    "account_id", "document_id", "holding_id", "raw_payload_id", "run_id", "statement_id",
    "transaction_id",
)
MONEY_NAME = r"(?i)(?:^|_)(?:amount|balance|payment|charge|fee)(?:$|_)"
UUID_TEXT = (
    r"(?:urn:uuid:)?\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}"
    r"-?[0-9a-fA-F]{12}\}?"
)
STREET_WORDS = (
    "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Way|Court|Ct"
)
MONEY_WORDS = "amount|balance|payment|charge|fee|total"

# What each pattern finds, in the order of PATTERN_NAMES.
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
# An address starts where its run of local-part characters starts, or where the last match
# ended. Saying so keeps long unbroken runs linear.
_LOCAL = "a-zA-Z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}"
_PHONE = r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?\d{4}\b"
_ACCOUNT = r"\b\d{16,}+\b"
# A street is a number, words of two or more letters, and a street word. One-letter words get
# a stop mark first, so that the words can be one character class: a repeated group recurses
# once per word and overflows the stack on long prose.
_STOP = "\ufdd0"
_OWN, _MARK = "\ufdd1", "\ufdd2"
_LONE_LETTER = r"(?i)(?<=\s)[a-z](?=\s)"
_STREET = rf"(?i)\b\d{{1,5}}\s+[a-z][a-z\s]*\s(?:{STREET_WORDS})\b"
_MONEY = (
    rf"(?i)(\b(?:{MONEY_WORDS})\b\s*[:=]?\s*)(?:\$)?"
    r"(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)"
)

PATTERN_NAMES = ("SSN", "EMAIL", "PHONE_US", "FULL_ACCOUNT", "STREET_ADDRESS", "MONEY_FIELD")


def _steps(text: Column) -> Iterator[tuple[str, Column, str, Column]]:
    """(name, text before, pattern, text after), each step fed by the one before."""
    for name, pattern in zip(PATTERN_NAMES[:4], (_SSN, _EMAIL, _PHONE, _ACCOUNT), strict=True):
        after = F.regexp_replace(text, pattern, MASK)
        yield name, text, pattern, after
        text = after
    # A text's own stops are told apart from the marks, and stay.
    hidden = F.replace(text, F.lit(_STOP), F.lit(_STOP + _OWN))
    marked = F.regexp_replace(hidden, _LONE_LETTER, "$0" + _STOP + _MARK)
    after = F.regexp_replace(marked, _STREET, MASK)
    after = F.replace(after, F.lit(_STOP + _MARK), F.lit(""))
    after = F.replace(after, F.lit(_STOP + _OWN), F.lit(_STOP))
    yield "STREET_ADDRESS", marked, _STREET, after
    yield "MONEY_FIELD", after, _MONEY, F.regexp_replace(after, _MONEY, "$1" + AMOUNT_MASK)


def is_uuid_text(col: Column) -> Column:
    return col.rlike(rf"^[{WS}]*{UUID_TEXT}[{WS}]*\z")


def redact_text(col: Column) -> Column:
    """Replace every known pattern; a value that is wholly a UUID passes."""
    after = col
    for _, _, _, after in _steps(col):
        pass
    return F.when(is_uuid_text(col), col).otherwise(after)


def redaction_counts(df: DataFrame, column: str) -> DataFrame:
    """Occurrences per pattern over all rows, each counted as its step runs."""
    text = F.when(~is_uuid_text(F.col(column)), F.col(column))
    hits = [
        F.regexp_count(before, F.lit(pattern)).alias(name)
        for name, before, pattern, _ in _steps(text)
    ]
    totals = df.select(*hits).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in PATTERN_NAMES]
    )
    return totals.unpivot([], list(PATTERN_NAMES), "pattern", "occurrences")


def _is_money_name(name: Column) -> Column:
    return name.rlike(MONEY_NAME) & ~F.lower(name).endswith("_cents")


def _money_name(name: str) -> bool:
    return not name.lower().endswith("_cents") and re.search(MONEY_NAME, name) is not None


def _redact_value(value: Column, kind: T.DataType, name: str | None, scrub: bool) -> Column:
    lowered = name.lower() if name else None
    if scrub and lowered in ROW_PII_NAMES:
        return F.lit(MASK)
    if lowered in ID_NAMES:
        return value
    if name and _money_name(name) and isinstance(kind, (T.StringType, T.FloatType, T.DoubleType)):
        return F.when(value.isNotNull(), F.lit(AMOUNT_MASK))
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.StructType):
        fields = [
            _redact_value(value.getField(f.name), f.dataType, f.name, scrub).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _redact_value(item, kind.elementType, None, scrub))
    if isinstance(kind, T.MapType):
        return _redact_map(value, kind, scrub)
    return value


def _redact_map(value: Column, kind: T.MapType, scrub: bool) -> Column:
    """Map entries follow the name rules through their keys, row by row."""
    inner = kind.valueType
    if not isinstance(inner, (T.StringType, T.FloatType, T.DoubleType)):
        # A value that cannot hold the mask keeps its type; its own nested names still apply.
        return F.transform_values(value, lambda _k, v: _redact_value(v, inner, None, scrub))

    def entry(key: Column, item: Column) -> Column:
        text = item.cast("string")
        plain = redact_text(text) if isinstance(inner, T.StringType) else text
        out = F.when(F.lower(key).isin(*ID_NAMES), text).when(
            _is_money_name(key) & item.isNotNull(), F.lit(AMOUNT_MASK)
        ).otherwise(plain)
        if not scrub:
            return out
        return F.when(F.lower(key).isin(*ROW_PII_NAMES), F.lit(MASK)).otherwise(out)

    return F.transform_values(value, entry)


def redact_frame(df: DataFrame, scrub_row_pii: bool = False) -> DataFrame:
    """Redact every column by its name and type, through structs, arrays and maps."""
    return df.select(
        *[
            _redact_value(F.col(f"`{f.name}`"), f.dataType, f.name, scrub_row_pii).alias(f.name)
            for f in df.schema.fields
        ]
    )
