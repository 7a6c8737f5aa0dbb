import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tokens as P


def read(spark, parse, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", parse(F.col("t")).alias("v")).orderBy("i").collect()]


CENTS = {
    "12.34": 1234, "$1,234.50": 123450, "(5.00)": -500, "(-5.00)": -500, "-$5.00": -500,
    "$-5.00": -500, "-$-5.00": -500, "+$12.00": 1200, "--1.00": -100, "$ 7.00": 700,
    "1,2,3.00": 12300, "12.3,4": 1234, "  $9.99\t": 999, "( $ 3.10 )": -310, "0.00": None,
    "12": None, "12.3": None, "12.345": None, ".50": None, "$": None, "(12.34": None,
    "12.34.56": None, "": None, "abc": None, None: None, "99999999999999999999.00": None,
}


def test_cents(spark):
    assert read(spark, P.cents, CENTS) == list(CENTS.values())


def test_cents_zero_allowed(spark):
    assert read(spark, lambda c: P.cents(c, allow_zero=True), ["0.00", "-$0.00", "x"]) == [0, 0, None]


def test_quantity_nanos(spark):
    unit = 10**9
    cases = {
        "10": 10 * unit, "2.5": 2_500_000_000, "0.000000001": 1, "-3": -3 * unit,
        "(3)": -3 * unit, "+1": unit, " 4 ": 4 * unit, "0": None, "0.0": None, " ": None,
        "1,000": None, "5.": None, "1.0123456789": None, "--5": None, "$5": None, None: None,
    }
    assert read(spark, P.quantity_nanos, cases) == list(cases.values())


def test_usd_form(spark):
    cases = {"50": 5000, "$50": 5000, "$1,245.00": 124500, "12.3": None, "12.345": None,
             "0": None, "-5": None, "(5.00)": None, "": None}
    assert read(spark, P.usd_form_cents, cases) == list(cases.values())


def test_legacy_cents(spark):
    cases = {"100": 10000, "1.5": 150, "(2.50)": 250, "-$3.00": 300, "$ 4": 400, "1,000.25": 100025,
             "0.00": None, "1.234": None, "1.2.3": None, "x": None, "5.": None, "": None}
    assert read(spark, P.legacy_cents, cases) == list(cases.values())


@pytest.mark.parametrize("parse", [P.statement_date])
def test_statement_date(spark, parse):
    june = dt.date(1995, 6, 1)
    cases = {
        "1995-06-01": june, "1995-6-1": june, "6/1/1995": june, "06/01/95": june,
        "1/5/70": dt.date(1970, 1, 5), "1/5/68": dt.date(2068, 1, 5),
        "1/5/69": dt.date(1969, 1, 5), "2/30/2000": None, "1/5/025": None, "June 1": None,
        "19950601": None, "0000-01-01": None, "": None,
    }
    assert read(spark, parse, cases) == list(cases.values())


def test_iso_date(spark):
    cases = {"1995-06-01": dt.date(1995, 6, 1), "19950601": dt.date(1995, 6, 1),
             "1995-6-1": None, "06/01/1995": None, "1995-02-30": None}
    assert read(spark, P.iso_date, cases) == list(cases.values())


def test_sign_and_columns(spark):
    assert read(spark, P.has_explicit_sign, ["+1", "-1", "(1)", "1", "(1"]) == [
        True, True, True, False, False]
    assert read(spark, P.split_wide, ["a b  c\td | e", " | ", "x"]) == [
        ["a b", "c", "d", "e"], [], ["x"]]
    assert read(spark, P.split_pipe, [" a | b||c "]) == [["a", "b", "", "c"]]
