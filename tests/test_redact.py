from pyspark.sql import functions as F

from ledgerloom.functions.redact import redact_frame, redact_text, redaction_counts

TEXTS = {
    "SSN 123-45-6789": "SSN [REDACTED]",
    "two 111-22-3333, 444-55-6666": "two [REDACTED], [REDACTED]",
    "mail a.b@c.example.org now": "mail [REDACTED] now",
    "a@b.comx.y@d.org": "[REDACTED][REDACTED]",
    "call (555) 123-4567": "call ([REDACTED]",
    "or 555-1234": "or [REDACTED]",
    "acct 1234567890123456": "acct [REDACTED]",
    "short 123456789012345": "short 123456789012345",
    "at 12 Oak Hill Road today": "at [REDACTED] today",
    "12 a Street": "12 a Street",
    "7 Old Elm St and West Lane end": "[REDACTED] end",
    "balance: $1,234.50": "balance: [REDACTED_AMOUNT]",
    "total 12345": "total [REDACTED_AMOUNT]45",
    "8fee1234-5678-4abc-8def-0123456789ab": "8fee1234-5678-4abc-8def-0123456789ab",
    "": "",
}


def test_redact_text(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = rows.select("i", redact_text(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == list(TEXTS.values())


def test_long_unbroken_texts_stay_cheap(spark):
    """A number before 200,000 plain words, and a megabyte without a blank."""
    words = "12 " + "plain words " * 100_000 + "Road"
    blob = "x" * 1_000_000
    rows = spark.createDataFrame([(0, words), (1, blob)], "i int, t string")
    got = rows.select("i", redact_text(F.col("t")).alias("r")).orderBy("i").collect()
    assert got[0].r == "[REDACTED]"
    assert got[1].r == blob


def test_counts_follow_the_steps(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.pattern: r.occurrences for r in redaction_counts(rows, "t").collect()}
    assert got == {"SSN": 3, "EMAIL": 3, "PHONE_US": 2, "FULL_ACCOUNT": 1, "STREET_ADDRESS": 2,
                   "MONEY_FIELD": 2}


def test_nested(spark):
    row = spark.sql("""
      SELECT named_struct('run_id', '8fee 555-1234', 'amount_cents', 5L, 'amount', 1.5D,
        'description', 'SSN 123-45-6789', 'notes', array('a@b.org', 'ok'),
        'extra', map('fee', '9.00', 'memo', '555-1234', 'account_mask', '*12')) AS r,
      CAST(NULL AS STRING) AS page_text, 7 AS txn_count""")
    plain = redact_frame(row).first()
    assert plain.r.run_id == "8fee 555-1234"
    assert (plain.r.amount_cents, plain.r.amount) == (5, "[REDACTED_AMOUNT]")
    assert plain.r.description == "SSN [REDACTED]"
    assert plain.r.notes == ["[REDACTED]", "ok"]
    assert plain.r.extra == {"fee": "[REDACTED_AMOUNT]", "memo": "[REDACTED]",
                             "account_mask": "*12"}
    assert (plain.page_text, plain.txn_count) == (None, 7)
    scrubbed = redact_frame(row, scrub_row_pii=True).first()
    assert scrubbed.r.description == scrubbed.page_text == "[REDACTED]"
    assert scrubbed.r.extra["account_mask"] == "[REDACTED]"


def test_marks_leave_other_characters(spark):
    kept = "\ufdd0 a \ufdd1\ufdd0\ufdd2 b\ufdd0"
    rows = [(kept,), (kept + " 12 Long Main Street x \ufdd0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(redact_text(F.col("t"))).collect()]
    assert got[0] == kept and got[1].startswith(kept) and got[1].endswith(" x \ufdd0")
    assert "Main" not in got[1]
