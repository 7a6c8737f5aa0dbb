"""The older table form of brokerage statements: extracted cells in, unsigned lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import tokens as P
from ledgerloom.operators.running import running_totals
from ledgerloom.schemas import INVARIANT, SCHEMA_DRIFT, TOKEN, VALUE

_ROWS_PER_CHUNK = 1 << 16


def legacy_table_rows(rows: DataFrame, periods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines of every document in date order, violations).

    ``rows`` is (doc_id, table_index, row_index, cells array<string>), row 0 being the header;
    ``periods`` is (doc_id, period_start, period_end). Tables without the three needed columns
    are not transaction tables and are passed over.
    """
    c = F.col
    names = F.transform(F.filter("cells", lambda x: F.length(x) > 0),
                        lambda x: F.lower(P.strip(x)))
    header = rows.filter(c("row_index") == 0).select(
        "doc_id", "table_index",
        *[F.array_position(names, name).cast("int").alias(f"{name}_at")
          for name in ("date", "description", "amount", "category")],
    ).filter((c("date_at") > 0) & (c("description_at") > 0) & (c("amount_at") > 0))

    def cell(name: str):
        at = c(f"{name}_at")
        text = F.get("cells", at - 1)
        return F.when(at > 0, P.strip(F.coalesce(text, F.lit(""))))

    filled = F.exists("cells", lambda x: F.coalesce(P.strip(x), F.lit("None")) != "")
    body = rows.filter((c("row_index") > 0) & filled).join(header, ["doc_id", "table_index"])
    body = body.join(periods, "doc_id").select(
        "doc_id", "table_index", "row_index", "period_start", "period_end",
        (F.size("cells") <= F.greatest("date_at", "description_at", "amount_at") - 1)
        .alias("short"),
        cell("date").alias("date_text"), cell("description").alias("description"),
        cell("amount").alias("amount_text"), F.nullif(cell("category"), F.lit("")).alias("category"),
    )
    note = (c("date_text") == "") & (c("amount_text") == "") & (c("description") != "")
    body = body.filter(c("short") | ~note).withColumns({
        "post_date": P.us_date(c("date_text")),
        "amount_cents": P.legacy_cents(c("amount_text")),
    })
    outside = ~c("post_date").between(c("period_start"), c("period_end"))
    code = (
        F.when(c("short"), SCHEMA_DRIFT)
        .when(c("post_date").isNull(), TOKEN)
        .when(outside, INVARIANT)
        .when(c("amount_cents").isNull(), TOKEN)
        .when(c("description") == "", "ValidationError")
    )
    body = body.withColumn("code", code)
    order = (c("table_index").cast("bigint") * (1 << 32) + c("row_index")).alias("seq")
    violations = body.filter(c("code").isNotNull()).select("doc_id", order, "code")
    debit = c("amount_text").startswith("-") | c("amount_text").startswith("(")
    good = body.filter(c("code").isNull()).select(
        "doc_id", order, "post_date", "description",
        F.when(debit, F.lit("debit")).otherwise(F.lit("credit")).alias("transaction_type"),
        "amount_cents", "category",
    )
    numbered = running_totals(good, ["doc_id"], "post_date", ["seq"], {"line_no": F.lit(1)})
    return numbered.drop("seq"), violations


def check_date_continuity(lines: DataFrame, periods: DataFrame) -> DataFrame:
    """First broken date rule per document: inverted period, date outside, date going back.

    Lines are compared inside slices of their order; only a slice's edge dates are compared
    across slices, so one huge document does not gather in a task.
    """
    c = F.col
    sliced = lines.join(periods, "doc_id").withColumn(
        "_slice", F.floor(c("line_no") / _ROWS_PER_CHUNK)
    )
    inside = W.partitionBy("doc_id", "_slice").orderBy("line_no")
    edges = sliced.groupBy("doc_id", "_slice").agg(
        F.max_by("post_date", "line_no").alias("_edge")
    )
    carried = edges.select(
        "doc_id", "_slice",
        F.lag("_edge").over(W.partitionBy("doc_id").orderBy("_slice")).alias("_edge"),
    )
    seen = sliced.withColumn("_prior", F.lag("post_date").over(inside)).join(
        carried, ["doc_id", "_slice"], "left"
    ).withColumn("_prior", F.coalesce("_prior", "_edge"))
    outside = ~c("post_date").between(c("period_start"), c("period_end"))
    back = c("post_date") < c("_prior")
    bad = seen.filter(outside | F.coalesce(back, F.lit(False))).select(
        "doc_id", c("line_no").alias("seq"),
        F.when(outside, "date_outside_period").otherwise("dates_not_ascending").alias("rule"),
    )
    inverted = periods.filter(c("period_start") > c("period_end")).select(
        "doc_id", F.lit(0).cast("bigint").alias("seq"), F.lit("period_inverted").alias("rule")
    )
    return bad.unionByName(inverted).groupBy("doc_id").agg(
        F.min(F.struct("seq", "rule")).alias("f")
    ).select("doc_id", "f.seq", "f.rule", F.lit(VALUE).alias("code"))


def check_cash_balance(lines: DataFrame, balances: DataFrame) -> DataFrame:
    """Documents whose start balance and lines do not give the end balance, with the gap.

    ``balances`` is (doc_id, start_balance_cents, end_balance_cents).
    """
    signed = F.when(F.col("transaction_type") == "credit", F.col("amount_cents")).otherwise(
        -F.col("amount_cents")
    )
    sums = lines.groupBy("doc_id").agg(F.sum(signed).alias("_net"))
    computed = F.col("start_balance_cents") + F.coalesce("_net", F.lit(0))
    return (
        balances.join(sums, "doc_id", "left")
        .withColumn("difference_cents", (computed - F.col("end_balance_cents")).cast("bigint"))
        .filter(F.col("difference_cents") != 0)
        .select("doc_id", "difference_cents", F.lit(VALUE).alias("code"))
    )
