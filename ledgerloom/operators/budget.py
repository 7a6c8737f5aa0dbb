"""Envelope budgets: listing, creation, what is left to assign, and ordered admission."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tokens import strip
from ledgerloom.operators.ledger_queries import overview_totals
from ledgerloom.schemas import TOKEN, Ledger
from ledgerloom.sources.stage import staged

EXCEEDS = "ASSIGN_EXCEEDS_AVAILABLE"
NOT_FOUND = "ENVELOPE_NOT_FOUND"


def list_envelopes(envelopes: DataFrame) -> DataFrame:
    return envelopes.orderBy(F.lower("name"), "envelope_id")


def create_envelopes(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert with balance 0, refused requests with a reason).

    ``new`` is (request_id, name). Names are trimmed; one name in any case exists once, and of
    several requests for it the lowest request id is served.
    """
    named = new.select("request_id", strip(F.coalesce("name", F.lit(""))).alias("name"))
    named = named.withColumn("_key", F.lower("name"))
    taken = existing.select(F.lower(strip(F.col("name"))).alias("_key")).distinct()
    winners = (
        named.filter(F.col("_key") != "")
        .groupBy("_key")
        .agg(F.min(F.struct("request_id", "name")).alias("w"))
        .join(taken, "_key", "left_anti")
        .select("_key", "w.request_id", "w.name")
    )
    created = winners.select(
        F.sha2(F.concat_ws("|", F.lit("envelope"), "_key"), 256).alias("envelope_id"),
        "request_id", "name", F.lit(0).cast("bigint").alias("balance_cents"),
    )
    refused = named.join(winners.select("request_id"), "request_id", "left_anti").select(
        "request_id", "name",
        F.when(F.col("_key") == "", F.lit(TOKEN)).otherwise(F.lit("DUPLICATE_NAME"))
        .alias("error"),
    )
    return created, refused


def ready_to_assign(ledger: Ledger, envelopes: DataFrame, limit: int | None = None,
                    liabilities_negative: bool = False) -> DataFrame:
    """Overview closings minus envelope balances: one row, possibly negative."""
    closing = overview_totals(ledger, limit, liabilities_negative).select(
        F.col("total_closing_cents").alias("cents")
    )
    assigned = envelopes.select((-F.col("balance_cents")).alias("cents"))
    return closing.unionByName(assigned).agg(
        F.coalesce(F.sum("cents"), F.lit(0)).cast("bigint").alias("ready_to_assign_cents")
    )


# One round for each power of two that a rest can have, and one that finds nothing left.
_ROUNDS = 65
# Requests of one budget are dealt into slices of this many sequence numbers.
_SLICE = 1 << 20


def _fold(group: pa.Table) -> pa.Table:
    """The requests of one slice that fit, taken in order from the rest at its start."""
    group = group.sort_by("seq")
    rest, fits = group["at_stop"][0].as_py(), []
    for amount in group["amount_cents"].to_pylist():
        fits.append(amount <= rest)
        if fits[-1]:
            rest -= amount
    return group.select(["budget_id", "seq", "amount_cents"]).filter(pa.array(fits, pa.bool_()))


def _admit(requests: DataFrame, available: DataFrame, slice_size: int = _SLICE) -> DataFrame:
    """Accepted requests: each takes its amount if the rest covers it, else takes nothing.

    The rest only ever shrinks, which bounds the work. Let the level be the largest waiting
    amount, or the largest power of two not above the rest if that is less. While the rest stays
    at the level or above, every request up to the level fits, so those are a plain running sum.
    A larger request that fits, or enough of the small ones, brings the rest below the level. The
    slice of sequence numbers in which that happens is told from two figures of each slice: what
    its small requests take, and the least rest at its start with which a larger one would fit.
    That slice, of at most ``slice_size`` requests, is folded one by one, and the round goes on
    behind it with a rest of fewer bits: a round for each slice or each bit, whichever are fewer.
    Every round covers all budgets at once, and keeps only requests that may still fit. Sums are
    decimals, as those far beyond the rest may pass 2^63.
    """
    rest = available.select("budget_id", F.col("available_cents").cast("bigint").alias("rest"))
    waiting = staged(
        requests.filter("seq IS NOT NULL").join(rest, "budget_id").filter("amount_cents <= rest")
        .select("budget_id", "seq", F.col("amount_cents").cast("bigint").alias("amount_cents"),
                F.floor(F.col("seq") / slice_size).alias("slice"), "rest"), "admission")
    columns = waiting.columns
    slim = waiting.select("budget_id", "seq", "amount_cents")
    accepted = slim.filter(F.lit(False))
    in_slice = Window.partitionBy("budget_id", "slice").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    over_slices = Window.partitionBy("budget_id").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for _ in range(_ROUNDS):
        if waiting.isEmpty():
            return accepted.select("budget_id", "seq")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin("rest")) - 1)
        # Staged, so that the joins' two sides are plain exchanges and a hot budget can be split.
        levels = staged(
            waiting.groupBy("budget_id").agg(F.max("amount_cents").alias("most"),
                                             F.min("rest").alias("rest"))
            .select("budget_id", F.least("most", bit).alias("level")), "levels")
        is_small = F.col("amount_cents") <= F.col("level")
        small = F.when(is_small, F.col("amount_cents")).otherwise(F.lit(0)).cast("decimal(20,0)")
        slices = (
            waiting.join(levels, "budget_id").withColumn("small", small)
            .withColumn("spent", F.sum("small").over(in_slice).cast("decimal(38,0)"))
            .groupBy("budget_id", "slice")
            .agg(F.min("rest").alias("rest"), F.min("level").alias("level"),
                 F.sum("small").cast("decimal(38,0)").alias("small"),
                 F.min(F.when(~is_small, F.col("spent") + F.col("amount_cents"))).alias("need"))
            .withColumn("after", F.col("rest") - F.sum("small").over(over_slices))
            .withColumn("before", F.col("after") + F.col("small"))
        )
        ends = (F.col("after") < F.col("level")) | (F.col("need") <= F.col("before"))
        stops = staged(
            slices.filter(ends).groupBy("budget_id")
            .agg(F.min_by(F.struct("slice", "before"), "slice").alias("s"))
            .select("budget_id", F.col("s.slice").alias("stop"),
                    F.col("s.before").cast("bigint").alias("at_stop")), "stops")
        # Before its stop every small request fits and no larger one does.
        plain = waiting.join(levels, "budget_id").join(stops, "budget_id", "left").filter(
            is_small & (F.col("stop").isNull() | (F.col("slice") < F.col("stop"))))
        folded = (
            waiting.join(stops, "budget_id").filter(F.col("slice") == F.col("stop"))
            .select("budget_id", "seq", "amount_cents", "at_stop")
            .groupBy("budget_id").applyInArrow(_fold, slim.schema)
        )
        taken = staged(
            plain.select(*slim.columns, F.lit(False).alias("folded"))
            .unionByName(folded.withColumn("folded", F.lit(True))), "accepted")
        accepted = accepted.unionByName(taken.select(*slim.columns))
        used = taken.filter("folded").groupBy("budget_id").agg(F.sum("amount_cents").alias("used"))
        rest = staged(
            stops.join(used, "budget_id", "left")
            .select("budget_id", "stop",
                    (F.col("at_stop") - F.coalesce("used", F.lit(0))).alias("rest")), "rests")
        waiting = staged(
            waiting.drop("rest").join(rest, "budget_id")
            .filter((F.col("slice") > F.col("stop")) & (F.col("amount_cents") <= F.col("rest")))
            .select(*columns), "admission")
    raise RuntimeError("budget admission did not end")


def assign_batch(requests: DataFrame, envelopes: DataFrame, available: DataFrame
                 ) -> tuple[DataFrame, DataFrame]:
    """(every request with its outcome, envelopes with their new balances).

    ``requests`` is (budget_id, seq, envelope_id, amount_cents), seq unique within its budget;
    ``available`` is (budget_id, available_cents). Checks run in the order amount, envelope,
    rest; a refused request uses nothing up and nothing is clamped.
    """
    known = envelopes.select("envelope_id").distinct().withColumn("_known", F.lit(True))
    checked = requests.join(known, "envelope_id", "left").withColumn(
        "error",
        F.when(F.coalesce(F.col("amount_cents") <= 0, F.lit(True)), F.lit(TOKEN))
        .when(F.col("_known").isNull(), F.lit(NOT_FOUND)),
    ).drop("_known")
    admissible = checked.filter(F.col("error").isNull()).select("budget_id", "seq", "amount_cents")
    accepted = _admit(admissible, available).withColumn("_ok", F.lit(True))
    outcome = checked.join(accepted, ["budget_id", "seq"], "left").select(
        "budget_id", "seq", "envelope_id", "amount_cents",
        F.coalesce("_ok", F.lit(False)).alias("accepted"),
        F.when(F.col("_ok").isNull(), F.coalesce("error", F.lit(EXCEEDS))).alias("error"),
    )
    gains = outcome.filter("accepted").groupBy("envelope_id").agg(
        F.sum("amount_cents").cast("bigint").alias("_gain")
    )
    balances = envelopes.join(gains, "envelope_id", "left").withColumn(
        "balance_cents", F.col("balance_cents") + F.coalesce("_gain", F.lit(0))
    ).select(*envelopes.columns)
    return outcome, balances
