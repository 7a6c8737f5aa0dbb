"""Running totals that stay parallel when one key owns most of the rows.

A plain window over a key sends every row of that key to one task. Here the key's rows are
cut into consecutive chunks: chunk totals are pre-aggregated on the map side, only those
totals are accumulated per key, and the rows themselves are windowed per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    totals: Mapping[str, Column],
    restart_on: Mapping[str, str] | None = None,
    kind: str = "bigint",
) -> DataFrame:
    """Append one inclusive running sum per entry of ``totals``.

    ``chunk`` must be a non-null column whose order agrees with ``order`` inside a key: every
    row of a lower chunk comes before every row of a higher one. ``restart_on`` maps a total to
    a further column, fixed within a chunk, at whose change that total starts again from zero.
    ``kind`` is the type of the sums; a decimal where they may pass the range of a bigint.
    """
    keys = list(keys)
    restart_on = dict(restart_on or {})
    extra = sorted(set(restart_on.values()))
    per_chunk = rows.groupBy(*keys, chunk).agg(
        *[F.min(column).alias(column) for column in extra],
        *[F.sum(value).alias(f"_{name}_chunk") for name, value in totals.items()],
    )
    offsets = per_chunk.select(
        *keys,
        chunk,
        *[
            F.coalesce(
                F.sum(f"_{name}_chunk").over(
                    W.partitionBy(*keys, *([restart_on[name]] if name in restart_on else []))
                    .orderBy(chunk)
                    .rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias(f"_{name}_before")
            for name in totals
        ],
    )
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(
        "*", *[F.sum(value).over(inside).alias(f"_{name}_in") for name, value in totals.items()]
    )
    # Left join: every chunk has its offset row, and an unused total lets Catalyst drop the join.
    return local.join(offsets, [*keys, chunk], "left").select(
        *rows.columns,
        *[
            (F.col(f"_{name}_before") + F.col(f"_{name}_in")).cast(kind).alias(name)
            for name in totals
        ],
    )
