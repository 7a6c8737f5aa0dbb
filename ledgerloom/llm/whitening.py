"""Vectors whitened on their leading principal components, from exact integer cross-products (general).

The statement records hold no vectors, so the columns are called vec_id and embedding.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.frames import staged

SCALE = 256
COMPONENTS = 4
# Vectors whose bits are packed together; words that one AND and popcount covers.
ROWS = 4_096
_LIMIT = float(1 << 62)

_SCATTER = "i int, j int, total decimal(38,0)"


def finite(embedding: Column) -> Column:
    """Not null, and without null or non-finite entries."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def stepped(embedding: Column, scale: int = SCALE) -> Column:
    """Each entry times ``scale`` rounded down, as long; beyond 2**62 it stays there."""
    limit = F.lit(_LIMIT)
    return F.transform(embedding, lambda c: F.floor(F.greatest(
        -limit, F.least(limit, c.cast("double") * scale))).cast("bigint"))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(kind, copy=False).reshape(len(column), -1)


def bit_planes(shifted: np.ndarray) -> list[np.ndarray]:
    """For every dimension (column) its bit planes, [plane, word]: bit r of the words is row r's."""
    n, dims = shifted.shape
    words = -(-n // 64)
    planes = []
    for d in range(dims):
        value = shifted[:, d]
        depth = int(value.max()).bit_length()
        bits = np.zeros((depth, words * 64), np.uint8)
        for b in range(depth):
            bits[b, :n] = (value >> np.uint64(b)) & np.uint64(1)
        planes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    return planes


def cross_products(x: np.ndarray) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """(rows, sums, sums of products of two dimensions i <= j) of int64 rows, exactly.

    A dimension is shifted by its least value, so that its bits are those of a number not below zero.
    The products of two planes are an AND, their sum a popcount, weighted by both places.
    """
    n, dims = x.shape
    least = x.min(axis=0)
    planes = bit_planes(x.view(np.uint64) - least.view(np.uint64))
    depth = np.array([len(p) for p in planes])
    first = np.cumsum(depth) - depth
    every = np.concatenate(planes) if depth.sum() else np.zeros((0, 1), np.uint64)
    counts = np.bitwise_count(every).sum(axis=1, dtype=np.int64).tolist()
    shift = [int(v) for v in least]
    sums = [sum(counts[f + b] << b for b in range(d)) for f, d in zip(first.tolist(), depth.tolist(), strict=True)]
    products = {}
    for i in range(dims):
        # Row a: plane a of dimension i with every plane of this and all later dimensions.
        rest = every[first[i]:]
        both = [np.bitwise_count(rest & plane).sum(axis=1, dtype=np.int64) for plane in planes[i]]
        for j in range(i, dims):
            at, total = int(first[j] - first[i]), 0
            for a, row in enumerate(both):
                total += sum(c << (a + b) for b, c in enumerate(row[at:at + int(depth[j])].tolist()))
            products[i, j] = (total + shift[i] * sums[j] + shift[j] * sums[i] + n * shift[i] * shift[j])
    return n, [s + n * m for s, m in zip(sums, shift, strict=True)], products


def _scattered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's count (-1, -1), sums (-1, j) and cross-products (i, j)."""
    found: dict[tuple[int, int], int] = {}
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            x = np.ascontiguousarray(_matrix(batch.column("x").slice(a, ROWS), np.int64))
            n, sums, products = cross_products(x)
            new = {(-1, -1): n, **{(-1, j): s for j, s in enumerate(sums)}, **products}
            for key, value in new.items():
                found[key] = found.get(key, 0) + value
    yield pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in found], pa.int32()), pa.array([j for _, j in found], pa.int32()),
         pa.array([*map(_decimal, found.values())], pa.decimal128(38, 0))], names=["i", "j", "total"])


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)


def leading_components(n: int, sums: list[int], products: dict[tuple[int, int], int],
                       most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of the covariance, largest first.

    Entries are centred as integers, n * product - sum * sum, and divided once. Eigenvalues that rounding
    can't tell from zero come as zero.
    """
    dims = len(sums)
    v = np.zeros((dims, dims))
    trace = 0
    for (i, j), total in products.items():
        centred = n * total - sums[i] * sums[j]
        v[i, j] = v[j, i] = centred / (n * n)
        trace += centred if i == j else 0
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:most].copy(), vectors[:, ::-1][:, :most]
    values[values <= dims * np.finfo(float).eps * max(float(np.abs(v).max(initial=0)), 0)] = 0
    return values, vectors, trace / (n * n)


def _projector(n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray):
    mean = np.array([s / n for s in sums])
    with np.errstate(divide="ignore"):
        scale = np.where(values > 0, 1 / np.sqrt(values), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - mean) @ vectors) * scale
    return project


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The exact sum over dimensions of (n * x - sum) ** 2."""
    far = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s))
               for lo, hi, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True)), default=0)
    whole = np.int64 if far * far * max(1, len(sums)) < 1 << 62 else object
    return (((n * x.astype(whole) - np.array(sums, whole)) ** 2).sum(axis=1)).tolist()


def _whitened_fit(project, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch.column("x"), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(many)],
                                                 names=[f"w{k}" for k in range(many)])
    return run


def _whitened(project, n: int, sums: list[int], values: np.ndarray, trace: float, error: float | None):
    explained = [float(e / trace) if trace else None for e in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), np.int64)
            rows = np.repeat(np.arange(len(x)), many)
            w = project(x).ravel()
            far = [_decimal(v) for v in _deviations(x, n, sums)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)),
                 pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                 pa.array([n] * len(rows), pa.int64()),
                 pa.array(far, pa.decimal128(38, 0)).take(pa.array(rows)),
                 pa.array(w, mask=np.isnan(w)),
                 pa.array(explained * len(x), pa.float64()),
                 pa.array([error] * len(rows), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def _identity_error(fit: DataFrame, project, values: np.ndarray) -> float | None:
    """The largest distance of the whitened fit list's measured covariance from the identity."""
    known = np.flatnonzero(values > 0).tolist()
    if not known:
        return None
    schema = ", ".join(f"w{k} double" for k in range(len(values)))
    w = fit.mapInArrow(_whitened_fit(project, len(values)), schema)
    pairs = list(combinations_with_replacement(known, 2))
    row = w.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten_vectors(vectors: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row a vector and component.

    ``vectors`` has vec_id (any type) and embedding (numbers); other columns are ignored. Entries are
    multiplied by ``scale`` and rounded down to whole x. The fit list is each distinct x once, n in all
    with sums S; components are unit eigenvectors of its covariance (divisor n) from number 1, the
    largest. whitened is x - S / n on the component over the root of its eigenvalue; deviation the exact
    sum of (n * x - S) ** 2; explained the eigenvalue's share of the trace; identity_error the largest
    entry of |covariance of whitened - identity|, measured over the fit list.

    Rows whose embedding is null, or holds null or non-finite entries, are left out, as are empty ones and
    those of another length than the most rows have. Repeated rows come back each, and fit once. Of
    fewer dimensions than ``components`` as many come as there are. A component without variance has
    whitened null and explained 0 (null where nothing varies at all, identity_error too). Null ids stay.
    An empty table gives an empty result.

    Cross-products are sums of popcounts of ANDed bit planes, added as whole numbers by Spark. What
    reaches the driver is one number for each two dimensions, whatever the rows.
    """
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    usable = vectors.select("vec_id", "embedding").filter(
        finite(F.col("embedding")) & (F.size("embedding") > 0))
    length = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = usable.filter(F.size("embedding") == length["n"]).select(
        "vec_id", stepped(F.col("embedding"), scale).alias("x"))
    fit = staged(rows.select("x").distinct(), "fit-vectors")
    totals = fit.mapInArrow(_scattered, _SCATTER).groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r["i"], r["j"]): int(r["total"]) for r in totals.collect()}
    n = found.pop((-1, -1))
    sums = [found.pop((-1, j)) for j in range(length["n"])]
    values, axes, trace = leading_components(n, sums, found, components)
    project = _projector(n, sums, values, axes)
    error = _identity_error(fit, project, values)
    return rows.mapInArrow(_whitened(project, n, sums, values, trace, error), schema)
