"""Nearest vectors by a tree of k-means centres, searched best bin first (general).

The statement records hold no vectors, so the columns are called vec_id and embedding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import staged

# Bounds of what is fitted and measured: vectors of the sample, queries of a calibration.
SAMPLE_VECTORS = 16_384
CALIBRATION_QUERIES = 128
BRANCH = 8
LEAF_VECTORS = 64
NEAREST = 10
TARGET_RECALL = 0.97
# Vectors of one leaf that a task holds together; a larger leaf is dealt over several.
LEAF_BLOCK = 4_096

_FOUND = "query_id bigint, vec_id bigint, distance double"


def usable(embedding: Column) -> Column:
    """Neither null nor empty, without null or non-finite components, and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) > 0) & ~bad
                      & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class VectorTree:
    """Nodes in arrays: children of an inner node follow each other; a leaf has a number."""

    centre: np.ndarray
    first_child: np.ndarray
    n_children: np.ndarray
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector falls to, down the nearest centres."""
        node = np.zeros(len(vectors), np.int64)
        while True:
            inner = self.n_children[node] > 0
            if not inner.any():
                return self.leaf[node]
            for parent in np.unique(node[inner]):
                rows = np.flatnonzero(node == parent)
                children = self.first_child[parent] + np.arange(self.n_children[parent])
                node[rows] = children[_nearest(vectors[rows], self.centre[children])]

    def leaves_by_nearness(self, vector: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves of a best-bin-first walk.

        A queue holds the nodes passed by, by the distance of their centres; the nearest is taken
        next and followed down to a leaf.
        """
        queue: list[tuple[float, int]] = [(0.0, 0)]
        found: list[int] = []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            while self.n_children[node]:
                children = self.first_child[node] + np.arange(self.n_children[node])
                far = ((self.centre[children] - vector) ** 2).sum(axis=1)
                best = int(far.argmin())
                for k, child in enumerate(children.tolist()):
                    if k != best:
                        heapq.heappush(queue, (float(far[k]), child))
                node = int(children[best])
            found.append(int(self.leaf[node]))
        return found


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def _means(vectors: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), k, replace=False)].copy()
    part = np.zeros(len(vectors), np.int64)
    for _ in range(12):
        part = _nearest(vectors, centres)
        for c in range(k):
            own = vectors[part == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres, _nearest(vectors, centres)


def grow_tree(sample: np.ndarray) -> VectorTree:
    """Split by k-means until a node has at most ``LEAF_VECTORS`` of the sample, or no two differ."""
    rng = np.random.default_rng(7)
    centre, first, many, leaf = [sample.mean(axis=0)], [0], [0], [-1]
    waiting, leaves = [(0, sample)], 0
    while waiting:
        node, vectors = waiting.pop(0)
        parts = []
        if len(vectors) > LEAF_VECTORS:
            centres, part = _means(vectors, min(BRANCH, len(vectors)), rng)
            parts = [(centres[c], vectors[part == c]) for c in range(len(centres)) if (part == c).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], many[node] = len(centre), len(parts)
        for point, own in parts:
            waiting.append((len(centre), own))
            centre.append(point)
            first.append(0)
            many.append(0)
            leaf.append(-1)
    return VectorTree(np.array(centre), np.array(first), np.array(many), np.array(leaf))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _assign(tree: VectorTree):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series(tree.leaf_of(_matrix(vectors)) if len(vectors) else [], dtype="int32")
    return F.pandas_udf(run, "int")


def _visit(tree: VectorTree, visits: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series([tree.leaves_by_nearness(np.asarray(v, np.float64), visits)
                             for v in vectors], dtype=object)
    return F.pandas_udf(run, "array<int>")


def _closest(query_ids, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple]:
    """Each query's k nearest of a block, ties to the smaller id, by the plain sum of squares."""
    out = []
    for query_id, query in zip(query_ids, queries, strict=True):
        other = np.flatnonzero(ids != query_id)
        far = np.sqrt(((vectors[other] - query) ** 2).sum(axis=1))
        best = other[np.lexsort((ids[other], far))[:k]]
        mine = np.sqrt(((vectors[best] - query) ** 2).sum(axis=1))
        out += [(query_id, int(i), float(d)) for i, d in zip(ids[best], mine, strict=True)]
    return out


def _search_block(k: int):
    def run(key, blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(blocks) and len(queries):
            out = _closest(queries["query_id"].to_numpy(), _matrix(queries["query"]),
                           blocks["vec_id"].to_numpy(), _matrix(blocks["embedding"]), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "distance"])
    return run


def _scan_all(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield pd.DataFrame(
                    _closest(query_ids, queries, rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), k),
                    columns=["query_id", "vec_id", "distance"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, as an ordered array; partial results are short already."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best"))


def _searched(vectors: DataFrame, queries: DataFrame, tree: VectorTree, visits: int, k: int) -> DataFrame:
    """(query_id, vec_id, distance): the k nearest in every visited block of a leaf."""
    sizes = vectors.groupBy("leaf").agg(F.ceil(F.count("*") / LEAF_BLOCK).cast("int").alias("blocks"))
    # One row for each leaf, and the sample bounds the leaves. Without the hint the exploded queries,
    # whose size Spark can't foresee, may be sent instead.
    sizes = F.broadcast(sizes)
    blocks = vectors.join(sizes, "leaf").withColumn(
        "block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = (
        queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"),
                       F.explode(_visit(tree, visits)("embedding")).alias("leaf"))
        .join(sizes, "leaf")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return (
        blocks.select("leaf", "block", "vec_id", "embedding").groupBy("leaf", "block")
        .cogroup(asked.select("leaf", "block", "query_id", "query").groupBy("leaf", "block"))
        .applyInPandas(_search_block(k), _FOUND)
    )


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = NEAREST,
                    target_recall: float = TARGET_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance.

    ``vectors`` and ``queries`` have vec_id and embedding. A tree of k-means centres is grown from
    about 16,384 vectors; every vector is put in its leaf. A query walks the tree best bin first
    and is compared with all vectors of the leaves it visits. For about 128 queries the true
    neighbours are found over all vectors, and visits are widened until the share of them that the
    tree finds reaches ``target_recall``; with every leaf visited the search is exact.

    Distances are in double precision on the original components. Ties go to the smaller vec_id; a
    vector is no neighbour of a query of its id. Vectors that are null, empty, all zero or hold null
    or non-finite components take no part, neither do rows of null id or of another length than the
    most. Repeated rows of one id are one vector if equal, else each counts. Tables may be empty.
    """
    typed = [f.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                      F.col("embedding").cast("array<double>").alias("embedding"))
             .filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
             for f in (vectors, queries)]
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    lengths = typed[0].groupBy(F.size("embedding").alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    all_vectors, all_queries = (f.filter(F.size("embedding") == lengths["n"]) for f in typed)
    total = lengths["count"]
    sample = all_vectors.filter(
        F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total))) < SAMPLE_VECTORS).select("embedding")
    tree = grow_tree(np.array([r[0] for r in sample.collect()] or [[0.0] * lengths["n"]], np.float64))
    indexed = staged(all_vectors.withColumn("leaf", _assign(tree)("embedding")), "leaf-vectors")
    asked = staged(all_queries, "vector-queries")
    visits = _calibrated(indexed, asked, tree, k, target_recall)
    best = _top(_searched(indexed, asked, tree, visits, k), k)
    return best.select("query_id", F.posexplode("best").alias("_at", "_hit")).select(
        "query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.vec_id").alias("vec_id"),
        F.col("_hit.distance").alias("score"))


def recall_of(indexed: DataFrame, some: DataFrame, truth: DataFrame, tree: VectorTree, visits: int,
              k: int) -> float:
    """The share of true neighbours that a search with so many visits finds."""
    found = _top(_searched(indexed, some, tree, visits, k), k).select(
        "query_id", F.explode("best.vec_id").alias("vec_id"))
    wanted = truth.select("query_id", F.explode("best.vec_id").alias("vec_id"))
    total = wanted.count()
    return wanted.join(found, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def _calibrated(indexed: DataFrame, asked: DataFrame, tree: VectorTree, k: int, target: float) -> int:
    """Visits that reach the target on a bounded part of the queries, against brute force."""
    n = asked.count()
    some = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, n))) < CALIBRATION_QUERIES)
    rows = some.collect()
    if not rows:
        return 1
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    truth = staged(_top(indexed.select("vec_id", "embedding").mapInPandas(
        _scan_all(ids, np.array([r["embedding"] for r in rows], np.float64), k), _FOUND), k), "true-nearest")
    visits = max(1, tree.n_leaves // 16)
    while visits < tree.n_leaves and recall_of(indexed, some, truth, tree, visits, k) < target:
        visits = min(tree.n_leaves, -(-visits * 3 // 2))
    return visits
