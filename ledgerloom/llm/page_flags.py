"""Flagged page text by a linear classifier on character n-grams scaled by count ratios (general)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import staged

# Lengths of the n-grams and bits of the hash that numbers them.
LENGTHS = (3, 4, 5, 6)
HASH_BITS = 22
# Bounds of the fit: labelled texts read, characters of each slice of a text, features kept.
MAX_TRAINING_PAGES = 20_000
MAX_FEATURES = 8_192
MIN_PAGES = 5
MIN_Z = 4.0
SMOOTHING = 1.0
RIDGE = 1e-3
STEPS = 400

_BUCKETS = 1 << HASH_BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20

_COUNTS = "feature int, flagged bigint, clear bigint"
_HITS = "page int, flagged int, features array<int>"
_WEIGHTS = "feature int, weight double"


def _features(text: str, at: int, length: int) -> np.ndarray:
    """Hash numbers of the n-grams of one length that start in a slice of a text."""
    piece = text[at:at + _SLICE + length - 1]
    points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.full(n, length, np.uint64)
    for k in range(length):
        code = (code + points[k:n + k]) * _MIX
    return ((code ^ (code >> np.uint64(29))) * _MIX >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _slices(text: str) -> Iterator[np.ndarray]:
    """Features of a whole text, slice by slice and length by length. Case is not looked at."""
    text = f" {' '.join(text.lower().split())} "
    for at in range(0, len(text), _SLICE):
        for length in LENGTHS:
            yield _features(text, at, length)


def page_features(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """The distinct feature numbers of a text, or those of them that are ``wanted`` (a mask)."""
    parts = []
    for some in _slices(text):
        parts.append(np.unique(some if wanted is None else some[wanted[some]]))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    flagged, clear = np.zeros(_BUCKETS, np.int32), np.zeros(_BUCKETS, np.int32)
    for rows in batches:
        for text, flag in zip(rows["page_text"], rows["flagged"], strict=True):
            (flagged if flag else clear)[page_features(text)] += 1
    seen = np.flatnonzero(flagged + clear)
    for at in range(0, len(seen), 100_000):
        some = seen[at:at + 100_000]
        yield pd.DataFrame({"feature": some.astype(np.int32), "flagged": flagged[some].astype(np.int64),
                            "clear": clear[some].astype(np.int64)})


def _hits(numbers: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.zeros(_BUCKETS, bool)
        wanted[numbers] = True
        for rows in batches:
            yield pd.DataFrame({
                "page": 0, "flagged": rows["flagged"].astype(np.int32),
                "features": [page_features(t, wanted).astype(np.int32) for t in rows["page_text"]]})
    return run


def _fit(features: np.ndarray, ratio: np.ndarray):
    """Logistic regression on present features times their ratio; weights come back unscaled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches])
        order = np.argsort(features)
        flag = rows["flagged"].to_numpy(np.float64)
        many = np.array([len(f) for f in rows["features"]])
        column = order[np.searchsorted(features[order], np.concatenate(
            [np.asarray(f, np.int64) for f in rows["features"]] or [np.zeros(0, np.int64)]))]
        row = np.repeat(np.arange(len(rows)), many)
        value = ratio[column]
        n, width = len(rows), len(features)
        weight, bias = np.zeros(width), np.log((flag.sum() + 1) / (n - flag.sum() + 1))
        # The classes weigh alike, so that a rare flag is not outvoted.
        share = np.where(flag > 0, 0.5 / max(flag.sum(), 1), 0.5 / max((1 - flag).sum(), 1))
        first, second, pace = np.zeros(width + 1), np.zeros(width + 1), 0.05
        for step in range(1, STEPS + 1):
            total = np.bincount(row, value * weight[column], n) + bias
            error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - flag) * share
            slope = np.append(np.bincount(column, value * error[row], width) + RIDGE * weight / width,
                              error.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope * slope
            move = pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weight -= move[:-1]
            bias -= move[-1]
        yield pd.DataFrame({"feature": np.append(features, -1).astype(np.int32),
                            "weight": np.append(weight * ratio, bias)})
    return run


@dataclass(frozen=True)
class PageFlags:
    """A fitted classifier: a weight for each feature number, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, raw_pages: DataFrame, score: str = "score") -> DataFrame:
        """Every input row and column, and ``score`` from 0 to 1; null text counts as empty.

        A column that is called like the score is replaced. Whole texts are scored, slice by slice.
        """
        pages = raw_pages.drop(score)
        features, weights, bias = self.features, self.weights, self.bias
        place = pages.columns.index("page_text")

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = np.zeros(_BUCKETS, np.float64)
            table[features] = weights
            wanted = np.zeros(_BUCKETS, bool)
            wanted[features] = True
            for some in texts:
                total = np.array([bias + table[page_features(t or "", wanted)].sum() for t in some])
                yield pd.Series(1 / (1 + np.exp(-np.clip(total, -500, 500))))

        return pages.withColumn(score, F.pandas_udf(run, "double")(F.col(pages.columns[place])))


def fit_page_flags(raw_pages: DataFrame, labels: DataFrame, max_pages: int = MAX_TRAINING_PAGES
                   ) -> PageFlags:
    """Fit on the texts of ``raw_pages`` (raw_page_id, page_text) that ``labels`` tells about.

    ``labels`` has raw_page_id and flagged (0 or 1); rows with a null in either are left out. About
    ``max_pages`` of them, by a hash of the id, are read: the documented bound of the fit.
    Each n-gram's count of flagged and clear pages gives its naive Bayes log ratio; n-grams whose
    ratio stands out by four standard errors are kept, at most 8,192; a logistic regression
    weighs present n-grams scaled by their ratios. Null text counts as empty. Where labels are all
    alike or no n-gram stands out, every score is the labels' share.
    """
    told = labels.select("raw_page_id", F.col("flagged").cast("int").alias("flagged")).dropna()
    n_told = told.count()
    if n_told > max_pages:
        told = told.filter(F.pmod(F.xxhash64("raw_page_id"), F.lit(n_told)) < max_pages)
    # max_pages bounds the labels, so they can be sent to every task and no text is moved.
    sample = staged(
        raw_pages.select("raw_page_id", F.coalesce("page_text", F.lit("")).alias("page_text"))
        .join(F.broadcast(told), "raw_page_id").select("page_text", "flagged"), "labelled-pages")
    n_flagged, n_clear = (int(x or 0) for x in sample.agg(
        F.sum("flagged"), F.sum(1 - F.col("flagged"))).first())
    share = float(np.log((n_flagged + 1) / (n_clear + 1)))
    nothing = PageFlags(np.zeros(0, np.int64), np.zeros(0), share)
    if not n_flagged or not n_clear:
        return nothing
    counts = sample.mapInPandas(_count, _COUNTS).groupBy("feature").agg(
        F.sum("flagged").alias("f"), F.sum("clear").alias("c"))
    p = (F.col("f") + SMOOTHING) / (n_flagged + 2 * SMOOTHING)
    q = (F.col("c") + SMOOTHING) / (n_clear + 2 * SMOOTHING)
    ratio = F.log(p / q)
    error = F.sqrt(1 / (F.col("f") + SMOOTHING) + 1 / (F.col("c") + SMOOTHING))
    # At most MAX_FEATURES rows come to the driver.
    kept = (
        counts.filter(F.col("f") + F.col("c") >= MIN_PAGES)
        .select("feature", ratio.alias("ratio"), F.abs(ratio / error).alias("z"))
        .filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()
    )
    if not kept:
        return nothing
    features = np.array([r.feature for r in kept], np.int64)
    ratios = np.array([r.ratio for r in kept], np.float64)
    # Staged, so that n-grams are taken by many tasks and only the kept ones' places meet in one.
    hits = staged(sample.mapInPandas(_hits(features), _HITS), "hits")
    weights = hits.coalesce(1).mapInPandas(_fit(features, ratios), _WEIGHTS).collect()
    table = {r.feature: r.weight for r in weights}
    return PageFlags(features, np.array([table[int(f)] for f in features]), table[-1])
