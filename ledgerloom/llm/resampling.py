"""Pages drawn towards a target's distribution of word runs, by importance weights over hashed buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.crc_spans import span_crcs
from ledgerloom.llm.frames import keyed_text, staged, text_batches

BUCKETS = 10_000
RUN_WORDS = 3
MIN_WORDS = 20
DRAW_PERCENT = 5
SEED = 42
# Bytes of text, and runs of words, that a task works on together.
TEXT_BYTES = 1 << 20
SPANS = 1 << 18

_INK = np.zeros(256, bool)
_INK[ord("0"):ord("9") + 1] = _INK[ord("a"):ord("z") + 1] = _INK[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_COUNTED = "bucket int, n bigint"


def joined_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each followed by a blank; begin and end of each word there; its text).

    ``at`` holds where each text begins in ``data``, and the end. Texts never run into each other.
    """
    data = _LOWER[data]
    ink = _INK[data]
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0) != 0
    inner = at[(at > 0) & (at < len(data))]
    split = inner[ink[inner] & ink[inner - 1]]
    step = np.sort(np.concatenate([np.flatnonzero(edge), np.unique(split), np.unique(split)]))
    begin, end = step[0::2], step[1::2]
    size = end - begin
    out_begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), ord(" "), np.uint8)
    blank = np.zeros(len(out), bool)
    blank[out_begin + size] = True
    out[~blank] = data[ink]
    return out, out_begin, out_begin + size, np.searchsorted(at, begin, "right") - 1


def run_buckets(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of one to three words, in pieces."""
    words, begin, end, text = joined_words(data, at)
    for n in range(RUN_WORDS):
        if len(begin) <= n:
            break
        first, last = begin[:len(begin) - n], end[n:]
        same = text[:len(begin) - n] == text[n:]
        first, last, of = first[same], last[same], text[:len(begin) - n][same]
        for a in range(0, len(first), SPANS):
            b = a + SPANS
            yield of[a:b], (span_crcs(words, first[a:b], last[a:b]) % BUCKETS).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One count of each bucket for a task, of all its texts."""
    counts = np.zeros(BUCKETS, np.int64)
    for _, data, at in text_batches(batches, TEXT_BYTES):
        for _, bucket in run_buckets(data, at):
            counts += np.bincount(bucket, minlength=BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])],
                                     names=["bucket", "n"])


def bucket_counts(raw_pages: DataFrame) -> np.ndarray:
    """How many runs of all texts fall into each bucket; tasks count, and counts are added."""
    found = keyed_text(raw_pages, "page_text").mapInArrow(_counted, _COUNTED)
    counts = np.zeros(BUCKETS, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of both smoothed distributions."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
        for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in text_batches(batches, TEXT_BYTES):
            n = len(at) - 1
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for of, bucket in run_buckets(data, at):
                np.add.at(weight, of, gains[bucket])
                features += np.bincount(of, minlength=n)
            # w words make w, w - 1 and w - 2 runs, 3 * w - 3 in all, but one word makes one.
            words = np.where(features > 1, features // RUN_WORDS + 1, features)
            yield pa.RecordBatch.from_arrays(
                [rows.column("raw_page_id"), pa.array(features), pa.array(words), pa.array(weight)],
                names=["raw_page_id", "n_features", "n_words", "weight"])
    return run


def seeded_noise(raw_page_id: Column, seed: int = SEED) -> Column:
    """Whole thousandths of Gumbel noise, from the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(raw_page_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """With rank: the place by falling score of each drawn row.

    Rows are dealt by ranges of the whole order, each part is sorted, and a row's place is its place in
    the part and the size of the parts before; no part holds all rows.
    """
    order = [F.desc("_long"), F.desc("score"), F.asc_nulls_last("raw_page_id"), F.asc("n_features"),
             F.asc("weight")]
    long = F.col("n_words") >= min_words
    placed = staged(
        scored.withColumn("_long", long).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "placed-pages")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(
        F.count("*").alias("_rows"), F.count_if("_long").alias("_n")).orderBy("_part").collect()
    drawn = percent * sum(r["_n"] for r in sizes) // 100
    before, total = [], 0
    for r in sizes:
        before.append((r["_part"], total))
        total += r["_rows"]
    offsets = placed.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(
        "rank", F.when(F.col("_long") & (place <= drawn), place)).drop(
            "_part", "_before", "_at", "_long")


def resample_pages(raw_pages: DataFrame, target_pages: DataFrame, draw_percent: int = DRAW_PERCENT,
                   min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(raw_page_id, n_features, n_words, weight, score, rank) of every page.

    ``raw_pages`` has raw_page_id (any type with an order) and page_text, ``target_pages`` has
    page_text; other columns are ignored. A-Z become lower case, words are runs of 0-9, a-z and
    characters beyond ASCII, and features are all runs of one to three words, repeats counted, joined by a blank
    and hashed by CRC-32 into 10,000 buckets. A bucket's gain is the log ratio, in thousandths, of its
    smoothed share in the target and in ``raw_pages``; weight adds the gains of a page's features, and score
    adds Gumbel noise from ``seed`` and the id. Of the pages with ``min_words`` words or more the
    ``draw_percent`` % of highest score are drawn without replacement; rank numbers them from 1, ties by
    smaller id, and is null elsewhere.

    Null or empty text has no features and weight 0. A null id takes part, with the noise of an
    empty one, and comes last among ties. Repeated rows count and are ranked each. Empty tables are
    fine: without a target all shares there are equal.
    """
    gains = bucket_gains(bucket_counts(raw_pages), bucket_counts(target_pages))
    id_field = T.StructField("raw_page_id", raw_pages.schema["raw_page_id"].dataType)
    schema = T.StructType([id_field, *(T.StructField(n, T.LongType())
                                       for n in ("n_features", "n_words", "weight"))])
    weighed = keyed_text(raw_pages, "raw_page_id", "page_text").mapInArrow(_weighed(gains), schema)
    scored = weighed.withColumn("score", F.col("weight") + seeded_noise(F.col("raw_page_id"), seed))
    return _ranked(scored, draw_percent, min_words)
