"""Pages whose word shingles are alike: chosen-path join with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bk_trees import least_labels
from ledgerloom.llm.components import components
from ledgerloom.llm.frames import keyed_text, staged, typed_ids, union_all, worded_ids

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
SKETCH = 64
# Tokens sampled at the root of a run, and at each later split of a bucket.
ROOT_SAMPLES = 6
SPLIT_SAMPLES = 2
MAX_SPLITS = 4
# A bucket of which one token keeps so large a part together is alike, and is not split. Which buckets are
# is told from about so many of each one's members; either way all its pairs are compared somewhere.
ALIKE_PART = 0.7
ALIKE_MEMBERS = 128
# Buckets up to this size are compared at once; sets of a larger one that a task holds together, and
# sets of which all pairs are looked at together.
SMALL_BUCKET = 512
BLOCK = 1 << 14
TILE = 256
# Links of a block held before they are contracted.
LINKS = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BATCH = 1 << 20
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 64, SKETCH, np.uint64)
_SPREAD = _rng.integers(0, 1 << 64, SKETCH, np.uint64) | np.uint64(1)
_BYTE_CODE = _rng.integers(0, 1 << 64, 256, np.uint64)
_WORD_CODE = _rng.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)

_SETS = ("raw_page_id string, tag bigint, set_id binary, sketch array<int>")
_GRAMS = "set_id binary, grams binary"
_FOUND = "set_id binary, links bigint, root binary"


def least_equal(threshold: float = THRESHOLD, miss: float = (1 - TARGET_RECALL) / 2) -> int:
    """Equal sketch values that a pair at the threshold has, but for a chance of ``miss`` at most."""
    tail = 0.0
    for k in range(SKETCH + 1):
        tail += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if tail > miss:
            return k
    return SKETCH


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Runs after which a pair just at the threshold is missed with a chance of half 1 - target at most.

    The pair shares a root's token with the threshold's probability, and must share one of a split's
    at every split, of which the most are reckoned with; tokens are taken to be independent. The other
    half of the chance is the sketches' (``least_equal``).
    """
    kept = threshold * (1 - (1 - threshold) ** SPLIT_SAMPLES) ** MAX_SPLITS
    miss = (1 - kept) ** ROOT_SAMPLES
    return max(1, math.ceil(math.log((1 - target) / 2) / math.log(miss)))


def _mixed(code: np.ndarray) -> np.ndarray:
    code = code ^ (code >> np.uint64(33))
    code = code * np.uint64(0xFF51AFD7ED558CCD)
    return code ^ (code >> np.uint64(29))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's runs of five words.

    Words are runs of bytes above the blank in lower case. One to four words make a single run.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    ink = np.concatenate([[False], data > 32])
    step = np.flatnonzero(ink[1:] != ink[:-1])
    begin = step[0::2]
    stop = step[1::2]
    # A word's polynomial is a difference of running sums, shifted back to where the word begins.
    power = np.cumprod(np.full(len(data), _PRIME, np.uint64))
    back = np.cumprod(np.full(len(data), _INVERSE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_CODE[data] * power)])
    word = _mixed((total[stop] - total[begin]) * back[begin])
    first = np.searchsorted(begin, np.concatenate([[0], ends[:-1]]))
    last = np.searchsorted(begin, ends)
    if len(word) >= WORDS:
        n = len(word) - WORDS + 1
        gram = word[:n] * _WORD_CODE[0]
        for k in range(1, WORDS):
            gram = gram + word[k:n + k] * _WORD_CODE[k]
        gram = _mixed(gram)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(gram[a:b - WORDS + 1]))
        elif b > a:
            few = (word[a:b] * _WORD_CODE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mixed(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest value of every set under each of the sketch's hash functions (upper 32 bits)."""
    tokens = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), SKETCH), np.uint32)
    for k in range(SKETCH):
        value = (tokens ^ _FLIP[k]) * _SPREAD[k]
        out[:, k] = np.minimum.reduceat(value, at) >> np.uint64(32)
    return out.view(np.int32)


def _groups(texts) -> Iterator[tuple[int, int]]:
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= _BATCH:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _make_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = rows["page_text"].tolist()
        for a, b in _groups(texts):
            sets = shingle_sets(texts[a:b])
            full = [k for k, s in enumerate(sets) if len(s)]
            sketch = _sketches([sets[k] for k in full]) if full else []
            ids, marks = [None] * (b - a), [None] * (b - a)
            for k, row in zip(full, sketch, strict=True):
                ids[k] = xxhash.xxh3_128_digest(sets[k].tobytes())
                marks[k] = row
            yield pd.DataFrame({"raw_page_id": rows["raw_page_id"].iloc[a:b].array,
                                "tag": rows["tag"].iloc[a:b].array, "set_id": ids, "sketch": marks})


def _make_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = rows["page_text"].tolist()
        for a, b in _groups(texts):
            grams = [s.tobytes() for s in shingle_sets(texts[a:b])]
            yield pd.DataFrame({"set_id": rows["set_id"].iloc[a:b].array, "grams": grams})


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of one bucket block after another, each set once; rows come ordered."""
    kept: list[pd.DataFrame] = []
    last = None
    key = ["path", "block_a", "block_b"]
    for rows in batches:
        if not len(rows):
            continue
        change = (rows[key] != rows[key].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
        for a, b in zip(change, [*change[1:], len(rows)], strict=True):
            part = rows.iloc[a:b]
            now = tuple(part[key].iloc[0])
            if now != last and kept:
                yield pd.concat(kept).drop_duplicates("set_id") if len(kept) > 1 else (
                    kept[0].drop_duplicates("set_id"))
                kept = []
            last = now
            kept.append(part)
    if kept:
        yield pd.concat(kept).drop_duplicates("set_id")


def _earlier(members: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(member, number of a path) for all paths of the members before the bucket's own."""
    paths = members["paths"].to_numpy()
    every = np.concatenate([np.asarray(p, np.int64) for p in paths])
    who = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
    before = every < members["path"].iloc[0]
    return who[before], np.unique(every[before], return_inverse=True)[1]


def _met_before(who: np.ndarray, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether members a (rows) and b (columns), runs of numbers, share an earlier path."""
    parts = []
    for run in (a, b):
        low, high = np.searchsorted(who, [run[0], run[-1] + 1])
        parts.append((who[low:high] - run[0], code[low:high]))
    common = np.intersect1d(parts[0][1], parts[1][1])
    if not len(common):
        return np.zeros((len(a), len(b)), bool)
    tables = []
    for run, (row, column) in zip((a, b), parts, strict=True):
        some = np.isin(column, common)
        table = np.zeros((len(run), len(common)), np.float32)
        table[row[some], np.searchsorted(common, column[some])] = 1
        tables.append(table)
    return tables[0] @ tables[1].T > 0


def _owned_pairs(members: pd.DataFrame, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket block that look alike and meet in no earlier bucket, a tile at a time."""
    block = members["block"].to_numpy()
    one = members["block_a"].iloc[0] == members["block_b"].iloc[0]
    sketch = np.stack(members["sketch"].to_numpy())
    who, code = _earlier(members)
    runs = [np.arange(k, min(k + TILE, len(sketch))) for k in range(0, len(sketch), TILE)]
    for k, a in enumerate(runs):
        for b in runs[k:]:
            new = ~_met_before(who, code, a, b)
            if a[0] == b[0]:
                new = np.triu(new, 1)
            if not one:
                new &= block[a][:, None] != block[b][None, :]
            left, right = np.nonzero(new)
            if 8 * len(left) > new.size:
                alike = np.zeros(new.shape, np.uint8)
                for c in range(SKETCH):
                    alike += sketch[a, c][:, None] == sketch[b, c][None, :]
                close = alike[left, right] >= least
            else:
                close = (sketch[a[left]] == sketch[b[right]]).sum(axis=1) >= least
            if close.any():
                yield a[left[close]], b[right[close]]


def _survivors(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in _by_bucket(batches):
            if len(members) < 2:
                continue
            some = np.zeros(len(members), bool)
            for left, right in _owned_pairs(members, least):
                some[left] = some[right] = True
            if some.any():
                yield members[some]
    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common tokens of each pair, by products of incidence columns for tokens that repeat."""
    token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(left) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                         for i, j in zip(left, right, strict=True)], np.int64)
    _, column, count = np.unique(token, return_inverse=True, return_counts=True)
    common = count[column] > 1
    row, column = row[common], np.unique(column[common], return_inverse=True)[1]
    shared = np.zeros((len(sets), len(sets)), np.float64)
    width = 1 << 14
    for at in range(0, int(column.max(initial=-1)) + 1, width):
        some = (column >= at) & (column < at + width)
        table = np.zeros((len(sets), width), np.float32)
        table[row[some], column[some] - at] = 1
        shared += table @ table.T
    return shared[left, right].astype(np.int64)


def _verify(threshold: float, least: int):
    def linked(sets, size, left, right):
        """Of one tile's pairs, those whose tokens are alike."""
        some, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        both = _overlaps([sets[k] for k in some], at[:len(left)], at[len(left):])
        link = both >= threshold * (size[left] + size[right] - both) - 1e-9
        return left[link], right[link]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in _by_bucket(batches):
            if len(members) < 2:
                continue
            sets = [np.frombuffer(g, np.uint64) for g in members["grams"]]
            size = np.array([len(s) for s in sets], np.int64)
            copies, n = members["copies"].to_numpy(), len(members)
            links, root, held = np.zeros(n, np.int64), np.arange(n), ([], [])

            def contracted(root, held, n=n):
                return least_labels(n, np.concatenate([np.arange(n), *held[0]]),
                                    np.concatenate([root, *held[1]]))

            for left, right in _owned_pairs(members, least):
                left, right = linked(sets, size, left, right)
                np.add.at(links, left, copies[right])
                np.add.at(links, right, copies[left])
                apart = root[left] != root[right]
                held[0].append(left[apart])
                held[1].append(right[apart])
                if sum(map(len, held[0])) > LINKS:
                    root, held = contracted(root, held), ([], [])
            some = np.flatnonzero(links)
            if len(some):
                root, ids = contracted(root, held), members["set_id"].to_numpy()
                yield pd.DataFrame({"set_id": ids[some], "links": links[some], "root": ids[root[some]]})
    return run


def _leaves(sets: DataFrame, runs: int) -> DataFrame:
    """(path, set_id, n): buckets of two or more, split on sampled tokens while they are large.

    A large bucket that a sampled token keeps together for the most part holds sets that are alike;
    splitting would only copy it, so it becomes a leaf whole.
    """
    samples = [
        F.xxhash64(F.lit(k), F.get("sketch", F.lit(k))) for k in range(runs * ROOT_SAMPLES)]
    level = sets.select("set_id", F.explode(F.array(*samples)).alias("path"))
    sizes = level.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    level = staged(level.join(sizes, "path").select("path", "set_id", "n"), "buckets")
    leaves = [level.filter(F.col("n") <= SMALL_BUCKET)]
    large = level.filter(F.col("n") > SMALL_BUCKET)
    sketches = sets.select("set_id", "sketch")
    turn = [F.pmod(F.xxhash64("path", F.lit(k)), F.lit(SKETCH)).cast("int") for k in range(SPLIT_SAMPLES)]
    child = F.explode(F.array_distinct(F.array(*[
        F.xxhash64("path", t, F.get("sketch", t)) for t in turn])))
    for _ in range(MAX_SPLITS):
        if large.isEmpty():
            return union_all(leaves)
        few = large.filter(F.pmod(F.xxhash64("set_id", F.lit(1)), F.ceil(F.col("n") / ALIKE_MEMBERS)) == 0)
        parts = few.join(sketches, "set_id").select("path", child.alias("child")).groupBy(
            "path", "child").agg(F.count("*").alias("part"))
        most = parts.groupBy("path").agg(F.max("part").alias("part"))
        alike = staged(few.groupBy("path").agg(F.count("*").alias("few")).join(most, "path").filter(
            F.col("part") >= ALIKE_PART * F.col("few")).select("path"), "alike-buckets")
        leaves.append(large.join(alike, "path", "left_semi"))
        split = large.join(alike, "path", "left_anti").join(sketches, "set_id").select(
            "set_id", child.alias("path"))
        sizes = staged(split.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
        level = staged(split.join(sizes, "path").select("path", "set_id", "n"), "buckets")
        leaves.append(level.filter(F.col("n") <= SMALL_BUCKET))
        large = level.filter(F.col("n") > SMALL_BUCKET)
    return union_all([*leaves, large])


def near_duplicate_pages(raw_pages: DataFrame, threshold: float = THRESHOLD,
                         target_recall: float = TARGET_RECALL) -> DataFrame:
    """(raw_page_id, tag, class_id, n_links) of every page; alike means Jaccard >= ``threshold``.

    ``raw_pages`` has raw_page_id (any type with an order) and page_text; other columns are ignored. A page is the set of
    its runs of five words (lower case; a page of one to four words is one run). n_links counts the
    other rows at least ``threshold`` alike; class_id is the smallest raw_page_id among all rows that
    links connect; tag is a hash of the text that tells rows of one id apart.

    Pages of equal sets are one set with a number of copies. The join follows chosen paths: a set
    goes down to a bucket for each token sampled at a node (the smallest under a hash function), large
    buckets are split again on further tokens, and small ones are compared pair by pair; runs
    are repeated until a pair at the threshold is found with probability ``target_recall``, sketches
    included. Buckets of alike sets, and those that stay large, are compared whole, in blocks of 16,384. A
    pair is counted in the first bucket that it shares, sketches must look alike, and its tokens
    decide. No pairs are written: a block gives each set's number of links and one towards its component.

    A page without words (null or empty too) is alone: its own class, no links. Repeated rows link
    to each other. A null id takes part; its class is the smallest id that is not null.
    """
    return _rooted_pages(raw_pages, threshold, target_recall).drop("root")


def _rooted_pages(raw_pages: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    """``near_duplicate_pages`` with root, which tells classes of one class_id apart; null without words."""
    least = least_equal(threshold, (1 - target_recall) / 2)
    pages = keyed_text(raw_pages, "raw_page_id", "page_text").select(
        "raw_page_id", "page_text", F.xxhash64("page_text").alias("tag"))
    rows = staged(typed_ids(worded_ids(pages, "raw_page_id").mapInPandas(_make_sets, _SETS),
                            raw_page_id=raw_pages), "page-sets")
    sets = staged(
        rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(
            F.count("*").alias("copies"), F.first("sketch").alias("sketch"),
            F.min(F.struct("raw_page_id", "tag")).alias("_one")), "sets")
    leaves = staged(_leaves(sets, runs_needed(threshold, target_recall)), "leaves")
    paths = leaves.groupBy("set_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("set_id", "path"), n_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    dealt = (
        leaves.withColumn("block", block).withColumn("_other", other)
        .select("path", "set_id", "block", F.least("block", "_other").alias("block_a"),
                F.greatest("block", "_other").alias("block_b"))
        .join(paths.join(sets.select("set_id", "sketch", "copies"), "set_id"), "set_id")
    )
    key = ["path", "block_a", "block_b"]
    columns = [*key, "block", "set_id", "sketch", "paths", "copies"]
    dealt = dealt.select(*columns)
    schema = dealt.schema
    alike = staged(
        dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(_survivors(least), schema),
        "alike-sets")
    wanted = alike.select("set_id").distinct().join(sets, "set_id").select(
        "set_id", F.col("_one.raw_page_id").alias("_page"), F.col("_one.tag").alias("_tag"))
    grams = pages.join(wanted, pages["raw_page_id"].eqNullSafe(wanted["_page"])
                       & (pages["tag"] == wanted["_tag"])).select("set_id", "page_text")
    grams = grams.mapInPandas(_make_grams, _GRAMS)
    found = staged(
        alike.join(grams, "set_id").repartition(*key).sortWithinPartitions(*key)
        .mapInPandas(_verify(threshold, least), _FOUND), "links")
    linked = found.groupBy("set_id").agg(F.sum("links").alias("_links"))
    tied = components(found.select(F.col("set_id").alias("u"), F.col("root").alias("v")))
    facts = (
        rows.select("raw_page_id", "tag", "set_id")
        .join(sets.select("set_id", "copies"), "set_id", "left")
        .join(linked, "set_id", "left")
        .join(tied.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
        .withColumn("_root", F.coalesce("root", "set_id"))
    )
    least_id = facts.filter("_root IS NOT NULL").groupBy("_root").agg(
        F.min("raw_page_id").alias("_class"))
    return facts.join(least_id, "_root", "left").select(
        "raw_page_id", "tag", F.col("_root").alias("root"),
        F.when(F.col("_root").isNull(), F.col("raw_page_id")).otherwise(F.col("_class"))
        .alias("class_id"),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("_links", F.lit(0))).alias("n_links"),
    )


def one_of_each_class(raw_pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows without those that a row of smaller id in their class stands for.

    Of each class the smallest raw_page_id stays, once, with all its columns; rows without words stay.
    Rows that share an id but no class are kept each. Of a class with ids no row of null id stays; of
    one whose ids are all null one row does.
    """
    classes = staged(_rooted_pages(raw_pages, threshold, TARGET_RECALL), "page-classes")
    kept = classes.filter(F.col("class_id").eqNullSafe(F.col("raw_page_id"))).select(
        F.col("raw_page_id").alias("_page"), F.col("tag").alias("_tag"), "root", "n_links")
    linked = kept.filter("n_links > 0")
    twins = linked.groupBy("_page", "root").count().filter("count > 1").select(
        F.col("_page").alias("_twin"), F.col("root").alias("_class"))
    twin = kept["_page"].eqNullSafe(twins["_twin"]) & (kept["root"] == twins["_class"])
    found = kept.join(twins, twin, "left").select("_page", "_tag", "_class").distinct()
    # The input's own columns are carried in one, so that no name of theirs meets one of these.
    rows = raw_pages.select(F.col("raw_page_id").alias("_id"), F.xxhash64(
        F.coalesce(F.col("page_text"), F.lit(""))).alias("_tag0"), F.struct("*").alias("_all"))
    rest = rows.join(found, F.col("_id").eqNullSafe(F.col("_page")) & (F.col("_tag0") == F.col("_tag")))
    if twins.isEmpty():
        return rest.select("_all.*")
    # Some class has several rows of its smallest id: one of them stays.
    single = rest.filter("_class IS NULL")
    again = rest.filter("_class IS NOT NULL").dropDuplicates(["_id", "_class"])
    return single.unionByName(again).select("_all.*")
