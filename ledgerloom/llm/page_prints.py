"""Pages of nearly equal SimHash fingerprints, linked by searches of BK-trees in shards."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bk_trees import grow_trees, linked_labels
from ledgerloom.llm.components import components
from ledgerloom.llm.frames import keyed_text, staged, union_all

SHINGLE = 3
SEED = 42
RADIUS = 3
# Prints of one shard's tree. A larger bucket is cut on more bits, then into trees of this size.
TREE_PRINTS = 1 << 15
PIECE = 1 << 20

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LINKED = "print bigint, root bigint"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text cut at blanks into pieces of about ``PIECE`` bytes."""
    first = 0
    while len(text) - first > PIECE:
        cut = _BLANK.search(text, first + PIECE)
        if cut is None:
            break
        yield text[first:cut.start()]
        first = cut.end()
    yield text[first:]


def _shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of all three-word shingles, repeats included; of all words where they are fewer."""
    digest, held, whole = xxhash.xxh64_intdigest, [], True
    for piece in _pieces(text):
        words = held + piece.lower().split()
        if len(words) >= SHINGLE:
            whole = False
            a, b = iter(words), iter(words[1:])
            yield np.fromiter((digest(b"%b %b %b" % three, SEED) for three in zip(a, b, words[2:])),
                              np.uint64)
        held = words[-(SHINGLE - 1):]
    if whole and held:
        yield np.array([digest(b" ".join(held), SEED)], np.uint64)


def page_print(text: bytes) -> int:
    """The fingerprint of a text: a bit is 1 where over half of its shingles' hashes have it."""
    n, ones = 0, np.zeros(64, np.int64)
    for hashes in _shingle_hashes(text):
        for a in range(0, len(hashes), 1 << 14):
            part = hashes[a:a + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found = np.array([page_print(t.as_buffer().to_pybytes())
                          for t in rows.column("page_text").cast(pa.large_binary())], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [rows.column("raw_page_id"), pa.array(found.view(np.int64), pa.int64())],
            names=["raw_page_id", "print"])


def _quarters(mask: int, parts: int = RADIUS + 1) -> list[int]:
    """The free bits of a mask dealt into so many runs, each added to the mask.

    Two words that agree in the mask and differ in at most ``RADIUS`` bits agree in one of the runs too.
    """
    free = [k for k in range(64) if not mask >> k & 1]
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _under(prints: DataFrame) -> DataFrame:
    """With held, the bits of each print that its mask shows."""
    return prints.withColumn("held", F.col("print").bitwiseAND(F.col("mask")))


def _sizes_over(level: DataFrame) -> DataFrame:
    sizes = level.groupBy("mask", "held").agg(F.count("*").alias("n"))
    return staged(sizes.filter(F.col("n") > TREE_PRINTS), "large-buckets")


def _single_trees(level: DataFrame, sizes: DataFrame) -> DataFrame:
    return level.join(sizes, ["mask", "held"], "left_anti").select(
        "mask", "held", F.lit(0).alias("tree"), F.lit(0).alias("asked"), "print",
        F.lit(True).alias("node"))


def _shards(prints: DataFrame) -> DataFrame:
    """(mask, held, tree, asked, print, node): buckets that hold every pair within the radius.

    A bucket is all prints that agree in the bits of a mask: first a quarter of the 64 bits, and where
    more than ``TREE_PRINTS`` agree, a quarter of the rest as well, twice at most. One still larger
    is dealt into several trees, and its prints are asked of each: rows with ``node`` are a tree's own.
    """
    masks = _quarters(0)
    every = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    level = staged(_under(prints.select("print", every.alias("mask"))), "print-buckets")
    sizes = _sizes_over(level)
    out = [_single_trees(level, sizes)]
    for _ in range(2):
        if sizes.isEmpty():
            break
        large = level.join(sizes.select("mask", "held"), ["mask", "held"], "left_semi")
        finer = F.create_map(*[x for m in masks for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in _quarters(m)]))])
        masks = [x for m in masks for x in _quarters(m)]
        # Two masks may have a finer one in common.
        level = staged(
            _under(large.select("print", F.explode(finer[F.col("mask")]).alias("mask")).distinct()),
            "print-buckets")
        sizes = _sizes_over(level)
        out.append(_single_trees(level, sizes))
    if not sizes.isEmpty():
        trees = F.ceil(F.col("n") / TREE_PRINTS).cast("int")
        own = F.pmod(F.xxhash64("print"), trees).cast("int")
        dealt = level.join(sizes, ["mask", "held"]).withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0), trees - 1)))
        # A print is a node of its own tree, and goes as a query to the trees before it.
        out.append(dealt.filter("other <= own").select(
            "mask", "held", F.col("other").alias("tree"), F.col("own").alias("asked"), "print",
            (F.col("other") == F.col("own")).alias("node")))
        out.append(dealt.filter("other > own").select(
            "mask", "held", F.col("own").alias("tree"), F.col("other").alias("asked"), "print",
            F.lit(True).alias("node")))
    return union_all(out)


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows of whole shards, at least ``TREE_PRINTS`` together; batches come ordered by shard."""
    names = ("mask", "held", "tree", "asked")
    kept: list[dict] = []
    size = 0

    def joined():
        return {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append({k: batch.column(k).to_numpy(zero_copy_only=False)
                     for k in (*names, "print", "node")})
        size += batch.num_rows
        if size < TREE_PRINTS:
            continue
        rows = joined()
        new = np.zeros(size, bool)
        for k in names:
            new[1:] |= rows[k][1:] != rows[k][:-1]
        last = np.flatnonzero(new)
        if not len(last):
            kept = [rows]
            continue
        yield {k: v[:last[-1]] for k, v in rows.items()}
        kept = [{k: v[last[-1]:] for k, v in rows.items()}]
        size -= int(last[-1])
    if kept:
        yield joined()


def _linked(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_shards(batches):
            new = np.zeros(len(rows["print"]), bool)
            for k in ("mask", "held", "tree", "asked"):
                new[1:] |= rows[k][1:] != rows[k][:-1]
            shard, points = np.cumsum(new), rows["print"].view(np.uint64)
            # A shard that has queries of another tree is searched by them; else by its own points.
            foreign = rows["tree"] != rows["asked"]
            for own, some in ((True, ~foreign), (False, foreign)):
                node = some & rows["node"]
                if not node.any():
                    continue
                number = np.unique(shard[node], return_inverse=True)[1]
                trees = grow_trees(points[node], number, radius)
                if own:
                    queries, of = points[node], number
                else:
                    ask = some & ~rows["node"]
                    known = np.unique(shard[node])
                    ask &= np.isin(shard, known)
                    queries, of = points[ask], np.searchsorted(known, shard[ask])
                label = linked_labels(trees, queries, of, radius, own)
                every = points[node] if own else np.concatenate([points[node], queries])
                tied = np.flatnonzero(label != np.arange(len(label)))
                if len(tied):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every[tied].view(np.int64)), pa.array(every[label[tied]].view(np.int64))],
                        names=["print", "root"])
    return run


def alike_prints(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, root): links, enough of them to connect all distinct prints within ``radius`` bits."""
    shard = ["mask", "held", "tree", "asked"]
    rows = _shards(prints).repartition(*shard).sortWithinPartitions(*shard)
    return rows.mapInArrow(_linked(radius), _LINKED)


def near_print_pages(raw_pages: DataFrame) -> DataFrame:
    """(raw_page_id, fingerprint, component_id) of every page.

    ``raw_pages`` has raw_page_id, of any type with an order, and page_text; other columns are ignored.
    A-Z become lower case; words are runs without blank, tab, line feed, vertical tab, form feed and
    carriage return; a shingle is three words, repeats count, and a page of one or two words is a single
    shingle of them. A bit of the fingerprint is 1 where more than half of the shingles' XXH64 (seed 42)
    have it. Fingerprints of three or fewer differing bits are linked; component_id is the smallest
    raw_page_id that links reach.

    A page without words (null and empty text too) has fingerprint zero and is linked like any other.
    Repeated rows each come back. A null id takes part; a component of null ids only has a null
    component_id. An empty table gives an empty result.

    Distinct prints are looked up in BK-trees, one for each bucket of prints that agree in 16 of the 64
    bits: prints three bits apart agree in one quarter at least, so every link lies in some
    bucket. A search follows only edges within the radius of its distance. The trees go to the tasks of
    their own queries by a shuffle: a broadcast would bring every print through the driver.
    """
    id_field = T.StructField("raw_page_id", raw_pages.schema["raw_page_id"].dataType)
    schema = T.StructType([id_field, T.StructField("print", T.LongType())])
    pages = staged(keyed_text(raw_pages, "raw_page_id", "page_text").mapInArrow(_prints, schema),
                   "page-prints")
    prints = staged(pages.groupBy("print").agg(F.min("raw_page_id").alias("_least")), "prints")
    tied = components(alike_prints(prints.select("print")).select(
        F.col("print").alias("u"), F.col("root").alias("v")))
    rooted = staged(prints.join(tied.withColumnRenamed("node", "print"), "print", "left").select(
        "print", F.coalesce("root", "print").alias("_root"), "_least"), "rooted-prints")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"))
    known = staged(rooted.join(least, "_root").select("print", "component_id"), "print-components")
    return pages.join(known, "print").select(
        "raw_page_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
