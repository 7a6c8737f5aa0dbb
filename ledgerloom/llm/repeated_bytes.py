"""Remove page bytes that a long byte string covers which also stands elsewhere (general)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import keyed_text, staged, text_batches, typed_ids, union_all, worded_ids
from ledgerloom.llm.suffixes import repeated_windows

WIDTH = 400
GRAM = 32
SHARD_BYTES = 1 << 20
# Keys with more different pieces than this are split by more of what surrounds the gram.
CROWD = 1024

_SLACK = WIDTH - GRAM
_HALF = _SLACK // 2
_BLOCK = 1 << 20
_PLACE_BITS = 22

_PIECES = ("key bigint, digest bigint, raw_page_id string, tag bigint, start bigint, "
           "n_windows int, gram_at int")
_SEGMENTS = ("key bigint, digest bigint, raw_page_id string, tag bigint, start bigint, "
             "n_windows int, gram_at int, low int, high int, lone boolean, segment binary")
_COVERED = "raw_page_id string, tag bigint, begin bigint, stop bigint"
_RESULT = ("raw_page_id string, n_bytes bigint, n_removed bigint, n_spans bigint, "
           "kept_sha256 string")


def _arrow_schema(columns: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at every place, by doubling."""
    code = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(31)
    factor, span = 0xD6E8FEB86659FD93, 1
    while span < GRAM:
        code = code[:-span] * np.uint64(factor) + code[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(29))


def _window_grams(data: np.ndarray) -> np.ndarray:
    """For every window of 400 bytes, the place of its gram of smallest hash, leftmost of equals."""
    code = _gram_hashes(data)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (code & ~low) | np.arange(len(code), dtype=np.uint64)
    grams, span = _SLACK + 1, 1
    while span * 2 <= grams:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if grams > span:
        best = np.minimum(best[:-(grams - span)], best[grams - span:])
    return (best & low).astype(np.int64)


def _hash(view, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(view, seed)


def window_pieces(data: np.ndarray, valid: np.ndarray):
    """Runs of neighbouring windows that share gram and side: (start, windows, gram place, key, digest).

    A window's gram lies in its left or right half; with the gram, the windows of a run share 184
    more bytes on one side. These are the key, so equal windows always have equal keys.
    """
    gram = _window_grams(data)
    starts = np.arange(len(gram))
    right = (gram - starts) < _HALF
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (right[1:] != right[:-1]) | (valid[1:] != valid[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(gram))
    begin, stop = begin[valid[begin]], stop[valid[begin]]
    place = gram[begin]
    at_right = right[begin]
    common = np.where(at_right, place, place - _HALF)
    common_end = np.where(at_right, place - (_HALF - 1) + WIDTH, place - _SLACK + WIDTH)
    view = memoryview(np.ascontiguousarray(data))
    key = [_hash(view[a:b], 1 + s) for a, b, s in
           zip(common.tolist(), common_end.tolist(), at_right.tolist(), strict=True)]
    digest = [_hash(view[a:b], 3) for a, b in
              zip(begin.tolist(), (stop + WIDTH - 1).tolist(), strict=True)]
    return (begin, stop - begin, place - begin,
            np.array(key, np.uint64).view(np.int64), np.array(digest, np.uint64).view(np.int64))


def _emit_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema(_PIECES)
    for rows, data, at in text_batches(batches, _BLOCK):
        page, tag = rows.column("raw_page_id"), rows.column("tag")
        owners = np.repeat(np.arange(len(at) - 1), np.diff(at))
        room = np.repeat(at[1:], np.diff(at)) - WIDTH - np.arange(len(data)) >= 0
        for first in range(0, max(1, len(data)), _BLOCK):
            some = data[first:first + _BLOCK + WIDTH - 1]
            if len(some) < WIDTH:
                continue
            n = len(some) - WIDTH + 1
            owner, valid = owners[first:first + n], room[first:first + n]
            if not valid.any():
                continue
            begin, many, gram_at, key, digest = window_pieces(some, valid)
            row = owner[begin]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                pa.array(key), pa.array(digest), page.take(take), tag.take(take),
                pa.array(begin + first - at[row]), pa.array(many.astype(np.int32)),
                pa.array(gram_at.astype(np.int32)),
            ], schema=schema)


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted piece of a page."""
    schema = _arrow_schema(_SEGMENTS)
    for rows, data, at in text_batches(batches, 1 << 18):
        view, out = memoryview(np.ascontiguousarray(data)), []
        pages, tags, wanted = (rows.column(n).to_pylist() for n in ("raw_page_id", "tag", "wanted"))
        for number, (page, tag, pieces) in enumerate(zip(pages, tags, wanted, strict=True)):
            for p in pieces:
                a = int(at[number]) + p["start"]
                left = p["gram_at"] >= _HALF
                out.append((p["key"], p["digest"], page, tag, p["start"], p["n_windows"],
                            p["gram_at"], _HALF if left else 0, _SLACK if left else _HALF - 1,
                            p["lone"], bytes(view[a:a + p["n_windows"] + WIDTH - 1])))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)],
                schema=schema)


def _halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece cut by where its gram stands in the window, keyed by all that its windows share."""
    schema = _arrow_schema(_SEGMENTS)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            middle = (r["low"] + r["high"]) // 2
            highest, segment = r["gram_at"], r["segment"]
            lowest = highest - r["n_windows"] + 1
            for low, high in ((middle + 1, r["high"]), (r["low"], middle)):
                top, bottom = min(high, highest), max(low, lowest)
                if top < bottom or low > high:
                    continue
                skip = highest - top
                piece = segment[skip:highest - bottom + WIDTH]
                shared = segment[highest - low:highest - high + WIDTH]
                key = _hash(shared, 8 + low * WIDTH + high)
                out.append((_signed(key), _signed(_hash(piece, 3)), r["raw_page_id"], r["tag"],
                            r["start"] + skip, top - bottom + 1, top, low, high, r["lone"], piece))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)],
                schema=schema)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole keys, a bounded number of bytes at a time; rows come by key."""
    schema = _arrow_schema(_COVERED)

    def close(shard: list[tuple]) -> pa.RecordBatch | None:
        text = np.frombuffer(b"\xff".join(r[5] for r in shard), np.uint8)
        found = repeated_windows(text, WIDTH)
        out, at = [], 0
        for page, tag, start, many, lone, segment in shard:
            hits = np.flatnonzero(found[at:at + many]) if lone else ()
            if len(hits):
                edge = np.flatnonzero(np.diff(hits) > 1)
                for a, b in zip(hits[np.append(0, edge + 1)], hits[np.append(edge, len(hits) - 1)],
                                strict=True):
                    out.append((page, tag, start + int(a), start + int(b) + WIDTH))
            at += len(segment) + 1
        if not out:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)],
            schema=schema)

    shard: list[tuple] = []
    group: list[tuple] = []
    held, last = 0, None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in
                   ("key", "raw_page_id", "tag", "start", "n_windows", "lone", "segment")]
        for key, *row in zip(*columns, strict=True):
            if key != last:
                if len(group) > 1:
                    shard += group
                    held += sum(len(r[5]) for r in group)
                group, last = [], key
                if held >= SHARD_BYTES:
                    if (done := close(shard)) is not None:
                        yield done
                    shard, held = [], 0
            group.append(tuple(row))
    if len(group) > 1:
        shard += group
    if shard and (done := close(shard)) is not None:
        yield done


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema(_RESULT)
    for rows, data, at in text_batches(batches):
        view, out = memoryview(np.ascontiguousarray(data)), []
        ranges = rows.column("covered").to_pylist()
        for number, (page, covered) in enumerate(
                zip(rows.column("raw_page_id").to_pylist(), ranges, strict=True)):
            text = view[at[number]:at[number + 1]]
            digest, done, removed, spans = hashlib.sha256(), 0, 0, 0
            for r in sorted(covered or (), key=lambda r: r["begin"]):
                if r["stop"] <= done:
                    continue
                # A run that only touches the one before it is part of it.
                spans += r["begin"] > done or spans == 0
                digest.update(text[done:max(done, r["begin"])])
                removed += r["stop"] - max(done, r["begin"])
                done = r["stop"]
            digest.update(text[done:])
            out.append((page, len(text), removed, spans, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)],
            schema=schema)


def _spans(pieces: DataFrame) -> DataFrame:
    """The bytes under all windows of a piece."""
    return pieces.select("raw_page_id", "tag", F.col("start").alias("begin"),
                         (F.col("start") + F.col("n_windows") + (WIDTH - 1)).alias("stop"))


def _settle(segments: DataFrame) -> list[DataFrame]:
    """Covered ranges of pieces that share keys but not all their bytes."""
    covered = []
    while True:
        crowded = segments.groupBy("key").agg(F.count("*").alias("_n")).filter(
            F.col("_n") > CROWD).select("key")
        crowded = staged(crowded, "crowded-keys")
        calm = segments.join(crowded, "key", "left_anti")
        covered.append(
            calm.select(*[c.split()[0] for c in _SEGMENTS.split(", ")])
            .repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards, _COVERED))
        if crowded.isEmpty():
            return covered
        halves = staged(
            segments.join(crowded, "key", "left_semi")
            .select(*[c.split()[0] for c in _SEGMENTS.split(", ")]).mapInArrow(_halve, _SEGMENTS),
            "halved-pieces")
        # Pieces that have become equal cover each other; one of them stays for the others.
        # Staged, so that the join's two sides are plain exchanges and a hot piece's side can be split.
        equal = staged(halves.groupBy("key", "digest").agg(
            F.count("*").alias("_n"),
            F.min(F.struct("raw_page_id", "tag", "start")).alias("_one")), "equal-pieces")
        joined = halves.join(equal, ["key", "digest"])
        covered.append(_spans(joined.filter((F.col("_n") > 1) & F.col("lone"))))
        own = F.struct("raw_page_id", "tag", "start")
        segments = staged(
            joined.filter(own.eqNullSafe(F.col("_one")))
            .withColumn("lone", F.col("lone") & (F.col("_n") == 1)).drop("_n", "_one")
            # Repeated rows still give the same piece more than once.
            .dropDuplicates(["key", "digest"]),
            "halved-segments")


def remove_repeated_bytes(raw_pages: DataFrame) -> DataFrame:
    """Every page without the bytes under a 400-byte string that also starts anywhere else.

    ``raw_pages`` has raw_page_id (any type) and page_text; other columns are ignored. Texts are judged as
    UTF-8 bytes, on the input; matches never cross pages, overlaps in one page count. Returns
    raw_page_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of what is
    left, joined), one row per input row.

    Windows of 400 bytes are grouped by their gram of smallest hash and the 184 bytes beside it.
    Pieces (neighbouring windows of one group) whose group has no other, or only equal ones,
    are settled by counting. The others are dealt over shards by group, and each shard's suffix
    array, by induced sorting, and its permuted common prefixes tell which windows repeat. A group
    of more than 1024 different pieces is halved by where the gram stands until it is smaller;
    at the last halving all its pieces are equal, so no group is gathered without bound.

    Null text counts as empty; a text under 400 bytes loses nothing; repeated rows are copies
    of each other and lose all from 400 bytes on; a null id is kept; an empty table gives none.
    """
    pages = worded_ids(keyed_text(raw_pages, "raw_page_id", "page_text"), "raw_page_id").select(
        "raw_page_id", "page_text",
        # Tells rows of one id with different texts apart.
        F.xxhash64("page_text").alias("tag"))
    pieces = staged(pages.mapInArrow(_emit_pieces, _PIECES), "window-pieces")
    # Staged, so that the join's two sides are plain exchanges and a hot key's side can be split.
    groups = staged(pieces.groupBy("key").agg(
        F.count("*").alias("_n"), F.min("digest").alias("_low"), F.max("digest").alias("_high"),
    ).filter("_n > 1").select("key", (F.col("_low") == F.col("_high")).alias("_equal")), "window-groups")
    shared = staged(pieces.join(groups, "key"), "shared-pieces")
    covered = [_spans(shared.filter("_equal"))]
    mixed = shared.filter("NOT _equal")
    kinds = mixed.groupBy("key", "digest").agg(
        F.count("*").alias("_n"),
        F.min(F.struct("raw_page_id", "tag", "start", "n_windows", "gram_at")).alias("_one"))
    many = kinds.filter("_n > 1").select("key", "digest")
    covered.append(_spans(mixed.join(many, ["key", "digest"], "left_semi")))
    wanted = kinds.select("key", "digest", "_one.*", (F.col("_n") == 1).alias("lone")).groupBy(
        F.col("raw_page_id").alias("_page"), F.col("tag").alias("_tag")).agg(
        F.collect_list(F.struct("key", "digest", "start", "n_windows", "gram_at", "lone"))
        .alias("wanted"))

    def beside(found: DataFrame, how: str) -> DataFrame:
        return pages.join(found, pages["raw_page_id"].eqNullSafe(found["_page"])
                          & (pages["tag"] == found["_tag"]), how)

    # Repeated rows all give their bytes; their pieces are not lone, so they only answer others.
    segments = staged(
        beside(wanted, "inner").select("raw_page_id", "tag", "page_text", "wanted")
        .mapInArrow(_cut_segments, _SEGMENTS), "segments")
    covered += _settle(segments)
    ranges = union_all(covered).groupBy(
        F.col("raw_page_id").alias("_page"), F.col("tag").alias("_tag")).agg(
        F.collect_set(F.struct("begin", "stop")).alias("covered"))
    kept = beside(ranges, "left").select("raw_page_id", "page_text", "covered").mapInArrow(
        _remove, _RESULT)
    return typed_ids(kept, raw_page_id=raw_pages)
