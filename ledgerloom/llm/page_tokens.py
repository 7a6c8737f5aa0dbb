"""Token counts of page text, with huge texts encoded in overlapping chunks (general: any text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.encoding import GUARD_CHARS, encoder
from ledgerloom.llm.frames import keyed_text, staged, typed_ids, union_all, worded_ids

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
_FRAME_CHARS = 1 << 22

_CHUNK = ("raw_page_id string, row_no bigint, chunk_no int, is_last boolean, step int, "
          "overlap int, chunk_text string")
_MARKS = ("raw_page_id string, row_no bigint, chunk_no int, is_last boolean, step int, "
          "overlap int, head_at array<int>, head_tokens array<int>, tail_at array<int>, "
          "tail_tokens array<int>, n_tokens bigint")


def _count_short(tokenizer_path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for rows in batches:
            yield pd.DataFrame({
                "raw_page_id": rows["raw_page_id"],
                "n_bytes": rows["n_bytes"],
                "n_tokens": [encode.count(t) for t in rows["page_text"]],
            })
    return run


def _cut(step: int, overlap: int):
    """Chunks of a text: chunk k starts at k * step and reaches ``overlap`` beyond the next start."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, out, held = [c.split()[0] for c in _CHUNK.split(", ")], [], 0
        for rows in batches:
            for page, row, text in zip(rows["raw_page_id"], rows["row_no"], rows["page_text"],
                                       strict=True):
                last = max(0, -(-(len(text) - overlap) // step) - 1)
                for k in range(last + 1):
                    end = len(text) if k == last else (k + 1) * step + overlap
                    chunk = text[k * step:end]
                    out.append((page, row, k, k == last, step, overlap, chunk))
                    held += len(chunk)
                    if held >= _FRAME_CHARS:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)
    return run


def _encode_chunks(tokenizer_path: str):
    """Piece starts with the tokens before them, in both overlaps of a chunk, and its token count."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                at, before = encode.boundaries(r.chunk_text)
                # The first chunk starts where the text does; any other start may be inside a
                # piece. What ends near a cut end may read differently in the whole text.
                head = at[:-1] <= r.overlap
                tail = (at[:-1] >= r.step) & (at[:-1] <= len(r.chunk_text) - GUARD_CHARS)
                if len(at) > 1:
                    tail[-1] = False
                out.append((r.raw_page_id, r.row_no, r.chunk_no, r.is_last, r.step, r.overlap,
                            at[:-1][head], before[:-1][head], at[:-1][tail] - r.step,
                            before[:-1][tail], int(before[-1])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MARKS.split(", ")])
    return run


def _splice(marks: DataFrame) -> DataFrame:
    """Per text: the spliced count, or null where two neighbours share no proven boundary.

    A neighbour's two readings agree on everything after a start that both have, so the earliest
    such start in the overlap is taken. It must not lie before the point where the left chunk was
    itself spliced, which holds as starts and overlaps of one chunk never meet.
    """
    left = marks.filter(~F.col("is_last")).select(
        "raw_page_id", "row_no", (F.col("chunk_no") + 1).alias("chunk_no"),
        "tail_at", "tail_tokens",
    )
    seams = marks.join(left.withColumnsRenamed({"tail_at": "l_at", "tail_tokens": "l_tokens"}),
                       ["raw_page_id", "row_no", "chunk_no"], "left")
    common = F.array_min(F.array_intersect("head_at", "l_at"))
    own = F.get("head_tokens", (F.array_position("head_at", common) - 1).cast("int"))
    other = F.get("l_tokens", (F.array_position("l_at", common) - 1).cast("int"))
    # A text's tokens: those of its last chunk, and at every seam what the left neighbour has
    # before it less what the right one has before it.
    seams = seams.withColumns({"_own": own, "_other": other})
    return seams.groupBy("raw_page_id", "row_no").agg(
        F.sum(F.when(F.col("is_last"), F.col("n_tokens")).otherwise(0)
              + F.coalesce(F.col("_other") - F.col("_own"), F.lit(0))).alias("n_tokens"),
        F.count_if((F.col("chunk_no") > 0) & F.col("_other").isNull()).alias("_open"),
    )


def count_page_tokens(
    raw_pages: DataFrame, tokenizer_path: str, chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Tokens of every page text: (raw_page_id, n_bytes, n_tokens), one row per input row.

    ``raw_pages`` has raw_page_id (any type) and page_text; other columns are ignored. Texts of at most
    ``chunk_chars`` are encoded at once. A longer one is cut into chunks that overlap by
    ``overlap_chars``; chunks are dealt over all tasks and encoded with offsets. Neighbours are
    spliced at the first place in the overlap where both readings begin a piece: pieces are split
    from left to right without memory, and no merge crosses them, so from there on both read the
    same. Texts with a seam that shares no such place are cut again with twice the overlap, until
    every seam is spliced or a single chunk holds the text.

    Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated rows; a null id is
    kept. An empty table gives an empty table.
    """
    pages = worded_ids(keyed_text(raw_pages, "raw_page_id", "page_text"), "raw_page_id").withColumn(
        "n_bytes", F.octet_length("page_text").cast("bigint"))
    size = F.length("page_text")
    schema = "raw_page_id string, n_bytes bigint, n_tokens bigint"
    short = pages.filter(size <= chunk_chars).mapInPandas(_count_short(tokenizer_path), schema)
    long = pages.filter(size > chunk_chars)
    if long.isEmpty():
        return typed_ids(short, raw_page_id=raw_pages)
    # Row numbers keep repeated rows apart; the stage fixes them.
    long = staged(long.withColumn("row_no", F.monotonically_increasing_id()), "long-texts")
    done, open_texts, step, overlap = [], long, chunk_chars, overlap_chars
    while True:
        cut = open_texts.select("raw_page_id", "row_no", "page_text").mapInPandas(
            _cut(step, overlap), _CHUNK)
        marks = staged(
            cut.repartition("raw_page_id", "row_no", "chunk_no")
            .mapInPandas(_encode_chunks(tokenizer_path), _MARKS), "chunk-marks")
        spliced = staged(_splice(marks), "spliced")
        sizes = open_texts.select("row_no", "raw_page_id", "n_bytes")
        done.append(
            sizes.join(spliced.filter("_open = 0").select("row_no", "n_tokens"), "row_no")
            .select("raw_page_id", "n_bytes", "n_tokens"))
        left = spliced.filter("_open > 0").select("row_no")
        if left.isEmpty():
            break
        overlap *= 2
        step = max(step, overlap)
        open_texts = staged(open_texts.join(left, "row_no", "left_semi"), "open-texts")
    return typed_ids(union_all([short, *done]), raw_page_id=raw_pages)
