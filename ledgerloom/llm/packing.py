"""Pack page texts into windows of tokens by dynamic programming over cut places (general)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ledgerloom.llm.encoding import encoder
from ledgerloom.llm.frames import keyed_text, typed_ids, worded_ids

WINDOW = 2048
END_ID = 1
# Costs in tokens of padding: a cut after a sentence, and one inside a sentence.
SENTENCE_CUT = 4
INNER_CUT = 12
# Longest way between two places where a cut may lie; a block's tokens are planned together.
STRIDE = 64
BLOCK_TOKENS = 1 << 18

SCHEMA = ("raw_page_id string, start bigint, length bigint, ids_crc32 bigint, page_tokens bigint, "
          "sequence_id bigint, seq_offset bigint")


def cut_places(ids: np.ndarray, page_ends: np.ndarray, closes: np.ndarray, stride: int
               ) -> tuple[np.ndarray, np.ndarray]:
    """(places, cost of a cut there), ascending, place 0 first and the end last."""
    end = len(ids)
    sentences = np.flatnonzero(closes[ids]) + 1
    places = np.unique(np.concatenate([[0], sentences, page_ends, [end]]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > stride)
    inner = [np.arange(places[i] + stride, places[i + 1], stride) for i in wide]
    inner = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    cost = np.full(end + 1, INNER_CUT, np.int64)
    cost[sentences] = SENTENCE_CUT
    cost[page_ends] = 0
    cost[[0, end]] = 0
    every = np.unique(np.concatenate([places, inner])).astype(np.int64)
    return every, cost[every]


def padding(length: int, window: int) -> int:
    """What a sequence of this length is padded by: nothing at a power of two."""
    return 0 if length & (length - 1) == 0 else window - length


def _unpadded(places: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """(j, i) for all places that lie a power of two, less than a window, behind another, by j."""
    later, earlier = [], []
    for k in range(window.bit_length()):
        if 1 << k < window:
            at = np.searchsorted(places, places - (1 << k))
            hit = np.flatnonzero(places[at] == places - (1 << k))
            later.append(hit)
            earlier.append(at[hit])
    j, i = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(j, kind="stable")
    return j[order].tolist(), i[order].tolist()


def plan_cuts(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Cuts from 0 to the last place, no two more than a window apart, of least total cost.

    best[j] = cost[j] + the least over the i within a window before j of best[i] + padding. But for lengths
    that are a power of two the padding is window - place[j] + place[i]: as j moves on, the i leave on
    one side and enter on the other, so a queue whose values of best[i] + place[i] rise from its head
    gives that minimum in constant time. The few powers of two are looked at one by one. Ties go
    to the longer sequence.
    """
    at, fee = places.tolist(), costs.tolist()
    value = [0] * len(at)
    came = [0] * len(at)
    later, earlier = _unpadded(places, window)
    later.append(len(at))
    queue, pair = deque([0]), 0
    for j in range(1, len(at)):
        place = at[j]
        while at[queue[0]] < place - window:
            queue.popleft()
        i = queue[0]
        # value holds best[j] + place[j]
        mine = window + value[i]
        while later[pair] == j:
            other = earlier[pair]
            pair += 1
            without = value[other] - at[other] + place
            if without < mine:
                i, mine = other, without
        came[j] = i
        mine = value[j] = mine + fee[j]
        while queue and value[queue[-1]] > mine:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


def _by_powers(cuts: list[int], window: int) -> list[int]:
    """The ends of the last sequence, or of its parts of powers of two where cutting costs less than padding."""
    begin, end = [0, *cuts][-2:]
    sizes = [1 << k for k in range(window.bit_length()) if (end - begin) >> k & 1][::-1]
    if INNER_CUT * (len(sizes) - 1) >= padding(end - begin, window):
        return [end]
    return (begin + np.cumsum(sizes)).tolist()


class _Block:
    """Tokens of whole pages in order, waiting to be cut; the first page may have begun earlier."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.pages: list[tuple[object, int, int]] = []  # id, tokens of the page, its start here
        self.size = 0

    def add(self, page: object, ids: np.ndarray, total: int, start: int) -> None:
        self.ids.append(ids)
        self.pages.append((page, total, start))
        self.size += len(ids)


def _pieces(block: _Block, closes, window, number: Iterator[int], last: bool):
    """Rows of all windows but the unfinished one, and the block of what is left."""
    ids = np.concatenate(block.ids)
    ends = np.cumsum([len(x) for x in block.ids])
    places, costs = cut_places(ids, ends, closes, STRIDE)
    cuts = plan_cuts(places, costs, window)
    cuts = cuts[:-1] + (_by_powers(cuts, window) if last else [])
    rows, begin, k = [], 0, 0
    page_begin = np.concatenate([[0], ends[:-1]])
    for cut in cuts:
        sequence, at = next(number), begin
        while at < cut:
            stop = min(cut, int(ends[k]))
            page, total, start = block.pages[k]
            rows.append((page, start + at - int(page_begin[k]), stop - at,
                         zlib.crc32(ids[at:stop].tobytes()), total, sequence, at - begin))
            at = stop
            k += at == ends[k]
        begin = cut
    rest = _Block()
    for i in range(k, len(block.pages)):
        page, total, start = block.pages[i]
        skip = max(0, begin - int(page_begin[i]))
        rest.add(page, block.ids[i][skip:], total, start + skip)
    return rows, rest


def _pack(tokenizer_path: str, window: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from itertools import count

        encode = encoder(tokenizer_path)
        closes = encode.ends_sentence()
        if end_id >= len(closes):
            closes = np.append(closes, np.zeros(end_id + 1 - len(closes), bool))
        number = count(TaskContext.get().partitionId() << 36)
        end, block, rows = np.array([end_id], "<u4"), _Block(), []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for page, text in zip(batch["raw_page_id"], batch["page_text"], strict=True):
                ids = np.concatenate([encode.encode(text), end])
                block.add(page, ids, len(ids), 0)
                if block.size >= BLOCK_TOKENS:
                    rows, block = _pieces(block, closes, window, number, last=False)
                    yield pd.DataFrame(rows, columns=names)
        if block.size:
            rows, _ = _pieces(block, closes, window, number, last=True)
            yield pd.DataFrame(rows, columns=names)
    return run


def pack_pages(raw_pages: DataFrame, tokenizer_path: str, window: int = WINDOW,
               end_id: int = END_ID) -> DataFrame:
    """Pieces of all pages in sequences of at most ``window`` tokens, pages kept in table order.

    ``raw_pages`` has raw_page_id (any type) and page_text; other columns are ignored. A page is the ids of
    its text without special tokens, then ``end_id``. Each partition is a run of pages; its cut
    places are page ends, sentence ends, and steps of 64 tokens through longer sentences. Sequences
    are chosen to make padding (to the window, none at a power of two) plus the fees for cut pages
    least; a partition's last one is dealt into powers of two where that is cheaper. Every id lies in one
    piece.

    Result: raw_page_id, start (ids of the page before the piece), length, ids_crc32 (of the
    little-endian unsigned 32-bit ids), page_tokens, sequence_id, seq_offset.

    Null or empty text is a page of ``end_id`` alone; repeated rows are packed each; a null id
    is kept as null; an empty table gives no piece. Nothing is shuffled, a task holds one
    block of tokens and one text, and a retried task makes the same pieces from the same rows.
    """
    pages = worded_ids(keyed_text(raw_pages, "raw_page_id", "page_text"), "raw_page_id")
    return typed_ids(pages.mapInPandas(_pack(tokenizer_path, window, end_id), SCHEMA),
                     raw_page_id=raw_pages)
