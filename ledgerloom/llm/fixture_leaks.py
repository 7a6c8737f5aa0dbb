"""Pages that hold the text of a fixture, up to a budget of edits: q-gram lemma and alignment."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import keyed_text, typed_ids, union_all, worded_ids

Q = 10
ERROR_RATE = 0.08
MIN_FIXTURE_BYTES = 40
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20

_FILTER_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = "raw_page_id string, fixture_id string, edits int"


def plain_text(text: str) -> str:
    """Lower case, each run of white space as one blank."""
    return " ".join(text.lower().split())


def plain_bytes(text: str) -> bytes:
    return plain_text(text).encode()


def edit_budget(length: int, q: int = Q, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed for a fixture of so many bytes; at least one q-gram must survive them all."""
    return max(0, min(int(error_rate * length), (length - q) // q))


def gram_codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of the ten bytes at every place (eight taken whole, two mixed in)."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    wide = data.astype(np.uint64)
    two = wide[:-1] | (wide[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return (eight[:-2] * _MIX) ^ (two[8:] * np.uint64(0xC2B2AE3D27D4EB4F))


class FixtureIndex:
    """The q-grams of a bounded slice of fixtures, sorted, behind a bit filter."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, self.texts = ids, texts
        lengths = np.array([len(t) for t in texts], np.int64)
        self.budget = np.array([edit_budget(n) for n in lengths], np.int64)
        self.least = lengths - Q + 1 - Q * self.budget
        self.lengths = lengths
        # Bands overlap by half, so the hits of one match, whose diagonals differ by at most the
        # budget, lie together in at least one band.
        self.band = int(self.budget.max(initial=0)) + 1
        codes = [gram_codes(np.frombuffer(t, np.uint8)) for t in texts]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.code = code[order]
        self.item = np.repeat(np.arange(len(texts)), [len(c) for c in codes])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in codes] or [np.zeros(0, int)])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.code >> np.uint64(64 - _FILTER_BITS)] = True

    def regions(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(fixture, band) pairs with enough shared q-grams in one diagonal band."""
        code = gram_codes(data)
        at = np.flatnonzero(self.filter[code >> np.uint64(64 - _FILTER_BITS)])
        first = np.searchsorted(self.code, code[at], "left")
        many = np.searchsorted(self.code, code[at], "right") - first
        at, first, many = at[many > 0], first[many > 0], many[many > 0]
        if not len(at):
            return []
        entry = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        item = self.item[entry]
        diagonal = np.repeat(at, many) - self.place[entry] + int(self.lengths.max())
        band = diagonal // self.band
        key = item * (1 << 40) + band
        key, count = np.unique(np.concatenate([key, key - (band > 0)]), return_counts=True)
        kept = key[count >= self.least[key >> 40]]
        return [(int(k >> 40), int(k & ((1 << 40) - 1))) for k in kept]

    def verify(self, data: bytes, fixture: int, band: int) -> int | None:
        """Fewest edits of the fixture against text on the diagonals of a band, if in budget."""
        text, budget = self.texts[fixture], int(self.budget[fixture])
        low = band * self.band - int(self.lengths.max())
        low, width = low - budget, 2 * self.band + 2 * budget + 1
        begin = max(0, low)
        if data.find(text, begin, low + width + len(text)) >= 0:
            return 0
        edits = banded_edits(text, data, low, width)
        return edits if edits <= budget else None


def banded_edits(text: bytes, data: bytes, low: int, width: int) -> int:
    """Fewest edits between all of ``text`` and any stretch of ``data``, on a band of diagonals.

    Diagonal k of the band pairs text[i] with data[i + low + k]. A stretch may start on any.
    """
    padded = np.full(len(text) + width, 256, np.int64)
    begin, end = max(0, low), min(len(data), low + len(text) + width)
    if begin < end:
        padded[begin - low:end - low] = np.frombuffer(data[begin:end], np.uint8)
    far = len(text) + 1
    steps = np.arange(width)
    best = np.zeros(width, np.int64)
    for i, byte in enumerate(text):
        mixed = best + (padded[i:i + width] != byte)
        mixed[:-1] = np.minimum(mixed[:-1], best[1:] + 1)
        best = np.minimum.accumulate(mixed - steps) + steps
    return int(min(best.min(initial=far), far))


class ShortFixtures:
    """Fixtures too short for edits, found whole and between characters that are no letter or digit."""

    def __init__(self, ids: list[str], texts: list[str]):
        by_text: dict[str, list[str]] = {}
        for fixture, text in zip(ids, texts):
            by_text.setdefault(text, []).append(fixture)
        self.words = ahocorasick.Automaton()
        for text, named in by_text.items():
            self.words.add_word(text, (len(text), named))
        self.words.make_automaton()

    def held_by(self, text: str) -> set[str]:
        found: set[str] = set()
        for last, (length, named) in self.words.iter(text):
            begin = last - length
            if (begin < 0 or not text[begin].isalnum()) and not text[last + 1:last + 2].isalnum():
                found.update(named)
        return found


def _search_short(ids: list[str], texts: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = ShortFixtures(ids, texts)
        for rows in batches:
            page_ids = rows["raw_page_id"].tolist()
            yield pd.DataFrame(
                [(page_ids[n], fixture, 0) for n, text in enumerate(rows["page_text"])
                 for fixture in sorted(short.held_by(plain_text(text)))],
                columns=["raw_page_id", "fixture_id", "edits"])
    return run


def _blocks(data: bytes, overlap: int) -> Iterator[bytes]:
    at = 0
    while True:
        yield data[at:at + BLOCK_BYTES + overlap]
        at += BLOCK_BYTES
        if at >= len(data):
            return


def _search(ids: list[int], texts: list[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = FixtureIndex(ids, texts)
        reach = int(index.lengths.max()) + 4 * index.band + Q

        def close(group: list[tuple[int, bytes]]) -> list[tuple]:
            """Pages are searched joined, with a gap no match can cross, then told apart again."""
            gap = b"\x00" * reach
            joined = gap.join(t for _, t in group)
            starts = np.cumsum([0] + [len(t) + reach for _, t in group])
            found: dict[tuple[int, int], int] = {}
            for fixture, band in index.regions(np.frombuffer(joined, np.uint8)):
                edits = index.verify(joined, fixture, band)
                if edits is not None:
                    middle = band * index.band - int(index.lengths.max()) + index.band + int(
                        index.lengths[fixture]) // 2
                    page = int(np.searchsorted(starts - reach // 2, middle, "right")) - 1
                    key = (min(max(page, 0), len(group) - 1), fixture)
                    found[key] = min(edits, found.get(key, edits))
            return [(group[page][0], ids[fixture], edits) for (page, fixture), edits in found.items()]

        for rows in batches:
            out: list[tuple] = []
            group: list[tuple[int, bytes]] = []
            held = 0
            for number, text in enumerate(rows["page_text"]):
                data = plain_bytes(text)
                for block in _blocks(data, reach):
                    group.append((number, block))
                    held += len(block) + reach
                    if held >= BLOCK_BYTES:
                        out += close(group)
                        group, held = [], 0
            if group:
                out += close(group)
            best: dict[tuple[int, int], int] = {}
            for number, fixture, edits in out:
                best[number, fixture] = min(edits, best.get((number, fixture), edits))
            page_ids = rows["raw_page_id"].tolist()
            yield pd.DataFrame([(page_ids[n], f, e) for (n, f), e in best.items()],
                               columns=["raw_page_id", "fixture_id", "edits"])
    return run


def find_fixture_leaks(raw_pages: DataFrame, fixtures: DataFrame, slice_bytes: int = SLICE_BYTES
                       ) -> DataFrame:
    """(raw_page_id, fixture_id, edits) of every page that holds a fixture's whole text.

    ``raw_pages`` has raw_page_id and page_text, ``fixtures`` (held-back statement texts) fixture_id
    and raw_text; ids may be of any type. Both are compared in lower case with white space runs as one blank. A page
    holds a fixture of m bytes if some stretch of it is within int(0.08 m) byte edits. Such a
    stretch shares at least m - 9 - 10 * budget ten-byte grams with the fixture, on diagonals no
    further apart than the budget: pages are scanned for bands with that many, and only those
    are aligned. edits is the least found.

    Fixtures go to the tasks in slices of about ``slice_bytes``, each slice a pass over the pages,
    so nothing sent grows with the table. Fixtures under 40 bytes would be met by chance within edits;
    they are found whole, where no letter or digit touches either end. Null, empty and blank texts
    hold and are held by nothing. Rows that repeat a
    fixture id, or a page id with equal text, give equal rows; distinct rows are returned.
    """
    items = fixtures.select("fixture_id", F.coalesce("raw_text", F.lit("")).alias("raw_text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("raw_text")), F.lit(0))).first()[0]
    n_slices = max(1, -(-int(total) // slice_bytes))
    items = worded_ids(items, "fixture_id")
    pages = worded_ids(keyed_text(raw_pages, "raw_page_id", "page_text"), "raw_page_id")
    passes = []
    for number in range(n_slices):
        # At most about slice_bytes: the hash deals the fixtures evenly over the slices.
        some = items.filter(F.pmod(F.xxhash64("fixture_id", "raw_text"), F.lit(n_slices)) == number)
        pairs = [(r.fixture_id, plain_text(r.raw_text)) for r in some.collect()]
        long = [(i, t.encode()) for i, t in pairs if len(t.encode()) >= MIN_FIXTURE_BYTES]
        short = [(i, t) for i, t in pairs if 0 < len(t.encode()) < MIN_FIXTURE_BYTES]
        for search, dealt in ((_search, long), (_search_short, short)):
            if dealt:
                ids, texts = zip(*dealt)
                passes.append(pages.mapInPandas(search(list(ids), list(texts)), _SCHEMA))
    if not passes:
        found = pages.select("raw_page_id", F.lit(None).cast("string").alias("fixture_id"),
                             F.lit(None).cast("int").alias("edits")).filter(F.lit(False))
    else:
        found = union_all(passes).groupBy("raw_page_id", "fixture_id").agg(F.min("edits").alias("edits"))
    return typed_ids(found, raw_page_id=raw_pages, fixture_id=fixtures)
