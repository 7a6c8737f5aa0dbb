"""Perplexity of page text under a word model of trusted pages, whose counts are dealt in shards (general)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import keyed_text, local_path, shared_folder, staged, text_batches
from ledgerloom.llm.perplexity import POOLED, QUANTILE

# Least number of shards, and grams that one shard holds in a task's memory.
SHARDS = 64
SHARD_ROWS = 4_000_000
PIECE_BYTES = 4 << 20
# Text of one block of pages; what pages of a block share is sent once.
BLOCK_BYTES = 12 << 20

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
_TOKENS = 1 << 18
# Grams are known by 48 bits of a hash; a shard is a range of them.
_BITS = 48
# No words of a text, as they hold a blank.
_START, _END = "start ", "end "
# Words of a block from this rank on are written apart.
_RARE = 0xFFFF
# Shards' sums over all blocks stand beside the blocks' answers under this number.
_SUMS = -1

_BLOCKS = "ids array<{}>, langs array<string>, n_tokens bigint, words binary, tokens binary, pages binary"
_ASKED = "block bigint, shard int, lang string, keys binary, counts binary"
_ANSWERS = "block bigint, shard int, lang string, answer binary, sums array<bigint>"
_SCORED = "raw_page_id {}, lang string, _trusted boolean, perplexity double"


def _code(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=_BITS // 8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _short(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


class _Numbers(dict):
    """Numbers of the words of one block."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def word_numbers(text: str, numbers: dict[str, int]) -> np.ndarray:
    """Numbers of (start, words, end). A word is a run of letters and digits, or one mark; case counts."""
    found = [np.array([numbers[_START]], np.uint32)]
    words = (m.group() for m in _WORD.finditer(text)) if len(text) > _TOKENS else iter(_WORD.findall(text))
    while some := list(islice(words, _TOKENS)):
        found.append(np.fromiter(map(numbers.__getitem__, some), np.uint32, len(some)))
    return np.concatenate([*found, np.array([numbers[_END]], np.uint32)])


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side; those of sorted and of small numbers pack well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _packed(*parts: np.ndarray) -> bytes:
    raw = b"".join(_planes(np.ascontiguousarray(x)) for x in parts)
    sizes = np.array([len(raw), *map(len, parts)], np.int64)
    return sizes.tobytes() + pa.Codec("zstd", 9).compress(raw, asbytes=True)


def _unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds) + 1)
    raw = pa.Codec("zstd").decompress(data[sizes.nbytes:], int(sizes[0]), asbytes=True)
    parts, at = [], 0
    for size, kind in zip(sizes[1:], map(np.dtype, kinds), strict=True):
        plane = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, -1)
        parts.append(np.ascontiguousarray(plane.T).view(kind).ravel())
        at += size * kind.itemsize
    return parts


def _packed_counts(counts: np.ndarray) -> bytes:
    """Whole numbers, most of them 0 or near: two bits for each, and apart what goes beyond."""
    x = np.ascontiguousarray(counts).ravel()
    four = np.zeros((-(-len(x) // 4), 4), np.uint8)
    four.ravel()[:len(x)] = np.minimum(x, 3)
    small = _packed(four @ np.array([1, 4, 16, 64], np.uint8))
    return np.array([len(x), len(small)], np.int64).tobytes() + small + _packed(x[x >= 3] - 3)


def _unpacked_counts(data: bytes, width: int) -> np.ndarray:
    size, cut = np.frombuffer(data, np.int64, 2)
    (four,) = _unpacked(data[16:16 + cut], np.uint8)
    (beyond,) = _unpacked(data[16 + cut:], np.int64)
    x = (four[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:size].astype(np.int64)
    x[x == 3] += beyond
    return x.reshape(width, -1)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Steps between keys in sorted order: three low bytes as they are, since nothing packs them, and the rest."""
    step = np.diff(keys, prepend=0)
    low = step.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
    return low + _packed((step >> 24).astype(np.int32))


def _unpacked_keys(data: bytes, size: int) -> np.ndarray:
    low = np.zeros((size, 8), np.uint8)
    low[:, :3] = np.frombuffer(data, np.uint8, 3 * size).reshape(-1, 3)
    (high,) = _unpacked(data[3 * size:], np.int32)
    return np.cumsum(low.view("<i8").ravel() + (high.astype(np.int64) << 24))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages read as words, many in one row: the block's words, commonest first, and their numbers in order."""
    numbers, ids, held, size = _Numbers(), [], [], 0

    def row() -> pa.RecordBatch:
        langs, found = zip(*held, strict=True)
        number = np.concatenate(found)
        word = np.fromiter(map(_code, numbers), np.int64, len(numbers))
        n = np.bincount(number)
        order = np.lexsort((word, -n))
        rank = np.empty(len(word), np.uint32)
        rank[order] = np.arange(len(word), dtype=np.uint32)
        rank = rank[number]
        names = sorted(set(langs))
        at = {name: k for k, name in enumerate(names)}
        own = pa.concat_arrays(ids)
        parts = {
            "n_tokens": len(rank), "words": _packed(np.diff(word[order], prepend=0)),
            "tokens": _packed(np.minimum(rank, _RARE).astype("<u2").view(np.uint8), rank[rank >= _RARE]),
            "pages": _packed(np.array([len(x) for x in found]), np.array([at[x] for x in langs]))}
        kinds = {"n_tokens": pa.int64(), "words": pa.binary(), "tokens": pa.binary(), "pages": pa.binary()}
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([names], pa.list_(pa.string())),
             *[pa.array([x], kinds[c]) for c, x in parts.items()]], names=["ids", "langs", *parts])

    for batch in batches:
        for piece, data, _ in text_batches([batch], PIECE_BYTES):
            ids.append(piece["raw_page_id"])
            columns = (piece[c].to_pylist() for c in ("lang", "page_text"))
            held += [(lang, word_numbers(text, numbers)) for lang, text in zip(*columns, strict=True)]
            size += len(data)
            if size >= BLOCK_BYTES:
                yield row()
                numbers, ids, held, size = _Numbers(), [], [], 0
    if held:
        yield row()


_ASKED_ROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("lang", pa.string()),
                        ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER_ROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("lang", pa.string()),
                         ("answer", pa.binary()), ("sums", pa.list_(pa.int64()))])


@dataclass
class _Group:
    """What a block's pages ask of one language's model."""

    lang: str
    pairs: np.ndarray  # first word and second word of each distinct pair
    keys: np.ndarray
    n: np.ndarray  # how often each pair comes in trusted pages
    words: np.ndarray  # numbers of the words in the order of their keys
    word_keys: np.ndarray
    pages: tuple[np.ndarray, np.ndarray]  # page and number of each word and pair of the pages scored here
    page_pairs: tuple[np.ndarray, np.ndarray]


def _counted(page: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(page, number, how often) of what is distinct."""
    size = int(number.max(initial=0)) + 1
    place, entry = pd.factorize(page.astype(np.int64) * size + number)
    return entry // size, entry % size, np.bincount(place, minlength=len(entry))


def _groups(row: dict, trusted: np.ndarray, learnt: frozenset[str], pooled: bool) -> Iterator[_Group]:
    """Groups of a block, one language at a time. A trusted page counts for its language and, if asked for, for all."""
    (word,) = _unpacked(row["words"], np.int64)
    word = np.cumsum(word).astype(np.uint64)
    low, rare = _unpacked(row["tokens"], np.uint8, np.uint32)
    token = low.view("<u2").astype(np.uint32)
    token[token == _RARE] = rare
    length, lang_no = _unpacked(row["pages"], np.int64, np.int64)
    at = np.repeat(np.arange(len(length), dtype=np.int32), length)
    langs = np.array([x if x in learnt else POOLED for x in row["langs"]], object)[lang_no]
    for lang in sorted({*langs, *([POOLED] if pooled and trusted.any() else [])}):
        scored = langs == lang
        counted = trusted & (scored | (lang == POOLED))
        mine = (scored | counted)[at]
        page, own = at[mine], token[mine].astype(np.int64)
        inside = page[1:] == page[:-1]
        number, pairs = pd.factorize((own[:-1] * len(word) + own[1:])[inside])
        page_of = page[1:][inside]
        n = np.bincount(number[counted[page_of]], minlength=len(pairs))
        named = word + np.uint64(_code("\0" + lang))
        code = _mixed(named)
        first, second = pairs // len(word), pairs % len(word)
        words = np.flatnonzero(np.bincount(own))
        words = words[np.argsort(_short(code[words]), kind="stable")]
        yield _Group(
            lang, np.stack([first, second]),
            _short(_mixed(code[first] * np.uint64(0x9E3779B97F4A7C15) + named[second])), n, words, _short(code[words]),
            (page[scored[page]], own[scored[page]]), (page_of[scored[page_of]], number[scored[page_of]]))


def _dealt(block: int, lang: str, keys: np.ndarray, counts: np.ndarray, n_shards: int) -> Iterator[dict]:
    """Sorted keys and their counts as a row for each shard that has some."""
    cuts = np.searchsorted((keys * n_shards) >> _BITS, np.arange(n_shards + 1))
    for shard in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[shard], cuts[shard + 1])
        yield {"block": block, "shard": int(shard), "lang": lang, "keys": _packed_keys(keys[own]),
               "counts": _packed_counts(counts[:, own])}


def _in_rows(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that what is sent stays small."""
    while some := list(islice(rows, 16)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _told(folder: str, block: int, *columns: str) -> list[dict]:
    """What was written for one block under a shared folder."""
    system, path = local_path(f"{folder}/block={block}")
    if system.get_file_info(path).type == FileType.NotFound:
        return []
    return ds.dataset(path, filesystem=system, format="parquet").to_table(columns=list(columns)).to_pylist()


def _by_lang(folder: str, block: int) -> dict[str, list[bytes]]:
    """The shards' answers to a block in the order of its keys."""
    found: dict[str, list[bytes]] = {}
    for row in sorted(_told(folder, block, "shard", "lang", "answer"), key=lambda r: r["shard"]):
        found.setdefault(row["lang"], []).append(row["answer"])
    return found


@dataclass(frozen=True)
class _Asker:
    """Reads blocks with the answers there are, and asks for the next ones or scores the pages."""

    learnt: frozenset[str]
    pooled: bool
    n_shards: int
    trusted: str
    pairs: str = ""
    words: str = ""
    models: dict[str, dict] | None = None

    def of(self, step: Callable[[_Asker, dict, Iterator[_Group], np.ndarray], Iterator[pa.RecordBatch]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = {c: batch[c][k] if c == "ids" else batch[c][k].as_py() for c in batch.schema.names}
                    trusted = np.zeros(len(row["ids"].values), bool)
                    trusted[[r["page_no"] for r in _told(self.trusted, row["block"], "page_no")]] = True
                    yield from step(self, row, _groups(row, trusted, self.learnt, self.pooled), trusted)
        return run

    def seen(self, row: dict, groups: Iterator[_Group]) -> Iterator[tuple[_Group, np.ndarray, np.ndarray]]:
        """Each group, with the count of its pairs in all trusted text and whether this block counts them as different."""
        told = _by_lang(self.pairs, row["block"])
        for g in groups:
            more = np.zeros(len(g.keys), np.int64)
            more[np.argsort(g.keys, kind="stable")] = np.concatenate([_unpacked_counts(x, 1)[0] for x in told[g.lang]])
            yield g, g.n + (more >> 1), (g.n > 0) & (more & 1 == 0)


def _ask_pairs(asker: _Asker, row: dict, groups: Iterator[_Group], trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for g in groups:
        order = np.argsort(g.keys, kind="stable")
        yield from _in_rows(_dealt(row["block"], g.lang, g.keys[order], g.n[None, order], asker.n_shards), _ASKED_ROW)


def _word_sums(g: _Group, n: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Of each word: the pairs that this block is to count and that it ends; how often it ends a pair and begins one
    in trusted pages; the pairs to be counted that it begins, by how often they come (1, 2, 3, 4, more)."""
    size = int(g.words.max()) + 1
    first, second = g.pairs
    sums = [np.bincount(second[mine], minlength=size), np.bincount(second, g.n, size), np.bincount(first, g.n, size)]
    sums += [np.bincount(first[mine & (n == k)], minlength=size) for k in (1, 2, 3, 4)]
    sums.append(np.bincount(first[mine & (n > 4)], minlength=size))
    return np.stack([x.astype(np.int64)[g.words] for x in sums])


def _needed(sums: np.ndarray) -> np.ndarray:
    """What a score needs of a word's sums."""
    before, seen, total, *after = sums
    return np.stack([before, seen, total, after[0], after[1], after[2] + after[3] + after[4]])


def _ask_words(asker: _Asker, row: dict, groups: Iterator[_Group], trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for g, n, mine in asker.seen(row, groups):
        yield from _in_rows(
            _dealt(row["block"], g.lang, g.word_keys, _word_sums(g, n, mine), asker.n_shards), _ASKED_ROW)


def _of_shards(answer: Callable[[list[dict]], Iterator[dict]]):
    """Answers to all rows of one shard and language, which come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and (row["shard"], row["lang"]) != (held[0]["shard"], held[0]["lang"]):
                    yield from _in_rows(answer(held), _ANSWER_ROW)
                    held = []
                held.append(row)
        if held:
            yield from _in_rows(answer(held), _ANSWER_ROW)
    return run


def _summed(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the key at each place, counts there, sums by key, places where rows begin)."""
    counts = [_unpacked_counts(r["counts"], width) for r in rows]
    keys = [_unpacked_keys(r["keys"], c.shape[1]) for r, c in zip(rows, counts, strict=True)]
    starts = np.cumsum([0, *map(len, keys)])
    number, known = pd.factorize(np.concatenate(keys))
    joined = np.concatenate(counts, axis=1)
    # Sums stay whole numbers in a double's range.
    sums = np.stack([np.bincount(number, x, len(known)) for x in joined]).astype(np.int64)
    return number, joined, sums, starts


def _count_pairs(rows: list[dict]) -> Iterator[dict]:
    number, (own,), (total,), starts = _summed(rows, 1)
    # One block of those that hold a pair in trusted text counts it among the different pairs.
    holds = np.flatnonzero(own)
    _, first = np.unique(number[holds], return_index=True)
    # Told is what a block doesn't know, which is nothing for most pairs.
    more = 2 * (total[number] - own)
    more[np.delete(holds, first)] += 1
    for k, row in enumerate(rows):
        yield {"block": row["block"], "shard": row["shard"], "lang": row["lang"],
               "answer": _packed_counts(more[None, starts[k]:starts[k + 1]])}


def _count_words(rows: list[dict]) -> Iterator[dict]:
    number, counts, sums, starts = _summed(rows, 8)
    more = _needed(sums)[:, number] - _needed(counts)
    for k, row in enumerate(rows):
        yield {"block": row["block"], "shard": row["shard"], "lang": row["lang"],
               "answer": _packed_counts(more[:, starts[k]:starts[k + 1]])}
    before, _, _, *after = sums
    yield {"block": _SUMS, "shard": rows[0]["shard"], "lang": rows[0]["lang"], "sums": [
        int(x) for x in (np.count_nonzero(before), before.sum(), *[np.count_nonzero(before == n) for n in (1, 2, 3, 4)],
                         *[x.sum() for x in after[:4]])]}


def _discounts(n: list[int]) -> list[float]:
    """Modified discounts from the counts of counts, kept within their range."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    # Where counts of counts are missing there is no estimate, and half the count goes.
    return [max(0.05, min(float(k), k - (k + 1) * y * n[k] / n[k - 1])) if n[0] and n[k - 1] else k / 2
            for k in (1, 2, 3)]


def _model(sums: list[int]) -> dict | None:
    """Discounts and the share of an unknown word; None where a language has no trusted text."""
    words, everything, *counts = sums
    if not words:
        return None
    one, two = _discounts(counts[:4]), _discounts(counts[4:])
    given = one[0] * counts[0] + one[1] * counts[1] + one[2] * (words - counts[0] - counts[1])
    return {"one": one, "two": two, "all": everything, "unknown": given / everything / (words + 1)}


def _less(n: np.ndarray, discounts: list[float]) -> np.ndarray:
    return n - np.array([0.0, *discounts])[np.minimum(n, 3)]


def _score(asker: _Asker, row: dict, groups: Iterator[_Group], trusted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each page's log probability, as that of its pairs as a bag, and its number of words.

    A word's value is its log probability over an unknown one's and what its discounts leave to
    single words after it; a pair's is its log probability over that. What isn't in the model adds nothing.
    """
    size = len(trusted)
    found, n_words = np.zeros(size), np.zeros(size, np.int64)
    told = _by_lang(asker.words, row["block"])
    for g, n, mine in asker.seen(row, groups):
        page, pair, times = _counted(*g.page_pairs)
        log_factorial = np.cumsum(np.log(np.maximum(np.arange(times.max(initial=0) + 1), 1)))
        here = np.bincount(page, times, size).astype(np.int64)
        n_words += here
        found -= np.bincount(page, log_factorial[times], size)
        model = (asker.models or {}).get(g.lang)
        if model is None:
            continue
        columns = np.zeros((6, int(g.words.max()) + 1), np.int64)
        columns[:, g.words] = _needed(_word_sums(g, n, mine)) + [
            np.concatenate(x) for x in zip(*[_unpacked_counts(x, 6) for x in told[g.lang]], strict=True)]
        before, seen, total, *after = columns
        p = np.where(before > 0, _less(before, model["one"]) / model["all"], 0.0) + model["unknown"]
        left = sum(d * x for d, x in zip(model["two"], after, strict=True))
        value = np.where(before > 0, np.log(p / model["unknown"]), 0.0)
        value += np.log(np.where(total > 0, left / np.maximum(total, 1), 1.0))
        first, second = g.pairs
        known = (n > 0) & (left[first] > 0)
        gain = np.zeros(len(n))
        gain[known] = np.log1p(_less(n[known], model["two"]) / (left[first] * p[second])[known])
        # A trusted page goes by what other pages hold.
        held = ~trusted[page] | (n[pair] > times)
        found += np.bincount(page, gain[pair] * times * held, size) + here * np.log(model["unknown"])
        page, word, times = _counted(*g.pages)
        held = ~trusted[page] | (np.maximum(seen, total)[word] > times)
        found += np.bincount(page, value[word] * times * held, size)
    _, lang_no = _unpacked(row["pages"], np.int64, np.int64)
    with np.errstate(over="ignore"):
        perplexity = np.exp(-found / n_words)
    yield pa.RecordBatch.from_arrays(
        [row["ids"].values, pa.array(row["langs"], pa.string()).take(pa.array(lang_no)), pa.array(trusted),
         pa.array(perplexity)], names=["raw_page_id", "lang", "_trusted", "perplexity"])


def _written(answers: DataFrame, name: str) -> str:
    """A shared folder with a folder for each block, which tasks that read the block look into."""
    folder = shared_folder(answers.sparkSession, name)
    answers.repartition("block").write.partitionBy("block").parquet(folder)
    return folder


def page_word_perplexity(raw_pages: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(raw_page_id, lang, perplexity, threshold, keep) of every page.

    ``raw_pages`` has raw_page_id, lang and page_text; ``trusted`` has the raw_page_id of pages to
    learn from. Pairs of neighbouring words of all trusted texts are counted for each language (and
    for all together, if a page's language has no trusted text) into an interpolated, modified
    Kneser-Ney model over an open vocabulary, as large as the text asks for. Words count by how many
    different words stand before them.

    Pages are read once, into blocks of word numbers. Each block's distinct pairs, with their counts in its
    trusted pages, go to the shards of the model once, sorted and packed; the sums over all blocks come
    back. Then its distinct words go, with what their pairs add up to, and their sums come back,
    of which the block's pages are scored. So no list of pages is sent and no share of a page's sum.

    A page's log probability is that of its pairs as a bag: a pair that comes n times is charged
    log n! more, so a text of repeated words isn't likely text. A trusted page is scored by what
    other pages hold: a word or pair that occurs nowhere else counts as unknown. threshold is the
    ``quantile`` of the trusted pages' perplexities in the page's language (the common one where it
    has none); a page is kept if its perplexity is at most that.

    Null text counts as empty: no perplexity, not kept. A null language is a language of its own.
    Without trusted text no page with text is rejected. Repeated rows are scored each. Words and
    pairs are known by 48 bits of a hash: an unseen one passes for a seen one once in 2^48 / model rows.
    """
    pages = keyed_text(raw_pages, "raw_page_id", "lang", "page_text").withColumn(
        # Within, no language is an empty text and all others bear a sign.
        "lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    known = trusted.select("raw_page_id").distinct().withColumn("_trusted", F.lit(True))
    inked = pages.filter("page_text <> ''")
    id_type = pages.schema["raw_page_id"].dataType.simpleString()
    blocks = staged(inked.mapInArrow(_blocks, _BLOCKS.format(id_type)).withColumn(
        "block", F.monotonically_increasing_id()), "word-blocks")
    # Ids meet the trusted ones without their texts. Both sides are shuffled at every size: trusted ids may be as many.
    placed = blocks.select("block", F.posexplode("ids").alias("page_no", "raw_page_id"))
    placed = placed.join(known.hint("merge"), "raw_page_id", "left_semi").select("block", "page_no")
    # Texts stay out of this join too.
    learnt = frozenset(r.lang for r in inked.select("raw_page_id", "lang").join(
        known.hint("merge"), "raw_page_id", "left_semi").select("lang").distinct().collect())
    pooled = any(r.lang not in learnt for r in blocks.select(F.explode("langs").alias("lang")).distinct().collect())
    n_tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    asker = _Asker(learnt, pooled, max(SHARDS, -(-n_tokens * (1 + pooled) // SHARD_ROWS)), _written(placed, "word-trusted"))

    def answered(step: Callable, answer: Callable) -> DataFrame:
        asked = blocks.mapInArrow(asker.of(step), _ASKED).repartition("shard").sortWithinPartitions("shard", "lang")
        return asked.mapInArrow(_of_shards(answer), _ANSWERS)

    asker = replace(asker, pairs=_written(answered(_ask_pairs, _count_pairs), "word-pairs"))
    asker = replace(asker, words=_written(answered(_ask_words, _count_words), "word-words"))
    sums: dict[str, list[int]] = {}
    if n_tokens:
        totals = pages.sparkSession.read.schema("lang string, sums array<bigint>").parquet(f"{asker.words}/block={_SUMS}")
        totals = totals.groupBy("lang").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(10)]).alias("sums"))
        sums = {r.lang: r.sums for r in totals.collect()}
    asker = replace(asker, models={lang: model for lang, x in sums.items() if (model := _model(x))})

    empty = pages.filter("page_text = ''").select(
        "raw_page_id", "lang", F.lit(None).cast("boolean").alias("_trusted"), F.lit(None).cast("double").alias("perplexity"))
    scored = staged(blocks.mapInArrow(asker.of(_score), _SCORED.format(id_type)).unionByName(empty), "word-perplexities")
    level = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    trusted_rows = scored.filter(F.col("_trusted"))
    by_lang = trusted_rows.groupBy("lang").agg(level.alias("_own"))
    common = trusted_rows.agg(level.alias("p")).first()
    whole = float("inf") if common is None or common.p is None else common.p
    threshold = F.coalesce("_own", F.lit(whole))
    return scored.join(by_lang, "lang", "left").select(
        "raw_page_id", F.when(F.col("lang") != "", F.substring("lang", 2, 1 << 30)).alias("lang"),
        "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
