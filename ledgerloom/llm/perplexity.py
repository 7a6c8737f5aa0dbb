"""Perplexity of page text under a modified Kneser-Ney model of trusted pages (general)."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import keyed_text, local_path, shared_folder, staged, union_all

ORDER = 4
# Trusted pages above this quantile of their language's perplexities mark the threshold.
QUANTILE = 0.99
# The model of all languages together, for those without trusted text.
POOLED = "*"
LANGUAGES_PER_PASS = 8

_SLICE = 1 << 20
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Symbols after the letters: accented and other letters, blank, break, digit, and marks by kind.
(_ACCENTED, _OTHER, _BLANK, _BREAK, _DIGIT, _STOP, _COMMA, _CALL, _QUOTE, _MARK) = range(26, 36)
SYMBOLS = 36
CELLS = SYMBOLS**ORDER
_POINTS = 0x250

_COUNTS = "lang string, gram int, n bigint"
_TABLE = "lang string, path string"


def _symbol_of(point: int) -> int:
    char = chr(point).lower()
    if char in "\n\r":
        return _BREAK
    if char.isspace() or point < 32:
        return _BLANK
    if len(char) == 1 and char in _LETTERS:
        return _LETTERS.index(char)
    kind = unicodedata.category(char[0])[0]
    if kind == "L":
        return _ACCENTED
    if kind == "N":
        return _DIGIT
    named = {".": _STOP, ",": _COMMA, "!": _CALL, "?": _CALL, "'": _QUOTE, '"': _QUOTE}
    return named.get(char, _MARK)


_SYMBOL = np.array([_symbol_of(p) for p in range(_POINTS)], np.int32)


def gram_numbers(text: str) -> Iterator[np.ndarray]:
    """The number of the four symbols that end at each character, slice by slice.

    Three blanks stand before the text. Letters lose case; accented letters, digits, and marks
    by kind share symbols, so there are 36 symbols and 36^4 numbers.
    """
    for at in range(0, len(text), _SLICE):
        lead = text[max(0, at - ORDER + 1):at]
        piece = text[at:at + _SLICE]
        points = np.frombuffer((lead + piece).encode("utf-32-le", "surrogatepass"), np.uint32)
        near = _SYMBOL[np.minimum(points, _POINTS - 1)]
        far = np.where((points >= 0x2000) & (points < 0x2070), _MARK, _OTHER)
        symbols = np.where(points < _POINTS, near, far).astype(np.int32)
        symbols = np.concatenate([np.full(ORDER - 1 - len(lead), _BLANK, np.int32), symbols])
        number = symbols[:-3] * SYMBOLS**3 + symbols[1:-2] * SYMBOLS**2 + symbols[2:-1] * SYMBOLS
        yield number + symbols[3:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one task; at most 36^4 for each language, written out when many are held."""
    held: dict[str, np.ndarray] = {}

    def pour() -> Iterator[pd.DataFrame]:
        for lang, counts in held.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "gram": seen.astype(np.int32), "n": counts[seen]})
        held.clear()

    for rows in batches:
        for lang, text in zip(rows["lang"], rows["page_text"], strict=True):
            for numbers in gram_numbers(text):
                if lang not in held:
                    if len(held) >= LANGUAGES_PER_PASS:
                        yield from pour()
                    held[lang] = np.zeros(CELLS, np.int64)
                grams, counts = np.unique(numbers, return_counts=True)
                held[lang][grams] += counts
    yield from pour()


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified discounts from the counts of counts, kept within their range."""
    n = {k: F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4)}
    y = n[1] / (n[1] + 2 * n[2])
    rule = {k: k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)}
    # Where counts of counts are missing there is no estimate, and half the count goes.
    return grams.groupBy("lang").agg(*[
        F.when((n[k] > 0) & (n[1] > 0), F.greatest(F.lit(0.05), F.least(F.lit(float(k)), rule[k])))
        .otherwise(F.lit(k / 2)).alias(f"d{k}") for k in (1, 2, 3)])


def _shares(grams: DataFrame, order: int) -> DataFrame:
    """(lang, part, n_symbols, number, share) of the seen grams and contexts of one order.

    A seen gram's share is its discounted count over its context's total; a context's is what
    the discounts leave to shorter grams, over the same total. Counts and contexts are joined in shards.
    """
    seen = grams.join(_discounts(grams), "lang").withColumn(
        "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2"))
        .otherwise(F.col("d3"))).select(
        "lang", "gram", "n", "d", (F.col("gram") / F.lit(SYMBOLS)).cast("int").alias("context"))
    contexts = seen.groupBy("lang", "context").agg(
        F.sum("n").alias("total"), F.sum("d").alias("given"))
    kept = seen.join(contexts, ["lang", "context"]).select(
        "lang", F.lit("gram").alias("part"), F.lit(order).alias("n_symbols"),
        F.col("gram").alias("number"), ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
    left = contexts.select(
        "lang", F.lit("context").alias("part"), F.lit(order).alias("n_symbols"),
        F.col("context").alias("number"), (F.col("given") / F.col("total")).alias("share"))
    return kept.unionByName(left)


def _packed(folder: str):
    """One language's table, shorter grams first, written to a file; its size is fixed, 36^4 cells.

    p = share of the gram (none if unseen) + share of the context (all if unseen) * p of the gram
    without its first symbol; below one symbol all are alike.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.full(1, 1.0 / SYMBOLS)
        for order in range(1, ORDER + 1):
            mine = rows[rows["n_symbols"] == order]
            own, rest = np.zeros(SYMBOLS**order), np.ones(SYMBOLS**(order - 1))
            for part, cells in (("gram", own), ("context", rest)):
                some = mine[mine["part"] == part]
                cells[some["number"].to_numpy()] = some["share"].to_numpy()
            shorter = np.arange(SYMBOLS**order) % SYMBOLS**(order - 1)
            p = own + np.repeat(rest, SYMBOLS) * p[shorter]
        system, root = local_path(folder)
        system.create_dir(root, recursive=True)
        # A name of its own for every attempt; only a finished one's is returned.
        name = f"{folder}/{uuid.uuid4().hex}.f32"
        with system.open_output_stream(local_path(name)[1], compression=None) as out:
            out.write(np.log(p).astype(np.float32).tobytes())
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "path": [name]})
    return run


def trusted_grams(trusted_pages: DataFrame) -> DataFrame:
    """(lang, gram, n) of trusted pages, for every language and for all together."""
    counted = trusted_pages.select("lang", "page_text").mapInPandas(_count, _COUNTS)
    own = staged(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trusted-grams")
    pooled = own.groupBy("gram").agg(F.sum("n").alias("n")).select(
        F.lit(POOLED).alias("lang"), "gram", "n")
    return own.unionByName(pooled)


def gram_tables(grams: DataFrame) -> DataFrame:
    """(lang, path): files in the shared folder with the log probability of every four-symbol gram."""
    orders = {ORDER: grams}
    for order in range(ORDER - 1, 0, -1):
        # A shorter gram counts by how many different symbols stand before it.
        orders[order] = orders[order + 1].groupBy(
            "lang", F.pmod(F.col("gram"), F.lit(SYMBOLS**order)).cast("int").alias("gram")
        ).agg(F.count("*").alias("n"))
    shares = union_all([_shares(orders[order], order) for order in range(1, ORDER + 1)])
    folder = shared_folder(grams.sparkSession, "gram-tables")
    return shares.groupBy("lang").applyInPandas(_packed(folder), _TABLE)


def _table(path: str) -> np.ndarray:
    system, where = local_path(path)
    with system.open_input_file(where) as file:
        return np.frombuffer(file.read(), np.float32)


@dataclass(frozen=True)
class PageModel:
    """Files with the log probabilities of grams, one of 6.7 MB for each language.

    Tasks read them from the shared folder; nothing but their paths passes through the driver.
    """

    paths: dict[str, str]

    def perplexity(self, lang: Column, page_text: Column) -> Column:
        paths = self.paths

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            tables = {lang_: _table(path) for lang_, path in paths.items()}
            if POOLED not in tables:
                tables[POOLED] = np.full(CELLS, -np.log(SYMBOLS), np.float32)
            for langs, texts in parts:
                out = []
                for lang_, text in zip(langs, texts, strict=True):
                    table, total = tables.get(lang_, tables[POOLED]), 0.0
                    for numbers in gram_numbers(text):
                        total += float(table[numbers].sum(dtype=np.float64))
                    out.append(float(np.exp(-total / len(text))) if text else None)
                yield pd.Series(out, dtype="float64")

        return F.pandas_udf(run, "double")(lang, page_text)


def page_perplexity(raw_pages: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(raw_page_id, lang, perplexity, threshold, keep) of every page.

    ``raw_pages`` has raw_page_id, lang and page_text; ``trusted`` has the raw_page_id of pages to
    learn from. Four-symbol grams of all trusted texts are counted for each language (and for all
    together); counts, contexts and shorter grams are joined in shards into interpolated, modified
    Kneser-Ney probabilities. A page's perplexity is that of its whole text, under its language's model or the
    common one. threshold is its language's ``quantile`` of the trusted pages' perplexities (the common
    one where a language has none); a page is kept if its perplexity is at most that.

    A language's table has 36^4 cells whatever the corpus, so it can go to every task; more than
    eight languages are scored in several passes. Null text counts as empty: no perplexity, not
    kept. A null language is a language of its own. Without trusted text all is uniform and every
    page with text is kept. Repeated rows are scored each.
    """
    pages = keyed_text(raw_pages, "raw_page_id", "lang", "page_text").withColumn(
        "lang", F.coalesce("lang", F.lit("")))
    known = trusted.select("raw_page_id").distinct().withColumn("_trusted", F.lit(True))
    # Both sides are shuffled at every size: trusted ids may be as many as the pages.
    grams = trusted_grams(pages.join(known.hint("merge"), "raw_page_id", "left_semi"))
    paths = {r.lang: r.path for r in staged(gram_tables(grams), "gram-tables").collect()}
    own = sorted(x for x in paths if x != POOLED)
    passes = []
    for at in range(0, max(1, len(own)), LANGUAGES_PER_PASS):
        some = own[at:at + LANGUAGES_PER_PASS]
        model = PageModel({x: paths[x] for x in (*some, POOLED) if x in paths})
        here = F.col("lang").isin(*some) if some else F.lit(False)
        if at == 0:
            here = here | ~F.col("lang").isin(*own) if own else F.lit(True)
        passes.append(pages.filter(here).select(
            "raw_page_id", "lang", model.perplexity(F.col("lang"), F.col("page_text")).alias("perplexity")))
    scored = staged(union_all(passes), "perplexities").join(known, "raw_page_id", "left")
    level = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    trusted_rows = scored.filter(F.col("_trusted"))
    by_lang = trusted_rows.groupBy("lang").agg(level.alias("_own"))
    common = trusted_rows.agg(level.alias("p")).first()
    whole = float("inf") if common is None or common.p is None else common.p
    threshold = F.coalesce("_own", F.lit(whole))
    return scored.join(by_lang, "lang", "left").select(
        "raw_page_id", "lang", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))
