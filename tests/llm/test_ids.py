"""Ids keep their type and value beside a null one, and no column name of the input is in the way."""

import random

import pytest

from ledgerloom.llm.boilerplate import strip_spread_lines
from ledgerloom.llm.fixture_leaks import find_fixture_leaks
from ledgerloom.llm.near_pages import near_duplicate_pages, one_of_each_class
from ledgerloom.llm.packing import pack_pages
from ledgerloom.llm.page_flags import fit_page_flags
from ledgerloom.llm.page_prints import near_print_pages
from ledgerloom.llm.page_tokens import count_page_tokens
from ledgerloom.llm.queries import tokenizer_file
from ledgerloom.llm.repeated_bytes import remove_repeated_bytes
from ledgerloom.llm.resampling import resample_pages
from ledgerloom.llm.word_perplexity import page_word_perplexity

BIG = 1 << 60
WORKING = ("tag path paths block block_a block_b set_id sketch copies root grams _page _class _tag _tag0 _all "
           "_id _twin _root _links _row1 _row2 _found _removed _at _line _bytes _line1 _line2 _site key digest "
           "start lone wanted covered print mask held node n_words score weight rank _long _part _before "
           "class_id n_links row_no chunk_no n_spread edits fixture_id").split()


def pages(spark, ids):
    draw = random.Random(1)

    def words(n):
        return " ".join(f"fee{draw.randrange(900)}" for _ in range(n))
    body, note = words(150), words(30)
    texts = {BIG + 1: body + "\n" + note, None: words(90) + "\n" + note, BIG + 3: body + "\n" + note,
             BIG + 5: words(80)}
    rows = [(k if k is None or ids == "bigint" else f"page-{k}", t, f"bank{j}", "en", *["x"] * len(WORKING))
            for j, (k, t) in enumerate(texts.items())]
    columns = ", ".join(f"{name} string" for name in WORKING)
    return note, spark.createDataFrame(
        rows, f"raw_page_id {ids}, page_text string, institution string, lang string, {columns}").coalesce(1)


OPERATORS = {
    "near_pages": lambda p, note: near_duplicate_pages(p),
    "one_of_each": lambda p, note: one_of_each_class(p),
    "spread_lines": lambda p, note: strip_spread_lines(p, 3),
    "flags": lambda p, note: fit_page_flags(p, p.selectExpr(
        "raw_page_id", "cast(length(page_text) > 600 as int) as flagged")).score(p),
    "leaks": lambda p, note: find_fixture_leaks(p, p.sparkSession.createDataFrame(
        [(BIG + 9, note), (None, note + " none")], "fixture_id bigint, raw_text string")),
    "tokens": lambda p, note: count_page_tokens(p, tokenizer_file("byte_bpe_50k.json"), 300, 50),
    "bytes": lambda p, note: remove_repeated_bytes(p),
    "packing": lambda p, note: pack_pages(p, tokenizer_file("word_bpe_49k.json"), 64),
    "perplexity": lambda p, note: page_word_perplexity(p, p.select("raw_page_id")),
    "prints": lambda p, note: near_print_pages(p),
    "resampling": lambda p, note: resample_pages(p, p),
}


@pytest.mark.parametrize("ids", ["bigint", "string"])
@pytest.mark.parametrize("name", list(OPERATORS))
def test_ids_stay_what_they_are(spark, name, ids):
    note, frame = pages(spark, ids)
    found = OPERATORS[name](frame, note)
    assert dict(found.dtypes)["raw_page_id"] == ids
    got = {r["raw_page_id"] for r in found.collect()}
    every = {r["raw_page_id"] for r in frame.collect()}
    first, last = sorted(x for x in every if x is not None)[0::2]
    lacking = {"one_of_each": {sorted(x for x in every if x is not None)[1]}, "leaks": {last}}
    assert got == every - lacking.get(name, set())
    if name == "near_pages":
        assert {r["raw_page_id"]: r["class_id"] for r in found.collect()} == {
            k: min(x for x in every if x is not None) if k in sorted(x for x in every if x is not None)[:2] else k
            for k in every}
    if name == "leaks":
        assert {r["fixture_id"] for r in found.collect()} == {BIG + 9, None}
    if name in ("one_of_each", "spread_lines"):
        assert set(WORKING) <= set(found.columns)
        assert all(r["_row1"] == r["_all"] == r["_class"] == "x" for r in found.collect())
