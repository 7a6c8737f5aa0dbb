"""Word perplexity: what four characters can't see, a plain model, edge rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import word_perplexity
from ledgerloom.llm.word_perplexity import page_word_perplexity

SCHEMA = "raw_page_id bigint, page_text string, lang string"


def sentences(draw, count):
    subject, verb, thing = (["The %s" % x for x in ("bank", "client", "teller", "auditor", "branch")],
                            ["pays", "sends", "checks", "books"], ["a fee", "the wire", "a refund", "the card"])
    return " ".join(f"{draw.choice(subject)} {draw.choice(verb)} {draw.choice(thing)}." for _ in range(count))


def test_repeated_and_shuffled_words_are_rejected(spark):
    draw = random.Random(3)
    rows = [(k, sentences(draw, 12), "en") for k in range(120)]
    shuffled = sentences(draw, 12).split()
    draw.shuffle(shuffled)
    rows += [(200, "pays " * 40, "en"), (201, " ".join(shuffled), "en"), (202, "zq xw vrr " * 9, "en"),
             (203, sentences(draw, 12), "en"), (204, sentences(draw, 12), "fr"), (205, None, "en")]
    frame = spark.createDataFrame(rows, SCHEMA)
    trusted = frame.filter("raw_page_id < 100").select("raw_page_id")
    kept = {r.raw_page_id: r.keep for r in page_word_perplexity(frame, trusted).collect()}
    assert not any(kept[k] for k in (200, 201, 202, 205))
    assert kept[203] and kept[204] and sum(kept[k] for k in range(100, 120)) >= 18


def plain(texts):
    pairs = Counter(p for t in texts for p in zip(["<s>", *t], [*t, "</s>"], strict=True))
    words = Counter(w for _, w in pairs)

    def discount(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return {k: max(0.05, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[1] else k / 2 for k in (1, 2, 3)}
    two, one = discount(pairs), discount(words)
    everything = sum(words.values())
    unknown = sum(one[min(c, 3)] for c in words.values()) / everything / (len(words) + 1)

    def p(v, w):
        lower = ((words[w] - one[min(words[w], 3)]) / everything if w in words else 0) + unknown
        after = [c for (a, _), c in pairs.items() if a == v]
        if not after:
            return lower
        c = pairs.get((v, w), 0)
        return ((c - two[min(c, 3)] if c else 0) + sum(two[min(x, 3)] for x in after) * lower) / sum(after)
    return p


@pytest.mark.parametrize("shards", [1, 7])
def test_word_perplexity_equals_the_plain_model(spark, monkeypatch, shards):
    monkeypatch.setattr(word_perplexity, "SHARDS", shards)
    draw = random.Random(5)
    rows = [(k, " ".join(draw.choice("fee wire card bank new".split()) for _ in range(9)), "en") for k in range(40)]
    rows += [(50, "", None), (51, "fee odd wire", "en"), rows[35], (None, "fee fee", "en"), (52, " ", "en")]
    frame = spark.createDataFrame(rows, SCHEMA)
    trusted = frame.filter("raw_page_id < 30").select("raw_page_id")
    p = plain([t.split() for k, t, _ in rows if k is not None and k < 30])
    got = page_word_perplexity(frame, trusted).collect()
    assert len(got) == len(rows)
    known = {r[0]: r[1] for r in rows}
    for r in got:
        text = known[r.raw_page_id]
        if not text:
            assert r.perplexity is None and not r.keep
        elif r.raw_page_id is None or r.raw_page_id >= 30:
            pairs = Counter(zip(["<s>", *text.split()], [*text.split(), "</s>"], strict=True))
            total = sum(n * math.log(p(*g)) - math.lgamma(n + 1) for g, n in pairs.items())
            assert r.perplexity == pytest.approx(math.exp(-total / sum(pairs.values())), rel=1e-4)
            assert r.keep == (r.perplexity <= r.threshold)


def test_word_perplexity_without_trusted_or_pages(spark):
    frame = spark.createDataFrame([(1, "fee", "en"), (2, None, "de")], SCHEMA)
    none = frame.limit(0)
    got = {r.raw_page_id: r.keep for r in page_word_perplexity(frame, none.select("raw_page_id")).collect()}
    assert got == {1: True, 2: False}
    assert page_word_perplexity(none, frame.select("raw_page_id")).collect() == []


def test_no_language_is_not_the_empty_one(spark):
    rows = [(1, None, "fee wire " * 9), (2, "", "deposit card " * 9), (3, "en", "check refund " * 9)]
    frame = spark.createDataFrame(rows, "raw_page_id bigint, lang string, page_text string")
    got = page_word_perplexity(frame, frame.select("raw_page_id")).collect()
    assert {r.raw_page_id: r.lang for r in got} == {1: None, 2: "", 3: "en"}
    assert len({r.threshold for r in got}) == 3 or all(r.threshold == r.perplexity for r in got)


def test_what_is_sent_is_packed_and_does_not_grow_with_the_pages():
    """A block's text goes to the shards as its distinct pairs, sent once, not as lists of its pages."""
    draw = random.Random(7)
    words = [f"w{draw.randrange(1 << 40):x}" for _ in range(400)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(50)]

    def sent(times):
        batch = pa.RecordBatch.from_pydict({"raw_page_id": list(range(50 * times)), "lang": ["=en"] * (50 * times),
                                            "page_text": texts * times})
        (row,) = next(word_perplexity._blocks(iter([batch]))).to_pylist()
        groups = word_perplexity._groups(row, np.arange(50 * times) % 3 == 0, frozenset(["=en"]), False)
        asker = word_perplexity._Asker(frozenset(["=en"]), False, 4, "")
        asked = [r for b in word_perplexity._ask_pairs(asker, row | {"block": 0}, groups, None) for r in b.to_pylist()]
        return asked, sum(len(r["keys"]) + len(r["counts"]) for r in asked)
    asked, size = sent(1)
    pairs = {p for t in texts for p in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)}
    assert sorted({r["shard"] for r in asked}) == [0, 1, 2, 3] and len(asked) == 4
    # Eight bytes a pair would not fit the disk; copies of pages add counts only.
    assert size < 6.5 * len(pairs) and sent(20)[1] < 1.35 * size


def test_counts_and_keys_come_back_as_they_were():
    draw = np.random.default_rng(2)
    for width in (1, 6, 8):
        for size in (1, 3, 4, 1000):
            counts = draw.integers(0, 9, (width, size)) ** draw.integers(0, 18, (width, size))
            assert (word_perplexity._unpacked_counts(word_perplexity._packed_counts(counts), width) == counts).all()
    keys = np.sort(np.append(draw.integers(0, 1 << 48, 999), [0, (1 << 48) - 1]))
    assert (word_perplexity._unpacked_keys(word_perplexity._packed_keys(keys), len(keys)) == keys).all()


def test_blocks_do_not_change_the_model(spark):
    """A pair that many blocks hold is one pair; a language without trusted text goes by all together."""
    draw = random.Random(9)
    rows = [(k, sentences(draw, 3), draw.choice(["en", "de"])) for k in range(60)]
    rows += [(70, sentences(draw, 3), "fr"), (71, None, "fr"), rows[0], (None, sentences(draw, 3), "en")]
    frame = spark.createDataFrame(rows, SCHEMA)
    trusted = frame.filter("raw_page_id < 40").select("raw_page_id")

    def scores(pages):
        return sorted((str(r.raw_page_id), r.lang, r.perplexity and round(r.perplexity, 6), r.keep)
                      for r in page_word_perplexity(pages, trusted).collect())
    whole = scores(frame.coalesce(1))
    # Each partition's pages are blocks of their own.
    assert scores(frame.repartition(9)) == whole and len(whole) == len(rows)
