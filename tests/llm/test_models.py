"""Page flags, vectors and perplexity: held-out accuracy, recall and a plain model."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import page_flags, perplexity, vector_tree
from ledgerloom.llm.page_flags import fit_page_flags
from ledgerloom.llm.perplexity import gram_numbers, page_perplexity
from ledgerloom.llm.vector_tree import nearest_vectors

WORDS = "fee deposit interest wire transfer payroll card refund check balance ledger account".split()


def flagged_rows(count, seed):
    draw, rows = random.Random(seed), []
    for k in range(count):
        text = [draw.choice(WORDS) for _ in range(draw.choice([5, 40, 200]))]
        flag = int(draw.random() < 0.3)
        if flag:
            text[draw.randrange(len(text))] = draw.choice(["wretched", "scoundrel"])
        rows.append((k, " ".join(text), flag, "clash"))
    return rows


def test_flags_on_held_out_pages(spark):
    rows = flagged_rows(600, 1)
    frame = spark.createDataFrame(rows, "raw_page_id bigint, page_text string, flagged int, score string")
    labels = frame.filter("raw_page_id >= 200").select("raw_page_id", "flagged")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (1, None)], labels.schema))
    model = fit_page_flags(frame, labels)
    scored = model.score(frame).collect()
    assert len(scored) == len(rows) and model.score(frame).columns[-1] == "score"
    held = [(r.score >= 0.5) == bool(r.flagged) for r in scored if r.raw_page_id < 200]
    assert np.mean(held) > 0.97
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "wretched " * 200_000)],
                                "raw_page_id bigint, page_text string")
    got = {r.raw_page_id: r.score for r in model.score(odd).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[2] > 0.5 and got[None] == got[1]


def test_flags_without_two_kinds_of_labels(spark):
    frame = spark.createDataFrame(flagged_rows(20, 2), "raw_page_id bigint, page_text string, flagged int, x string")
    one_kind = frame.select("raw_page_id", F.lit(0).alias("flagged"))
    for labels in (one_kind, one_kind.limit(0)):
        scores = {r.score for r in fit_page_flags(frame, labels).score(frame).collect()}
        assert len(scores) == 1
    model = fit_page_flags(frame.limit(0), one_kind.limit(0))
    assert model.score(frame.limit(0)).collect() == []


def brute_nearest(rows, queries, k):
    out = {}
    for q, query in queries:
        far = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, query, strict=True))), i)
                     for i, v in rows if i != q)
        out[q] = [i for _, i in far[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 20])
def test_nearest_reach_the_recall(spark, monkeypatch, block):
    monkeypatch.setattr(vector_tree, "LEAF_BLOCK", block)
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(12, 16)) * 3
    rows = [(k, (middle[k % 12] + draw.normal(size=16)).tolist()) for k in range(1500)]
    rows += [(5000 + k, rows[0][1]) for k in range(15)]
    odd = [(9000, None), (9100, []), (9200, [0.0] * 16), (9300, [float("nan")] * 16), (None, rows[0][1]),
           (9400, [None] + [1.0] * 15), (9500, [float("inf")] * 16), (9600, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<double>, rank int")
    queries = frame.filter(F.col("vec_id") % 50 == 0)
    got = defaultdict(list)
    for r in sorted(nearest_vectors(frame, queries).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert set(got) == set(want)
    known = dict(rows)
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [s for *_, s in found] == sorted(s for *_, s in found)
        for _, i, s in found:
            assert s == pytest.approx(math.dist(known[q], known[i]), abs=1e-12)
        hits += len({i for _, i, _ in found} & set(want[q]))
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, i, _ in got[0]][:10] == [5000 + k for k in range(10)]


def test_nearest_of_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in nearest_vectors(few, few).orderBy("query_id").collect()
            ] == [(1, 1, 2), (2, 1, 1)]
    none = few.limit(0)
    assert nearest_vectors(none, none).collect() == [] and nearest_vectors(few, none).collect() == []


def plain_model(texts):
    """Interpolated modified Kneser-Ney with dictionaries; a probability for each gram asked."""
    size = perplexity.SYMBOLS
    counts = {4: Counter(int(g) for t in texts for part in gram_numbers(t) for g in part)}
    for order in (3, 2, 1):
        counts[order] = Counter(g % size**order for g in counts[order + 1])
    discount, context = {}, {}
    for order, grams in counts.items():
        n = Counter(grams.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        discount[order] = {
            k: max(0.05, min(k, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and n[1] else k / 2
            for k in (1, 2, 3)}
        context[order] = defaultdict(list)
        for g, c in grams.items():
            context[order][g // size].append(c)

    def p(gram, order):
        if order == 0:
            return 1 / size
        lower = p(gram % size**(order - 1), order - 1)
        seen = context[order].get(gram // size)
        if not seen:
            return lower
        d, c = discount[order], counts[order].get(gram, 0)
        given = sum(d[min(x, 3)] for x in seen)
        return (c - (d[min(c, 3)] if c else 0)) / sum(seen) + given / sum(seen) * lower
    return p


def test_perplexity_equals_the_plain_model(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "_SLICE", 37)
    draw = random.Random(5)
    rows = [(k, " ".join(draw.choice(WORDS) for _ in range(draw.choice([2, 30]))) + draw.choice([".", "!\n"]),
             draw.choice(["en", "de"]), "clash") for k in range(40)]
    rows += [(50, None, "en", "x"), (51, "", None, "x"), (52, "Zß9 §§ ÄÖ 你好 “x”", "fr", "x"), rows[0],
             (53, "fee " * 500, "en", "x"), (None, "lost id", "en", "x")]
    frame = spark.createDataFrame(rows, "raw_page_id bigint, page_text string, lang string, keep string")
    trusted = frame.filter("raw_page_id < 30").select("raw_page_id")
    texts = defaultdict(list)
    for page, text, lang, _ in rows:
        if page is not None and page < 30:
            texts[lang].append(text)
            texts["*"].append(text)
    models = {lang: plain_model(t) for lang, t in texts.items()}
    got = page_perplexity(frame, trusted).collect()
    assert len(got) == len(rows)
    known = {r[0]: r for r in rows}
    for r in got:
        _, text, lang, _ = known[r.raw_page_id]
        if not text:
            assert r.perplexity is None and not r.keep
            continue
        p = models.get(lang, models["*"])
        logs = [math.log(p(int(g), 4)) for part in gram_numbers(text) for g in part]
        assert r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
        assert r.keep == (r.perplexity <= r.threshold)


def test_perplexity_without_trusted_or_pages(spark):
    frame = spark.createDataFrame([(1, "fee", "en"), (2, None, "de")],
                                  "raw_page_id bigint, page_text string, lang string")
    none = frame.limit(0)
    got = {r.raw_page_id: r.keep for r in page_perplexity(frame, none.select("raw_page_id")).collect()}
    assert got == {1: True, 2: False}
    assert page_perplexity(none, frame.select("raw_page_id")).collect() == []


def plain_features(text):
    """Feature numbers of a text one n-gram after another, in whole numbers modulo 2^64."""
    text, mix, full = f" {' '.join(text.lower().split())} ", 0x9E3779B97F4A7C15, (1 << 64) - 1
    found = set()
    for length in page_flags.LENGTHS:
        for at in range(len(text) - length + 1):
            code = length
            for letter in text[at:at + length]:
                code = (code + ord(letter)) * mix & full
            found.add(((code ^ (code >> 29)) * mix & full) >> (64 - page_flags.HASH_BITS))
    return found


def test_flags_equal_a_plain_dictionary_model(spark):
    rows = flagged_rows(150, 4) + [(900, None, 1, ""), (901, "", 0, ""), (902, "Ärger \U0001f600 ÄRGER", 1, "")]
    frame = spark.createDataFrame(rows, "raw_page_id bigint, page_text string, flagged int, x string")
    labels = frame.select("raw_page_id", "flagged")
    # A row that is told twice counts twice.
    model = fit_page_flags(frame, labels.unionByName(labels.filter("raw_page_id < 10")))
    told = rows + [r for r in rows if r[0] < 10]
    seen = {0: Counter(), 1: Counter()}
    for _, text, flag, _ in told:
        seen[flag].update(plain_features(text or ""))
    n = Counter(r[2] for r in told)
    strength = {}
    for feature in seen[0] | seen[1]:
        f, c = seen[1][feature] + 1, seen[0][feature] + 1
        z = abs(math.log(f / (n[1] + 2) / (c / (n[0] + 2)))) / math.sqrt(1 / f + 1 / c)
        if f + c - 2 >= page_flags.MIN_PAGES and z >= page_flags.MIN_Z:
            strength[feature] = z
    assert strength and set(model.features.tolist()) == set(strength)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for r in model.score(frame).collect():
        total = model.bias + sum(weight.get(f, 0) for f in plain_features(r.page_text or ""))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)
