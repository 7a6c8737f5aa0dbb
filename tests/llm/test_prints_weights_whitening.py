"""SimHash links, resampling and whitening against plain brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import page_prints, resampling, whitening
from ledgerloom.llm.bk_trees import grow_trees, linked_labels
from ledgerloom.llm.crc_spans import PLACES, span_crcs
from ledgerloom.llm.page_prints import alike_prints, near_print_pages
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.resampling import resample_pages
from ledgerloom.llm.whitening import cross_products, whiten_vectors

BIG = 1 << 60


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    runs = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(prints):
    """For every index, all it reaches by links of at most three bits."""
    root = list(range(len(prints)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[top(b)] = top(a)
    return [top(k) for k in range(len(prints))]


def texts(seed=3):
    draw = random.Random(seed)
    out = []
    for _ in range(30):
        base = [f"Fee{draw.randrange(400)}" for _ in range(draw.choice([1, 2, 3, 30, 300]))]
        for _ in range(draw.choice([1, 2, 6])):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(["edited", base[0]])
            out.append(draw.choice([" ", "\n", " \t "]).join(copy))
    return [*out, None, "", " \n ", "é ü x 你", "one", "ONE", "x " * 400_000, "y" * 1_500_000, out[0]]


@pytest.mark.parametrize("tree,piece", [(1 << 15, 1 << 20), (4, 50)])
@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_near_prints_equal_brute_force(spark, monkeypatch, tree, piece, ids):
    monkeypatch.setattr(page_prints, "TREE_PRINTS", tree)
    monkeypatch.setattr(page_prints, "PIECE", piece)
    pages = [(None if k == 5 else BIG + k, t) for k, t in enumerate(texts())]
    rows = [(k if k is None or ids == "bigint" else str(k), t, "a", "b", "c") for k, t in pages]
    frame = spark.createDataFrame(
        rows, f"raw_page_id {ids}, page_text string, print string, fingerprint string, component_id string")
    got = near_print_pages(frame)
    assert dict(got.dtypes)["raw_page_id"] == dict(got.dtypes)["component_id"] == ids
    prints = [brute_print(t) for _, t, *_ in rows]
    root = brute_roots(prints)
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None),
                    default=None) for r in set(root)}
    want = [(rows[k][0], f"{prints[k]:016x}", least[root[k]]) for k in range(len(rows))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_pages_and_a_component_of_null_ids(spark):
    schema = "raw_page_id bigint, page_text string"
    assert near_print_pages(spark.createDataFrame([], schema)).collect() == []
    got = near_print_pages(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, None)], schema))
    assert sorted((str(r[0]), str(r[2])) for r in got.collect()) == [("7", "7"), ("None", "None"), ("None", "None")]


@pytest.mark.parametrize("tree", [1 << 15, 40, 3])
def test_links_of_crowded_prints_equal_brute_force(spark, monkeypatch, tree):
    """A crowd around one print, pairs at three and four bits, and strangers."""
    monkeypatch.setattr(page_prints, "TREE_PRINTS", tree)
    draw = random.Random(tree)
    hub = draw.getrandbits(64)
    some = {hub ^ sum(1 << b for b in draw.sample(range(20), draw.randrange(9))) for _ in range(300)}
    for _ in range(60):
        one = draw.getrandbits(64)
        some |= {one, one ^ sum(1 << b for b in draw.sample(range(64), draw.choice([3, 4, 5])))}
    prints = sorted({*some, 0, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = alike_prints(spark.createDataFrame([(p,) for p in signed], "print bigint")).collect()
    for r in found:
        assert ((r["print"] ^ r["root"]) & ((1 << 64) - 1)) != 0
    at = {p: k for k, p in enumerate(signed)}
    label = list(range(len(prints)))
    for _ in prints:
        for r in found:
            low = min(label[at[r["print"]]], label[at[r["root"]]])
            label[at[r["print"]]] = label[at[r["root"]]] = low
        if all(label[at[r["print"]]] == label[at[r["root"]]] for r in found):
            break
    root = brute_roots(prints)
    groups = lambda x: sorted(sorted(k for k in range(len(x)) if x[k] == r) for r in set(x))
    assert groups(label) == groups(root)


def test_tree_children_are_keyed_by_distance():
    rng = np.random.default_rng(5)
    points = np.unique(rng.integers(0, 1 << 64, 500, np.uint64))
    trees = grow_trees(points, np.repeat([0, 1], [200, len(points) - 200]), 3)
    assert len(trees.edge) == len(set(trees.edge.tolist())) == len(points) - 2
    for edge, child in zip(trees.edge.tolist(), trees.child.tolist(), strict=True):
        parent, distance = divmod(edge, 65)
        assert (int(points[parent]) ^ int(points[child])).bit_count() == distance
    label = linked_labels(trees, points[:1] ^ np.uint64(7), np.array([0]), 3, own=False)
    assert label[-1] == 0


def test_span_crcs_equal_the_library():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 40_000, np.uint8)
    size = np.array([1, 2, 3, PLACES - 1, PLACES, PLACES + 1, 2 * PLACES, 5 * PLACES + 7, 4_096, 39_000, 9, 1])
    begin = np.array([int(rng.integers(0, len(data) - n)) for n in size])
    want = [zlib.crc32(data[b:b + n].tobytes()) for b, n in zip(begin, size, strict=True)]
    assert span_crcs(data, begin, begin + size).tolist() == want
    assert span_crcs(data, begin[:0], begin[:0]).tolist() == []
    assert span_crcs(data, begin[:3], begin[:3] + size[:3]).tolist() == want[:3]


def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return [" ".join(words[k:k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)], len(words)


def brute_resampled(pages, targets, percent=5, least=20):
    counts = [Counter(zlib.crc32(r.encode()) % 10_000 for t in some for r in runs(t)[0])
              for some in ([t for _, t in pages], targets)]
    s_all, t_all = (sum(c.values()) for c in counts)
    gain = [math.floor(1000 * math.log((counts[1][b] + 1.0) * (s_all + 10_000.0)
                                       / ((counts[0][b] + 1.0) * (t_all + 10_000.0)))) for b in range(10_000)]
    out = []
    for page, text in pages:
        found, words = runs(text)
        weight = sum(gain[zlib.crc32(r.encode()) % 10_000] for r in found)
        h = int(hashlib.sha256(f"42:{'' if page is None else page}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([page, len(found), words, weight, score, None])
    long = sorted((r for r in out if r[2] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(long[:percent * len(long) // 100], 1):
        row[5] = place
    return out


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_resampling_equals_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(resampling, "TEXT_BYTES", 3_000)
    monkeypatch.setattr(resampling, "SPANS", 500)
    draw = random.Random(9)
    pages = [(BIG + k, " ".join(draw.choice(["Fee", "É9", "wire-x", "a,b", "Z" * 300])
                                + str(draw.randrange(50)) for _ in range(draw.choice([1, 2, 19, 25, 80]))))
             for k in range(150)]
    pages += [(None, pages[0][1] + " more words to be long enough " * 3), (5, None), (6, ""), (7, "... !!"),
              (8, "word " * 40_000), (9, "q" * 300_000), (10, "end"), (11, "start")]
    pages = [(k if k is None or ids == "bigint" else f"{k:020d}", t) for k, t in pages]
    targets = ["fee1 fee2 wire x3", None, "a b7 é91"]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in pages],
                                  f"raw_page_id {ids}, page_text string, _at string, rank int").repartition(5)
    target = spark.createDataFrame([(t, 0) for t in targets], "page_text string, n int")
    got = sorted(map(str, map(list, resample_pages(frame, target, 30).collect())))
    if ids == "string":
        want = brute_resampled([(k, t) for k, t in pages], targets, 30)
    else:
        want = brute_resampled(pages, targets, 30)
    assert got == sorted(map(str, want))


def test_repeated_and_empty_resampling(spark):
    schema = "raw_page_id bigint, page_text string"
    text = "one two three " * 10
    frame = spark.createDataFrame([(1, text)] * 40, schema)
    none = spark.createDataFrame([], schema)
    got = resample_pages(frame, none).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]
    assert {r["n_features"] for r in got} == {87}
    assert resample_pages(none, frame).collect() == []
    assert resample_pages(none, none).collect() == []


def test_resampling_query_equals_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op12_resample_pages"][0](spark, sf_dir)
    want = [[p, n, w, s, r] for p, n, _, w, s, r in brute_resampled(pages, target)]
    assert sorted(map(str, map(list, got.select("doc_id", "n_features", "weight", "score", "rank").collect()))) == (
        sorted(map(str, want)))


def test_near_prints_query_equals_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in pages]
    root = brute_roots(prints)
    least = {r: min(p for k, (p, _) in enumerate(pages) if root[k] == r) for r in set(root)}
    want = [[p, f"{prints[k]:016x}", least[root[k]]] for k, (p, _) in enumerate(pages)]
    got = QUERIES["op11_near_prints"][0](spark, sf_dir).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(list, got.collect())) == sorted(want)


def test_cross_products_are_exact():
    rng = np.random.default_rng(8)
    for low, high in ((-300, 300), (5, 6), (-(1 << 40), 1 << 40), (0, 1)):
        x = rng.integers(low, high, (131, 5))
        n, sums, products = cross_products(x)
        whole = x.astype(object)
        assert (n, sums) == (131, [int(v) for v in whole.sum(axis=0)])
        assert products == {(i, j): int((whole[:, i] * whole[:, j]).sum()) for i in range(5) for j in range(i, 5)}


def brute_whitened(rows, most=4):
    kept = [(k, [math.floor(256 * float(np.float64(c))) for c in v]) for k, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in kept}), np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    e, axes = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(fit.shape[1], -1))
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    out = []
    for k, v in kept:
        far = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        w = (np.array(v) - np.array(sums) / n) @ axes / np.sqrt(e)
        out += [(k, c + 1, n, far, float(w[c]), float(e[c] / np.trace(np.cov(fit.T, bias=True)))) for c in range(len(e))]
    return out


@pytest.mark.parametrize("ids", ["bigint", "string"])
def test_whitening_equals_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(whitening, "ROWS", 70)
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6)) * np.array([1, 2, 4, 8, 16, 32])
    good = [(BIG + k, (rng.normal(size=6) @ mix).tolist()) for k in range(400)]
    good += [(None, good[3][1]), good[4], good[4], (1, [0.0] * 6), (2, [-0.0] * 6), (3, [1e-9] * 6)]
    bad = [(4, None), (5, [None] * 6), (6, [float("nan")] * 6), (7, [float("-inf")] + [0.0] * 5), (8, []), (9, [1.0])]
    as_id = (lambda k: k) if ids == "bigint" else (lambda k: None if k is None else str(k))
    good = [(as_id(k), v) for k, v in good]
    frame = spark.createDataFrame([(k, v, "x", 0) for k, v in good + [(as_id(k), v) for k, v in bad]],
                                  f"vec_id {ids}, embedding array<double>, x string, n int").repartition(6)
    got = sorted((str(r[0]), r[1], r[2], int(r[3]), r[4], r[5], r[6]) for r in whiten_vectors(frame).collect())
    want = sorted((str(k), *more) for k, *more in brute_whitened(good))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    sign = {}
    for g, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-3:
            sign.setdefault(g[1], math.copysign(1, g[4] * w[4]))
            assert g[4] * sign[g[1]] == pytest.approx(w[4], rel=1e-7)
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == got[0][6] < 1e-9


def test_whitening_of_nothing_of_one_and_of_flat_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whiten_vectors(spark.createDataFrame([], schema)).collect() == []
    one = whiten_vectors(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r[1], r[2], r[3], r[4], r[6]) for r in one] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = whiten_vectors(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], schema)).collect()
    assert {r[4] is None for r in flat if r[1] == 2} == {True} and {r[4] is None for r in flat if r[1] == 1} == {False}
    assert flat[0][6] < 1e-12
    far = whiten_vectors(spark.createDataFrame([(1, [3e30, 0.0]), (2, [-3e30, 1.0])], schema)).collect()
    assert len(far) == 4
