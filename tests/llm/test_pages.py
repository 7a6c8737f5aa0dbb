"""Near pages, repeated bytes, spread lines, fixture leaks and archives against brute force."""

import gzip
import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import boilerplate, fixture_leaks, near_pages, payload_archive, repeated_bytes
from ledgerloom.llm.components import components
from ledgerloom.llm.fixture_leaks import edit_budget, find_fixture_leaks, plain_bytes
from ledgerloom.llm.near_pages import near_duplicate_pages, one_of_each_class
from ledgerloom.llm.payload_archive import read_payload_archive, write_payload_archive
from ledgerloom.llm.repeated_bytes import remove_repeated_bytes
from ledgerloom.llm.suffixes import permuted_prefixes, repeated_windows, suffix_array

SCHEMA = "raw_page_id bigint, page_text string, institution string, tag string, n_links string, key int"


def words(draw, count):
    return [draw.choice("fee deposit interest wire transfer payroll card refund check balance".split())
            + str(draw.randrange(60)) for _ in range(count)]


def frame(spark, texts):
    """Pages with columns whose names clash with the operators' own."""
    return spark.createDataFrame(
        [(k, t, f"bank{j % 5}", "tag", "clash", 7) for j, (k, t) in enumerate(texts)], SCHEMA)


def page_texts(seed=1):
    draw = random.Random(seed)
    texts, number = [], itertools.count()
    for _ in range(25):
        base = words(draw, draw.choice([3, 8, 60, 200]))
        for _ in range(draw.choice([1, 2, 3])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 3])):
                copy[draw.randrange(len(copy))] = "edited"
            texts.append((next(number), " ".join(copy)))
    texts += [(next(number), t) for t in (None, "", " \n ", "one", "ONE", "é ü 你 ok", "x " * 30_000)]
    texts += [texts[0], texts[0], (None, texts[3][1]), (next(number), texts[2][1].upper())]
    return texts


def shingles(text):
    split = (text or "").lower().split()
    if not split:
        return frozenset()
    return frozenset(tuple(split[k:k + 5]) for k in range(max(1, len(split) - 4)))


def brute_links(texts):
    sets = [shingles(t) for _, t in texts]
    links = defaultdict(set)
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a].add(b)
            links[b].add(a)
    root = list(range(len(sets)))
    for _ in sets:
        for a, near in links.items():
            root[a] = min([root[a], *(root[b] for b in near)])
    least = defaultdict(list)
    for k, (page, _) in enumerate(texts):
        least[root[k]].append(page)
    smallest = {r: min((p for p in ids if p is not None), default=None) for r, ids in least.items()}
    return [(p, smallest[root[k]] if sets[k] else p, len(links[k])) for k, (p, _) in enumerate(texts)]


@pytest.mark.parametrize("small,block", [(64, 256), (2, 3)])
def test_near_pages_equal_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_pages, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_pages, "BLOCK", block)
    texts = page_texts()
    got = near_duplicate_pages(frame(spark, texts)).collect()
    assert sorted(str((r.raw_page_id, r.class_id, r.n_links)) for r in got) == sorted(
        map(str, brute_links(texts)))


def test_one_page_of_each_class_stays(spark):
    texts = page_texts()
    kept = one_of_each_class(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    want = {p for p, c, n in brute_links(texts) if p == c}
    assert sorted(r.raw_page_id for r in kept.collect()) == sorted(want)
    empty = frame(spark, [])
    assert near_duplicate_pages(empty).collect() == [] and one_of_each_class(empty).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (102, 101)], "u int, v int")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}


def test_suffix_order_and_prefixes():
    draw = np.random.default_rng(0)
    for _ in range(400):
        text = draw.integers(0, draw.integers(1, 5) + 1, draw.integers(1, 60)).astype(np.uint8)
        data = text.tobytes()
        order = sorted(range(len(data)), key=lambda k: data[k:])
        assert suffix_array(text, 1000).tolist() == order
        shared = permuted_prefixes(text, np.array(order), 7)
        for at, before in zip(order[1:], order, strict=False):
            same = 0
            while same < 7 and data[at + same:at + same + 1] == data[before + same:before + same + 1] != b"":
                same += 1
            assert shared[at] == same
        found = repeated_windows(text, 3)
        windows = Counter(data[k:k + 3] for k in range(len(data) - 2))
        assert all(found[k] == (windows[data[k:k + 3]] > 1) for k in range(len(data) - 2))


def brute_removed(texts):
    data = [(t or "").encode() for _, t in texts]
    count = Counter(d[k:k + 400] for d in data for k in range(len(d) - 399))
    out = []
    for (page, _), d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if count[d[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((page, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1024, 2])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeated_bytes, "CROWD", crowd)
    draw = random.Random(4)
    passages = [" ".join(words(draw, 70)) for _ in range(4)]
    texts = []
    for k in range(40):
        parts = [" ".join(words(draw, draw.choice([3, 40, 90])))]
        for _ in range(draw.choice([0, 1, 2])):
            passage = draw.choice(passages)
            cut = draw.choice([0, 50, len(passage) - 399, len(passage) - 400])
            parts += [passage[cut:] if draw.random() < 0.5 else passage[:len(passage) - cut],
                      " ".join(words(draw, 5))]
        texts.append((k, "é".join(parts)))
    texts += [(50, None), (51, ""), (52, "a" * 399), (53, "a" * 400), (54, "b" * 2500), texts[0], texts[0],
              (None, texts[1][1]), (55, texts[2][1] + "\n" + texts[2][1]), (0, "another " * 80)]
    got = remove_repeated_bytes(frame(spark, texts)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in brute_removed(texts))


def test_repeated_bytes_of_long_and_no_texts(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "_BLOCK", 1000)
    draw = random.Random(5)
    long = " ".join(words(draw, 1500))
    texts = [(1, long), (2, "x" + long[3000:4200] + "y")]
    got = remove_repeated_bytes(frame(spark, texts)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str(r) for r in brute_removed(texts))
    assert remove_repeated_bytes(frame(spark, [])).collect() == []


def brute_stripped(rows, least):
    sites = defaultdict(set)
    for _, text, site, *_ in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r") and site is not None:
                sites[line.strip(" \t\r")].add(site)
    out = []
    for page, text, *_ in rows:
        lines = (text or "").split("\n")
        ink = [x.strip(" \t\r") for x in lines]
        spread = [bool(x) and len(sites[x]) >= least for x in ink]
        size = [len(x.encode()) for x in ink]
        strip = any(spread) and sum(s for s, f in zip(size, spread, strict=True) if f) < sum(size)
        kept = "\n".join(x for x, f in zip(lines, spread, strict=True) if not (f and strip))
        out.append((page, sum(map(bool, ink)), sum(spread), sum(spread) if strip else 0, kept))
    return out


def test_spread_lines_equal_brute_force(spark):
    draw, rows = random.Random(6), []
    shared = [f"Member FDIC notice {k}" for k in range(12)]
    for page in range(300):
        body = [" ".join(words(draw, 12)) for _ in range(draw.choice([1, 4]))]
        for _ in range(draw.choice([0, 1, 3])):
            k = draw.randrange(12)
            body.insert(draw.randrange(len(body) + 1), draw.choice(["", " ", "\t"]) + shared[k] + "\r")
        rows.append((page, "\n".join(body), f"bank{draw.randrange(k_banks(page))}", None, None, 1))
    rows += [(900, None, "bank1", None, None, 1), (901, "", None, None, None, 1), rows[0], rows[0],
             (902, "\n\n" + shared[0] + "\n", "bank9", None, None, 1),
             (None, shared[1] + "\n" + "own line " * 9, None, None, None, 1)]
    got = boilerplate.strip_spread_lines(spark.createDataFrame(rows, SCHEMA), 10)
    assert set(SCHEMA.replace(",", "").split()[0::2]) <= set(got.columns)
    found = [(r.raw_page_id, r.n_lines, r.n_spread, r.n_removed, r.page_text) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, brute_stripped(rows, 10)))
    assert any(n for _, _, _, n, _ in found)
    assert boilerplate.strip_spread_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def k_banks(page):
    """Some lines reach the threshold of ten, some come near it."""
    return 9 + page % 7


def least_edits(text, data):
    """Edits of ``text`` against its best stretch of ``data``, one cell after another."""
    row = [0] * (len(data) + 1)
    for i, byte in enumerate(text, 1):
        new = [i]
        for j, other in enumerate(data, 1):
            new.append(min(row[j - 1] + (byte != other), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_full_alignment(spark):
    draw = random.Random(7)
    fixtures = [(k, " ".join(words(draw, draw.choice([6, 12, 25])))) for k in range(6)]
    pages = []
    for k in range(40):
        text = list(draw.choice(fixtures)[1])
        for _ in range(draw.choice([0, 2, 5, 9, 14])):
            at = draw.randrange(len(text))
            text[at:at + draw.choice([0, 1])] = draw.choice(["", "q", "é"])
        around = " ".join(words(draw, draw.choice([0, 5, 30])))
        pages.append((k, f"{around} {''.join(text).upper()}\n\n {around}"))
    pages += [(90, None), (91, ""), (92, fixtures[0][1] + " " + fixtures[1][1]), pages[0]]
    fixtures += [(70, None), (71, "too short"), (72, fixtures[0][1]), fixtures[1], (73, " \n")]
    want = set()
    for page, text in pages:
        for fixture, item in fixtures:
            item = plain_bytes(item or "")
            if len(item) >= fixture_leaks.MIN_FIXTURE_BYTES:
                edits = least_edits(item, plain_bytes(text or ""))
                if edits <= edit_budget(len(item)):
                    want.add((page, fixture, edits))
    texts = spark.createDataFrame(fixtures, "fixture_id bigint, raw_text string")
    for size in (1 << 20, 200):
        got = find_fixture_leaks(frame(spark, pages), texts, slice_bytes=size).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert find_fixture_leaks(frame(spark, []), texts).collect() == []
    assert find_fixture_leaks(frame(spark, pages), texts.limit(0)).collect() == []


def test_short_fixtures_are_found_whole_between_words(spark):
    fixtures = [(1, "What is 2+2?"), (2, "Net  ASSET value"), (3, "é"), (4, "net asset value"),
                (5, "asset"), (6, "x" * 39), (7, ""), (8, None)]
    pages = [(1, "Quiz: what is\n2+2? Four."), (2, "The net asset\tvalue, told twice: net asset value"),
             (3, "net asset values and assets"), (4, "caf\u00e9 \u00e9t\u00e9"), (5, "(\u00c9)"), (6, "x" * 40),
             (7, "-" + "X" * 39), (8, None), (9, "y " * 200_000 + "asset"), (10, "planet asset value")]
    want = {(1, 1, 0), (2, 2, 0), (2, 4, 0), (2, 5, 0), (3, 5, 0), (5, 3, 0), (7, 6, 0), (9, 5, 0),
            (10, 5, 0)}
    texts = spark.createDataFrame(fixtures, "fixture_id bigint, raw_text string")
    for size in (1 << 20, 10):
        got = find_fixture_leaks(frame(spark, pages), texts, slice_bytes=size).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_leaks_in_pages_longer_than_a_block(spark, monkeypatch):
    draw = random.Random(8)
    item = " ".join(words(draw, 12))
    index = fixture_leaks.FixtureIndex([0], [plain_bytes(item)])
    noise = plain_bytes(" ".join(words(draw, 400)))
    data = noise + plain_bytes(item) + noise
    assert any(index.verify(data, f, b) == 0 for f, b in index.regions(np.frombuffer(data, np.uint8)))
    monkeypatch.setattr(fixture_leaks, "BLOCK_BYTES", 500)
    run = fixture_leaks._search([0], [plain_bytes(item)])
    pages = frame(spark, [(1, data.decode()), (2, noise.decode())]).select(
        "raw_page_id", "page_text").toPandas()
    found = [tuple(r) for part in run(iter([pages])) for r in part.itertuples(index=False)]
    assert found == [(1, 0, 0)]


PAYLOADS = "raw_payload_id bigint, original_basename string, content binary, path string, n_bytes string"


def payload_rows():
    draw = random.Random(9)
    body = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 5, 99, 100, 3000, 200_000)]
    rows = [(k, f"http://bank.example/{k}?a=b c\r\n", body[k % 6], "clash", "x") for k in range(40)]
    inner = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    return [*rows, (100, None, None, "clash", "x"), (101, "b.html", payload_archive.MAGIC * 50, None, None),
            (102, "nested.warc.gz", inner * 3, None, None)]


@pytest.mark.parametrize("split", [1 << 23, 1000, 7])
def test_archive_round_trip(spark, tmp_path, split):
    rows = payload_rows()
    small = [r for r in rows if r[2] is None or len(r[2]) < 4000] if split == 7 else rows
    files = write_payload_archive(spark.createDataFrame(small, PAYLOADS).coalesce(2), str(tmp_path / "a"))
    got = read_payload_archive(files, split_bytes=split).collect()
    first = {}
    for page, _, content, *_ in sorted(small, key=lambda r: r[0]):
        first.setdefault(content or b"", page)
    want = []
    for page, name, content, *_ in small:
        content = content or b""
        refers = first[content] if len(content) >= 100 and first[content] != page else None
        want.append((str(page), name, "revisit" if refers is not None else "response",
                     None if refers is None else str(refers), len(content),
                     hashlib.sha256(content).hexdigest(), None if refers is not None else content))
    plain = [(*tuple(r)[:6], None if r.content is None else bytes(r.content)) for r in got]
    assert sorted(map(str, plain)) == sorted(map(str, want))
    listed = payload_archive.archive_files(spark, str(tmp_path / "a"))
    assert read_payload_archive(listed, with_content=False).count() == len(small)


def test_archive_of_long_names(spark, tmp_path):
    draw = random.Random(10)
    names = ["".join(chr(draw.randrange(33, 0x2000)) for _ in range(80_000)), "a" * 3_000_000, "short"]
    rows = [(k, name, b"body %d" % k, "x", "y") for k, name in enumerate(names)]
    files = write_payload_archive(spark.createDataFrame(rows, PAYLOADS).coalesce(1), str(tmp_path / "l"))
    for split in (1 << 23, 10_000):
        got = read_payload_archive(files, split_bytes=split).collect()
        assert sorted((int(r.raw_payload_id), r.original_basename, bytes(r.content)) for r in got) == [
            r[:3] for r in rows]


def test_archive_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], PAYLOADS)
    assert read_payload_archive(write_payload_archive(none, str(tmp_path / "b"))).collect() == []


def test_false_magic_is_passed_over(tmp_path):
    record = payload_archive.record_bytes("1", "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    good = zlib.compressobj(6, zlib.DEFLATED, 31)
    good = good.compress(record) + good.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(payload_archive.MAGIC + b"junk" + gzip.compress(b"no head") + good + payload_archive.MAGIC)
    system, where = payload_archive.local_path(str(path))
    with system.open_input_file(where) as handle:
        assert len(list(payload_archive.owned_records(handle, path.stat().st_size, 0, 1 << 20))) == 1
