"""Token counts and packing against the tokenizer library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import encoding, page_tokens
from ledgerloom.llm.encoding import PieceEncoder
from ledgerloom.llm.packing import pack_pages, padding, plan_cuts
from ledgerloom.llm.page_tokens import count_page_tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "raw_page_id bigint, page_text string, n_tokens string, length int"
TEXTS = [
    None, "", " ", "\n\n", "Opening Balance: $1,200.00\nClosing balance:  $900.00",
    "a" * 5000, "<|endoftext|>", "x<|endoftext|><|startoftext|> y", "你好 мир 😀 naïve — “quote”",
    "don't WE'LL it's 'S  \t tabs\r\n\r\nand   gaps   ", "ǅ ſ ª º ² ½ İstanbul ı \xa0 \xad \x1c",
    "Fee. Refund! Total? " * 4000, "日本語のテキスト" * 3000, "!?" * 3000, " " * 9000 + "end",
]


def rows():
    found = [(k, t, "clash", 1) for k, t in enumerate(TEXTS)]
    return [*found, (3, TEXTS[4], "clash", 2), (4, TEXTS[4], "clash", 1), (None, "lost id", None, None)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_library_ids(path, monkeypatch):
    monkeypatch.setattr(encoding, "_LONG", 200)
    coder, draw = PieceEncoder(path), random.Random(3)
    letters = "aAzZéÉñß09²½ \t\n\r  ''s't'll.,!?<|—“”…·¿Ǆſ°ªİı\xad\xa0你\x1c<|endoftext|>"
    texts = [t or "" for t in TEXTS] + [
        "".join(draw.choice(letters[:draw.choice((20, 40, len(letters)))])
                for _ in range(draw.randrange(400))) for _ in range(600)]
    for text in texts:
        want = coder.whole.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == want
        starts, before, ids = coder.read(text)
        assert ids.tolist() == want and before[-1] == len(want) and starts[-1] == len(text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("chunk,overlap", [(page_tokens.CHUNK_CHARS, 512), (900, 40), (64, 64)])
def test_counts_equal_whole_encoding(spark, path, chunk, overlap):
    whole = Tokenizer.from_file(path)
    got = count_page_tokens(spark.createDataFrame(rows(), SCHEMA), path, chunk, overlap).collect()
    want = sorted(
        str((r[0], len((r[1] or "").encode()), len(whole.encode(r[1] or "", add_special_tokens=False).ids)))
        for r in rows())
    assert sorted(str((r.raw_page_id, r.n_bytes, r.n_tokens)) for r in got) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert count_page_tokens(none, BYTE).collect() == []
    assert pack_pages(none, WORD).collect() == []


def test_packing_keeps_every_id(spark):
    whole = Tokenizer.from_file(WORD)
    frame = spark.createDataFrame([r for r in rows() if r[0] != 3 or r[3] == 1], SCHEMA).coalesce(2)
    pieces, by_page, by_sequence = pack_pages(frame, WORD).collect(), defaultdict(list), defaultdict(list)
    for piece in pieces:
        by_page[piece.raw_page_id].append(piece)
        by_sequence[piece.sequence_id].append(piece)
    for page, text, *_ in rows()[:len(TEXTS)]:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        if page == 4:
            continue  # twice in the table
        at = 0
        for piece in sorted(by_page[page], key=lambda p: p.start):
            assert piece.start == at and piece.page_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at:at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    assert len(by_page[4]) == 2
    padded = sum(padding(sum(p.length for p in found), 2048) for found in by_sequence.values())
    assert padded <= 0.01 * sum(p.length for p in pieces)
    for found in by_sequence.values():
        at = 0
        for piece in sorted(found, key=lambda p: p.seq_offset):
            assert piece.seq_offset == at and piece.length > 0
            at += piece.length
        assert at <= 2048


def test_cuts_are_of_least_cost():
    draw = np.random.default_rng(2)
    for _ in range(60):
        places = np.unique(np.concatenate([[0], draw.integers(1, 60, 14), [60]]))
        places = np.unique(np.concatenate([places, np.arange(0, 61, 9)]))
        costs = draw.integers(0, 6, len(places))
        costs[[0, -1]] = 0
        window, best = 20, {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + padding(int(places[j] - places[i]), window) for i in range(j)
                          if places[j] - places[i] <= window) + int(costs[j])
        cuts = plan_cuts(places, costs, window)
        paid = sum(padding(int(b - a), window) for a, b in zip([0, *cuts], cuts, strict=False))
        paid += sum(int(costs[np.flatnonzero(places == c)[0]]) for c in cuts)
        assert paid == best[len(places) - 1]
