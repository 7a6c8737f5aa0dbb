import json

import pytest

from ledgerloom.plans.derive import derive_ledger
from ledgerloom.sources import pages as PG
from ledgerloom.sources import payloads as PL
from ledgerloom.sources import stage
from ledgerloom.sources.ledger_store import read_ledger, write_ledger


def test_scan_payloads(spark, tmp_path):
    for name, content in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b""), ("c.txt", b"%PDF"),
                          ("d.PDF", b"plain")):
        (tmp_path / name).write_bytes(content)
    got = {r.original_basename: (r.byte_length, r.refused)
           for r in PL.scan_payloads(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": (10, None), "b.pdf": (0, "empty_file"), "c.txt": (4, "not_a_pdf_name"),
                   "d.PDF": (5, "not_pdf_bytes")}


def test_scan_payloads_in_folders_and_slices(spark, tmp_path):
    assert PL.scan_payloads(spark, str(tmp_path)).collect() == []
    for k in range(30):
        (tmp_path / f"in {k % 3}").mkdir(exist_ok=True)
        (tmp_path / f"in {k % 3}" / f"{k}.pdf").write_bytes(b"%PDF" + bytes([65 + k]) * k)
    found = PL.scan_payloads(spark, f"file://{tmp_path}", 5 * PL.OPEN_BYTES)
    assert found.rdd.getNumPartitions() == 8
    assert sorted(r.byte_length for r in found.collect()) == list(range(4, 34))


def test_empty_content_is_refused(spark):
    files = spark.createDataFrame([("/in/b.pdf", b"")], "path string, content binary")
    assert PL.payload_facts(files).first().refused == "empty_file"


def test_pages_from_fixtures(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(
        {"institution": "Standard Bank", "account_type": "Checking", "raw_text": "A\nB"}, indent=1))
    row = PG.pages_from_fixtures(spark, str(tmp_path)).first()
    assert (row.doc_id, row.page_number, row.page_text) == ("one.json", 1, "A\nB")


def test_store_is_idempotent(spark, sf_dir, tmp_path):
    ledger = derive_ledger(spark, sf_dir)
    path = str(tmp_path / "ledger")
    for _ in range(2):
        write_ledger(ledger, path)
    stored = read_ledger(spark, path)
    for name, frame in ledger.tables().items():
        assert getattr(stored, name).count() == frame.count(), name


def test_stage_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = stage.stage_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir())
    assert stage.staged(spark.range(3), "t").count() == 3


def test_tokens_round_half_to_even(spark):
    words = spark.createDataFrame(
        [(1, 1, 0, "w", -1.0, 0.0025, -1.0, 0.0025)],
        "doc_id int, page_number int, word_index int, text string, x0 double, top double, "
        "x1 double, bottom double")
    row = PG.words_to_tokens(words).first()
    assert (row.x0_mp, row.x1_mp, row.y0_mp, row.y1_mp) == (0, 1, 2, 3)
    assert pytest.approx(1) == row.x1_mp - row.x0_mp
