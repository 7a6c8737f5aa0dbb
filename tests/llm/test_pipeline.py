"""The pipeline on planted documents, and the registered queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")

WORDS = "fee deposit interest wire transfer payroll card refund check balance ledger account".split()
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def prose(draw, count):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(400)) for _ in range(count))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, documents by kind): clean, toxic, copies, leaks, boilerplate, empty ones."""
    draw, folder = random.Random(12), str(tmp_path_factory.mktemp("planted"))
    rows, kinds, labels = [], {}, []

    def add(kind, text, source=None):
        key = len(rows)
        rows.append((key, text, "en", source or f"src{key % 20}", len(text or ""), "clash"))
        kinds.setdefault(kind, []).append(key)
        return key

    for _ in range(300):
        labels.append((add("clean", prose(draw, 80)), 1, 0))
    for _ in range(100):
        text = prose(draw, 60).split()
        text[draw.randrange(60)] = draw.choice(["wretched", "scoundrel"])
        labels.append((add("toxic", " ".join(text)), 0, 1))
    base = prose(draw, 120)
    for k in range(4):
        near = base.split()
        near[k * 20] = "edited"
        add("near", " ".join(near))
    for _ in range(3):
        add("exact", rows[0][1])
    items = [(k, prose(draw, 14)) for k in range(3)]
    for k, item in items:
        add("leak", f"{prose(draw, 30)} {item.upper()[:-3]}xy {prose(draw, 10)}")
    for k in range(24):
        add("lined", f"{prose(draw, 40)}\n  Member FDIC notice\n{prose(draw, 40)}", f"src{k % 12}")
    for text in (None, "", " \n"):
        add("empty", text)
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, kinds, {r[0]: r[1] for r in rows}


def test_planted_cases_are_caught_and_clean_ones_kept(spark, planted):
    folder, kinds, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "line_dedup":
            for r in docs.filter(F.col("doc_id").isin(kinds["lined"])).collect():
                assert "FDIC" not in r.text and r.n_chars == len(r.text)
                assert r.text == texts[r.doc_id].replace("  Member FDIC notice\n", "")
    assert len(set(kinds["toxic"]) & kept["toxicity"]) <= 5
    assert len(set(kinds["clean"]) - kept["toxicity"]) <= 3
    assert kept["line_dedup"] == kept["toxicity"]
    near = [d for d in kinds["near"] if d in kept["line_dedup"]]
    assert set(near) & kept["near_duplicates"] == {min(near)}
    same = [d for d in [kinds["clean"][0], *kinds["exact"]] if d in kept["line_dedup"]]
    assert set(same) & kept["near_duplicates"] == {min(same)}
    gone = kept["near_duplicates"] - kept["decontamination"]
    assert gone == set(kinds["leak"]) & kept["near_duplicates"]
    assert kept["packing"] == kept["decontamination"]
    assert set(kinds["empty"]) <= kept["packing"]


def test_run_and_registration(spark, planted):
    folder, _, _ = planted
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sizes = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(0 < r.n <= 2048 for r in sizes)
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    frame = QUERIES[name][0](spark, sf_dir)
    columns = sorted(frame.columns)
    found = con.execute(QUERIES[name][1])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in frame.collect()) == sorted(
        str([r[k] for k in at]) for r in found.fetchall())
