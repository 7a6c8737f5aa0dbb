"""What the stages of the pipeline once left out."""

import random

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(draw, count):
    return " ".join(f"word{draw.randrange(5000)}" for _ in range(count))


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", s, len(t)) for k, t, s in rows], SCHEMA)


def test_spread_lines_go_from_pages_they_fill_and_copies_spread_none(spark):
    draw = random.Random(4)
    footer = [words(draw, 20), words(draw, 20)]
    own = {k: words(draw, 10) for k in range(24)}
    rows = [(k, "\n".join([own[k], *footer]), f"src{k % 12}") for k in own]
    rows += [(100, "\n".join(footer), "src1")]
    shared = [words(draw, 60) for _ in range(4)]
    # Near copies of one page in twelve sources: one word differs, and a whole line is shared by all.
    near = {200 + k: "\n".join([*shared, f"{shared[0]} mark{k}"]) for k in range(12)}
    rows += [(k, t, f"src{k % 12}") for k, t in near.items()]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(spark, rows), "").collect()}
    assert {k: got[k] for k in own} == own
    assert got[100] == "\n".join(footer)
    assert {k: got[k] for k in near} == near


def test_rows_of_one_id_or_none_are_told_apart(spark, tmp_path):
    draw = random.Random(8)
    a, b, c, item = (words(draw, 60) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (None, c, "x"), (None, c, "y"), (None, b + " more", "x"),
            (2, b, "x")]
    near = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "")
    assert sorted((str(r.doc_id), r.text) for r in near.collect()) == sorted([("1", a), ("1", b), ("None", c)])
    alone = [(3, a, "x"), (3, a, "x"), (3, b, "x"), (3, c, "y"), (4, b, "x")]
    near = corpus_pipeline.near_duplicates(spark, documents(spark, alone), "")
    assert sorted(r.text for r in near.collect()) == sorted([a, b, c])

    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{a} {item}", "x"), (None, b, "x"), (5, f"{b} {item} {c}", "x"), (5, c, "x")]
    clean = corpus_pipeline.decontamination(spark, documents(spark, rows), str(tmp_path))
    assert sorted((str(r.doc_id), r.text) for r in clean.collect()) == sorted([("None", b), ("5", c)])
