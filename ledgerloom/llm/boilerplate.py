"""Lines that many institutions print: spread by sketch, near the threshold by exact count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import staged

MIN_INSTITUTIONS = 10
LG_K = 12
# Six standard errors of a sketch with 2^12 registers, rounded up; small counts get room for 2.
BAND = 0.1
BAND_FLOOR = 2

_BLANKS = " \t\r"


def _row_key() -> list[Column]:
    parts = ["raw_page_id", "institution", "page_text"]
    return [F.xxhash64(F.lit(salt), *parts).alias(f"_row{salt}") for salt in (1, 2)]


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(_BLANKS))


def page_lines(raw_pages: DataFrame) -> DataFrame:
    """(row key, line number from 0, line hash, institution, bytes) of every line with ink."""
    rows = raw_pages.select(
        *_row_key(), "institution", F.posexplode(F.split("page_text", "\n", -1)).alias("_at", "_line"))
    line = _stripped(F.col("_line"))
    return rows.filter(F.length(line) > 0).select(
        "_row1", "_row2", "institution", "_at",
        F.xxhash64(F.lit(1), line).alias("_line1"), F.xxhash64(F.lit(2), line).alias("_line2"),
        F.octet_length(line).alias("_bytes"),
    )


def spread_lines(lines: DataFrame, min_institutions: int = MIN_INSTITUTIONS) -> DataFrame:
    """Hashes of the lines that at least ``min_institutions`` distinct institutions print."""
    line = ["_line1", "_line2"]
    sketched = lines.groupBy(*line).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("institution", LG_K)).alias("_about"))
    margin = max(BAND_FLOOR, BAND * min_institutions)
    sure = sketched.filter(F.col("_about") > min_institutions + margin).select(*line)
    near = sketched.filter(F.col("_about").between(
        min_institutions - margin, min_institutions + margin)).select(*line)
    counted = (
        lines.select(*line, "institution").join(near, line, "left_semi")
        .groupBy(*line).agg(F.countDistinct("institution").alias("_exact"))
        .filter(F.col("_exact") >= min_institutions).select(*line)
    )
    return sure.unionByName(counted)


def _class_sites(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """(row key, institution): the one institution that the rows of a near-copy class count for."""
    tag = F.xxhash64("page_text")
    known = classes.select(
        F.col("raw_page_id").alias("_page"), F.col("tag").alias("_tag"), "class_id").distinct()
    rows = pages.select("raw_page_id", "institution", tag.alias("_text"), *_row_key()).distinct()
    named = rows.join(
        known, rows["raw_page_id"].eqNullSafe(known["_page"]) & (rows["_text"] == known["_tag"]), "left"
    ).select("_row1", "_row2", "raw_page_id", "institution", F.coalesce(
        F.concat(F.lit("class "), F.col("class_id").cast("string")),
        F.concat(F.lit("text "), F.col("_text").cast("string"))).alias("_class"))
    first = named.filter("institution IS NOT NULL").groupBy("_class").agg(
        F.min_by("institution", F.struct("raw_page_id", "institution")).alias("_site"))
    return named.join(first, "_class").select("_row1", "_row2", F.col("_site").alias("institution"))


def strip_spread_lines(raw_pages: DataFrame, min_institutions: int = MIN_INSTITUTIONS,
                       classes: DataFrame | None = None) -> DataFrame:
    """Page text without the lines that many institutions print.

    ``raw_pages`` has raw_page_id, institution and page_text. A line is what stands between line
    breaks, compared without blanks at its ends; lines without ink are never removed. A line is
    spread if at least ``min_institutions`` distinct institutions print it: a sketch for each line
    hash decides the clear cases, lines within six standard errors of the threshold are counted
    exactly. Spread lines are removed from every page that has another inked line; a page of nothing else
    stays whole. With ``classes`` (rows of ``near_duplicate_pages`` on the same pages) pages of one class
    count for one institution, so that copies spread no line.

    Returns every input row and column with page_text replaced, and n_lines (with ink), n_spread,
    n_removed; an input column of such a name is replaced. Null text counts as empty and gives empty text; a
    null institution counts for no line's spread; repeated rows are treated alike and all kept.
    """
    # The input's own columns are carried in one, so that no name of theirs meets one of these.
    pages = raw_pages.select(
        "raw_page_id", "institution", F.coalesce("page_text", F.lit("")).alias("page_text"),
        F.struct("*").alias("_all"))
    lines = page_lines(pages.select("raw_page_id", "institution", "page_text"))
    row = ["_row1", "_row2"]
    counted = lines if classes is None else lines.drop("institution").join(
        _class_sites(pages, classes), row)
    # Staged, so that the join's two sides are plain exchanges and a hot line's side can be split.
    spread = staged(spread_lines(counted, min_institutions), "spread-lines")
    found = (
        lines.join(spread, ["_line1", "_line2"], "left_semi")
        # A repeated row meets its twin here; its positions count once.
        .groupBy(*row).agg(F.collect_set(F.struct("_at", "_bytes")).alias("_found"))
    )
    keyed = pages.select("*", *_row_key()).join(found, row, "left")
    inked = F.aggregate(
        F.split("page_text", "\n", -1), F.lit(0).cast("bigint"),
        lambda n, x: n + F.octet_length(_stripped(x)))
    spread_bytes = F.aggregate(
        F.col("_found"), F.lit(0).cast("bigint"), lambda n, x: n + x["_bytes"])
    removed = F.when(F.col("_found").isNotNull() & (spread_bytes < inked),
                     F.transform("_found", lambda x: x["_at"]))

    def without(page: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(page["lines"]) - 1)
        kept = F.array_except(places, page["removed"])
        return F.array_join(F.transform(kept, lambda i: F.get(page["lines"], i)), "\n")

    # The lines are bound once, as a lambda's variable; a captured split would run for each line.
    page = F.struct(F.split("page_text", "\n", -1).alias("lines"), F.col("_removed").alias("removed"))
    n_lines = F.size(F.filter(F.split("page_text", "\n", -1), lambda x: F.length(_stripped(x)) > 0))
    new = {
        "n_lines": n_lines.cast("bigint"),
        "n_spread": F.coalesce(F.size("_found"), F.lit(0)).cast("bigint"),
        "n_removed": F.coalesce(F.size("_removed"), F.lit(0)).cast("bigint"),
        "page_text": F.when(F.col("_removed").isNull(), F.col("page_text")).otherwise(
            F.get(F.transform(F.array(page), without), F.lit(0))),
    }
    kept = {name: F.col("_all").getField(name) for name in raw_pages.columns} | new
    return keyed.withColumn("_removed", removed).select(*[c.alias(n) for n, c in kept.items()])


def strip_sql(table: str, key: str, site: str, text: str, least: int = MIN_INSTITUTIONS) -> str:
    """The rule of ``strip_spread_lines`` as common table expressions of another SQL engine."""
    return f"""
    rows_ AS (SELECT *, row_number() OVER (ORDER BY {key}) AS row_ FROM {table}),
    parts_ AS (SELECT row_, {site} AS site_, string_split(coalesce({text}, ''), chr(10)) AS p_ FROM rows_),
    lines_ AS (SELECT row_, site_, unnest(p_) AS line_, unnest(range(len(p_))) AS at_ FROM parts_),
    inked_ AS (SELECT *, trim(line_, ' ' || chr(9) || chr(13)) AS ink_ FROM lines_),
    spread_ AS (SELECT ink_ FROM inked_ WHERE ink_ <> '' GROUP BY ink_
                HAVING count(DISTINCT site_) >= {least}),
    marked_ AS (SELECT i.*, s.ink_ IS NOT NULL AS spread_
                FROM inked_ i LEFT JOIN spread_ s ON i.ink_ = s.ink_),
    weighed_ AS (SELECT row_, count(*) FILTER (ink_ <> '') AS n_lines,
                 count(*) FILTER (spread_) AS n_spread,
                 coalesce(sum(strlen(ink_)) FILTER (spread_), 0) < sum(strlen(ink_)) AS strip_
                 FROM marked_ GROUP BY row_),
    stripped_ AS (SELECT m.row_, any_value(w.n_lines) AS n_lines, any_value(w.n_spread) AS n_spread,
                  count(*) FILTER (w.strip_ AND m.spread_) AS n_removed,
                  coalesce(string_agg(m.line_, chr(10) ORDER BY m.at_)
                           FILTER (NOT (w.strip_ AND m.spread_)), '') AS kept_
                  FROM marked_ m JOIN weighed_ w ON m.row_ = w.row_ GROUP BY m.row_)"""
