"""Line dedup by overlapping three-line windows. DataFrame functions only.

Every run of three consecutive lines of a text is one window, known by a 128-bit hash of its lines.
A window that occurs anywhere else in the table, or again in the same text, is repeated; its first
occurrence in the order (doc_id, text hash, line number) stays and every later one goes. The line
ranges that later occurrences cover are merged, and a text keeps the lines outside them.

Scale: windows are counted with map-side partial sums, so a passage that a third of all documents
share is a few rows per task. Windows that many rows hold (at most ``HOT`` of them can exist, for each
holds over 1/HOT of all windows) are matched through a broadcast of that proven size; for all others
the join spreads evenly. Texts move at most once, when joined with their covered ranges.

Defined results: a null text stays null, with no lines; texts of fewer than three lines, the empty
text included, have no window and stay as they are; lines compare exactly, without trimming; rows
with the same doc_id and text are one occurrence and get the same result; a null doc_id counts as the
largest; an empty table gives an empty result; other columns pass through (names starting with
``_ld_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.common import NO_ID
from varlens.session import Scratch

WINDOW = 3
HOT = 10_000


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("_ld_k", F.coalesce(F.col("doc_id"), F.lit(NO_ID))).withColumn("_ld_t", F.xxhash64("text"))


def covered_ranges(docs: DataFrame) -> DataFrame:
    """``_ld_k, _ld_t, _ld_cover``: per text with later occurrences, its merged line ranges [start, end)."""
    scratch = Scratch(docs.sparkSession, "lines")
    at = F.sequence(F.lit(0), F.size("_ld_lines") - WINDOW)
    lines = F.col("_ld_lines")

    def window(i):
        run = [lines[i + j] for j in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit("second"), *run).alias("h2"))

    windows = _key(docs.select("doc_id", "text")).withColumn("_ld_lines", F.split("text", "\n", -1)).filter(F.size("_ld_lines") >= WINDOW)
    windows = windows.select("_ld_k", "_ld_t", F.explode(F.transform(at, window)).alias("w")).select("_ld_k", "_ld_t", "w.*")
    windows = scratch.save(windows, "windows")
    here = F.struct("_ld_k", "_ld_t", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.save(first, "first")
    total = windows.count()
    hot = first.filter(F.col("n") > total / HOT).drop("n")  # fewer than HOT rows
    cold = first.filter(F.col("n") <= total / HOT).drop("n")
    later = windows.join(F.broadcast(hot), ["h1", "h2"]).unionByName(windows.join(cold, ["h1", "h2"]))
    later = later.filter(here != F.col("first")).select("_ld_k", "_ld_t", "pos").distinct()
    run = Window.partitionBy("_ld_k", "_ld_t").orderBy("pos")
    opens = F.coalesce(F.col("pos") - F.lag("pos").over(run) > WINDOW, F.lit(True)).cast("int")
    later = later.withColumn("_open", opens).withColumn("_range", F.sum("_open").over(run))
    ranges = later.groupBy("_ld_k", "_ld_t", "_range").agg(F.min("pos").alias("start"), (F.max("pos") + WINDOW).alias("end"))
    return ranges.groupBy("_ld_k", "_ld_t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_ld_cover"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated windows, plus ``n_lines`` and ``n_removed``."""
    cover = covered_ranges(docs)
    joined = _key(docs).join(cover, ["_ld_k", "_ld_t"], "left").withColumn("_ld_lines", F.split("text", "\n", -1))
    none = F.array().cast("array<int>")
    starts = F.coalesce(F.col("_ld_cover.start"), none)
    ends = F.coalesce(F.col("_ld_cover.end"), none)
    total = F.coalesce(F.size("_ld_lines"), F.lit(0))
    total = F.when(F.col("text").isNull(), F.lit(0)).otherwise(total)
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(total)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("_ld_lines"), g["a"] + 1, g["b"] - g["a"])))
    removed = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    text = F.when(F.col("_ld_cover").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    plain = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return joined.select(*plain, text.alias("text"), total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
