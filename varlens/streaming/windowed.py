"""A fit per tumbling event-time window, from additive statistics.

Batch: one stats pass by window. Streaming: ``stream_stats`` keeps the sums of a small design per window with a
watermark, as a plain streaming aggregation, so late rows are dropped and finished windows are emitted once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.operators.ridge import solve
from varlens.operators.stats import Stats, stats_pass
from varlens.plans.layout import Layout


def with_time(df: DataFrame, ts: str, length: str = "1 day") -> DataFrame:
    """``df`` with ``window``, its start as text, and ``time``, the place in the day from 0 to 1."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts)).cast("double")
    return df.withColumn("window", F.date_format(F.window(ts, length)["start"], "yyyy-MM-dd HH:mm:ss")).withColumn("time", seconds / F.lit(86400.0))


def fit_windows(df: DataFrame, layout: Layout, target: str, window: str, lam: float) -> list[dict]:
    """A row per window: n, mean and coefficients."""
    out = []
    for k, s in sorted(stats_pass(df, layout, target, by=window).items()):
        out.append({"window": k, "n": int(s.n), "mean": s.mean, "w": solve(s.centred(), np.full(layout.size, lam)).w})
    return out


def stream_stats(events: DataFrame, layout: Layout, target: str, ts: str, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Streaming sums per window: ``window, n, sy, yy, s0.., b0.., c0_0..`` for designs of a few columns."""
    cols = layout.columns()
    y = F.col(target).cast("double")
    rows = events.withWatermark(ts, late).select(F.window(ts, length).alias("window"), y.alias("_y"), *[c.alias(f"_f{i}") for i, c in enumerate(cols)])
    n, f = len(cols), lambda i: F.col(f"_f{i}")
    sums = [F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") ** 2).alias("yy")]
    sums += [F.sum(f(i)).alias(f"s{i}") for i in range(n)] + [F.sum(f(i) * F.col("_y")).alias(f"b{i}") for i in range(n)]
    sums += [F.sum(f(i) * f(j)).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    return rows.groupBy("window").agg(*sums)


def stats_of_row(row, size: int) -> Stats:
    """One emitted row as statistics; rows of the same window add up."""
    c = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
    return Stats(float(row["n"]), float(row["n"]), float(row["sy"]), float(row["yy"]), np.array([row[f"s{i}"] for i in range(size)], float), np.array([row[f"b{i}"] for i in range(size)], float), c)
