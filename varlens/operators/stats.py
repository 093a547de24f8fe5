"""The one pass over rows that most answers need: additive sufficient statistics of a design.

``stats_pass`` accumulates, by key, n, the weights, and the sums of phi, phi y, phi phi', y and y^2. They
add and subtract, so folds, held-out sets and groups come from the same scan.

Two physical forms. Small designs are plain Catalyst sums, whole-stage compiled, combined map-side.
Larger ones are built inside Arrow batches with NumPy and leave each partition as one packed row per key,
which ``summed`` adds up in a tree, so that the driver sees one matrix for each key.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.plans.layout import Layout
from varlens.session import ship

#: Designs up to this many columns are summed by Catalyst.
SMALL = 12
#: Driver memory holds a few matrices of this many columns.
LARGEST = 6000
#: Bytes of partial sums that the driver adds up itself, at most; beyond, tasks add them up once more.
GATHERED = 1 << 26


@dataclass
class Stats:
    n: float
    sw: float
    sy: float
    yy: float
    s: np.ndarray
    b: np.ndarray
    c: np.ndarray

    @classmethod
    def zero(cls, f: int) -> Stats:
        return cls(0.0, 0.0, 0.0, 0.0, np.zeros(f), np.zeros(f), np.zeros((f, f)))

    def __add__(self, o: Stats) -> Stats:
        return Stats(self.n + o.n, self.sw + o.sw, self.sy + o.sy, self.yy + o.yy, self.s + o.s, self.b + o.b, self.c + o.c)

    def __sub__(self, o: Stats) -> Stats:
        return Stats(self.n - o.n, self.sw - o.sw, self.sy - o.sy, self.yy - o.yy, self.s - o.s, self.b - o.b, self.c - o.c)

    @property
    def mean(self) -> float:
        return self.sy / self.sw if self.sw else 0.0

    def centred(self, at: float | None = None) -> Stats:
        """The same design with y less its mean (or ``at``)."""
        m = self.mean if at is None else at
        return replace(self, sy=self.sy - m * self.sw, yy=self.yy - 2 * m * self.sy + m * m * self.sw, b=self.b - m * self.s)

    def demeaned(self) -> Stats:
        """Both y and the design less their weighted means."""
        p = self.s / self.sw
        return replace(self.centred(), s=np.zeros_like(self.s), b=self.b - self.mean * self.s, c=self.c - np.outer(p, p) * self.sw)

    def take(self, at: np.ndarray) -> Stats:
        return replace(self, s=self.s[at], b=self.b[at], c=self.c[np.ix_(at, at)])

    def rss(self, w: np.ndarray) -> float:
        return float(self.yy - 2 * w @ self.b + w @ self.c @ w)

    def pack(self) -> bytes:
        up = np.triu_indices(len(self.s))
        return np.concatenate([[self.n, self.sw, self.sy, self.yy], self.s, self.b, self.c[up]]).tobytes()

    @classmethod
    def unpack(cls, v: np.ndarray, f: int) -> Stats:
        c = np.zeros((f, f))
        up = np.triu_indices(f)
        c[up] = v[4 + 2 * f :]
        return cls(*v[:4], v[4 : 4 + f].copy(), v[4 + f : 4 + 2 * f].copy(), c + np.triu(c, 1).T)


def of_batch(phi: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Stats:
    """Statistics of rows in memory."""
    u = phi if w is None else phi * w[:, None]
    wy = y if w is None else y * w
    return Stats(float(len(y)), float(len(y) if w is None else w.sum()), float(wy.sum()), float(wy @ y), u.sum(axis=0), u.T @ y, u.T @ phi)


def _sums(df: DataFrame, layout: Layout, target: str, weight: str | None, by: str | None) -> dict:
    names = [f"_f{i}" for i in range(layout.size)]
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(*([F.col(by).alias("_key")] if by else []), w.cast("double").alias("_w"), F.col(target).cast("double").alias("_y"), *[c.alias(n) for c, n in zip(layout.columns(), names, strict=True)])
    col, wt, y = F.col, F.col("_w"), F.col("_y")
    sums = [F.count("*").alias("n"), F.sum(wt).alias("sw"), F.sum(wt * y).alias("sy"), F.sum(wt * y * y).alias("yy")]
    sums += [F.sum(wt * col(a)).alias(f"s{i}") for i, a in enumerate(names)]
    sums += [F.sum(wt * y * col(a)).alias(f"b{i}") for i, a in enumerate(names)]
    sums += [F.sum(wt * col(a) * col(names[j])).alias(f"c{i}_{j}") for i, a in enumerate(names) for j in range(i, len(names))]
    out, f = {}, layout.size
    for r in (rows.groupBy("_key") if by else rows.groupBy()).agg(*sums).collect():
        z = lambda name: float(r[name] or 0.0)  # noqa: E731, B023
        c = np.array([[z(f"c{min(i, j)}_{max(i, j)}") for j in range(f)] for i in range(f)]).reshape(f, f)
        out[r["_key"] if by else None] = Stats(float(r["n"]), z("sw"), z("sy"), z("yy"), np.array([z(f"s{i}") for i in range(f)]), np.array([z(f"b{i}") for i in range(f)]), c)
    return out


def summed(parts: DataFrame, size: int, keys: int = 1) -> dict[str, np.ndarray]:
    """The sums of packed vectors of ``size`` by key, from (key string, part int, v binary) rows, one or few for each partition.

    All partitions work side by side; about the root of their number of groups add up first. What they leave, a vector
    for each group and key, goes to the driver where ``keys`` of them are few bytes; else one task for each key adds up again, so
    that a single vector per key reaches the driver.
    """

    def merge(batches):
        sums: dict = {}
        for batch in batches:
            for k, data in zip(batch.column("key").to_pylist(), batch.column("v"), strict=True):
                v = np.frombuffer(data.as_buffer(), float)
                sums[k] = sums[k] + v if k in sums else v
        for n, (k, v) in enumerate(sums.items()):
            yield pa.record_batch({"key": pa.array([k]), "part": pa.array([n], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

    schema = "key string, part int, v binary"
    groups = max(1, int(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    first = parts.repartition(groups, "key", F.pmod(F.col("part"), F.lit(groups))).mapInArrow(merge, schema)
    if groups * keys * size * 8 > GATHERED:
        first = first.repartition(max(1, groups // 2), "key").mapInArrow(merge, schema)
    out: dict[str, np.ndarray] = {}
    for r in first.collect():
        v = np.frombuffer(r["v"], float)
        out[r["key"]] = out[r["key"]] + v if r["key"] in out else v
    return out


def packed_rows(run, size: int, merged: int = 1):
    """A mapInArrow function that leaves the sum of run(batch), a vector of ``size``, as one row for ``summed``. Batches of fewer
    than ``merged`` rows are put together first."""

    def of_partition(batches):
        from pyspark import TaskContext

        out, waiting, rows = np.zeros(size), [], 0

        def whole():
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            return sum((run(b) for b in table.to_batches()), np.zeros(size))

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
                if rows >= merged:
                    out += whole()
                    rows = 0
        if waiting:
            out += whole()
        yield pa.record_batch({"key": pa.array([""]), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    return of_partition


def row_sums(rows: DataFrame, run, size: int, merged: int = 1) -> np.ndarray:
    """The sum over all Arrow batches of run(batch), in one job over all partitions."""
    ship(rows.sparkSession)
    return summed(rows.mapInArrow(packed_rows(run, size, merged), "key string, part int, v binary"), size).get("", np.zeros(size))


def stats_pass(df: DataFrame, layout: Layout, target: str, weight: str | None = None, by: str | None = None, small: int = SMALL) -> dict:
    """Statistics by the values of ``by`` (key None without it). Rows with a null or NaN in a used column must be gone."""
    f = layout.size
    if f > LARGEST:
        raise ValueError(f"{f} columns: beyond {LARGEST} the matrices don't fit the driver; use fewer terms or a pair scan")
    if f <= small:
        return _sums(df, layout, target, weight, by) or {None: Stats.zero(f)}
    ship(df.sparkSession)
    features = list(layout.features)
    used = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    key = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(key.alias("_key"), F.col(target).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *used)

    def partial(batches):
        from pyspark import TaskContext

        part, sums = TaskContext.get().partitionId(), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))], axis=1)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
            phi = layout.batch(x)
            keys = np.array([k if k is not None else "\0" for k in batch.column("_key").to_pylist()], object)
            for k in dict.fromkeys(keys):
                at = keys == k
                got = of_batch(phi[at], y[at], w[at] if weight else None)
                sums[k] = sums[k] + got if k in sums else got
        for k, v in sums.items():
            yield pa.record_batch({"key": pa.array([k]), "part": pa.array([part], pa.int32()), "v": pa.array([v.pack()], pa.binary())})

    kind = dict(df.dtypes).get(by, "string") if by else None
    back = int if kind in ("int", "bigint", "smallint", "tinyint") else str
    got = summed(rows.mapInArrow(partial, "key string, part int, v binary"), 4 + 2 * f + f * (f + 1) // 2, 16 if by else 1)
    out = {None if not by or k == "\0" else back(k): Stats.unpack(v, f) for k, v in got.items()}
    return out or {None: Stats.zero(f)}


def total(stats: dict) -> Stats:
    """All keys together."""
    return sum(list(stats.values())[1:], next(iter(stats.values())))
