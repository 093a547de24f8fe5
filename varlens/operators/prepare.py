"""From a raw table to the unit cube: checks, splits, quantile transform, ties, out-of-range rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varlens.session import ship

MIN_DISTINCT, MAX_SHARE = 10, 0.2
KNOTS = 1000
#: Cells of a feature's histogram, and values of a feature that finish on the driver, at most.
CELLS, FINISH = 1 << 14, 1 << 16


def check_inputs(df: DataFrame, features: list[str], target: str | None = None) -> None:
    """ValueError for missing or repeated columns, non-numeric types, nulls, NaN, infinities or a constant target. One aggregation."""
    used = [*features, *([target] if target else [])]
    if len(set(used)) < len(used) or not features:
        raise ValueError("features and target must be different columns, and there must be some")
    kinds = dict(df.dtypes)
    for c in used:
        if c not in kinds:
            raise ValueError(f"no column {c!r}")
        if kinds[c].split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"):
            raise ValueError(f"column {c!r} is {kinds[c]}, not numeric; encode it first")
    num = lambda c: F.col(c).cast("double")
    bad = [F.count_if(num(c).isNull() | F.isnan(num(c)) | (F.abs(num(c)) == float("inf"))).alias(f"b{i}") for i, c in enumerate(used)]
    ends = [F.min(num(target)).alias("lo"), F.max(num(target)).alias("hi")] if target else []
    row = df.agg(F.count("*").alias("n"), *bad, *ends).head()
    if not row["n"]:
        raise ValueError("the table has no rows")
    if wrong := [c for i, c in enumerate(used) if row[f"b{i}"]]:
        raise ValueError(f"nulls, NaN or infinities in {wrong}")
    if target and row["lo"] == row["hi"]:
        raise ValueError("the target is constant")


def tied_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, n_distinct, max_share, tied: fewer than 10 values, or one in over a fifth of the rows."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features])).alias("s")).select("s.*")
    counts = long.groupBy("feature", "v").count()
    out = counts.groupBy("feature").agg(F.count("*").alias("n_distinct"), (F.max("count") / F.sum("count")).alias("max_share"))
    return out.withColumn("tied", (F.col("n_distinct") < MIN_DISTINCT) | (F.col("max_share") > MAX_SHARE))


def split_by_key(key: Column, val: float = 0.15, test: float = 0.15, parts: int = 20) -> Column:
    """train, val or test by an integer key modulo ``parts``: stable, and the same in any engine."""
    a, b = round(parts * (1 - val - test)), round(parts * (1 - test))
    k = F.pmod(key, F.lit(parts))
    return F.when(k < a, "train").when(k < b, "val").otherwise("test")


def fold_by_rank(rank: Column, n: int, k: int, scheme: str = "strided") -> Column:
    """Fold of the row with 0-based rank among n rows: strided (rank mod k), contiguous (sizes differ by one at most, larger
    first) or remainder_last (the last fold takes the remainder)."""
    if scheme == "strided":
        return (rank % k).cast("int")
    if scheme == "remainder_last":
        return F.least(F.floor(rank / max(n // k, 1)), F.lit(k - 1)).cast("int")
    big, size = n % k, n // k
    edge = big * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(big + F.floor((rank - edge) / max(size, 1))).cast("int")


def _histogram(df: DataFrame, features: list[str], edges: list[np.ndarray]) -> list[dict[int, tuple]]:
    """For each feature, the rows, least and greatest value of every cell (edges[j - 1], edges[j]] that has rows; one pass."""

    def run(batches):
        count = [np.zeros(len(e) + 1, np.int64) for e in edges]
        low, high = [np.full(len(e) + 1, np.inf) for e in edges], [np.full(len(e) + 1, -np.inf) for e in edges]
        for batch in batches:
            for i in range(len(edges)):
                x = batch.column(i).to_numpy(zero_copy_only=False)
                x = np.sort(x[~np.isnan(x)])
                if not len(x):
                    continue
                cell = np.searchsorted(edges[i], x, side="left")
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                which = cell[at]
                count[i][which] += np.diff(np.append(at, len(x)))
                low[i][which] = np.minimum(low[i][which], x[at])
                high[i][which] = np.maximum(high[i][which], x[np.append(at[1:], len(x)) - 1])
        for i in range(len(edges)):
            at = np.flatnonzero(count[i])
            yield pa.record_batch({"f": pa.array(np.full(len(at), i, np.int32)), "c": pa.array(at.astype(np.int32)), "n": pa.array(count[i][at]), "lo": pa.array(low[i][at]), "hi": pa.array(high[i][at])})

    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    cells = rows.mapInArrow(run, "f int, c int, n long, lo double, hi double").groupBy("f", "c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out: list[dict[int, tuple]] = [{} for _ in features]
    for r in cells.collect():  # as many cells as edges, at most
        out[r["f"]][r["c"]] = (r["n"], r["lo"], r["hi"])
    return out


def _within(df: DataFrame, features: list[str], wanted: list[list[tuple[float, float]]]) -> list[np.ndarray]:
    """For each feature, its values within the closed ranges, sorted; the caller knows that they are few. One pass."""
    todo = [i for i, w in enumerate(wanted) if w]
    if not todo:
        return [np.zeros(0) for _ in features]
    ranges = {i: tuple(np.array(z) for z in zip(*wanted[i], strict=True)) for i in todo}

    def run(batches):
        for batch in batches:
            for j, i in enumerate(todo):
                x, (lo, hi) = batch.column(j).to_numpy(zero_copy_only=False), ranges[i]
                at = np.searchsorted(lo, x, side="right") - 1
                yield pa.record_batch({"f": pa.array([i], pa.int32()), "x": pa.array([x[(at >= 0) & (x <= hi[at])].tobytes()], pa.binary())})

    found: list[list[bytes]] = [[] for _ in features]
    for r in df.select(*[F.col(features[i]).cast("double").alias(f"x{i}") for i in todo]).mapInArrow(run, "f int, x binary").filter(F.length("x") > 0).collect():
        found[r["f"]].append(r["x"])
    return [np.sort(np.frombuffer(b"".join(f), float)) for f in found]


def order_statistics(df: DataFrame, features: list[str], ranks: np.ndarray, cells: int = CELLS, finish: int = FINISH) -> np.ndarray:
    """The values of the given 0-based ranks of every feature (features x ranks), exact, without sorting or gathering a column.

    A histogram of ``cells`` cells between least and greatest value tells which cell holds each rank. Cells that hold a wanted rank and
    more than one value are cut again, in as many parts as ``cells`` allows, pass after pass for all features at once, until the
    values in them are ``finish`` for a feature at most; these finish on the driver. A task's state is the cells', and a value that a
    third of the rows share fills a cell of its own. NaN and null take no part.
    """
    ship(df.sparkSession)
    ranks = np.asarray(ranks, np.int64)
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    ends = df.agg(*[f(num(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).head()
    edges = [np.unique(np.linspace(ends[f"a{i}"], ends[f"b{i}"], cells)) if ends[f"a{i}"] is not None else np.zeros(1) for i in range(len(features))]
    known: list[dict[int, float]] = [{} for _ in features]  # by rank
    #: Of each feature: (rows below, rows, least, greatest value) of the cells that still hold wanted ranks.
    while True:
        open_: list[list[tuple]] = []
        for i, found in enumerate(_histogram(df, features, edges)):
            below, rows = 0, []
            for c in sorted(found):
                n, lo, hi = found[c]
                rows.append((below, n, lo, hi))
                below += n
            starts = np.array([r[0] for r in rows] or [0])
            own: dict[int, tuple] = {}
            for k in ranks:
                if int(k) in known[i] or not rows:
                    continue
                at = int(np.searchsorted(starts, min(int(k), below - 1), side="right") - 1)
                b, n, lo, hi = rows[at]
                if lo == hi or k <= b:
                    known[i][int(k)] = lo if k <= b else hi
                elif k >= b + n - 1:
                    known[i][int(k)] = hi
                else:
                    own[at] = rows[at]
            open_.append([own[a] for a in sorted(own)])
        if all(sum(r[1] for r in rows) <= finish for rows in open_):
            break
        # The whole range stays covered, so that counts below a cell stay known; only open cells are cut finer.
        for i, rows in enumerate(open_):
            parts = max(2, cells // max(len(rows), 1))
            inner = [np.linspace(lo, hi, parts + 1) for _, _, lo, hi in rows]
            outer = [[np.nextafter(lo, -np.inf), hi] for _, _, lo, hi in rows]
            edges[i] = np.unique(np.concatenate([edges[i][[0, -1]], *inner, *outer])) if rows else edges[i][[0, -1]]
    values = _within(df, features, [[(lo, hi) for _, _, lo, hi in rows] for rows in open_])
    for i, rows in enumerate(open_):
        for below, n, lo, hi in rows:
            v = values[i][np.searchsorted(values[i], lo, side="left") : np.searchsorted(values[i], hi, side="right")]
            for k in ranks:
                if below <= k < below + n:
                    known[i][int(k)] = float(v[int(k) - below])
    return np.array([[known[i].get(int(k), np.nan) for k in ranks] for i in range(len(features))])


@dataclass(frozen=True)
class Quantiles:
    """Knots of each feature's empirical quantiles: rank references in [0, 1] and values."""

    features: tuple[str, ...]
    refs: np.ndarray
    values: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], knots: int = KNOTS, accuracy: int | None = None) -> Quantiles:
        """Exact percentiles by refined histograms, whose state does not grow with the rows, or (``accuracy``) percentile_approx."""
        n = df.count()
        refs = np.linspace(0, 1, max(2, min(knots, n)))
        if accuracy is None:
            place = refs * (n - 1)
            low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
            ranks = np.unique(np.concatenate([low, high]))
            found = order_statistics(df, features, ranks)
            a, b = found[:, np.searchsorted(ranks, low)], found[:, np.searchsorted(ranks, high)]
            values = np.where(low == high, a, (high - place) * a + (place - low) * b)
        else:
            at = F.array(*[F.lit(float(r)) for r in refs])
            row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, accuracy).alias(f"q{i}") for i, c in enumerate(features)]).head()
            values = np.array([row[f"q{i}"] for i in range(len(features))], float)
        for v in values:  # interpolation between equal values may leave the last bit different: ties are ties
            for k in range(1, len(v)):
                if v[k] - v[k - 1] <= 1e-13 * max(abs(v[k]), abs(v[k - 1])):
                    v[k] = v[k - 1]
        return cls(tuple(features), refs, values)

    def one(self, x: np.ndarray, i: int) -> np.ndarray:
        """Interpolated ranks; a tie is the mean of its first and last rank."""
        v = self.values[i]
        up = np.interp(x, v, self.refs)
        down = -np.interp(-x, -v[::-1], -self.refs[::-1])
        out = 0.5 * (up + down)
        out[x <= v[0]], out[x >= v[-1]] = 0.0, 1.0
        return np.clip(out, 0, 1)

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the features mapped to [0, 1]."""
        ship(df.sparkSession)
        schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in self.features else f for f in df.schema.fields])

        def run(batches):
            for batch in batches:
                cols = []
                for name, col in zip(batch.schema.names, batch.columns, strict=True):
                    if name in self.features:
                        x = col.cast(pa.float64()).to_numpy(zero_copy_only=False)
                        col = pa.array(self.one(x, self.features.index(name)))
                    cols.append(col)
                yield pa.record_batch(cols, names=batch.schema.names)

        return df.mapInArrow(run, schema)

    def outside(self) -> Column:
        """Whether a row lies beyond the fitted range in some feature."""
        out = F.lit(False)
        for c, v in zip(self.features, self.values, strict=True):
            out = out | (F.col(c) < float(v[0])) | (F.col(c) > float(v[-1]))
        return out


def minmax(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with the features scaled to [0, 1] by their range."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("a", F.min), ("b", F.max))]).head()
    return df.withColumns({c: (F.col(c) - float(row[f"a{i}"])) / ((float(row[f"b{i}"]) - float(row[f"a{i}"])) or 1.0) for i, c in enumerate(features)})
