"""Whitening of embeddings through the covariance of their distinct vectors.

Every entry c becomes the integer ``floor(64 * c) + 1000000``, so that counts and sums are exact. The distinct integer
vectors are the fit list. With n of them and sums S, its rows are centred exactly, ``n * x - S`` in integers and divided by
n once; Spark MLlib's ``RowMatrix`` over these rows gives the Gramian, which divided by n is the covariance. Its
eigenvectors come from a local ``eigh`` of that one dims x dims matrix, and the whitening, projection on each component over the
square root of its eigenvalue, is broadcast and applied to all rows in ``mapInPandas``.

Scale: one shuffle, that of the distinct vectors, combined map-side so that copies meet before they travel. The fit list is
saved; sums, the Gramian and the check of the whitened covariance are passes over it that leave one vector or one matrix of
dims x dims for each partition (added up in Spark's tree), and all that is broadcast is dims x components numbers. Integers
that 64 bits might not hold are computed as Python's.

Defined results: rows whose vector is null, or holds null, NaN or infinite entries, or an entry whose integer no long holds, are
dropped; so are those of another length than most remaining rows (the longer on a tie), empty vectors included. Null ids,
repeated ids and repeated rows stay, each row with its own result; repeats enter the fit once. Components whose eigenvalue is
not above 1e-12 of the largest cannot be scaled to variance one and are left out, so a table of equal vectors gives no rows. Equal
eigenvalues leave their components' directions open; one choice is made for all rows. A deviation beyond 64 bits is
null. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.session import Scratch, ship

#: Eigenvalues up to this share of the largest count as zero.
FLAT = 1e-12
#: Integers below this add and multiply safely in 64 bits.
SAFE = 1 << 62


@dataclass
class Whitening:
    """What the fit knows: n and sums of the fit list, eigenvalues of its covariance, projections (dims x components)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    projection: np.ndarray
    identity_error: float = 0.0


def whole_numbers(df: DataFrame, id: str, vector: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``_id`` and the integer vector ``_x`` of every row that has one."""
    c = F.transform(F.col(vector), lambda e: e.cast("double"))
    limit = float((1 << 62) // scale)
    rows = df.select(F.col(id).alias("_id"), c.alias("_c"))
    rows = rows.filter(F.col("_c").isNotNull() & F.forall("_c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < limit)))
    return rows.select("_id", F.transform("_c", lambda e: F.floor(e * scale) + offset).alias("_x"))


def centred_integers(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: int64 where that holds it, else Python's integers."""
    low = [s // n for s in sums]
    q, r = np.array(low, np.int64), np.array([s - n * a for s, a in zip(sums, low, strict=True)], object)
    far = int(max(x.max(initial=0) - min(low, default=0), max(low, default=0) - x.min(initial=0), 1))
    if (far + 1) * n < SAFE:
        return (x - q) * n - r.astype(np.int64)
    return (x.astype(object) - q.astype(object)) * n - r


def centred(v: np.ndarray, n: int) -> np.ndarray:
    """x - S / n as doubles, from the exact integers n * x - S."""
    return np.array(v / n, np.float64)


def deviations(v: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of integers; None beyond a long."""
    most = int(np.abs(v).max(initial=0))
    squares = v if v.dtype == object or most * most * max(v.shape[1], 1) < SAFE else v.astype(object)
    if squares.dtype != object and most * most * max(v.shape[1], 1) >= SAFE:
        squares = v.astype(object)
    return [int(s) if int(s) < 1 << 63 else None for s in (squares * squares).sum(axis=1)]


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as int64 or float64 (rows x dims)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _gramian(rows: DataFrame, column: str, n: int, dims: int) -> np.ndarray:
    """Gramian of a column of double arrays, by MLlib's RowMatrix."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, dims).computeGramianMatrix().toArray()


def fit(rows: DataFrame, dims: int, components: int, scratch: Scratch) -> Whitening | None:
    """Fit on the distinct integer vectors of ``rows`` (see ``whole_numbers``); None where no component has variance."""
    distinct = scratch.save(rows.select("_x").distinct(), "fit_list")

    def sums_of(batches):
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch.column("_x"), dims)
            n += len(x)
            few = int(np.abs(x).max(initial=0)) * max(len(x), 1) < SAFE
            total = total + (x.sum(axis=0) if few else x.astype(object).sum(axis=0)).astype(object)
        yield pa.record_batch({"k": pa.array(range(dims + 1), pa.int32()), "s": pa.array([str(n), *map(str, total)], pa.string())})

    # As many rows as dimensions; decimals hold sums of 10^19 entries of 19 digits.
    per = distinct.mapInArrow(sums_of, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["k"]: int(r["s"]) for r in per.collect()}
    n, sums = got.get(0, 0), [got.get(k + 1, 0) for k in range(dims)]
    if not n:
        return None

    def centre(batches):
        for batch in batches:
            c = centred(centred_integers(_matrix(batch.column("_x"), dims), n, sums), n)
            yield pa.record_batch({"c": pa.array(list(c), pa.list_(pa.float64()))})

    exact = distinct.mapInArrow(centre, "c array<double>")
    covariance = _gramian(exact, "c", n, dims) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * FLAT]
    if not len(order):
        return None
    model = Whitening(n, sums, float(np.trace(covariance)), values[order], vectors[:, order] / np.sqrt(values[order]))
    model.identity_error = _identity_error(exact, model)
    return model


def _identity_error(exact: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance, measured on its rows, less the identity."""
    projection, k, n = model.projection, model.projection.shape[1], model.n

    def whiten(batches, less=0.0):
        for batch in batches:
            yield pa.record_batch({"w": pa.array(list(_matrix(batch.column("c"), projection.shape[0]) @ projection - less), pa.list_(pa.float64()))})

    def total(batches):
        out = np.zeros(k)
        for batch in whiten(batches):
            out += _matrix(batch.column("w"), k).sum(axis=0)
        yield pa.record_batch({"k": pa.array(range(k), pa.int32()), "s": pa.array(out)})

    got = exact.mapInArrow(total, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    mean = np.zeros(k)
    for r in got:
        mean[r["k"]] = r["s"] / n
    covariance = _gramian(exact.mapInArrow(lambda batches: whiten(batches, mean), "w array<double>"), "w", n, k) / n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each remaining row and component."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "whitening")
    rows = whole_numbers(df, id, vector, scale, offset)
    kind = dict(rows.dtypes)["_id"]
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    dims = lengths["d"] if lengths else 0
    rows = rows.filter(F.size("_x") == dims)
    model = fit(rows, dims, components, scratch) if dims else None
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("_id", id)
    shared = spark.sparkContext.broadcast((model.n, model.sums, model.projection, model.values / model.trace, model.identity_error))

    def run(frames):
        n, sums, projection, explained, error = shared.value
        k = projection.shape[1]
        for frame in frames:
            if not len(frame):
                continue
            v = centred_integers(np.stack(frame["_x"].to_numpy()), n, sums)
            yield pd.DataFrame(
                {
                    "_id": frame["_id"].repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(frame)),
                    "n": n,
                    "deviation": pd.array(deviations(v), "Int64").repeat(k),
                    "whitened": (centred(v, n) @ projection).ravel(),
                    "explained": np.tile(explained, len(frame)),
                    "identity_error": error,
                }
            )

    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id)
