"""Packing documents into fixed-length training sequences by cutting-stock column generation.

A document's ids are cut into whole sequences and one remainder. The remainders' lengths, rounded up
to ``grain``, form a histogram of at most capacity / grain classes: the whole input of a linear
program over patterns (which classes share a sequence), solved by a revised simplex method whose
columns a knapsack dynamic program prices. Patterns are used as often as their value rounded down;
what is left, a number of pieces bounded by the classes, is packed best-fit. Pieces are ranked within
their class, and the patterns' places are given out by rank.

Scale: texts are read once and never shuffled; only piece rows move. The driver sees the histogram
alone. A class that holds most pieces is ranked over hash buckets, whose number grows with the rows.
The plan that is broadcast has a row per class and pattern, bounded by the classes and not by rows.

Defined results: a null or empty text is its end id alone; rows that repeat, and null doc_ids, are
documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.tokens import default_path, encode_documents
from varlens.session import Scratch, ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROWS_A_BUCKET = 100_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Whole sequences and one remainder per document, with the checksum of each piece's ids."""

    def cut(batches):
        for doc_ids, ids, starts, lengths in encode_documents(batches, tokenizer, end_id):
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(capacity, lengths[doc] - start)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((starts[doc] + start).tolist(), (starts[doc] + start + length).tolist(), strict=True)]
            yield pa.record_batch({"doc_id": doc_ids.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(lengths[doc])})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_column(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over sizes 1..capacity (prices[s - 1]): the best value and how often each size is taken."""
    best = np.zeros(capacity + 1)
    pick = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = best[room - 1 :: -1] + prices[:room] if room > 1 else best[:1] + prices[:1]
        s = int(value.argmax())
        if value[s] > best[room - 1] + 1e-12:
            best[room], pick[room] = value[s], s + 1
        else:
            best[room] = best[room - 1]
    column, room = np.zeros(capacity, np.int64), capacity
    while room > 0:
        if pick[room]:
            column[pick[room] - 1] += 1
            room -= pick[room]
        else:
            room -= 1
    return float(best[capacity]), column


def column_generation(demand: np.ndarray, gap: float = 3e-4, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """min sum x with patterns' columns covering ``demand`` (pieces of size 1..capacity): (patterns, x).

    Ends when a lower bound (the value over the best price, or all sizes over the capacity) shows it to be within
    ``gap`` times the optimum, or half a sequence of it.
    """
    capacity = len(demand)
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, capacity), np.int64), np.zeros(0)
    columns = np.diag(capacity // sizes).astype(float)
    d = demand[sizes - 1].astype(float)
    # A little more of each class, by a different amount, keeps ties from stalling the pivots.
    d = d * (1 + 1e-9 * np.arange(1, m + 1))
    # A size above half the capacity begins together with its complement, as the pattern of the rarer of the two.
    place = {int(s): i for i, s in enumerate(sizes)}
    for s, i in place.items():
        if 2 * s > capacity and (j := place.get(capacity - s)) is not None:
            if d[j] >= d[i]:
                columns[j, i] = 1
            else:
                columns[j, j] = columns[i, j] = 1
    inverse = np.linalg.inv(columns)
    x = inverse @ d
    bound = float(demand[sizes - 1] @ sizes) / capacity
    for step in range(most):
        duals = inverse.sum(axis=0)
        prices = np.zeros(capacity)
        prices[sizes - 1] = np.maximum(duals, 0)
        value, column = best_column(prices, capacity)
        bound = max(bound, x.sum() / max(value, 1))
        if x.sum() - bound <= max(0.5, gap * x.sum()):
            break
        column = column[sizes - 1]
        held = np.flatnonzero(column)
        u = inverse[:, held] @ column[held]
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x -= t * u
        x[out] = t
        columns[:, out] = column
        pivot = inverse[out] / u[out]
        rows = np.flatnonzero(np.abs(u) > 1e-12)
        inverse[rows] -= u[rows, None] * pivot
        inverse[out] = pivot
        if step % 200 == 199:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ d, 0)
    patterns = np.zeros((m, capacity), np.int64)
    patterns[:, sizes - 1] = columns.T.round().astype(np.int64)
    return patterns, np.maximum(x, 0)


def plan_patterns(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold exactly ``demand``: rounded-down patterns, then best-fit bins for the rest."""
    left = demand.copy()
    plan = []
    for pattern, x in zip(*column_generation(demand), strict=True):
        used = pattern > 0
        times = min(int(x + 1e-6), int((left[used] // pattern[used]).min()) if used.any() else 0)
        if times:
            plan.append((pattern, times))
            left -= pattern * times
    capacity = len(demand)
    bins: list[np.ndarray] = []
    room: list[int] = []
    for size in range(capacity, 0, -1):
        for _ in range(int(left[size - 1])):
            fits = [(r, i) for i, r in enumerate(room) if r >= size]
            if fits:
                i = min(fits)[1]
            else:
                i = len(bins)
                bins.append(np.zeros(capacity, np.int64))
                room.append(capacity)
            bins[i][size - 1] += 1
            room[i] -= size
    return plan + [(b, 1) for b in bins]


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, grain: int = 4) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut_pieces(docs, tokenizer or default_path(), capacity, end_id), "pieces")
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    whole = F.col("length") == capacity
    pieces = pieces.withColumn("_class", F.when(whole, F.lit(0)).otherwise(F.col("_class")))
    histogram = {r["_class"]: r["count"] for r in pieces.groupBy("_class").count().collect()}  # at most capacity / grain + 1 rows
    classes = -(-capacity // grain)
    demand = np.array([histogram.get(s, 0) for s in range(1, classes + 1)], np.int64)
    rows, base, done = [], 0, np.zeros(classes + 1, np.int64)
    if n := histogram.get(0, 0):
        rows.append((0, 0, n, 1, 0))
        base = n
    for pattern, times in plan_patterns(demand):
        for s in np.flatnonzero(pattern):
            a = int(pattern[s])
            rows.append((int(s + 1), int(done[s + 1]), int(done[s + 1] + a * times), a, base))
            done[s + 1] += a * times
        base += times
    plan = spark.createDataFrame(rows, "_class int, _lo long, _hi long, _each long, _base long")

    buckets = max(64, sum(histogram.values()) // ROWS_A_BUCKET)
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("_class", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("_class").orderBy("_bucket")) - F.col("count")
    counts = counts.select("_class", "_bucket", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("_local", local).join(counts, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    placed = ranked.join(F.broadcast(plan), "_class").filter("_rank >= _lo and _rank < _hi")
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_each")))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank")
    offset = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
