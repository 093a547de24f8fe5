"""Benchmarks with known answers, as expressions over spark.range: no random state, the same rows in any engine.

Inputs are the additive recurrence x_d = frac((i + 1) a_d) with a_d = frac(2^(1/(d + 1)) ... ), here the powers of the
root of t^(D+1) = t + 1 (the R-sequence); noise is a bounded pseudo-random sequence of the row number.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PI = math.pi


def steps(d: int) -> list[float]:
    """The R-sequence's steps, rounded to 12 digits so that other engines can name them."""
    g = 2.0
    for _ in range(60):
        g = (1 + g) ** (1 / (d + 1))
    return [round(g ** -(k + 1), 12) for k in range(d)]


def inputs(spark: SparkSession, n: int | DataFrame, d: int) -> DataFrame:
    """i and x1..xd in [0, 1), for row numbers up to ``n``, or those in its column ``id`` where it is a table."""
    i = F.col("id").cast("double") + 1.0
    frac = lambda v: v - F.floor(v)
    rows = n if isinstance(n, DataFrame) else spark.range(n)
    return rows.select(F.col("id").alias("i"), *[frac(i * F.lit(a)).alias(f"x{k + 1}") for k, a in enumerate(steps(d))])


def noise(sd: Column | float = 1.0) -> Column:
    """Uniform pseudo-noise of the row number with mean 0 and the given standard deviation."""
    u = F.col("i").cast("double") * F.lit(0.754877666247) + F.lit(0.123)
    u = F.sin(u * 12.9898) * 43758.5453
    return (u - F.floor(u) - 0.5) * math.sqrt(12) * sd


def x(k: int) -> Column:
    return F.col(f"x{k}")


def friedman1(spark, n: int, d: int = 10, sd: float = 1.0) -> DataFrame:
    y = 10 * F.sin(PI * x(1) * x(2)) + 20 * F.pow(x(3) - 0.5, 2) + 10 * x(4) + 5 * x(5)
    return inputs(spark, n, d).withColumn("y", y + noise(sd))


def friedman_noise(spark, n: int, d: int = 10, driver: int = 6) -> DataFrame:
    """Friedman's mean with standard deviation 0.5 + 2 x_driver, given as ``sigma``."""
    rows = friedman1(spark, n, d, 0.0).withColumn("sigma", 0.5 + 2 * x(driver))
    return rows.withColumn("y", F.col("y") + noise(F.col("sigma")))


def friedman1_truth() -> dict:
    return {"first": [0.19731, 0.19731, 0.09327, 0.34975, 0.08744], "pair": {(1, 2): 0.07492}}


def ishigami(spark, n: int, a: float = 7.0, b: float = 0.1, noisy: bool = False) -> DataFrame:
    """x1..x3 in [-pi, pi], ``truth``, ``sigma`` (0, or a ramp 0.3 to 3 along x3) and y."""
    rows = inputs(spark, n, 3)
    for k in (1, 2, 3):
        rows = rows.withColumn(f"x{k}", (2 * x(k) - 1) * PI)
    rows = rows.withColumn("truth", F.sin(x(1)) + a * F.pow(F.sin(x(2)), 2) + b * F.pow(x(3), 4) * F.sin(x(1)))
    rows = rows.withColumn("sigma", F.lit(0.3) + F.lit(2.7) * (x(3) + PI) / (2 * PI) if noisy else F.lit(0.0))
    return rows.withColumn("y", F.col("truth") + noise(F.col("sigma")))


def ishigami_truth(a: float = 7.0, b: float = 0.1) -> dict:
    d1, d2, d13 = 0.5 + b * PI**4 / 5 + b * b * PI**8 / 50, a * a / 8, 8 * b * b * PI**8 / 225
    # d1 holds all of x1's part: its square of (1 + b pi^4 / 5) / 2 is the main effect.
    main = 0.5 * (1 + b * PI**4 / 5) ** 2
    v = main + d2 + d13
    return {"variance": v, "first": [main / v, d2 / v, 0.0], "total": [(main + d13) / v, d2 / v, d13 / v], "d1": d1}


def g_function(spark, n: int, a=(0, 1, 4.5, 9, 99, 99, 99, 99)) -> DataFrame:
    y = F.lit(1.0)
    for k, c in enumerate(a):
        y = y * (F.abs(4 * x(k + 1) - 2) + float(c)) / (1 + float(c))
    return inputs(spark, n, len(a)).withColumn("y", y)


def g_truth(a=(0, 1, 4.5, 9, 99, 99, 99, 99)) -> dict:
    v = [1 / (3 * (1 + c) ** 2) for c in a]
    whole = math.prod(1 + q for q in v) - 1
    return {"variance": whole, "first": [q / whole for q in v], "total": [q * math.prod(1 + p for m, p in enumerate(v) if m != k) / whole for k, q in enumerate(v)]}


def morris(spark, n: int, d: int = 20, active: int = 10) -> DataFrame:
    """A screening function: strong, then weak linear effects, and products among the first; the rest is inert."""
    y = F.lit(0.0)
    for k in range(1, min(active, d) + 1):
        y = y + (20.0 if k <= 4 else 5.0 / k) * (x(k) - 0.5)
    for i, j in combinations(range(1, min(4, active) + 1), 2):
        y = y - 15.0 * (x(i) - 0.5) * (x(j) - 0.5)
    return inputs(spark, n, d).withColumn("y", y)


def cosine(f: int, k: int) -> Column:
    return F.cos(2 * PI * f * x(k))


def sine(f: int, k: int) -> Column:
    return F.sin(2 * PI * f * x(k))


#: name: (variables, mean, sd or log-variance, what is known of the answer). Formulas are fixed by their published benchmarks.
CATALOGUE = {
    "linear": (5, lambda: 5 * (x(1) - 0.5) + 3 * (x(2) - 0.5), 0.1, {(1,): 25 / 12, (2,): 9 / 12}),
    "harmonic": (5, lambda: 3 * cosine(1, 1) + 2 * sine(2, 2), 0.1, {(1,): 4.5, (2,): 2.0}),
    "cross_term": (3, lambda: 4 * (x(1) - 0.5) + 2 * sine(1, 1), 0.1, {(1,): 4 / 3 + 2 - 8 / PI}),
    "pair_only": (5, lambda: 3 * (x(1) - 0.5) * (x(2) - 0.5), 0.1, {(1, 2): 1 / 16}),
    "noise_only": (5, lambda: F.lit(0.0), lambda: 2 * (x(1) - 0.5), {}),
    "mixed": (8, lambda: 3 * cosine(1, 1) + 2 * sine(2, 2) + 1.5 * cosine(1, 3) * cosine(1, 4) + 4 * (x(5) - 0.5), 0.5, {(1,): 4.5, (2,): 2.0, (3, 4): 0.5625, (5,): 4 / 3}),
    "apart": (6, lambda: 5 * (x(1) - 0.5) + 3 * cosine(1, 2), lambda: 2 * (x(3) - 0.5), {(1,): 25 / 12, (2,): 4.5}),
    "shared": (5, lambda: 5 * (x(1) - 0.5) + 3 * (x(1) - 0.5) * (x(2) - 0.5), lambda: 1.5 * (x(1) - 0.5), {(1,): 25 / 12, (1, 2): 1 / 16}),
    "two_noise": (8, lambda: 3 * cosine(1, 1) + 2 * (x(2) - 0.5), lambda: x(3) + 0.5 * sine(1, 4) - 0.75, {(1,): 4.5, (2,): 1 / 3}),
    "noise_pair": (6, lambda: 4 * (x(1) - 0.5) + 2 * (x(2) - 0.5), lambda: 8 * (x(3) - 0.5) * (x(4) - 0.5), {(1,): 4 / 3, (2,): 1 / 3}),
    "same_frequency": (5, lambda: 5 * sine(1, 1) + 3 * cosine(2, 2), lambda: 2 * cosine(1, 1), {(1,): 12.5, (2,): 4.5}),
    "sawtooth": (3, lambda: sum((sine(f, 1) / f for f in range(1, 9)), F.lit(0.0)), 0.1, {(1,): sum(1 / (2 * f * f) for f in range(1, 9))}),
    "triple": (6, lambda: 2 * sine(1, 1) + sine(1, 2) * sine(1, 3) + 1.5 * sine(1, 1) * sine(1, 2) * sine(1, 3), 0.1, {(1,): 2.0, (2, 3): 0.25, (1, 2, 3): 2.25 / 8}),
}


def catalogue(spark: SparkSession, name: str, n: int) -> DataFrame:
    """i, x1.., truth, sigma and y of a named benchmark."""
    d, mean, sd, _ = CATALOGUE[name]
    rows = inputs(spark, n, d).withColumn("truth", mean().cast("double"))
    rows = rows.withColumn("sigma", F.exp(sd() / 2) if callable(sd) else F.lit(float(sd)))
    return rows.withColumn("y", F.col("truth") + noise(F.col("sigma")))
