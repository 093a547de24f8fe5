"""Complement models for what a layout misses: RBF, random Fourier and Nystrom features, kept orthogonal to the design."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.numeric import halton, normal_quantile
from varlens.operators.rows import _map_rows, intervals
from varlens.operators.stats import Stats, stats_pass
from varlens.plans.layout import Layout

KERNELS = ("rbf", "matern32", "matern52")


def kernel(d2: np.ndarray, scale: float, kind: str = "rbf") -> np.ndarray:
    """A kernel of squared distances."""
    if kind == "rbf":
        return np.exp(-d2 / (2 * scale**2))
    d = np.sqrt(np.maximum(d2, 0)) / scale
    if kind == "matern32":
        return (1 + math.sqrt(3) * d) * np.exp(-math.sqrt(3) * d)
    if kind == "matern52":
        return (1 + math.sqrt(5) * d + 5 * d**2 / 3) * np.exp(-math.sqrt(5) * d)
    raise ValueError(f"unknown kernel {kind!r}")


def kernel_column(x: list[Column], centre, scale: float, kind: str = "rbf") -> Column:
    """The same of one centre, as an expression."""
    d2 = F.lit(0.0)
    for c, v in zip(x, centre, strict=True):
        d2 = d2 + (c - F.lit(float(v))) * (c - F.lit(float(v)))
    if kind == "rbf":
        return F.exp(-d2 / F.lit(2 * scale**2))
    d = F.sqrt(d2) / F.lit(float(scale))
    if kind == "matern32":
        return (F.lit(1.0) + F.lit(math.sqrt(3)) * d) * F.exp(-F.lit(math.sqrt(3)) * d)
    return (F.lit(1.0) + F.lit(math.sqrt(5)) * d + F.lit(5 / 3) * d * d) * F.exp(-F.lit(math.sqrt(5)) * d)


@dataclass(frozen=True)
class Features:
    """Functions z(x) of all features: kernels around centres, or cosines of random frequencies."""

    kind: str
    centres: np.ndarray
    scale: float
    phase: np.ndarray | None = None
    mix: np.ndarray | None = None

    @classmethod
    def rbf(cls, centres, scale: float) -> Features:
        return cls("rbf", np.asarray(centres, float), scale)

    @classmethod
    def random_fourier(cls, d: int, m: int, scale: float, seed: int = 0) -> Features:
        """sqrt(2 / m) cos(omega' x + b) with Gaussian omega from Halton points."""
        u = halton(m, d + 1, start=1 + seed * m)
        omega = np.vectorize(normal_quantile)(np.clip(u[:, :d], 1e-9, 1 - 1e-9)) / scale
        return cls("rff", omega, scale, 2 * math.pi * u[:, d])

    @classmethod
    def nystrom(cls, points, scale: float, kind: str = "rbf", jitter: float = 1e-8) -> Features:
        """K(x, points) K(points, points)^(-1/2)."""
        p = np.asarray(points, float)
        k = kernel(((p[:, None] - p[None]) ** 2).sum(-1), scale, kind)
        val, vec = np.linalg.eigh(k + jitter * np.eye(len(p)))
        return cls(kind, p, scale, None, vec @ np.diag(1 / np.sqrt(np.maximum(val, jitter))) @ vec.T)

    @property
    def size(self) -> int:
        return len(self.centres)

    def batch(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "rff":
            return math.sqrt(2 / self.size) * np.cos(x @ self.centres.T + self.phase)
        d2 = (x**2).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1)
        k = kernel(np.maximum(d2, 0), self.scale, self.kind)
        return k if self.mix is None else k @ self.mix

    def columns(self, x: list[Column]) -> list[Column]:
        if self.kind == "rff":
            out = []
            for omega, b in zip(self.centres, self.phase, strict=True):
                angle = F.lit(float(b))
                for c, o in zip(x, omega, strict=True):
                    angle = angle + F.lit(float(o)) * c
                out.append(F.lit(math.sqrt(2 / self.size)) * F.cos(angle))
            return out
        k = [kernel_column(x, c, self.scale, self.kind) for c in self.centres]
        if self.mix is None:
            return k
        return [sum((F.lit(float(m)) * c for m, c in zip(col, k, strict=True)), F.lit(0.0)) for col in self.mix.T]


@dataclass(frozen=True)
class Joint:
    """[design, complement features] side by side, with the interface of a layout."""

    layout: Layout
    extra: Features

    @property
    def features(self):
        return self.layout.features

    @property
    def size(self) -> int:
        return self.layout.size + self.extra.size

    def batch(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.layout.batch(x), self.extra.batch(x)])

    def columns(self, source=F.col) -> list[Column]:
        return self.layout.columns(source) + self.extra.columns([source(f) for f in self.features])


@dataclass
class Complement:
    joint: Joint
    projection: np.ndarray
    v: np.ndarray
    joint_w: np.ndarray
    #: Mean square of what design and complement leave, and the complement's degrees of freedom.
    mse: float = 0.0
    df: float = 0.0

    def batch(self, x: np.ndarray) -> np.ndarray:
        """The residual part at new rows: (z - phi P) v."""
        phi = self.joint.layout.batch(x)
        return (self.joint.extra.batch(x) - phi @ self.projection) @ self.v


def projection(stats: Stats, f: int, ridge: float = 1e-8) -> np.ndarray:
    """(C + eps I)^-1 C_z for the first f columns of joint statistics, eps relative to C's mean diagonal."""
    c = stats.c[:f, :f]
    return np.linalg.solve(c + ridge * np.trace(c) / max(f, 1) * np.eye(f), stats.c[:f, f:])


def fit_complement(df: DataFrame, layout: Layout, extra: Features, target: str, w: np.ndarray, f0: float, lam: float) -> Complement:
    """Ridge of y - f0 - phi w on z made orthogonal to phi, from one joint pass."""
    joint, f = Joint(layout, extra), layout.size
    s = stats_pass(df, joint, target)[None].centred(f0)
    p = projection(s, f)
    c, z = s.c[:f, :f], s.c[f:, f:]
    cross = s.c[:f, f:]
    zz = z - p.T @ cross - cross.T @ p + p.T @ c @ p
    b = s.b[f:] - p.T @ s.b[:f]
    b = b - (cross - c @ p).T @ w
    inverse = np.linalg.inv(zz + lam * np.eye(extra.size))
    v = inverse @ b
    joint_w = np.concatenate([w - p @ v, v])
    return Complement(joint, p, v, joint_w, max(s.rss(joint_w), 0.0) / max(s.n, 1.0), float(np.trace(inverse @ zz)))


def posterior_variance(df: DataFrame, features: list[str], points, scale: float, lam: float, kind: str = "rbf", signal: float = 1.0, name: str = "posterior_variance") -> DataFrame:
    """``df`` with the variance that a kernel model of inducing ``points`` leaves open at each row.

    signal - k(x, P) (K_PP + lam I)^-1 k(P, x), all kernels times ``signal``. The inverse's factor stays with the points, a
    few hundred rows; a row needs its kernels against them and one triangular product.
    """
    p = np.asarray(points, float)
    inner = signal * kernel(((p[:, None] - p[None]) ** 2).sum(-1), scale, kind) + lam * np.eye(len(p))
    root = np.linalg.inv(np.linalg.cholesky(inner)).T  # K^-1 = root root'

    def left(x, _):
        d2 = np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0)
        return signal - ((signal * kernel(d2, scale, kind) @ root) ** 2).sum(axis=1)

    return _map_rows(df, Plain(tuple(features)), {name: left})


@dataclass(frozen=True)
class Plain:
    """The features themselves, with the interface of a layout."""

    features: tuple[str, ...]

    def batch(self, x: np.ndarray) -> np.ndarray:
        return x


def whole_intervals(rows: DataFrame, layout: Layout, w: np.ndarray, f0: float, inverse: np.ndarray, sigma2: float, df_residual: float, n: float, level: float = 0.95, noise: tuple | None = None, extra: Complement | None = None) -> DataFrame:
    """``intervals`` of a fit with all its parts: a log-variance (layout, w, h0), and a complement that moves prediction and bounds
    by its own value; the noise is then what both leave, or the noise part's."""
    left = df_residual
    if extra is not None:
        left = max(left - extra.df, 1.0)
        sigma2 = extra.mse * n / left
    out = intervals(rows, layout, w, f0, inverse, sigma2, left, level, noise)
    if extra is None:
        return out
    u = np.concatenate([-extra.projection @ extra.v, extra.v])  # the closure must not hold the result and its session
    out = _map_rows(out, extra.joint, {"_more": lambda j, _: j @ u})
    return out.withColumns({c: F.col(c) + F.col("_more") for c in ("prediction", "lo", "hi")}).drop("_more")


def complement_variance(complement: Complement, df: DataFrame | None = None, points: int = 4096) -> float:
    """The complement's variance: over the rows of ``df`` (one pass), or without it under the uniform measure, at ``points`` Halton points."""
    lay = complement.joint.layout
    if df is None:
        return float(np.var(complement.batch(halton(points, len(lay.features)))))
    s = stats_pass(df.withColumn("_zero", F.lit(0.0)), complement.joint, "_zero")[None]
    u = np.concatenate([-complement.projection @ complement.v, complement.v])
    return max(float(u @ s.c @ u) / max(s.n, 1.0) - (float(s.s @ u) / max(s.n, 1.0)) ** 2, 0.0)


def redecompose(complement: Complement, n: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Move what the complement has in the design's span, under the uniform measure, into the mean: (change of w, the
    complement's own coefficients left). Predictions stay the same, less a constant."""
    layout = complement.joint.layout
    x = halton(n, len(layout.features))
    phi = np.column_stack([np.ones(n), layout.batch(x)])
    move, *_ = np.linalg.lstsq(phi, complement.batch(x), rcond=None)
    return move[1:], move[:1]


def kmeans_centres(df: DataFrame, features: list[str], k: int, seed: int = 0) -> np.ndarray:
    """Centres by Spark ML's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(df.select(*features))
    return np.array(KMeans(k=k, seed=seed, featuresCol="_v").fit(rows).clusterCenters())
