"""Variance shares of a fitted layout: analytic spectra, confidence intervals, frequencies, interaction strengths."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from varlens.functions.basis import gram
from varlens.functions.numeric import t_quantile
from varlens.plans.layout import Layout

COMPONENTS = "part string, ord int, v1 int, v2 int, v3 int, variance double, share_core double, share_total double, lo double, hi double, status string"


def block_variances(layout: Layout, w: np.ndarray) -> np.ndarray:
    """w' G w of each term, not below 0."""
    return np.array([max(0.0, float(w[layout.block(k)] @ t.gram() @ w[layout.block(k)])) for k, t in enumerate(layout.terms)])


def shares(layout: Layout, w: np.ndarray, residual_variance: float = 0.0) -> list[dict]:
    """A row per term: variance, its share of the terms and of terms plus residual; 0 where there is none."""
    v = block_variances(layout, w)
    core, whole = v.sum(), v.sum() + residual_variance
    return [{"term": k, "vars": t.vars, "variance": float(v[k]), "share_core": float(v[k] / core) if core else 0.0, "share_total": float(v[k] / whole) if whole else 0.0} for k, t in enumerate(layout.terms)]


def total_order(layout: Layout, w: np.ndarray) -> np.ndarray:
    """For each variable, the share of all terms that hold it."""
    v = block_variances(layout, w)
    out = np.zeros(len(layout.features))
    for k, t in enumerate(layout.terms):
        out[list(t.vars)] += v[k]
    return out / v.sum() if v.sum() else out


def share_intervals(layout: Layout, w: np.ndarray, covariance: np.ndarray, df: float, level: float = 0.95) -> list[dict]:
    """Delta-method intervals of the shares with the full gradient, Student t, clipped to [0, 1]; with regularity labels."""
    g = [t.gram() for t in layout.terms]
    u = np.concatenate([2 * g[k] @ w[layout.block(k)] for k in range(len(g))] or [np.zeros(0)])
    v = block_variances(layout, w)
    whole = v.sum()
    su = covariance @ u
    usu, t = float(u @ su), t_quantile(0.5 + level / 2, max(df, 1.0))
    out = []
    for k, term in enumerate(layout.terms):
        b = layout.block(k)
        own = float(u[b] @ covariance[b, b] @ u[b])
        s = v[k] / whole if whole else 0.0
        var = (own - 2 * s * float(u[b] @ su[b]) + s * s * usu) / whole**2 if whole else 0.0
        half = t * math.sqrt(max(var, 0.0))
        edge = float(u[b] @ u[b]) <= 1e-12 * max(float(u @ u), 1e-300)
        status = "nonregular_null" if edge or s < 1e-12 else "nonregular_boundary" if s > 1 - 1e-9 else "regular"
        out.append({"term": k, "vars": term.vars, "share": float(s), "se": math.sqrt(max(var, 0.0)), "lo": float(max(0.0, s - half)), "hi": float(min(1.0, s + half)), "status": status})
    return out


def components_table(spark: SparkSession, layout: Layout, w: np.ndarray, part: str = "mean", residual_variance: float = 0.0, intervals: list[dict] | None = None) -> DataFrame:
    """The spectrum as a relation."""
    rows = []
    for k, s in enumerate(shares(layout, w, residual_variance)):
        v = [*(x + 1 for x in s["vars"]), None, None][:3]
        i = intervals[k] if intervals else {"lo": None, "hi": None, "status": None}
        rows.append((part, layout.terms[k].order, *v, s["variance"], s["share_core"], s["share_total"], i["lo"], i["hi"], i["status"]))
    return spark.createDataFrame(rows, COMPONENTS)


def coefficients_table(spark: SparkSession, layout: Layout, w: np.ndarray, r: np.ndarray, part: str = "mean") -> DataFrame:
    """A row per coefficient with its term's variables and its place in each variable's basis."""
    rows = []
    for k, t in enumerate(layout.terms):
        sizes = [s.size for s in t.specs]
        for i in range(t.size):
            at = [int(x) for x in np.unravel_index(i, sizes)]
            j = layout.offsets[k] + i
            rows.append((part, t.order, *[*(x + 1 for x in t.vars), None, None][:3], *[*at, None, None][:3], float(w[j]), float(r[j])))
    return spark.createDataFrame(rows, "part string, ord int, v1 int, v2 int, v3 int, b1 int, b2 int, b3 int, w double, penalty double")


def frequencies(layout: Layout, w: np.ndarray, variable: int) -> list[dict]:
    """A main effect's variance by frequency (Fourier), degree or scale; a cross product counts half to either side."""
    k = next(k for k, t in enumerate(layout.terms) if t.vars == (variable,))
    s = layout.terms[k].specs[0]
    b, g = w[layout.block(k)], gram(s.k, s.basis, s.linear)
    share = b * (g @ b)
    if s.basis == "fourier":
        name = ([0] if s.linear else []) + [f for f in range(1, s.k + 1) for _ in "cs"]
    elif s.basis == "legendre":
        name = list(range(1, s.k + 1))
    else:
        name = [j for j in range(1, s.k + 1) for _ in range(2 ** (j - 1))]
    return [{"frequency": f, "variance": float(sum(x for x, n in zip(share, name, strict=True) if n == f))} for f in sorted(set(name))]


def strength_matrix(layout: Layout, w: np.ndarray) -> np.ndarray:
    """Main shares on the diagonal, pair shares beside it."""
    m = np.zeros((len(layout.features),) * 2)
    for s in shares(layout, w):
        if len(s["vars"]) <= 2:
            i, j = s["vars"][0], s["vars"][-1]
            m[i, j] = m[j, i] = s["share_core"]
    return m
