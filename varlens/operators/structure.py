"""Questions about a model's structure: paired leave-one-out tests of terms, additivity-calibrated shares, exact nested
leave-one-out, posterior uncertainty, single-row summaries and reference regressors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.functions.numeric import minimise_scalar
from varlens.operators.ridge import solve
from varlens.operators.rows import _map_rows, linear
from varlens.operators.sensitivity import block_variances
from varlens.operators.stats import Stats, row_sums, stats_pass
from varlens.plans.layout import Layout


def additivity_shares(stats: Stats, layout: Layout, strategy: str = "variance", target: float = 1.0) -> dict:
    """The lambda of order 1 within [1e-10, 1] at which the terms' variances come nearest ``target`` times y's; orders 2
    and 3 follow it by the ratio of their block sizes."""
    s = stats.centred()
    sizes = {t.order: t.size for t in layout.terms}
    base = sizes.get(1, 1)

    def shares(u: float):
        r = layout.penalty({o: 10**u * sizes.get(o, base) / base for o in (1, 2, 3)}, strategy)
        w = solve(s, r).w
        return block_variances(layout, w) / (s.yy / s.n), w

    u, _ = minimise_scalar(lambda u: abs(shares(u)[0].sum() - target), -10.0, 0.0)
    v, w = shares(u)
    return {"lambda": 10**u, "shares": v, "sum": float(v.sum()), "w": w}


def structure_test(df: DataFrame, layout: Layout, target: str, lam, strategy: str = "variance", drops=None, adds: tuple = (), k2: int = 1) -> list[dict]:
    """Each candidate's change of the leave-one-out mean square and its paired standard error, most helpful removal
    or addition first. All candidates are refitted from one statistics pass and scored in one row pass.

    ``drops``: places of terms to leave out (default each one); ``adds``: pairs to add.
    """
    from varlens.plans.layout import Spec, Term

    spec = layout.terms[0].specs[0]
    extra = tuple(Term(tuple(sorted(p)), (Spec(k2, spec.basis, spec.linear),) * 2) for p in adds)
    wide = Layout(layout.features, layout.terms + extra)
    s = stats_pass(df, wide, target)[None]
    c, n = s.centred(), len(layout.terms)
    r = wide.penalty(lam, strategy)
    every = {"base": list(range(n))}
    every |= {("drop", layout.terms[k].vars): [i for i in range(n) if i != k] for k in (range(n) if drops is None else drops)}
    every |= {("add", t.vars): [*range(n), n + i] for i, t in enumerate(extra)}
    fits = []
    for keep in every.values():
        at = wide.select(keep)[1]
        f = solve(c.take(at), r[at])
        fits.append((at, f.w, f.inverse))
    mean, f_count = s.mean, len(fits)
    rows = df.select(F.col(target).cast("double").alias("_y"), *[F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(wide.features)])

    def run(b):
        out = np.zeros((f_count, 3))
        phi = wide.batch(np.stack([b.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(wide.features))], axis=1))
        y = b.column("_y").to_numpy(zero_copy_only=False) - mean
        base = None
        for i, (at, w, inverse) in enumerate(fits):
            p = phi[:, at]
            h = np.clip(((p @ inverse) * p).sum(axis=1), 0, 1 - 1e-10)
            loss = ((y - p @ w) / (1 - h)) ** 2
            base = loss if base is None else base
            d = loss - base
            out[i] = (len(y), d.sum(), (d * d).sum())
        return out.ravel()

    sums = row_sums(rows, run, 3 * f_count).reshape(f_count, 3)
    out = []
    for (name, (m, a, b)) in list(zip(every, sums, strict=True))[1:]:
        change = a / m
        out.append({"change": name[0], "vars": name[1], "loo_change": float(change), "se": math.sqrt(max(b / m - change**2, 0) / m)})
    return sorted(out, key=lambda x: x["loo_change"])


def exact_loo(df: DataFrame, layout: Layout, target: str, r: np.ndarray, key: str) -> DataFrame:
    """key and the negative log-likelihood of each row under a refit without it (mean, weights and noise).

    One statistics pass, then a row map: a row's statistics are taken off and the inverse is brought up to date by a
    rank-one step, a batch at a time.
    """
    s = stats_pass(df, layout, target)[None]
    inv = np.linalg.inv(s.c + np.diag(r))
    f = layout.size
    br = inv * r  # inverse times the penalty
    tr1, tr2 = float(np.trace(br)), float((br * br.T).sum())

    def row(phi, e):
        y, n = e[target], s.n - 1
        mean = (s.sy - y) / n
        b = s.b - phi * y[:, None] - mean[:, None] * (s.s - phi)
        yy = s.yy - y * y - n * mean * mean
        q = phi @ inv
        left = 1 / (1 - np.clip((q * phi).sum(axis=1), 0, 1 - 1e-10))
        w = b @ inv
        w += q * ((phi * w).sum(axis=1) * left)[:, None]
        qrq = (q * q * r).sum(axis=1) * left
        trace = tr1 + qrq
        square = tr2 + 2 * ((q * r) @ inv * (q * r)).sum(axis=1) * left + qrq**2
        df_, tr_h2 = f - trace, f - 2 * trace + square
        p = (phi * w).sum(axis=1)
        rss = yy - 2 * (w * b).sum(axis=1) + ((w @ s.c) * w).sum(axis=1) - p * p
        sigma2 = rss / np.maximum(n - 2 * df_ + tr_h2, 1.0)
        d = y - mean - p
        return 0.5 * np.log(2 * np.pi * sigma2) + d * d / (2 * sigma2)

    return _map_rows(df.select(key, target, *layout.features), layout, {"loo_nll": row}, (target,)).select(key, "loo_nll")


def uncertainty(df: DataFrame, layout: Layout, w: np.ndarray, f0: float, inverse: np.ndarray, sigma2: float, noise: float | None = None) -> DataFrame:
    """``df`` with prediction, aleatoric and epistemic variance and their sum, from the coefficients' posterior."""
    from varlens.operators.rows import predict

    rows = predict(df, layout, w, f0)
    rows = _map_rows(rows, layout, {"epistemic": lambda phi, _: sigma2 * ((phi @ inverse) * phi).sum(axis=1)})
    return rows.withColumn("aleatoric", F.lit(float(sigma2 if noise is None else noise))).withColumn("total", F.col("epistemic") + F.col("aleatoric"))


def explain_row(layout: Layout, w: np.ndarray, f0: float, x: dict[str, float]) -> list[dict]:
    """A row's prediction by term, largest part first."""
    phi = layout.batch(np.array([[float(x[f]) for f in layout.features]]))[0]
    parts = [{"vars": t.vars, "part": float(phi[layout.block(k)] @ w[layout.block(k)])} for k, t in enumerate(layout.terms)]
    return [{"vars": (), "part": f0}, *sorted(parts, key=lambda p: -abs(p["part"]))]


def explain_rows(df: DataFrame, layout: Layout, w: np.ndarray, f0: float, key: str) -> DataFrame:
    """key, term, vars, part, rank: each row's prediction by term (term -1: the mean), largest part first, as one expression."""
    cols = layout.columns()
    own = [linear(cols[layout.block(k)], w[layout.block(k)]) for k in range(len(layout.terms))]
    cell = lambda term, vars_, part: F.struct((-F.abs(part)).alias("_size"), F.lit(term).alias("term"), F.array(*[F.lit(v + 1) for v in vars_]).cast("array<int>").alias("vars"), part.alias("part"))
    parts = F.array_sort(F.array(*[cell(k, t.vars, p) for k, (t, p) in enumerate(zip(layout.terms, own, strict=True))]))
    whole = F.concat(F.array(cell(-1, (), F.lit(float(f0)))), parts)
    return df.select(F.col(key), F.posexplode(whole).alias("rank", "s")).select(key, "s.term", "s.vars", "s.part", "rank")


def two_fit_gap(layout: Layout, weighted: np.ndarray, plain: np.ndarray) -> list[dict]:
    """Shares under the weighted fit less those under the unweighted one, by term."""
    a, b = block_variances(layout, weighted), block_variances(layout, plain)
    return [{"vars": t.vars, "gap": float(a[k] / max(a.sum(), 1e-300) - b[k] / max(b.sum(), 1e-300))} for k, t in enumerate(layout.terms)]


def noise_verdict(fitted: float, model_free: float, tolerance: float = 0.25) -> str:
    """Whether a fit's noise agrees with noise measured without it: underfit, overfit or consistent."""
    ratio = fitted / max(model_free, 1e-300)
    return "underfit" if ratio > 1 + tolerance else "overfit" if ratio < 1 / (1 + tolerance) else "consistent"


def baselines(train: DataFrame, test: DataFrame, features: list[str], target: str, seed: int = 0) -> list[dict]:
    """Test R^2 of Spark ML's gradient-boosted trees and random forest."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    join = VectorAssembler(inputCols=features, outputCol="_v")
    out = []
    for name, m in (("boosting", GBTRegressor(featuresCol="_v", labelCol=target, maxIter=50, seed=seed)), ("forest", RandomForestRegressor(featuresCol="_v", labelCol=target, numTrees=100, maxDepth=10, seed=seed))):
        p = m.fit(join.transform(train)).transform(join.transform(test))
        out.append({"model": name, "r2": RegressionEvaluator(labelCol=target, metricName="r2").evaluate(p)})
    return out
