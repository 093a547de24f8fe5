"""Row passes with a small fitted state in the closure: prediction, intervals, leverage, deleted residuals, sandwich covariance."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.numeric import normal_quantile, t_quantile
from varlens.operators.stats import Stats, row_sums
from varlens.plans.layout import Layout
from varlens.session import ship


def linear(columns: list[Column], w: np.ndarray, f0: float = 0.0) -> Column:
    """f0 + sum of w times columns, as one compiled expression."""
    out = F.lit(float(f0))
    for c, x in zip(columns, w, strict=True):
        if x:
            out = out + F.lit(float(x)) * c
    return out


def predict(df: DataFrame, layout: Layout, w: np.ndarray, f0: float, name: str = "prediction", most: int = 60) -> DataFrame:
    """``df`` with the prediction: an expression for small designs, Arrow batches for larger ones."""
    if layout.size <= most:
        return df.withColumn(name, linear(layout.columns(), w, f0))
    return _map_rows(df, layout, {name: lambda phi, _: f0 + phi @ w})


def _map_rows(df: DataFrame, layout: Layout, outputs: dict, extra: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with new double columns, each a function of (phi, dict of the extra columns)."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in outputs]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(layout.features))], axis=1)
            phi = layout.batch(x)
            others = {c: batch.column(f"_e{i}").to_numpy(zero_copy_only=False) for i, c in enumerate(extra)}
            new = [pa.array(np.asarray(f(phi, others), float)) for f in outputs.values()]
            yield pa.record_batch([*(batch.column(c) for c in keep), *new], names=[*keep, *outputs])

    used = df.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(layout.features)], *[F.col(c).cast("double").alias(f"_e{i}") for i, c in enumerate(extra)])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + [f"`{n}` double" for n in outputs]
    return used.mapInArrow(run, ", ".join(fields))


def leverage_rows(df: DataFrame, layout: Layout, target: str, w: np.ndarray, f0: float, inverse: np.ndarray, weight: str | None = None) -> DataFrame:
    """``df`` with fitted, residual, leverage (of the weighted design) and the deleted residual r / (1 - h)."""
    extra = (target, *([weight] if weight else ()))
    wt = lambda e: e[weight] if weight else 1.0
    lev = lambda phi, e: np.clip(((phi @ inverse) * phi).sum(axis=1) * wt(e), 0, 1 - 1e-10)
    fit = lambda phi, e: f0 + phi @ w
    res = lambda phi, e: e[target] - fit(phi, e)
    return _map_rows(df, layout, {"fitted": fit, "residual": res, "leverage": lev, "loo_residual": lambda p, e: res(p, e) / (1 - lev(p, e))}, extra)


def debiased(r2: Column, leverage: Column) -> Column:
    """Squared residuals less what the fit took: r^2 / (1 - h), with 1 - h between 0.001 and 1."""
    return r2 / F.least(F.greatest(F.lit(1.0) - leverage, F.lit(1e-3)), F.lit(1.0))


def sandwich(df: DataFrame, layout: Layout, target: str, w: np.ndarray, f0: float, inverse: np.ndarray, kind: str = "HC3", weight: str | None = None) -> np.ndarray:
    """A^-1 (sum phi phi' (w r / (1 - h))^2) A^-1, h = 0 for HC0; one pass."""
    f = layout.size
    used = df.select(F.col(target).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(layout.features)])

    def run(batch):
        phi = layout.batch(np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(layout.features))], axis=1))
        y, wt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
        h = np.clip(wt * ((phi @ inverse) * phi).sum(axis=1), 0, 1 - 1e-10) if kind == "HC3" else 0.0
        u = phi * (wt * (y - f0 - phi @ w) / (1 - h))[:, None]
        return (u.T @ u).ravel()

    meat = row_sums(used, run, f * f).reshape(f, f)
    return inverse @ meat @ inverse


def intervals(df: DataFrame, layout: Layout, w: np.ndarray, f0: float, inverse: np.ndarray, sigma2: float, df_residual: float = math.inf, level: float = 0.95, log_variance: tuple[Layout, np.ndarray, float] | None = None) -> DataFrame:
    """``df`` with prediction, aleatoric and epistemic variance, lo and hi. Without a log-variance part the noise is
    sigma2 and the quantile Student's; with one it is exp(h) and the quantile normal."""
    q = normal_quantile(0.5 + level / 2) if log_variance else t_quantile(0.5 + level / 2, df_residual)
    scale = 1.0 if log_variance else sigma2
    out = predict(df, layout, w, f0)
    if log_variance:
        lay, wh, h0 = log_variance
        out = out.withColumn("aleatoric", F.exp(F.least(F.greatest(linear(lay.columns(), wh, h0), F.lit(-30.0)), F.lit(30.0))))
    else:
        out = out.withColumn("aleatoric", F.lit(float(sigma2)))
    out = _map_rows(out, layout, {"epistemic": lambda phi, _: scale * ((phi @ inverse) * phi).sum(axis=1)})
    half = F.lit(q) * F.sqrt(F.col("aleatoric") + F.col("epistemic"))
    return out.withColumn("lo", F.col("prediction") - half).withColumn("hi", F.col("prediction") + half)


def loo_summary(rows: DataFrame, sigma2: float) -> dict:
    """PRESS mean square and the deleted Gaussian negative log-likelihood of ``leverage_rows``."""
    cv = rows.agg(F.avg(F.col("loo_residual") ** 2)).head()[0]
    return {"loo_cv": cv, "loo_nll": 0.5 * math.log(max(sigma2, 1e-300)) + cv / (2 * max(sigma2, 1e-300)) + 0.5 * math.log(2 * math.pi)}


def noise_curve(df: DataFrame, layout: Layout, target: str, shape: np.ndarray, lams=None) -> dict:
    """The noise and the criteria along penalties lambda * ``shape``, with deleted residuals, and each one's best lambda.

    One pass of statistics, then one of rows for all lambdas: their weights side by side, and the leverages by powers of one
    eigenbasis, h = sum of u^2 / (mu + lambda). ``curve``: a dict per lambda; ``best``: the lambda of the least sigma2, loo_cv,
    gcv, aic and bic (of equal ones the smallest). ``stats``: the centred statistics.
    """
    from varlens.operators.ridge import path, solve
    from varlens.operators.stats import stats_pass

    raw = stats_pass(df, layout, target)[None]
    s, mean = raw.centred(), raw.mean
    lams = np.logspace(-6, 2, 50) if lams is None else np.asarray(lams, float)
    curve = path(s, shape, lams)
    weights = np.column_stack([p["w"] for p in curve])
    steady = len(shape) and shape.min() > 0 and shape.max() / shape.min() < 1e8
    if steady:
        root = np.sqrt(shape)
        mu, q = np.linalg.eigh(s.c / root[:, None] / root)
        turn, shrink = q / root[:, None], 1 / (np.maximum(mu, 0)[:, None] + lams)
    else:
        inverses = [solve(s, x * shape).inverse for x in lams]
    rows = df.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(layout.features)])

    def run(batch):
        phi = layout.batch(np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(layout.features))], axis=1))
        y = batch.column("_y").to_numpy(zero_copy_only=False) - mean
        h = (phi @ turn) ** 2 @ shrink if steady else np.column_stack([((phi @ i) * phi).sum(axis=1) for i in inverses])
        return (((y[:, None] - phi @ weights) / (1 - np.clip(h, 0, 1 - 1e-10))) ** 2).sum(axis=0)

    cv = row_sums(rows, run, len(lams)) / max(s.n, 1.0)
    curve = [{k: v for k, v in p.items() if k != "w"} | {"loo_cv": float(x)} for p, x in zip(curve, cv, strict=True)]
    best = {c: min(curve, key=lambda p: (p[c], p["lambda"]))["lambda"] for c in ("sigma2", "loo_cv", "gcv", "aic", "bic")}
    if steady and mu.min() > 0 and s.n > len(mu):
        # Of many rows, small penalties change sigma2 by less than a double shows: compare its growth over that without penalty.
        c = q.T @ (s.b / root)
        least = s.yy - float((c * c / mu).sum())
        if least > 1e-8 * s.yy:
            gap = [(float((c * c / mu * x * x).sum()), float((x * x).sum())) for x in (lam / (mu + lam) for lam in lams)]
            growth = [math.log1p(a / least) - math.log1p(b / (s.n - len(mu))) for a, b in gap]
            best["sigma2"] = min(zip(growth, lams.tolist(), strict=True))[1]
    return {"curve": curve, "best": best, "stats": s}


def kfold(folds: dict, r: np.ndarray) -> list[dict]:
    """A row per fold: its size, held-out mean square and the noise of the others' fit; folds are subtracted from the whole."""
    from varlens.operators.ridge import solve
    from varlens.operators.stats import total

    whole: Stats = total(folds)
    out = []
    for k in sorted(folds, key=str):
        train = whole - folds[k]
        at = train.mean
        s = solve(train.centred(at), r)
        out.append({"fold": k, "n": int(folds[k].n), "mse": folds[k].centred(at).rss(s.w) / folds[k].n, "sigma": math.sqrt(s.rss / max(train.n - s.df, 1.0)), "w": s.w})
    return out


def stability(folds: dict, layout: Layout, r: np.ndarray) -> dict:
    """How first-order shares move over folds: their largest standard deviation, and a grade."""
    from varlens.operators.sensitivity import shares

    rows = kfold(folds, r)
    s = np.array([[x["share_core"] for x in shares(layout, row["w"])] for row in rows])
    most = float(s.std(axis=0).max()) if s.size else 0.0
    grade = next(g for g, limit in (("excellent", 0.01), ("good", 0.03), ("moderate", 0.05), ("poor", math.inf)) if most < limit)
    return {"shares": s, "max_sd": most, "grade": grade, "rmse": [math.sqrt(row["mse"]) for row in rows], "sigma": [row["sigma"] for row in rows]}


def sample_size(n: float, columns: int, df: float) -> dict:
    """Rules of thumb for how many rows a design has per column and per degree of freedom."""
    per = n / max(df, 1.0)
    return {"rows_per_column": n / max(columns, 1), "rows_per_df": per, "verdict": "ample" if per >= 50 else "adequate" if per >= 20 else "marginal" if per >= 10 else "insufficient"}
