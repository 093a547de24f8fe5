"""The log-variance part: Newton steps on statistics gathered per iteration, and the alternation with a weighted mean.

Minimises sum h/2 + r^2 exp(-h)/2 + theta' R theta / 2 over h = h0 + psi theta, with |h| held within 30: rows at
the bound give no gradient. One pass gives the objective, gradient and Hessian after the whole step, which is nearly always the one
taken; where it is not, another gives the objective at all step sizes. Many objectives (penalties, folds, deleted rows) share their passes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.operators.ridge import Solution, solve
from varlens.operators.rows import debiased, leverage_rows, linear, predict
from varlens.operators.stats import row_sums, stats_pass
from varlens.plans.layout import Layout
from varlens.session import Scratch

BOUND = 30.0
STEPS = 0.5 ** np.arange(11)


def _sum_rows(df: DataFrame, layout: Layout, r2: str, f, size: int) -> np.ndarray:
    """The sum over rows of f(psi, r2), a vector of ``size``."""
    used = df.select(F.col(r2).cast("double").alias("_r"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(layout.features)])

    def run(batch):
        x = np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(layout.features))], axis=1)
        return f(layout.batch(x), batch.column("_r").to_numpy(zero_copy_only=False))

    return row_sums(used, run, size)


@dataclass
class LogVariance:
    layout: Layout
    w: np.ndarray
    h0: float
    hessian: np.ndarray
    data_hessian: np.ndarray
    objective: float
    steps: int
    grad: np.ndarray | None = None

    @property
    def health(self) -> dict:
        """How far the fit is from a stationary point (largest gradient entry, and relative to the objective), and the reciprocal
        condition of its Hessian, with flags."""
        values = np.linalg.eigvalsh(self.hessian)
        rcond = float(values[0] / values[-1]) if values[-1] > 0 else 0.0
        kkt = float(np.abs(self.grad).max()) if self.grad is not None else math.nan
        return {"kkt": kkt, "kkt_relative": kkt / max(abs(self.objective), 1e-300), "rcond": rcond, "ill_conditioned": values[0] <= 0 or rcond < 1e-10}

    @property
    def df(self) -> float:
        """Effective degrees of freedom: the trace of the inverse Hessian times its data part."""
        return float(np.trace(np.linalg.solve(self.hessian, self.data_hessian)))

    def column(self, source=F.col):
        h = linear(self.layout.columns(source), self.w, self.h0)
        return F.least(F.greatest(h, F.lit(-BOUND)), F.lit(BOUND))


@dataclass
class Point:
    """A place theta of one objective: its value, gradient and Hessian there (penalty included), the data's part of the Hessian and the steps made."""

    theta: np.ndarray
    pen: np.ndarray
    value: float = math.nan
    grad: np.ndarray | None = None
    data: np.ndarray | None = None
    steps: int = 0
    done: bool = False

    @property
    def known(self) -> bool:
        return self.grad is not None

    def take(self, got: np.ndarray) -> None:
        """Value, gradient and Hessian from a pass's sums at theta."""
        n = len(self.theta)
        self.value = got[0] + 0.5 * float(self.pen @ self.theta**2)
        self.grad, self.data = got[1 : 1 + n] + self.pen * self.theta, got[1 + n :].reshape(n, n)


def derivative_sums(u: np.ndarray, v: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Value, gradient and Hessian of the rows' loss h / 2 + v exp(-h) / 2, h = u theta, as one vector."""
    h = u @ theta
    on = np.abs(h) < BOUND
    full = np.clip(h, -BOUND, BOUND)
    e = v * np.exp(-full)
    rho = np.where(on, e, 0.0)
    g = u.T @ (0.5 * (on - rho))
    hess = (u * (0.5 * rho)[:, None]).T @ u
    return np.concatenate([[0.5 * float((full + e).sum())], g, hess.ravel()])


def step_sums(u: np.ndarray, v: np.ndarray, theta: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The rows' loss at theta + a * move for every a of ``STEPS``."""
    h, dh = u @ theta, u @ move
    return np.array([0.5 * float(((z := np.clip(h + a * dh, -BOUND, BOUND)) + v * np.exp(-z)).sum()) for a in STEPS])


def newton_many(evaluate, points: list[Point], steps: int = 20, tol: float = 1e-6) -> int:
    """Damped Newton steps of many objectives at once; the number of passes over the rows.

    ``evaluate(asked)`` makes one pass for the list of (place in ``points``, theta, move, short): a move of None asks for the derivatives at
    theta, a move for those at theta + move, and with ``short`` for the losses at all step sizes. So a step that is taken whole, the
    usual one, costs one pass and one look at each row, whatever the number of objectives; a shorter one costs two passes more.
    """
    passes = 0
    short: dict[int, tuple[np.ndarray, float]] = {}
    while True:
        asked = []
        for i, p in enumerate(points):
            if p.done and p.known:
                continue
            if not p.known:
                asked.append((i, p.theta, None, False))
            elif i in short:
                asked.append((i, p.theta, short[i], True))
            else:
                move = -np.linalg.solve(p.data + np.diag(p.pen) + 1e-4 * np.eye(len(p.theta)), p.grad)
                asked.append((i, p.theta, move, False))
        if not asked:
            return passes
        passes += 1
        for (i, theta, move, all_sizes), got in zip(asked, evaluate(asked), strict=True):
            p = points[i]
            if move is None:
                p.take(got)
                continue
            slope, before = float(p.grad @ move), p.value
            if not all_sizes:
                trial = got[0] + 0.5 * float(p.pen @ (theta + move) ** 2)
                if not trial <= before + 1e-4 * slope:
                    short[i] = move
                    continue
                p.theta = theta + move
                p.take(got)
            else:
                del short[i]
                losses = got + [0.5 * float(p.pen @ (theta + a * move) ** 2) for a in STEPS]
                good = np.flatnonzero(losses[1:] <= before + 1e-4 * STEPS[1:] * slope) + 1
                if not len(good):
                    p.steps, p.done = p.steps + 1, True
                    continue
                trial, p.theta = losses[good[0]], theta + STEPS[good[0]] * move
                p.grad = None  # not known here yet
            p.steps += 1
            p.done = p.steps >= steps or abs(before - trial) <= tol * (abs(before) + 1e-12)


def with_one(psi: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(psi)), psi])


def newton(df: DataFrame, layout: Layout, r2: str, r: np.ndarray, w: np.ndarray | None = None, h0: float | None = None, steps: int = 20, tol: float = 1e-6) -> LogVariance:
    """Fit (h0, w) to squared residuals in column ``r2``; h0 is not penalised."""
    f = layout.size
    if h0 is None:
        h0 = math.log(max(df.agg(F.avg(r2)).head()[0] or 0.0, 1e-12))
    point = Point(np.append(h0, np.zeros(f) if w is None else w), np.append(0.0, r))
    size = 1 + (f + 1) + (f + 1) ** 2

    def evaluate(asked):
        (_, theta, move, short), = asked
        if short:
            return [_sum_rows(df, layout, r2, lambda psi, v: step_sums(with_one(psi), v, theta, move), len(STEPS))]
        at = theta if move is None else theta + move
        return [_sum_rows(df, layout, r2, lambda psi, v: derivative_sums(with_one(psi), v, at), size)]

    newton_many(evaluate, [point], steps, tol)
    return LogVariance(layout, point.theta[1:], float(point.theta[0]), point.data + np.diag(point.pen) + 1e-9 * np.eye(f + 1), point.data, point.value, point.steps, point.grad)


@dataclass
class Heteroscedastic:
    mean_layout: Layout
    w: np.ndarray
    f0: float
    solution: Solution
    variance: LogVariance | None
    sigma2: float
    nll: dict
    kept: bool


def weighted_mean_fit(df: DataFrame, layout: Layout, target: str, r: np.ndarray, weight: str | None) -> tuple[Solution, float]:
    """Joint intercept and ridge: y and design less their weighted means."""
    s = stats_pass(df, layout, target, weight)[None]
    fit = solve(s.demeaned(), r)
    return fit, s.mean - float(s.s / s.sw @ fit.w)


def heteroscedastic(df: DataFrame, mean: Layout, var: Layout, target: str, r_mean: np.ndarray, r_var: np.ndarray, split: str | None = None, rounds: int = 10, tol: float = 1e-4, gain: float = 2e-3) -> Heteroscedastic:
    """Alternate mean and log-variance on rows with split 'train', keep the best round by 'val' likelihood, and keep the
    variance part only if it beats a constant by a relative ``gain`` under the same mean without doubling the
    error. Without ``split`` all rows are both."""
    spark = df.sparkSession
    names = list(dict.fromkeys([*mean.features, *var.features]))
    scratch = Scratch(spark, "variance")
    rows = df.select(*names, F.col(target).alias("_y"), (F.col(split) if split else F.lit("train")).alias("_split"))
    rows = scratch.save(rows, "rows")
    train = rows.filter("_split = 'train'")
    val = rows.filter("_split = 'val'") if split else train
    unit, f0 = weighted_mean_fit(train, mean, "_y", r_mean, None)
    sigma2 = unit.sigma2
    nll_of = lambda d, w, c, s2: predict(d, mean, w, c, "_p").agg(F.avg(0.5 * F.log(s2) + (F.col("_y") - F.col("_p")) ** 2 / (2 * s2))).head()[0]
    start = nll_of(val, unit.w, f0, F.lit(float(sigma2)))
    tss = train.agg(F.var_pop("_y")).head()[0] or 0.0
    if tss and unit.mse / tss < 1e-2:  # nearly noiseless: the residuals say nothing about noise
        return Heteroscedastic(mean, unit.w, f0, unit, None, sigma2, {"constant": start}, False)
    fit, c, part, best, last = unit, f0, None, None, None
    weight = None
    for n in range(rounds):
        lev = leverage_rows(train if weight is None else train.withColumn("_w", weight), mean, "_y", fit.w, c, fit.inverse, None if weight is None else "_w")
        lev = scratch.save(lev.withColumn("_r2", debiased(F.col("residual") ** 2, F.col("leverage"))).select(*names, "_y", "_r2"), f"round-{n}")
        part = newton(lev, var, "_r2", r_var, part.w if part else None, part.h0 if part else None)
        weight = F.exp(-part.column())
        fit, c = weighted_mean_fit(train.withColumn("_w", weight), mean, "_y", r_mean, "_w")
        nll = nll_of(val, fit.w, c, F.exp(part.column()))
        scratch.drop(f"round-{n}")
        if best is None or nll < best[0]:
            best = (nll, fit, c, part)
        if last is not None and abs(last - nll) <= tol * (abs(last) + 1e-12):
            break
        last = nll
    nll, fit, c, part = best
    flat = predict(val, mean, fit.w, c, "_p").agg(F.avg((F.col("_y") - F.col("_p")) ** 2)).head()[0]
    first = predict(val, mean, unit.w, f0, "_p").agg(F.avg((F.col("_y") - F.col("_p")) ** 2)).head()[0]
    constant = 0.5 * math.log(max(flat, 1e-300)) + 0.5
    kept = constant - nll > gain * abs(constant) and flat <= 4 * first
    report = {"constant": start, "constant_same_mean": constant, "input": nll}
    return Heteroscedastic(mean, fit.w if kept else unit.w, c if kept else f0, fit if kept else unit, part if kept else None, sigma2, report, kept)


def variance_path(df: DataFrame, layout: Layout, r2: str, shape: np.ndarray, lams) -> list[dict]:
    """Newton fits from the largest penalty down, each started at the last; objective and df at each."""
    out, w, h0 = [], None, None
    for lam in sorted(lams, reverse=True):
        part = newton(df, layout, r2, lam * shape, w, h0)
        w, h0 = part.w, part.h0
        out.append({"lambda": float(lam), "objective": part.objective, "df": part.df, "w": part.w, "h0": part.h0})
    return out[::-1]


def one_step_loo(rows: DataFrame, layout: Layout, part: LogVariance, residual: str, leverage: str) -> DataFrame:
    """Deleted joint log-likelihood (``loo_nll``) by one Newton step per left-out row, and the ``correction`` of its log-variance:
    (1 - rho) q / 2, q = psi' H^-1 psi, cut at 5."""
    from varlens.operators.rows import _map_rows

    inv = np.linalg.inv(part.hessian)

    def moved(phi, e):
        u = np.column_stack([np.ones(len(phi)), phi])
        h = np.clip(part.h0 + phi @ part.w, -BOUND, BOUND)
        rho = e[residual] ** 2 * np.exp(-h)
        return h, np.clip(0.5 * (1 - rho) * ((u @ inv) * u).sum(axis=1), -5, 5)

    def nll(phi, e):
        h, more = moved(phi, e)
        deleted = e[residual] / (1 - np.clip(e[leverage], 0, 1 - 1e-10))
        return 0.5 * (h + more) + 0.5 * deleted**2 * np.exp(-(h + more)) + 0.5 * math.log(2 * math.pi)

    return _map_rows(rows, layout, {"loo_nll": nll, "correction": lambda phi, e: moved(phi, e)[1]}, (residual, leverage))
