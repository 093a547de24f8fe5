"""Penalised least squares from sufficient statistics: solutions, criteria, penalty paths and their optimum.

Nothing here touches rows. A design's y is centred; df counts the design, and the criteria add one
for the mean. Where a residual sum of squares is so small against y's that subtraction spoils it,
``Solution.exact`` says so and a residual pass should replace it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from varlens.functions.numeric import minimise, minimise_scalar
from varlens.operators.stats import Stats

FLOOR = 1e-12


@dataclass
class Solution:
    w: np.ndarray
    inverse: np.ndarray
    n: float
    rss: float
    df: float
    tr_h2: float
    exact: bool
    evidence: float
    intercept_df: float = 1.0

    @property
    def mse(self) -> float:
        return self.rss / self.n

    @property
    def df_residual(self) -> float:
        return max(self.n - 2 * self.df + self.tr_h2, 1.0)

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_residual

    @property
    def gcv(self) -> float:
        return self.mse / max(1e-10, 1 - (self.df + self.intercept_df) / self.n) ** 2

    @property
    def aic(self) -> float:
        return self.n * math.log(max(self.mse, 1e-15)) + 2 * (self.df + self.intercept_df)

    @property
    def bic(self) -> float:
        return self.n * math.log(max(self.mse, 1e-15)) + math.log(self.n) * (self.df + self.intercept_df)

    def criterion(self, name: str) -> float:
        return -self.evidence if name == "evidence" else getattr(self, name)


def solve(stats: Stats, r: np.ndarray, intercept_df: float = 1.0) -> Solution:
    """min sum w (y - phi w)^2 + w' R w for the given (usually centred) statistics."""
    f = len(r)
    a = stats.c + np.diag(r)
    inverse = np.linalg.inv(a) if f else np.zeros((0, 0))
    w = np.linalg.solve(a, stats.b) if f else np.zeros(0)
    m = inverse @ stats.c
    rss = max(stats.rss(w), 0.0)
    ytr = max(stats.yy - float(w @ stats.b), 1e-300)
    sign, logdet = np.linalg.slogdet(a) if f else (1, 0.0)
    n = stats.n
    evidence = -n / 2 * math.log(ytr / n) - 0.5 * (logdet - np.log(np.maximum(r, FLOOR)).sum()) - n / 2 * (1 + math.log(2 * math.pi))
    return Solution(w, inverse, n, rss, float(np.trace(m)), float((m * m.T).sum()), rss > 1e-8 * max(stats.yy, 1e-300), float(evidence), intercept_df)


@dataclass
class EigenPath:
    """All penalties lam * shape from one eigendecomposition."""

    stats: Stats
    shape: np.ndarray

    def __post_init__(self):
        self.root = np.sqrt(np.maximum(self.shape, FLOOR))
        mu, self.q = np.linalg.eigh(self.stats.c / np.outer(self.root, self.root))
        self.mu = np.maximum(mu, 0)
        self.c = self.q.T @ (self.stats.b / self.root)

    def at(self, lam: float) -> dict[str, float]:
        n, share = self.stats.n, self.mu / (self.mu + lam)
        z = self.c / (self.mu + lam)
        ytr = self.stats.yy - float((self.c * z).sum())
        rss = max(ytr - lam * float((z * z).sum()), 0.0)
        df = float(share.sum())
        out = {"lambda": lam, "df": df, "tr_h2": float((share**2).sum()), "rss": rss, "mse": rss / n}
        out["gcv"] = out["mse"] / max(1e-10, 1 - (df + 1) / n) ** 2
        log = n * math.log(max(out["mse"], 1e-15))
        out["aic"], out["bic"] = log + 2 * (df + 1), log + math.log(n) * (df + 1)
        out["evidence"] = -n / 2 * math.log(max(ytr, 1e-300) / n) - 0.5 * float(np.log((self.mu + lam) / lam).sum()) - n / 2 * (1 + math.log(2 * math.pi))
        out["sigma2"] = rss / max(n - 2 * df + out["tr_h2"], 1.0)
        return out

    def weights(self, lam: float) -> np.ndarray:
        return (self.q @ (self.c / (self.mu + lam))) / self.root


def path(stats: Stats, shape: np.ndarray, lams=None) -> list[dict]:
    """Criteria at each lambda (default 50 from 1e-6 to 1e2); solved one by one where the eigenproblem is too ill-conditioned."""
    lams = np.logspace(-6, 2, 50) if lams is None else np.asarray(lams, float)
    if len(shape) and shape.min() > 0 and shape.max() / shape.min() < 1e8:
        e = EigenPath(stats, shape)
        return [e.at(float(x)) | {"w": e.weights(float(x))} for x in lams]
    out = []
    for x in lams:
        s = solve(stats, x * shape)
        out.append({"lambda": float(x), "df": s.df, "tr_h2": s.tr_h2, "rss": s.rss, "mse": s.mse, "gcv": s.gcv, "aic": s.aic, "bic": s.bic, "evidence": s.evidence, "sigma2": s.sigma2, "w": s.w})
    return out


def best_lambda(stats: Stats, shape: np.ndarray, criterion: str = "gcv", low: float = -6, high: float = 2, points: int = 50) -> dict:
    """The lambda that minimises a criterion (evidence is maximised): a grid, then golden section around its best point."""
    grid = np.linspace(low, high, points)
    sign = -1 if criterion == "evidence" else 1
    good = len(shape) and shape.min() > 0 and shape.max() / shape.min() < 1e8
    e = EigenPath(stats, shape) if good else None
    value = lambda u: sign * e.at(10**u)[criterion] if good else solve(stats, 10**u * shape).criterion(criterion)
    values = [value(u) for u in grid]
    k = int(np.argmin(values))
    u, v = minimise_scalar(value, grid[max(k - 1, 0)], grid[min(k + 1, points - 1)])
    if values[k] < v:
        u, v = grid[k], values[k]
    return {"lambda": 10**u, criterion: sign * v, "solution": solve(stats, 10**u * shape)}


def criterion_gradient(stats: Stats, shapes: list[np.ndarray], logs: np.ndarray, criterion: str = "gcv") -> tuple[float, np.ndarray]:
    """A criterion and its gradient in log10 of the block penalties; r = sum of 10**log * shape."""
    lams = 10.0**logs
    r = sum(x * s for x, s in zip(lams, shapes, strict=True))
    s = solve(stats, r)
    u, n = s.inverse, stats.n
    ucu = ((u @ stats.c) * u).sum(axis=1)
    uw = u @ (r * s.w)
    ytr = stats.yy - float(s.w @ stats.b)
    grad = []
    for x, shape in zip(lams, shapes, strict=True):
        d_df = -float((ucu * shape).sum())
        d_rss = 2 * float((shape * s.w * uw).sum())
        chain = x * math.log(10)
        if criterion == "gcv":
            e = 1 - (s.df + 1) / n
            g = d_rss / n / e**2 + 2 * s.mse / e**3 * d_df / n
        elif criterion in ("aic", "bic"):
            g = n * d_rss / max(s.rss, 1e-300) + (2 if criterion == "aic" else math.log(n)) * d_df
        else:
            inside = np.where(r > FLOOR, shape / np.maximum(r, FLOOR), 0)
            g = n / 2 * float((shape * s.w**2).sum()) / max(ytr, 1e-300) + 0.5 * float((np.diag(u) * shape).sum() - inside.sum())
        grad.append(g * chain)
    return s.criterion(criterion), np.array(grad)


def best_lambdas(stats: Stats, shapes: list[np.ndarray], criterion: str = "gcv", start=None, low: float = -8, high: float = 3) -> dict:
    """Up to four block penalties (shape vectors over all columns, zero outside their block), jointly."""
    k = len(shapes)
    f = lambda x: criterion_gradient(stats, shapes, x, criterion)
    if start is None:
        grid = np.linspace(-5, 1, 4)
        start = min((np.array(p) for p in np.stack(np.meshgrid(*[grid] * k), axis=-1).reshape(-1, k)), key=lambda x: f(x)[0]) if k <= 3 else np.array([-3.0] + [-2.0] * (k - 1))
    x, v = minimise(f, start, np.full(k, low), np.full(k, high))
    r = sum(10.0**a * s for a, s in zip(x, shapes, strict=True))
    return {"lambdas": (10.0**x).tolist(), criterion: -v if criterion == "evidence" else v, "solution": solve(stats, r)}


def order_shapes(layout, strategy="variance") -> list[np.ndarray]:
    """One unit-penalty shape for each order that the layout has, zero elsewhere."""
    unit = layout.penalty(1.0, strategy)
    out = []
    for o in sorted({t.order for t in layout.terms}):
        keep = np.concatenate([np.full(t.size, float(t.order == o)) for t in layout.terms])
        out.append(unit * keep)
    return out


def path_shares(stats: Stats, layout, shape: np.ndarray, lams) -> list[dict]:
    """Every term's share at every lambda * shape, from one eigendecomposition."""
    from varlens.operators.sensitivity import shares

    found = EigenPath(stats, shape)
    return [{"lambda": float(lam), "term": s["term"], "vars": s["vars"], "variance": s["variance"], "share": s["share_core"]} for lam in lams for s in shares(layout, found.weights(lam))]
