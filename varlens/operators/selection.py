"""Which groups of columns (variables, pairs) a design needs: BIC, group lasso, one-standard-error; and sparse solvers.

All work on sufficient statistics: dropping a group deletes rows and columns, and a coordinate's
gradient is b_j - C_j w.
"""

from __future__ import annotations

import math

import numpy as np

from varlens.operators.ridge import path, solve
from varlens.operators.stats import Stats, total


def soft(x: float, t: float) -> float:
    """Soft threshold."""
    return math.copysign(max(abs(x) - t, 0.0), x)


def group_soft(v: np.ndarray, t: float) -> np.ndarray:
    """Group soft threshold in the Euclidean norm."""
    n = float(np.linalg.norm(v))
    return v * max(1 - t / n, 0.0) if n > 0 else v


def gram_norm(w: np.ndarray, g: np.ndarray) -> float:
    return math.sqrt(max(float(w @ g @ w), 0.0))


def by_bic(stats: Stats, r: np.ndarray, blocks: list[slice]) -> list[dict]:
    """A row per group: BIC with and without it; selected if leaving it out is worse."""
    full = solve(stats, r).bic
    out = []
    for g, block in enumerate(blocks):
        keep = np.ones(len(r), bool)
        keep[block] = False
        at = np.flatnonzero(keep)
        less = solve(stats.take(at), r[at]).bic if len(at) else stats.n * math.log(max(stats.yy / stats.n, 1e-12))
        out.append({"group": g, "bic_with": full, "bic_without": less, "delta": less - full, "selected": less > full})
    return out


def lasso(stats: Stats, r: np.ndarray, alpha: float | np.ndarray, steps: int = 5000, tol: float = 1e-12, w: np.ndarray | None = None) -> np.ndarray:
    """min 1/(2n) RSS + r'w^2 + alpha'|w| by cyclic coordinate descent."""
    n, f = stats.n, len(r)
    a = np.broadcast_to(np.asarray(alpha, float), (f,))
    w = np.zeros(f) if w is None else w.copy()
    grad = stats.b - stats.c @ w
    diag = np.diag(stats.c)
    for _ in range(steps):
        most = 0.0
        for j in range(f):
            new = soft((grad[j] + diag[j] * w[j]) / n, a[j]) / (diag[j] / n + 2 * r[j] or 1e-300)
            if new != w[j]:
                grad -= stats.c[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < tol:
            break
    return w


def elastic_net(stats: Stats, r: np.ndarray, alpha: float, adaptive: bool = True) -> np.ndarray:
    """Lasso with the ridge part r and, if adaptive, an L1 weight that grows with the root of a column's penalty."""
    weight = np.sqrt(r / np.median(r)) if adaptive and np.median(r) > 0 else np.ones_like(r)
    return lasso(stats, r, alpha * weight)


def _group_step(stats: Stats, r: np.ndarray, w: np.ndarray, grad: np.ndarray, block: slice, shrink) -> float:
    """Solve one block given the others, shrink it, update the gradient; the largest change."""
    c = stats.c[block, block]
    free = np.linalg.solve(c + np.diag(stats.n * r[block]) + 1e-12 * np.eye(c.shape[0]), grad[block] + c @ w[block])
    new = shrink(free)
    change = new - w[block]
    grad -= stats.c[:, block] @ change
    w[block] = new
    return float(np.abs(change).max(initial=0.0))


def group_lasso(stats: Stats, r: np.ndarray, blocks: list[slice], alpha: float, weights=None, mix: float = 0.0, steps: int = 500, tol: float = 1e-10, w: np.ndarray | None = None) -> np.ndarray:
    """Block coordinate descent with n r as the ridge part; each block's solution is shrunk by alpha * weight (default the
    root of its size) in the norm of its Gram matrix. With ``mix`` a share of alpha first shrinks single
    entries (sparse group lasso)."""
    f = len(r)
    w = np.zeros(f) if w is None else w.copy()
    weights = [math.sqrt(b.stop - b.start) for b in blocks] if weights is None else weights
    grad = stats.b - stats.c @ w

    def shrinker(block, weight):
        c = stats.c[block, block] / stats.n

        def shrink(v):
            if mix:
                d = np.maximum(np.diag(c) + r[block], 1e-300)
                v = np.sign(v) * np.maximum(np.abs(v) - mix * alpha / d, 0)
            size = gram_norm(v, c)
            return v * max(1 - (1 - mix) * alpha * weight / size, 0.0) if size > 0 else v

        return shrink

    shrinkers = [shrinker(b, g) for b, g in zip(blocks, weights, strict=True)]
    for _ in range(steps):
        if max(_group_step(stats, r, w, grad, b, s) for b, s in zip(blocks, shrinkers, strict=True)) < tol:
            break
    return w


def sparsity(w: np.ndarray, blocks: list[slice], tol: float = 1e-10) -> dict:
    on = np.abs(w) > tol
    return {"nonzero": int(on.sum()), "share_zero": float(1 - on.mean()) if len(w) else 0.0, "groups_on": sum(bool(on[b].any()) for b in blocks)}


def glasso_path(stats: Stats, r: np.ndarray, blocks: list[slice], points: int = 30, ratio: float = 1e-3) -> list[dict]:
    """Group-lasso solutions from the smallest alpha that empties the model down, warm-started, with BIC by active sizes."""
    starts = []
    for b in blocks:
        c = stats.c[b, b] / stats.n
        free = np.linalg.solve(stats.c[b, b] + np.diag(stats.n * r[b]) + 1e-12 * np.eye(c.shape[0]), stats.b[b])
        starts.append(gram_norm(free, c) / math.sqrt(b.stop - b.start))
    top, w, out = max(starts, default=0.0), None, []
    for a in np.logspace(0, math.log10(ratio), points) * max(top, 1e-300):
        w = group_lasso(stats, r, blocks, float(a), w=w)
        on = [g for g, b in enumerate(blocks) if np.abs(w[b]).max(initial=0) > 1e-10]
        df = sum(blocks[g].stop - blocks[g].start for g in on)
        out.append({"alpha": float(a), "active": on, "df": df, "bic": stats.n * math.log(max(stats.rss(w) / stats.n, 1e-15)) + math.log(stats.n) * df, "w": w})
    return out


def by_glasso(stats: Stats, r: np.ndarray, blocks: list[slice], **options) -> list[int]:
    return min(glasso_path(stats, r, blocks, **options), key=lambda p: p["bic"])["active"]


def cv_path(folds: dict, shape: np.ndarray, lams: np.ndarray, centre: bool = True) -> list[dict]:
    """Mean and standard error over folds of the held-out mean square at each lambda; folds are subtracted, not refitted."""
    whole = total(folds)
    parts = []
    for held in folds.values():
        train = whole - held
        at = train.mean if centre else 0.0
        parts.append((train.centred(at), held.centred(at)))
    errors = np.array([[h.rss(p["w"]) / h.n for p in path(t, shape, lams)] for t, h in parts])
    return [{"lambda": float(x), "cv": float(e.mean()), "se": float(e.std(ddof=1) / math.sqrt(len(e)))} for x, e in zip(lams, errors.T, strict=True)]


def by_one_se(folds: dict, shape: np.ndarray, blocks: list[slice], grams: list[np.ndarray] | None = None, points: int = 40) -> dict:
    """The largest lambda within one standard error of the best, and the groups whose norm then exceeds sigma sqrt(B / n)."""
    rows = cv_path(folds, shape, np.logspace(-6, 2, points))
    best = min(rows, key=lambda r: r["cv"])
    lam = max(r["lambda"] for r in rows if r["cv"] <= best["cv"] + best["se"])
    whole = total(folds).centred()
    s = solve(whole, lam * shape)
    norms = [gram_norm(s.w[b], grams[g]) if grams else float(np.linalg.norm(s.w[b])) for g, b in enumerate(blocks)]
    on = [g for g, b in enumerate(blocks) if norms[g] > math.sqrt(s.sigma2 * (b.stop - b.start) / whole.n)]
    return {"lambda": lam, "best_lambda": best["lambda"], "active": on, "path": rows}


def active_variables(shares: dict[int, float], threshold: float = 0.01, most: int | None = None, least: int = 2) -> list[int]:
    """Variables whose share exceeds the threshold, largest first and at most ``most``; never fewer than ``least``."""
    order = sorted(shares, key=lambda v: (-shares[v], v))
    n = max(sum(shares[v] > threshold for v in order), min(least, len(order)))
    return sorted(order[: min(n, most or n)])
