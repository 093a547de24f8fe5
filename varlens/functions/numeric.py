"""Small numerics: Student-t quantiles, one-dimensional and projected quasi-Newton minimisers, Halton points."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 400):
        for even in (True, False):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    """Student's t; the normal quantile for infinite df."""
    if math.isinf(df) or df > 1e8:
        return normal_quantile(p)
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def minimise_scalar(f, low: float, high: float, steps: int = 60) -> tuple[float, float]:
    """Golden-section minimum on [low, high]."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (x, fx) if fx <= fy else (y, fy)


def minimise(f, x0, low, high, steps: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, float]:
    """Projected BFGS in a box; f returns (value, gradient)."""
    x = np.clip(np.asarray(x0, float), low, high)
    v, g = f(x)
    h = np.eye(len(x))
    for _ in range(steps):
        stuck = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))
        d = -(h @ np.where(stuck, 0, g))
        d[stuck] = 0
        if d @ g >= 0:
            h, d = np.eye(len(x)), np.where(stuck, 0, -g)
        if np.abs(d).max(initial=0) < 1e-14:
            break
        t = min(1.0, 2.0 / max(np.abs(d).max(), 1e-300))
        while True:
            new = np.clip(x + t * d, low, high)
            nv, ng = f(new)
            if nv <= v + 1e-4 * g @ (new - x) or t < 1e-12:
                break
            t /= 2
        s, y = new - x, ng - g
        done = abs(v - nv) <= tol * (abs(v) + 1e-12)
        if s @ y > 1e-14:
            r = 1 / (s @ y)
            e = np.eye(len(x)) - r * np.outer(s, y)
            h = e @ h @ e.T + r * np.outer(s, s)
        x, v, g = new, nv, ng
        if done:
            break
    return x, v


def halton(n: int, d: int, start: int = 1) -> np.ndarray:
    """n Halton points of d dimensions."""
    primes: list[int] = []
    c = 2
    while len(primes) < d:
        if all(c % p for p in primes):
            primes.append(c)
        c += 1
    out = np.zeros((n, d))
    for k, base in enumerate(primes):
        i, f = np.arange(start, start + n), 1.0
        while i.any():
            f /= base
            out[:, k] += f * (i % base)
            i //= base
    return out
