"""Fourier, Legendre and Haar bases on [0, 1], twice: as Column expressions and as NumPy batches.

Both give the same functions in the same order. Fourier: x - 1/2 (if linear), then cos and sin of
2 pi k x. Legendre: shifted polynomials of degree 1 to K. Haar: for scale j = 1..K, 2**(j-1) wavelets of
amplitude 2**((j-1)/2); cells are half open, but each scale's last cell holds x = 1.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("fourier", "legendre", "haar")


def basis_size(k: int, basis: str = "fourier", linear: bool = True) -> int:
    """Number of functions of order k."""
    if k < 0:
        raise ValueError("order must not be negative")
    if k == 0:
        return 0
    return {"fourier": 2 * k + linear, "legendre": k, "haar": 2**k - 1}[basis]


def haar_index(k: int) -> list[tuple[int, int]]:
    """(scale, position) of each Haar function of order k."""
    return [(j, p) for j in range(1, k + 1) for p in range(2 ** (j - 1))]


def basis_columns(x: Column, k: int, basis: str = "fourier", linear: bool = True) -> list[Column]:
    """The basis functions of a column of values in [0, 1]."""
    if basis == "fourier":
        out = [x - F.lit(0.5)] if linear else []
        for f in range(1, k + 1):
            out += [F.cos(x * F.lit(2 * math.pi * f)), F.sin(x * F.lit(2 * math.pi * f))]
        return out if k else []
    if basis == "legendre":
        z, out = x * F.lit(2.0) - F.lit(1.0), []
        before, now = F.lit(1.0), z
        for d in range(1, k + 1):
            out.append(now)
            before, now = now, (F.lit(float(2 * d + 1)) * z * now - F.lit(float(d)) * before) / F.lit(float(d + 1))
        return out
    if basis == "haar":
        out = []
        for j, p in haar_index(k):
            a, n = 2 ** ((j - 1) / 2), 2 ** (j - 1)
            left, middle, right = p / n, (p + 0.5) / n, (p + 1) / n
            inside = x <= right if p == n - 1 else x < right
            out.append(F.when((x >= left) & (x < middle), F.lit(a)).when((x >= middle) & inside, F.lit(-a)).otherwise(F.lit(0.0)))
        return out
    raise ValueError(f"unknown basis {basis!r}")


def basis_batch(x: np.ndarray, k: int, basis: str = "fourier", linear: bool = True) -> np.ndarray:
    """The basis functions of a vector, a column each."""
    x = np.asarray(x, float)
    out = np.empty((len(x), basis_size(k, basis, linear)))
    if not k:
        return out
    if basis == "fourier":
        at = int(linear)
        if linear:
            out[:, 0] = x - 0.5
        angle = np.outer(x, 2 * math.pi * np.arange(1, k + 1))
        out[:, at::2], out[:, at + 1 :: 2] = np.cos(angle), np.sin(angle)
    elif basis == "legendre":
        z = 2 * x - 1
        before, now = np.ones_like(z), z
        for d in range(1, k + 1):
            out[:, d - 1] = now
            before, now = now, ((2 * d + 1) * z * now - d * before) / (d + 1)
    elif basis == "haar":
        out[:] = 0
        rows = np.flatnonzero((x >= 0) & (x <= 1))
        for j in range(1, k + 1):
            n = 2 ** (j - 1)
            cell = np.minimum((x[rows] * n).astype(int), n - 1)
            out[rows, n - 1 + cell] = np.where(x[rows] * n - cell < 0.5, 2 ** ((j - 1) / 2), -(2 ** ((j - 1) / 2)))
    else:
        raise ValueError(f"unknown basis {basis!r}")
    return out


def gram(k: int, basis: str = "fourier", linear: bool = True) -> np.ndarray:
    """Inner products of the basis functions over [0, 1]."""
    n = basis_size(k, basis, linear)
    if basis == "legendre":
        return np.diag(1.0 / (2 * np.arange(1, k + 1) + 1))
    if basis == "haar":
        return np.eye(n)
    g = np.eye(n) / 2
    if linear and k:
        g[0, 0] = 1 / 12
        for f in range(1, k + 1):
            g[0, 2 * f] = g[2 * f, 0] = -1 / (2 * math.pi * f)
    return g


def derivative_energy(k: int, p: int, basis: str = "fourier", linear: bool = True) -> np.ndarray:
    """Integral of the squared p-th derivative of each function (for Haar its Besov weight 4**(p j))."""
    if basis == "haar":
        return np.array([4.0 ** (p * j) for j, _ in haar_index(k)])
    if basis == "legendre":
        out = []
        for d in range(1, k + 1):
            c = np.polynomial.legendre.legder(np.eye(d + 1)[d], p) * 2.0**p
            out.append(float((c**2 / (2 * np.arange(len(c)) + 1)).sum()))
        return np.array(out)
    out = [float(p == 1)] if linear and k else []
    for f in range(1, k + 1):
        out += [(2 * math.pi * f) ** (2 * p) / 2] * 2
    return np.array(out)


def penalty(k: int, lam: float, strategy: str = "variance", basis: str = "fourier", linear: bool = True, order: int = 1) -> np.ndarray:
    """Diagonal penalty of one variable's functions.

    uniform: lam. variance: lam times the Gram diagonal. smoothness and curvature: lam times the energy of
    the first or second derivative. sobolev_s: lam (1 + e)^s, where e is the eigenvalue of frequency f:
    (2 pi f)^2, d (d + 1) for degree d, 4^(j - 1) for scale j. spectral_a: lam f^a, with f the
    frequency, degree or 2^(j - 1). The linear function of a Fourier basis has lam in both. In orders 2 and 3
    smoothness has a floor, as curvature has in every order, so that no function is free.
    """
    n = basis_size(k, basis, linear)
    name, _, number = strategy.partition("_")
    if basis == "fourier":
        f = np.array(([0] if linear and k else []) + [q for q in range(1, k + 1) for _ in "cs"], float)
        eigen = (2 * math.pi * f) ** 2
    elif basis == "legendre":
        f = np.arange(1, k + 1, dtype=float)
        eigen = f * (f + 1)
    else:
        f = np.array([2.0 ** (j - 1) for j, _ in haar_index(k)])
        eigen = f**2
    if name == "uniform":
        return np.full(n, lam)
    if name == "variance":
        return lam * np.diag(gram(k, basis, linear)) if n else np.zeros(0)
    if name == "smoothness":
        e = derivative_energy(k, 1, basis, linear)
        return lam * (e if order == 1 else np.maximum(e, 1e-6))
    if name == "curvature":
        return lam * np.maximum(derivative_energy(k, 2, basis, linear), 1e-6)
    if name == "sobolev":
        return lam * np.where(f > 0, (1 + eigen) ** float(number or 1), 1.0)
    if name == "spectral":
        return lam * np.where(f > 0, np.maximum(f, 1) ** float(number or 2), 1.0)
    raise ValueError(f"unknown penalty strategy {strategy!r}")
