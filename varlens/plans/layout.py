"""The layout of a design: variables, terms, their column blocks, Gram matrices and penalties.

A layout never holds data. Columns are ordered by term: order 1, then 2, then 3; within a term the
basis functions of its variables multiply row-major.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varlens.functions.basis import basis_batch, basis_columns, basis_size, gram, penalty


@dataclass(frozen=True)
class Spec:
    """One variable's basis within a term."""

    k: int
    basis: str = "fourier"
    linear: bool = True

    @property
    def size(self) -> int:
        return basis_size(self.k, self.basis, self.linear)


@dataclass(frozen=True)
class Term:
    """A component: its variables (ascending places) and their bases."""

    vars: tuple[int, ...]
    specs: tuple[Spec, ...]
    #: Of a layout with a basis for each variable.
    mixed: bool = False

    @property
    def size(self) -> int:
        return int(np.prod([s.size for s in self.specs]))

    @property
    def order(self) -> int:
        return len(self.vars)

    def gram(self) -> np.ndarray:
        return reduce(np.kron, [gram(s.k, s.basis, s.linear) for s in self.specs])

    def penalty(self, lam: float, strategy: str) -> np.ndarray:
        """Products of Gram diagonals for ``variance`` and lam for ``uniform``, else and in mixed layouts sums over the variables, with a floor."""
        if self.order == 1:
            s = self.specs[0]
            return penalty(s.k, lam, strategy, s.basis, s.linear)
        if strategy == "uniform" and not self.mixed:
            return np.full(self.size, lam)
        if strategy == "variance" and not self.mixed:
            return lam * np.diag(self.gram())
        parts = [penalty(s.k, lam, strategy, s.basis, s.linear, order=self.order) for s in self.specs]
        return np.maximum(reduce(np.add.outer, parts).ravel(), lam * 1e-6)


@dataclass(frozen=True)
class Layout:
    features: tuple[str, ...]
    terms: tuple[Term, ...]
    offsets: tuple[int, ...] = field(init=False)

    def __post_init__(self):
        sizes = [t.size for t in self.terms]
        object.__setattr__(self, "offsets", tuple(int(x) for x in np.cumsum([0, *sizes])))

    @classmethod
    def build(cls, features, k1=5, k2=0, k3=0, pairs=None, triples=None, basis="fourier", linear=True, per_variable=None, per_pair=None, first=None) -> Layout:
        """Terms of orders 1 to 3. ``pairs``/``triples``: places, default all. ``per_variable``: a (basis, k) for each
        feature (a mixed layout: Legendre holds the linear part, other bases have none). ``per_pair``: k2 by pair.
        ``first``: places with a main effect, default all."""
        d = len(features)
        own = [Spec(k1, basis, linear)] * d if per_variable is None else [Spec(k, b, False) for b, k in per_variable]
        terms = [Term((i,), (own[i],)) for i in (range(d) if first is None else sorted(first)) if own[i].size]
        if k2 or per_pair:
            for i, j in combinations(range(d), 2) if pairs is None else sorted(tuple(sorted(p)) for p in pairs):
                k = (per_pair or {}).get((i, j), k2)
                specs = (Spec(k, basis, linear),) * 2 if per_variable is None else (own[i], own[j])
                if k:
                    terms.append(Term((i, j), specs, per_variable is not None))
        if k3:
            for t in combinations(range(d), 3) if triples is None else sorted(tuple(sorted(t)) for t in triples):
                terms.append(Term(t, (Spec(k3, basis, linear),) * 3))
        return cls(tuple(features), tuple(terms))

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def block(self, k: int) -> slice:
        return slice(self.offsets[k], self.offsets[k + 1])

    def columns(self, source=F.col) -> list[Column]:
        """All columns as Catalyst expressions of the features."""
        out = []
        for t in self.terms:
            parts = [basis_columns(source(self.features[v]), s.k, s.basis, s.linear) for v, s in zip(t.vars, t.specs, strict=True)]
            out += reduce(lambda a, b: [x * y for x in a for y in b], parts)
        return out

    def batch(self, x: np.ndarray) -> np.ndarray:
        """All columns for rows of features."""
        out = np.empty((len(x), self.size))
        known: dict = {}
        for k, t in enumerate(self.terms):
            block = None
            for v, s in zip(t.vars, t.specs, strict=True):
                if (v, s) not in known:
                    known[v, s] = basis_batch(x[:, v], s.k, s.basis, s.linear)
                b = known[v, s]
                block = b if block is None else (block[:, :, None] * b[:, None, :]).reshape(len(x), -1)
            out[:, self.block(k)] = block
        return out

    def penalty(self, lams: dict[int, float] | float, strategy: str | dict[int, str] = "variance") -> np.ndarray:
        """The penalty diagonal; ``lams`` and ``strategy`` may go by order."""
        lam = lambda o: lams if isinstance(lams, (int, float)) else lams[o]
        how = lambda o: strategy if isinstance(strategy, str) else strategy[o]
        return np.concatenate([t.penalty(lam(t.order), how(t.order)) for t in self.terms] or [np.zeros(0)])

    def select(self, keep) -> tuple[Layout, np.ndarray]:
        """The layout of some terms and the places of their columns."""
        keep = list(keep)
        at = np.concatenate([np.arange(self.offsets[k], self.offsets[k + 1]) for k in keep] or [np.zeros(0, int)])
        return Layout(self.features, tuple(self.terms[k] for k in keep)), at.astype(int)

    def relation(self, spark: SparkSession) -> DataFrame:
        """term_id, ord, vars, basis, k, offset, size."""
        rows = [(n, t.order, [v + 1 for v in t.vars], t.specs[0].basis, t.specs[0].k, self.offsets[n], t.size) for n, t in enumerate(self.terms)]
        return spark.createDataFrame(rows, "term_id int, ord int, vars array<int>, basis string, k int, offset int, size int")


def pairs_of(d: int, active=None, mode: str = "all") -> list[tuple[int, int]]:
    """Candidate pairs: all, both active, or either active."""
    a = set(range(d) if active is None else active)
    test = {"all": lambda i, j: True, "both": lambda i, j: i in a and j in a, "either": lambda i, j: i in a or j in a}[mode]
    return [p for p in combinations(range(d), 2) if test(*p)]


def richest_pairs(n: float, d: int, active, first: int, block: int, most: int) -> dict:
    """The widest choice of pairs, of all, either and both active, whose design stays below five columns a row and within
    ``most`` columns; both where none does. ``first``: columns of the main effects, ``block``: of a pair."""
    options = [(mode, pairs_of(d, active, mode)) for mode in ("all", "either", "both")]
    sized = [(mode, pairs, first + block * len(pairs)) for mode, pairs in options]
    mode, pairs, columns = next((o for o in sized if o[2] < 5 * n and o[2] <= most), sized[-1])
    return {"mode": mode, "pairs": pairs, "columns": columns}


def triples_of(d: int, active=None, mode: str = "all") -> list[tuple[int, int, int]]:
    """Candidate triples by how many members are active: all, all_active, two_active, one_active."""
    a = set(range(d) if active is None else active)
    least = {"all": 0, "one_active": 1, "two_active": 2, "all_active": 3}[mode]
    return [t for t in combinations(range(d), 3) if len(a.intersection(t)) >= least]


def first_try(n: int, d: int, budget: int | None = None, ratio: int = 10) -> dict[str, int]:
    """Orders for a first fit that keep the columns within min(budget, n / ratio): K1 = 2, pairs at K2 = 1, then K1 and K2 in turn."""
    most = min(budget or n, n // ratio)
    pairs = d * (d - 1) // 2
    size = lambda k1, k2: d * basis_size(k1) + pairs * basis_size(k2) ** 2 * (k2 > 0)
    k1, k2 = 1, 0
    for a, b in ((2, 0), (2, 1), (3, 1), (4, 1), (4, 2), (5, 2)):
        if size(a, b) > most:
            break
        k1, k2 = a, b
    return {"k1": k1, "k2": k2, "columns": size(k1, k2)}
