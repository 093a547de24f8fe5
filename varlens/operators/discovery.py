"""What a model missed: projection scores of candidate terms on its residuals, and characterisation of bases.

All candidates are scored from one scan: each is a small block of its own, whose moments a partition adds up; none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.functions.basis import basis_batch
from varlens.operators.residual import Features, Joint
from varlens.operators.ridge import solve
from varlens.operators.sensitivity import block_variances
from varlens.operators.stats import Stats, of_batch, stats_pass
from varlens.plans.layout import Layout, Spec, Term, pairs_of, triples_of
from varlens.session import ship


def projection_score(s: Stats, ridge: float = 1e-8, adjust: bool = True) -> float:
    """Share of the residual variance in the span of a block, less what noise would give, not below 0."""
    m = len(s.b)
    if not m or not s.n:
        return 0.0
    c = np.linalg.solve(s.c + ridge * np.trace(s.c) / m * np.eye(m), s.b)
    captured = float(c @ s.c @ c) / s.n - (float(c @ s.s) / s.n) ** 2
    whole = s.yy / s.n - (s.sy / s.n) ** 2
    share = captured / max(whole, 1e-15)
    return max(0.0, share - m / s.n) if adjust else share


#: Bytes of partial statistics that one task holds; more candidates are dealt over more tasks.
TASK_BYTES = 1 << 26


def _candidate_rows(df: DataFrame, layouts: dict[str, Layout], targets: dict[str, str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """(k, s): each candidate's packed statistics over each partition. Candidates that one task cannot hold are dealt over several,
    each of which goes over its rows again."""
    ship(df.sparkSession)
    features = next(iter(layouts.values())).features
    names = sorted(set(targets.values()))
    used = df.select(*[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(names)], *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    parts: list[list[str]] = [[]]
    held = 0
    for k, lay in layouts.items():
        size = 8 * (4 + 2 * lay.size + lay.size * (lay.size + 1) // 2)
        if held + size > task_bytes and parts[-1]:
            parts.append([])
            held = 0
        parts[-1].append(k)
        held += size

    def runner(own: dict[str, tuple[Layout, int]]):
        def run(batches):
            sums: dict[str, Stats] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = [batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]
                y = [batch.column(f"_y{i}").to_numpy(zero_copy_only=False) for i in range(len(names))]
                known: dict = {}
                for k, (lay, t) in own.items():
                    got = of_batch(_columns(lay, x, known), y[t])
                    sums[k] = sums[k] + got if k in sums else got
            for k, s in sums.items():
                yield pa.record_batch({"k": pa.array([k]), "s": pa.array([s.pack()], pa.binary())})

        return run

    out = None
    for keys in parts:
        rows = used.mapInArrow(runner({k: (layouts[k], names.index(targets[k])) for k in keys}), "k string, s binary")
        out = rows if out is None else out.unionByName(rows)
    return out


def _columns(lay: Layout, x: list[np.ndarray], known: dict) -> np.ndarray:
    """A layout's columns; the bases of a variable are computed once for all layouts of a batch."""
    blocks = []
    for t in lay.terms:
        block = None
        for v, s in zip(t.vars, t.specs, strict=True):
            if (v, s) not in known:
                known[v, s] = basis_batch(x[v], s.k, s.basis, s.linear)
            b = known[v, s]
            block = b if block is None else (block[:, :, None] * b[:, None, :]).reshape(len(b), -1)
        blocks.append(block)
    return np.hstack(blocks) if blocks else np.zeros((len(x[0]) if x else 0, 0))


def _merged(rows: DataFrame, finish, schema: str) -> DataFrame:
    """finish(key, summed vector) of every candidate, a record batch each; candidates are added up side by side."""

    def merge(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("k").to_pylist(), batch.column("s"), strict=True):
                v = np.frombuffer(data.as_buffer(), float)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            yield finish(k, v)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "k").mapInArrow(merge, schema)


def block_stats(df: DataFrame, layouts: dict[str, Layout], target: str) -> dict[str, Stats]:
    """Statistics of many small layouts over the same features, from one scan."""
    rows = _merged(_candidate_rows(df, layouts, dict.fromkeys(layouts, target)), lambda k, v: pa.record_batch({"k": pa.array([k]), "s": pa.array([v.tobytes()], pa.binary())}), "k string, s binary")
    return {r["k"]: Stats.unpack(np.frombuffer(r["s"], float), layouts[r["k"]].size) for r in rows.collect()}  # a row per candidate


def block_scores(df: DataFrame, layouts: dict[str, Layout], targets: dict[str, str], task_bytes: int = TASK_BYTES) -> dict[str, float]:
    """Projection scores of many candidates, each on its target, from one scan; only scores reach the driver."""
    sizes = {k: lay.size for k, lay in layouts.items()}
    finish = lambda k, v: pa.record_batch({"k": pa.array([k]), "score": pa.array([projection_score(Stats.unpack(v, sizes[k]))])})
    return {r["k"]: r["score"] for r in _merged(_candidate_rows(df, layouts, targets, task_bytes), finish, "k string, score double").collect()}


def candidates(features, order: int, k: int, basis: str = "fourier", fitted=(), active=None) -> dict[tuple, Layout]:
    """A layout of its own for every term of an order that a model lacks."""
    d = len(features)
    every = [(i,) for i in range(d)] if order == 1 else pairs_of(d, active) if order == 2 else triples_of(d, active)
    done = {tuple(t) for t in fitted}
    return {t: Layout(tuple(features), (Term(t, (Spec(k, basis),) * order),)) for t in every if t not in done}


def scan(df: DataFrame, features, residual: str, fitted=(), order: int = 2, k: int = 2, basis: str = "fourier", threshold: float = 1e-3, active=None) -> list[dict]:
    """Scores of all pairs (or triples) that a model lacks, best first; flagged where above the threshold."""
    todo = candidates(features, order, k, basis, fitted, active)
    if not todo:
        return []
    key = {",".join(map(str, t)): t for t in todo}
    scores = block_scores(df, {name: todo[t] for name, t in key.items()}, dict.fromkeys(key, residual))
    rows = [{"vars": t, "score": scores[name], "candidates": len(todo), "flagged": scores[name] > threshold} for name, t in key.items() if name in scores]
    return sorted(rows, key=lambda r: (-r["score"], r["vars"]))


LEVELS = ("mains", "pairs", "triples", "variance_pairs")


def sieve(df: DataFrame, features, residual: str, fitted=(), log_square: str | None = None, k: int = 2, k1: int = 5, k3: int = 1, basis: str = "fourier", top: int | None = 5, threshold: float = 0.05, task_bytes: int = TASK_BYTES) -> dict:
    """Mains, pairs and triples of the residual, and pairs of its log-variance where given, all scored in one scan, with a
    recommendation. ``top``: how many of each level are listed (None: all). A level's ``total`` adds up its scores."""
    layouts: dict[str, Layout] = {}
    targets: dict[str, str] = {}
    for n, (level, order, size) in enumerate((("mains", 1, k1), ("pairs", 2, k), ("triples", 3, k3), ("variance_pairs", 2, k))):
        if level == "variance_pairs" and log_square is None:
            continue
        skip = [t for t in fitted if len(t) == order] if order > 1 and level != "variance_pairs" else ()
        for t, lay in candidates(features, order, size, basis, skip).items():
            key = f"{n}:" + ",".join(map(str, t))
            layouts[key], targets[key] = lay, residual if level != "variance_pairs" else log_square
    scores = block_scores(df, layouts, targets, task_bytes) if layouts else {}
    out: dict = {"totals": {}}
    found = []
    for n, level in enumerate(LEVELS):
        rows = [{"vars": layouts[key].terms[0].vars, "score": score, "flagged": score > threshold} for key, score in scores.items() if key.startswith(f"{n}:")]
        if not rows:
            continue
        rows.sort(key=lambda r: (-r["score"], r["vars"]))
        out["totals"][level] = float(sum(r["score"] for r in rows))
        out[level] = rows[:top]
        if rows[0]["score"] > threshold:
            found.append((level, rows[0]["score"]))
    out["scanned"] = len(layouts)
    out["recommend"] = [level for level, _ in sorted(found, key=lambda x: -x[1])]
    return out


def subspace_capture(df: DataFrame, layout: Layout, extra: Features, residual: str, top: int = 5, ridge: float = 1e-8) -> dict:
    """What share of a residual's variance a space of smooth functions would take: as it is, and made orthogonal to the
    design, each less what noise would give. One joint pass. ``directions``: the orthogonal space's principal directions by the
    energy of the residual along them, the ``top`` largest shares first."""
    joint, f = Joint(layout, extra), layout.size
    s = stats_pass(df, joint, residual)[None]
    m = extra.size
    at = np.arange(f, f + m)
    p = np.linalg.solve(s.c[:f, :f] + ridge * np.trace(s.c[:f, :f]) / max(f, 1) * np.eye(f), s.c[:f, f:]) if f else np.zeros((0, m))
    cross = s.c[:f, f:]
    apart = Stats(s.n, s.sw, s.sy, s.yy, s.s[f:] - p.T @ s.s[:f], s.b[f:] - p.T @ s.b[:f], s.c[f:, f:] - p.T @ cross - cross.T @ p + p.T @ s.c[:f, :f] @ p)
    centred = apart.demeaned()
    values, vectors = np.linalg.eigh((centred.c + centred.c.T) / 2)
    good = values > max(values.max(initial=0.0), 0.0) * 1e-10
    energy = np.where(good, (vectors.T @ centred.b) ** 2 / np.where(good, values, 1.0), 0.0) / max(centred.yy, 1e-300)
    order = np.argsort(-energy, kind="stable")[:top]
    return {"raw": projection_score(s.take(at)), "orthogonal": projection_score(apart), "residual_variance": s.yy / s.n - (s.sy / s.n) ** 2, "features": m, "directions": [{"share": float(energy[k]), "vector": vectors[:, k]} for k in order]}


def cross_residual(df: DataFrame, features, target: str, k: dict[str, int] | None = None, lam: float = 1e-3, strategy: str = "variance") -> list[dict]:
    """What a Legendre model of all variables explains of each, and what Fourier and Haar functions of the variable alone take of its
    residual; one pass. The last two are upper bounds: what both can express counts twice. A row per variable: variances, shares
    of their sum, its part of the target's variance, and a character."""
    k = k or {"legendre": 10, "fourier": 10, "haar": 5}
    d = len(features)
    terms = tuple(Term((i,), (Spec(k[b], b, b == "fourier"),)) for b in ("legendre", "fourier", "haar") if k[b] for i in range(d))
    lay = Layout(tuple(features), terms)
    s = stats_pass(df, lay, target)[None].centred()
    first = np.arange(lay.offsets[d])
    base = s.take(first)
    w = solve(base, Layout(lay.features, terms[:d]).penalty(lam, strategy)).w
    b_left = s.b - s.c[:, first] @ w  # of the residual with every column
    whole = s.yy / s.n
    spread = lambda at, c: max(float(c @ s.c[np.ix_(at, at)] @ c) / s.n - (float(s.s[at] @ c) / s.n) ** 2, 0.0)
    out = []
    for i, name in enumerate(features):
        v = {"legendre": 0.0, "fourier": 0.0, "haar": 0.0}
        for n, t in enumerate(terms):
            if t.vars == (i,):
                at = np.arange(lay.offsets[n], lay.offsets[n + 1])
                v[t.specs[0].basis] = spread(at, w[at] if n < d else np.linalg.lstsq(s.c[np.ix_(at, at)], b_left[at], rcond=None)[0])
        both = sum(v.values())
        part = {b: x / both if both >= 0.005 * whole and both > 0 else 0.0 for b, x in v.items()}
        out.append({"variable": name, **{f"{b}_variance": x for b, x in v.items()}, **part, "of_total": both / max(whole, 1e-300), "character": effect_character(part["legendre"], part["fourier"], part["haar"])})
    return out


def effect_character(polynomial: float, oscillating: float, local: float) -> str:
    """One word for the shares of a variable's effect."""
    if not polynomial + oscillating + local:
        return "negligible"
    if polynomial > 0.8:
        return "polynomial"
    if max(oscillating, local) > 0.3:
        return "oscillatory" if oscillating > local else "localized"
    return "polynomial" if polynomial > 0.5 else "mixed"


def characterise(df: DataFrame, features, residual: str, primary: dict[str, float], k: int = 5, scales: int = 4, least: float = 0.01) -> list[dict]:
    """What a fitted model's residual still holds of each variable: a row per variable with the share that Fourier functions take, the
    energies of its Haar scales as shares of the residual's variance, the strongest scale and a character. ``primary``: the
    model's own first-order shares. One scan for all variables."""
    layouts = {f"{b}{i}": Layout(tuple(features), (Term((i,), (Spec(n, b, b == "fourier"),)),)) for i in range(len(features)) for b, n in (("fourier", k), ("haar", scales))}
    stats = block_stats(df, layouts, residual)
    out = []
    for i, name in enumerate(features):
        s, h = stats[f"fourier{i}"].centred(), stats[f"haar{i}"].centred()
        whole = max(s.yy / s.n, 1e-300)
        c = np.linalg.lstsq(s.c, s.b, rcond=None)[0]
        fourier = max(float(c @ layouts[f"fourier{i}"].terms[0].gram() @ c), 0.0) / whole
        coefficient = h.b / h.n
        energy = [float((coefficient[2 ** (j - 1) - 1 : 2**j - 1] ** 2).sum()) / whole for j in range(1, scales + 1)]
        haar, own = sum(energy), float(primary.get(name, 0.0))
        character = "polynomial" if own > 0.8 else "localized" if haar > fourier and haar > least else "oscillatory" if fourier > least else "polynomial" if own > least else "negligible"
        out.append({"variable": name, "primary": own, "fourier": fourier, "haar": haar, "scales": energy, "strongest_scale": int(np.argmax(energy)) + 1 if haar > 0 else None, "character": character})
    return out


def discover_pairs(df: DataFrame, features, target: str, k1: int = 5, k2: int = 3, lam=(1e-3, 1e-2), strategy: str = "curvature", rounds: int = 5, per_round: int = 3, threshold: float = 1e-3) -> list[dict]:
    """Fit, scan the residual, add the best pairs, fit again; a row per round."""
    from varlens.operators.rows import predict

    pairs: list[tuple[int, int]] = []
    out = []
    for n in range(rounds):
        layout = Layout.build(features, k1, k2 if pairs else 0, pairs=pairs)
        s = stats_pass(df, layout, target)[None]
        fit = solve(s.centred(), layout.penalty({1: lam[0], 2: lam[1]}, strategy))
        out.append({"round": n, "pairs": list(pairs), "mse": fit.mse, "bic": fit.bic})
        rows = predict(df, layout, fit.w, s.mean, "_p").withColumn("_res", F.col(target) - F.col("_p"))
        new = [r["vars"] for r in scan(rows, features, "_res", pairs, 2, min(k2, 2), threshold=threshold) if r["flagged"]][:per_round]
        if not new:
            break
        pairs = sorted({*pairs, *new})
    return out


def basis_shares(df: DataFrame, features, target: str, k: dict[str, int] | None = None) -> list[dict]:
    """For each variable, what Legendre, then Fourier, then Haar functions add, in turn, to its explained variance.

    The joint statistics of the three bases give each step's gain by elimination.
    """
    k = k or {"legendre": 3, "fourier": 5, "haar": 4}
    layouts = {}
    for i in range(len(features)):
        terms = tuple(Term((i,), (Spec(k[b], b, False),)) for b in ("legendre", "fourier", "haar"))
        layouts[str(i)] = Layout(tuple(features), terms)
    stats = block_stats(df, layouts, target)
    out = []
    for i, name in enumerate(features):
        s, lay = stats[str(i)].demeaned(), layouts[str(i)]
        gains, before = [], 0.0
        for n in range(3):
            at = np.arange(lay.offsets[n + 1])
            part = s.take(at)
            eps = 1e-8 * np.trace(part.c) / max(len(at), 1)
            got = float(part.b @ np.linalg.solve(part.c + eps * np.eye(len(at)), part.b)) / max(s.yy, 1e-300)
            gains.append(max(got - before, 0.0))
            before = got
        out.append({"variable": name, "legendre": gains[0], "fourier": gains[1], "haar": gains[2], "recommend": recommend_basis(*gains)})
    return out


def recommend_basis(legendre: float, fourier: float, haar: float, least: float = 1e-3) -> str:
    """The first basis in order of smoothness that leaves little to the rougher ones."""
    if legendre + fourier + haar < least:
        return "none"
    if haar > 0.3 * (legendre + fourier + haar):
        return "legendre+haar" if legendre > haar else "haar"
    return "fourier" if fourier > 0.2 * (legendre + fourier) else "legendre"


def compare_bases(df: DataFrame, features, target: str, lam: float = 1e-3) -> list[dict]:
    """Main-effect fits in each basis: explained share and BIC; one scan for all three."""
    sizes = {"fourier": (3, True), "legendre": (6, True), "haar": (3, True)}
    layouts = {b: Layout.build(features, k, basis=b, linear=lin) for b, (k, lin) in sizes.items()}
    stats = block_stats(df, layouts, target)
    out = []
    for b, lay in layouts.items():
        s = stats[b].centred()
        fit = solve(s, lay.penalty(lam))
        out.append({"basis": b, "columns": lay.size, "explained": 1 - fit.rss / max(s.yy, 1e-300), "bic": fit.bic, "variances": block_variances(lay, fit.w)})
    return out
