"""One-call fits: main effects, interactions, complement, log-variance, as configured or as the data ask."""

from __future__ import annotations

import difflib
import math
from dataclasses import dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.operators import prepare
from varlens.operators.diagnostics import next_stages, residual_correlations
from varlens.operators.joint import deleted
from varlens.operators.residual import Complement, Features, complement_variance, fit_complement, kmeans_centres, whole_intervals
from varlens.operators.ridge import Solution, best_lambdas, order_shapes, solve
from varlens.operators.rows import leverage_rows, linear, loo_summary, predict, sandwich
from varlens.operators.selection import active_variables, by_bic, by_glasso, by_one_se
from varlens.operators.sensitivity import block_variances, components_table, share_intervals, shares, total_order
from varlens.operators.stats import LARGEST, Stats, stats_pass, total
from varlens.operators.structure import exact_loo
from varlens.operators.variance import BOUND, Heteroscedastic, heteroscedastic, newton, one_step_loo
from varlens.plans.layout import Layout, Spec, Term, pairs_of, richest_pairs, triples_of

STRATEGIES = ("uniform", "variance", "smoothness", "curvature", "sobolev", "spectral")


@dataclass(frozen=True)
class Config:
    """Everything a fit can be told. Unknown names and values out of range are errors with the nearest valid one."""

    k1: int = 5
    k2: int = 3
    k3: int = 0
    basis: str = "fourier"
    linear: bool = True
    per_variable: tuple | None = None
    strategy: str = "variance"
    lambda1: float = 1e-3
    lambda2: float = 1e-2
    lambda3: float = 1e-1
    criterion: str | None = None
    stages: tuple[str, ...] | None = None
    pairs: tuple | str = "either"
    selection: str = "bic"
    prune_pairs: bool = True
    threshold: float = 0.01
    residual: str | None = None
    residual_size: int = 50
    residual_scale: float = 0.5
    residual_lambda: float = 1e-2
    kh: int = 1
    kh2: int = 0
    lambda_h: float = 1.0
    lambda_h2: float | None = None
    variance_features: tuple[str, ...] | None = None
    variance_basis: str | None = None
    variance_pairs: tuple | str = "all"
    prune_mains: bool = False
    folds: int = 5
    level: float = 0.95

    def __post_init__(self):
        for name, low in (("k1", 1), ("k2", 0), ("k3", 0), ("kh", 1), ("kh2", 0), ("folds", 2), ("residual_size", 1)):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v < low:
                raise ValueError(f"{name} must be an integer from {low} on, not {v!r}")
        for name in ("lambda1", "lambda2", "lambda3", "lambda_h", "residual_lambda", "residual_scale"):
            v = getattr(self, name)
            if not isinstance(v, (int, float)) or not v > 0 or math.isinf(v):
                raise ValueError(f"{name} must be a positive number, not {v!r}")
        if not 0 < self.level < 1 or not 0 <= self.threshold < 1:
            raise ValueError("level must lie within (0, 1) and threshold within [0, 1)")
        choose = {"basis": ("fourier", "legendre", "haar"), "selection": ("bic", "glasso", "1se", "threshold", "none"), "criterion": (None, "gcv", "aic", "bic", "evidence"), "residual": (None, "rbf", "rff", "nystrom")}
        for name, allowed in choose.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if self.strategy.split("_")[0] not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}, not {self.strategy!r}")
        if self.lambda_h2 is not None and not 0 < self.lambda_h2 < math.inf:
            raise ValueError(f"lambda_h2 must be a positive number, not {self.lambda_h2!r}")
        if self.variance_basis not in (None, *choose["basis"]):
            raise ValueError(f"variance_basis must be one of {choose['basis']}, not {self.variance_basis!r}")
        if isinstance(self.variance_pairs, str) and self.variance_pairs not in ("all", "auto"):
            raise ValueError("variance_pairs must be all, auto or a list of pairs of feature names")
        if self.variance_features is not None and not self.variance_features:
            raise ValueError("variance_features must name some features")
        if isinstance(self.pairs, str) and self.pairs not in ("all", "both", "either", "auto"):
            raise ValueError("pairs must be all, both, either, auto or a list of pairs")
        if self.stages is not None and (not self.stages or self.stages[0] != "A" or list(self.stages) != sorted(set(self.stages)) or set(self.stages) - set("ABCD")):
            raise ValueError("stages must be A, then any of B, C and D in order")

    @classmethod
    def of(cls, **given) -> Config:
        names = [f.name for f in fields(cls)]
        for k in given:
            if k not in names:
                near = difflib.get_close_matches(k, names, 1)
                raise ValueError(f"unknown option {k!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return cls(**given)


def noise_layout(c: Config, features: list[str], rows: DataFrame, squares: str) -> Layout:
    """The log-variance's own design: main effects of ``variance_features`` (default all; the noise is taken as flat along the
    others) and, with ``kh2``, pairs of them: all, those given by name, or ``auto``, both of whose variables a quick fit of
    main effects to ``squares`` finds active."""
    own = list(features if c.variance_features is None else c.variance_features)
    if missing := [x for x in own if x not in features]:
        raise ValueError(f"variance_features {missing} are no features")
    places = [features.index(x) for x in own]
    basis = c.variance_basis or c.basis
    mains = Layout.build(features, c.kh, basis=basis, linear=c.linear, first=places)
    if not c.kh2:
        return mains
    if isinstance(c.variance_pairs, str):
        active = places
        if c.variance_pairs == "auto":
            quick = newton(rows, mains, squares, mains.penalty(c.lambda_h, c.strategy), steps=5)
            v = block_variances(mains, quick.w)
            active = active_variables({t.vars[0]: x / max(v.sum(), 1e-300) for t, x in zip(mains.terms, v, strict=True)}, c.threshold)
        pairs = pairs_of(len(features), [a for a in active if a in places], "both")
    else:
        pairs = []
        for p in c.variance_pairs:
            if len(p) != 2 or p[0] == p[1] or any(x not in own for x in p):
                raise ValueError(f"variance pair {p!r} must be two different names of {own}")
            pairs.append(tuple(sorted(features.index(x) for x in p)))
    return Layout.build(features, c.kh, c.kh2, pairs=pairs, basis=basis, linear=c.linear, first=places) if pairs else mains


def noise_penalty(layout: Layout, c: Config) -> np.ndarray:
    """lambda_h for main effects, lambda_h2 (default ten times that) for pairs."""
    return layout.penalty({1: c.lambda_h, 2: c.lambda_h2 or 10 * c.lambda_h}, c.strategy)


@dataclass
class Result:
    """A fit: its layout and statistics, and answers as DataFrames."""

    config: Config
    features: list[str]
    target: str
    quantiles: prepare.Quantiles | None
    layout: Layout
    penalty: np.ndarray
    stats: Stats
    solution: Solution
    f0: float
    folds: dict
    stages: list[str]
    complement: Complement | None = None
    hetero: Heteroscedastic | None = None
    log: list[dict] = field(default_factory=list)
    rows: DataFrame | None = None

    @property
    def noise(self):
        """The log-variance part, where one was kept."""
        return self.hetero.variance if self.hetero else None

    @property
    def weights(self) -> np.ndarray:
        """The coefficients that predict: weighted by the noise where its part was kept."""
        return self.hetero.w if self.noise else self.solution.w

    def shares(self, measure: str | None = None) -> list[dict]:
        """A row per term; ``share_total`` counts a complement's variance under ``measure``: cube (default) or data."""
        return shares(self.layout, self.weights, self.residual_variance(measure or "cube"))

    def residual_variance(self, measure: str = "cube") -> float:
        if self.complement is None:
            return 0.0
        return complement_variance(self.complement, None if measure == "cube" else self.rows)

    def noise_components(self) -> DataFrame:
        """The spectrum of the log-variance: empty without that part."""
        part = self.noise
        return components_table(self.rows.sparkSession, part.layout if part else Layout(tuple(self.features), ()), part.w if part else np.zeros(0), "noise")

    def to_dict(self) -> dict:
        """All numbers of the fit as plain Python values."""
        s, part = self.solution, self.noise
        names = lambda vs: [self.features[v] for v in vs]
        terms = [{"vars": names(x["vars"]), "variance": x["variance"], "share_core": x["share_core"], "share_total": x["share_total"]} for x in self.shares()]
        out = {"target": self.target, "features": list(self.features), "stages": list(self.stages), "rows": int(s.n), "columns": self.layout.size, "intercept": float(self.hetero.f0 if part else self.f0), "mse": s.mse, "r2": 1 - s.rss / max(self.stats.yy, 1e-300), "sigma2": s.sigma2, "df": s.df, "gcv": s.gcv, "aic": s.aic, "bic": s.bic, "terms": terms, "total_order": {k: float(v) for k, v in self.total_order().items()}, "coefficients": [float(x) for x in self.weights]}
        out["noise"] = None if part is None else [{"vars": names(x["vars"]), "share": x["share_core"]} for x in shares(part.layout, part.w)]
        return out

    def summary(self, most: int = 10) -> str:
        """A few lines of text: quality, then the largest terms."""
        d = self.to_dict()
        lines = [f"{d['target']}: {d['rows']} rows, {d['columns']} columns, stages {''.join(d['stages'])}, R2 {d['r2']:.4f}, noise variance {d['sigma2']:.4g}"]
        lines += [f"  {' x '.join(t['vars']):<24} {t['share_core']:.4f}" for t in sorted(d["terms"], key=lambda t: -t["share_core"])[:most]]
        return "\n".join(lines)

    def first_order(self) -> dict[str, float]:
        return {self.features[s["vars"][0]]: s["share_core"] for s in self.shares() if len(s["vars"]) == 1}

    def total_order(self) -> dict[str, float]:
        return dict(zip(self.features, total_order(self.layout, self.weights), strict=True))

    def components(self, covariance: str | None = None) -> DataFrame:
        """The spectrum with intervals: classical sigma^2 A^-1 C A^-1, or HC0 / HC3 by one more pass. With a noise part the
        weighted coefficients and their posterior covariance, the inverse of the weighted normal matrix; a sandwich is then
        refused. With a complement lo and hi are bounds of ``share_core``, the share among the terms, as always, while
        ``share_total`` counts the complement's variance too."""
        s = self.solution
        if covariance not in (None, "HC0", "HC3"):
            raise ValueError(f"covariance must be None, HC0 or HC3, not {covariance!r}")
        if self.noise and covariance:
            raise ValueError("with a noise part the weighted fit's posterior covariance is used; a sandwich of the unweighted fit does not belong to it")
        if self.noise:
            cov = self.hetero.solution.inverse
        elif covariance:
            cov = sandwich(self.rows, self.layout, self.target, s.w, self.f0, s.inverse, covariance)
        else:
            cov = s.sigma2 * s.inverse @ self.stats.c @ s.inverse
        found = share_intervals(self.layout, self.weights, cov, s.df_residual, self.config.level)
        return components_table(self.rows.sparkSession, self.layout, self.weights, residual_variance=self.residual_variance(), intervals=found)

    def diagnostics(self) -> DataFrame:
        s = self.solution
        row = (s.n, float(self.layout.size), s.df, s.tr_h2, s.sigma2, s.mse, s.gcv, s.aic, s.bic, s.evidence)
        return self.rows.sparkSession.createDataFrame([tuple(map(float, row))], "n double, columns double, df double, tr_h2 double, sigma2 double, mse double, gcv double, aic double, bic double, evidence double")

    def loo(self, tier: int = 2) -> dict:
        """Leave-one-out likelihood and mean square. With a noise part tier 1 holds it as it is and tier 2 moves it by one
        Newton step for each row left out; without one they are the same. Tier 3 refits exactly, with a noise part mean and
        log-variance together for every row, so it is meant for small tables. With a noise part tier 2 says whether its step can
        be trusted: gradient (``kkt``) and conditioning of the log-variance, rows pressed against its bounds, corrections cut."""
        if tier not in (1, 2, 3):
            raise ValueError(f"tier must be 1, 2 or 3, not {tier!r}")
        s, part, rows = self.solution, self.noise, self.rows
        if part is None:
            out = {"tier": tier, **loo_summary(leverage_rows(rows, self.layout, self.target, s.w, self.f0, s.inverse), s.sigma2)}
            if tier == 3:
                exact = exact_loo(rows.withColumn("_k", F.lit(0)), self.layout, self.target, self.penalty, "_k")
                out["loo_nll"] = exact.agg(F.avg("loo_nll")).head()[0]
            return out
        if tier == 3:
            refits, flags = deleted(rows.withColumn("_k", F.monotonically_increasing_id()), self.layout, part.layout, self.target, self.penalty, noise_penalty(part.layout, self.config), "_k")
            return {"tier": 3, "loo_nll": float(np.mean([r["nll"] for r in refits])), "refits": len(refits), "settled": sum(r["converged"] for r in refits), **flags}
        h = self.hetero
        rows = leverage_rows(rows.withColumn("_w", F.exp(-part.column())), self.layout, self.target, h.w, h.f0, h.solution.inverse, "_w")
        free, ratio = linear(part.layout.columns(), part.w, part.h0), F.col("_w") * F.col("residual") ** 2
        active = ((free <= -BOUND * (1 - 1e-6)) & (ratio < 1)) | ((free >= BOUND * (1 - 1e-6)) & (ratio > 1))
        rows = rows.withColumn("_active", active)
        if tier == 2:
            rows = one_step_loo(rows, part.layout, part, "residual", "leverage")
        else:
            rows = rows.withColumn("loo_nll", 0.5 * (math.log(2 * math.pi) - F.log("_w") + F.col("_w") * F.col("loo_residual") ** 2)).withColumn("correction", F.lit(0.0))
        got = rows.agg(F.avg(F.col("loo_residual") ** 2).alias("cv"), F.avg("loo_nll").alias("nll"), F.max(F.col("_active").cast("int")).alias("active"), F.count_if(F.abs("correction") >= 5).alias("clipped")).head()
        out = {"tier": tier, "loo_cv": got["cv"], "loo_nll": got["nll"]}
        if tier == 2:
            health = part.health
            out |= {**health, "floor_active": bool(got["active"]), "clipped": got["clipped"], "guarantee_holds": not got["active"] and not health["ill_conditioned"]}
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.quantiles.apply(df) if self.quantiles else df

    def predict(self, df: DataFrame) -> DataFrame:
        """``df``'s features mapped, with prediction, noise and interval bounds. A complement moves prediction and bounds by
        its own value; the noise is then what both leave, or the noise part's."""
        s, part = self.solution, self.noise
        f0, inv = (self.hetero.f0, self.hetero.solution.inverse) if part else (self.f0, s.inverse)
        return whole_intervals(self.transform(df), self.layout, self.weights, f0, inv, s.sigma2, s.df_residual, s.n, self.config.level, (part.layout, part.w, part.h0) if part else None, self.complement)


def fit(df: DataFrame, target: str, features: list[str] | None = None, uniform: bool = False, split: str | None = None, fold: str | None = None, **options) -> Result:
    """Fit ``target`` on ``features`` (default: all other columns).

    ``uniform``: the features lie in [0, 1] already. ``split``: a column with train, val and test; rows not 'train' are left
    out of the means. ``fold``: an integer column for cross-validation and the one-standard-error rule. The first pass over
    the data decides main effects, a second one interactions; a variance part iterates.
    """
    c = Config.of(**options)
    features = [x for x in df.columns if x not in (target, split, fold)] if features is None else list(features)
    prepare.check_inputs(df, features, target)
    quantiles = None if uniform else prepare.Quantiles.fit(df if split is None else df.filter(F.col(split) == "train"), features)
    rows = df if uniform else quantiles.apply(df)
    train = rows if split is None else rows.filter(F.col(split) == "train")
    d = len(features)
    log: list[dict] = []

    def run(layout):
        folds = stats_pass(train, layout, target, by=fold)
        s = total(folds).centred()
        r = layout.penalty({1: c.lambda1, 2: c.lambda2, 3: c.lambda3}, c.strategy)
        if c.criterion:
            best = best_lambdas(s, order_shapes(layout, c.strategy), c.criterion)
            r = sum(x * y for x, y in zip(best["lambdas"], order_shapes(layout, c.strategy), strict=True))
        return folds, s, r, solve(s, r)

    layout = Layout.build(features, c.k1, basis=c.basis, linear=c.linear, per_variable=c.per_variable)
    folds, s, r, found = run(layout)
    mean = total(folds).mean
    stages = ["A"]
    log.append({"stage": "A", "columns": layout.size, "bic": found.bic, "mse": found.mse})
    if c.stages is None:
        scored = predict(train, layout, found.w, mean, "_p").withColumn("_res", F.col(target) - F.col("_p"))
        squares = residual_correlations(scored, features, "_res").filter("kind = 'square'").agg(F.max(F.abs("r"))).head()[0] or 0.0
        wanted = next_stages(1 - found.rss / max(s.yy, 1e-300), squares)
        wanted = [x for x in wanted if x != "C" or c.residual]
    else:
        wanted = list(c.stages[1:])
    if "B" in wanted and d > 1 and (c.k2 or c.k3):
        blocks = [layout.block(k) for k in range(len(layout.terms))]
        if c.selection == "bic":
            on = [layout.terms[x["group"]].vars[0] for x in by_bic(s, r, blocks) if x["selected"]]
        elif c.selection == "glasso":
            on = [layout.terms[g].vars[0] for g in by_glasso(s, r, blocks)]
        elif c.selection == "1se" and fold:
            on = [layout.terms[g].vars[0] for g in by_one_se(folds, r, blocks)["active"]]
        elif c.selection == "none":
            on = list(range(d))
        else:
            v = block_variances(layout, found.w)
            on = active_variables({t.vars[0]: v[k] / max(v.sum(), 1e-300) for k, t in enumerate(layout.terms)}, c.threshold)
        on = on if len(on) >= min(2, d) else list(range(d))
        if c.pairs == "auto":
            richest = richest_pairs(s.n, d, on, layout.size, Term((0, 1), (Spec(c.k2, c.basis, c.linear),) * 2).size if c.k2 else 0, LARGEST)
            pairs = richest["pairs"]
            log.append({"stage": "pairs", "mode": richest["mode"], "pairs": len(pairs), "columns": richest["columns"]})
        else:
            pairs = pairs_of(d, on, c.pairs) if isinstance(c.pairs, str) else list(c.pairs)
        triples = triples_of(d, on, "all_active") if c.k3 else None
        layout = Layout.build(features, c.k1, c.k2, c.k3, pairs, triples, c.basis, c.linear, c.per_variable)
        folds, s, r, found = run(layout)
        stages.append("B")
        log.append({"stage": "B", "columns": layout.size, "bic": found.bic, "mse": found.mse, "active": on})
        if c.prune_pairs or c.prune_mains:
            chosen = {x["group"] for x in by_bic(s, r, [layout.block(k) for k in range(len(layout.terms))]) if x["selected"]}
            higher = {k for k, t in enumerate(layout.terms) if t.order > 1 and (k in chosen or not c.prune_pairs)}
            held = {v for k in higher for v in layout.terms[k].vars}  # a main effect stays where an interaction holds its variable
            keep = sorted(higher | {k for k, t in enumerate(layout.terms) if t.order == 1 and (k in chosen or not c.prune_mains or t.vars[0] in held)})
            keep = keep or [0]
            if len(keep) < len(layout.terms):
                layout, at = layout.select(keep)
                folds = {k: v.take(at) for k, v in folds.items()}
                s, r = s.take(at), r[at]
                found = solve(s, r)
                log.append({"stage": "prune", "columns": layout.size, "bic": found.bic, "mse": found.mse})
    result = Result(c, features, target, quantiles, layout, r, s, found, mean, folds, stages, log=log, rows=train)
    if "C" in wanted and c.residual:
        if c.residual == "rff":
            extra = Features.random_fourier(d, c.residual_size, c.residual_scale)
        else:
            centres = kmeans_centres(train, features, c.residual_size)
            extra = Features.rbf(centres, c.residual_scale) if c.residual == "rbf" else Features.nystrom(centres, c.residual_scale)
        result.complement = fit_complement(train, layout, extra, target, found.w, mean, c.residual_lambda)
        stages.append("C")
    if "D" in wanted:
        scored = predict(train, layout, found.w, mean, "_p").withColumn("_r2", (F.col(target) - F.col("_p")) ** 2)
        var = noise_layout(c, features, scored, "_r2")
        result.hetero = heteroscedastic(rows, layout, var, target, r, noise_penalty(var, c), split)
        stages.append("D")
    return result
