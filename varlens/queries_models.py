"""Core queries, second part: statistics, solutions, criteria, folds, selection, sensitivity, prediction, diagnostics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from varlens.functions.basis import basis_columns
from varlens.operators import diagnostics, discovery, residual, ridge, rows, selection, sensitivity, variance
from varlens.operators.fit import fit
from varlens.operators.stats import stats_pass, total
from varlens.plans.layout import Layout, Spec, Term
from varlens.queries import fourier_sql, frac, haar_sql, legendre_sql, make, P, PI2, planted, projections, query, R, rd, table, tidy, W
from varlens.sources import synthetic

# --- normal equations --------------------------------------------------------------------------------------

_F1 = ["x1 - 0.5", "cos(2 * pi() * x1)", "sin(2 * pi() * x1)"]
_LIST = "[" + ", ".join(_F1) + "]"


def _normal(stats):
    out = []
    for key, s in stats.items():
        for i in range(len(s.b)):
            out.append((key, i, -1, s.b[i]))
            out += [(key, i, j, s.c[i, j]) for j in range(len(s.b))]
    return [(k, i, j, round(float(v), 5) + 0.0) for k, i, j, v in out]


def _normal_sql(weight, key):
    return f"""WITH {P}, f AS (SELECT {key} AS fold, y, CAST({weight} AS DOUBLE) AS w, {_LIST} AS f FROM p),
g AS (SELECT fold, y, w, f, CAST(unnest(range(0, 3)) AS INTEGER) AS i FROM f), h AS (SELECT fold, y, w, f, i, CAST(unnest(range(-1, 3)) AS INTEGER) AS j FROM g)
SELECT fold, i, j, {R('sum(w * f[i + 1] * CASE WHEN j < 0 THEN y ELSE f[greatest(j, 0) + 1] END)', 5)} AS v FROM h GROUP BY fold, i, j"""


def _one(spark, sf_dir, **k):
    return stats_pass(planted(spark, sf_dir), Layout.build(["x1"], 1), "y", **k)


@query(_normal_sql("1", "0"))
def normal_equations(spark, sf_dir):
    return make(spark, [(0, *r[1:]) for r in _normal(_one(spark, sf_dir))], "fold int, i int, j int, v double")


@query(_normal_sql("1", "0"))
def normal_equations_batches(spark, sf_dir):
    """The same through Arrow batches."""
    return make(spark, [(0, *r[1:]) for r in _normal(_one(spark, sf_dir, small=0))], "fold int, i int, j int, v double")


@query(_normal_sql("x2 + 0.5", "0"))
def normal_equations_weighted(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("w", F.col("x2") + 0.5)
    return make(spark, [(0, *r[1:]) for r in _normal(stats_pass(d, Layout.build(["x1"], 1), "y", "w"))], "fold int, i int, j int, v double")


@query(_normal_sql("1", "fold"))
def normal_equations_by_fold(spark, sf_dir):
    return make(spark, _normal(_one(spark, sf_dir, by="fold", small=0)), "fold int, i int, j int, v double")


# --- one-column models in closed form ----------------------------------------------------------------------

_COS = Layout(("x1",), (Term((0,), (Spec(1, "legendre"),)),))
#: f = 2 x1 - 1, y centred; sums n, c = sum f^2, b = sum f y, yy.
S1 = f"""{P}, m AS (SELECT avg(y) AS m FROM p), q AS (SELECT k, fold, 2 * x1 - 1 AS f, y - m AS y FROM p, m),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(f * f) AS c, sum(f * y) AS b, sum(y * y) AS yy FROM q)"""
_T1 = f"{S1}, t AS (SELECT n, c, b, yy, b / (c + 2) AS w, c / (c + 2) AS df, yy - 2 * b * b / (c + 2) + c * pow(b / (c + 2), 2) AS rss FROM s)"


def _solve1(spark, sf_dir, lam=2.0):
    s = stats_pass(planted(spark, sf_dir), _COS, "y")[None]
    return s, ridge.solve(s.centred(), np.array([lam]))


@query(f"WITH {_T1} SELECT {R('w', 8)} AS w, {R('rss / n', 8)} AS mse FROM t")
def ridge_one(spark, sf_dir):
    s = _solve1(spark, sf_dir)[1]
    return make(spark, [(round(s.w[0], 8), round(s.mse, 8))], "w double, mse double")


_S2 = f"""{P}, m AS (SELECT avg(y) AS m FROM p), q AS (SELECT 2 * x1 - 1 AS f, 2 * x2 - 1 AS g, y - m AS y FROM p, m),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(f * f) + 2 AS a, sum(f * g) AS c, sum(g * g) + 2 AS d, sum(f * y) AS u, sum(g * y) AS v, sum(y * y) AS yy FROM q)"""


@query(f"WITH {_S2} SELECT {R('(d * u - c * v) / (a * d - c * c)', 8)} AS w1, {R('(a * v - c * u) / (a * d - c * c)', 8)} AS w2 FROM s")
def ridge_two(spark, sf_dir):
    s = stats_pass(planted(spark, sf_dir), Layout.build(["x1", "x2"], 1, basis="legendre"), "y")[None].centred()
    w = ridge.solve(s, np.full(2, 2.0)).w
    return make(spark, [(round(w[0], 8), round(w[1], 8))], "w1 double, w2 double")


@query("SELECT CAST(i AS INTEGER) AS i, 0.0::DOUBLE AS gradient FROM (SELECT unnest(range(0, 24)) AS i)")
def ridge_optimality(spark, sf_dir):
    """(C + R) w - b of a pair model: zero in every column."""
    lay = Layout.build(["x1", "x2", "x3"], 2, 1, pairs=[(0, 2)])
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    r = lay.penalty({1: 1e-2, 2: 1e-1}, "curvature")
    f = ridge.solve(s, r)
    return make(spark, [(i, round(float(v), 6) + 0.0) for i, v in enumerate((s.c + np.diag(r)) @ f.w - s.b)], "i int, gradient double")


@query(f"""WITH {P}, q AS (SELECT 2 * x1 - 1 AS f, y, x2 + 0.5 AS w FROM p), m AS (SELECT sum(w * f) / sum(w) AS mf, sum(w * y) / sum(w) AS my FROM q),
s AS (SELECT sum(w * (f - mf) * (y - my)) / (sum(w * pow(f - mf, 2)) + 2) AS b, any_value(mf) AS mf, any_value(my) AS my FROM q, m) SELECT {R('b', 8)} AS w, {R('my - mf * b', 8)} AS f0 FROM s""")
def ridge_profiled_intercept(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("w", F.col("x2") + 0.5)
    s, f0 = variance.weighted_mean_fit(d, _COS, "y", np.array([2.0]), "w")
    return make(spark, [(round(s.w[0], 8), round(f0, 8))], "w double, f0 double")


@query(f"""WITH {_T1} SELECT {R('df')} AS df, {R('df * df')} AS tr_h2, {R('rss / (n - 2 * df + df * df)')} AS sigma2, {R('rss / n / pow(1 - (df + 1) / n, 2)')} AS gcv,
{R('n * ln(rss / n) + 2 * (df + 1)', 4)} AS aic, {R('n * ln(rss / n) + ln(n) * (df + 1)', 4)} AS bic,
{R('-n / 2 * ln((yy - w * b) / n) - 0.5 * (ln(c + 2) - ln(2)) - n / 2 * (1 + ln(2 * pi()))', 4)} AS evidence FROM t""")
def ridge_diagnostics(spark, sf_dir):
    s = _solve1(spark, sf_dir)[1]
    v = [round(x, 6) for x in (s.df, s.tr_h2, s.sigma2, s.gcv)] + [round(x, 4) for x in (s.aic, s.bic, s.evidence)]
    return make(spark, [v], "df double, tr_h2 double, sigma2 double, gcv double, aic double, bic double, evidence double")


_GRID = [10.0**e for e in range(-2, 5)]
_PATH = f"""{S1}, l AS (SELECT CAST(unnest(range(-2, 5)) AS INTEGER) AS e), t AS (SELECT e, n, c / (c + pow(10::DOUBLE, e)) AS df, yy - 2 * b * b / (c + pow(10::DOUBLE, e)) + c * pow(b / (c + pow(10::DOUBLE, e)), 2) AS rss FROM s, l)"""


@query(f"WITH {_PATH} SELECT e, {R('df')} AS df, {R('rss / n')} AS mse, {R('rss / n / pow(1 - (df + 1) / n, 2)')} AS gcv, {R('rss / (n - 2 * df + df * df)')} AS sigma2 FROM t")
def lambda_path(spark, sf_dir):
    s = stats_pass(planted(spark, sf_dir), _COS, "y")[None].centred()
    out = [(round(math.log10(p["lambda"])), *(round(p[x], 6) for x in ("df", "mse", "gcv", "sigma2"))) for p in ridge.path(s, np.ones(1), _GRID)]
    return make(spark, out, "e int, df double, mse double, gcv double, sigma2 double")


@query(f"WITH {_PATH} SELECT min_by(e, rss / n / pow(1 - (df + 1) / n, 2)) AS e_gcv, min_by(e, n * ln(rss / n) + ln(n) * (df + 1)) AS e_bic FROM t")
def lambda_best(spark, sf_dir):
    s = stats_pass(planted(spark, sf_dir), _COS, "y")[None].centred()
    p = ridge.path(s, np.ones(1), _GRID)
    return make(spark, [tuple(round(math.log10(min(p, key=lambda r: r[c])["lambda"])) for c in ("gcv", "bic"))], "e_gcv int, e_bic int")


@query("SELECT 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2")
def lambda_joint(spark, sf_dir):
    """Two penalties chosen jointly by GCV: the gradient at the optimum is zero (or points out of the box)."""
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    shapes = ridge.order_shapes(lay)
    best = ridge.best_lambdas(s, shapes)
    logs = np.log10(best["lambdas"])
    g = ridge.criterion_gradient(s, shapes, logs)[1]
    g = np.where((logs <= -8) & (g > 0) | (logs >= 3) & (g < 0), 0, g)
    return make(spark, [tuple(round(float(x), 3) + 0.0 for x in g)], "g1 double, g2 double")


_LEV = f"{_T1}, r AS (SELECT k, q.f, q.y - t.w * q.f AS e, q.f * q.f / (t.c + 2) AS h FROM q, t)"


def _leveraged(spark, sf_dir):
    d = planted(spark, sf_dir)
    s, f = _solve1(spark, sf_dir)
    return rows.leverage_rows(d, _COS, "y", f.w, s.mean, f.inverse), f


@query(f"WITH {_LEV} SELECT k, {R('h', 9)} AS leverage, {R('e')} AS residual, {R('e / (1 - h)')} AS loo_residual FROM r")
def leverage(spark, sf_dir):
    return _leveraged(spark, sf_dir)[0].select("k", rd(F.col("leverage"), 9).alias("leverage"), rd(F.col("residual")).alias("residual"), rd(F.col("loo_residual")).alias("loo_residual"))


@query(f"WITH {_LEV}, u AS (SELECT avg(pow(e / (1 - h), 2)) AS cv FROM r), v AS (SELECT cv, rss / (n - 2 * df + df * df) AS s2 FROM u, t) SELECT {R('cv')} AS loo_cv, {R('0.5 * ln(s2) + cv / (2 * s2) + 0.5 * ln(2 * pi())')} AS loo_nll FROM v")
def loo_score(spark, sf_dir):
    d, f = _leveraged(spark, sf_dir)
    got = rows.loo_summary(d, f.sigma2)
    return make(spark, [(round(got["loo_cv"], 6), round(got["loo_nll"], 6))], "loo_cv double, loo_nll double")


@query(f"WITH {_LEV} SELECT k, {R('e * e / least(greatest(1 - h, 1e-3), 1)')} AS r2 FROM r")
def leverage_debias(spark, sf_dir):
    d, _ = _leveraged(spark, sf_dir)
    return d.select("k", rd(rows.debiased(F.col("residual") ** 2, F.col("leverage"))).alias("r2"))


@query(f"WITH {_LEV} SELECT {R('sum(pow(r.f * e / (1 - h), 2)) / pow(any_value(t.c) + 2, 2)', 12)} AS hc3, {R('sum(pow(r.f * e, 2)) / pow(any_value(t.c) + 2, 2)', 12)} AS hc0 FROM r, t")
def sandwich_covariance(spark, sf_dir):
    d = planted(spark, sf_dir)
    s, f = _solve1(spark, sf_dir)
    return make(spark, [tuple(round(float(rows.sandwich(d, _COS, "y", f.w, s.mean, f.inverse, k)[0, 0]), 12) for k in ("HC3", "HC0"))], "hc3 double, hc0 double")


_KF = f"""{P}, j AS (SELECT a.fold, avg(b.y) AS m FROM (SELECT DISTINCT fold FROM p) a JOIN p b ON b.fold <> a.fold GROUP BY a.fold),
w AS (SELECT j.fold, any_value(m) AS m, sum((2 * x1 - 1) * (y - m)) AS b, sum(pow(2 * x1 - 1, 2)) AS c FROM j JOIN p ON p.fold <> j.fold GROUP BY j.fold)"""


@query(f"WITH {_KF} SELECT p.fold, count(*) AS n, {R('avg(pow(y - m - b / (c + 2) * (2 * x1 - 1), 2))')} AS mse FROM p JOIN w USING (fold) GROUP BY p.fold")
def kfold_cv(spark, sf_dir):
    f = stats_pass(planted(spark, sf_dir), _COS, "y", by="fold")
    return make(spark, [(r["fold"], r["n"], round(r["mse"], 6)) for r in rows.kfold(f, np.array([2.0]))], "fold int, n long, mse double")


@query(f"""WITH {_KF}, l AS (SELECT CAST(unnest(range(-2, 5)) AS INTEGER) AS e), g AS (SELECT e, p.fold, avg(pow(y - m - b / (c + pow(10::DOUBLE, e)) * (2 * x1 - 1), 2)) AS s FROM p JOIN w USING (fold), l GROUP BY e, p.fold),
h AS (SELECT e, avg(s) AS cv, stddev_samp(s) / sqrt(5) AS se FROM g GROUP BY e) SELECT e, {R('cv')} AS cv, {R('se')} AS se, cv <= (SELECT min_by(cv + se, cv) FROM h) AS within FROM h""")
def one_se_rule(spark, sf_dir):
    f = stats_pass(planted(spark, sf_dir), _COS, "y", by="fold")
    p = selection.cv_path(f, np.ones(1), np.array(_GRID))
    best = min(p, key=lambda r: r["cv"])
    return make(spark, [(round(math.log10(r["lambda"])), round(r["cv"], 6), round(r["se"], 6), r["cv"] <= best["cv"] + best["se"]) for r in p], "e int, cv double, se double, within boolean")


_BIC = f"""{_S2}, t AS (SELECT n, yy - 2 * (u * w1 + v * w2) + (a - 2) * w1 * w1 + 2 * c * w1 * w2 + (d - 2) * w2 * w2 AS rss, ((a - 2) * d - c * c + a * (d - 2) - c * c) / (a * d - c * c) AS df, a, d, u, v, yy
FROM (SELECT *, (d * u - c * v) / (a * d - c * c) AS w1, (a * v - c * u) / (a * d - c * c) AS w2 FROM s)),
z AS (SELECT 0 AS g, n, rss, df, yy - 2 * v * v / d + (d - 2) * pow(v / d, 2) AS r1, (d - 2) / d AS df1 FROM t UNION ALL SELECT 1, n, rss, df, yy - 2 * u * u / a + (a - 2) * pow(u / a, 2), (a - 2) / a FROM t)"""


@query(f"WITH {_BIC} SELECT CAST(g AS INTEGER) AS g, {R('n * ln(r1 / n) + ln(n) * (df1 + 1) - n * ln(rss / n) - ln(n) * (df + 1)', 4)} AS delta, n * ln(r1 / n) + ln(n) * (df1 + 1) > n * ln(rss / n) + ln(n) * (df + 1) AS selected FROM z")
def bic_groups(spark, sf_dir):
    lay = Layout.build(["x1", "x2"], 1, basis="legendre")
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    got = selection.by_bic(s, np.full(2, 2.0), [lay.block(0), lay.block(1)])
    return make(spark, [(r["group"], round(r["delta"], 4), r["selected"]) for r in got], "g int, delta double, selected boolean")


@query(f"WITH {W(fourier_sql('x1', 2))} SELECT i, {R('sign(w) * greatest(abs(w) - 0.05, 0)')} AS v FROM w")
def soft_threshold(spark, sf_dir):
    w = projections(spark, sf_dir, Layout.build(["x1"], 2))
    return make(spark, [(i, round(float(selection.soft(x, 0.05)), 6) + 0.0) for i, x in enumerate(w)], "i int, v double")


@query(f"WITH {W(fourier_sql('x1', 2))}, n AS (SELECT sqrt(sum(w * w)) AS n FROM w) SELECT i, {R('w * greatest(1 - t / n, 0)')} AS v, t FROM w, n, (VALUES (0.1::DOUBLE), (6.0::DOUBLE)) s(t)")
def group_soft_threshold(spark, sf_dir):
    w = projections(spark, sf_dir, Layout.build(["x1"], 2))
    return make(spark, [(i, round(float(v), 6) + 0.0, t) for t in (0.1, 6.0) for i, v in enumerate(selection.group_soft(w, t))], "i int, v double, t double")


@query("SELECT 'lasso' AS method, 0.0::DOUBLE AS violation UNION ALL SELECT 'elastic_net', 0.0::DOUBLE")
def sparse_kkt(spark, sf_dir):
    """The largest violation of the optimality conditions of sparse solutions."""
    lay = Layout.build(["x1", "x2", "x3"], 2)
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    r = lay.penalty(1e-3, "curvature")
    out = []
    for name, w, a in (("lasso", selection.lasso(s, r, 0.05), np.full(len(r), 0.05)), ("elastic_net", selection.elastic_net(s, r, 0.05), 0.05 * np.sqrt(r / np.median(r)))):
        g = (s.b - s.c @ w) / s.n - 2 * r * w
        out.append((name, round(float(np.where(np.abs(w) > 0, np.abs(g - a * np.sign(w)), np.maximum(np.abs(g) - a, 0)).max()), 6)))
    return make(spark, out, "method string, violation double")


@query()
def group_lasso_path(spark, sf_dir):
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    p = selection.glasso_path(s, lay.penalty(1e-6), [lay.block(k) for k in range(len(lay.terms))], points=12)
    return make(spark, [(n, len(r["active"]), r["df"], round(r["bic"], 3)) for n, r in enumerate(p)], "step int, groups int, df int, bic double")


# --- sensitivity of the coefficients that the table gives ---------------------------------------------------

_LAY = Layout.build(["x1", "x2", "x3"], 1, 1, basis="legendre")
_L1 = [legendre_sql(x, 1)[0] for x in ("x1", "x2", "x3")]


def _coefficients(spark, sf_dir):
    return projections(spark, sf_dir, _LAY) / np.concatenate([np.diag(t.gram()) for t in _LAY.terms])


_CO = f"{W([*_L1, f'{_L1[0]} * {_L1[1]}', f'{_L1[0]} * {_L1[2]}', f'{_L1[1]} * {_L1[2]}'])}, c AS (SELECT i AS term, [1, 2, 3, 1, 1, 2][i + 1] AS v1, [NULL, NULL, NULL, 2, 3, 3][i + 1] AS v2, w * CASE WHEN i < 3 THEN 3 ELSE 9 END AS w, 1 / CASE WHEN i < 3 THEN 3.0::DOUBLE ELSE 9.0 END AS g FROM w), v AS (SELECT *, w * w * g AS v FROM c)"


@query(f"WITH {_CO} SELECT CAST(term AS INTEGER) AS term, {R('v')} AS variance, {R('v / sum(v) OVER ()')} AS share_core, {R('v / (sum(v) OVER () + 0.1)')} AS share_total, {R('sum(v) OVER (ORDER BY v DESC, term) / sum(v) OVER ()')} AS cumulative, CAST(row_number() OVER (ORDER BY v DESC, term) AS INTEGER) AS rank FROM v")
def sobol_shares(spark, sf_dir):
    d = make(spark, [(s["term"], s["variance"], s["share_core"], s["share_total"]) for s in sensitivity.shares(_LAY, _coefficients(spark, sf_dir), 0.1)], "term int, variance double, share_core double, share_total double")
    w = Window.orderBy(F.col("variance").desc(), "term")
    return tidy(d.withColumn("cumulative", F.sum("share_core").over(w)).withColumn("rank", F.row_number().over(w)))


@query(f"WITH {_CO}, e AS (SELECT v1 AS x, v FROM v UNION ALL SELECT v2, v FROM v WHERE v2 IS NOT NULL) SELECT CAST(x AS INTEGER) AS variable, {R('sum(v) / (SELECT sum(v) FROM v)')} AS total FROM e GROUP BY x")
def sobol_total_order(spark, sf_dir):
    return make(spark, [(i + 1, round(float(v), 6)) for i, v in enumerate(sensitivity.total_order(_LAY, _coefficients(spark, sf_dir)))], "variable int, total double")


@query(f"WITH {_CO} SELECT CAST(coalesce(o, 0) AS INTEGER) AS ord, {R('sum(v)')} AS variance FROM (SELECT CASE WHEN v2 IS NULL THEN 1 ELSE 2 END AS o, v FROM v) GROUP BY ROLLUP (o)")
def order_rollup(spark, sf_dir):
    d = sensitivity.components_table(spark, _LAY, _coefficients(spark, sf_dir))
    return tidy(d.rollup("ord").agg(F.sum("variance").alias("variance")).withColumn("ord", F.coalesce("ord", F.lit(0))))


@query(f"WITH {_CO} SELECT CAST(v1 AS INTEGER) AS i, CAST(coalesce(v2, v1) AS INTEGER) AS j, {R('v / sum(v) OVER ()')} AS share FROM v")
def interaction_matrix(spark, sf_dir):
    m = sensitivity.strength_matrix(_LAY, _coefficients(spark, sf_dir))
    return make(spark, [(i + 1, j + 1, round(float(m[i, j]), 6)) for i in range(3) for j in range(i, 3)], "i int, j int, share double")


_F1 = f"{W(fourier_sql('x1', 1))}, c AS (SELECT max(w) FILTER (WHERE i = 0) AS a, max(w) FILTER (WHERE i = 1) AS b, max(w) FILTER (WHERE i = 2) AS c FROM w)"


@query(f"WITH {_F1} SELECT CAST(f AS INTEGER) AS frequency, {R('CASE f WHEN 0 THEN a * a / 12 - a * c / (2 * pi()) ELSE 0.5 * (b * b + c * c) - a * c / (2 * pi()) END')} AS variance FROM c, (SELECT unnest(range(0, 2)) AS f)")
def frequency_shares(spark, sf_dir):
    lay = Layout.build(["x1"], 1)
    got = sensitivity.frequencies(lay, projections(spark, sf_dir, lay), 0)
    return make(spark, [(r["frequency"], round(r["variance"], 6)) for r in got], "frequency int, variance double")


@query(f"WITH {P}, f AS (SELECT 2 * (2 * x1 - 1) AS a, 3 * (2 * x2 - 1) AS b, (2 * x1 - 1) * (2 * x3 - 1) AS c FROM p), l AS (UNPIVOT (SELECT a, b, c, a + b + c AS t FROM f) ON a, b, c INTO NAME component VALUE v) SELECT component, {R('covar_pop(v, t)')} AS covariance, {R('covar_pop(v, t) / var_pop(t)')} AS share FROM l GROUP BY component")
def correlative_shares(spark, sf_dir):
    z = lambda c: 2 * F.col(c) - 1
    return tidy(diagnostics.component_covariances(planted(spark, sf_dir), {"a": 2 * z("x1"), "b": 3 * z("x2"), "c": z("x1") * z("x3")}))


@query(f"WITH {P}, f AS (SELECT 2 * (2 * x1 - 1) AS g, (2 * x1 - 1) * (2 * x3 - 1) AS r FROM p) SELECT {R('4 / 3.0::DOUBLE / (4 / 3.0 + var_pop(r))')} AS fidelity, {R('2 * covar_pop(g, r) / (4 / 3.0 + var_pop(r) + 2 * covar_pop(g, r))')} AS defect FROM f")
def fidelity(spark, sf_dir):
    z = lambda c: 2 * F.col(c) - 1
    core = sensitivity.block_variances(Layout.build(["x1"], 1, basis="legendre"), np.array([2.0])).sum()
    d = planted(spark, sf_dir).select((2 * z("x1")).alias("g"), (z("x1") * z("x3")).alias("r"))
    v, c = F.var_pop("r"), F.covar_pop("g", "r")
    return tidy(d.agg((F.lit(core) / (F.lit(core) + v)).alias("fidelity"), (2 * c / (F.lit(core) + v + 2 * c)).alias("defect")))


# --- prediction and components -----------------------------------------------------------------------------

_FIX = Layout.build(["x1", "x2"], 1)
_FW = np.array([0.5, 3.0, -1.0, 2.0, 0.25, 0.75])
_FP = "1.5 + 0.5 * (x1 - 0.5) + 3 * cos(2 * pi() * x1) - sin(2 * pi() * x1) + 2 * (x2 - 0.5) + 0.25 * cos(2 * pi() * x2) + 0.75 * sin(2 * pi() * x2)"


@query(f"WITH {P} SELECT k, {R(_FP)} AS yhat, {R('exp(least(greatest(-1 + 2 * (x2 - 0.5) + 0.5 * cos(2 * pi() * x2), -30), 30))')} AS sigma2 FROM p")
def predict_rows(spark, sf_dir):
    d = rows.predict(planted(spark, sf_dir), _FIX, _FW, 1.5)
    part = variance.LogVariance(Layout.build(["x2"], 1), np.array([2.0, 0.5, 0.0]), -1.0, np.eye(1), np.eye(1), 0.0, 0)
    return d.select("k", rd(F.col("prediction")).alias("yhat"), rd(F.exp(part.column())).alias("sigma2"))


@query(f"WITH {_T1}, z AS (SELECT q.k, m.m + t.w * q.f AS yhat, rss / (n - 2 * df + df * df) AS s2, q.f * q.f / (t.c + 2) AS h FROM q, t, m) SELECT k, {R('yhat')} AS yhat, {R('yhat - 1.959963984540054 * sqrt(s2 + s2 * h)', 4)} AS lo, {R('yhat + 1.959963984540054 * sqrt(s2 + s2 * h)', 4)} AS hi FROM z")
def predict_interval(spark, sf_dir):
    s, f = _solve1(spark, sf_dir)
    d = rows.intervals(planted(spark, sf_dir), _COS, f.w, s.mean, f.inverse, f.sigma2)
    return d.select("k", rd(F.col("prediction")).alias("yhat"), rd(F.col("lo"), 4).alias("lo"), rd(F.col("hi"), 4).alias("hi"))


@query(f"WITH {_F1} SELECT k, {R('a * (x1 - 0.5) + b * cos(2 * pi() * x1) + c * sin(2 * pi() * x1)')} AS f FROM p, c")
def component_curve(spark, sf_dir):
    """A main effect along its variable, at every row."""
    lay = Layout.build(["x1"], 1)
    w = projections(spark, sf_dir, lay)
    return planted(spark, sf_dir).select("k", rd(rows.linear(lay.columns(), w)).alias("f"))


@query(f"WITH {_CO} SELECT k, {R('(SELECT w FROM v WHERE term = 4) * (2 * x1 - 1) * (2 * x3 - 1)')} AS f FROM p")
def pair_surface(spark, sf_dir):
    """An interaction over the plane of its variables, at every row."""
    w = _coefficients(spark, sf_dir)[_LAY.block(4)]
    return planted(spark, sf_dir).select("k", rd(rows.linear(_LAY.select([4])[0].columns(), w)).alias("f"))


@query(f"WITH {P} SELECT k, {R('0.5 * (x1 - 0.5) + 3 * cos(2 * pi() * x1) - sin(2 * pi() * x1)')} AS c1, {R('2 * (x2 - 0.5) + 0.25 * cos(2 * pi() * x2) + 0.75 * sin(2 * pi() * x2)')} AS c2 FROM p")
def contributions(spark, sf_dir):
    cols = _FIX.columns()
    return planted(spark, sf_dir).select("k", rd(rows.linear(cols[:3], _FW[:3])).alias("c1"), rd(rows.linear(cols[3:], _FW[3:])).alias("c2"))


# --- diagnostics -------------------------------------------------------------------------------------------

_Z = f"{P}, z AS (SELECT k, x1, x2, x3, y, 3 * cos(2 * pi() * x1) + 0.1 AS f, exp(x2 - 1) AS s2, y - 3 * cos(2 * pi() * x1) - 0.1 AS r FROM p)"


def _z(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("f", 3 * F.cos(PI2 * F.col("x1")) + 0.1).withColumn("s2", F.exp(F.col("x2") - 1))
    return d.withColumn("r", F.col("y") - 3 * F.cos(PI2 * F.col("x1")) - 0.1)


@query(f"WITH {_Z} SELECT {R('1 - var_pop(r) / var_pop(y)')} AS explained, {R('1 - sum(r * r) / (var_pop(y) * count(*))')} AS r2 FROM z")
def r2_both(spark, sf_dir):
    return tidy(diagnostics.r_squared(_z(spark, sf_dir), F.col("y"), F.col("f")))


@query(f"WITH {_Z} SELECT {R('avg(0.5 * ln(s2) + 0.5 * r * r / s2)')} AS nll, {R('avg(0.5 * ln(0.3) + 0.5 * r * r / 0.3)')} AS nll_constant FROM z")
def gaussian_nll(spark, sf_dir):
    return tidy(_z(spark, sf_dir).agg(diagnostics.gaussian_nll(F.col("r"), F.col("s2")).alias("nll"), diagnostics.gaussian_nll(F.col("r"), F.lit(0.3)).alias("nll_constant")))


@query(f"WITH {_Z}, c AS (SELECT r / sqrt(s2) AS z FROM z), m AS (SELECT avg(z) AS m, var_pop(z) AS v FROM c) SELECT {R('any_value(m)')} AS mean, {R('any_value(v)')} AS variance, {R('avg(pow(z - m, 3)) / pow(any_value(v), 1.5)')} AS skew, {R('avg(pow(z - m, 4)) / pow(any_value(v), 2) - 3')} AS excess_kurtosis, " + ", ".join(f"{R(f'avg(CASE WHEN abs(z) <= {q} THEN 1.0 ELSE 0.0 END)')} AS cover{p}" for p, q in ((50, 0.6744897501960817), (90, 1.6448536269514715), (95, 1.9599639845400536), (99, 2.575829303548901))) + " FROM c, m")
def calibration(spark, sf_dir):
    return tidy(diagnostics.calibration(_z(spark, sf_dir), F.col("r"), F.col("s2")))


@query(f"WITH {_Z}, c AS (SELECT 'linear' AS kind, 1 AS v1, NULL AS v2, corr(r, x1) AS r FROM z" + "".join(f" UNION ALL SELECT '{k}', {i}, NULL, corr({e}, x{i}) FROM z" for k, e in (("linear", "r"), ("square", "r * r")) for i in (1, 2, 3) if (k, i) != ("linear", 1)) + "".join(f" UNION ALL SELECT 'pair', {i}, {j}, corr(r, (x{i} - 0.5) * (x{j} - 0.5)) FROM z" for i, j in ((1, 2), (1, 3), (2, 3))) + f") SELECT kind, CAST(v1 AS INTEGER) AS v1, CAST(coalesce(v2, 0) AS INTEGER) AS v2, {R('r')} AS r FROM c")
def residual_correlations(spark, sf_dir):
    return tidy(diagnostics.residual_correlations(_z(spark, sf_dir), ["x1", "x2", "x3"], "r").withColumn("v2", F.coalesce("v2", F.lit(0))))


@query(f"WITH {_Z}, c AS (SELECT 1 AS i, 2 AS j, corr(r, (x1 - 0.5) * (x2 - 0.5)) AS r FROM z UNION ALL SELECT 1, 3, corr(r, (x1 - 0.5) * (x3 - 0.5)) FROM z UNION ALL SELECT 2, 3, corr(r, (x2 - 0.5) * (x3 - 0.5)) FROM z) SELECT CAST(i AS INTEGER) AS v1, CAST(j AS INTEGER) AS v2, {R('r')} AS r FROM c ORDER BY abs(c.r) DESC LIMIT 1")
def top_residual_pair(spark, sf_dir):
    d = diagnostics.residual_correlations(_z(spark, sf_dir), ["x1", "x2", "x3"], "r").filter("kind = 'pair'")
    return tidy(d.orderBy(F.abs("r").desc(), "v1", "v2").limit(1).select("v1", "v2", "r"))


@query(f"WITH {_Z} SELECT 1 - (1 - var_pop(r) / var_pop(y)) > 0.01 AS interactions, greatest(abs(corr(r * r, x1)), abs(corr(r * r, x2)), abs(corr(r * r, x3))) > 0.1 AS noise FROM z")
def stage_rule(spark, sf_dir):
    d = _z(spark, sf_dir)
    e = diagnostics.r_squared(d, F.col("y"), F.col("f")).head()["explained"]
    c = diagnostics.residual_correlations(d, ["x1", "x2", "x3"], "r").filter("kind = 'square'").agg(F.max(F.abs("r"))).head()[0]
    got = diagnostics.next_stages(e, c)
    return make(spark, [("B" in got, "D" in got)], "interactions boolean, noise boolean")


@query(f"WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_discount) AS b, corr(l_extendedprice, l_discount) AS c FROM lineitem), l AS (SELECT n, 1 AS v1, 2 AS v2, a AS r FROM c UNION ALL SELECT n, 1, 3, b FROM c UNION ALL SELECT n, 2, 3, c FROM c) SELECT CAST(v1 AS INTEGER) AS v1, CAST(v2 AS INTEGER) AS v2, {R('r')} AS r, {R('r * sqrt((n - 2) / (1 - r * r))', 4)} AS t FROM l")
def correlation_test(spark, sf_dir):
    d = diagnostics.correlation_test(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return d.select("v1", "v2", rd(F.col("r")).alias("r"), rd(F.col("t"), 4).alias("t"))


@query(f"""WITH p AS (SELECT s_suppkey AS k, CAST(s_nationkey AS DOUBLE) AS x, s_acctbal AS y FROM supplier), d AS (SELECT a.k AS i, b.k AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM p a, p b), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
m AS (SELECT i, sum(a) AS a, sum(b) AS b FROM d GROUP BY i), g AS (SELECT sum(a) AS a, sum(b) AS b FROM d),
u AS (SELECT d.a - (p.a + q.a) / (n - 2) + g.a / ((n - 1) * (n - 2)) AS a, d.b - (p.b + q.b) / (n - 2) + g.b / ((n - 1) * (n - 2)) AS b FROM d JOIN m p ON p.i = d.i JOIN m q ON q.i = d.j, g, n WHERE d.i <> d.j)
SELECT {R('sum(a * b) / sqrt(sum(a * a) * sum(b * b))')} AS dcor FROM u""")
def distance_correlation(spark, sf_dir):
    return make(spark, [(round(diagnostics.pair_dependence(table(spark, sf_dir, "supplier"), "s_nationkey", "s_acctbal"), 6),)], "dcor double")


@query(f"WITH g AS (SELECT var_pop(l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax) SELECT {R('sum(v * n) FILTER (WHERE n > 1) / sum(n - 1) FILTER (WHERE n > 1)', 2)} AS sigma2, count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS rows, count(*) FILTER (WHERE n > 1) >= 5 AND sum(n) FILTER (WHERE n > 1) >= 0.05 * sum(n) AS usable FROM g")
def replicate_variance(spark, sf_dir):
    return tidy(diagnostics.replicate_noise(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), 2)


@query(f"""WITH m AS (SELECT avg(s_acctbal) AS m, stddev_pop(s_acctbal) AS s FROM supplier), p AS (SELECT s_suppkey AS k, (s_acctbal - m) / s AS z, CAST(s_nationkey AS DOUBLE) AS y FROM supplier, m),
d AS (SELECT a.k, min({{'d': pow(a.z - b.z, 2), 'k': b.k, 'e': a.y - b.y}}) AS n FROM p a JOIN p b ON a.k <> b.k GROUP BY a.k) SELECT {R('avg(pow(n.e, 2)) / 2')} AS sigma2, count(*) AS rows FROM d""")
def neighbour_variance(spark, sf_dir):
    return tidy(diagnostics.neighbour_noise(table(spark, sf_dir, "supplier"), ["s_acctbal"], "s_nationkey", "s_suppkey", cells=4))


@query(f"WITH {_Z} SELECT {R('sqrt(avg(r * r))')} AS rmse_observed, {R('sqrt(avg(pow(x1 - f, 2)))')} AS rmse_true, {R('1 - sum(r * r) / (var_pop(y) * count(*))')} AS r2_observed, {R('1 - sum(pow(x1 - f, 2)) / (var_pop(x1) * count(*))', 3)} AS r2_true, {R('avg(0.5 * ln(2 * pi() * s2 * s2) + r * r / (2 * s2 * s2))')} AS nll, {R('avg(CASE WHEN abs(r) <= 1.6449 * s2 THEN 1.0 ELSE 0.0 END)')} AS cover90, {R('avg(CASE WHEN abs(r) <= 1.96 * s2 THEN 1.0 ELSE 0.0 END)')} AS cover95, {R('corr(s2, x3)')} AS sigma_corr FROM z")
def score_predictions(spark, sf_dir):
    d = diagnostics.score_predictions(_z(spark, sf_dir).withColumnRenamed("x1", "truth").withColumn("pred", F.col("y") - F.col("r")).drop("f").withColumnRenamed("pred", "f"), "y", "truth", "f", "s2", "x3")
    return tidy(d.withColumn("r2_true", rd(F.col("r2_true"), 3)))


# --- discovery, complements, generators --------------------------------------------------------------------


@query(f"WITH {P}, q AS (SELECT (2 * x1 - 1) * (2 * x3 - 1) AS f, y FROM p), s AS (SELECT count(*) AS n, sum(f * f) * (1 + 1e-8) AS c, sum(f * f) AS c0, sum(f) AS s, sum(f * y) AS b, var_pop(y) AS v FROM q) SELECT {R('greatest((pow(b / c, 2) * c0 / n - pow(b / c * s / n, 2)) / v - 1 / n::DOUBLE, 0)')} AS score FROM s")
def projection_score(spark, sf_dir):
    lay = Layout(("x1", "x3"), (Term((0, 1), (Spec(1, "legendre"),) * 2),))
    s = discovery.block_stats(planted(spark, sf_dir), {"a": lay}, "y")["a"]
    return make(spark, [(round(discovery.projection_score(s), 6),)], "score double")


@query()
def pair_scan(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("r", F.col("y") - 3 * F.cos(PI2 * F.col("x1")) - 2 * (F.col("x2") - 0.5))
    got = discovery.scan(d, ["x1", "x2", "x3"], "r")
    return make(spark, [(r["vars"][0] + 1, r["vars"][1] + 1, round(r["score"], 6), r["flagged"]) for r in got], "v1 int, v2 int, score double, flagged boolean")


@query(f"WITH {P}, c AS (SELECT CAST(least(floor(x1 * 8), 7) AS INTEGER) AS cell, avg(y) AS m, count(*) AS n FROM p GROUP BY 1) SELECT cell, n, {R('m')} AS m FROM c")
def haar_cells(spark, sf_dir):
    d = planted(spark, sf_dir)
    return d.groupBy(F.least(F.floor(F.col("x1") * 8), F.lit(7)).cast("int").alias("cell")).agg(F.count("*").alias("n"), rd(F.avg("y")).alias("m"))


_ENERGY = [f for x in ("x1", "x2", "x3") for f in (legendre_sql(x, 1)[0], f"cos(2 * pi() * {x})", haar_sql(x, 1)[0])]


@query(f"WITH {W(_ENERGY)}, e AS (SELECT i // 3 AS i, sum(w * w) FILTER (WHERE i % 3 = 0) AS l, sum(w * w) FILTER (WHERE i % 3 = 1) AS f, sum(w * w) FILTER (WHERE i % 3 = 2) AS h FROM w GROUP BY 1) SELECT i, CASE WHEN l + f + h < 1e-3 THEN 'none' WHEN h > 0.3 * (l + f + h) THEN CASE WHEN l > h THEN 'legendre+haar' ELSE 'haar' END WHEN f > 0.2 * (l + f) THEN 'fourier' ELSE 'legendre' END AS basis FROM e")
def basis_recommendation(spark, sf_dir):
    """What the energies of each variable's linear, cosine and step function in the target suggest."""
    names = ["x1", "x2", "x3"]
    legendre, fourier, haar = (projections(spark, sf_dir, lay) ** 2 for lay in (Layout.build(names, 1, basis="legendre"), Layout.build(names, 1, linear=False), Layout.build(names, 1, basis="haar")))
    return make(spark, [(i, discovery.recommend_basis(float(legendre[i]), float(fourier[2 * i]), float(haar[i]))) for i in range(3)], "i int, basis string")


_D2 = "pow(x1 - 0.25, 2) + pow(x2 - 0.75, 2)"
_KER = {"rbf": f"exp(-({_D2}) / (2 * 0.09))", "matern32": f"(1 + sqrt(3) * sqrt({_D2}) / 0.3) * exp(-sqrt(3) * sqrt({_D2}) / 0.3)", "matern52": f"(1 + sqrt(5) * sqrt({_D2}) / 0.3 + 5 / 3.0::DOUBLE * ({_D2}) / 0.09) * exp(-sqrt(5) * sqrt({_D2}) / 0.3)"}


@query(f"WITH {P} SELECT k, " + ", ".join(f"{R(v)} AS {n}" for n, v in _KER.items()) + " FROM p")
def kernel_features(spark, sf_dir):
    x = [F.col("x1"), F.col("x2")]
    return planted(spark, sf_dir).select("k", *[rd(residual.kernel_column(x, (0.25, 0.75), 0.3, k)).alias(k) for k in residual.KERNELS])


@query(f"WITH {P} SELECT k, {R('sqrt(2 / 1.0::DOUBLE) * cos(1.5 * x1 - 2 * x2 + 0.7)')} AS z FROM p")
def random_fourier_feature(spark, sf_dir):
    f = residual.Features("rff", np.array([[1.5, -2.0]]), 1.0, np.array([0.7]))
    return planted(spark, sf_dir).select("k", rd(f.columns([F.col("x1"), F.col("x2")])[0]).alias("z"))


@query("SELECT 0.0::DOUBLE AS largest")
def projection_orthogonality(spark, sf_dir):
    """Complement features less their projection are orthogonal to the design."""
    lay = Layout.build(["x1", "x2"], 2)
    joint = residual.Joint(lay, residual.Features.rbf(np.array([[0.2, 0.3], [0.7, 0.6], [0.5, 0.9]]), 0.3))
    s = stats_pass(planted(spark, sf_dir), joint, "y")[None]
    f = lay.size
    p = residual.projection(s, f, 1e-12)
    return make(spark, [(round(float(np.abs(s.c[:f, f:] - s.c[:f, :f] @ p).max()) / s.n, 6),)], "largest double")


def _ids(spark, sf_dir):
    """The keys of orders, as the rows of a benchmark."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def _gen(d, sql_y):
    a = synthetic.steps(d)
    cols = ", ".join(f"(i + 1) * {repr(s)}::DOUBLE - floor((i + 1) * {repr(s)}::DOUBLE) AS x{k + 1}" for k, s in enumerate(a))
    return f"WITH g AS (SELECT i, {cols} FROM (SELECT o_orderkey AS i FROM orders)) SELECT i, {R(sql_y)} AS y FROM g"


@query(_gen(5, "10 * sin(pi() * x1 * x2) + 20 * pow(x3 - 0.5, 2) + 10 * x4 + 5 * x5"))
def generate_friedman1(spark, sf_dir):
    return tidy(synthetic.friedman1(spark, _ids(spark, sf_dir), 5, 0.0).select("i", "y"))


@query(_gen(3, "sin((2 * x1 - 1) * pi()) + 7 * pow(sin((2 * x2 - 1) * pi()), 2) + 0.1 * pow((2 * x3 - 1) * pi(), 4) * sin((2 * x1 - 1) * pi())"))
def generate_ishigami(spark, sf_dir):
    return tidy(synthetic.ishigami(spark, _ids(spark, sf_dir)).select("i", "y"))


@query(_gen(4, "(abs(4 * x1 - 2) / 1) * ((abs(4 * x2 - 2) + 1) / 2) * ((abs(4 * x3 - 2) + 4.5) / 5.5) * ((abs(4 * x4 - 2) + 9) / 10)"))
def generate_g_function(spark, sf_dir):
    return tidy(synthetic.g_function(spark, _ids(spark, sf_dir), (0, 1, 4.5, 9)).select("i", "y"))


@query(_gen(20, " + ".join(f"{20.0 if k <= 4 else 5.0 / k!r} * (x{k} - 0.5)" for k in range(1, 11)) + "".join(f" - 15 * (x{i} - 0.5) * (x{j} - 0.5)" for i in range(1, 5) for j in range(i + 1, 5))))
def generate_morris(spark, sf_dir):
    return tidy(synthetic.morris(spark, _ids(spark, sf_dir)).select("i", "y"))


_MEANS = {
    "linear": (5, "5 * (x1 - 0.5) + 3 * (x2 - 0.5)"),
    "harmonic": (5, "3 * cos(2 * pi() * x1) + 2 * sin(4 * pi() * x2)"),
    "cross_term": (3, "4 * (x1 - 0.5) + 2 * sin(2 * pi() * x1)"),
    "pair_only": (5, "3 * (x1 - 0.5) * (x2 - 0.5)"),
    "mixed": (8, "3 * cos(2 * pi() * x1) + 2 * sin(4 * pi() * x2) + 1.5 * cos(2 * pi() * x3) * cos(2 * pi() * x4) + 4 * (x5 - 0.5)"),
    "apart": (6, "5 * (x1 - 0.5) + 3 * cos(2 * pi() * x2)"),
    "triple": (6, "2 * sin(2 * pi() * x1) + sin(2 * pi() * x2) * sin(2 * pi() * x3) + 1.5 * sin(2 * pi() * x1) * sin(2 * pi() * x2) * sin(2 * pi() * x3)"),
}
for _n, (_d, _m) in _MEANS.items():
    query(_gen(_d, _m), f"generate_{_n}")(lambda spark, sf_dir, n=_n: tidy(synthetic.catalogue(spark, n, _ids(spark, sf_dir)).select("i", F.col("truth").alias("y"))))


_ISH = "SELECT sin((2 * x1 - 1) * pi()) * (1 + 0.1 * pow(pi(), 4) / 5) AS m1, 7 * pow(sin((2 * x2 - 1) * pi()), 2) AS m2, sin((2 * x1 - 1) * pi()) + 7 * pow(sin((2 * x2 - 1) * pi()), 2) + 0.1 * pow((2 * x3 - 1) * pi(), 4) * sin((2 * x1 - 1) * pi()) AS y FROM g"


@query(_gen(3, "0").split("SELECT i, round")[0] + f", y AS ({_ISH}), c AS (SELECT 0.5 * pow(1 + 0.1 * pow(pi(), 4) / 5, 2) AS a, 49 / 8.0::DOUBLE AS b, 8 * 0.01 * pow(pi(), 8) / 225 AS c) SELECT {R('var_pop(m1) / (any_value(a) + any_value(b) + any_value(c)) - any_value(a) / (any_value(a) + any_value(b) + any_value(c))')} AS d1, {R('var_pop(m2) / (any_value(a) + any_value(b) + any_value(c)) - any_value(b) / (any_value(a) + any_value(b) + any_value(c))')} AS d2, {R('var_pop(y) / (any_value(a) + any_value(b) + any_value(c)) - 1')} AS d FROM y, c")
def truth_ishigami(spark, sf_dir):
    """How far the variances over the table's rows are from the known ones, as shares: two main effects, and the whole."""
    t = synthetic.ishigami_truth()
    d = synthetic.ishigami(spark, _ids(spark, sf_dir))
    mains = F.sin("x1") * (1 + 0.1 * math.pi**4 / 5), 7 * F.pow(F.sin("x2"), 2)
    v = t["variance"]
    return tidy(d.agg((F.var_pop(mains[0]) / v - t["first"][0]).alias("d1"), (F.var_pop(mains[1]) / v - t["first"][1]).alias("d2"), (F.var_pop("y") / v - 1).alias("d")))


@query(_gen(4, "0").split("SELECT i, round")[0] + f", m AS (SELECT unnest([abs(4 * x1 - 2), (abs(4 * x2 - 2) + 1) / 2, (abs(4 * x3 - 2) + 4.5) / 5.5, (abs(4 * x4 - 2) + 9) / 10]) AS m, unnest([0, 1, 2, 3]) AS i FROM g), a AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i), v AS (SELECT i, 1 / (3 * pow(1 + [0, 1, 4.5, 9][i + 1], 2))::DOUBLE AS v FROM a), w AS (SELECT product(1 + v) - 1 AS w FROM v) SELECT CAST(m.i AS INTEGER) AS i, {R('(var_pop(m) - any_value(v)) / any_value(w)')} AS d FROM m JOIN v ON v.i = m.i, w GROUP BY m.i")
def truth_g_function(spark, sf_dir):
    """The same for each factor of the G function."""
    a = (0, 1, 4.5, 9)
    t = synthetic.g_truth(a)
    d = synthetic.inputs(spark, _ids(spark, sf_dir), 4).agg(*[F.var_pop((F.abs(4 * F.col(f"x{k + 1}") - 2) + float(c)) / (1 + float(c))).alias(f"v{k}") for k, c in enumerate(a)])
    cells = F.array(*[F.struct(F.lit(k).alias("i"), (F.col(f"v{k}") / t["variance"] - t["first"][k]).alias("d")) for k in range(4)])
    return tidy(d.select(F.explode(cells).alias("s")).select("s.*"))


# --- fits and iterations -----------------------------------------------------------------------------------


@query()
def fit_components(spark, sf_dir):
    """The flagship: which variables and pairs drive the planted target, with intervals."""
    d = planted(spark, sf_dir).select("x1", "x2", "x3", "y")
    return tidy(fit(d, "y", uniform=True, k1=3, k2=1, stages=("A", "B"), strategy="curvature").components())


@query()
def fit_diagnostics(spark, sf_dir):
    d = planted(spark, sf_dir).select("x1", "x2", "x3", "y")
    return tidy(fit(d, "y", uniform=True, k1=3, k2=1, stages=("A", "B"), criterion="gcv").diagnostics())


@query()
def fit_predictions(spark, sf_dir):
    d = planted(spark, sf_dir)
    f = fit(d.select("x1", "x2", "x3", "y"), "y", uniform=True, k1=3, k2=1, stages=("A", "B"))
    return tidy(f.predict(d).select("k", "prediction", "lo", "hi"), 4)


@query()
def stability_folds(spark, sf_dir):
    lay = Layout.build(["x1", "x2", "x3"], 2)
    f = stats_pass(planted(spark, sf_dir), lay, "y", by="fold")
    got = rows.stability(f, lay, lay.penalty(1e-3))
    return make(spark, [(k, *map(lambda v: round(float(v), 6), s), got["grade"]) for k, s in enumerate(got["shares"])], "fold int, s1 double, s2 double, s3 double, grade string")


@query()
def noise_complexity(spark, sf_dir):
    lay = Layout.build(["x1", "x2", "x3"], 3)
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    return make(spark, [tuple(round(p[c], 6) for c in ("lambda", "df", "sigma2", "gcv")) for p in ridge.path(s, lay.penalty(1.0), np.logspace(-4, 4, 17))], "lambda double, df double, sigma2 double, gcv double")


@query("SELECT CAST(i AS INTEGER) AS i, 0.0::DOUBLE AS gradient FROM (SELECT unnest(range(0, 4)) AS i)")
def newton_stationarity(spark, sf_dir):
    """The gradient of a converged log-variance fit, per row: zero."""
    d = _z(spark, sf_dir).withColumn("r2", F.col("r") ** 2)
    lay = Layout.build(["x2"], 1)
    pen = lay.penalty(1.0)
    part = variance.newton(d, lay, "r2", pen, steps=40, tol=1e-13)
    h = F.exp(-part.column())
    cols = [F.lit(1.0), *lay.columns()]
    row = d.agg(F.count("*").alias("n"), *[F.sum(c * 0.5 * (1 - F.col("r2") * h)).alias(f"g{i}") for i, c in enumerate(cols)]).head()
    add = np.append(0.0, pen * part.w)
    return make(spark, [(i, round((row[f"g{i}"] + add[i]) / row["n"], 5) + 0.0) for i in range(4)], "i int, gradient double")


@query()
def heteroscedastic_fit(spark, sf_dir):
    d = synthetic.catalogue(spark, "apart", _ids(spark, sf_dir)).withColumn("split", F.when(F.col("i") % 5 < 4, "train").otherwise("val"))
    names = [f"x{k}" for k in range(1, 7)]
    m, v = Layout.build(names, 2), Layout.build(["x3"], 1)
    got = variance.heteroscedastic(d, m, v, "y", m.penalty(1e-3, "curvature"), v.penalty(1.0, "curvature"), "split", rounds=3)
    return make(spark, [(got.kept, round(got.nll["constant_same_mean"], 4), round(got.nll["input"], 4), round(float(got.variance.w[0]), 2))], "kept boolean, nll_constant double, nll_input double, slope double")


@query()
def variance_path(spark, sf_dir):
    d = _z(spark, sf_dir).withColumn("r2", F.col("r") ** 2)
    lay = Layout.build(["x2"], 1)
    got = variance.variance_path(d, lay, "r2", lay.penalty(1.0), [1e-1, 1e1, 1e3])
    return make(spark, [(r["lambda"], round(r["objective"], 3), round(r["df"], 3)) for r in got], "lambda double, objective double, df double")


@query()
def joint_loo(spark, sf_dir):
    d, f = _leveraged(spark, sf_dir)
    d = d.withColumn("r2", F.col("residual") ** 2)
    lay = Layout.build(["x2"], 1)
    part = variance.newton(d, lay, "r2", lay.penalty(1.0))
    got = variance.one_step_loo(d.select("k", "x2", "residual", "leverage"), lay, part, "residual", "leverage")
    return tidy(got.agg(F.avg("loo_nll").alias("loo_nll"), F.count("*").alias("n")), 5)


@query()
def basis_shares(spark, sf_dir):
    got = discovery.basis_shares(planted(spark, sf_dir), ["x1", "x2", "x3"], "y")
    return make(spark, [(r["variable"], *(round(r[b], 5) for b in ("legendre", "fourier", "haar")), r["recommend"]) for r in got], "variable string, legendre double, fourier double, haar double, recommend string")


@query()
def basis_comparison(spark, sf_dir):
    got = discovery.compare_bases(planted(spark, sf_dir), ["x1", "x2", "x3"], "y")
    return make(spark, [(r["basis"], r["columns"], round(r["explained"], 5), round(r["bic"], 2)) for r in got], "basis string, columns int, explained double, bic double")


@query()
def residual_sieve(spark, sf_dir):
    d = planted(spark, sf_dir).withColumn("r", F.col("y") - 3 * F.cos(PI2 * F.col("x1")) - 2 * (F.col("x2") - 0.5))
    got = discovery.sieve(d, ["x1", "x2", "x3"], "r")
    out = [(n, ",".join(str(v + 1) for v in r["vars"]), round(r["score"], 5)) for n in ("pairs", "triples") for r in got[n]]
    return make(spark, out, "part string, vars string, score double")


@query()
def pair_discovery(spark, sf_dir):
    got = discovery.discover_pairs(planted(spark, sf_dir), ["x1", "x2", "x3"], "y", k1=2, k2=1, rounds=2)
    return make(spark, [(r["round"], str(r["pairs"]), round(r["mse"], 5)) for r in got], "round int, pairs string, mse double")


@query()
def complement_fit(spark, sf_dir):
    """An RBF complement of main effects, and what of it the mean takes back."""
    d = planted(spark, sf_dir)
    lay = Layout.build(["x1", "x2", "x3"], 2)
    s = stats_pass(d, lay, "y")[None]
    f = ridge.solve(s.centred(), lay.penalty(1e-3))
    c = residual.fit_complement(d, lay, residual.Features.random_fourier(3, 20, 0.3), "y", f.w, s.mean, 1e-2)
    move, _ = residual.redecompose(c, 4096)
    j = stats_pass(d, c.joint, "y")[None].centred(s.mean)
    return make(spark, [(round(f.mse, 5), round(j.rss(c.joint_w) / j.n, 5), round(float(np.abs(move).max()), 4))], "mse_mean double, mse_both double, largest_move double")


@query(f"WITH s AS (SELECT CAST(ts AS DATE) AS day, 2 * (epoch(ts) / 86400 - floor(epoch(ts) / 86400)) - 1 AS f, value AS y FROM events), m AS (SELECT day, avg(y) AS m FROM s GROUP BY day), t AS (SELECT s.day, count(*) AS n, sum(f * (y - m)) AS b, sum(f * f) AS c, any_value(m) AS m FROM s JOIN m USING (day) GROUP BY s.day) SELECT CAST(day AS VARCHAR) AS day, n, {R('m')} AS mean, {R('b / (c + 2)')} AS w FROM t")
def windowed_fit(spark, sf_dir):
    from varlens.streaming.windowed import fit_windows, with_time

    got = fit_windows(with_time(table(spark, sf_dir, "events"), "ts"), _time_layout(), "value", "window", 2.0)
    return make(spark, [(r["window"][:10], r["n"], round(r["mean"], 6), round(float(r["w"][0]), 6) + 0.0) for r in got], "day string, n long, mean double, w double")


def _time_layout():
    return Layout(("time",), (Term((0,), (Spec(1, "legendre"),)),))


# --- sources and sinks -------------------------------------------------------------------------------------


@query("SELECT c_custkey::DOUBLE AS k, c_acctbal AS y FROM customer WHERE c_custkey % 7 <> 3")
def csv_missing_drop(spark, sf_dir):
    """Customers written as CSV with missing tokens in every seventh row, read back without those rows."""
    from varlens.session import Scratch
    from varlens.sources.numeric_csv import read_numeric_csv

    path = Scratch(spark, "csv").path + "/file"
    tokens = F.element_at(F.array(*[F.lit(t) for t in ("NA", "nan", "null", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.when(F.col("c_custkey") % 7 == 3, tokens).otherwise(F.col("c_acctbal").cast("string")).alias("y"))
    d.coalesce(1).write.option("header", True).csv(path)
    return read_numeric_csv(spark, path)[0]


@query()
def saved_model(spark, sf_dir):
    """A fit saved, loaded and used."""
    from varlens.session import Scratch
    from varlens.sources import model_store

    d = planted(spark, sf_dir)
    f = fit(d.select("x1", "x2", "x3", "y"), "y", k1=3, k2=1, stages=("A", "B"))
    path = Scratch(spark, "model").path + "/m"
    model_store.save(spark, model_store.of_result(f), path, f.penalty)
    return tidy(model_store.load(spark, path).predict(d).select("k", "prediction", "lo", "hi"), 4)


# --- structure ---------------------------------------------------------------------------------------------


@query()
def additivity_shares(spark, sf_dir):
    from varlens.operators.structure import additivity_shares as find

    lay = Layout.build(["x1", "x2", "x3"], 3, 1)
    got = find(stats_pass(planted(spark, sf_dir), lay, "y")[None], lay)
    return make(spark, [(k, round(float(v), 4)) for k, v in enumerate(got["shares"])], "term int, share double")


@query()
def structure_test(spark, sf_dir):
    from varlens.operators.structure import structure_test as test

    lay = Layout.build(["x1", "x2", "x3"], 2)
    got = test(planted(spark, sf_dir), lay, "y", 1e-3, adds=((0, 2), (1, 2)))
    return make(spark, [(r["change"], ",".join(str(v + 1) for v in r["vars"]), round(r["loo_change"], 5), round(r["se"], 5)) for r in got], "change string, vars string, loo_change double, se double")


@query(f"WITH {_LEV}, z AS (SELECT k, e, h, f FROM r) SELECT k, {R('0.5 * ln(2 * pi() * s2) + d * d / (2 * s2)', 3)} AS loo_nll FROM (SELECT z.k, e / (1 - h) AS d, (SELECT rss / (n - 2 * df + df * df) FROM t) AS s2 FROM z)")
def loo_nll_rows(spark, sf_dir):
    """Each row's deleted likelihood at the whole fit's noise."""
    d, f = _leveraged(spark, sf_dir)
    s2 = f.sigma2
    return d.select("k", rd(F.lit(0.5 * math.log(2 * math.pi * s2)) + F.col("loo_residual") ** 2 / (2 * s2), 3).alias("loo_nll"))


@query(f"""WITH {P}, a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y * y) AS yy, sum(2 * x1 - 1) AS s, sum(pow(2 * x1 - 1, 2)) AS c, sum((2 * x1 - 1) * y) AS b FROM p),
dl AS (SELECT k, y, 2 * x1 - 1 AS f, n - 1 AS n, (sy - y) / (n - 1) AS m, c - pow(2 * x1 - 1, 2) AS c, b - (2 * x1 - 1) * y - (sy - y) / (n - 1) * (s - (2 * x1 - 1)) AS b, yy - y * y - pow(sy - y, 2) / (n - 1) AS yy FROM p, a),
w AS (SELECT k, y - m - b / (c + 2) * f AS e, (yy - 2 * b * b / (c + 2) + c * pow(b / (c + 2), 2)) / (n - 2 * c / (c + 2) + pow(c / (c + 2), 2)) AS s2 FROM dl) SELECT k, {R('0.5 * ln(2 * pi() * s2) + e * e / (2 * s2)', 4)} AS loo_nll FROM w""")
def exact_loo(spark, sf_dir):
    from varlens.operators.structure import exact_loo as loo

    d = planted(spark, sf_dir)
    return tidy(loo(d, _COS, "y", np.array([2.0]), "k"), 4)


@query(f"WITH {_T1}, z AS (SELECT q.k, t.w * q.f AS p, rss / (n - 2 * df + df * df) AS s2, q.f * q.f / (t.c + 2) AS h FROM q, t) SELECT k, {R('s2 * h', 9)} AS epistemic, {R('s2')} AS aleatoric FROM z")
def posterior_uncertainty(spark, sf_dir):
    from varlens.operators.structure import uncertainty

    s, f = _solve1(spark, sf_dir)
    d = uncertainty(planted(spark, sf_dir), _COS, f.w, s.mean, f.inverse, f.sigma2)
    return d.select("k", rd(F.col("epistemic"), 9).alias("epistemic"), rd(F.col("aleatoric")).alias("aleatoric"))


# --- accounts and checks -----------------------------------------------------------------------------------


@query(f"WITH {_Z} SELECT {R('var_pop(y)')} AS total, {R('var_pop(f)')} AS explained, {R('var_pop(r)')} AS residual, {R('2 * covar_pop(f, r)')} AS \"cross\", {R('(var_pop(f) + var_pop(r)) / var_pop(y) - 1')} AS additivity_gap FROM z")
def variance_accounting(spark, sf_dir):
    return tidy(diagnostics.variance_accounting(_z(spark, sf_dir), F.col("y"), F.col("f")))


@query(f"""WITH {_Z}, c AS (SELECT CAST(least(floor(x1 * 8), 7) AS INTEGER) AS cell, avg(r) AS m FROM z GROUP BY 1), j AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS scale),
h AS (SELECT scale, cell // (8 >> scale) AS h, sum(m / (8 >> scale)) AS m FROM c, j GROUP BY ALL), w AS (SELECT scale, h // 2 AS w, sum(CASE WHEN h % 2 = 0 THEN m ELSE -m END) AS d FROM h GROUP BY ALL),
e AS (SELECT scale, sum(d * d) / (4 * pow(2, scale - 1)) AS e FROM w GROUP BY scale) SELECT scale, {R('e')} AS e, {R('e / (SELECT var_pop(r) FROM z)')} AS share FROM e""")
def haar_scale_energy(spark, sf_dir):
    return tidy(diagnostics.haar_energy(_z(spark, sf_dir), "x1", "r", 3))


@query(f"""WITH {_Z}, q AS (SELECT r / sqrt(0.5) AS s, r, x1, x2, x3 FROM z), a AS (SELECT abs(avg(s)) AS mean, var_pop(s) AS var, avg(CASE WHEN abs(s) <= 1.959963984540054 THEN 1.0 ELSE 0.0 END) AS cover,
greatest(abs(corr(r, x1)), abs(corr(r, x2)), abs(corr(r, x3))) AS corr, greatest(abs(corr(r * r, x1)), abs(corr(r * r, x2)), abs(corr(r * r, x3))) AS square FROM q)
SELECT 'mean' AS "check", {R('mean')} AS value, mean < 0.05 AS ok FROM a UNION ALL SELECT 'var', {R('var')}, abs(var - 1) < 0.2 FROM a UNION ALL SELECT 'cover', {R('cover')}, abs(cover - 0.95) < 0.03 FROM a
UNION ALL SELECT 'corr', {R('corr')}, corr < 0.1 FROM a UNION ALL SELECT 'square', {R('square')}, square < 0.1 FROM a""")
def model_checks(spark, sf_dir):
    return tidy(diagnostics.verify(_z(spark, sf_dir), ["x1", "x2", "x3"], "y", "r", 0.5))


@query("""WITH t AS (SELECT 'orders' AS name, count(*) AS n, 3 AS d FROM orders UNION ALL SELECT 'lineitem', count(*), 4 FROM lineitem UNION ALL SELECT 'supplier', count(*), 20 FROM supplier),
o(s, a, b) AS (VALUES (0, 1, 0), (1, 2, 0), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 4, 2), (6, 5, 2)),
z AS (SELECT name, n // 10 AS most, s, a, b, d * (2 * a + 1) + CASE WHEN b > 0 THEN d * (d - 1) // 2 * pow(2 * b + 1, 2) ELSE 0 END AS size FROM t, o),
f AS (SELECT name, coalesce(min(s) FILTER (WHERE s > 0 AND size > most), 7) - 1 AS s FROM z GROUP BY name)
SELECT f.name, CAST(a AS INTEGER) AS k1, CAST(b AS INTEGER) AS k2, CAST(size AS INTEGER) AS columns FROM f JOIN z ON z.name = f.name AND z.s = f.s""")
def first_fit_plan(spark, sf_dir):
    """Orders for a first fit of some columns of each table, within a tenth of its rows."""
    from varlens.plans.layout import first_try

    sizes = [(t, table(spark, sf_dir, t).count(), d) for t, d in (("orders", 3), ("lineitem", 4), ("supplier", 20))]
    return make(spark, [(t, (p := first_try(n, d))["k1"], p["k2"], p["columns"]) for t, n, d in sizes], "name string, k1 int, k2 int, columns int")
