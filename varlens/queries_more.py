"""Core queries, third part: spectra of the noise, complements' variance, divergence, paths of shares, and checks of whole fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from varlens.operators import diagnostics, discovery, residual, ridge, selection, sensitivity, structure, variance
from varlens.operators.fit import fit
from varlens.operators.stats import stats_pass
from varlens.plans.layout import Layout
from varlens.queries import P, R, make, planted, query, rd, tidy
from varlens.queries_models import S1, _S2

_Q = ["(2 * x1 - 1)", "(2 * x2 - 1)", "(2 * x1 - 1) * (2 * x2 - 1)"]


@query(f"WITH {P}, q AS (SELECT *, y * y - (SELECT avg(y * y) FROM p) AS z FROM p), c AS (SELECT unnest([0, 1, 2]) AS term, unnest([{', '.join(f'avg(z * {f})' for f in _Q)}]) AS w FROM q), v AS (SELECT term, w * w / CASE WHEN term < 2 THEN 3 ELSE 9 END AS v FROM c) SELECT CAST(term AS INTEGER) AS term, {R('v')} AS variance, {R('v / sum(v) OVER ()')} AS share FROM v")
def noise_shares(spark, sf_dir):
    """The spectrum of a log-variance part, pairs included, with coefficients from the table's squares."""
    lay = Layout.build(["x1", "x2"], 1, 1, basis="legendre")
    s = stats_pass(planted(spark, sf_dir).withColumn("y", F.col("y") ** 2), lay, "y")[None].centred()
    part = variance.LogVariance(lay, s.b / s.n, -1.0, np.eye(4), np.eye(4), 0.0, 0)
    d = sensitivity.components_table(spark, part.layout, part.w, "noise")
    d = d.select(F.when(F.col("ord") == 2, 2).otherwise(F.col("v1") - 1).alias("term"), "variance", F.col("share_core").alias("share"))
    return tidy(d)


@query(f"WITH {P} SELECT {R('4 * var_pop(sqrt(2 / 1.0::DOUBLE) * cos(1.5 * x1 - 2 * x2 + 0.7))')} AS variance FROM p")
def residual_variance_of_rows(spark, sf_dir):
    """A complement's variance over the data, from one pass of statistics."""
    joint = residual.Joint(Layout.build(["x1", "x2"], 1), residual.Features("rff", np.array([[1.5, -2.0]]), 1.0, np.array([0.7])))
    c = residual.Complement(joint, np.zeros((joint.layout.size, 1)), np.array([2.0]), np.zeros(joint.layout.size + 1))
    return make(spark, [(round(residual.complement_variance(c, planted(spark, sf_dir)), 6),)], "variance double")


@query(f"WITH {P}, g AS (SELECT (i + 0.5) / 400 AS x FROM (SELECT unnest(range(0, 400)) AS i)), z AS (SELECT sqrt(2) * cos(1.5 * u.x - 2 * v.x + 0.7) AS z FROM g u, g v) SELECT {R('stddev_pop(z) * (SELECT stddev_pop(y) FROM p)', 2)} AS sd FROM z")
def residual_variance_of_cube(spark, sf_dir):
    """The same under the uniform measure, for a complement as strong as the table's target varies, as a standard deviation:
    Halton points here, a midpoint grid there, to two decimals."""
    joint = residual.Joint(Layout.build(["x1", "x2"], 1), residual.Features("rff", np.array([[1.5, -2.0]]), 1.0, np.array([0.7])))
    size = planted(spark, sf_dir).agg(F.stddev_pop("y")).head()[0]
    c = residual.Complement(joint, np.zeros((joint.layout.size, 1)), np.array([size]), np.zeros(joint.layout.size + 1))
    return make(spark, [(round(math.sqrt(residual.complement_variance(c, points=65536)), 2),)], "sd double")


@query(f"""WITH {P}, f AS (SELECT 2 * (2 * x1 - 1) AS a, 1.5 * (2 * x2 - 1) AS b, (2 * x1 - 1) * (2 * x3 - 1) AS c FROM p), t AS (SELECT a, b, a + b + c AS t FROM f), k AS (SELECT 4 / 3.0::DOUBLE AS a, 0.75::DOUBLE AS b, 1 / 9.0::DOUBLE AS c),
o AS (SELECT 1 AS variable, a / (a + b + c) AS structural, (SELECT covar_pop(a, t) / var_pop(t) FROM t) AS correlative FROM k UNION ALL SELECT 2, b / (a + b + c), (SELECT covar_pop(b, t) / var_pop(t) FROM t) FROM k)
SELECT CAST(variable AS INTEGER) AS variable, {R('structural')} AS structural, {R('correlative')} AS correlative, {R('abs(structural - correlative)')} AS divergence FROM o""")
def structural_divergence(spark, sf_dir):
    lay = Layout.build(["x1", "x2", "x3"], 1, 1, pairs=[(0, 2)], basis="legendre", first=[0, 1])
    return tidy(diagnostics.share_divergence(planted(spark, sf_dir), lay, np.array([2.0, 1.5, 1.0])))


@query(f"""WITH {_S2}, l AS (SELECT CAST(unnest(range(-2, 5)) AS INTEGER) AS e), am AS (SELECT e, a - 2 + pow(10::DOUBLE, e) AS a, c, d - 2 + pow(10::DOUBLE, e) AS d, u, v FROM s, l),
w AS (SELECT e, (d * u - c * v) / (a * d - c * c) AS w1, (a * v - c * u) / (a * d - c * c) AS w2 FROM am), r AS (SELECT e, 0 AS term, w1 * w1 / 3 AS v, w1 * w1 / (w1 * w1 + w2 * w2) AS s FROM w UNION ALL SELECT e, 1, w2 * w2 / 3, w2 * w2 / (w1 * w1 + w2 * w2) FROM w)
SELECT e, CAST(term AS INTEGER) AS term, {R('v')} AS variance, {R('s')} AS share FROM r""")
def lambda_path_shares(spark, sf_dir):
    """Every term's share at every penalty."""
    lay = Layout.build(["x1", "x2"], 1, basis="legendre")
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    got = ridge.path_shares(s, lay, np.ones(2), [10.0**e for e in range(-2, 5)])
    return make(spark, [(round(math.log10(r["lambda"])), r["term"], round(r["variance"], 6), round(r["share"], 6)) for r in got], "e int, term int, variance double, share double")



@query("SELECT CAST(i AS INTEGER) AS step, 0.0::DOUBLE AS violation FROM (SELECT unnest(range(0, 12)) AS i)")
def group_lasso_optimality(spark, sf_dir):
    """The optimality conditions of a fitted group lasso along its path, from the statistics alone: a block at zero has its own
    solution within the threshold; one that is not equals its own solution shrunk by it."""
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    s = stats_pass(planted(spark, sf_dir), lay, "y")[None].centred()
    r, blocks = lay.penalty(1e-6), [lay.block(k) for k in range(len(lay.terms))]
    out = []
    for n, alpha in enumerate(np.logspace(-1, -3, 12)):
        w, worst = selection.group_lasso(s, r, blocks, alpha, tol=1e-12, steps=5000), 0.0
        for b in blocks:
            c, limit = s.c[b, b], alpha * math.sqrt(b.stop - b.start)
            others = w.copy()
            others[b] = 0
            free = np.linalg.solve(c + np.diag(s.n * r[b]), s.b[b] - s.c[b] @ others)
            size = math.sqrt(max(float(free @ c @ free) / s.n, 0.0))
            worst = max(worst, max(size - limit, 0.0) if not w[b].any() else float(np.abs(w[b] - free * (1 - limit / size)).max()))
        out.append((n, round(worst, 5) + 0.0))
    return make(spark, out, "step int, violation double")




def _t975(df):
    """Student's 0.975 quantile for hundreds of degrees of freedom and more: the normal one and two terms of its expansion."""
    z = "1.959963984540054::DOUBLE"
    return f"({z} + (pow({z}, 3) + {z}) / (4 * ({df})) + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({df}, 2)))"


_ONE = f"""{S1}, t AS (SELECT n, c, b / (c + r) AS w, c / (c + r) AS df, yy - 2 * b * b / (c + r) + c * pow(b / (c + r), 2) AS rss, r FROM s, (SELECT 1e-3::DOUBLE / 3 AS r)),
z AS (SELECT q.k, (SELECT avg(y) FROM p) + t.w * q.f AS yhat, rss / (n - 2 * df + df * df) AS s2, {_t975('n - 2 * df + df * df')} AS t, q.f * q.f / (t.c + t.r) AS h FROM q, t)"""


@query(f"WITH {_ONE} SELECT k, {R('yhat')} AS prediction, {R('yhat - t * sqrt(s2 + s2 * h)', 4)} AS lo, {R('yhat + t * sqrt(s2 + s2 * h)', 4)} AS hi FROM z")
def fit_predictions_one(spark, sf_dir):
    """A whole fit of one main effect, predicted for all rows."""
    d = planted(spark, sf_dir)
    f = fit(d.select("x1", "y"), "y", uniform=True, k1=1, k2=0, basis="legendre", stages=("A",))
    return f.predict(d).select("k", rd(F.col("prediction")).alias("prediction"), rd(F.col("lo"), 4).alias("lo"), rd(F.col("hi"), 4).alias("hi"))


@query(f"""WITH {_S2}, g AS (SELECT n, a - 2 + 1e-3 / 3 AS a, c, d - 2 + 1e-3 / 3 AS d, u, v, yy FROM s), w AS (SELECT *, (d * u - c * v) / (a * d - c * c) AS w1, (a * v - c * u) / (a * d - c * c) AS w2, a * d - c * c AS det FROM g),
r AS (SELECT *, a - 1e-3 / 3 AS p, d - 1e-3 / 3 AS q FROM w), f AS (SELECT *, yy - 2 * (w1 * u + w2 * v) + w1 * w1 * p + 2 * w1 * w2 * c + w2 * w2 * q AS rss,
 (d * p - c * c) / det AS m11, (d * c - c * q) / det AS m12, (a * c - c * p) / det AS m21, (a * q - c * c) / det AS m22 FROM r),
k AS (SELECT *, rss / nu AS s2, {_t975('nu')} AS tq FROM (SELECT *, n - 2 * (m11 + m22) + m11 * m11 + 2 * m12 * m21 + m22 * m22 AS nu FROM f)),
e AS (SELECT *, s2 * (m11 * d - m12 * c) / det AS v11, s2 * (m12 * a - m11 * c) / det AS v12, s2 * (m22 * a - m21 * c) / det AS v22, w1 * w1 + w2 * w2 AS t FROM k),
o AS (SELECT 1 AS v1, w1 * w1 / t AS s, sqrt(pow(2 * w1 * w2 * w2 / (t * t), 2) * v11 + 2 * (2 * w1 * w2 * w2 / (t * t)) * (-2 * w1 * w1 * w2 / (t * t)) * v12 + pow(2 * w1 * w1 * w2 / (t * t), 2) * v22) AS se, w1 * w1 / 3 AS v, tq FROM e
UNION ALL SELECT 2, w2 * w2 / t, sqrt(pow(2 * w1 * w2 * w2 / (t * t), 2) * v11 + 2 * (2 * w1 * w2 * w2 / (t * t)) * (-2 * w1 * w1 * w2 / (t * t)) * v12 + pow(2 * w1 * w1 * w2 / (t * t), 2) * v22), w2 * w2 / 3, tq FROM e)
SELECT CAST(v1 AS INTEGER) AS v1, {R('v')} AS variance, {R('s')} AS share_core, {R('greatest(s - tq * se, 0)', 4)} AS lo, {R('least(s + tq * se, 1)', 4)} AS hi FROM o""")
def fit_components_two(spark, sf_dir):
    """A whole fit of two main effects: shares with delta-method intervals."""
    f = fit(planted(spark, sf_dir).select("x1", "x2", "y"), "y", uniform=True, k1=1, k2=0, basis="legendre", stages=("A",))
    d = f.components()
    return d.select("v1", rd(F.col("variance")).alias("variance"), rd(F.col("share_core")).alias("share_core"), rd(F.col("lo"), 4).alias("lo"), rd(F.col("hi"), 4).alias("hi"))


@query(f"""WITH {_ONE}, a AS (SELECT yy, n, w, df, rss FROM s JOIN t USING (n)) SELECT CAST(n AS BIGINT) AS rows, {R('rss / n')} AS mse, {R('1 - rss / yy')} AS r2, {R('df')} AS df, {R('w')} AS w FROM (SELECT s.yy, t.n, t.w, t.df, t.rss FROM s, t)""")
def fit_as_dict(spark, sf_dir):
    """A fit's numbers as plain values."""
    f = fit(planted(spark, sf_dir).select("x1", "y"), "y", uniform=True, k1=1, k2=0, basis="legendre", stages=("A",))
    d = f.to_dict()
    return make(spark, [(d["rows"], round(d["mse"], 6), round(d["r2"], 6), round(d["df"], 6), round(d["coefficients"][0], 6))], "rows long, mse double, r2 double, df double, w double")


@query("SELECT count(*) AS rows, 0.0::DOUBLE AS largest FROM orders")
def saved_model_predicts_alike(spark, sf_dir):
    """The largest difference between a fit's predictions and bounds and those of the same fit saved and loaded."""
    from varlens.session import Scratch
    from varlens.sources import model_store

    d = planted(spark, sf_dir)
    f = fit(d.select("x1", "x2", "x3", "y"), "y", uniform=True, k1=2, k2=1, stages=("A", "B"))
    path = Scratch(spark, "model").path + "/m"
    model_store.save(spark, model_store.of_result(f), path, f.penalty)
    two = model_store.load(spark, path).predict(f.predict(d).select("k", "x1", "x2", "x3", *[F.col(c).alias(f"_{c}") for c in ("prediction", "lo", "hi")]))
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in ("prediction", "lo", "hi")])
    return two.agg(F.count("*").alias("rows"), (F.round(F.max(gap), 9) + 0.0).alias("largest"))


@query(f"""WITH {_S2}, g AS (SELECT a - 2 + 1e-3 / 3 AS a, c, d - 2 + 1e-3 / 3 AS d, u, v FROM s), w AS (SELECT *, a * d - c * c AS det FROM g), b AS (SELECT *, (d * u - c * v) / det AS w1, (a * v - c * u) / det AS w2 FROM w),
l AS (SELECT pow((q.y - w1 * f - w2 * g) / (1 - (d * f * f - 2 * c * f * g + a * g * g) / det), 2) AS base, pow((q.y - v / d * g) / (1 - g * g / d), 2) AS no1, pow((q.y - u / a * f) / (1 - f * f / a), 2) AS no2 FROM q, b),
o AS (SELECT 1 AS v1, avg(no1 - base) AS m, var_pop(no1 - base) AS s, count(*) AS n FROM l UNION ALL SELECT 2, avg(no2 - base), var_pop(no2 - base), count(*) FROM l) SELECT CAST(v1 AS INTEGER) AS v1, {R('m')} AS loo_change, {R('sqrt(s / n)')} AS se FROM o""")
def structure_test_two(spark, sf_dir):
    """Leave-one-out tests of dropping either of two main effects."""
    lay = Layout.build(["x1", "x2"], 1, basis="legendre")
    got = structure.structure_test(planted(spark, sf_dir), lay, "y", 1e-3)
    return make(spark, [(r["vars"][0] + 1, round(r["loo_change"], 6), round(r["se"], 6)) for r in got], "v1 int, loo_change double, se double")


@query(f"""WITH {S1}, r AS (SELECT 1e-3::DOUBLE / 3 AS r), t AS (SELECT n, c, b / (c + r) AS w, c / (c + r) AS df, yy - 2 * b * b / (c + r) + c * pow(b / (c + r), 2) AS rss, r FROM s, r),
v AS (SELECT avg(pow((q.y - t.w * q.f) / (1 - q.f * q.f / (t.c + t.r)), 2)) AS cv, any_value(rss / (n - 2 * df + df * df)) AS s2 FROM q, t),
a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS sy, sum(y * y) AS yy, sum(2 * x1 - 1) AS s, sum(pow(2 * x1 - 1, 2)) AS c, sum((2 * x1 - 1) * y) AS b FROM p),
dl AS (SELECT y, 2 * x1 - 1 AS f, n - 1 AS n, (sy - y) / (n - 1) AS m, c - pow(2 * x1 - 1, 2) AS c, b - (2 * x1 - 1) * y - (sy - y) / (n - 1) * (s - (2 * x1 - 1)) AS b, yy - y * y - pow(sy - y, 2) / (n - 1) AS yy FROM p, a),
w AS (SELECT y - m - b / (c + r) * f AS e, (yy - 2 * b * b / (c + r) + c * pow(b / (c + r), 2)) / (n - 2 * c / (c + r) + pow(c / (c + r), 2)) AS s2 FROM dl, r)
SELECT 1 AS tier, {R('cv')} AS loo_cv, {R('0.5 * ln(s2) + cv / (2 * s2) + 0.5 * ln(2 * pi())')} AS loo_nll FROM v UNION ALL SELECT 3, (SELECT {R('cv')} FROM v), {R('avg(0.5 * ln(2 * pi() * s2) + e * e / (2 * s2))')} FROM w""")
def loo_tiers(spark, sf_dir):
    """A whole fit's leave-one-out scores: at the fit's noise, and by exact refits."""
    f = fit(planted(spark, sf_dir).select("x1", "y"), "y", uniform=True, k1=1, k2=0, basis="legendre", stages=("A",))
    out = [f.loo(1), f.loo(3)]
    return make(spark, [(r["tier"], round(r["loo_cv"], 6), round(r["loo_nll"], 6)) for r in out], "tier int, loo_cv double, loo_nll double")


_PAIRS = " UNION ALL ".join(f"SELECT {i} AS v1, {j} AS v2, (2 * x{i} - 1) * (2 * x{j} - 1) AS f, y - 3 * cos(2 * pi() * x1) - 2 * (x2 - 0.5) AS y FROM p" for i, j in ((1, 2), (1, 3), (2, 3)))


@query(f"""WITH {P}, q AS ({_PAIRS}), s AS (SELECT v1, v2, count(*) AS n, sum(f * f) * (1 + 1e-8) AS c, sum(f * f) AS c0, sum(f) AS s, sum(f * y) AS b, var_pop(y) AS v FROM q GROUP BY v1, v2),
z AS (SELECT v1, v2, greatest((pow(b / c, 2) * c0 / n - pow(b / c * s / n, 2)) / v - 1 / n::DOUBLE, 0) AS score FROM s) SELECT CAST(v1 AS INTEGER) AS v1, CAST(v2 AS INTEGER) AS v2, {R('score')} AS score, score > 1e-3 AS flagged FROM z""")
def pair_scan_linear(spark, sf_dir):
    """Scores of all pairs in one scan, by products of linear parts."""
    d = planted(spark, sf_dir).withColumn("r", F.col("y") - 3 * F.cos(2 * math.pi * F.col("x1")) - 2 * (F.col("x2") - 0.5))
    got = discovery.scan(d, ["x1", "x2", "x3"], "r", k=1, basis="legendre")
    return make(spark, [(r["vars"][0] + 1, r["vars"][1] + 1, round(r["score"], 6), r["flagged"]) for r in got], "v1 int, v2 int, score double, flagged boolean")
