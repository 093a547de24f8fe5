"""Noise along penalties, the width of a choice of pairs, repeated neighbours, rows explained by term."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import diagnostics, ridge, rows, structure
from varlens.operators.fit import fit
from varlens.operators.stats import stats_pass
from varlens.plans.layout import Layout, richest_pairs


@pytest.fixture(scope="module")
def design(spark):
    r = np.random.default_rng(11)
    x = r.uniform(size=(400, 3))
    y = 2 * np.cos(2 * np.pi * x[:, 0]) + 6 * (x[:, 1] - 0.5) * (x[:, 2] - 0.5) + 0.3 * r.normal(size=400) + 5
    return spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x1 double, x2 double, x3 double, y double").repartition(5)


@pytest.mark.parametrize("strategy", ["variance", "zeros"])
def test_noise_curve_against_dense_fits(design, strategy):
    """Also where a column has no penalty, so that no common eigenbasis is at hand."""
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    shape = lay.penalty(1.0)
    if strategy == "zeros":
        shape[0] = 0.0
    got = rows.noise_curve(design, lay, "y", shape, [1e-2, 1.0, 1e2, 1e4])
    d = design.toPandas()
    phi, y = lay.batch(d[["x1", "x2", "x3"]].to_numpy()), d["y"].to_numpy() - d["y"].mean()
    for p in got["curve"]:
        hat = phi @ np.linalg.solve(phi.T @ phi + np.diag(p["lambda"] * shape), phi.T)
        e = y - hat @ y
        assert p["loo_cv"] == pytest.approx(np.mean((e / (1 - np.diag(hat))) ** 2))
        assert p["df"] == pytest.approx(np.trace(hat)) and p["rss"] == pytest.approx(e @ e)
        assert p["sigma2"] == pytest.approx(e @ e / (len(y) - 2 * np.trace(hat) + (hat * hat.T).sum()))
    assert got["best"]["loo_cv"] == min(got["curve"], key=lambda p: p["loo_cv"])["lambda"] and got["best"]["loo_cv"] < 1e4


def test_richest_pairs_that_fit():
    assert richest_pairs(1000, 4, [0], 8, 4, 6000) == {"mode": "all", "pairs": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], "columns": 32}
    assert richest_pairs(5, 4, [0], 8, 4, 6000)["mode"] == "either"  # 20 columns < 25 <= 32
    assert richest_pairs(1000, 4, [0, 1], 8, 4, 12) == {"mode": "both", "pairs": [(0, 1)], "columns": 12}
    assert richest_pairs(1, 4, [0, 1], 8, 4, 3)["mode"] == "both"


def test_fit_chooses_pairs_itself(design):
    f = fit(design.drop("k"), "y", uniform=True, k1=2, k2=1, stages=("A", "B"), pairs="auto", prune_pairs=False)
    assert {"stage": "pairs", "mode": "all", "pairs": 3, "columns": 3 * 5 + 3 * 9} in f.log and f.layout.size == 42
    named = {tuple(s["vars"]): s["share_core"] for s in f.shares()}
    assert max((p for p in named if len(p) == 2), key=named.get) == (1, 2)


def _nearest(keys, z, y):
    total = 0.0
    for i in range(len(keys)):
        best = min((float(((z[i] - z[j]) ** 2).sum()), keys[j], y[j]) for j in range(len(keys)) if keys[j] != keys[i])
        total += (y[i] - best[2]) ** 2
    return total / len(keys) / 2


def test_neighbours_among_repeats(spark):
    """Points of many rows, of two, of one, whose nearest point holds several rows: against all pairs. The first two features are constant
    or nearly so."""
    r = np.random.default_rng(3)
    x = np.vstack([np.tile([1.0, 2.0, 0.5], (60, 1)), np.tile([1.0, 2.0, 2.5], (2, 1)), [[1.0, 2.0, 4.5], [1.0, 2.0, 6.7], [1.0, 3.0, 60.0]], np.column_stack([np.ones(40), np.full(40, 2.0), r.choice(r.uniform(8, 20, 25), 40)])])
    keys = [int(k) for k in r.permutation(len(x))]
    y = [float(v) for v in r.normal(size=len(x))]
    df = spark.createDataFrame([(k, *map(float, a), b) for k, a, b in zip(keys, x, y, strict=True)], "k long, a double, b double, c double, y double").repartition(6)
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    got = diagnostics.neighbour_noise(df, ["a", "b", "c"], "y", "k", cells=64).head()
    assert got["rows"] == len(x) and got["sigma2"] == pytest.approx(_nearest(keys, z, y))


def test_one_point_for_all_rows_stays_linear(spark):
    """All of 60,000 rows at one point: each one's neighbour is the row of the least key, no two of the others meet."""
    df = spark.range(60_000).select("id", F.lit(0.3).alias("a"), F.lit(0.7).alias("b"), (F.col("id") % 2).cast("double").alias("y"))
    got = diagnostics.neighbour_noise(df, ["a", "b"], "y", "id").head()
    assert got["rows"] == 60_000 and got["sigma2"] == pytest.approx((30_000 + 1) / 60_000 / 2)  # y of row 0 is 0; row 0 looks at row 1


def test_explained_rows_add_up(design):
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    s = stats_pass(design, lay, "y")[None]
    w = ridge.solve(s.centred(), lay.penalty(1e-2)).w
    got = structure.explain_rows(design, lay, w, s.mean, "k").toPandas()
    assert len(got) == 400 * 7
    whole = got.groupby("k")["part"].sum()
    for row in rows.predict(design, lay, w, s.mean).filter("k < 20").collect():
        assert whole[row["k"]] == pytest.approx(row["prediction"])
        own = got[got["k"] == row["k"]].sort_values("rank")
        assert own["term"].iloc[0] == -1 and (own["part"].abs().iloc[1:].diff().dropna() <= 0).all()
        parts = structure.explain_row(lay, w, s.mean, {f"x{i}": row[f"x{i}"] for i in (1, 2, 3)})
        assert [p["part"] for p in parts] == pytest.approx(list(own["part"]))


def test_neighbours_of_many_different_points(spark):
    """20,000 points, most of them crowded into a small part of the range, with the coarsest choice of cells: some boxes' points meet a row, not all."""
    r = np.random.default_rng(8)
    x = np.concatenate([r.uniform(0, 1e-3, 15_000), r.uniform(-1, 1, 4_990), r.uniform(50, 60, 10)])
    y = r.normal(size=len(x))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, a double, y double").repartition(4)
    order = np.argsort(x)
    gap = np.append(np.inf, np.append(np.diff(x[order]), np.inf))
    near = np.where(gap[:-1] <= gap[1:], np.roll(order, 1), np.roll(order, -1))
    began = time.time()
    got = diagnostics.neighbour_noise(df, ["a"], "y", "k", cells=4).head()
    assert time.time() - began < 60
    assert got["rows"] == len(x) and got["sigma2"] == pytest.approx(np.mean((y[order] - y[near]) ** 2) / 2, rel=1e-4)


def test_crowded_boxes_are_cut(spark, monkeypatch):
    """Small boxes, two and three features, repeated keys and equal distances: against all pairs."""
    monkeypatch.setattr(diagnostics, "BOX", 8)
    r = np.random.default_rng(9)
    x = np.column_stack([r.integers(0, 12, 300), r.choice([0.0, 1.0, 50.0], 300), r.normal(size=300).round(1)]).astype(float)
    keys = [int(k) for k in r.integers(0, 250, 300)]
    y = [float(v) for v in r.normal(size=300)]
    for names in (["a", "b"], ["a", "b", "c"]):
        z = x[:, : len(names)]
        one = dict(zip(map(tuple, z.tolist()), range(300), strict=True))
        at = sorted(one.values()) if len(names) == 2 else list(range(300))
        seen: dict = {}
        at = [i for i in at if seen.setdefault((keys[i], *z[i]), i) == i]
        df = spark.createDataFrame([(keys[i], *map(float, x[i]), y[i]) for i in at], "k long, a double, b double, c double, y double").repartition(3)
        z = (z[at] - z[at].mean(axis=0)) / z[at].std(axis=0)
        total, ks, ys = 0.0, [keys[i] for i in at], [y[i] for i in at]
        for i in range(len(at)):
            best = min((sum((z[i] - z[j]) ** 2), ks[j], ys[i] - ys[j]) for j in range(len(at)) if ks[j] != ks[i])
            total += best[2] ** 2
        got = diagnostics.neighbour_noise(df, names, "y", "k", cells=3).head()
        assert got["rows"] == len(at) and got["sigma2"] == pytest.approx(total / len(at) / 2, rel=2e-2)


def test_least_noise_among_penalties_that_doubles_cannot_tell_apart(design):
    """Sigma2 grows with the penalty here, by less than rounding: the smallest one is the best."""
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    got = rows.noise_curve(design, lay, "y", lay.penalty(1.0), np.logspace(-9, -5, 40))
    assert got["best"]["sigma2"] == got["curve"][0]["lambda"]


def test_query_flags_every_penalty_whose_noise_is_the_least_double(spark, monkeypatch):
    """As its SQL does, here from the sums of 9,000,000 orders: sigma2 of the smallest penalties is the same double."""
    from types import SimpleNamespace

    import duckdb

    from varlens import queries_joint
    from varlens.queries import SQL

    n, c, b, yy = 9000000.0, 3001136.039781292, -22650.02459034485, 44589801.62926643
    lams = [10.0**e for e in range(-2, 5)]
    curve = [{"lambda": x, "df": c / (c + x), "sigma2": 4.954404, "loo_cv": 5.0 - x / 1e5, "gcv": 5.0} for x in lams]
    stats = SimpleNamespace(n=n, c=np.array([[c]]), b=np.array([b]), yy=yy)
    monkeypatch.setattr(queries_joint, "planted", lambda *_: None)
    monkeypatch.setattr(queries_joint.rows, "noise_curve", lambda *_: {"curve": curve, "best": {"sigma2": lams[0], "loo_cv": lams[-1]}, "stats": stats})
    got = sorted(r["e"] for r in queries_joint.noise_curve(spark, "").collect() if r["best_sigma2"])

    sql = SQL["noise_curve"]
    tail = sql[sql.index("l AS (SELECT") : sql.index(", v AS (")]
    sums = f"WITH s AS (SELECT {n!r}::DOUBLE AS n, {c!r}::DOUBLE AS c, {b!r}::DOUBLE AS b, {yy!r}::DOUBLE AS yy), {tail}"
    want = duckdb.sql(f"{sums}, v AS (SELECT e, rss / (n - 2 * df + df * df) AS sigma2 FROM r) SELECT e FROM v WHERE sigma2 = (SELECT min(sigma2) FROM v) ORDER BY e").fetchall()
    assert got == [e for e, in want] == [-2, -1, 0]
