"""The one-scan sieve, residual subspaces, characterisations, exact quantiles, dependence over all rows, kernel variance, saved models."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import diagnostics, discovery, residual
from varlens.operators.fit import fit
from varlens.operators.prepare import Quantiles, order_statistics
from varlens.operators.stats import stats_pass
from varlens.plans.layout import Layout, Spec, Term
from varlens.sources import model_store


def frame(spark, x, y, parts=3):
    names = [f"x{k + 1}" for k in range(x.shape[1])]
    return spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in names) + ", y double").repartition(parts), names


def test_all_triples_of_thirty_columns_in_one_scan(spark):
    r = np.random.default_rng(2)
    x = r.random((400, 30))
    z = 2 * x - 1
    y = 3 * z[:, 27] * z[:, 28] * z[:, 29] + 2 * z[:, 3] * z[:, 19] + r.normal(0, 0.1, 400)
    df, names = frame(spark, x, y)
    got = discovery.sieve(df, names, "y", k=1, k1=2, k3=1, basis="legendre", top=None)
    assert got["scanned"] == 30 + 435 + 4060 and len(got["triples"]) == 4060 and len(got["pairs"]) == 435
    assert got["triples"][0]["vars"] == (27, 28, 29) and got["triples"][0]["score"] > 0.2 and got["pairs"][0]["vars"] == (3, 19)
    assert set(got["recommend"]) >= {"triples", "pairs"}
    yc, n = y, len(y)
    for t in got["triples"][:3] + got["triples"][2000:2003]:
        i, j, k = t["vars"]
        f = z[:, i] * z[:, j] * z[:, k]
        w = f @ yc / (f @ f * (1 + 1e-8))
        assert t["score"] == pytest.approx(max(0.0, np.var(w * f) / np.var(y) - 1 / n), abs=1e-9)
    # Few bytes a task: the same scores from candidates dealt over many tasks.
    few = ["x1", "x2", "x28", "x29", "x30"]
    a, b = (discovery.sieve(df, few, "y", k=1, k1=2, k3=1, basis="legendre", top=None, task_bytes=size) for size in (1 << 26, 400))
    assert [t["vars"] for t in a["triples"]] == [t["vars"] for t in b["triples"]]
    assert [t["score"] for t in a["pairs"]] == pytest.approx([t["score"] for t in b["pairs"]])
    assert discovery.sieve(df, ["x1"], "y", k1=1)["scanned"] == 1 and "pairs" not in discovery.sieve(df, ["x1"], "y", k1=1)


def test_subspace_captures_a_planted_pair_and_not_noise(spark):
    r = np.random.default_rng(3)
    x = r.random((1500, 3))
    noise = r.normal(0, 0.5, 1500)
    df, names = frame(spark, x, 4 * (x[:, 0] - 0.5) * (x[:, 1] - 0.5) + 0.2 * noise)
    lay = Layout.build(names, 2)
    extra = residual.Features.rbf(r.random((40, 3)), 0.4)
    got = discovery.subspace_capture(df, lay, extra, "y")
    assert got["orthogonal"] > 0.7 and got["features"] == 40 and got["directions"][0]["share"] >= got["directions"][1]["share"]
    phi, z = lay.batch(x), extra.batch(x)
    y = np.array([v["y"] for v in df.select(*names, "y").collect()])
    flat, _ = frame(spark, x, noise)
    assert discovery.subspace_capture(flat, lay, extra, "y")["orthogonal"] < 0.05
    left = z - phi @ np.linalg.solve(phi.T @ phi + 1e-8 * np.trace(phi.T @ phi) / lay.size * np.eye(lay.size), phi.T @ z)
    target = np.asarray(4 * (x[:, 0] - 0.5) * (x[:, 1] - 0.5) + 0.2 * noise)
    c = np.linalg.solve(left.T @ left + 1e-8 * np.trace(left.T @ left) / 40 * np.eye(40), left.T @ target)
    assert got["orthogonal"] == pytest.approx(np.var(left @ c) / np.var(y) - 40 / 1500, abs=1e-4)
    energy = discovery.subspace_capture(df, lay, extra, "y", top=40)["directions"]
    assert sum(d["share"] for d in energy) <= 1 + 1e-9


def test_a_step_lands_on_haar_and_a_wave_on_fourier(spark):
    r = np.random.default_rng(4)
    x = r.random((12000, 4))
    y = 3 * (x[:, 0] - 0.5) + 1.5 * np.where(np.floor(x[:, 1] * 8) % 2 == 0, 1, -1) + 1.5 * np.cos(2 * np.pi * 6 * x[:, 2]) + r.normal(0, 0.2, 12000)
    df, names = frame(spark, x, y)
    got = {g["variable"]: g for g in discovery.cross_residual(df, names, "y", {"legendre": 4, "fourier": 7, "haar": 3})}
    assert [got[n]["character"] for n in names] == ["polynomial", "localized", "oscillatory", "negligible"]
    phi = Layout.build(names, 4, basis="legendre")
    p, yc = phi.batch(x), y - y.mean()
    w = np.linalg.solve(p.T @ p + np.diag(phi.penalty(1e-3)), p.T @ yc)
    left = yc - p @ w
    h = Layout(tuple(names), (Term((1,), (Spec(3, "haar", False),)),)).batch(x)
    assert got["x2"]["haar_variance"] == pytest.approx(np.var(h @ np.linalg.lstsq(h, left, rcond=None)[0]), rel=1e-6)
    assert got["x1"]["legendre_variance"] == pytest.approx(np.var(p[:, :4] @ w[:4]), rel=1e-6)
    rest = df.withColumn("r", F.col("y") - 3 * (F.col("x1") - 0.5))
    kinds = {g["variable"]: g for g in discovery.characterise(rest, names, "r", {"x1": 0.9}, k=7, scales=3)}
    assert [kinds[n]["character"] for n in names] == ["polynomial", "localized", "oscillatory", "negligible"]
    assert kinds["x2"]["strongest_scale"] == 3 and sum(kinds["x2"]["scales"]) == pytest.approx(kinds["x2"]["haar"])


def test_what_a_residual_suggests(spark):
    r = np.random.default_rng(5)
    x = r.random((3000, 2))
    for y, flags in (
        (np.cos(2 * np.pi * 4 * x[:, 0]) + r.normal(0, 0.5, 3000), (True, False)),
        ((x[:, 0] - 0.5) * (x[:, 1] - 0.5) * 4 + r.normal(0, 0.5, 3000), (False, True)),
    ):
        df, names = frame(spark, x, y)
        got = diagnostics.residual_report(df.withColumn("t", F.col("y") + 10 * F.col("x2")), names, "t", "y", 3)
        assert (got["more_functions"], got["interactions"]) == flags and not got["noise_part"]
    power = sum(np.corrcoef(y, f(2 * np.pi * k * x[:, 0]))[0, 1] ** 2 for k in (4, 5, 6) for f in (np.cos, np.sin))
    assert got["high_frequency"]["x1"] == pytest.approx(power) and set(got["pairs"]) == {("x1", "x2")}


@pytest.mark.parametrize("cells, finish", [(1 << 14, 1 << 16), (16, 0), (8, 5)])
def test_order_statistics(spark, cells, finish):
    r = np.random.default_rng(7)
    n = 700
    columns = {
        "smooth": r.normal(0, 1, n),
        "tied": np.where(r.random(n) < 0.4, 3.0, r.integers(0, 6, n)).astype(float),
        "same": np.full(n, -2.5),
        "wide": np.concatenate([r.random(n - 3), [1e300, -1e300, 1e-300]]),
        "close": 1 + r.integers(0, 4, n) * 2.0**-52,
    }
    df = spark.createDataFrame([tuple(map(float, t)) for t in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns)).repartition(5)
    ranks = np.array([0, 1, 17, 349, 350, 698, 699])
    got = order_statistics(df, list(columns), ranks, cells, finish)
    for k, v in enumerate(columns.values()):
        assert got[k].tolist() == np.sort(v)[ranks].tolist()
    gaps = df.select(F.when(F.col("smooth") > 0, F.col("smooth")).alias("a"), F.lit(float("nan")).alias("b"))
    a, b = order_statistics(gaps, ["a", "b"], np.array([0, 5]))
    assert a.tolist() == np.sort(columns["smooth"][columns["smooth"] > 0])[[0, 5]].tolist() and np.isnan(b).all()


def test_quantile_knots_are_the_percentiles(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.gamma(2, 1, 3000), np.full(500, 1.25)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    q = Quantiles.fit(df, ["x"], 101)
    assert np.allclose(q.values[0], np.percentile(x, np.linspace(0, 100, 101)), rtol=1e-12)
    assert Quantiles.fit(df.limit(3), ["x"], 101).refs.tolist() == [0, 0.5, 1]


def test_dependence_over_all_rows(spark):
    r = np.random.default_rng(9)
    a = r.random(2600)
    b = np.abs(a - 0.5) + 0.3 * r.random(2600)
    df = spark.createDataFrame([(float(u), float(v)) for u, v in zip(a, b, strict=True)] + [(None, 1.0)], "a double, b double").repartition(4)
    want = diagnostics.distance_correlation(a, b)
    assert diagnostics.pair_dependence(df, "a", "b") == pytest.approx(want, abs=1e-10) == diagnostics.pair_dependence(df, "a", "b", block=300)
    assert diagnostics.pair_dependence(df.limit(3), "a", "b") == 0.0


@pytest.mark.parametrize("kind", ["rbf", "matern32", "matern52"])
def test_kernel_variance_is_the_dense_one(spark, kind):
    r = np.random.default_rng(10)
    x, p = r.random((50, 2)), r.random((12, 2))
    df, names = frame(spark, x, np.zeros(50))
    got = sorted((v["x1"], v["v"]) for v in residual.posterior_variance(df, names, p, 0.4, 1e-2, kind, signal=2.0, name="v").collect())
    k = lambda a, b: 2.0 * residual.kernel(((a[:, None] - b[None]) ** 2).sum(-1), 0.4, kind)
    dense = 2.0 - np.diag(k(x, p) @ np.linalg.solve(k(p, p) + 1e-2 * np.eye(12), k(p, x)))
    assert [v for _, v in got] == pytest.approx([v for _, v in sorted(zip(x[:, 0], dense, strict=True))], abs=1e-8)
    assert min(v for _, v in got) > 0


@pytest.mark.parametrize("kind", ["plain", "noise", "rff", "rbf", "nystrom", "noise and complement"])
def test_a_saved_model_predicts_as_the_fit(spark, tmp_path, kind):
    r = np.random.default_rng(12)
    x = r.random((900, 3)) * [10, 1, 5]
    y = np.cos(x[:, 0]) + x[:, 1] * x[:, 2] + r.normal(0, 0.2, 900) * np.exp(1.5 * x[:, 1])
    df, names = frame(spark, x, y)
    options = {"plain": dict(stages=("A", "B")), "noise": dict(stages=("A", "D"), kh=1), "rff": dict(stages=("A", "C"), residual="rff", residual_size=20), "rbf": dict(stages=("A", "C"), residual="rbf", residual_size=10), "nystrom": dict(stages=("A", "C"), residual="nystrom", residual_size=10), "noise and complement": dict(stages=("A", "C", "D"), residual="rff", residual_size=20)}[kind]
    f = fit(df, "y", k1=2, k2=1, **options)
    assert (f.noise is not None) == ("noise" in kind) and (f.complement is not None) == (kind not in ("plain", "noise"))
    path = f"file://{tmp_path}/model"
    model_store.save(spark, model_store.of_result(f), path, f.penalty)
    with pytest.raises(Exception, match="already exists"):
        model_store.save(spark, model_store.of_result(f), path)
    cells = ["x1", "prediction", "aleatoric", "lo", "hi"]
    a, b = (m.predict(df).select(*cells).orderBy("x1").toPandas() for m in (f, model_store.load(spark, path)))
    assert np.allclose(a, b, atol=1e-9, rtol=1e-9)
    meta = json.loads(spark.read.parquet(f"{path}/meta").head()[0])
    spark.createDataFrame([(json.dumps(meta | {"format": 1}),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="format"):
        model_store.load(spark, path)


def test_mains_are_pruned_unless_an_interaction_holds_them(spark):
    r = np.random.default_rng(13)
    x = r.random((1500, 4))
    y = 3 * (x[:, 0] - 0.5) + 5 * (x[:, 1] - 0.5) * (x[:, 2] - 0.5) + r.normal(0, 0.1, 1500)
    df, _ = frame(spark, x, y)
    f = fit(df, "y", uniform=True, k1=1, k2=1, basis="legendre", stages=("A", "B"), selection="none", prune_mains=True)
    assert {t.vars for t in f.layout.terms} == {(0,), (1,), (2,), (1, 2)}
    s = stats_pass(df, f.layout, "y")[None]
    assert math.isclose(f.solution.rss, s.centred().rss(f.solution.w), rel_tol=1e-9)
