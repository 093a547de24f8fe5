"""The engine on Spark: both forms of the statistics, fits with known answers, negative inputs, sources, streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import prepare, rows, variance
from varlens.operators.fit import Config, fit
from varlens.operators.stats import of_batch, stats_pass, total
from varlens.plans.layout import Layout
from varlens.sources import model_store, synthetic
from varlens.sources.numeric_csv import infer_target, read_numeric_csv


def test_expressions_equal_batches(spark):
    d = synthetic.inputs(spark, 300, 2).withColumn("x1", F.when(F.col("i") == 7, 1.0).otherwise(F.col("x1")))
    x = np.array([(r["x1"], r["x2"]) for r in d.orderBy("i").collect()])
    for basis in ("fourier", "legendre", "haar"):
        lay = Layout.build(["x1", "x2"], 3, 2, basis=basis)
        got = np.array([list(r) for r in d.orderBy("i").select(*[c.alias(f"c{k}") for k, c in enumerate(lay.columns())]).collect()])
        assert np.allclose(got, lay.batch(x), atol=1e-12)


def test_both_forms_of_statistics(spark):
    d = synthetic.friedman1(spark, 2000, 5).withColumn("w", F.col("x1") + 0.1).withColumn("g", (F.col("i") % 3).cast("int"))
    lay = Layout.build(["x1", "x2"], 2)
    for weight in (None, "w"):
        for by in (None, "g"):
            a, b = stats_pass(d, lay, "y", weight, by, small=50), stats_pass(d, lay, "y", weight, by, small=0)
            assert set(a) == set(b)
            for k in a:
                for field in ("n", "sw", "sy", "yy", "s", "b", "c"):
                    assert np.allclose(getattr(a[k], field), getattr(b[k], field), rtol=1e-9), field
    m = np.array([(r["x1"], r["x2"], r["y"], r["w"]) for r in d.collect()])
    want = of_batch(lay.batch(m[:, :2]), m[:, 2], m[:, 3])
    assert np.allclose(total(stats_pass(d, lay, "y", "w", "g")).c, want.c)


def test_leverage_and_sandwich(spark):
    d = synthetic.friedman1(spark, 400, 3 + 2)
    lay = Layout.build(["x1", "x2", "x3"], 1)
    from varlens.operators.ridge import solve

    s = stats_pass(d, lay, "y")[None]
    f = solve(s.centred(), np.full(lay.size, 0.1))
    m = np.array([(r["x1"], r["x2"], r["x3"], r["y"]) for r in d.orderBy("i").collect()])
    phi, e = lay.batch(m[:, :3]), m[:, 3] - s.mean
    res = e - phi @ f.w
    h = np.einsum("ij,jk,ik->i", phi, f.inverse, phi)
    got = rows.leverage_rows(d, lay, "y", f.w, s.mean, f.inverse).orderBy("i").collect()
    assert np.allclose([r["loo_residual"] for r in got], res / (1 - h))
    u = phi * (res / (1 - h))[:, None]
    assert np.allclose(rows.sandwich(d, lay, "y", f.w, s.mean, f.inverse), f.inverse @ u.T @ u @ f.inverse)


def test_ishigami(spark):
    d = synthetic.ishigami(spark, 5000).select("x1", "x2", "x3", "y")
    r = fit(d, "y", k1=8, k2=4, stages=("A", "B"), lambda1=1e-6, lambda2=1e-6)
    t = synthetic.ishigami_truth()
    assert np.allclose(list(r.first_order().values()), t["first"], atol=0.03)
    assert np.allclose(list(r.total_order().values()), t["total"], atol=0.03)
    p = r.predict(d).agg(F.avg((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y")).head()
    assert p[0] / p[1] < 0.02
    assert {c["status"] for c in r.components("HC3").collect()} <= {"regular", "nonregular_null", "nonregular_boundary"}


def test_friedman(spark):
    d = synthetic.friedman1(spark, 10_000).select(*[f"x{k}" for k in range(1, 11)], "y")
    r = fit(d, "y", uniform=True, k1=6, k2=2, stages=("A", "B"), strategy="curvature", lambda1=1e-3, lambda2=1e-3)
    got = list(r.first_order().values())
    t = synthetic.friedman1_truth()
    v = r.stats.yy / r.stats.n
    assert np.allclose(got[:5], t["first"], atol=0.02) and max(got[5:]) < 0.01
    pair = next(s for s in r.shares() if s["vars"] == (0, 1))
    assert pair["share_core"] == pytest.approx(t["pair"][1, 2], abs=0.02)
    assert r.solution.sigma2 == pytest.approx(1.0, abs=0.15) and v > 20


@pytest.mark.parametrize("name", ["linear", "harmonic", "cross_term", "pair_only", "apart", "triple"])
def test_known_variances(spark, name):
    d, _, _, known = synthetic.CATALOGUE[name]
    rows_ = synthetic.catalogue(spark, name, 6000).select(*[f"x{k}" for k in range(1, d + 1)], F.col("truth").alias("y"))
    r = fit(rows_, "y", uniform=True, k1=3, k2=1, k3=1 if name == "triple" else 0, stages=("A", "B"), lambda1=1e-6, lambda2=1e-6, lambda3=1e-6, selection="none")
    got = {tuple(v + 1 for v in s["vars"]): s["variance"] for s in r.shares()}
    for k, v in known.items():
        assert got[k] == pytest.approx(v, abs=0.02 + 0.02 * v), k


def test_noise_model(spark):
    d = synthetic.catalogue(spark, "apart", 4000).withColumn("s", F.when(F.col("i") % 5 < 4, "train").otherwise("val"))
    m, v = Layout.build([f"x{k}" for k in range(1, 7)], 2), Layout.build(["x3"], 1)
    got = variance.heteroscedastic(d, m, v, "y", m.penalty(1e-3), v.penalty(1.0), "s", rounds=3)
    assert got.kept and got.variance.w[0] == pytest.approx(2.0, abs=0.4) and got.variance.h0 == pytest.approx(0, abs=0.2)
    flat = synthetic.catalogue(spark, "linear", 3000).withColumn("y", F.col("truth") + synthetic.noise(2.0)).withColumn("s", F.when(F.col("i") % 5 < 4, "train").otherwise("val"))
    m, v = Layout.build([f"x{k}" for k in range(1, 6)], 1), Layout.build(["x3"], 1)
    assert not variance.heteroscedastic(flat, m, v, "y", m.penalty(1e-3), v.penalty(1.0), "s", rounds=2).kept


def test_complement_explains_what_mains_miss(spark):
    d = synthetic.friedman1(spark, 3000, 5, 0.1).select("x1", "x2", "x3", "x4", "x5", "y")
    plain = fit(d, "y", uniform=True, k1=4, stages=("A",))
    both = fit(d, "y", uniform=True, k1=4, stages=("A", "C"), residual="rff", residual_size=80, residual_scale=0.7)
    mse = [r.predict(d).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).head()[0] for r in (plain, both)]
    assert mse[1] < 0.6 * mse[0]


def test_bad_inputs(spark):
    good = spark.createDataFrame([(0.1, 1.0, "a"), (0.2, 2.0, "b")], "x double, y double, s string")
    for bad, args in ((good, (["s"], "y")), (good, (["z"], "y")), (good, (["x", "x"], "y")), (good.limit(0), (["x"], "y")), (good.withColumn("x", F.lit(None).cast("double")), (["x"], "y")), (good.withColumn("x", F.lit(float("nan"))), (["x"], "y")), (good.withColumn("y", F.lit(3.0)), (["x"], "y")), (good.withColumn("y", F.lit(float("inf"))), (["x"], "y"))):
        with pytest.raises(ValueError):
            prepare.check_inputs(bad, *args)
    with pytest.raises(ValueError, match="did you mean 'lambda1'"):
        Config.of(lambda_1=1)
    for wrong in ({"k1": 0}, {"k1": True}, {"lambda1": -1}, {"basis": "x"}, {"stages": ("B",)}, {"level": 1.0}, {"strategy": "none"}, {"pairs": "some"}):
        with pytest.raises(ValueError):
            Config.of(**wrong)


def test_quantiles(spark):
    d = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 5, 9]], "x double")
    q = prepare.Quantiles.fit(d, ["x"])
    assert np.allclose(q.one(np.array([0.0, 1, 2, 5, 9, 20]), 0), [0, 0, 0.4, 0.8, 1, 1])
    assert [r["o"] for r in d.select(q.outside().alias("o")).collect()] == [False] * 6
    assert {r["feature"]: r["tied"] for r in prepare.tied_columns(d, ["x"]).collect()} == {"x": True}


def test_csv(spark, tmp_path):
    def read(text, **k):
        p = tmp_path / f"f{abs(hash(text))}.csv"
        p.write_text(text, encoding="utf-8")
        return read_numeric_csv(spark, f"file://{p}", **k)

    d, t = read("﻿a,Target,b\n1,2,3\nNA,5,6\n4,5,null\n7,8,9\n")
    assert t == "Target" and d.count() == 2 and d.columns == ["a", "b", "Target"]
    assert infer_target(["a", "b"]) == "b"
    for text in ("a,a\n1,2\n", "a,\n1,2\n", "a,y\n1,2\n1\n", "a,y\n1,x\n2,3\n", "a,y\n1,inf\n2,3\n", "a,y\n1,2\n3,2\n", ""):
        with pytest.raises(ValueError):
            read(text)


def test_model_round_trip(spark, tmp_path):
    d = synthetic.ishigami(spark, 1000).select("x1", "x2", "x3", "y")
    r = fit(d, "y", k1=3, k2=1, stages=("A", "B"))
    path = f"file://{tmp_path}/m"
    model_store.save(spark, model_store.of_result(r), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        model_store.save(spark, model_store.of_result(r), path)
    a, b = (m.predict(d).agg(F.sum("prediction"), F.sum("hi")).head() for m in (r, model_store.load(spark, path)))
    assert np.allclose(a, b)


def test_streaming_windows_equal_batch(spark, tmp_path):
    from varlens.streaming.windowed import fit_windows, stats_of_row, stream_stats, with_time

    d = spark.range(400).select((F.col("id") * 7).alias("k"), F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.sin(F.col("id") / 9).alias("value"))
    rows_ = with_time(d, "ts")
    lay = Layout.build(["time"], 1, basis="legendre")
    want = fit_windows(rows_, lay, "value", "window", 1.0)
    rows_.drop("window").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows_.drop("window").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_stats(stream, lay, "value", "ts").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.sql("select * from windows").collect(), key=lambda r: r["window"]["start"])
    from varlens.operators.ridge import solve

    for g, w in zip(got, want, strict=True):
        s = stats_of_row(g, lay.size)
        assert s.n == w["n"] and np.allclose(solve(s.centred(), np.ones(1)).w, w["w"])


def test_structure_questions(spark):
    from varlens.operators import structure
    from varlens.operators.ridge import solve

    d = synthetic.friedman1(spark, 600, 5).select("i", "x1", "x2", "x3", "x4", "x5", "y")
    lay = Layout.build(["x1", "x2", "x3", "x4", "x5"], 2)
    got = structure.structure_test(d, lay, "y", 1e-3, adds=((0, 1), (2, 3)))
    first = next(g for g in got if g["change"] == "add")
    assert first["vars"] == (0, 1) and first["loo_change"] < -3 * first["se"]
    assert all(g["loo_change"] > 0 for g in got if g["change"] == "drop" and g["vars"] in ((3,), (2,)))
    r = lay.penalty(1e-3)
    s = stats_pass(d, lay, "y")[None]
    loo = {x["i"]: x["loo_nll"] for x in structure.exact_loo(d.filter("i < 40"), lay, "y", r + 1.0, "i").collect()}
    m = np.array([(x["x1"], x["x2"], x["x3"], x["x4"], x["x5"], x["y"]) for x in d.filter("i < 40").orderBy("i").collect()])
    phi = lay.batch(m[:, :5])
    keep = np.arange(40) != 7
    f = solve(of_batch(phi[keep], m[keep, 5]).centred(), r + 1.0)
    e = m[7, 5] - m[keep, 5].mean() - phi[7] @ f.w
    assert loo[7] == pytest.approx(0.5 * np.log(2 * np.pi * f.sigma2) + e * e / (2 * f.sigma2))
    a = structure.additivity_shares(s, lay)
    assert 0.8 < a["sum"] <= 1.05
    w = solve(s.centred(), r).w
    parts = structure.explain_row(lay, w, s.mean, {f"x{k}": 0.3 for k in range(1, 6)})
    assert sum(p["part"] for p in parts) == pytest.approx(s.mean + float(lay.batch(np.full((1, 5), 0.3))[0] @ w))
    assert structure.noise_verdict(2.0, 1.0) == "underfit" and structure.noise_verdict(1.1, 1.0) == "consistent"
    assert all(g["gap"] == 0 for g in structure.two_fit_gap(lay, w, w))
    scores = structure.baselines(d.filter("i % 3 > 0"), d.filter("i % 3 = 0"), ["x1", "x2", "x3", "x4", "x5"], "y")
    assert all(b["r2"] > 0.5 for b in scores)
