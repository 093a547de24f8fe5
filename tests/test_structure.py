"""Row passes run side by side, rank-one refits, true neighbours, complements' bounds and whole-fit reports, against plain computations."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import diagnostics, residual, ridge, structure
from varlens.operators.fit import fit
from varlens.operators.stats import row_sums, stats_pass
from varlens.plans.layout import Layout


@pytest.fixture(scope="module")
def design(spark):
    r = np.random.default_rng(4)
    x = r.random((600, 3))
    y = 2 * np.cos(2 * np.pi * x[:, 0]) + x[:, 1] + 3 * (x[:, 0] - 0.5) * (x[:, 2] - 0.5) + r.normal(0, 0.2, 600) * np.exp(x[:, 1])
    return spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x1 double, x2 double, x3 double, y double").cache()


def test_partitions_work_side_by_side(spark):
    """Eight partitions that sleep take about as long as the cores need, not one after another."""
    rows = spark.range(8, numPartitions=8)

    def run(batch):
        time.sleep(2)
        return np.array([float(batch.num_rows)])

    row_sums(spark.range(8, numPartitions=8), lambda b: np.array([0.0]), 1)  # start the workers
    begin = time.time()
    assert row_sums(rows, run, 1)[0] == 8
    cores = spark.sparkContext.defaultParallelism
    assert time.time() - begin < 2 * math.ceil(8 / min(cores, 8)) + 6
    assert row_sums(spark.range(0), run, 3).tolist() == [0, 0, 0]


def test_exact_loo_against_refits(spark, design):
    lay = Layout.build(["x1", "x2", "x3"], 2, 1)
    r = lay.penalty({1: 1e-2, 2: 1e-1})
    s = stats_pass(design, lay, "y")[None]
    got = structure.exact_loo(design, lay, "y", r, "k").join(design, "k").toPandas()
    assert len(got) == 600
    for row in got.iloc[::25].itertuples():
        phi = lay.batch(np.array([[row.x1, row.x2, row.x3]]))[0]
        less = s - type(s)(1.0, 1.0, row.y, row.y**2, phi, phi * row.y, np.outer(phi, phi))
        f = ridge.solve(less.centred(), r)
        e = row.y - less.mean - float(phi @ f.w)
        assert row.loo_nll == pytest.approx(0.5 * math.log(2 * math.pi * f.sigma2) + e * e / (2 * f.sigma2), abs=1e-8)


def test_neighbours_are_the_nearest(spark):
    """Isolated rows, ties, repeats, nulls: against all pairs."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(0, 1, (80, 2)), [[40.0, 0], [40.0, 30], [-25, 8], [0.5, 0.5], [0.5, 0.5]]])
    y = r.normal(0, 1, len(x))
    rows = [(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(1000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    z = (x - x.mean(0)) / x.std(0)
    z[:, 1] = (x[:, 1] - np.append(x[:, 1], 1.0).mean()) / np.append(x[:, 1], 1.0).std()  # the null row has this value
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = np.mean((y - y[d.argmin(1)]) ** 2) / 2
    got = diagnostics.neighbour_noise(df, ["a", "b"], "y", "k", cells=32).head()
    assert got["rows"] == len(x) and got["sigma2"] == pytest.approx(want)
    assert diagnostics.neighbour_noise(df.limit(0), ["a", "b"], "y", "k").head()["rows"] == 0
    assert diagnostics.neighbour_noise(df.filter("k = 1"), ["a", "b"], "y", "k").head()["rows"] == 0


def test_predictions_with_complement_and_noise_have_bounds(design):
    d = design.drop("k")
    plain = fit(d, "y", uniform=True, k1=2, k2=0, stages=("A",))
    f = fit(d, "y", uniform=True, k1=2, k2=0, stages=("A", "C"), residual="rff", residual_size=30)
    rows = f.predict(design).toPandas()
    lay = f.layout
    x = rows[["x1", "x2", "x3"]].to_numpy()
    want = f.f0 + lay.batch(x) @ f.solution.w + f.complement.batch(x)
    assert np.allclose(rows["prediction"], want) and (rows["lo"] < rows["prediction"]).all() and (rows["hi"] > rows["prediction"]).all()
    assert ((rows["y"] > rows["lo"]) & (rows["y"] < rows["hi"])).mean() > 0.9
    assert np.mean((rows["y"] - rows["prediction"]) ** 2) == pytest.approx(f.complement.mse, rel=1e-6)
    assert f.complement.mse < plain.solution.mse
    data, cube = f.residual_variance("data"), f.residual_variance("cube")
    assert data == pytest.approx(np.var(f.complement.batch(x)), rel=1e-6) and cube > 0
    assert sum(s["share_total"] for s in f.shares()) < 1 == pytest.approx(sum(s["share_core"] for s in f.shares()))


def test_a_kept_noise_part_decides_shares_and_has_a_spectrum(design):
    f = fit(design.drop("k"), "y", uniform=True, k1=2, k2=1, kh=1, stages=("A", "B", "D"))
    assert f.noise is not None
    noise = {r["v1"]: r["share_core"] for r in f.noise_components().collect() if r["ord"] == 1}
    assert max(noise, key=noise.get) == 2 and sum(noise.values()) == pytest.approx(1)
    one, two = f.loo(1), f.loo()
    assert one["loo_cv"] == pytest.approx(two["loo_cv"]) and one["loo_nll"] < two["loo_nll"] < one["loo_nll"] + 0.1
    assert not two["ill_conditioned"] and two["guarantee_holds"] and two["clipped"] == 0 and two["kkt_relative"] < 1e-3
    with pytest.raises(ValueError, match="posterior"):
        f.components("HC3")
    with pytest.raises(ValueError, match="tier must"):
        f.loo(4)
    assert np.array_equal(f.weights, f.hetero.w) and not np.array_equal(f.weights, f.solution.w)
    top = f.components().toPandas()
    assert top["variance"].sum() == pytest.approx(sum(s["variance"] for s in f.shares()))
    d = json.loads(json.dumps(f.to_dict()))
    assert d["rows"] == 600 and len(d["coefficients"]) == d["columns"] and d["noise"][1]["share"] == pytest.approx(noise[2])
    assert "R2" in f.summary().splitlines()[0] and len(f.summary(most=2).splitlines()) == 3
    alone = fit(design.drop("k"), "y", uniform=True, k1=1, k2=0, stages=("A",))
    assert alone.noise_components().count() == 0 and alone.to_dict()["noise"] is None


def test_complement_variance_of_nothing(design):
    joint = residual.Joint(Layout.build(["x1"], 1), residual.Features("rff", np.array([[1.0]]), 1.0, np.array([0.0])))
    c = residual.Complement(joint, np.zeros((3, 1)), np.zeros(1), np.zeros(4))
    assert residual.complement_variance(c, design) == 0 == residual.complement_variance(c)


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from varlens.session import shared_dir

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(session)


def test_dependence_test_tells_dependent_inputs(spark):
    r = np.random.default_rng(1)
    x = r.random(200)
    df = spark.createDataFrame([(float(a), float(abs(a - 0.5)), float(b)) for a, b in zip(x, r.random(200), strict=True)], "a double, b double, c double")
    assert diagnostics.dependence_test(df, ["a", "b"], permutations=39)["p"] <= 0.05 < diagnostics.dependence_test(df, ["a", "c"], permutations=39)["p"]
    assert diagnostics.pair_dependence(df.select("a", F.col("a").alias("b")), "a", "b") == pytest.approx(1)
