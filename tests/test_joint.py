"""Joint fits of mean and log-variance in batches, against dense computations in memory."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.operators import joint, variance
from varlens.operators.fit import fit
from varlens.plans.layout import Layout

MEAN = Layout.build(["x1", "x2"], 1)
VAR = Layout.build(["x2"], 1, basis="legendre")
R_MEAN, R_VAR = np.full(MEAN.size, 0.3), np.array([0.7])


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(11)
    x = r.random((240, 2))
    y = np.sin(2 * np.pi * x[:, 0]) + x[:, 1] + r.normal(0, 0.3, 240) * np.exp(0.8 * (2 * x[:, 1] - 1))
    df = spark.createDataFrame([(i, *map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k long, x1 double, x2 double, y double, fold int").repartition(3).cache()
    return df, x, y


def one(m):
    return np.column_stack([np.ones(len(m)), m])


def dense(x, y, r_mean=R_MEAN, r_var=R_VAR, raw=False, rounds=60):
    """Alternating fit by plain matrices, to the end."""
    u, v = one(MEAN.batch(x)), one(VAR.batch(x[:, 1:]))
    rm, rv = np.append(0, r_mean), np.append(0, r_var)
    wt, theta, w = np.ones(len(y)), None, None
    for _ in range(rounds):
        a = np.linalg.inv(u.T @ (u * wt[:, None]) + np.diag(rm))
        w = a @ (u.T @ (wt * y))
        r2 = (y - u @ w) ** 2
        if not raw:
            r2 = r2 / np.clip(1 - wt * ((u @ a) * u).sum(1), 1e-3, 1)
        theta = np.array([math.log(r2.mean()), 0.0]) if theta is None else theta
        for _ in range(50):
            e = r2 * np.exp(-(v @ theta))
            step = np.linalg.solve(v.T @ (v * (e / 2)[:, None]) + np.diag(rv), v.T @ (0.5 * (1 - e)) + rv * theta)
            theta = theta - step
            if np.abs(step).max() < 1e-12:
                break
        wt = np.exp(-(v @ theta))
    a = np.linalg.inv(u.T @ (u * wt[:, None]) + np.diag(rm))
    return a @ (u.T @ (wt * y)), theta


def nll(x, y, w, theta, cap=math.inf):
    h = one(VAR.batch(x[:, 1:])) @ theta
    return 0.5 * math.log(2 * math.pi) + 0.5 * h + 0.5 * np.minimum((y - one(MEAN.batch(x)) @ w) ** 2 * np.exp(-h), cap)


def rows_of(df, fold="fold"):
    return joint.Rows.of(df, MEAN, VAR, "y", fold, floor_share=0.0)


@pytest.mark.parametrize("raw", [False, True])
def test_many_fits_at_once_are_the_fits_one_by_one(data, raw):
    df, x, y = data
    rows = rows_of(df)
    states = [joint.State(a * R_MEAN, b * R_VAR, k) for a in (1, 20) for b in (0.1, 10) for k in (None, 0, 3)]
    joint.joint_fits(rows, states, raw, rounds=40, tol=1e-13)
    fold = np.arange(len(y)) % 4
    for s in states:
        at = fold != s.leave if s.leave is not None else fold >= 0
        w, theta = dense(x[at], y[at], s.r_mean, s.r_var, raw)
        assert np.allclose(s.w, w, atol=1e-6) and np.allclose(s.theta, theta, atol=1e-6) and s.converged
    tests = joint.held_out(rows, [s for s in states if s.leave is not None])
    for s, t in zip([s for s in states if s.leave is not None], tests, strict=True):
        at = fold == s.leave
        assert t["rows"] == at.sum()
        assert t["nll"] == pytest.approx(nll(x[at], y[at], s.w, s.theta).mean()) and t["nll_capped"] == pytest.approx(nll(x[at], y[at], s.w, s.theta, 50.0).mean())


def test_passes_do_not_grow_with_folds_and_penalties(data):
    df = data[0]

    def passes(states):
        rows = rows_of(df)
        joint.joint_fits(rows, states)
        return rows.passes

    alone = [passes([joint.State(R_MEAN, b * R_VAR, k)]) for b in (0.01, 100) for k in (None, 1)]
    together = passes([joint.State(R_MEAN, b * R_VAR, k) for b in np.logspace(-2, 2, 9) for k in (None, 0, 1, 2, 3)])
    assert together <= 1.5 * max(alone)


def test_sums_that_do_not_fit_go_in_turns(data, monkeypatch):
    df = data[0]
    make = lambda: [joint.State(R_MEAN, b * R_VAR, k) for b in (0.1, 1) for k in (0, 1)]
    a, b = make(), make()
    joint.joint_fits(rows_of(df), a)
    monkeypatch.setattr(joint, "BYTES", 400)
    joint.joint_fits(rows_of(df), b)
    assert all(np.allclose(p.w, q.w) and np.allclose(p.theta, q.theta) for p, q in zip(a, b, strict=True))


def test_evidence_is_the_laplace_approximation(data):
    """Against the Hessian of the penalised likelihood by differences, mean and log-variance together."""
    df, x, y = data
    rows, s = rows_of(df), joint.State(R_MEAN, R_VAR)
    joint.joint_fits(rows, [s], raw=True, rounds=60, tol=1e-15)
    u, v = one(MEAN.batch(x)), one(VAR.batch(x[:, 1:]))
    f = u.shape[1]
    pen = np.concatenate([[0], R_MEAN, [0], R_VAR])

    def loss(z):
        h = v @ z[f:]
        return (0.5 * h + 0.5 * (y - u @ z[:f]) ** 2 * np.exp(-h)).sum() + 0.5 * pen @ z**2

    z, d = np.concatenate([s.w, s.theta]), 1e-4
    e = np.eye(len(z)) * d
    hess = np.array([[(loss(z + a + b) - loss(z + a - b) - loss(z - a + b) + loss(z - a - b)) / (4 * d * d) for b in e] for a in e])
    want = -loss(z) + 0.5 * np.log(pen[pen > 0]).sum() - 0.5 * np.linalg.slogdet(hess)[1]
    got = joint.evidence(rows, [s], cross=True, raw=True)[0]
    assert got["evidence"] == pytest.approx(want, abs=1e-4) and got["status"] == "laplace_evidence"
    cross = hess[:f, f:]
    assert got["cross_ratio"] == pytest.approx(np.linalg.norm(cross) / math.sqrt(np.linalg.norm(hess[:f, :f]) * np.linalg.norm(hess[f:, f:])), rel=1e-4)
    block = joint.evidence(rows, [s], raw=True)[0]
    apart = np.linalg.slogdet(hess[:f, :f])[1] + np.linalg.slogdet(hess[f:, f:])[1]
    assert block["evidence"] == pytest.approx(-loss(z) + 0.5 * np.log(pen[pen > 0]).sum() - 0.5 * apart, abs=1e-4)
    assert joint.evidence(rows, [s])[0]["status"] == "empirical_criterion"
    short = joint.State(R_MEAN, R_VAR)
    joint.joint_fits(rows, [short], raw=True, rounds=1)
    assert joint.evidence(rows, [short], raw=True)[0]["status"] == "laplace_evidence_unverified"


def test_best_penalties(data):
    df, x, y = data
    ones = np.ones(MEAN.size)
    got = joint.best_penalties(df, MEAN, VAR, "y", ones, np.ones(1), "fold", mean_lambda=0.3, points=7, bounds=(1e-2, 1e4))
    fold = np.arange(len(y)) % 4
    for p in got["path"]:
        parts = []
        for k in range(4):
            w, theta = dense(x[fold != k], y[fold != k], 0.3 * ones, p["lambda"] * np.ones(1))
            parts.append(nll(x[fold == k], y[fold == k], w, theta).mean())
        assert p["held_out"] == pytest.approx(np.mean(parts), abs=2e-4)
    assert got["objective"] == min(p["objective"] for p in got["path"]) and len(got["path"]) in (7, 8)
    split = joint.best_penalties(df, MEAN, VAR, "y", ones, np.ones(1), "fold", criterion="split", mean_lambda=0.3, points=3)
    w, theta = dense(x[fold != 0], y[fold != 0], 0.3 * ones, split["path"][0]["lambda"] * np.ones(1))
    assert split["path"][0]["held_out"] == pytest.approx(nll(x[fold == 0], y[fold == 0], w, theta).mean(), abs=2e-4)
    laplace = joint.best_penalties(df, MEAN, VAR, "y", ones, np.ones(1), "fold", criterion="laplace", mean_lambda=0.3, points=5, bounds=(1e-2, 1e6))
    assert laplace["status"] == "laplace_evidence" and laplace["objective"] == -max(p["evidence"] for p in laplace["path"])
    assert any("end" in w for w in joint.best_penalties(df, MEAN, VAR, "y", ones, np.ones(1), "fold", mean_lambda=0.3, points=2)["warnings"])
    with pytest.raises(ValueError, match="criterion"):
        joint.best_penalties(df, MEAN, VAR, "y", ones, np.ones(1), "fold", criterion="x")


def test_coordinate_fits_stand_at_the_grid_optimum(data):
    """The chosen mean penalty minimises the criterion of the ridge whitened with the fit's own weights."""
    df, x, y = data
    rows, s = rows_of(df), joint.State(R_MEAN, R_VAR)
    lam = joint.coordinate_fits(rows, [s], np.ones(MEAN.size), rounds=6)[0]
    wt = np.exp(-np.clip(one(VAR.batch(x[:, 1:])) @ s.theta, -30, 30))
    phi, n = MEAN.batch(x), len(y)
    pc = (phi - wt @ phi / wt.sum()) * np.sqrt(wt)[:, None]
    yc = (y - wt @ y / wt.sum()) * np.sqrt(wt)

    def gcv(lam):
        a = np.linalg.solve(pc.T @ pc + lam * np.eye(MEAN.size), np.column_stack([pc.T @ yc, pc.T @ pc]))
        return np.mean((yc - pc @ a[:, 0]) ** 2) / (1 - (np.trace(a[:, 1:]) + 1) / n) ** 2

    grid = np.logspace(-2, 5, 2001)
    assert abs(math.log10(lam) - math.log10(grid[np.argmin([gcv(g) for g in grid])])) < 0.02


def test_deletion_equals_refits(data):
    df, x, y = data
    small = df.filter("k < 60")
    table, flags = joint.deleted(small, MEAN, VAR, "y", R_MEAN, R_VAR, "k", rounds=30, tol=1e-10)
    x, y = x[:60], y[:60]
    assert [t["key"] for t in table] == list(range(60)) and all(t["converged"] for t in table)
    for t in table[::7]:
        keep = np.arange(60) != t["key"]
        w, theta = dense(x[keep], y[keep])
        assert t["nll"] == pytest.approx(nll(x[~keep], y[~keep], w, theta)[0], abs=1e-5)
    assert flags["kkt"] < 1e-3 and flags["guarantee_holds"] and not flags["floor_active"] and 0 < flags["rcond"] <= 1
    some, _ = joint.deleted(small, MEAN, VAR, "y", R_MEAN, R_VAR, "k", keys=[3, 9], rounds=30, tol=1e-10)
    assert [s["nll"] for s in some] == pytest.approx([table[3]["nll"], table[9]["nll"]], abs=1e-6)


def test_newton_makes_one_pass_a_step(data, monkeypatch):
    df, x, y = data
    calls = []
    plain = variance._sum_rows
    monkeypatch.setattr(variance, "_sum_rows", lambda *a: calls.append(1) or plain(*a))
    part = variance.newton(df.withColumn("r2", (F.col("y") - F.col("x2")) ** 2), VAR, "r2", R_VAR, tol=1e-12)
    assert len(calls) <= part.steps + 3
    v = one(VAR.batch(x[:, 1:]))
    theta = np.append(part.h0, part.w)
    e = (y - x[:, 1]) ** 2 * np.exp(-(v @ theta))
    assert np.abs(v.T @ (0.5 * (1 - e)) + np.append(0, R_VAR) * theta).max() < 1e-6 and part.health["kkt"] < 1e-6


def test_tier_three_of_a_whole_fit(data):
    df = data[0].filter("k < 90").select("x1", "x2", "y")
    f = fit(df, "y", uniform=True, k1=1, k2=0, stages=("A", "D"), kh=1, lambda_h=0.1)
    assert f.noise is not None
    two, three = f.loo(2), f.loo(3)
    assert three["refits"] == 90 and abs(three["loo_nll"] - two["loo_nll"]) < 0.1


def test_a_noise_of_one_pair_alone(spark):
    """The log-variance's only part is a pair: its own design finds it, main effects do not."""
    r = np.random.default_rng(5)
    x = r.random((3000, 4))
    y = 4 * (x[:, 0] - 0.5) + 2 * (x[:, 1] - 0.5) + r.normal(0, 1, 3000) * np.exp(4 * (x[:, 2] - 0.5) * (x[:, 3] - 0.5))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x1 double, x2 double, x3 double, x4 double, y double").repartition(4)
    common = dict(uniform=True, k1=1, k2=0, basis="legendre", stages=("A", "D"), kh=1, lambda_h=1e-2)
    f = fit(df, "y", **common, kh2=1, variance_features=("x2", "x3", "x4"))
    spectrum = {tuple(f.features[v] for v in t.vars): None for t in f.noise.layout.terms}
    assert set(spectrum) == {("x2",), ("x3",), ("x4",), ("x2", "x3"), ("x2", "x4"), ("x3", "x4")}
    rows = sorted(f.noise_components().collect(), key=lambda r: -r["share_core"])
    assert (rows[0]["v1"], rows[0]["v2"]) == (3, 4) and rows[0]["share_core"] > 0.8
    pinned = fit(df, "y", **common, kh2=1, variance_pairs=(("x4", "x3"),))
    assert [t.vars for t in pinned.noise.layout.terms if t.order == 2] == [(2, 3)]
    assert fit(df, "y", **common).noise is None  # main effects alone are no better than a constant
    with pytest.raises(ValueError, match="no features"):
        fit(df, "y", **common, variance_features=("x9",))
    with pytest.raises(ValueError, match="variance pair"):
        fit(df, "y", **common, kh2=1, variance_features=("x3",), variance_pairs=(("x3", "x4"),))
    with pytest.raises(ValueError, match="kh2"):
        fit(df, "y", kh2=-1)


def test_pairs_of_the_noise_follow_its_active_main_effects(spark):
    r = np.random.default_rng(6)
    x = r.random((2500, 4))
    h = 2 * (2 * x[:, 0] - 1) + 1.5 * (2 * x[:, 2] - 1) + (2 * x[:, 0] - 1) * (2 * x[:, 2] - 1)
    y = x[:, 1] + r.normal(0, 1, 2500) * np.exp(h / 2)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "x1 double, x2 double, x3 double, x4 double, y double").repartition(4)
    f = fit(df, "y", uniform=True, k1=1, k2=0, basis="legendre", stages=("A", "D"), lambda_h=1e-2, kh2=1, variance_pairs="auto", threshold=0.05)
    assert [t.vars for t in f.noise.layout.terms if t.order == 2] == [(0, 2)]


def test_likelihood_comes_with_the_mean_step(data, monkeypatch):
    """No pass of its own for it, and the same value as from the rows."""
    df, x, y = data
    sizes, plain = [], joint.Rows.by_state
    monkeypatch.setattr(joint.Rows, "by_state", lambda self, states, f, size: (sizes.append((len(states), size)), plain(self, states, f, size))[1])
    rows = joint.Rows.of(df, MEAN, VAR, "y")
    s = joint.State(R_MEAN, R_VAR)
    joint.joint_fits(rows, [s], rounds=2)
    assert not [a for a in sizes if a[1] == 2 and a[0]]
    total = plain(rows, [s], lambda s, y, u, v: np.array([len(y), joint._nll(s, y, u, v).sum()]), 2)[0]
    assert s.loss == pytest.approx(total[1] / total[0], rel=1e-10)


def test_deletions_need_no_pass_of_their_own(spark, monkeypatch):
    """Where designs repeat, 3,000 rows are deleted in as many passes as the whole fit takes; keys of several rows, by cell formulas."""
    df = spark.range(3000).select((F.col("id") % 2900).alias("k"), ((F.col("id") % 7) / 7).alias("x1"), F.sin(F.col("id") * 1.7).alias("y"))
    cells = Layout.build(["x1"], 1, basis="haar")
    tiny, passes = np.array([1e-7]), []
    plain = joint.Rows.sums
    monkeypatch.setattr(joint.Rows, "sums", lambda self, f, sizes: (passes.append(len(sizes)), plain(self, f, sizes))[1])
    got = {r["key"]: r for r in joint.deletions(df, cells, cells, "y", tiny, tiny, "k", rounds=20).collect()}
    assert len(got) == 2900 and set(passes) <= {0, 1}
    k, x, y = df.toPandas().to_numpy().T
    for key in (0, 5, 2899):
        own, side = k == key, x >= 0.5
        want = []
        for i in np.flatnonzero(own):
            rest = y[(side == side[i]) & ~own]
            m, v = rest.mean(), rest.var()
            n = (side == side[i]).sum() - own[side == side[i]].sum()
            v = v * n / (n - 1)  # residuals are corrected for leverage
            want.append((m, np.log(v), 0.5 * np.log(2 * np.pi * v) + 0.5 * (y[i] - m) ** 2 / v))
        assert [got[key][c] for c in ("prediction", "log_variance", "nll")] == pytest.approx(np.mean(want, axis=0), abs=1e-5)
