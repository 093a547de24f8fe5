"""Diagnostics as aggregations: residual correlations, calibration, variance accounting, noise without a model, dependence."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.functions.numeric import normal_quantile, t_cdf
from varlens.operators.rows import linear
from varlens.operators.sensitivity import shares
from varlens.plans.layout import Layout
from varlens.session import Scratch, ship


def residual_correlations(df: DataFrame, features: list[str], residual: str) -> DataFrame:
    """kind, v1, v2, r: of the residual with each x, of its square with each x, and with each centred product. One scan."""
    r = F.col(residual)
    items = [("linear", i, None, F.corr(r, F.col(c))) for i, c in enumerate(features)]
    items += [("square", i, None, F.corr(r * r, F.col(c))) for i, c in enumerate(features)]
    items += [("pair", i, j, F.corr(r, (F.col(features[i]) - 0.5) * (F.col(features[j]) - 0.5))) for i, j in combinations(range(len(features)), 2)]
    row = df.agg(*[x.alias(f"c{n}") for n, (*_, x) in enumerate(items)])
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i + 1).alias("v1"), F.lit(None if j is None else j + 1).cast("int").alias("v2"), F.col(f"c{n}").alias("r")) for n, (k, i, j, _) in enumerate(items)])
    return row.select(F.explode(cells).alias("s")).select("s.*")


def calibration(df: DataFrame, residual: Column, sigma2: Column) -> DataFrame:
    """Moments of z = r / sigma and the share within the normal 50, 90, 95 and 99 % bounds."""
    z = (residual / F.sqrt(sigma2)).alias("z")
    cover = [F.avg(F.when(F.abs("z") <= normal_quantile(0.5 + p / 200), 1.0).otherwise(0.0)).alias(f"cover{p}") for p in (50, 90, 95, 99)]
    return df.select(z).agg(F.avg("z").alias("mean"), F.var_pop("z").alias("variance"), F.skewness("z").alias("skew"), F.kurtosis("z").alias("excess_kurtosis"), *cover)


def r_squared(df: DataFrame, y: Column, prediction: Column) -> DataFrame:
    """Explained variance 1 - Var(r) / Var(y), and 1 - SSE / TSS."""
    rows = df.select(y.alias("y"), (y - prediction).alias("r"))
    return rows.agg((1 - F.var_pop("r") / F.var_pop("y")).alias("explained"), (1 - F.sum(F.col("r") ** 2) / (F.var_pop("y") * F.count("*"))).alias("r2"))


def gaussian_nll(residual: Column, sigma2: Column) -> Column:
    """Mean of ln(s2) / 2 + r^2 / (2 s2)."""
    return F.avg(0.5 * F.log(sigma2) + 0.5 * residual * residual / sigma2)


def replicate_noise(df: DataFrame, features: list[str], target: str, digits: int = 12) -> DataFrame:
    """Pooled variance within rows of equal features; usable with at least 5 such groups and 5 % of the rows."""
    keys = [F.round(F.col(c), digits).alias(c) for c in features]
    groups = df.select(*keys, F.col(target).alias("_y")).groupBy(*features).agg(F.var_pop("_y").alias("v"), F.count("*").alias("n"))
    out = groups.agg(F.sum(F.when(F.col("n") > 1, F.col("v") * F.col("n"))).alias("ss"), F.sum(F.when(F.col("n") > 1, F.col("n") - 1)).alias("df"), F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("rows"), F.sum("n").alias("all_rows"))
    return out.select((F.col("ss") / F.col("df")).alias("sigma2"), "groups", "rows", ((F.col("groups") >= 5) & (F.col("rows") >= 0.05 * F.col("all_rows"))).alias("usable"))


#: Points of a box in the search for neighbours, about.
BOX = 2048


def _cut_boxes(points: DataFrame, at_point: list[str], ways: int) -> tuple[list[list[tuple]], dict[int, tuple]]:
    """Cuts by level, as (box, axis, cuts), until boxes hold about ``BOX`` of the distinct points, and each last box's bounds.

    A level cuts each crowded box into up to ``ways`` parts, at quantiles along the axis that gives most parts, of those the widest.
    Driver state is a row for each box.
    """
    levels: list[list[tuple]] = []
    bounds = {0: (np.full(len(at_point), -np.inf), np.full(len(at_point), np.inf))}
    parts = [i / ways for i in range(1, ways)]
    cells = [f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(at_point) for n, f in (("a", F.min), ("b", F.max), ("q", lambda c: F.percentile_approx(c, parts, 1000)))]
    while len(levels) < 40:
        seen = _boxed(points, at_point, levels, ways).groupBy("box").agg(F.count("*").alias("n"), *cells).filter(F.col("n") > BOX).collect()  # crowded boxes
        cuts = []
        for r in seen:
            found = [(sorted({x for x in r[f"q{i}"] if x > r[f"a{i}"]}), r[f"b{i}"] - r[f"a{i}"], i) for i in range(len(at_point))]
            xs, wide, i = max(found, key=lambda x: (len(x[0]), x[1], -x[2]))
            if not xs and wide > 0:
                xs = [r[f"a{i}"] + wide / 2]
                xs = xs if xs[0] > r[f"a{i}"] else [r[f"b{i}"]]
            if xs:
                cuts.append((r["box"], i, xs))
        if not cuts:
            break
        of, after = {c[0]: c for c in cuts}, {}
        for box, (lo, hi) in bounds.items():
            _, i, xs = of.get(box, (box, 0, []))
            for k in range(len(xs) + 1):
                low, high = lo.copy(), hi.copy()
                if xs:
                    low[i], high[i] = (xs[k - 1] if k else lo[i]), (xs[k] if k < len(xs) else hi[i])
                after[box * ways + k] = (low, high)
        # Numbers stay small: boxes are counted anew at each level.
        names = {old: new for new, old in enumerate(after)}
        levels.append([(box, *of.get(box, (box, 0, []))[1:], names[box * ways]) for box in bounds])
        bounds = {names[old]: x for old, x in after.items()}
    return levels, bounds


def _boxed(df: DataFrame, at_point: list[str], levels: list[list[tuple]], ways: int) -> DataFrame:
    """``df`` with the number of each row's box."""
    df = df.withColumn("box", F.lit(0))
    for level in levels:
        cuts = df.sparkSession.createDataFrame(level, "box int, axis int, cuts array<double>, first int")
        z = F.element_at(F.array(*at_point), F.col("axis") + 1)
        at = (F.col("first") + F.size(F.filter("cuts", lambda c: c <= z))).cast("int")
        df = df.join(F.broadcast(cuts), "box").withColumn("box", at).drop("axis", "cuts", "first")
    return df


def _nearest_in_box(rows, points, axes: int):
    """For each of ``rows`` (id, k, y, z0..) the nearest other point of ``points`` (p, q, z0..): d2, k2, dy, null where there is none."""
    import pyarrow as pa
    import pyarrow.compute

    def flat(column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column

    n, m = rows.num_rows, points.num_rows
    x, z = (np.stack([np.asarray(t.column(f"z{i}").to_numpy(), float) for i in range(axes)], axis=1).reshape(t.num_rows, axes) for t in (rows, points))
    p, q = (flat(points.column(c)) for c in ("p", "q"))
    two = q.is_valid().to_numpy(zero_copy_only=False)
    key = lambda a: a.to_numpy(zero_copy_only=False)
    pk, py = key(p.field("k")), key(p.field("y"))
    qs = q.filter(pa.array(two))
    mine = key(rows.column("k"))
    names, rank = np.unique(np.concatenate([pk, key(qs.field("k")), mine]), return_inverse=True)
    first, own = rank[:m], rank[len(rank) - n :]
    second, qy = np.full(m, len(names)), np.zeros(m)
    second[two], qy[two] = rank[m : len(rank) - n], key(qs.field("y"))
    best, at, other = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, len(names))
    side = max(1, (1 << 19) // max(m, 1))
    for a in range(0, n if m else 0, side):
        d2 = np.zeros((len(x[a : a + side]), m))
        for i in range(axes):
            d2 += (x[a : a + side, i : i + 1] - z[None, :, i]) ** 2
        same = np.ones(d2.shape, bool)
        for i in range(axes):
            same &= x[a : a + side, i : i + 1] == z[None, :, i]
        who = np.where(first[None] == own[a : a + side, None], second[None], first[None])
        d2[same | (who == len(names))] = np.inf
        least = d2.min(axis=1)
        who = np.where(d2 == least[:, None], who, len(names))
        j = who.argmin(axis=1)
        best[a : a + side], at[a : a + side], other[a : a + side] = least, j, who[np.arange(len(j)), j]
    ok = np.isfinite(best)
    y = np.where(first[at] == own, qy[at], py[at]) if m else np.zeros(n)
    none = pa.array(~ok)
    names = pa.array(names, rows.schema.field("k").type)
    k2 = names.take(pa.array(np.where(ok, other, 0))) if len(names) else rows.column("k")
    drop = lambda v: pa.compute.if_else(none, pa.scalar(None, v.type), v)
    dy = np.asarray(rows.column("y").to_numpy(), float) - y
    return best, {"d2": drop(pa.array(best)), "k2": drop(k2), "dy": drop(pa.array(dy))}


def neighbour_noise(df: DataFrame, features: list[str], target: str, key: str, cells: int = 16) -> DataFrame:
    """Half the mean squared difference to the nearest row, features standardised; of equally near rows that with the least key.

    Rows of equal features become one point that knows its two least keys, by map-side combined sums, so repeated values, however
    many, never meet in pairs; rows with another key at their own point are done. For the others space is cut at quantiles into boxes of
    about ``BOX`` distinct points, up to ``cells`` parts at a time, wherever they lie. A row looks through its own box; where the ball up to the
    nearest row found reaches over the box, it also goes to the boxes that the ball meets. So a row meets some boxes' points, however
    many rows there are, and those far from all others look further. Rows with a null take no part. Tables between steps are written to the shared folder.
    """
    asked = [f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.agg(*asked).head()
    z = [((F.col(c) - stats[f"m{i}"]) / (stats[f"s{i}"] or 1.0)).alias(f"z{i}") for i, c in enumerate(features)]
    at_point = [f"z{i}" for i in range(len(features))]
    scratch = Scratch(df.sparkSession, "neighbours")
    rows = scratch.save(df.select(F.col(key).alias("k"), F.col(target).cast("double").alias("y"), *z).dropna(), "rows")
    points = rows.groupBy(*at_point).agg(F.min(F.struct("k", "y")).alias("p"))
    met = rows.join(points, at_point)
    second = met.filter(F.col("k") != F.col("p.k")).groupBy(*at_point).agg(F.min(F.struct("k", "y")).alias("q"))
    points = scratch.save(points.join(second, at_point, "left"), "points")
    own = F.when(F.col("k") != F.col("p.k"), F.col("p")).otherwise(F.col("q"))
    met = rows.join(points, at_point).withColumn("o", own)
    found = [met.filter("o IS NOT NULL").select((F.col("y") - F.col("o.y")).alias("dy"))]
    left = scratch.save(met.filter("o IS NULL").select(F.monotonically_increasing_id().alias("id"), "k", "y", *at_point), "left")
    if not left.isEmpty():
        ship(df.sparkSession)
        axes, ways = len(features), max(2, cells)
        levels, bounds = _cut_boxes(points, at_point, ways)
        box_of = scratch.save(_boxed(points, at_point, levels, ways), "boxes")
        low, high = (np.stack([bounds[b][i] for b in range(len(bounds))]) for i in (0, 1))
        kind = dict(rows.dtypes)["k"]

        def own_box(mine, theirs):
            import pyarrow as pa

            best, columns = _nearest_in_box(mine, theirs, axes)
            x = np.stack([np.asarray(mine.column(f"z{i}").to_numpy(), float) for i in range(axes)], axis=1).reshape(mine.num_rows, axes)
            b = mine.column("box").to_numpy()
            reach = best * (1 + 1e-9)
            inside = np.ones(len(x), bool)
            for i in range(axes):
                inside &= ((x[:, i] - low[b, i]) ** 2 > reach) & ((high[b, i] - x[:, i]) ** 2 > reach)
            others: list = [None] * len(x)
            for r in np.flatnonzero(~inside).tolist():
                gap = np.maximum(np.maximum(low - x[r], x[r] - high), 0)
                near = np.flatnonzero((gap * gap).sum(axis=1) <= reach[r])
                near = near[near != b[r]]
                others[r] = near.tolist() if len(near) else None
            return pa.table({**{c: mine.column(c) for c in ("id", "k", "y", *at_point)}, **columns, "boxes": pa.array(others, pa.list_(pa.int32()))})

        def other_box(mine, theirs):
            import pyarrow as pa

            return pa.table({"id": mine.column("id"), **_nearest_in_box(mine, theirs, axes)[1]})

        shape = ", ".join(f"{c} double" for c in at_point)
        dealt = box_of.groupBy("box")
        first = _boxed(left, at_point, levels, ways).groupBy("box").cogroup(dealt).applyInArrow(own_box, f"id long, k {kind}, y double, {shape}, d2 double, k2 {kind}, dy double, boxes array<int>")
        first = scratch.save(first, "own-box")
        found.append(first.filter("boxes IS NULL AND d2 IS NOT NULL").select("dy"))
        wide = first.filter("boxes IS NOT NULL")
        more = wide.select("id", "k", "y", *at_point, F.explode("boxes").alias("box")).groupBy("box").cogroup(dealt).applyInArrow(other_box, f"id long, d2 double, k2 {kind}, dy double")
        both = wide.select("id", "d2", "k2", "dy").unionByName(more).filter("d2 IS NOT NULL")
        found.append(both.groupBy("id").agg(F.min(F.struct("d2", "k2", "dy")).alias("s")).select("s.dy"))
    done = found[0]
    for part in found[1:]:
        done = done.unionByName(part)
    return done.agg((F.avg(F.col("dy") ** 2) / 2).alias("sigma2"), F.count("*").alias("rows"))


def correlation_test(df: DataFrame, features: list[str], level: float = 0.05) -> DataFrame:
    """Pearson's r of each pair, its t statistic and Bonferroni p value."""
    pairs = list(combinations(range(len(features)), 2))
    row = df.agg(F.count("*").alias("n"), *[F.corr(features[i], features[j]).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).head()
    out = []
    for k, (i, j) in enumerate(pairs):
        r, n = row[f"c{k}"] or 0.0, row["n"]
        t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
        p = min(1.0, 2 * (1 - t_cdf(abs(t), n - 2)) * len(pairs))
        out.append((i + 1, j + 1, r, t, p, p < level))
    return df.sparkSession.createDataFrame(out, "v1 int, v2 int, r double, t double, p double, dependent boolean")


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Bias-corrected (U-centred) distance correlation of two samples in memory."""

    def centred(v):
        d = np.abs(v[:, None] - v[None])
        n = len(v)
        row = d.sum(1)
        u = d - row[:, None] / (n - 2) - row[None] / (n - 2) + d.sum() / ((n - 1) * (n - 2))
        np.fill_diagonal(u, 0)
        return u

    n = len(x)
    a, b = centred(np.asarray(x, float)), centred(np.asarray(y, float))
    inner = lambda p, q: float((p * q).sum()) / (n * (n - 3))
    den = inner(a, a) * inner(b, b)
    return inner(a, b) / math.sqrt(den) if den > 0 else 0.0


def dependence_test(df: DataFrame, features: list[str], sample: int = 256, permutations: int = 199, seed: int = 0) -> dict:
    """Largest distance correlation over pairs against its permutation distribution, on a hash-ordered sample (a
    sampling operator: its size is the parameter)."""
    rows = df.select(*features).orderBy(F.xxhash64(*features)).limit(sample).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    pairs = list(combinations(range(len(features)), 2))
    stat = lambda m: max((distance_correlation(m[:, i], m[:, j]) for i, j in pairs), default=0.0)
    seen = stat(rows)
    hits = sum(stat(np.column_stack([rng.permutation(c) for c in rows.T])) >= seen for _ in range(permutations))
    return {"statistic": seen, "p": (hits + 1) / (permutations + 1), "rows": len(rows)}


def pair_dependence(df: DataFrame, a: str, b: str, block: int = 2048) -> float:
    """Bias-corrected distance correlation of two columns over all rows.

    The sums over pairs of rows are additive over pairs of blocks: rows are dealt into blocks of ``block``, each block meets each
    other once, and what leaves a meeting are row sums of distances and three sums of products. U-centred products follow from
    these without a second meeting: with row sums A_i and whole sum A of the distances a_ij, the centred inner product of a and b is
    sum a b - 2 / (n - 2) sum A_i B_i + A B / ((n - 1)(n - 2)), the diagonal being left out. Work grows with the square of the
    rows, as the statistic's does; memory with a block.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "dependence")
    rows = scratch.save(df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().withColumn("_id", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    if n < 4:
        return 0.0
    blocks = -(-n // block)
    dealt = scratch.save(rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")), "dealt")
    left = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))  # block _b meets block _o, once from each side
    own = dealt.select("a", "b", F.col("_b").alias("_o"), "_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(mine, theirs):
        import pyarrow as pa

        x = [np.asarray(mine.column(c).to_numpy(), float) for c in ("a", "b")]
        z = [np.asarray(theirs.column(c).to_numpy(), float) for c in ("a", "b")]
        out = np.zeros((len(x[0]), 5))
        for i in range(0, len(x[0]), 256):
            da, db = (np.abs(u[i : i + 256, None] - v[None]) for u, v in zip(x, z, strict=True))
            out[i : i + 256] = np.column_stack([m.sum(axis=1) for m in (da, db, da * db, da * da, db * db)])
        return pa.table({"_id": mine.column("_id"), **{f"s{k}": out[:, k] for k in range(5)}})

    met = left.groupBy("_b", "_o").cogroup(own.groupBy("_b", "_o")).applyInArrow(meet, "_id long, s0 double, s1 double, s2 double, s3 double, s4 double")
    per = met.groupBy("_id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(5)])
    t = per.agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(5)], F.sum(F.col("s0") * F.col("s1")).alias("ab"), F.sum(F.col("s0") ** 2).alias("aa"), F.sum(F.col("s1") ** 2).alias("bb")).head()
    inner = lambda products, rows_, p, q: products - 2 / (n - 2) * rows_ + p * q / ((n - 1) * (n - 2))
    ab, aa, bb = inner(t["t2"], t["ab"], t["t0"], t["t1"]), inner(t["t3"], t["aa"], t["t0"], t["t0"]), inner(t["t4"], t["bb"], t["t1"], t["t1"])
    return ab / math.sqrt(aa * bb) if aa > 0 and bb > 0 else 0.0


def high_frequency(df: DataFrame, features: list[str], residual: str, k1: int, more: int = 3) -> DataFrame:
    """variable, power: squared correlations of the residual with the ``more`` frequencies above ``k1``, added up. One scan."""
    waves = [(i, f(F.col(c) * F.lit(2 * math.pi * k))) for i, c in enumerate(features) for k in range(k1 + 1, k1 + more + 1) for f in (F.cos, F.sin)]
    row = df.agg(*[F.corr(residual, w).alias(f"c{n}") for n, (_, w) in enumerate(waves)])
    cells = [F.struct(F.lit(i + 1).alias("variable"), sum((F.coalesce(F.col(f"c{n}"), F.lit(0.0)) ** 2 for n, (j, _) in enumerate(waves) if j == i), F.lit(0.0)).alias("power")) for i in range(len(features))]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def residual_report(df: DataFrame, features: list[str], target: str, residual: str, k1: int, top: int = 10) -> dict:
    """What a residual's correlations suggest: more functions of a variable, interactions or a complement, a noise part."""
    found = residual_correlations(df, features, residual).collect()  # a row per variable and pair
    power = {features[r["variable"] - 1]: r["power"] for r in high_frequency(df, features, residual, k1).collect()}
    v = df.agg(F.var_pop(residual).alias("r"), F.var_pop(target).alias("y")).head()
    of = lambda kind: {r["v1"] if r["v2"] is None else (r["v1"], r["v2"]): r["r"] or 0.0 for r in found if r["kind"] == kind and (r["r"] is None or not math.isnan(r["r"]))}
    named = lambda d: {(features[k - 1] if isinstance(k, int) else tuple(features[i - 1] for i in k)): x for k, x in d.items()}
    linear_, square, pairs = named(of("linear")), named(of("square")), named(of("pair"))
    largest = lambda d: max((abs(x) for x in d.values()), default=0.0)
    share = (v["r"] or 0.0) / max(v["y"] or 0.0, 1e-300)
    rules = {"more_functions": max(power.values(), default=0.0) > 0.05, "interactions": largest(pairs) > 0.1 or largest(linear_) > 0.1 or share > 0.2, "noise_part": largest(square) > 0.1}
    best = sorted(pairs, key=lambda p: (-abs(pairs[p]), p))[:top]
    return {"linear": linear_, "square": square, "pairs": {p: pairs[p] for p in best}, "high_frequency": power, "residual_share": share, **rules}


def share_divergence(df: DataFrame, layout: Layout, w: np.ndarray) -> DataFrame:
    """variable, structural (under independent uniform inputs) and correlative share of each main effect, and their distance."""
    cols = layout.columns()
    parts = {",".join(map(str, t.vars)): linear(cols[layout.block(k)], w[layout.block(k)]) for k, t in enumerate(layout.terms)}
    found = component_covariances(df, parts)
    own = [(",".join(map(str, s["vars"])), s["vars"][0] + 1, s["share_core"]) for s in shares(layout, w) if len(s["vars"]) == 1]
    named = df.sparkSession.createDataFrame(own, "component string, variable int, structural double")
    return named.join(found, "component").select("variable", "structural", F.col("share").alias("correlative"), F.abs(F.col("structural") - F.col("share")).alias("divergence"))


def component_covariances(df: DataFrame, components: dict[str, Column]) -> DataFrame:
    """component, covariance with their sum, and its share: the shares add up to 1 under any dependence."""
    whole = sum(components.values(), F.lit(0.0))
    rows = df.select(whole.alias("_t"), *[c.alias(f"_c{i}") for i, c in enumerate(components.values())])
    row = rows.agg(F.var_pop("_t").alias("v"), *[F.covar_pop(f"_c{i}", "_t").alias(f"k{i}") for i in range(len(components))])
    cells = F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"k{i}").alias("covariance"), (F.col(f"k{i}") / F.col("v")).alias("share")) for i, n in enumerate(components)])
    return row.select(F.explode(cells).alias("s")).select("s.*")


def score_predictions(df: DataFrame, y: str, truth: str, prediction: str, sigma: str, sigma_true: str | None = None) -> DataFrame:
    """RMSE and R^2 against observed and noiseless truth, likelihood with 2 pi, coverage at 1.6449 and 1.96 sd, sd correlation."""
    r, s = F.col(y) - F.col(prediction), F.col(sigma)
    out = [F.sqrt(F.avg(r * r)).alias("rmse_observed"), F.sqrt(F.avg((F.col(truth) - F.col(prediction)) ** 2)).alias("rmse_true")]
    out += [(1 - F.sum((F.col(c) - F.col(prediction)) ** 2) / (F.var_pop(c) * F.count("*"))).alias(f"r2_{n}") for n, c in (("observed", y), ("true", truth))]
    out.append(F.avg(0.5 * F.log(2 * math.pi * s * s) + r * r / (2 * s * s)).alias("nll"))
    out += [F.avg(F.when(F.abs(r) <= q * s, 1.0).otherwise(0.0)).alias(n) for n, q in (("cover90", 1.6449), ("cover95", 1.96))]
    if sigma_true:
        out.append(F.corr(sigma, sigma_true).alias("sigma_corr"))
    return df.agg(*out)


def next_stages(explained: float, square_correlation: float) -> list[str]:
    """Interactions and complement if over 1 % is unexplained; a variance part if |corr(r^2, x)| exceeds 0.1."""
    return (["B", "C"] if 1 - explained > 0.01 else []) + (["D"] if square_correlation > 0.1 else [])


def variance_accounting(df: DataFrame, y: Column, prediction: Column) -> DataFrame:
    """Variance of y, of the prediction and of the residual, twice their covariance, and what explained and residual leave of the total."""
    rows = df.select(y.alias("y"), prediction.alias("f"), (y - prediction).alias("r"))
    v, f, r = F.var_pop("y"), F.var_pop("f"), F.var_pop("r")
    return rows.agg(v.alias("total"), f.alias("explained"), r.alias("residual"), (2 * F.covar_pop("f", "r")).alias("cross"), ((f + r) / v - 1).alias("additivity_gap"))


def haar_energy(df: DataFrame, x: str, residual: str, scales: int = 3) -> DataFrame:
    """Share of the residual's variance in each Haar scale of x, from the means of 2**scales cells; one aggregation.

    A wavelet's coefficient against cells of equal width is half the difference of its halves' means, times its amplitude.
    """
    n = 2**scales
    cell = F.least(F.floor(F.col(x) * n), F.lit(n - 1)).cast("int")
    cells = df.groupBy(cell.alias("cell")).agg(F.avg(residual).alias("m"))
    whole = df.agg(F.var_pop(residual).alias("v"))
    out = None
    for j in range(1, scales + 1):
        half = n >> j  # cells in half a wavelet
        parts = cells.groupBy(F.floor(F.col("cell") / half).alias("h")).agg((F.sum("m") / half).alias("m"))
        pairs = parts.groupBy(F.floor(F.col("h") / 2).alias("p")).agg(F.sum(F.when(F.col("h") % 2 == 0, F.col("m")).otherwise(-F.col("m"))).alias("d"))
        energy = pairs.agg((F.sum(F.col("d") ** 2) / (4 * 2 ** (j - 1))).alias("e")).select(F.lit(j).alias("scale"), "e")
        out = energy if out is None else out.unionByName(energy)
    v = whole.head()["v"]
    return out.select("scale", "e", (F.col("e") / F.lit(float(v) or 1.0)).alias("share"))


def verify(df: DataFrame, features: list[str], target: str, residual: str, sigma2: float) -> DataFrame:
    """check, value, ok: a fit's health as rows: centred residuals, noise that matches, uncorrelated residuals, normal coverage."""
    z = F.col(residual) / math.sqrt(sigma2)
    cells = [F.abs(F.avg(z)).alias("mean"), F.var_pop(z).alias("var"), F.avg(F.when(F.abs(z) <= 1.959963984540054, 1.0).otherwise(0.0)).alias("cover"), F.greatest(*[F.abs(F.corr(residual, c)) for c in features], F.lit(0.0)).alias("corr"), F.greatest(*[F.abs(F.corr(F.col(residual) ** 2, F.col(c))) for c in features], F.lit(0.0)).alias("square")]
    row = df.agg(*cells)
    rules = [("mean", F.col("mean") < 0.05), ("var", F.abs(F.col("var") - 1) < 0.2), ("cover", F.abs(F.col("cover") - 0.95) < 0.03), ("corr", F.col("corr") < 0.1), ("square", F.col("square") < 0.1)]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), ok.alias("ok")) for n, ok in rules])).alias("s")).select("s.*")
