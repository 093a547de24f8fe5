"""The catalogue of core queries: each applies an operator to whole tables and returns its full result.

``query`` registers a function of (spark, sf_dir) and, where SQL can say the same, its SQL. Doubles are rounded
on both sides, because sums depend on their order.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varlens.functions.basis import basis_columns, gram, penalty
from varlens.operators import diagnostics, discovery, prepare, residual, ridge, rows, selection, sensitivity, variance
from varlens.operators.fit import fit
from varlens.operators.stats import stats_pass, total
from varlens.plans.layout import Layout, pairs_of, triples_of
from varlens.sources import synthetic

QUERIES: dict = {}
SQL: dict[str, str] = {}
PI2 = 2 * math.pi


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rd(c, n: int = 6):
    """Rounded, without negative zero."""
    return F.round(c, n) + F.lit(0.0)


def frac(c):
    return c - F.floor(c)


def tidy(df: DataFrame, n: int = 6) -> DataFrame:
    """``df`` with all doubles rounded."""
    return df.select(*[rd(F.col(c), n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def make(spark: SparkSession, data, schema: str) -> DataFrame:
    """A small driver-side result as a relation."""
    plain = lambda v: v.item() if isinstance(v, np.generic) else v
    return spark.createDataFrame([tuple(plain(v) for v in r) for r in data], schema)


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a design: key k, fold, x1 (price by range), x2 and x3 (hashed keys) in [0, 1], and a target y with known parts."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    o = prepare.minmax(o, ["o_totalprice"])
    k = F.col("o_orderkey").cast("double")
    d = o.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("x1"), frac(F.col("o_custkey").cast("double") * 0.6180339887498949).alias("x2"), frac(k * 0.7548776662466927).alias("x3"), (frac(k * 0.5698402909980532) - 0.5).alias("e"))
    y = 3 * F.cos(PI2 * F.col("x1")) + 2 * (F.col("x2") - 0.5) + 4 * (F.col("x1") - 0.5) * (F.col("x3") - 0.5) + 0.3 * F.col("e")
    return d.withColumn("y", y).drop("e")


P = """d AS (SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS fold, (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) AS x1,
  o_custkey * CAST(0.6180339887498949 AS DOUBLE) - floor(o_custkey * CAST(0.6180339887498949 AS DOUBLE)) AS x2,
  o_orderkey * CAST(0.7548776662466927 AS DOUBLE) - floor(o_orderkey * CAST(0.7548776662466927 AS DOUBLE)) AS x3,
  o_orderkey * CAST(0.5698402909980532 AS DOUBLE) - floor(o_orderkey * CAST(0.5698402909980532 AS DOUBLE)) - 0.5 AS e FROM orders),
p AS (SELECT k, fold, x1, x2, x3, 3 * cos(2 * pi() * x1) + 2 * (x2 - 0.5) + 4 * (x1 - 0.5) * (x3 - 0.5) + 0.3 * e AS y FROM d)"""


def R(x, n=6):
    """Rounding in SQL."""
    return f"round({x}, {n}) + 0.0"


def projections(spark: SparkSession, sf_dir: str, layout: Layout) -> np.ndarray:
    """Mean products of the planted target, centred, with every function of a layout: the coefficients that later queries show."""
    s = stats_pass(planted(spark, sf_dir), layout, "y")[None].centred()
    return s.b / s.n


def W(functions: list[str]) -> str:
    """The same as a relation w(i, w)."""
    return f"{P}, z AS (SELECT *, y - (SELECT avg(y) FROM p) AS z FROM p), a AS (SELECT [{', '.join(f'avg(z * {f})' for f in functions)}] AS l FROM z), w AS (SELECT CAST(i AS INTEGER) AS i, l[i + 1] AS w FROM a, (SELECT unnest(range(0, {len(functions)})) AS i))"


def fourier_sql(x: str, k: int) -> list[str]:
    return [f"({x} - 0.5)", *(f"{f}({2 * j} * pi() * {x})" for j in range(1, k + 1) for f in ("cos", "sin"))]


def legendre_sql(x: str, k: int) -> list[str]:
    z = f"(2 * {x} - 1)"
    return [z, f"((3 * pow({z}, 2) - 1) / 2)", f"((5 * pow({z}, 3) - 3 * {z}) / 2)", f"((35 * pow({z}, 4) - 30 * pow({z}, 2) + 3) / 8)"][:k]


def haar_sql(x: str, k: int) -> list[str]:
    out = []
    for j in range(1, k + 1):
        n = 2 ** (j - 1)
        a = f"sqrt({n}::DOUBLE)"
        out += [f"(CASE WHEN least(floor({x} * {2 * n}), {2 * n - 1}) = {2 * q} THEN {a} WHEN least(floor({x} * {2 * n}), {2 * n - 1}) = {2 * q + 1} THEN -{a} ELSE 0 END)" for q in range(n)]
    return out


# --- preparation -------------------------------------------------------------------------------------------

_CHECKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS n_null, count(*) FILTER (WHERE isnan({c}) OR isinf({c})) AS n_bad, {R(f'min({c})')} AS lo, {R(f'max({c})')} AS hi FROM lineitem" for c in _CHECKED))
def input_checks(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(*_CHECKED)
    prepare.check_inputs(d, _CHECKED[1:], _CHECKED[0])
    c = lambda n: F.col(n)
    row = d.agg(*[F.struct(F.lit(n).alias("feature"), F.count("*").alias("n"), F.count_if(c(n).isNull()).alias("n_null"), F.count_if(F.isnan(n) | (F.abs(n) == float("inf"))).alias("n_bad"), rd(F.min(n)).alias("lo"), rd(F.max(n)).alias("hi")).alias(n) for n in _CHECKED])
    return row.select(F.explode(F.array(*_CHECKED)).alias("s")).select("s.*")


@query(f"WITH l AS (UNPIVOT (SELECT {', '.join(_CHECKED)} FROM lineitem) ON {', '.join(_CHECKED)} INTO NAME feature VALUE v), c AS (SELECT feature, v, count(*) AS n FROM l GROUP BY ALL) SELECT feature, count(*) AS n_distinct, {R('max(n) / CAST(sum(n) AS DOUBLE)')} AS max_share, count(*) < 10 OR max(n) / CAST(sum(n) AS DOUBLE) > 0.2 AS tied FROM c GROUP BY feature")
def tied_columns(spark, sf_dir):
    return tidy(prepare.tied_columns(table(spark, sf_dir, "lineitem"), _CHECKED))


_SPLIT = "CASE WHEN o_orderkey % 20 < 14 THEN 'train' WHEN o_orderkey % 20 < 17 THEN 'val' ELSE 'test' END"


@query(f"SELECT o_orderkey AS k, {_SPLIT} AS split FROM orders")
def split_assign(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), prepare.split_by_key(F.col("o_orderkey")).alias("split"))


@query(f"SELECT {_SPLIT} AS split, count(*) AS n FROM orders GROUP BY 1")
def split_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(prepare.split_by_key(F.col("o_orderkey")).alias("split")).agg(F.count("*").alias("n"))


_TENTHS = ", ".join(f"{i / 10}::DOUBLE" for i in range(11))


@query(f"WITH q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [{_TENTHS}]) AS v FROM orders) SELECT CAST(i AS INTEGER) AS knot, {R('v[i + 1]', 4)} AS value FROM q, (SELECT unnest(range(0, 11)) AS i)")
def quantile_knots(spark, sf_dir):
    q = prepare.Quantiles.fit(table(spark, sf_dir, "orders"), ["o_totalprice"], 11)
    return make(spark, [(i, round(v, 4)) for i, v in enumerate(q.values[0])], "knot int, value double")


@query(f"""WITH q AS (SELECT quantile_cont(CAST(c_acctbal AS DOUBLE), [0.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 1.0::DOUBLE]) AS v FROM customer),
s AS (SELECT i, v[i + 1] AS a, v[i + 2] AS b FROM q, (SELECT unnest(range(0, 4)) AS i))
SELECT c_custkey AS k, {R('max(0.25 * (i + (c_acctbal - a) / (b - a)))')} AS u FROM customer JOIN s ON c_acctbal >= a AND c_acctbal <= b GROUP BY c_custkey""")
def quantile_apply(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return prepare.Quantiles.fit(c, ["c_acctbal"], 5).apply(c).select(F.col("c_custkey").alias("k"), rd(F.col("c_acctbal")).alias("u"))


@query("WITH q AS (SELECT quantile_cont(CAST(c_acctbal AS DOUBLE), [0.25::DOUBLE, 0.75::DOUBLE]) AS v FROM customer) SELECT c_custkey AS k, c_acctbal < v[1] OR c_acctbal > v[2] AS outside FROM customer, q")
def out_of_range_flags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    q = prepare.Quantiles.fit(c, ["c_acctbal"], 5)
    inner = prepare.Quantiles(q.features, q.refs[1:4], q.values[:, 1:4])
    return c.select(F.col("c_custkey").alias("k"), inner.outside().alias("outside"))


@query(f"SELECT p_partkey AS k, {R('(p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())')} AS u FROM part")
def minmax_scale(spark, sf_dir):
    p = prepare.minmax(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    return p.select(F.col("p_partkey").alias("k"), rd(F.col("p_retailprice")).alias("u"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey % 5 AS INTEGER) AS strided, CAST(CASE WHEN o_orderkey < n % 7 * (n // 7 + 1) THEN o_orderkey // (n // 7 + 1) ELSE n % 7 + (o_orderkey - n % 7 * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS contiguous, CAST(least(o_orderkey // (n // 7), 6) AS INTEGER) AS remainder_last FROM orders, (SELECT count(*) AS n FROM orders)")
def kfold_assign(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    n, k = o.count(), F.col("o_orderkey")
    return o.select(k.alias("k"), prepare.fold_by_rank(k, n, 5).alias("strided"), prepare.fold_by_rank(k, n, 7, "contiguous").alias("contiguous"), prepare.fold_by_rank(k, n, 7, "remainder_last").alias("remainder_last"))


# --- bases, Gram matrices, penalties -----------------------------------------------------------------------


def _long(spark, sf_dir, columns, n=6):
    d = planted(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(i).alias("b"), rd(c, n).alias("v")) for i, c in enumerate(columns)])
    return d.select("k", F.explode(cells).alias("s")).select("k", "s.*")


def _long_sql(values, n=6):
    return f"WITH {P} SELECT k, CAST(b AS INTEGER) AS b, {R('v', n)} AS v FROM (" + " UNION ALL ".join(f"SELECT k, {i} AS b, {v} AS v FROM p" for i, v in enumerate(values)) + ")"


_F2 = ["{x} - 0.5", "cos(2 * pi() * {x})", "sin(2 * pi() * {x})", "cos(4 * pi() * {x})", "sin(4 * pi() * {x})"]
_L3 = ["(2 * {x} - 1)", "(1.5 * pow(2 * {x} - 1, 2) - 0.5)", "(2.5 * pow(2 * {x} - 1, 3) - 1.5 * (2 * {x} - 1))"]


def _haar_sql(x, j, p):
    n = 2 ** (j - 1)
    right = f"{x} <= {(p + 1) / n}" if p == n - 1 else f"{x} < {(p + 1) / n}"
    return f"(CASE WHEN {x} >= {p / n} AND {x} < {(p + 0.5) / n} THEN 1 WHEN {x} >= {(p + 0.5) / n} AND {right} THEN -1 ELSE 0 END * sqrt({n}::DOUBLE))"


_H2 = [_haar_sql("{x}", 1, 0), _haar_sql("{x}", 2, 0), _haar_sql("{x}", 2, 1)]


@query(_long_sql([f.format(x="x1") for f in _F2]))
def basis_fourier(spark, sf_dir):
    return _long(spark, sf_dir, basis_columns(F.col("x1"), 2, "fourier"))


@query(_long_sql([f.format(x="x2") for f in _L3]))
def basis_legendre(spark, sf_dir):
    return _long(spark, sf_dir, basis_columns(F.col("x2"), 3, "legendre"))


@query(_long_sql([f.format(x="x1") for f in _H2]))
def basis_haar(spark, sf_dir):
    return _long(spark, sf_dir, basis_columns(F.col("x1"), 2, "haar"))


@query(_long_sql([f"({a.format(x='x1')}) * ({b.format(x='x2')})" for a in _F2[:3] for b in _F2[:3]]))
def basis_pair_outer(spark, sf_dir):
    lay = Layout.build(["x1", "x2"], 1, 1)
    return _long(spark, sf_dir, lay.columns()[lay.offsets[2] :])


@query(_long_sql([f"({a.format(x='x1')}) * ({b.format(x='x2')}) * ({c.format(x='x3')})" for a in _L3[:2] for b in _L3[:2] for c in _L3[:2]]))
def basis_triple_outer(spark, sf_dir):
    lay = Layout.build(["x1", "x2", "x3"], 1, 0, 2, basis="legendre")
    return _long(spark, sf_dir, lay.columns()[lay.offsets[3] :])


@query(_long_sql([f.format(x="x1") for f in _L3[:2]] + [f.format(x="x2") for f in _F2[1:3]] + [f"{a.format(x='x1')} * {b.format(x='x2')}" for a in _L3[:2] for b in _F2[1:3]]))
def basis_mixed(spark, sf_dir):
    lay = Layout.build(["x1", "x2"], pairs=[(0, 1)], k2=1, per_variable=[("legendre", 2), ("fourier", 1)])
    return _long(spark, sf_dir, lay.columns())


def _weighed(spark, sf_dir, lay, m):
    """A matrix between the coefficients that the table gives a layout's functions: their sum is the variance."""
    w = projections(spark, sf_dir, lay)
    return make(spark, [(i, j, round(float(v), 9) + 0.0) for (i, j), v in np.ndenumerate(m * np.outer(w, w))], "i int, j int, v double")


def _weighed_sql(functions, entry):
    return f"WITH {W(functions)}, q AS (SELECT a.i, b.i AS j, a.w * b.w AS w FROM w a, w b) SELECT i, j, {R(f'w * ({entry})', 9)} AS v FROM q"


_IJ = "(SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS i), (SELECT CAST(unnest(range(0, {n})) AS INTEGER) AS j)"


@query(_weighed_sql(fourier_sql("x1", 3), "CASE WHEN i = 0 AND j = 0 THEN 1 / 12.0::DOUBLE WHEN i = j THEN 0.5 WHEN least(i, j) = 0 AND greatest(i, j) % 2 = 0 THEN -1 / (pi() * greatest(i, j)) ELSE 0 END"))
def gram_fourier(spark, sf_dir):
    return _weighed(spark, sf_dir, Layout.build(["x1"], 3), gram(3))


@query(_weighed_sql(legendre_sql("x2", 4), "CASE WHEN i = j THEN 1 / (2.0::DOUBLE * i + 3) ELSE 0 END"))
def gram_legendre(spark, sf_dir):
    return _weighed(spark, sf_dir, Layout.build(["x2"], 4, basis="legendre"), gram(4, "legendre"))


@query(_weighed_sql(haar_sql("x1", 3), "CASE WHEN i = j THEN 1 ELSE 0 END"))
def gram_haar(spark, sf_dir):
    return _weighed(spark, sf_dir, Layout.build(["x1"], 3, basis="haar"), gram(3, "haar"))


def _pair(a, b, **options):
    """A layout of the pair alone."""
    lay = Layout.build([a, b], **options)
    return lay.select([2])[0]


def _products(a, b):
    return [f"{f} * {g}" for f in a for g in b]


@query(_weighed_sql(_products(legendre_sql("x1", 2), legendre_sql("x3", 2)), "CASE WHEN i = j THEN 1 / ((2.0::DOUBLE * (i // 2) + 3) * (2 * (i % 2) + 3)) ELSE 0 END"))
def gram_kron(spark, sf_dir):
    lay = _pair("x1", "x3", k1=2, k2=2, basis="legendre")
    return _weighed(spark, sf_dir, lay, lay.terms[0].gram())


_PEN = {
    "uniform": "0.01",
    "variance": "0.01 * CASE WHEN i = 0 THEN 1 / 12.0::DOUBLE ELSE 0.5 END",
    "smoothness": "0.01 * CASE WHEN i = 0 THEN 1 ELSE pow(2 * pi() * ((i + 1) // 2), 2) / 2 END",
    "curvature": "0.01 * CASE WHEN i = 0 THEN 1e-6 ELSE pow(2 * pi() * ((i + 1) // 2), 4) / 2 END",
    "sobolev_1.5": "0.01 * CASE WHEN i = 0 THEN 1 ELSE pow(1 + pow(2 * pi() * ((i + 1) // 2), 2), 1.5) END",
    "spectral_2": "0.01 * CASE WHEN i = 0 THEN 1 ELSE pow((i + 1) // 2, 2) END",
}


@query(f"WITH {W(fourier_sql('x1', 2))} " + " UNION ALL ".join(f"SELECT '{s}' AS strategy, i, {R(f'w * w * CAST({v} AS DOUBLE)', 9)} AS r FROM w" for s, v in _PEN.items()))
def penalty_strategies(spark, sf_dir):
    """What each strategy charges the coefficients that the table gives x1's functions."""
    w = projections(spark, sf_dir, Layout.build(["x1"], 2))
    return make(spark, [(s, i, round(float(v * w[i] ** 2), 9) + 0.0) for s in _PEN for i, v in enumerate(penalty(2, 0.01, s))], "strategy string, i int, r double")


_C1 = "CASE WHEN {i} = 0 THEN 1e-6 ELSE pow(2 * pi(), 4) / 2 END"
_V1 = "CASE WHEN {i} = 0 THEN 1 / 12.0::DOUBLE ELSE 0.5 END"


@query(f"WITH {W(_products(fourier_sql('x1', 1), fourier_sql('x3', 1)))}, q AS (SELECT i // 3 AS i, i % 3 AS j, w * w AS w FROM w) SELECT 'curvature' AS strategy, i, j, {R(f'w * 0.1 * ({_C1.format(i='i')} + {_C1.format(i='j')})')} AS r FROM q UNION ALL SELECT 'variance', i, j, {R(f'w * 0.1 * {_V1.format(i='i')} * {_V1.format(i='j')}')} FROM q")
def penalty_pair(spark, sf_dir):
    lay = _pair("x1", "x3", k1=1, k2=1)
    w = projections(spark, sf_dir, lay)
    return make(spark, [(s, n // 3, n % 3, round(float(v * w[n] ** 2), 6) + 0.0) for s in ("curvature", "variance") for n, v in enumerate(lay.terms[0].penalty(0.1, s))], "strategy string, i int, j int, r double")


def _mixed_pair(spark, sf_dir, bases):
    lay = _pair("x1", "x3", k2=1, per_variable=bases)
    w = projections(spark, sf_dir, lay)
    return make(spark, [(n // 2, n % 2, round(float(v * w[n] ** 2), 9) + 0.0) for n, v in enumerate(lay.terms[0].penalty(0.1, "variance"))], "i int, j int, r double")


@query(f"WITH {W(_products(legendre_sql('x1', 2), fourier_sql('x3', 1)[1:]))}, q AS (SELECT i // 2 AS i, i % 2 AS j, w * w AS w FROM w) SELECT i, j, {R('w * 0.1 * (1 / (2.0::DOUBLE * i + 3) + 0.5)', 9)} AS r FROM q")
def penalty_mixed(spark, sf_dir):
    return _mixed_pair(spark, sf_dir, [("legendre", 2), ("fourier", 1)])


@query(f"WITH {W(_products(legendre_sql('x1', 2), legendre_sql('x3', 2)))}, q AS (SELECT i // 2 AS i, i % 2 AS j, w * w AS w FROM w) SELECT i, j, {R('w * 0.1 * (1 / (2.0::DOUBLE * i + 3) + 1 / (2.0::DOUBLE * j + 3))', 9)} AS r FROM q")
def penalty_mixed_equal(spark, sf_dir):
    """In a layout with a basis for each variable, pairs of equal bases are additive too."""
    return _mixed_pair(spark, sf_dir, [("legendre", 2), ("legendre", 2)])


# --- term structure ----------------------------------------------------------------------------------------

_V = "v AS (SELECT CAST(r_regionkey AS INTEGER) AS i, r_regionkey IN (1, 3) AS a FROM region)"


@query(f"WITH {_V} SELECT m.mode, x.i, y.i AS j FROM v x JOIN v y ON x.i < y.i JOIN (VALUES ('all'), ('both'), ('either')) m(mode) ON m.mode = 'all' OR (m.mode = 'both' AND x.a AND y.a) OR (m.mode = 'either' AND (x.a OR y.a))")
def candidate_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "region").count()
    return make(spark, [(m, *p) for m in ("all", "both", "either") for p in pairs_of(d, None if m == "all" else [1, 3], m)], "mode string, i int, j int")


@query(f"WITH {_V} SELECT m.mode, x.i, y.i AS j, z.i AS k FROM v x JOIN v y ON x.i < y.i JOIN v z ON y.i < z.i JOIN (VALUES ('all', 0), ('one_active', 1), ('two_active', 2), ('all_active', 3)) m(mode, least) ON CAST(x.a AS INT) + CAST(y.a AS INT) + CAST(z.a AS INT) >= m.least")
def candidate_triples(spark, sf_dir):
    d = table(spark, sf_dir, "region").count()
    return make(spark, [(m, *p) for m in ("all", "one_active", "two_active", "all_active") for p in triples_of(d, [1, 3], m)], "mode string, i int, j int, k int")


@query(f"WITH {_V} SELECT x.i, y.i AS j FROM v x JOIN v y ON x.i < y.i WHERE NOT (x.i = 0 AND y.i = 1) AND NOT (x.i = 2 AND y.i = 4)")
def missing_pairs(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("i"))
    every = r.join(r.select(F.col("i").alias("j")), F.col("i") < F.col("j"))
    return every.join(make(spark, [(0, 1), (2, 4)], "i int, j int"), ["i", "j"], "left_anti")


@query(f"WITH {W([legendre_sql(x, 1)[0] for x in ('x1', 'x2', 'x3')] + [f'cos(2 * pi() * {x})' for x in ('x1', 'x2', 'x3')])}, v AS (SELECT i % 3 AS v, sum(w * w) AS s FROM w GROUP BY 1), r AS (SELECT v, s / sum(s) OVER () AS s, row_number() OVER (ORDER BY s DESC, v) AS n FROM v) SELECT CAST(v AS INTEGER) AS v FROM r WHERE s > 0.05 OR n <= 2")
def active_variables(spark, sf_dir):
    """Variables with over a twentieth of the energy of their linear function and their first cosine, two at least."""
    names = ["x1", "x2", "x3"]
    w = np.concatenate([projections(spark, sf_dir, Layout.build(names, 1, basis="legendre")), projections(spark, sf_dir, Layout.build(names, 1, linear=False))[::2]])
    energy = w[:3] ** 2 + w[3:] ** 2
    return make(spark, [(v,) for v in selection.active_variables(dict(enumerate(energy / energy.sum())), 0.05)], "v int")


_TWO = fourier_sql("x1", 1) + fourier_sql("x3", 1) + _products(fourier_sql("x1", 1), fourier_sql("x3", 1))


@query(f"WITH {W(_TWO)}, t(term_id, ord, basis, k, \"offset\", size) AS (VALUES (0, 1, 'fourier', 1, 0, 3), (1, 1, 'fourier', 1, 3, 3), (2, 2, 'fourier', 1, 6, 9)) SELECT t.*, {R('(SELECT sum(w * w) FROM w WHERE i >= t.\"offset\" AND i < t.\"offset\" + t.size)')} AS energy FROM t")
def layout_terms(spark, sf_dir):
    """The terms of a layout, with the energy that the table gives each one's functions."""
    lay = Layout.build(["x1", "x3"], 1, 1)
    w = projections(spark, sf_dir, lay)
    energy = make(spark, [(n, round(float((w[lay.block(n)] ** 2).sum()), 6)) for n in range(3)], "term_id int, energy double")
    return lay.relation(spark).drop("vars").join(energy, "term_id")
