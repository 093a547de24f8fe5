"""Saved models: coefficients, quantile knots and terms as Parquet, settings as one JSON row; never pickles."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from varlens.operators.prepare import Quantiles
from varlens.operators.residual import Complement, Features, Joint, whole_intervals
from varlens.operators.sensitivity import coefficients_table
from varlens.plans.layout import Layout, Spec, Term


@dataclass
class Model:
    """What prediction needs of a fit: the mean's part, and where they were kept the log-variance's and the complement's."""

    layout: Layout
    w: np.ndarray
    f0: float
    inverse: np.ndarray
    sigma2: float
    df_residual: float
    target: str
    quantiles: Quantiles | None = None
    n: float = 0.0
    noise: tuple[Layout, np.ndarray, float] | None = None
    complement: Complement | None = None

    def predict(self, df: DataFrame, level: float = 0.95) -> DataFrame:
        rows = self.quantiles.apply(df) if self.quantiles else df
        return whole_intervals(rows, self.layout, self.w, self.f0, self.inverse, self.sigma2, self.df_residual, self.n, level, self.noise, self.complement)


def of_result(result) -> Model:
    """The model of a fit, with all its parts."""
    s, part = result.solution, result.noise
    f0, inverse = (result.hetero.f0, result.hetero.solution.inverse) if part else (result.f0, s.inverse)
    return Model(result.layout, result.weights, f0, inverse, s.sigma2, s.df_residual, result.target, result.quantiles, s.n, (part.layout, part.w, part.h0) if part else None, result.complement)


def _terms(layout: Layout) -> dict:
    return {"features": list(layout.features), "terms": [{"vars": list(t.vars), "specs": [asdict(s) for s in t.specs], "mixed": t.mixed} for t in layout.terms]}


def _layout(meta: dict) -> Layout:
    return Layout(tuple(meta["features"]), tuple(Term(tuple(t["vars"]), tuple(Spec(**s) for s in t["specs"]), t.get("mixed", False)) for t in meta["terms"]))


def _write(spark: SparkSession, path: str, mode: str, **arrays: np.ndarray) -> None:
    """Matrices and vectors by name, a row of each matrix per row."""
    rows = [(name, i, [float(v) for v in np.atleast_1d(row)]) for name, a in arrays.items() if a is not None for i, row in enumerate(a)]
    spark.createDataFrame(rows, "name string, i int, row array<double>").write.mode(mode).parquet(path)


def _read(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A model's size, not the data's."""
    out: dict[str, list] = {}
    for r in spark.read.parquet(path).orderBy("name", "i").collect():
        out.setdefault(r["name"], []).append(r["row"])
    return {k: np.array(v) for k, v in out.items()}


def save(spark: SparkSession, model: Model, path: str, penalty: np.ndarray | None = None, overwrite: bool = False) -> None:
    """Write ``path``/coefficients, /columns, /inverse, /meta and, if there are any, /quantiles, /noise, /noise_coefficients and
    /complement. An existing path is an error by default."""
    mode = "overwrite" if overwrite else "errorifexists"
    r = np.zeros_like(model.w) if penalty is None else penalty
    meta = _terms(model.layout) | {"f0": model.f0, "sigma2": model.sigma2, "df_residual": model.df_residual, "n": model.n, "target": model.target, "quantiles": model.quantiles is not None, "noise": None, "complement": None, "format": 2}
    if model.noise:
        lay, w, h0 = model.noise
        meta["noise"] = _terms(lay) | {"h0": float(h0)}
        _write(spark, f"{path}/noise", mode, w=w)
        coefficients_table(spark, lay, w, np.zeros_like(w), "noise").write.mode(mode).parquet(f"{path}/noise_coefficients")
    if model.complement:
        c = model.complement
        z = c.joint.extra
        meta["complement"] = {"kind": z.kind, "scale": float(z.scale), "mse": float(c.mse), "df": float(c.df)}
        _write(spark, f"{path}/complement", mode, centres=z.centres, phase=z.phase, mix=z.mix, projection=c.projection, v=c.v, joint_w=c.joint_w)
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")
    spark.createDataFrame([(i, float(x), float(p)) for i, (x, p) in enumerate(zip(model.w, r, strict=True))], "column int, w double, penalty double").write.mode(mode).parquet(f"{path}/columns")
    coefficients_table(spark, model.layout, model.w, r).write.mode(mode).parquet(f"{path}/coefficients")
    _write(spark, f"{path}/inverse", mode, inverse=model.inverse)
    if model.quantiles:
        q = model.quantiles
        spark.createDataFrame([(i, n, [float(x) for x in q.refs], [float(x) for x in v]) for i, (n, v) in enumerate(zip(q.features, q.values, strict=True))], "i int, feature string, refs array<double>, quantiles array<double>").write.mode(mode).parquet(f"{path}/quantiles")


def load(spark: SparkSession, path: str) -> Model:
    meta = json.loads(spark.read.parquet(f"{path}/meta").head()[0])
    if meta.get("format") != 2:
        raise ValueError(f"{path} has format {meta.get('format')}; this version reads 2")
    layout = _layout(meta)
    w = np.array([r["w"] for r in spark.read.parquet(f"{path}/columns").orderBy("column").collect()])  # a model's size, not the data's
    quantiles = noise = complement = None
    if meta["quantiles"]:
        rows = spark.read.parquet(f"{path}/quantiles").orderBy("i").collect()
        quantiles = Quantiles(tuple(r["feature"] for r in rows), np.array(rows[0]["refs"]), np.array([r["quantiles"] for r in rows]))
    if meta["noise"]:
        noise = (_layout(meta["noise"]), _read(spark, f"{path}/noise")["w"][:, 0], meta["noise"]["h0"])
    if meta["complement"]:
        m, a = meta["complement"], _read(spark, f"{path}/complement")
        flat = lambda name: a[name][:, 0] if name in a else None
        extra = Features(m["kind"], a["centres"], m["scale"], flat("phase"), a.get("mix"))
        complement = Complement(Joint(layout, extra), a["projection"], flat("v"), flat("joint_w"), m["mse"], m["df"])
    return Model(layout, w, meta["f0"], _read(spark, f"{path}/inverse")["inverse"], meta["sigma2"], meta["df_residual"], meta["target"], quantiles, meta["n"], noise, complement)
