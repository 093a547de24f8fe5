"""Quality classifier by positive-unlabelled learning.

Trusted positives are label-1 texts; the unlabelled set is a hash-ordered sample of all web text, its
labels unseen. With class prior p, positive loss P+, P- and unlabelled loss U-, a linear model minimises
the non-negative unbiased risk ``p P+ + max(0, U- - p P-)`` under the logistic loss: where the second
part of a mini-batch falls below zero, the step goes the other way. The prior is the share of
label 1 among labelled training rows, which holds if rows were picked for labelling whatever their
quality. A scale and an offset, fitted on the same labelled training rows, turn the margin into a
probability.

A text's features are the frequencies of its bytes and of runs of three character classes, and a few
measures of words and lines; never its id, language, source or labels.

Scale: the sample is bounded by ``positives`` and ``unlabelled`` (and ``checked`` for the scale), rows that
reach the driver as features and, as ids of that bounded number, are broadcast; scoring is one pass
over whole texts without any shuffle.

Defined results: null and empty texts are scored by the features of the empty text; repeated label
rows for a document count as label 1 only if all say 1; null labels are ignored; without any positive
label every text scores the prior; repeated documents score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.session import held, ship

#: Character classes of bytes: control and space, digit, lower, upper, sentence marks, brackets and quotes, other ASCII, non-ASCII.
_CLASS = np.full(256, 6, np.uint16)
_CLASS[:33] = 0
_CLASS[48:58] = 1
_CLASS[97:123] = 2
_CLASS[65:91] = 3
_CLASS[[ord(c) for c in ".,;:-!?"]] = 4
_CLASS[[ord(c) for c in "\"'()[]{}<>"]] = 5
_CLASS[128:] = 7
WIDTH = 256 + 512 + 9


def features(text: bytes | None) -> np.ndarray:
    """float32 features of a whole text."""
    out = np.zeros(WIDTH, np.float32)
    text = text or b""
    if text:
        x = np.frombuffer(text, np.uint8)
        out[:256] = np.sqrt(np.bincount(x, minlength=256) / len(x))
        if len(x) > 2:
            c = _CLASS[x]
            out[256:768] = np.sqrt(np.bincount(c[:-2] * 64 + c[1:-1] * 8 + c[2:], minlength=512) / (len(x) - 2))
    words = text.split()
    n = len(words)
    if n:
        different = len(set(words))
        doubled = sum(map(bytes.__eq__, words, words[1:]))
        lines = text.split(b"\n")
        lengths = np.fromiter(map(len, words), np.float32, n)
        out[768:] = (np.log1p(n), different / n, np.log(different + 1) / np.log(n + 1), doubled / n, lengths.mean() / 10, lengths.std() / 10, np.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines) / 100)
    return out


def fit(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
    """(mean, scale, weights, offset) minimising the non-negative risk by Adam steps on mini-batches of rows of ``x``."""
    both = np.concatenate([positive, unlabelled])
    sums = np.zeros((2, x.shape[1]))
    for a in range(0, len(both), 1024):
        part = x[both[a : a + 1024]].astype(np.float64)
        sums += part.sum(axis=0), (part * part).sum(axis=0)
    mean = sums[0] / len(both)
    scale = np.sqrt(np.maximum(sums[1] / len(both) - mean**2, 0)) + 1e-3
    rows = lambda i: np.clip((x[i].astype(np.float32) - mean) / scale, -6, 6)
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1] + 1)
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(unlabelled), max(1, len(unlabelled) // batch)):
            xu, xp = rows(at), rows(rng.choice(positive, len(at)))
            zu, zp = xu @ w[:-1] + w[-1], xp @ w[:-1] + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gu, gp = sigmoid(zu) / len(zu), prior * sigmoid(zp) / len(zp)
            if negative >= 0:
                du, dp = gu, -prior * sigmoid(-zp) / len(zp) - gp
            else:
                du, dp = -gu, gp
            g = np.append(du @ xu + dp @ xp, du.sum() + dp.sum())
            g[:-1] += decay * w[:-1]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return mean, scale, w[:-1], w[-1]


def margin(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w, b = model
    return np.clip((x - mean) / scale, -6, 6) @ w + b


def fit_scale(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on z with targets drawn in from 0 and 1, by damped Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n0 or not n1:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    s = max(float(np.abs(z).mean()), 1e-9)
    x = np.stack([z / s, np.ones_like(z)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(rounds):
        q = 0.5 * (1 + np.tanh(x @ c / 2))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * len(z) * np.eye(2)
        c -= np.clip(np.linalg.solve(h, x.T @ (q - t) + 1e-6 * len(z) * c), -2, 2)
    return float(c[0] / s), float(c[1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 6000, unlabelled: int = 12000, checked: int = 6000):
    """(model, scale, offset) or, without positives, the prior alone. ``learn``: of doc_id, whether its label may be seen."""
    ship(docs.sparkSession)
    key = F.xxhash64("doc_id", F.lit("quality"))
    known = labels.filter(F.col("quality").isNotNull() & learn).groupBy("doc_id").agg(F.min("quality").alias("q"))
    n, n1 = (known.agg(F.count("*"), F.sum(F.col("q").cast("long"))).head()) or (0, 0)
    prior = ((n1 or 0) + 1) / (n + 2)
    # Each part is bounded by its parameter, so their ids may be broadcast and their features collected.
    parts = [
        known.filter("q = 1").orderBy(key, "doc_id").limit(positives).select("doc_id", F.lit(0).alias("part"), F.lit(1).alias("q")),
        docs.filter(learn).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("web")), "doc_id").limit(unlabelled).select("doc_id", F.lit(1).alias("part"), F.lit(0).alias("q")),
        known.orderBy(F.xxhash64("doc_id", F.lit("check")), "doc_id").limit(checked).select("doc_id", F.lit(2).alias("part"), "q"),
    ]
    sample = [tuple(r) for p in parts for r in p.collect() if r["doc_id"] is not None]
    ids = docs.sparkSession.createDataFrame(sample, "_id long, part int, q int")

    def run(batches):
        held("quality")
        for b in batches:
            x = [features(t).astype(np.float16).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "x": pa.array(x, pa.binary())})

    seen = ids.select("_id").distinct()
    got = docs.join(F.broadcast(seen), F.col("doc_id") == F.col("_id"), "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary")
    got = got.groupBy("doc_id").agg(F.min("x").alias("x"))  # rows that share an id: one of them, whatever the order
    place: dict[int, int] = {}
    x = np.empty((len(sample), WIDTH), np.float16)
    for r in got.collect():  # as many as ids were sampled, at most
        x[len(place)] = np.frombuffer(r["x"], np.float16)
        place[r["doc_id"]] = len(place)
    rows = [[(place[i], q) for i, part, q in sorted(sample) if part == k and i in place] for k in range(3)]
    if not rows[0] or not rows[1]:
        return None, prior, 0.0
    model = fit(x, np.array([i for i, _ in rows[0]]), np.array([i for i, _ in rows[1]]), prior)
    model = tuple(np.asarray(p, np.float64) for p in model)
    z = np.concatenate([margin(model, x[i : i + 1].astype(np.float64)) for i, _ in rows[2]])
    return model, *fit_scale(z, np.array([q for _, q in rows[2]], float))


def probability(trained, texts: list[bytes | None]) -> np.ndarray:
    """Scores of whole texts, 0 to 1."""
    model, a, b = trained
    if model is None:
        return np.full(len(texts), a)
    z = np.array([margin(model, features(t)) for t in texts], np.float64)
    return 0.5 * (1 + np.tanh((a * z + b) / 2))


def score_texts(docs: DataFrame, trained, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of whole texts."""

    def run(batches):
        held("quality")
        for batch in batches:
            score = probability(trained, batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def fold(doc_id, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; the null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def accepted(docs: DataFrame, trained, threshold: float = 0.3) -> DataFrame:
    """``docs`` that the model accepts, all columns kept."""

    def run(batches):
        held("quality")
        for batch in batches:
            score = probability(trained, batch.column("text").cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(score >= threshold))

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
