"""Whitening, source divergence and language identification against direct computation, and odd rows."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.llm import divergence, lang_id, whitening
from varlens.llm.queries import queries

DATA = os.environ.get("VARLENS_TEST_DATA", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def vectors(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def check_whitening(rows, got, components=16):
    """``rows`` are (id, vector) that remain."""
    x = {i: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, dims = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(dims)]
    centre = lambda v: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)])
    c = np.array([centre(v) for v in fit])
    # Another way to the same components: singular values of the centred rows.
    _, sizes, right = np.linalg.svd(c / math.sqrt(n), full_matrices=False)
    values = sizes**2
    k = min(components, int((values > values[0] * 1e-12).sum()))
    by = defaultdict(dict)
    for g in got:
        by[g["vec_id"]][g["component"]] = g
    assert set(by) == set(x) and all(set(b) == set(range(1, k + 1)) for b in by.values())
    assert all(g["n"] == n and g["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[g["vec_id"]], sums, strict=True)) for g in got)
    w = np.array([[by[i][j + 1]["whitened"] for j in range(k)] for i in sorted(by)])
    want = np.array([centre(x[i]) @ right[:k].T / sizes[:k] for i in sorted(by)])
    for j in range(k):
        if all(abs(values[j] - values[m]) > 1e-6 * values[0] for m in range(len(values)) if m != j):
            assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-6
        assert abs(by[min(by)][j + 1]["explained"] / (values[j] / values.sum()) - 1) < 1e-9
    assert len({g["identity_error"] for g in got}) == 1 and got[0]["identity_error"] < 1e-9


@tables
def test_whitening_of_a_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check_whitening(rows, queries()["op11_whitening"](spark, DATA).collect())


def test_whitening_of_odd_rows(spark):
    r = random.Random(4)
    good = [(i, [r.uniform(-3, 3), r.uniform(-1, 1), r.gauss(0, 2), 0.25]) for i in range(40)]
    good += [(100, good[0][1]), (101, [1e3, -1e3, 5.0, 0.25])]  # a copy, and a vector far from the others
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0]), (202, [float("nan"), 1.0, 1.0, 1.0]), (203, [1.0, float("inf"), 1.0, 1.0]), (204, [1.0, 2.0]), (205, []), (206, [1e30, 1.0, 1.0, 1.0])]
    df = vectors(spark, [(*v, 9, 9) for v in good + bad], ", n long, component int").repartition(5)
    got = whitening.whiten(df).collect()
    check_whitening(good, got)
    assert all(g["component"] <= 3 for g in got)  # the fourth dimension does not vary
    again = whitening.whiten(vectors(spark, good[:40] + good[:1] + [(None, good[1][1])])).collect()
    assert Counter(g["vec_id"] for g in again)[0] == 6 and Counter(g["vec_id"] for g in again)[None] == 3
    assert len({g["n"] for g in again}) == 1 and again[0]["n"] == 40  # copies enter the fit once


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert same.collect() == [] and same.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_exact_integers_beyond_64_bits():
    x = np.array([[1 << 50, 1], [-(1 << 50), 3]], np.int64)
    n, sums = 1 << 20, [12345, (1 << 70) + 1]
    v = whitening.centred_integers(x, n, sums)
    assert [[int(a) for a in row] for row in v] == [[n * int(a) - s for a, s in zip(row, sums, strict=True)] for row in x]
    assert whitening.deviations(v) == [None, None]
    assert whitening.deviations(np.array([[1 << 31, 1 << 31], [3, 4]], np.int64)) == [None, 25]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def direct_audit(rows, least, ranks):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(TERM.findall(lower(text or "")))
        counts[lang, source] += terms
        sources[lang].add(source)
        docs[lang].update(set(terms))
    out = set()
    for lang, names in sources.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        whole = {t: sum(counts[lang, s][t] for s in names) for t in kept}
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][u] for u in kept)) for t in kept} for s in names}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in names:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in names if o != s]
            above = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(names)), ("term", above, ranks)):
                items.sort(key=lambda i: (-i[1], i[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])}
    return out


def test_divergence_of_odd_rows(spark):
    r = random.Random(6)
    words = ["the", "The", "été", "中文", "a1b", "x_y", "don't", "ÀB", "naïve\U0001f600z", "q" * 40, "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(r.choice(words[: r.randint(3, len(words))]) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", None]), r.choice(["a", "b", "ü", None, ""])) for _ in range(300)]
    rows += [(None, "en", "a"), ("", None, None), ("alone here", "one", "only"), ("ends with", "en", "c"), ("letters", "en", "c"), (" ".join(words * 4000), "fr", "long"), rows[0], rows[0]]
    rows += [("nothing kept", "rare", "a"), ("123 ...", "rare", "b")]
    df = spark.createDataFrame([(*x, 5, 1) for x in rows], "text string, lang string, source string, value long, rank int").repartition(7)
    for block in (100_000, 20):
        got = {tuple(g[c] for c in ("lang", "source", "part", "item", "value", "rank")) for g in divergence.audit(df, least=5, ranks=8, block=block).collect()}
        assert got == direct_audit(rows, 5, 8)
    assert any(g[0] == "rare" and g[2:5] == ("pair", "b", 0) for g in got) and not any(g[0] == "one" for g in got)
    assert divergence.audit(df.limit(0)).collect() == []


def test_terms_end_with_their_text_and_hashes_are_the_librarys():
    import xxhash

    r = random.Random(2)
    texts = ["ab", "cd", "", "e f", "É" * 30, "g" * 100, "1h"]
    raw = [t.encode() for t in texts]
    data, starts, sizes, number = divergence.slices(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]))
    got = [(int(n), data[s : s + k].tobytes().decode()) for s, k, n in zip(starts, sizes, number, strict=True)]
    assert got == [(0, "ab"), (1, "cd"), (3, "e"), (3, "f"), (4, "É" * 30), (5, "g" * 100), (6, "h")]
    slices = [bytes(r.randrange(1, 256) for _ in range(r.randrange(0, 40))) for _ in range(500)]
    size = np.array([len(s) for s in slices])
    found = divergence.hashes(np.frombuffer(b"".join(slices), np.uint8), np.cumsum(size) - size, size)
    assert [int(h) for h in found] == [xxhash.xxh64_intdigest(s) for s in slices]


def test_terms_with_one_hash_stay_apart():
    words = [b"one", b"two", b"one", b"three", b"two", b"six"]
    size = np.array([len(w) for w in words])
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
    group, first = divergence.grouped(data, starts, size, np.zeros(len(words), np.uint64))
    named = [data[starts[first[g]] : starts[first[g]] + size[first[g]]].tobytes() for g in group]
    assert named == words and len(first) == 4


def test_shares_beyond_64_bits():
    count, total = np.array([10**12, 3], np.int64), np.array([3 * 10**12, 10**13], np.int64)
    assert divergence._shares(count, total).tolist() == [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(count, total, strict=True)]


def phrases(text: bytes, reference: bytes) -> int:
    """Greedy longest matches in pieces, by searching substrings."""
    fold = lambda b: re.sub(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]+", b" ", b).lower()
    text, reference, n = fold(text), fold(reference), 0
    for a in range(0, len(text), lang_id.PIECE):
        piece, at = text[a : a + lang_id.PIECE], 0
        while at < len(piece):
            size = 1
            while at + size < len(piece) and piece[at : at + size + 1] in reference:
                size += 1
            at, n = at + (size if piece[at : at + 1] in reference else 1), n + 1
    return n


def test_phrases_by_substring_search():
    r = random.Random(8)
    make = lambda letters, n: "".join(r.choice(letters) for _ in range(n)).encode()
    known = [("a", make("abc é", 600)), ("b", make("bcd. 7", 700)), ("c", b"z")]
    texts = [make("abcdé. X9", r.randint(0, 300)) for _ in range(40)] + [b"", b"a", b"\xf0\x9f\x98\x80 QQ", make("abcd ", 3000), known[0][1]]
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    got = lang_id.Parser(known).phrases(data, np.cumsum(sizes) - sizes, np.cumsum(sizes))
    assert got.tolist() == [[phrases(t, ref) for _, ref in known] for t in texts]
    assert got[-1].tolist()[0] == 1  # a reference is one phrase of itself


def test_language_of_odd_rows(spark):
    text = {"x": "alpha beta gamma delta " * 9, "y": "uno dos tres cuatro cinco " * 9}
    rows = [(i, text[k], k, None) for i in range(20) for k in "xy"]
    rows += [(50, None, "x", None), (51, "", "y", None), (52, "123 -- !", "x", None), (53, "ALPHA BETA", None, "y"), (54, "tres cuatro", "x", "x"), (None, "delta gamma", None, None), (56, "中", None, None), (57, "gamma " * 30_000, None, None), (53, "ALPHA BETA", None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    known = lang_id.references(df, F.col("doc_id") < 40, reference_bytes=500)
    assert [k for k, _ in known] == ["x", "y"] and all(0 < len(t) <= 500 for _, t in known)
    got = {g["doc_id"]: g for g in lang_id.identify(df, known).collect()}
    assert [got[i]["lang_pred"] for i in (50, 51, 52, 53, 54, None, 57)] == ["und", "und", "und", "x", "y", "x", "x"]
    assert got[56]["lang_pred"] == "x"  # a tie
    assert all(0 <= g["score"] <= 1 for g in got.values()) and got[50]["score"] == 0
    nothing = lang_id.identify(df, lang_id.references(df, F.lit(False))).collect()
    assert {(g["lang_pred"], g["score"]) for g in nothing} == {("und", 0.0)} and len(nothing) == len(rows)
    one = lang_id.identify(df, [("x", b"alpha")]).collect()
    assert {g["lang_pred"] for g in one} == {"x", "und"} and lang_id.identify(df.limit(0), known).collect() == []
    longest = lang_id.references(df.filter("doc_id = 57").withColumn("lang", F.lit("g")), F.lit(True), reference_bytes=100)
    assert [(k, len(t)) for k, t in longest] == [("g", 100)]


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_language_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    got = queries()["op13_language_id"](spark, LARGER).collect()
    assert sorted(g["doc_id"] for g in got) == sorted(lang)
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) for g in got)
    held = [g["lang_pred"] == lang[g["doc_id"]] for g in got if g["held_out"]]
    assert len(held) > 100 and sum(held) / len(held) > 0.98
