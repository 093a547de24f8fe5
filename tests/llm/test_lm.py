"""Language-model scores: the base by counting, the mixer bit by bit, anchors by a dictionary."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from varlens.llm import lm_score as L


def test_language_model(odd, empty, spark):
    from varlens.llm.lm_score import Run, huffman, score

    got = {g["doc_id"]: g for g in score(odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in odd.collect() if r["doc_id"] is not None}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in rows[i])
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    for i, words in rows.items():
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words, None])
        g = got[i]
        assert g["base_score"] == pytest.approx(want) and g["train_tokens"] == n and g["n_tokens"] == len(words) + 1
        assert g["n_known"] == sum(c[w] > 0 for w in [*words, None]) and g["score"] < 0
        assert g["held_out"] == (i not in train)
    assert score(odd).count() == odd.count()
    assert score(empty).count() == 0
    # Codes are prefix-free and complete, and a text's bits do not depend on its neighbours.
    start, length, branches = code = huffman(np.tile(np.arange(257), (2048, 1)))
    words = {tuple(branches[a : a + k].tolist()) for a, k in zip(start[:257], length[:257], strict=True)}
    assert len(words) == 257 and sum(0.5 ** len(w) for w in words) == pytest.approx(1)
    together, alone = Run([b"abc def", b"xyz"]), Run([b"xyz"])
    for r in (together, alone):
        r.spell(code)
    cut, bit = together.first[1], together.where[together.first[1]]
    assert together.branch[bit:].tolist() == alone.branch.tolist()
    for a, b in zip(together.slots(16), alone.slots(16), strict=True):
        assert a[cut:].tolist() == b.tolist()


def slow_mix(bits, odds, gates):
    """One bit after another, in Python floats."""
    weights = [[float(x) for x in row] for row in L.START]
    power = [L.CURVE] * L.GATES
    turned = [[24 / (1 + math.exp((c - 32) / 4)), 24 / (1 + math.exp(-(c - 32) / 4))] for c in range(65)]
    total, edges, block = 0.0, L.steps_to(len(bits)).tolist(), []
    for i, (y, g) in enumerate(zip(bits, gates, strict=True)):
        s = [np.float32(x) * L.STEP for x in odds[:, i]]
        z = np.float32(0)
        for w, x in zip(weights[g], s, strict=True):
            z += np.float32(w) * x  # single precision: the cell must not differ by rounding
        z = min(np.float32(8), max(np.float32(-8), z))
        cell = int(z * np.float32(4) + np.float32(32.5))
        s, z = [float(x) for x in s], float(z)
        final = (z + math.log(turned[cell][1] / turned[cell][0])) / 2
        total -= math.log2(1 + math.exp(-final if y else final))
        block.append((y, g, s, z, cell))
        if i + 1 in edges:
            slope = [[0.0] * 3 for _ in range(L.GATES)]
            for y_, g_, s_, z_, cell_ in block:
                p = 1 / (1 + math.exp(-z_))
                power[g_] += (p - p * p + 0.01) * sum(x * x for x in s_)
                for k in range(3):
                    slope[g_][k] += (y_ - p) * s_[k]
                turned[cell_][y_] += 1
            for g_ in range(L.GATES):
                for k in range(3):
                    weights[g_][k] += slope[g_][k] / power[g_]
            block = []
    return total


def test_mixer_against_bit_by_bit():
    rng = np.random.default_rng(3)
    n = [1500, 20, 0, 4000, 33]
    edges = np.append(0, np.cumsum(n))
    bit = (rng.random(edges[-1]) < 0.6).astype(np.int8)
    odds = np.where(rng.random((3, edges[-1])) < 0.7, (rng.normal(0, 20, (3, edges[-1])) + 25 * (2 * bit - 1)).clip(-108, 108), 0).astype(np.int8)
    gate = rng.integers(0, L.GATES, edges[-1]).astype(np.int8)
    got = L.score_texts(bit, odds, gate, edges, L.STEP)
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        assert got[k] == pytest.approx(slow_mix(bit[a:b].tolist(), odds[:, a:b], gate[a:b].tolist()), rel=1e-3, abs=0.02)


def test_probabilities_add_up():
    """Over both values of the last bit, the model's probabilities add up to that of what came before."""
    rng = np.random.default_rng(1)
    odds = rng.integers(-40, 40, (3, 3000)).astype(np.int8)
    bit, gate = (rng.random(3000) < 0.7).astype(np.int8), rng.integers(0, L.GATES, 3000).astype(np.int8)
    whole = lambda y, n: L.score_texts(y, odds[:, :n], gate[:n], np.array([0, n]), L.STEP)[0]
    both = [whole(np.append(bit[:-1], v).astype(np.int8), 3000) for v in (0, 1)]
    assert np.logaddexp2(*both) == pytest.approx(whole(bit[:-1], 2999), abs=1e-3)


def test_short_texts_learn_too():
    rng = np.random.default_rng(2)
    edges = np.array([0, 1200, 1240])
    bit = (rng.random(1240) < 0.5).astype(np.int8)
    odds = rng.integers(-18, 18, (3, 1240)).astype(np.int8)
    odds[1] = np.where(bit == 1, -36, 36)  # a predictor that is always wrong
    got = L.score_texts(bit, odds, np.zeros(1240, np.int8), edges, L.STEP)
    # Unlearned, each bit costs over two; within 40 bits that falls, and after 1200 the predictor is read the other way round.
    assert got[0] > -0.4 * 1200 and got[1] > -2.6 * 40
    assert np.diff(L.steps_to(10**6)).max() <= 10**6 / 64 and np.diff(L.steps_to(2000)).max() == 32


def expected_by_loop(text, answers):
    """Symbol -> (expected symbol, log-odds): each anchor's guesses until one is wrong, later anchors over earlier ones."""
    out = {}
    _, begin, key = L.Run([text]).anchors()
    symbols = [*text, L.END]
    for i, k in sorted(zip(begin.tolist(), key.tolist(), strict=True)):
        if k in answers:
            follow, support = answers[k]
            want = [*follow, *([L.END] if len(follow) < L.FOLLOW else [])]
            for j, w in enumerate(want):
                if i + j >= len(symbols):
                    break
                out[i + j] = (w, 30 + 6 * min(j, 8) + 10 * min(support - 1, 3))
                if symbols[i + j] != w:
                    break
    return out


def test_scores_against_brute_force(spark):
    """Tables by counting every (place, branch), anchors by a dictionary, mixing bit by bit."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 120))) for _ in range(90)]
    texts += [texts[3], texts[40] + " and more", texts[70], texts[70], "x " + texts[85], texts[5] + "\n" + texts[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = [i < 80 or i in (90, 92) for i in range(len(texts))]
    got = {g["doc_id"]: g["score"] for g in L.score(df, held_out=~((F.col("doc_id") < 80) | F.col("doc_id").isin(90, 92)), tuning=0).collect()}

    raw = [t.encode() for t in texts]
    train = [t for t, on in zip(raw, learned, strict=True) if on]
    pairs = np.zeros((L.TREES, 257), np.int64)
    for t in train:
        for s in L.Run([t]).symbol:
            pairs[divmod(int(s), 257)] += 1
    code = L.huffman(pairs)
    bits = L.table_bits(int(pairs.sum()))
    assert bits == max(L.LEAST_BITS, sum(len(t) + 1 for t in train).bit_length())

    def spelled(t):
        run = L.Run([t])
        run.spell(code)
        return run, [[(2 * int(slot[b]) + int(x)) for b, x in zip(run.byte, run.branch, strict=True)] for slot in run.slots(bits)]

    seen = [Counter() for _ in range(3)]
    for t in train:
        for c, slots in zip(seen, spelled(t)[1], strict=True):
            c.update(slots)
    follows = [{} for _ in raw]
    for i, t in enumerate(raw):
        run = L.Run([t])
        _, begin, key = run.anchors()
        for b, k in sorted(zip(begin.tolist(), key.tolist(), strict=True)):
            follows[i].setdefault(k, run.following(b, 0))
    votes = {}
    for i, own in enumerate(follows):
        for k, f in own.items():
            votes.setdefault(k, Counter())[f] += learned[i]
    spoke = 0
    start, length, branches = code
    for i, t in enumerate(raw):
        answers = {}
        for k, f in follows[i].items():
            b, best = max((n, f_) for f_, n in votes[k].items())
            most = 2 * b > sum(votes[k].values())
            b -= learned[i] and best == f
            if most and b > 0:
                answers[k] = (best, b)
        run, slots = spelled(t)
        odds = np.array([[int(L.odds_of(np.array([c[s & ~1], c[s | 1]]))[0]) for s in x] for c, x in zip(seen, slots, strict=True)], np.int8)
        gate = [int(o[2] != 0) + int(abs(o[2]) > 24) + 3 * (int(o[1] != 0) + int(abs(o[1]) > 24)) for o in odds.T.astype(int)]
        for s, (want, sure) in expected_by_loop(t, answers).items():
            way = 257 * int(run.tree[s]) + want
            for j in range(min(int(run.count[s]), int(length[way]))):
                bit = int(run.where[s]) + j
                branch = int(branches[start[way] + j])
                if branch >> 1 != int(run.branch[bit]) >> 1:
                    break
                odds[2, bit], gate[bit] = (sure if branch & 1 else -sure), L.GATES - 1
                spoke += 1
        want = slow_mix([int(x) & 1 for x in run.branch], odds, gate) * math.log10(2)
        assert got[i] == pytest.approx(want, rel=2e-3, abs=0.02), i
    assert spoke > 300  # anchors had their say


def test_held_out_texts_and_copies(spark):
    """Held-out bits a byte fall as the corpus grows, and a text that the corpus has elsewhere scores better."""
    rng = random.Random(8)
    stems = ["".join(rng.choices("aeioumnrst", k=3)) for _ in range(60)]
    text = lambda: " ".join("".join(rng.choices(stems, k=rng.randint(1, 3))) for _ in range(200))
    held = [text() for _ in range(10)]
    bits = []
    for n in (30, 400):
        rows = [(i, t) for i, t in enumerate([*held, *(text() for _ in range(n)), held[0]])]
        got = {g["doc_id"]: g["score"] for g in L.score(spark.createDataFrame(rows, "doc_id long, text string"), held_out=F.col("doc_id") < 10).collect()}
        each = [-got[i] / math.log10(2) / len(held[i]) for i in range(10)]
        bits.append(sum(each[1:]) / 9)
        assert each[0] < 0.9 * bits[-1]
    assert bits[1] < bits[0] < 8


def test_starting_weights_are_the_regression(spark):
    rng = np.random.default_rng(7)
    odds = rng.integers(-40, 40, (3, 20_000)).astype(np.int8)
    true = np.array([0.1, 0.7, 0.4])
    gate = rng.integers(0, L.GATES, 20_000).astype(np.int8)
    gate[:100], gate[100:] = 9, np.minimum(gate[100:], 8)
    bit = (rng.random(20_000) < 1 / (1 + np.exp(-(true @ odds) * float(L.STEP)))).astype(np.int8)
    got = L.starting_weights(bit, odds, gate, L.STEP)
    assert np.allclose(got[:9], true, atol=0.12) and np.array_equal(got[9], L.START[9])
    at = gate == 4
    cost = lambda w: np.logaddexp(0, -(2 * bit[at] - 1.0) * (w @ odds[:, at] * float(L.STEP))).sum() + 10 * ((w - L.START[4]) ** 2).sum()
    assert all(cost(got[4]) <= cost(got[4] + d) + 1e-6 for d in 0.02 * np.concatenate([np.eye(3), -np.eye(3)]))


def test_texts_that_tune_are_not_counted(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(120)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = df.withColumn("held_out", F.lit(False)).withColumn("doc", F.xxhash64("doc_id", "text"))
    few = L.tuning_texts(marked, 5)
    assert len(few) == 5 == len({k for k, _ in few}) and few == L.tuning_texts(marked.repartition(7), 5) and all(t for _, t in few)
    a, b = ({g["doc_id"]: g["score"] for g in L.score(df, held_out=F.col("doc_id") % 5 == 0, tuning=n).collect()} for n in (0, 6))
    assert set(a) == set(b) and all(v < 0 for v in b.values()) and a != b
    assert sum(b[i] for i in range(0, 120, 5)) > 1.1 * sum(a[i] for i in range(0, 120, 5))


def test_words_before_are_the_texts_own():
    """The context of a word and the one before it does not reach over a text's start."""
    alone, beside = L.Run([b"one two"]), L.Run([b"zero ", b"one two", b"one two"])
    n = len(alone.word)
    for t in (1, 2):
        assert beside.word[beside.first[t] : beside.first[t] + n].tolist() == alone.word.tolist()
    other = L.Run([b"six two"])
    assert (other.word[5:] != alone.word[5:]).all()  # within the second word: the words before differ


def test_query_learns_from_all_training_texts(spark, tmp_path, monkeypatch):
    """No model, count or starting weight of the query comes from a choice of training texts."""
    from varlens.llm.queries import op8_lm_scores

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(L, "tuning_texts", lambda *_: pytest.fail("the query chose some training texts"))
    got = {g["doc_id"]: g["score"] for g in op8_lm_scores(spark, str(tmp_path)).collect()}
    want = {g["doc_id"]: g["score"] for g in L.score(docs, tuning=0).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == 90


def test_what_recurs_is_spelt_once(monkeypatch):
    """Branches of the four bytes before are counted from sorted symbols: each different one is spelt once, with the same counts."""
    text = b"so it goes on and on, and on it goes; " * 300
    run = L.Run([text, b"", b"on"])
    code = L.huffman(np.bincount(run.symbol, minlength=L.TREES * 257).reshape(L.TREES, 257))
    run.spell(code)
    slot = run.slots(16)[1]
    want = np.bincount(2 * slot.take(run.byte) + run.branch, minlength=2 * L.table_sizes(16)[1])
    spelt, ways = [], L.ways
    monkeypatch.setattr(L, "ways", lambda code, symbols: spelt.append(len(symbols)) or ways(code, symbols))
    table = np.zeros(2 * L.table_sizes(16)[1], np.uint32)
    L.count_branches(code, table, slot * L.ALL_SYMBOLS + run.symbol)
    assert table.tolist() == want.tolist() and table.max() > 255
    assert sum(spelt) < 100 < len(run.symbol) / 100
    L.count_branches(code, table, np.zeros(0, np.int64))
    assert table.sum() == want.sum()


def test_counts_are_sent_as_bytes():
    """Low bytes, and the rest of the few counts beyond a byte: sums are those of the counts, in fewer bytes."""
    import zstandard

    rng = np.random.default_rng(4)
    for n in (2 * L.NODES, 131_584, 2 * L.PIECE):
        a, b = (rng.poisson(0.3, n).astype(np.uint32) for _ in range(2))
        a[[0, n - 1]], b[0] = (255, 256), 2**32 - 1
        sums = L.add_packed(L.packed_counts(b), L.add_packed(L.packed_counts(a), None))
        assert sums.tolist() == (a.astype(np.int64) + b).tolist()
        assert n < 1000 or len(L.packed_counts(a)) < 0.75 * len(zstandard.ZstdCompressor(level=1).compress(a.tobytes()))


def test_more_texts_side_by_side_score_alike():
    """A text's score does not depend on which ones it is scored with."""
    rng = np.random.default_rng(6)
    n = [700, 33, 0, 5000, 64, 1]
    edges = np.append(0, np.cumsum(n))
    bit = (rng.random(edges[-1]) < 0.5).astype(np.int8)
    odds = (rng.normal(0, 20, (3, edges[-1])) + 20 * (2 * bit - 1)).clip(-108, 108).astype(np.int8)
    gate = rng.integers(0, L.GATES, edges[-1]).astype(np.int8)
    together = L.score_packed(L.packed(bit, odds, gate), edges, L.STEP)
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        assert L.score_packed(L.packed(bit[a:b], odds[:, a:b], gate[a:b]), np.array([0, b - a]), L.STEP)[0] == pytest.approx(together[k], rel=1e-6)
