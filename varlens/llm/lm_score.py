"""Language-model scores by online logistic mixing of hashed-context bit predictors.

The model spells a lower-cased text byte by byte, and each byte (or the end of the text) as the branches of a
Huffman tree of what follows the two bytes before it, hashed to ``TREES`` places, in training texts. Every branch is a
bit that several predictors guess. Three go by counts of all training texts, in hashed tables: the two bytes before
(exact within its tree), the four bytes before, and the letters of the current word so far with the whole word before it. A
fourth takes the place of the third where it speaks: after an anchor, a pair of words that a hash picks (one in ``ANCHORS``), it expects
the bytes that followed that pair in most other training documents, for as long as they come.

The guesses, as log-odds, are mixed with weights that a gate picks (which contexts know this place, which are sure,
does an anchor speak?). Every text starts with the weights ``START``, which are part of the method and come from no text; within
it they learn online, after every 32 bits, and later after every 64th of the bits so far; a final adaptive map, updated as often, corrects the mixed guess by how such guesses have turned out so
far. All that a guess uses lies before it, so the bits' log-probabilities add up to the text's.

Trees, tables, anchors and word counts come from all training texts. On demand (``tuning``), and in no query, the weights at a
text's start are learned by a logistic regression on that many training texts, which the tables then leave out.

The base score is a unigram model of words with add-one smoothing.

Scale: what is gathered are word counts and anchors with what follows them, which grow with the corpus and stay
distributed, and the tables, which have a place for each training byte up to 2**``MOST_BITS`` (more would not do to broadcast), and which are
broadcast with the ``HEAD`` most frequent words (fixed bounds). Tables are added up in pieces. Anchors are grouped by
their pair, after adding up what follows alike, and only those that two documents share are joined back; a document
meets its own answers by a hash of its id and text. Occurrences of other words join the counts by hash. A document's own
part in an anchor's count is taken out, so that no text is expected because of itself.

Defined results: null and empty texts are one end; a null doc_id counts as the empty text for the
split; rows that repeat are scored each; without training texts all counts are 0 and every bit costs
one bit at first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varlens.llm.quality import fold
from varlens.llm.tokens import text_runs
from varlens.session import Scratch, held, ship

HEAD = 1 << 18
CONTEXTS = 3
TREES = 2048
#: Branches of a tree.
NODES = 256
#: Places of a hashed table, as a power of 2.
LEAST_BITS, MOST_BITS = 16, 24
#: Log-odds are kept as bytes, in steps of a twelfth.
STEP = np.float32(1 / 12)
END = 256
#: One pair of words in this many is an anchor; what follows it is kept for this many bytes.
ANCHORS, FOLLOW = 32, 32
#: Gates: what the third predictor knows (0 to 2) and, in threes, the second; then one for anchors.
GATES = 10
#: Weights of the predictors for each gate that every text starts with; they learn from there.
START = np.array([[0.15, 0.6, 0.35]] * (GATES - 1) + [[0.1, 0.3, 0.9]], np.float32)
#: Bytes of training texts from which other starting weights are learned on demand, at most.
TUNING_BYTES = 1 << 20
#: Curvature that a text's weights have at their start: how slowly they leave it.
CURVE = 10.0
#: Characters of text that are worked on at once, so that arrays stay in the processor's caches.
RUN = 1 << 16
#: Characters of texts of like lengths that are scored side by side, and number of these texts, at most.
BESIDE, ABREAST = 3 << 19, 1 << 12
#: Characters of a batch whose words are held at once.
AT_ONCE = 1 << 23


def _branches(counts: np.ndarray) -> list[list[int]]:
    """Each symbol's path through the Huffman tree of ``counts`` + 1, as 2 * node + bit."""
    heap = [(int(c) + 1, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    new = len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[new] = (a[1], b[1])
        heapq.heappush(heap, (a[0] + b[0], new))
        new += 1
    codes: list[list[int]] = [[] for _ in counts]
    level, number = [(heap[0][1], [])], 0
    while level:  # nodes are numbered from the root down, so that frequent ones lie together
        below = []
        for node, way in level:
            if node in kids:
                below += [(kid, [*way, 2 * number + bit]) for bit, kid in enumerate(kids[node])]
                number += 1
            else:
                codes[node] = way
        level = below
    return codes


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, branches) for a (TREES, 257) table of what follows each place: symbol s at place t takes the
    branches from start[257 * t + s] on. Places that nothing followed share one tree."""
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    starts, lengths, parts, at = [], [], [], 0
    for row in counts:
        key = row.tobytes()
        if key not in known:
            codes = _branches(row)
            length = np.fromiter(map(len, codes), np.int64, len(codes))
            known[key] = (at + np.cumsum(length) - length, length)
            parts.append(np.fromiter((x for way in codes for x in way), np.int16, int(length.sum())))
            at += len(parts[-1])
        starts.append(known[key][0])
        lengths.append(known[key][1])
    return np.concatenate(starts).astype(np.int32), np.concatenate(lengths).astype(np.uint8), np.concatenate(parts)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """63-bit keys from 64-bit sums."""
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return (h >> np.uint64(1)).view(np.int64)


class Run:
    """Texts side by side: their bytes between zeros, and for each byte to come what lies before it.

    ``first[t]`` and ``last[t]`` bound text t's symbols, its end included; symbol i is byte ``x[i + 1]``.
    """

    def __init__(self, texts: list[bytes]):
        x = self.x = np.frombuffer(b"\0" + b"".join(t + b"\0" for t in texts), np.uint8)
        self.last = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        first = self.first = np.append(0, self.last[:-1])
        y = x.astype(np.uint32)
        o2 = y[:-1].copy()
        o2[1:] |= y[:-2] << 8
        o4 = o2.copy()
        o4[2:] |= o2[:-2] << 16
        for j in range(4):  # nothing of the text before
            at = first[first + j < self.last] + j
            o4[at] &= np.uint32((1 << 8 * j) - 1)
            o2[at] &= np.uint32((1 << 8 * min(j, 2)) - 1)
        self.o4 = o4
        self.tree = (o2 * np.uint32(0x9E3779B1)) >> np.uint32(21)
        # Letters weighted by powers of an odd number, summed from the word's start, are a hash of the word so far.
        self.blank = _BLANK[x]
        self.blank[0] = self.blank[self.last] = True
        spot = np.arange(len(x) - 1, dtype=np.int32)
        self.since = np.maximum.accumulate(spot * self.blank[:-1])
        self.far = spot - self.since
        self.total = np.cumsum((x[:-1] + np.uint64(1)) * _POWERS.take(np.minimum(self.far, len(_POWERS) - 1)), dtype=np.uint64)
        word = (self.total - self.total.take(self.since)).astype(np.uint32) + self.far.view(np.uint32)
        begun = np.zeros(len(spot), bool)
        begun[first] = True  # a text's first word has none before it
        before = word.take(np.maximum(self.since - 1, 0))
        before[begun.take(self.since)] = 0
        self.word = word * np.uint32(0x2C1B3C6D) + before
        self.plain = x[1:].astype(np.int64)
        self.plain[self.last - 1] = END
        self.symbol = self.plain + 257 * self.tree.astype(np.int64)

    def spell(self, code) -> None:
        """Sets, by symbol, where its bits begin and how many they are; by bit, its symbol and 2 * node + bit."""
        start, length, branches = code
        self.count = length.take(self.symbol)
        ends = np.cumsum(self.count, dtype=np.int64)
        self.where = ends - self.count
        step = np.zeros(int(ends[-1]), np.int8)
        step[ends[:-1]] = 1
        self.byte = np.cumsum(step, dtype=np.int64)
        at = (start.take(self.symbol) - self.where).take(self.byte)
        at += np.arange(len(at))
        self.branch = branches.take(at)

    def slots(self, bits: int) -> list[np.ndarray]:
        """Per predictor, the place where each symbol's nodes begin in its table."""
        return [self.tree.astype(np.int64) * NODES, _hash(self.o4, self.tree, 1, bits), _hash(self.word, self.tree, 2, bits)]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the last byte in ``x``, key) of each word."""
        j = np.flatnonzero(~self.blank[:-1] & self.blank[1:])
        far = self.far[j]
        key = mixed(self.total[j] - self.total[self.since[j]] + far.astype(np.uint64))
        for i in np.flatnonzero(far >= len(_POWERS)).tolist():  # beyond the powers
            key[i] = word_hash(self.x[j[i] - far[i] + 1 : j[i] + 1].tobytes())
        return np.searchsorted(self.first, j, side="left") - 1, j, key

    def anchors(self, words=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, the symbol after the pair and its blank, hash of the pair) of each anchor."""
        text, j, h = self.words() if words is None else words
        key = mixed(h[:-1].view(np.uint64) * np.uint64(3) + h[1:].view(np.uint64))
        on = np.flatnonzero((key >> 20) % ANCHORS == 0)
        j, last = j[on + 1], self.last[text[on + 1]]
        fits = (text[on] == text[on + 1]) & (j + 1 < last)
        return text[on + 1][fits], j[fits] + 1, key[on][fits]

    def following(self, symbol: int, text: int) -> bytes:
        return self.x[symbol + 1 : min(symbol + 1 + FOLLOW, int(self.last[text]))].tobytes()


def _hash(context: np.ndarray, tree: np.ndarray, salt: int, bits: int) -> np.ndarray:
    h = (context + np.uint32(0x7F4A7C15 * salt & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h += tree
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def table_bits(symbols: int) -> int:
    """Places of a hashed table, as a power of 2, for so many training bytes and ends: one for each or more, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, symbols.bit_length()))


def table_sizes(bits: int) -> list[int]:
    return [TREES * NODES, (1 << bits) + NODES, (1 << bits) + NODES]


def steps_to(n: int) -> np.ndarray:
    """Where blocks of a text of ``n`` bits begin: every 32 bits, then every 64th of the bits so far."""
    out = [0]
    while out[-1] < n:
        out.append(out[-1] + max(32, out[-1] >> 6))
    return np.array(out)


def starting_weights(bit: np.ndarray, odds: np.ndarray, gate: np.ndarray, unit: float = 1.0, least: int = 200, pull: float = 20.0) -> np.ndarray:
    """For each gate, the predictors' weights that make its bits likeliest, by damped Newton steps, drawn towards ``START``; gates
    with fewer than ``least`` bits keep it."""
    out = START.astype(np.float64)
    for g in range(GATES):
        at = np.flatnonzero(gate == g)
        if len(at) < least:
            continue
        x, y, w = odds[:, at] * float(unit), bit[at], out[g].copy()
        for _ in range(50):
            q = 0.5 * (1 + np.tanh(np.clip(w @ x, -30, 30) / 2))
            step = np.linalg.solve((x * (q * (1 - q))) @ x.T + pull * np.eye(len(w)), x @ (y - q) - pull * (w - START[g]))
            w += np.clip(step, -0.5, 0.5)
            if np.abs(step).max() < 1e-5:
                break
        out[g] = w
    return out.astype(np.float32)


def packed(bit: np.ndarray, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """A row of four bytes for each bit: its odds, and 2 * gate + bit."""
    out = np.empty((len(bit), CONTEXTS + 1), np.int8)
    for k in range(CONTEXTS):
        out[:, k] = odds[k]
    out[:, CONTEXTS] = 2 * gate + bit
    return out


def score_texts(bit: np.ndarray, odds: np.ndarray, gate: np.ndarray, edges: np.ndarray, unit: float = 1.0, start: np.ndarray = START) -> np.ndarray:
    """log2 probability of each text's bits, bit[edges[i] : edges[i + 1]], given log-odds in ``unit``s (a row for each
    predictor) and gates."""
    return score_packed(packed(bit, odds, gate), edges, unit, start)


def score_packed(rows: np.ndarray, edges: np.ndarray, unit: float = 1.0, start: np.ndarray = START) -> np.ndarray:
    """``score_texts`` of ``packed`` bits. Texts learn side by side, each its own weights, from ``start`` on, and map."""
    n, many = np.diff(edges), len(edges) - 1
    if not len(rows):
        return np.zeros(many)
    # Blocks go by step, and within a step by their texts' lengths, so that a step's texts are the first ones.
    begins = steps_to(int(n.max()))
    active = many - np.searchsorted(np.sort(n), begins[:-1], side="right")
    longest = np.argsort(-n, kind="stable")
    ranks = np.arange(active.sum()) - np.repeat(np.cumsum(active) - active, active)
    steps = np.repeat(np.arange(len(active)), active)
    begun = begins[steps]
    sizes = np.minimum(begins[steps + 1], n[longest][ranks]) - begun
    begun += edges[:-1][longest][ranks]
    cuts = np.append(0, np.cumsum(active)).tolist()
    four = rows.view(np.int32).ravel()  # one look-up finds a bit, its odds and its gate
    # A row for each text and gate: its weights. Slopes go in pairs, so that two are added up at once; the last one's
    # partner is the curvature, which stays from step to step.
    weights = np.zeros((many, GATES, CONTEXTS + 1), np.float32)
    weights[:, :, :CONTEXTS] = start
    weights = weights.reshape(-1, CONTEXTS + 1)
    slope, bend = np.zeros(GATES * many, np.complex64), np.full(GATES * many, 1j * CURVE, np.complex64)
    totals, power = [slope.real, slope.imag, bend.real], bend.imag
    middle = (np.arange(65, dtype=np.float32) - 32) / 4
    turned = np.tile((24 / (1 + np.exp(np.stack([middle, -middle], axis=1)))).astype(np.float32).ravel(), many)
    one, unit = np.float32(1), np.float32(unit)
    # Arrays of a step's bits, used again by each step; look-ups "clip" since they then need no copy, no place lies outside.
    most = int(np.add.reduceat(sizes, cuts[:-1]).max())
    spots, (kept, held_weights), rooms = np.arange(most), np.empty((2, most, CONTEXTS + 1), np.float32), np.empty((6, most), np.float32)
    pulls, bends = np.empty((2, most), np.complex64)
    cost, ordered = np.zeros(many), np.arange(many)
    for a, b, k in zip(cuts, cuts[1:], active.tolist(), strict=False):
        size = sizes[a:b]
        ends = np.cumsum(size)
        m = int(ends[-1])
        order = np.repeat(begun[a:b] - (ends - size), size)
        order += spots[:m]
        found = four.take(order, mode="clip").view(np.int8).reshape(-1, CONTEXTS + 1)
        s, w, (z, p, sharp, x, side, wrong) = kept[:m], held_weights[:m], rooms[:, :m]
        np.multiply(found, unit, out=s)
        mark = np.ascontiguousarray(found[:, CONTEXTS])
        y = mark & 1
        mark >>= 1
        text = np.repeat(ordered[:k], size)
        at = GATES * text
        at += mark
        weights.take(at, axis=0, out=w, mode="clip")
        w *= s
        np.add(w[:, 0], w[:, 1], out=z)
        z += w[:, 2]
        np.clip(z, -8, 8, out=z)
        np.multiply(z, 4, out=x)
        x += np.float32(32.5)
        cell = x.astype(np.int64)
        cell *= 2
        text *= 130
        cell += text
        cell += y
        # The odds that the bit is the other one: by the weights, and by how such guesses have turned out.
        np.multiply(y, np.float32(-2), out=side)
        side += one
        z *= side
        np.exp(z, out=z)
        turned.take(cell ^ 1, out=wrong, mode="clip")
        turned.take(cell, out=x, mode="clip")
        wrong /= x
        wrong *= z
        # What the block showed: a damped diagonal Newton step for each text's weights, and counts for its map.
        np.add(z, one, out=p)
        np.divide(one, p, out=p)
        z *= p
        np.multiply(s, s, out=w)
        np.add(w[:, 0], w[:, 1], out=x)
        x += w[:, 2]
        np.multiply(p, z, out=sharp)
        sharp += np.float32(0.01)
        z *= side
        np.negative(z, out=z)
        pull, other = pulls[:m], bends[:m]
        np.multiply(s[:, 0], z, out=pull.real)
        np.multiply(s[:, 1], z, out=pull.imag)
        np.multiply(s[:, 2], z, out=other.real)
        np.multiply(sharp, x, out=other.imag)
        g = GATES * k
        slope[:g] = 0
        totals[2][:g] = 0
        np.add.at(slope, at, pull)
        np.add.at(bend, at, other)
        for column, total in enumerate(totals):
            weights[:g, column] += total[:g] / power[:g]
        np.add.at(turned, cell, one)
        # What its bits cost.
        np.sqrt(wrong, out=wrong)
        wrong += one
        np.log(wrong, out=wrong)
        cost[:k] += np.add.reduceat(wrong, ends - size, dtype=np.float64)
    out = np.empty(many)
    out[longest] = -cost / np.log(2)
    return out


def expected(run: Run, answers: list[dict[int, tuple[bytes, int]] | None]):
    """(symbols with a guess from an anchor, the symbol expected, log-odds in steps): guesses go on until one was wrong."""
    text, begin, key = run.anchors()
    symbol = np.full(len(run.plain), -1, np.int64)
    sure = np.zeros(len(run.plain), np.int8)
    for t, i, k in zip(text.tolist(), begin.tolist(), key.tolist(), strict=True):
        found = answers[t].get(k) if answers[t] else None
        if found is None:
            continue
        want = np.frombuffer(found[0], np.uint8).astype(np.int64)
        if len(want) < FOLLOW:
            want = np.append(want, END)
        want = want[: int(run.last[t]) - i]
        missed = np.flatnonzero(run.plain[i : i + len(want)] != want)
        n = int(missed[0]) + 1 if len(missed) else len(want)
        symbol[i : i + n] = want[:n]
        sure[i : i + n] = 30 + 6 * np.minimum(np.arange(n), 8) + 10 * min(found[1] - 1, 3)
    at = np.flatnonzero(symbol >= 0)
    return at, symbol[at], sure[at]


def guesses_of(run: Run, code, tables: list[np.ndarray], bits: int, answers: list | None = None):
    """(where each text's bits begin, bits, log-odds in steps as bytes, a row for each predictor, gates)."""
    run.spell(code)
    node = run.branch >> 1
    odds = np.empty((CONTEXTS, len(node)), np.int8)
    for row, table, slot in zip(odds, tables, run.slots(bits), strict=True):
        at = slot.take(run.byte, mode="clip")
        at += node
        table.take(at, out=row, mode="clip")
    gate = (odds[2] != 0).view(np.int8) + (np.abs(odds[2]) > 24).view(np.int8)
    gate += np.int8(3) * ((odds[1] != 0).view(np.int8) + (np.abs(odds[1]) > 24).view(np.int8))
    if answers is not None and any(answers):
        start, length, branches = code
        at, symbol, sure = expected(run, answers)
        count = run.count[at].astype(np.int64)
        ends = np.cumsum(count)
        deep = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        bit = np.repeat(run.where[at], count) + deep
        way = np.repeat(symbol + 257 * run.tree[at].astype(np.int64), count)
        sure = np.repeat(sure, count)
        inside = deep < length[way]
        bit, way, deep, sure = bit[inside], way[inside], deep[inside], sure[inside]
        branch = branches[start[way] + deep]
        same = branch >> 1 == node[bit]  # a node has one way to it: so far the bits were as expected
        bit, branch, sure = bit[same], branch[same], sure[same]
        odds[2, bit] = np.where(branch & 1, sure, -sure)
        gate[bit] = GATES - 1
    return run.where[run.first], (run.branch & 1).astype(np.int8), odds, gate


def score_batch(texts: list[bytes], answers: list, guesses, start: np.ndarray = START) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each text; the text and key of every word. Texts of like lengths are scored side by side, about
    BESIDE bytes and at most ABREAST texts at once."""
    out, owner, keys = np.zeros(len(texts)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
    ordered, known = [texts[i] for i in order], [answers[i] for i in order]
    for a, b in ((i, min(i + ABREAST, b)) for a, b in text_runs(ordered, BESIDE) for i in range(a, b, ABREAST)):
        edges, parts = [np.zeros(1, np.int64)], []
        for i, j in text_runs(ordered[a:b], RUN):
            run = Run(ordered[a + i : a + j])
            text, _, key = run.words()
            owner.append(order[a + i : a + j][text])
            keys.append(key)
            first, *part = guesses(run, known[a + i : a + j])
            edges.append(edges[-1][-1] + np.append(first[1:], len(part[0])))
            parts.append(packed(*part))
        rows = np.concatenate(parts)
        parts.clear()
        out[order[a:b]] = score_packed(rows, np.concatenate(edges), STEP, start) * np.log10(2)
    return out, np.concatenate(owner), np.concatenate(keys)


def _lower(batch) -> list[bytes]:
    return [(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def word_hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word) >> 1


def summed_keys(keys: np.ndarray, counts: np.ndarray):
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts[order], at)


GATHERED = "kind int, h long, c long, doc long, follow binary"


def _gather(batches):
    """kind 0: training words by hash; 1: what follows each tree's place in them, as 257 * tree + next; 2: all texts' anchors
    by hash, once a text, c = 1 for a training text, with the text's key and what follows."""
    pairs = np.zeros(TREES * 257, np.int64)
    waiting, size = [], 0

    def table(kind, h, c, doc=None, follow=None):
        n = len(h)
        return pa.record_batch({"kind": pa.array(np.full(n, kind, np.int32)), "h": pa.array(h), "c": pa.array(c), "doc": pa.nulls(n, pa.int64()) if doc is None else doc, "follow": pa.array(follow or [None] * n, pa.binary())})

    def merged():
        out = summed_keys(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        waiting.clear()
        return out

    for batch in batches:
        texts = _lower(batch)
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        doc = batch.column("doc")
        for a, b in text_runs(texts, RUN):
            run, on = Run(texts[a:b]), train[a:b]
            np.add.at(pairs, run.symbol[np.repeat(on, run.last - run.first)], 1)
            words = run.words()
            waiting.append(np.unique(words[2][on[words[0]]], return_counts=True))
            size += len(waiting[-1][0])
            if size > 2_000_000:
                waiting.append(merged())
                size = len(waiting[0][0])
                if size > 1_000_000:
                    yield table(0, *waiting.pop())
                    size = 0
            text, begin, key = run.anchors(words)
            by = np.lexsort((begin, key, text))
            text, begin, key = text[by], begin[by], key[by]
            new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(text)])
            text, begin, key = text[new], begin[new], key[new]
            if len(text):
                yield table(2, key, train[a:b][text].astype(np.int64), doc.take(pa.array(text + a)), [run.following(i, t) for i, t in zip(begin.tolist(), text.tolist(), strict=True)])
    if waiting:
        yield table(0, *merged())
    at = np.flatnonzero(pairs)
    yield table(1, at, pairs[at])


#: Places that are added up and sent together.
PIECE = 1 << 17
#: Symbols that are sorted at once, and different ones whose branches are counted at once.
SORTED, SPELT = 1 << 20, 1 << 16
#: A symbol and its tree, as ``Run.symbol``, below this.
ALL_SYMBOLS = 1 << (TREES * 257 - 1).bit_length()


def ways(code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of branches, of each of ``symbols``; their branches, one after another)."""
    start, length, branches = code
    count = length[symbols].astype(np.int64)
    ends = np.cumsum(count)
    return count, branches[np.repeat(start[symbols] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


def count_branches(code, table: np.ndarray, keys: np.ndarray) -> None:
    """Adds the branches of ``keys``, place * ALL_SYMBOLS + symbol, to ``table``. Keys are sorted in place: what occurs often is
    spelt once, and places are met in order."""
    keys.sort()
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    times = np.diff(np.append(first, len(keys))).astype(np.uint32)
    for a in range(0, len(first), SPELT):
        key = keys[first[a : a + SPELT]]
        count, branch = ways(code, key % ALL_SYMBOLS)
        at = np.repeat(key // ALL_SYMBOLS * 2, count)
        at += branch
        np.add.at(table, at, np.repeat(times[a : a + SPELT], count))


def _count_bits(code, bits):
    """Counts of every branch by place in the hashed tables, as (table, piece, counts): nonzero pieces, compressed."""

    def run(batches):
        held("bits")
        counts = None
        for batch in batches:
            texts = _lower(batch)
            for a, b in text_runs(texts, SORTED):
                if counts is None:
                    counts = [np.zeros(2 * n, np.uint32) for n in table_sizes(bits)[1:]]
                parts = []
                for i, j in text_runs(texts[a:b], RUN):
                    part = Run(texts[a + i : a + j])
                    part.spell(code.value)
                    _, keys, slot = part.slots(bits)
                    keys *= ALL_SYMBOLS
                    keys += part.symbol
                    parts.append(keys)
                    # Words with the one before are mostly new; sorting them saves nothing.
                    slot *= 2
                    at = slot.take(part.byte)
                    at += part.branch
                    np.add.at(counts[1], at, np.uint32(1))
                count_branches(code.value, counts[0], np.concatenate(parts))
        if counts is not None:
            for k, table in enumerate(counts, 1):
                for p in range(0, len(table), 2 * PIECE):
                    part = table[p : p + 2 * PIECE]
                    if part.any():
                        yield pa.record_batch({"table": pa.array([k], pa.int32()), "piece": pa.array([p // (2 * PIECE)], pa.int32()), "counts": pa.array([packed_counts(part)])})

    return run


def packed_counts(counts: np.ndarray) -> bytes:
    """uint32 counts, most of them small: their number, low bytes, then place and rest of those beyond a byte; compressed."""
    import zstandard

    over = np.flatnonzero(counts > 255).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.uint32(len(counts)).tobytes() + counts.astype(np.uint8).tobytes() + over.tobytes() + (counts[over] >> 8).tobytes())


def add_packed(data: bytes, sums: np.ndarray | None) -> np.ndarray:
    """``sums``, zeros where None, plus packed counts."""
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    sums = np.zeros(n, np.int64) if sums is None else sums
    sums += np.frombuffer(raw, np.uint8, n, offset=4)
    over, rest = np.frombuffer(raw, np.uint32, offset=4 + n).reshape(2, -1)
    sums[over] += rest.astype(np.int64) << 8
    return sums


def tree_counts(pairs: np.ndarray, code) -> np.ndarray:
    """Counts of every branch of every tree, from how often each symbol followed each place."""
    out = np.zeros(2 * TREES * NODES, np.int64)
    seen = np.flatnonzero(pairs)
    count, branch = ways(code, seen)
    np.add.at(out, np.repeat(seen // 257 * (2 * NODES), count) + branch, np.repeat(pairs.reshape(-1)[seen], count))
    return out


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds in steps of (0s, 1s) counts."""
    n = counts.reshape(-1, 2) + np.float32(0.4)
    return np.rint(np.clip(np.log(n[:, 1] / n[:, 0]), -9, 9) / STEP).astype(np.int8)


def _sum_pieces(batches):
    sums: dict = {}
    for batch in batches:
        for k, p, data in zip(*(batch.column(c).to_pylist() for c in ("table", "piece", "counts")), strict=True):
            sums[k, p] = add_packed(data, sums.get((k, p)))
    for (k, p), part in sums.items():
        yield pa.record_batch({"table": pa.array([k], pa.int32()), "piece": pa.array([p], pa.int32()), "odds": pa.array([odds_of(part).tobytes()])})


class Head:
    """Places of keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        bits = max(4, (4 * n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.names = np.append(keys, -1)
        self.rows = np.full((1 << bits) + n + 1, n, np.int32)
        left, place = np.arange(n), self._place(keys)
        while len(left):  # one of those at a free place takes it, the others go on
            free = self.rows[place] == n
            self.rows[place[free]] = left[free]
            on = self.rows[place] != left
            left, place = left[on], place[on] + 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; the number of keys for those that are not here."""
        n, place = len(self.names) - 1, self._place(keys)
        row = self.rows.take(place)
        at = np.flatnonzero((row < n) & (self.names.take(row) != keys))
        while len(at):
            place[at] += 1
            row[at] = self.rows[place[at]]
            at = at[(row[at] < n) & (self.names[row[at]] != keys[at])]
        return row


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, head_log double, head_known long, score double, h long, n long"


def _score(code, odds_b, bits, head_b, start=START):
    def run(batches):
        from pyspark import TaskContext

        held("scores")
        odds = [np.array(t) for t in odds_b.value]  # copies lie in large pages, what was unpickled does not
        head, logs = head_b.value
        rid = TaskContext.get().partitionId() << 36
        schema = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCORED.split(", ")])

        def table(rows, **columns):
            return pa.record_batch([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

        for whole in batches:
            lowered = _lower(whole)
            for a, b in text_runs(lowered, AT_ONCE):
                batch = whole.slice(a, b - a)
                texts, many = lowered[a:b], b - a
                answers = [{r["h"]: (r["follow"], r["support"]) for r in rows} if rows else None for rows in batch.column("answers").to_pylist()]
                scores, doc, key = score_batch(texts, answers, lambda run, known: guesses_of(run, code.value, odds, bits, known), start)
                place = head.find(key)
                known = place < len(logs)
                log = np.bincount(doc[known], weights=logs[place[known]], minlength=many)
                rids = rid + np.arange(many)
                rid += many
                yield table(many, rid=pa.array(rids), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=pa.array(np.bincount(doc, minlength=many) + 1), head_log=pa.array(log), head_known=pa.array(np.bincount(doc[known], minlength=many)), score=pa.array(scores, pa.float64()))
                rest = np.flatnonzero(~known)
                if len(rest):
                    h, d = key[rest], doc[rest]
                    order = np.lexsort((h, d))
                    h, d = h[order], d[order]
                    starts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
                    yield table(len(starts), rid=pa.array(rids[d[starts]]), h=pa.array(h[starts]), n=pa.array(np.diff(np.append(starts, len(h)))))

    return run


def shared_anchors(anchors: DataFrame) -> DataFrame:
    """doc and its answers (h, follow, support) from anchors (h, c = 1 for training, doc, follow): what followed each pair
    in more than half of the training documents that have it, counted without the document itself; only where something is left."""
    alike = anchors.groupBy("h", "follow").agg(F.sum("c").alias("b"), F.count("*").alias("n"))
    best = alike.groupBy("h").agg(F.max(F.struct("b", "follow")).alias("best"), F.sum("n").alias("n"), F.sum("b").alias("all")).filter("n > 1 and 2 * best.b > all")
    joined = anchors.join(best.select("h", "best"), "h")
    own = F.when(F.col("follow") == F.col("best.follow"), F.col("c")).otherwise(F.lit(0))
    found = joined.select("doc", F.struct("h", F.col("best.follow").alias("follow"), (F.col("best.b") - own).cast("int").alias("support")).alias("answer"))
    return found.filter("answer.support > 0").groupBy("doc").agg(F.collect_set("answer").alias("answers"))  # a document's own, at most its anchors


def tuning_texts(docs: DataFrame, most: int) -> list[tuple[int, bytes]]:
    """(key, text) of up to ``most`` training texts, the first by their key's hash that fit ``TUNING_BYTES`` together."""
    rows = docs.filter(~F.col("held_out") & (F.length("text") > 0) & (F.octet_length("text") <= TUNING_BYTES // 16))
    out, size = [], 0
    for r in rows.select("doc", "text").orderBy(F.xxhash64("doc", F.lit("tuning")), "doc").limit(most).collect() if most else []:
        text = (r["text"] or "").encode().lower()
        if size + len(text) <= TUNING_BYTES:
            out.append((r["doc"], text))
            size += len(text)
    return out


def score(docs: DataFrame, held_out: Column | None = None, tuning: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out``: a boolean of doc_id; the other documents are learned from. All documents are scored. ``tuning``: how many
    training texts serve the starting weights, and not the tables (0: none, all training texts are counted and weights start at
    ``START``); a sixteenth of the training texts at most.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lm")

    def save(df: DataFrame, name: str) -> DataFrame:
        """What a write shuffled goes from disk with it."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            return scratch.save(df, name)
        finally:
            spark.conf.set(key, before)

    held_out = fold("doc_id", 7) == 2 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out)
    docs = docs.withColumn("doc", F.xxhash64("doc_id", "text"))
    gathered = save(docs.select("text", "held_out", "doc").mapInArrow(_gather, GATHERED), "gathered")
    counts = save(gathered.filter("kind < 2").groupBy("kind", "h").agg(F.sum("c").alias("c")), "counts")
    answers = save(shared_anchors(gathered.filter("kind = 2").select("h", "c", "doc", "follow")), "answers")
    scratch.drop("gathered")
    pairs = np.zeros((TREES, 257), np.int64)
    got = counts.filter("kind = 1").select("h", "c").toArrow()  # at most TREES * 257 rows
    pairs.reshape(-1)[got.column("h").to_numpy()] = got.column("c").to_numpy()
    code = spark.sparkContext.broadcast(huffman(pairs))
    n_words, v_words = counts.filter("kind = 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    ends = int(pairs[:, END].sum())
    total, different = n_words + ends, v_words + (ends > 0)
    head = counts.filter("kind = 0").orderBy(F.desc("c"), "h").limit(HEAD).select("h", "c").toArrow()
    head_b = spark.sparkContext.broadcast((Head(head.column("h").to_numpy()), np.log10(head.column("c").to_numpy() + 1.0)))

    bits = table_bits(int(pairs.sum()))
    tune = tuning_texts(docs, min(tuning, docs.filter(~F.col("held_out")).count() // 16)) if tuning else []
    counted = docs.filter(~F.col("held_out"))
    if tune:  # their rows, copies under one id included
        counted = counted.filter(~F.col("doc").isin([k for k, _ in tune]))
    sent = counted.select("text").mapInArrow(_count_bits(code, bits), "table int, piece int, counts binary")
    summed = sent.repartition("table", "piece").mapInArrow(_sum_pieces, "table int, piece int, odds binary")
    odds = [odds_of(tree_counts(pairs, code.value)), *(np.zeros(n, np.int8) for n in table_sizes(bits)[1:])]
    for r in summed.collect():  # the tables' size at most
        part = np.frombuffer(r["odds"], np.int8)
        odds[r["table"]][r["piece"] * PIECE :][: len(part)] = part
    odds_b = spark.sparkContext.broadcast(odds)

    start = START
    if tune:
        parts = [guesses_of(Run([t]), code.value, odds, bits)[1:] for _, t in tune]
        start = starting_weights(*(np.concatenate(x, axis=-1) for x in zip(*parts, strict=True)), STEP)

    rows = docs.join(answers, "doc", "left").select("doc_id", "text", "held_out", "answers")
    scored = save(rows.mapInArrow(_score(code, odds_b, bits, head_b, start), SCORED), "scored")
    scratch.drop("answers")
    tail = scored.filter("h is not null").select("rid", "h", "n").join(counts.filter("kind = 0").select("h", "c"), "h")
    tail = tail.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_log"), F.sum("n").alias("_known"))
    out = scored.filter("h is null").join(tail, "rid", "left")
    end_log, end_known = float(np.log10(ends + 1)), int(ends > 0)
    log = F.col("head_log") + F.coalesce("_log", F.lit(0.0)) + F.lit(end_log)
    base = log - F.col("n_tokens") * F.lit(float(np.log10(total + different + 1)))
    known = F.col("head_known") + F.coalesce("_known", F.lit(0)) + F.lit(end_known)
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
