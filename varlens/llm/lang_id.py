"""Language identification by cross-parsing entropy.

A language's reference is labelled text of it. Its suffix automaton accepts exactly the reference's substrings, so walking it
gives the longest match at a place. A text is cut greedily into phrases, each the longest that occurs in the reference (or one
byte that does not occur at all); c phrases against a reference of N bytes cost about ``c * log2(N)`` bits, and the language
with the lowest cost, the fewest normalised phrases, wins. Language, source and id of a text are never looked at.

Texts are read as UTF-8 bytes with A-Z lower-cased; a run of ASCII bytes that are no letters counts as one space. The score is how much cheaper the winner is than the second, ``1 - best / second``, 0 to 1.

Scale: references are whole labelled texts, ``reference_bytes`` for a language at most (and ``total_bytes`` over all, shared
evenly), picked by a hash of the id; this is the only part that reaches the driver, and it is broadcast. Prediction is one pass over
whole texts without a shuffle. Texts are parsed in pieces of ``PIECE`` bytes side by side, so a phrase also ends at a piece's
end; this is the same for every language, and a long text is many pieces, not one long task.

Defined results: ``und`` with score 0 for null texts and texts without a letter (Unicode categories L), and for all texts
where nothing was learned; score 1 where one language only was learned, or the winner alone costs nothing. Ties go to the
language that is first by code points. Rows with null lang, text or (where an id is held out) id teach nothing; a language whose
texts are all longer than its share of bytes is learned from the first bytes of the shortest sampled. Repeated rows are
predicted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlens.session import held, ship

#: Bytes of a text that are parsed as one piece, and pieces that are parsed side by side.
PIECE, SIDE = 1024, 8192

#: Bytes as they are compared: A-Z lower-cased, every ASCII byte that is no letter a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with runs of spaces as one space, and where they start and end now."""
    data = _FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[starts[starts < ends]] = True  # whatever text comes before
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[starts], at[ends]


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts the substrings of ``symbols``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in moves[at]:
            moves[at][s] = new
            at = link[at]
        if at >= 0:
            to = moves[at][s]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(s) == to:
                    moves[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return moves


class Parser:
    """Counts of phrases of texts against every reference, for many pieces of texts at once.

    One table holds all automata: entry (state, symbol) is the next state's row times four plus the phrases that the step
    ends, so a step is a lookup. Where a state has no move on a symbol its phrase ends and the symbol starts the next one; a
    symbol that the reference lacks is a phrase by itself.
    """

    def __init__(self, references: list[tuple[str, bytes]]):
        self.languages = [lang for lang, _ in references]
        texts = [folded(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] for _, t in references]
        self.bits = np.array([math.log2(len(t) + 1) for t in texts])
        known = np.unique(np.concatenate([*texts, np.zeros(0, np.uint8)]))
        #: Bytes to symbols; 0 is any symbol that no reference holds.
        place = np.zeros(256, np.uint8)
        place[known] = np.arange(1, len(known) + 1)
        self.symbol = place
        self.width = len(known) + 1
        tables, self.starts, at = [], [], 0
        for t in texts:
            moves = suffix_automaton(place[t].tobytes())
            root = np.full(self.width, at * self.width * 4 + 1, np.int64)  # an unknown symbol: one phrase, back to the start
            for s, to in moves[0].items():
                root[s] = (at + to) * self.width * 4
            table = np.tile(root + 1, (len(moves), 1))  # a phrase ends, and the symbol starts the next
            table[0] = root
            rows = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
            columns = np.fromiter((s for m in moves for s in m), np.int64, len(rows))
            table[rows, columns] = (np.fromiter((to for m in moves for to in m.values()), np.int64, len(rows)) + at) * self.width * 4
            tables.append(table)
            self.starts.append(at * self.width)
            at += len(moves)
        table = np.concatenate(tables) if tables else np.zeros((1, 1), np.int64)
        self.table = (table.astype(np.int32) if table.max(initial=0) < 1 << 31 else table).ravel()

    def phrases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases (texts x languages) of the texts ``data[starts:ends]``."""
        out = np.zeros((len(starts), len(self.languages)), np.int64)
        data, starts, ends = folded(data, starts, ends)
        data = np.concatenate([data, np.zeros(PIECE, np.uint8)])  # a window of a whole piece fits at every place
        pieces = -(-(ends - starts) // PIECE)
        owner = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lo = starts[owner] + nth * PIECE
        hi = np.minimum(lo + PIECE, ends[owner])
        order = np.argsort(lo - hi, kind="stable")  # the longest first: those still being read are the first ones
        for a in range(0, len(order), SIDE):
            at = order[a : a + SIDE]
            np.add.at(out, owner[at], self._pieces(data, lo[at], hi[at] - lo[at]))
        return out

    def _pieces(self, data: np.ndarray, lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        languages, longest = len(self.languages), int(sizes[0])
        steps = np.lib.stride_tricks.sliding_window_view(data, longest)[lo]
        symbols = np.ascontiguousarray(self.symbol[steps].T).astype(self.table.dtype)
        reading = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many pieces are longer than t bytes
        state = np.repeat(np.array(self.starts, self.table.dtype)[:, None], len(lo), axis=1)
        ended = np.zeros((languages, len(lo)), np.int32)
        for t in range(longest):
            k = reading[t]
            for j in range(languages):
                step = self.table.take(state[j, :k] + symbols[t, :k])
                ended[j, :k] += step & 3
                state[j, :k] = step >> 2
        # What was being matched at the end is a phrase too, unless the end is the start state.
        return (ended + (state != np.array(self.starts, self.table.dtype)[:, None])).T

    def choose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winner's place in ``languages`` and the score of every text."""
        cost = self.phrases(data, starts, ends) * self.bits
        best = cost.argmin(axis=1)
        if cost.shape[1] == 1:
            return best, np.ones(len(best))
        two = np.partition(cost, 1, axis=1)
        second = two[:, 1]
        score = np.where(second > 0, 1 - two[:, 0] / np.where(second > 0, second, 1), 0.0)
        return best, score


def references(docs: DataFrame, learn: Column, reference_bytes: int = 1 << 16, total_bytes: int = 1 << 20, rows: int = 96) -> list[tuple[str, bytes]]:
    """(language, text) by code point, from at most ``rows`` labelled texts of each language."""
    known = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", F.lit("lang")).alias("_h"))
    languages = known.select("lang").distinct().count()
    share = max(64, min(reference_bytes, total_bytes // max(languages, 1)))
    # Texts that fit come first; the first rows of each part are kept map-side, so no language's rows meet in one task.
    known = known.withColumn("_b", F.octet_length("text")).withColumn("_long", F.when(F.col("_b") > share, F.col("_b")).otherwise(0))
    first = known.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_long", "_h", "_b", "text"))).filter(F.col("_r") <= rows)
    got = first.select("lang", "_r", F.when(F.col("_long") > 0, F.substring(F.col("text").cast("binary"), 1, share)).otherwise(F.col("text").cast("binary")).alias("text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["_r"])):
        have = texts.setdefault(r["lang"], [])
        if sum(map(len, have)) + len(r["text"]) + len(have) <= share or not have:
            have.append(bytes(r["text"]))
    return [(lang, b"\n".join(t)) for lang, t in sorted(texts.items())]


def identify(docs: DataFrame, known: list[tuple[str, bytes]]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(known)
    key = f"lang_id {uuid.uuid4().hex}"

    def run(batches):
        parser = held(key, lambda: Parser(shared.value))
        languages = np.array([*parser.languages, "und"], object)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            best, score = np.full(len(texts), len(parser.languages)), np.zeros(len(texts))
            at = np.flatnonzero(batch.column("_letter").to_numpy(zero_copy_only=False))
            if len(at) and parser.languages:
                best[at], score[at] = parser.choose(data, ends[:-1][at], ends[1:][at])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(languages[best], pa.string()), "score": pa.array(score)})

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("_letter")).mapInArrow(run, "doc_id long, lang_pred string, score double")
