"""Audit of sources: how far the term frequencies of each source lie from the others of its language.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Every (language, source) group gives each term that
at least ``least`` documents of the language hold a smoothed share in billionths, ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, N its
occurrences of kept terms and V their number. Part ``pair`` sums |p - q| over all kept terms for each two sources of a language;
part ``term`` lists the terms of a source that lie most above the language's own share.

Tokenizer: a batch's texts are one UTF-8 buffer. A table of 256 entries marks and lower-cases the bytes of terms, and the changes of
the mark (a text's end counts as one) are the boundaries. Slices are hashed with XXH64, all of one length at a time, sorted by hash and
compared byte by byte with the first of their hash, so two terms that share a hash are still counted apart. Each task adds up
its counts by (group, term) and gives them out when ``HELD`` entries are there, so a term's rows that travel are few.

Divergences: kept terms are dealt by a hash into blocks of some ``block`` rows (a language's size does not matter), with all its
sources in each. A block is a CSR matrix, sources by terms; a source's dense row is gathered at all entries, and
``np.add.reduceat`` over the row pointers gives its distances to all sources. Absent entries have a share too: what they add is
known from counts alone. Sums over blocks are the result.

All arithmetic is in integers, 64 bits where they hold it, else Python's or decimals. Only the number of rows reaches the driver.
The result has a row for each two sources of a language, and a block gives as many; blocks grow where sources are more than 300.

Defined results: null text, lang and source are ''. Groups without terms take part; a language without kept terms has pairs of
value 0 and no terms; a language's only source has no pair. Repeated rows are separate documents. Equal values rank by item. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlens.session import Scratch, ship

#: Entries of (group, term) that a task holds before it gives them out; bytes of texts that are cut at a time.
HELD, CUT = 1 << 20, 1 << 22
#: Smoothing and the unit of shares.
ADD, UNIT = 5, 1_000_000_000

#: Byte to lower-cased byte of a term; 0 for bytes outside terms.
_TERM = np.zeros(256, np.uint8)
_TERM[97:123] = np.arange(97, 123)
_TERM[65:91] = np.arange(97, 123)
_TERM[128:] = np.arange(128, 256)

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices; those of one length below 32 are hashed together, longer ones by the library."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    bounds = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(bounds, bounds[1:], strict=False):
        at = order[a:b]
        size = int(sizes[at[0]])
        if size >= 32:
            out[at] = [xxhash.xxh64_intdigest(data[s : s + size].tobytes()) for s in starts[at]]
            continue
        rows = data[starts[at][:, None] + np.arange(size)] if size else np.zeros((len(at), 0), np.uint8)
        h = np.full(len(at), _P5 + np.uint64(size))
        i = 0
        while i + 8 <= size:
            lane = np.ascontiguousarray(rows[:, i : i + 8]).view("<u8")[:, 0]
            h = _turn(h ^ (_turn(lane * _P2, 31) * _P1), 27) * _P1 + _P4
            i += 8
        if i + 4 <= size:
            lane = np.ascontiguousarray(rows[:, i : i + 4]).view("<u4")[:, 0].astype(np.uint64)
            h = _turn(h ^ (lane * _P1), 23) * _P2 + _P3
            i += 4
        for j in range(i, size):
            h = _turn(h ^ (rows[:, j].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[at] = h ^ (h >> np.uint64(32))
    return out


def slices(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, sizes, number of the text) of all terms of texts that end at ``ends``."""
    data = _TERM[text]
    inside = np.concatenate([[False], data != 0, [False]])
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    stops = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A run that crosses the end of a text is cut there.
    cuts = ends[(ends > 0) & (ends < len(data))]
    cuts = np.unique(cuts[(data[cuts] != 0) & (data[cuts - 1] != 0)])
    starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    return data, starts, stops - starts, np.searchsorted(ends, starts, side="right")


def grouped(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of every slice, a slice of each group): by hash, then by exact bytes."""
    _, first, group = np.unique(hashed, return_index=True, return_inverse=True)
    model = first[group]
    wrong = sizes != sizes[model]
    for size in np.unique(sizes):
        at = np.flatnonzero((sizes == size) & ~wrong & (model != np.arange(len(sizes))))
        for a in range(0, len(at), 1 << 16):
            some = at[a : a + (1 << 16)]
            step = np.arange(size)
            wrong[some] = (data[starts[some][:, None] + step] != data[starts[model[some]][:, None] + step]).any(axis=1)
    if wrong.any():  # different terms with one hash
        more: dict[bytes, int] = {}
        extra = []
        for i in np.flatnonzero(wrong):
            term = data[starts[i] : starts[i] + sizes[i]].tobytes()
            if term not in more:
                more[term] = len(first) + len(extra)
                extra.append(i)
            group[i] = more[term]
        first = np.concatenate([first, np.array(extra, first.dtype)])
    return group, first


class Counter:
    """Occurrences and documents by (group of documents, term) of one task."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[np.ndarray] = []
        self.entries = 0

    def add(self, text: np.ndarray, ends: np.ndarray, groups: list[tuple[str, str]]) -> None:
        data, starts, sizes, number = slices(text, ends)
        own = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        if not len(starts):
            return
        group, first = grouped(data, starts, sizes, hashes(data, starts, sizes))
        ids = np.array([self.terms.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), len(self.terms)) for i in first], np.int64)
        pairs, count = np.unique(group * len(ends) + number, return_counts=True)  # one for each term of each document
        keys = own[pairs % len(ends)] << 32 | ids[pairs // len(ends)]
        self._merge(np.stack([keys, count, np.ones_like(count)]))

    def _merge(self, new: np.ndarray) -> None:
        self.parts.append(_added(new))
        self.entries += self.parts[-1].shape[1]

    def full(self) -> bool:
        """Whether more than ``HELD`` entries are left after adding up equal ones."""
        if self.entries > 2 * HELD:
            self.parts = [_added(np.concatenate(self.parts, axis=1))]
            self.entries = self.parts[0].shape[1]
            return self.entries > HELD
        return False

    def rows(self):
        """Record batches of what is held; the counter is empty then."""
        if self.parts:
            keys, count, docs = _added(np.concatenate(self.parts, axis=1))
            terms, groups = pa.array(list(self.terms), pa.binary()), list(self.groups)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            for a in range(0, len(keys), 1 << 16):
                k = keys[a : a + (1 << 16)]
                columns = [langs.take(pa.array(k >> 32)), sources.take(pa.array(k >> 32)), terms.take(pa.array(k & 0xFFFFFFFF))]
                yield pa.record_batch([*columns, pa.array(count[a : a + (1 << 16)]), pa.array(docs[a : a + (1 << 16)])], ["lang", "source", "term", "count", "docs"])
        self.__init__()


def _added(part: np.ndarray) -> np.ndarray:
    """(key, count, documents) columns with the sums of equal keys."""
    order = np.argsort(part[0], kind="stable")
    part = part[:, order]
    at = np.flatnonzero(np.diff(part[0], prepend=-1))
    return np.stack([part[0][at], *(np.add.reduceat(part[i], at) for i in (1, 2))]) if len(at) else part


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs``: occurrences of a term in a group's documents, and documents that hold it."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def run(batches):
        counter = Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            a = 0
            while a < len(texts):  # some texts at a time, one at least
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + CUT, side="right")) - 1)
                counter.add(data[bounds[a] : bounds[b]], bounds[a + 1 : b + 1] - bounds[a], groups[a:b])
                a = b
                if counter.full():
                    yield from counter.rows()
        yield from counter.rows()

    rows = docs.select(text("text").alias("text"), text("lang").alias("lang"), text("source").alias("source"))
    out = rows.mapInArrow(run, "lang string, source string, term binary, count long, docs long")
    return out.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), exact."""
    if int(count.max(initial=0)) + ADD < (1 << 63) // UNIT:
        return 1 + UNIT * (count + ADD) // total
    return np.array([1 + UNIT * (int(c) + ADD) // int(t) for c, t in zip(count, total, strict=True)], np.int64)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``bounds``, empty ones included."""
    out = np.zeros(len(bounds) - 1, np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out


def distances(row: np.ndarray, column: np.ndarray, count: np.ndarray, totals: np.ndarray, width: int) -> np.ndarray:
    """Sums of |p - q| over ``width`` terms for each two sources (sources x sources), from CSR entries sorted by row."""
    sources = len(totals)
    bounds = np.searchsorted(row, np.arange(sources + 1))
    share, absent = _shares(count, totals[row]), _shares(np.zeros(sources, np.int64), totals)
    out = np.zeros((sources, sources), np.int64)
    for a in range(sources):
        own = slice(bounds[a], bounds[a + 1])
        dense = np.full(width, absent[a])
        dense[column[own]] = share[own]
        here = dense[column]
        # All terms as if the other source lacked them, then what its entries change.
        lacking = np.abs(share[own][:, None] - absent[None, :]).sum(axis=0) if sources * (own.stop - own.start) < 1 << 22 else np.array([np.abs(share[own] - q).sum() for q in absent])
        lacking = lacking + (width - (own.stop - own.start)) * np.abs(absent[a] - absent)
        out[a] = lacking + _sums(np.abs(here - share) - np.abs(here - absent[row]), bounds)
    return out


def audit(docs: DataFrame, least: int = 30, ranks: int = 50, block: int = 100_000) -> DataFrame:
    """``lang, source, part, item, value, rank`` as the module's docstring says."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = scratch.save(docs.select(text("lang").alias("lang"), text("source").alias("source")).distinct(), "groups")
    by_term = Window.partitionBy("lang", "term")
    kept = count_terms(docs).withColumn("_docs", F.sum("docs").over(by_term)).filter(F.col("_docs") >= least).select("lang", "source", "term", "count")
    kept = scratch.save(kept, "kept")
    size = kept.groupBy("lang").agg(F.count("*").alias("rows"), F.countDistinct("term").alias("v"), F.sum("count").alias("all"))
    widest = groups.groupBy("lang").count().agg(F.max("count")).head()[0] or 0
    rows = max(block, widest * widest)
    size = size.withColumn("blocks", F.ceil(F.col("rows") / rows).cast("long"))
    facts = groups.join(size, "lang", "left").join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
    add = F.coalesce(F.col("v"), F.lit(0)) * ADD
    facts = facts.select("lang", "source", F.coalesce("blocks", F.lit(1)).alias("blocks"), (F.coalesce("n", F.lit(0)) + add).alias("total"), (F.coalesce("all", F.lit(0)) + add).alias("lang_total"))
    facts = scratch.save(facts, "facts")
    dealt = kept.join(size.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).select("lang", "block", "source", "term", "count")
    everywhere = facts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("lang", "block", "source", "total", "lang_total")

    def of_block(entries, sources):
        sources = sources.sort_by("source")
        names = sources.column("source").to_pylist()
        totals = sources.column("total").to_numpy()
        terms, column = np.unique(np.array(entries.column("term").to_pylist(), object), return_inverse=True) if entries.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
        place = {s: i for i, s in enumerate(names)}
        row = np.array([place[s] for s in entries.column("source").to_pylist()], np.int64)
        count = entries.column("count").to_numpy().astype(np.int64)
        order = np.lexsort((column, row))
        row, column, count = row[order], column[order], count[order]
        out = []
        if len(terms):
            apart = distances(row, column, count, totals, len(terms))
            whole = np.zeros(len(terms), np.int64)
            np.add.at(whole, column, count)
            q = _shares(whole, np.full(len(terms), sources.column("lang_total")[0].as_py(), np.int64))
            above = _shares(count, totals[row]) - q[column]
            bounds = np.searchsorted(row, np.arange(len(names) + 1))
        else:
            apart = np.zeros((len(names), len(names)), np.int64)
        for a, name in enumerate(names):
            out += [(name, "pair", other, int(apart[a, b])) for b, other in enumerate(names) if b != a]
            if len(terms):
                # The best of a block hold the best of all; terms are sorted, so equal values keep their order.
                own = np.arange(bounds[a], bounds[a + 1])[above[bounds[a] : bounds[a + 1]] > 0]
                best = own[np.argsort(-above[own], kind="stable")[:ranks]]
                out += [(name, "term", terms[column[i]].decode(errors="replace"), int(above[i])) for i in best]
        lang = sources.column("lang")[0].as_py()
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), **{n: pa.array(c, t) for n, c, t in zip(("source", "part", "item", "value"), columns, (pa.string(),) * 3 + (pa.int64(),), strict=True)}})

    found = dealt.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(of_block, "lang string, source string, part string, item string, value long")
    found = scratch.save(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "found")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs, terms = (found.filter(F.col("part") == p).withColumn("rank", rank) for p in ("pair", "term"))
    return pairs.unionByName(terms.filter(F.col("rank") <= ranks))
