"""MinHash near-dedup: universal hash minima, banding, verification, connected components.

A text's words (A-Z lower-cased) give its set of ``width``-word shingles, as 64-bit hashes. Texts with
equal sets are one class and count once from there on. ``BANDS * ROWS`` multiply-add-shift hashes
give minima; classes that agree on all minima of some band are candidates. At similarity 0.8 a pair
shares no band with probability (1 - 0.8**5)**32 = 3e-6.

No bucket is expanded into pairs. Each member is first paired with the smallest member of its bucket,
and for each class the pair that shares most bands is confirmed on the full sets; the links give
components. Only members whose component differs from that of their bucket's smallest member are then
compared with the members of other components, in blocks: first by signature, which leaves the
members that have a partner within 5.6 standard deviations of the threshold, then, likeliest first, on
the full sets, until the two components are linked. What leaves a block is a spanning set of links.
So every link between candidates is either confirmed or joins classes that are connected already.

Scale: texts are read once for the sketch; only texts of candidate classes are read again and moved.
Hot buckets are combined map-side; members return to them by a join that adaptive execution splits.
A bucket's outliers and other members are cut into chunks of about half a ``BLOCK``; an outliers' chunk meets each chunk
from itself on, in a unit of its own, so that every pair is compared once and two chunks bound what a task holds.

Defined results: a null or blank text has the empty set, is linked with nothing and is its own
component; texts with fewer words than ``width`` have one shingle, all their words; rows that share a
doc_id are one document, whatever their texts: their classes are linked through it, and a blank row goes with the other rows of
its id; rows without doc_id take part, and a component made only of them has a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.llm.components import components
from varlens.session import Scratch, held, ship

BANDS, ROWS = 32, 5
BLOCK = 1024
_M = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), np.uint64) | np.uint64(1)
_W = np.random.default_rng(11).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for up to ``most`` of them."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.most, self.digest = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.digest(word)
        if len(self) < self.most:
            self[word] = value
        return value


def shingle_set(text: bytes | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. bytes.split() splits at exactly 9 to 13 and 32."""
    found = (text or b"").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(n, width)
    s = np.full(n - k + 1, k, np.uint64) * _W[63]
    for j in range(k):
        s += w[j : n - k + 1 + j] * _W[j]
    return np.unique(_stir(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima, 32 bits each."""
    x = shingles >> np.uint64(32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(x), 256):
        np.minimum(low, (np.multiply.outer(_M[0], x[a : a + 256]) + _M[1][:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _sketch(width: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        words = held("words", WordHashes)
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text, width, words)
                counts.append(len(s))
                digests.append(xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s))
            if not counts:
                continue
            sig = np.array(sigs, np.uint32)
            keyed = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
            band = _stir(np.arange(BANDS, dtype=np.uint64) * _W[62] + (keyed * _W[:ROWS]).sum(axis=2, dtype=np.uint64)).view(np.int64)
            low = np.ascontiguousarray((sig & 255).astype(np.uint8))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "row": batch.column("row"),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "digest": pa.array(digests, pa.binary()),
                    "sig": pa.array([x.tobytes() for x in low], pa.binary()),
                    "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, BANDS, dtype=np.int32)), pa.array(band.ravel())),
                }
            )

    return run


def _sets(width: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        words = held("words", WordHashes)
        for batch in batches:
            sets = [shingle_set(t, width, words).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"digest": pa.array([xxh3_128_digest(s) for s in sets], pa.binary()), "shingles": pa.array(sets, pa.binary())})

    return run


def _confirm(part: int, whole: int):
    def run(batches):
        for batch in batches:
            keep = []
            a_all, b_all = batch.column("a"), batch.column("b")
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (a_all, b_all))
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                if whole * common >= part * (len(both) - common):
                    keep.append(i)
            if keep:
                yield batch.select(["u", "v"]).take(pa.array(keep))

    return run


ROW = "h long, unit long, own long, lead long, node long, comp long, n_shingles long, sig binary, bands array<long>"


def _groups(batches):
    """Tables of one (h, unit) each, from batches sorted by it."""
    open_key, parts = None, []
    for batch in batches:
        h, unit = batch.column("h").to_numpy(), batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (unit[1:] != unit[:-1])) + 1).tolist(), len(h)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if (key := (h[a], unit[a])) != open_key:
                    if parts:
                        yield parts
                    open_key, parts = key, []
                parts.append(batch.slice(a, b - a))
    if parts:
        yield parts


class _Block:
    """Two chunks of a bucket that are compared with each other, or one with itself."""

    def __init__(self, rows: pa.Table, part: int, whole: int):
        self.rows, self.part, self.whole = rows, part, whole
        self.comp = rows.column("comp").to_numpy().copy()
        self.n = rows.column("n_shingles").to_numpy()
        self.own = rows.column("own").to_numpy()
        self.outliers = np.flatnonzero(self.own == rows.column("lead").to_numpy())  # the chunk whose members look for partners
        self.inside = bool((self.own == self.own[0]).all())
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.band = int((self.bands[0] == rows.column("h")[0].as_py()).argmax())
        share = part / whole
        self.enough = share - 5.6 * np.sqrt(share * (1 - share) / (BANDS * ROWS))

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that may be linked with i, likeliest first; each pair in its first common band only."""
        n = self.n
        other = self.comp != self.comp[i]
        if self.inside:
            other[: i + 1] = False
        else:
            other &= self.own != self.own[i]
        at = np.flatnonzero(other & (self.whole * np.minimum(n, n[i]) >= self.part * np.maximum(n, n[i])))
        at = at[(self.bands[at] == self.bands[i]).argmax(axis=1) == self.band]
        alike = (self.sig[at] == self.sig[i]).mean(axis=1)
        order = np.argsort(-alike, kind="stable")
        return at[order][alike[order] >= self.enough]


def _involved(part: int, whole: int):
    """The rows of blocks that have a partner, by signature."""

    def run(batches):
        for parts in _groups(batches):
            rows = pa.Table.from_batches(parts)
            if rows.num_rows < 2:
                continue
            block = _Block(rows, part, whole)
            keep = np.zeros(rows.num_rows, bool)
            for i in block.outliers:
                found = block.partners(i)
                keep[found] = True
                keep[i] |= len(found) > 0
            if keep.any():
                yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return run


def _span(part: int, whole: int):
    """Links on full sets that join the components of a block."""

    def run(batches):
        for parts in _groups(batches):
            rows = pa.Table.from_batches(parts)
            block = _Block(rows, part, whole)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
            node = rows.column("node").to_numpy()
            u, v = [], []
            for i in block.outliers:
                for j in block.partners(i):
                    if block.comp[i] != block.comp[j]:
                        both = np.sort(np.concatenate([sets[i], sets[j]]))
                        common = int((both[1:] == both[:-1]).sum())
                        if whole * common >= part * (len(both) - common):
                            u.append(node[i])
                            v.append(node[j])
                            block.comp[block.comp == block.comp[j]] = block.comp[i]
            if u:
                yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def one_of_each(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs``, all columns: one row of each component, and all blank rows without doc_id, each its own component.

    Rows that share a doc_id are one document, and so one row. The row stays that near_duplicates keeps, not a blank one
    if there is another, and the first of several.
    """
    marked = Scratch(docs.sparkSession, "one").save(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    found = Scratch(docs.sparkSession, "one").save(near_duplicates(marked, width, part, whole, "_row").select("row", "n_shingles", "kept", "group"), "found")
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(~F.col("kept"), F.col("n_shingles") == 0, "row"))["row"].alias("row"))
    gone = found.filter("group is not null").join(first, "row", "left_anti").select(F.col("row").alias("_row"))
    return marked.join(gone, "_row", "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (and, given a column ``row``, its values and group, a name of the component even where it has no id) for ``docs`` (doc_id, text), linking at part / whole or more."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(row) if row else F.lit(0)).cast("long").alias("row"))
    docs = keyed.select("doc_id", "text")
    rows = scratch.save(keyed.mapInArrow(_sketch(width), "doc_id long, row long, n_shingles long, digest binary, sig binary, bands array<long>"), "rows")

    # Rows of a class have one set, so any of them gives its sketch; hot classes are combined map-side. Classes are numbered as they are written.
    own = rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n_shingles", "sig", "bands")], F.count("*").alias("copies"))
    classes = scratch.save(own.withColumn("node", F.monotonically_increasing_id()), "classes")
    # Ids that several classes share, or a class and blank rows: few.
    worded_digest = F.when(F.col("n_shingles") > 0, F.col("digest"))
    ends = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min(worded_digest).alias("a"), F.max(worded_digest).alias("b"), F.min("n_shingles").alias("least"))
    shared = scratch.save(ends.filter("a != b or (a is not null and least = 0)"), "shared-ids")
    many_texts = shared.filter("a != b").select("doc_id", F.col("a").alias("_first"))
    tied = rows.filter("n_shingles > 0").select("doc_id", "digest").join(many_texts, "doc_id").filter("digest != _first").distinct()
    name = classes.select("digest", "node")
    tied = tied.join(name, "digest").select("_first", F.col("node").alias("u")).join(name.toDF("_first", "v"), "_first").select("u", "v")

    banded = classes.select("node", F.explode("bands").alias("h"))
    hubs = banded.groupBy("h").agg(F.min("node").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    members = scratch.save(banded.join(hubs, "h"), "members")
    stars = members.filter("node != hub").groupBy("hub", "node").count()
    best = stars.groupBy("node").agg(F.max(F.struct("count", (-F.col("hub")).alias("less"))).alias("b"))
    first = best.select(F.col("node").alias("u"), (-F.col("b.less")).alias("v"))
    size = classes.select("node", "n_shingles")

    def close(pairs: DataFrame) -> DataFrame:
        sized = pairs.join(size.toDF("u", "_nu"), "u").join(size.toDF("v", "_nv"), "v")
        return sized.filter(F.least("_nu", "_nv") * whole >= F.greatest("_nu", "_nv") * part).select("u", "v")

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        wanted = wanted.distinct().join(classes.select("node", "digest", F.col("low").alias("_id")), "node")
        ids = wanted.select("_id").distinct()
        read = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi").select("text").mapInArrow(_sets(width), "digest binary, shingles binary")
        return scratch.save(wanted.drop("_id").join(read.dropDuplicates(["digest"]), "digest").select("node", "shingles"), f"{name}-sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(close(pairs), f"{name}-pairs")
        sets = sets_of(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))), name)
        both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
        links = scratch.save(both.select("u", "v", "a", "b").mapInArrow(_confirm(part, whole), "u long, v long"), f"{name}-links")
        scratch.drop(f"{name}-sets")
        return links

    links = confirmed(first, "first").unionByName(tied)
    star = components(links, scratch, "first-cc")
    at = members.join(star.toDF("node", "_c"), "node", "left").join(star.toDF("hub", "_h"), "hub", "left")
    at = at.select("h", "members", "node", F.coalesce("_c", "node").alias("comp"), F.coalesce("_h", "hub").alias("hub_comp"))
    at = at.withColumn("outlier", F.col("comp") != F.col("hub_comp"))
    open_h = at.filter("outlier").groupBy("h").agg(F.count("*").alias("outliers"))
    at = scratch.save(at.join(open_h, "h"), "open")
    # Chunks of half a block, outliers' first; a unit is an outliers' chunk with one from there on, so each pair meets once.
    parts = lambda n: F.ceil(n * 2 / BLOCK).cast("long")
    out_chunks, chunks = F.col("_o"), F.col("_o") + F.col("_n")
    at = at.withColumn("_o", F.greatest(F.lit(1), parts(F.col("outliers")))).withColumn("_n", parts(F.col("members") - F.col("outliers")))
    chunk = F.when(F.col("outlier"), F.pmod(F.xxhash64("node"), out_chunks)).otherwise(out_chunks + F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col("_n"))))
    at = at.withColumn("own", chunk)
    met = F.when(F.col("outlier"), F.sequence(F.lit(0).cast("long"), chunks - 1)).otherwise(F.sequence(F.lit(0).cast("long"), out_chunks - 1))
    at = at.withColumn("_met", F.explode(met)).withColumn("lead", F.least("own", "_met"))
    at = at.withColumn("unit", F.col("lead") * chunks + F.greatest("own", "_met")).join(classes.select("node", "n_shingles", "sig", "bands"), "node")
    columns = [c.split()[0] for c in ROW.split(", ")]

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition("h", "unit").sortWithinPartitions("h", "unit")

    involved = scratch.save(blocks(at.select(*columns)).mapInArrow(_involved(part, whole), ROW), "involved")
    with_sets = involved.join(sets_of(involved.select("node"), "more"), "node").select(*columns, "shingles")
    more = scratch.save(blocks(with_sets).mapInArrow(_span(part, whole), "u long, v long").distinct(), "more-links")
    star = components(star.unionByName(more), scratch, "all-cc")

    ids = classes.select("digest", "node", "copies", "low").join(star.toDF("node", "_g"), "node", "left").select("digest", "copies", "low", F.coalesce("_g", "node").alias("_g"))
    # A component's id is the least doc_id in it; the copies of a class are counted once here.
    named = ids.groupBy("_g").agg(F.min("low").alias("_c"))
    ids = scratch.save(ids.drop("low").join(named, "_g").select("digest", "copies", "_c", F.concat(F.lit("class "), "_g").alias("_group"), F.lit(True).alias("_in")), "ids")
    # Classes of over a thousandth of the rows, fewer than a thousand, are broadcast to their rows, the others shuffled.
    hot = F.col("copies") * 1000 > rows.count()
    many, few = ids.filter(hot).drop("copies"), ids.filter(~hot).drop("copies")
    plain = rows.select("doc_id", "row", "n_shingles", "digest")
    worded = plain.filter("n_shingles > 0")
    out = worded.join(F.broadcast(many), "digest").unionByName(worded.join(F.broadcast(many.select("digest")), "digest", "left_anti").join(few, "digest"))
    # Blank rows stand alone, but for those whose id has other rows.
    blank = plain.filter("n_shingles = 0").drop("digest").join(shared.select("doc_id", F.col("a").alias("digest")), "doc_id", "left")
    alone = blank.filter("digest is null").select(*plain.columns, *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in ("_c", "_group", "_in")])
    out = out.unionByName(alone).unionByName(blank.filter("digest is not null").join(ids.drop("copies"), "digest").select(*out.columns))
    component = F.when(F.col("_in"), F.col("_c")).otherwise(F.col("doc_id"))
    columns = ["doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")]
    return out.select(*columns, *(["row", F.coalesce("_group", F.concat(F.lit("id "), "doc_id")).alias("group")] if row else []))
