"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Every source's documents are shuffled by a hash and laid end to end: one epoch of the source's
stream of words. The stream, repeated for up to ``max_epochs`` epochs, is cut into blocks of
``block`` words. A schedule of N slots, as many as there are blocks to take, maps slot i to the
golden-ratio point ``(i * g mod N) / N`` (g is the integer nearest N / phi that is coprime to N, so
the N points are all different), the point to a source through cumulative weights, and the slot's
rank within its source to that source's block of the same rank. Any run of slots thus holds the
sources nearly in proportion, and the whole schedule holds them exactly.

Scale: no step gathers a source. Offsets in a source's stream come from sums over 4,096 hash
buckets and a running sum inside each; ranks of slots come from counts over chunks of slots and a
row number inside each. The join is on (source, block), a key with at most a few documents' pieces.
Only one row per source is ever ordered as a whole.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows
that repeat (same doc_id or wholly equal) are separate documents; an empty table gives an empty
result; a document of size 0 takes 0 words; other columns of the input pass through untouched and may
have any name not starting with ``_mx_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.common import partitions, word_count
from varlens.session import Scratch

CHUNK = 1 << 16
EXTRA = ["_mx_s", "_mx_b", "_mx_r"]


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: ``_mx_source, source_size, weight, target, _mx_s``.

    Weights repeat ``cycle`` over the sources in code-point order, null last. Targets share the sum of
    all sizes by weight; none exceeds ``max_epochs`` times its source's size, and what is above is
    shared again by weight until none is. That fixed point is found in one step: in ascending order
    of size per weight, the capped sources are a prefix.
    """
    per = sized.groupBy(F.col("_mx_source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("_mx_source").asc_nulls_last())
    per = per.withColumn("_mx_s", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_mx_s") % len(cycle) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    order = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_mx_s"))
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("_k", F.row_number().over(order))
        .withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_w", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    level = F.col("weight") * F.col("_left") / F.col("_w")
    per = per.withColumn("_first", F.min(F.when(level <= F.col("_cap"), F.struct("_k", "_left", "_w"))).over(whole))
    free = F.col("weight") * F.col("_first._left") / F.col("_first._w")
    target = F.when(F.col("_k") < F.col("_first._k"), F.col("_cap").cast("double")).otherwise(free.cast("double"))
    return per.select("_mx_source", "source_size", "weight", target.alias("target"), "_mx_s")


def golden_step(n: int) -> int:
    """The integer nearest n / phi that is coprime to n."""
    if n <= 2:
        return 1
    g = round(n * (math.sqrt(5) - 1) / 2)
    return next(c for d in range(n) for c in (g + d, g - d) if 0 < c < n and math.gcd(c, n) == 1)


def _lattice(i: Column, g: int, n: int) -> Column:
    """i * g mod n without overflow for n up to 2**42."""
    high, low = F.shiftright(i, 20), i.bitwiseAND(F.lit((1 << 20) - 1))
    return ((high * g) % n * (1 << 20) + low * g) % n


def schedule_slots(spark, targets: DataFrame, block: int) -> DataFrame:
    """``slot, _mx_s, block``: which block of which source each slot takes. ``targets`` is small and saved."""
    need = targets.select("_mx_s", F.floor("target").alias("_need"))
    need = need.withColumn("_n", F.ceil(F.col("_need") / block).cast("long")).filter("_n > 0")
    n = need.agg(F.sum("_n")).head()[0] or 0
    upto = F.sum("_n").over(Window.orderBy("_mx_s"))
    # Cells of the unit interval turn the search for a point's source into an equality join.
    cell = max(1, -(-n // 4096))
    cells = (
        need.select("_mx_s", (upto - F.col("_n")).alias("_lo"), upto.alias("_hi"))
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor((F.col("_hi") - 1) / cell))))
    )
    slots = spark.range(n).select(F.col("id").alias("slot"), _lattice(F.col("id"), golden_step(n), max(n, 1)).alias("_p"))
    slots = slots.withColumn("_cell", F.floor(F.col("_p") / cell)).join(cells, "_cell")
    slots = slots.filter("_p >= _lo and _p < _hi").select("slot", "_mx_s", F.floor(F.col("slot") / CHUNK).alias("_chunk"))
    sums = slots.groupBy("_mx_s", "_chunk").count()
    sums = sums.withColumn("_before", F.sum("count").over(Window.partitionBy("_mx_s").orderBy("_chunk")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("_mx_s", "_chunk").orderBy("slot")) - 1
    return slots.withColumn("_rank", rank).join(sums.drop("count"), ["_mx_s", "_chunk"]).select("slot", "_mx_s", (F.col("_before") + F.col("_rank")).alias("block"))


def mix(docs: DataFrame, block: int = 1024, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (needs doc_id, text, source).

    Returns ``(documents, schedule)``. documents: doc_id, size, source_size, target, taken, the first slot that
    takes some of it (null if none does) and the row's key in the schedule. schedule: one row per piece of a document in a slot, ``slot, block, epoch, words``
    with the same key; reading it by slot is reading the mix.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = scratch.save(docs.select("doc_id", F.col("source").alias("_mx_source"), word_count(F.col("text")).alias("size"), order.alias("_mx_o")), "sized")
    targets = scratch.save(source_targets(sized, cycle, max_epochs), "targets")

    rows = sized.join(targets, sized["_mx_source"].eqNullSafe(targets["_mx_source"])).select("doc_id", "size", "source_size", "target", "_mx_s", "_mx_o", F.substring("_mx_o", 1, 3).alias("_mx_b"))
    sums = rows.groupBy("_mx_s", "_mx_b").agg(F.sum("size").alias("_sum"))
    sums = sums.select("_mx_s", "_mx_b", (F.sum("_sum").over(Window.partitionBy("_mx_s").orderBy("_mx_b")) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy("_mx_s", "_mx_b").orderBy("_mx_o", "doc_id", "size")
    rows = rows.withColumn("_mx_r", F.row_number().over(inside))
    rows = rows.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums, ["_mx_s", "_mx_b"]).withColumn("_start", F.col("_offset") + F.col("_in")).drop("_mx_o", "_offset", "_in")
    rows = scratch.save(rows, "rows")

    lo = F.col("epoch") * F.col("source_size") + F.col("_start")
    pieces = (
        rows.filter("size > 0")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
        .withColumn("_lo", lo)
        .withColumn("_hi", F.least(F.col("_lo") + F.col("size"), F.floor("target")))
        .filter("_lo < _hi")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
        .withColumn("words", F.least(F.col("_hi"), (F.col("block") + 1) * block) - F.greatest(F.col("_lo"), F.col("block") * block))
    )
    schedule = schedule_slots(spark, targets, block).join(pieces.select(*EXTRA, "doc_id", "block", "epoch", "words", "_lo"), ["_mx_s", "block"])
    taken = schedule.groupBy(*EXTRA).agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = rows.join(taken, EXTRA, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot", *EXTRA), schedule


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them, in the order of its schedule.

    A row comes once for each epoch that takes at least half of its words, at the place of the first slot of that epoch that
    takes some of them; a source's stream ends within one document, so its words are its target's to within that document's. Partitions are
    runs of slots, in order, and so are the rows in them: any stretch of the result holds the sources nearly in proportion. Rows that
    share a doc_id go together: an epoch takes them all if it takes half of their words. Documents without words are not taken.
    """
    taken, schedule = mix(docs, **options)
    sizes = taken.groupBy("doc_id").agg(F.sum("size").alias("_mx_size")).filter("_mx_size > 0").withColumnRenamed("doc_id", "_mx_id")
    copies = schedule.groupBy("doc_id", "epoch").agg(F.sum("words").alias("_mx_words"), F.min("slot").alias("_mx_slot"))
    copies = copies.join(sizes, F.col("doc_id").eqNullSafe(F.col("_mx_id"))).filter("2 * _mx_words >= _mx_size").select("_mx_id", "_mx_slot")
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies["_mx_id"])).select(*[docs[c] for c in docs.columns], "_mx_slot", "_mx_id")
    order = ["_mx_slot", "_mx_id"]  # documents that begin in one slot follow by id
    return joined.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop(*order)
