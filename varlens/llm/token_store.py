"""Token ids as Arrow stream files of fixed-size lists, with zero-copy random access.

Documents are range-partitioned and sorted by doc_id; each partition is one shard file in the Arrow
stream format, whose batches hold ``ids`` and ``mask``, lists of exactly ``row`` values. Documents
follow one another without gaps; only a shard's last row is padded, and its mask says where. A reader
maps the file and slices any document or row without copying. Ids take two bytes where the vocabulary
allows. An index table (doc_id, file, start within the shard, n_tokens) says where documents are.

Scale: one shuffle of the texts, to sort them; a shard is streamed, never held whole; files go to
the cluster's shared folder through Arrow's file systems under names that hold the task attempt, so a
lost or repeated task leaves an unused file and no wrong one.

Defined results: a null or empty text is its end id alone; a null doc_id comes last; rows with equal
doc_id are ordered by a hash of the text; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varlens.llm.common import partitions
from varlens.llm.tokens import default_path, encode_documents, encoder_of
from varlens.session import Scratch, ship

ROWS_A_BATCH = 256
#: A file ends with the run of texts that brings it to this many ids, so that none grows with the data.
IDS_A_FILE = 1 << 25
INDEX = "doc_id long, file string, shard long, local long, n_tokens long"


def schema_of(row: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), row)), ("mask", pa.list_(pa.bool_(), row))])


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, row: int = 2048, shards: int = 32, most: int = IDS_A_FILE) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; returns the index."""

    def write(batches):
        import pyarrow.fs
        from pyspark import TaskContext

        kind = np.uint16 if encoder_of(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        schema = schema_of(row, kind)
        task = TaskContext.get()
        writer = sink = target = None
        rest, before, part = np.zeros(0, kind), 0, 0

        def put(ids, real):
            ids_list = pa.FixedSizeListArray.from_arrays(pa.array(ids), row)
            mask = np.zeros(len(ids), bool)
            mask[:real] = True
            writer.write_batch(pa.record_batch([ids_list, pa.FixedSizeListArray.from_arrays(pa.array(mask), row)], schema=schema))

        try:
            for doc_ids, ids, starts, lengths in encode_documents(batches, tokenizer, end_id):
                if writer is None:
                    target = f"{folder}/shard-{task.partitionId():06d}-{part:06d}-{task.taskAttemptId()}.arrow"
                    fs, path = pyarrow.fs.FileSystem.from_uri(target)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    sink = fs.open_output_stream(path, compression=None)
                    writer = pa.ipc.new_stream(sink, schema)
                rest = np.concatenate([rest, ids.astype(kind)])
                unit = row * ROWS_A_BATCH
                for a in range(0, len(rest) - unit + 1, unit):
                    put(rest[a : a + unit], unit)
                rest = rest[len(rest) // unit * unit :].copy()
                n = len(lengths)
                yield pa.record_batch({"doc_id": doc_ids, "file": pa.array([target] * n), "shard": pa.array(np.full(n, (task.partitionId() << 32) + part, np.int64)), "local": pa.array(before + starts), "n_tokens": pa.array(lengths)})
                before += len(ids)
                if before >= most:  # the next run of texts begins a file
                    if len(rest):
                        put(np.concatenate([rest, np.zeros(-len(rest) % row, kind)]), len(rest))
                    writer.close()
                    sink.close()
                    writer, rest, before, part = None, np.zeros(0, kind), 0, part + 1
            if len(rest):
                put(np.concatenate([rest, np.zeros(-len(rest) % row, kind)]), len(rest))
        finally:
            if writer is not None:
                writer.close()
                sink.close()

    ship(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h")]
    sorted_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return sorted_docs.select("doc_id", "text").mapInArrow(write, INDEX)


class ShardReader:
    """Random access to one file: mapped where local, otherwise read whole, at most about IDS_A_FILE ids and one run of texts."""

    def __init__(self, uri: str):
        import pyarrow.fs

        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        source = pa.memory_map(path) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(path)
        with pa.ipc.open_stream(source) as reader:
            self.batches = list(reader)
            self.row = reader.schema.field("ids").type.list_size
        self.ids = [b.column("ids").flatten().to_numpy(zero_copy_only=True) for b in self.batches]

    def pieces(self, start: int, length: int):
        """Views of the ids [start, start + length), one for each batch they lie in."""
        unit = self.row * ROWS_A_BATCH
        while length > 0:
            k, at = divmod(start, unit)
            view = self.ids[k][at : at + length]
            yield view
            start, length = start + len(view), length - len(view)

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row n of the shard: its ids (a view) and its mask."""
        k, at = divmod(n, ROWS_A_BATCH)
        return self.ids[k][at * self.row : (at + 1) * self.row], self.batches[k].column("mask")[at].values.to_numpy(zero_copy_only=False)


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the file, from the files of an index."""

    def read(batches):
        opened, reader = None, None
        for batch in batches:
            files, starts, counts = (batch.column(c).to_pylist() for c in ("file", "local", "n_tokens"))
            sums = []
            for file, start, count in zip(files, starts, counts, strict=True):
                if file != opened:
                    opened, reader = file, ShardReader(file)
                crc = 0
                for view in reader.pieces(start, count):
                    crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": pa.array(sums, pa.int64()), "file": batch.column("file")})

    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))  # a row for each file
    totals = totals.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    placed = index.join(F.broadcast(totals), "shard").withColumn("start", F.col("_before") + F.col("local"))
    return placed.select("doc_id", "file", "local", "start", "n_tokens").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def store_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, row: int = 2048, shards: int | None = None, most: int = IDS_A_FILE) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    index = write_shards(docs, scratch.path + "/files", tokenizer or default_path(), end_id, row, shards or partitions(spark), most)
    return read_back(scratch.save(index, "index"))
