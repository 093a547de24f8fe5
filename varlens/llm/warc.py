"""WARC archives with a two-level capture index.

Each page is one gzip member in a WARC file. Pages with equal payloads share one response, that of the
largest page_id; the others are revisit records that name it. Captures are sorted by reversed-host
URL keys into compressed blocks of ``LINES`` index lines; the directory keeps each block's first key and
byte range. A lookup searches the directory, then a block, by halving, and reads two byte ranges; ``lookup_urls``
does so for a table of URLs. The whole-table query reads every block instead.

Scale: equal payloads are found by a map-side combined aggregation of digests; the pages join only
the digests that occur more than once. Index lines are range-partitioned, so a host with most pages
spreads over many blocks. Files go to the shared folder under names that hold the task attempt; a
repeated task leaves an unused file and no wrong one.

Defined results: a null html is the empty payload; a null url has the key "-"; rows that repeat a
page_id and payload are equal captures, all response or all revisit; rows without page_id never are
the response if another page has their payload; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varlens.llm.common import partitions
from varlens.session import Scratch, ship

LINES = 500
DATE = "2024-01-01T00:00:00Z"
CAPTURES = "key string, page_id long, file string, offset long, length long"
DIRECTORY = "first_key string, first_id long, file string, offset long, length long, lines long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: lower-case host labels in reverse, then port, path and query."""
    if url is None:
        return "-"
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/@?#]*@)?([^/?#:]*)(:\d+)?([^#]*)", url, re.DOTALL)
    host, port, rest = m[1].lower().rstrip("."), m[2] or "", m[3]
    if rest[:1] != "/":
        rest = "/" + rest
    return ",".join(reversed(host.split("."))) + ("" if port in (":80", ":443") else port) + ")" + rest


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + payload_digest(payload))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])


def parse_record(data: bytes) -> dict:
    """page_id, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to; a wrong digest or length raises ValueError."""
    top, _, rest = data.partition(b"\r\n\r\n")
    head = _headers(top)
    block = rest[: int(head["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(_headers(http)["Content-Length"])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    refers = number(head["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": number(head["WARC-Record-ID"]), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Files:
    """Byte ranges of files on any of Arrow's file systems; keeps a few open."""

    def __init__(self):
        self.open: dict = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        import pyarrow.fs

        if uri not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = pyarrow.fs.FileSystem.from_uri(uri)
            self.open[uri] = fs.open_input_file(path)
        return zlib.decompress(self.open[uri].read_at(length, offset), 31)


class _Out:
    """A file of gzip members, opened when the first comes."""

    def __init__(self, folder: str, ending: str):
        from pyspark import TaskContext

        task = TaskContext.get()
        self.uri, self.at, self.sink = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}{ending}", 0, None

    def add(self, data: bytes) -> tuple[int, int]:
        if self.sink is None:
            import pyarrow.fs

            fs, path = pyarrow.fs.FileSystem.from_uri(self.uri)
            fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
            self.sink = fs.open_output_stream(path, compression=None)
        packed = _gzip(data)
        self.sink.write(packed)
        self.at += len(packed)
        return self.at - len(packed), len(packed)

    def close(self):
        if self.sink is not None:
            self.sink.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write WARC files below ``folder``; returns a capture row for each page."""

    def run(batches):
        out = _Out(folder, ".warc.gz")
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, top in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "top")), strict=True):
                    data = record(page_id, url, (html or "").encode(), None if top is None or top == page_id else top)
                    rows.append((url_key(url), page_id, out.uri, *out.add(data)))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length"])
        finally:
            out.close()

    ship(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("_digest"))
    shared = pages.groupBy("_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return pages.join(shared, "_digest", "left").select("page_id", "url", "html", "top").mapInArrow(run, CAPTURES)


def write_index(captures: DataFrame, folder: str, blocks_in: int) -> DataFrame:
    """Sort captures into compressed blocks below ``folder``; returns the directory."""

    def run(batches):
        out = _Out(folder, ".cdx.gz")

        def block(rows):
            text = "".join(f"{k}\t{json.dumps([i, f, a, n])}\n" for k, i, f, a, n in rows)
            return (rows[0][0], rows[0][1], out.uri, *out.add(text.encode()), len(rows))

        try:
            rest: list = []
            for batch in batches:
                rest += zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "offset", "length")), strict=True)
                done = [block(rest[a : a + LINES]) for a in range(0, len(rest) - LINES + 1, LINES)]
                rest = rest[len(done) * LINES :]
                if done:
                    yield _directory(done)
            if rest:
                yield _directory([block(rest)])
        finally:
            out.close()

    order = [F.col("key"), F.col("page_id").asc_nulls_first()]
    lines = captures.withColumn("key", F.regexp_replace("key", "[\t\n\r]", " "))
    return lines.repartitionByRange(blocks_in, *order).sortWithinPartitions(*order).mapInArrow(run, DIRECTORY)


def _directory(rows):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in DIRECTORY.split(", ")])


def block_lines(files: Files, file: str, offset: int, length: int) -> list[tuple[str, list]]:
    text = files.read(file, offset, length).decode()
    return [(k, json.loads(v)) for k, v in (line.rsplit("\t", 1) for line in text.split("\n")[:-1])]


def lookup(directory: list, url: str, files: Files | None = None) -> list[dict]:
    """All captures of a URL. ``directory``: its rows in order of first_key."""
    files, key = files or Files(), re.sub(r"[\t\n\r]", " ", url_key(url))
    first = [r[0] for r in directory]
    found = []
    for row in directory[max(0, bisect.bisect_left(first, key) - 1) : bisect.bisect_right(first, key)]:
        lines = block_lines(files, *row[2:5])
        keys = [k for k, _ in lines]
        found += [v for _, v in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
    return [parse_record(files.read(f, a, n)) for _, f, a, n in found]


#: Keys that one task of a batched lookup searches; more that fall into one index file are dealt over several.
KEYS = 20_000


def _may_hold(first: list[str], key: str) -> range:
    """Places in sorted first keys of what may hold a key."""
    return range(max(0, bisect.bisect_left(first, key) - 1), bisect.bisect_right(first, key))


def lookup_urls(urls: DataFrame, directory: DataFrame, most: int = KEYS) -> DataFrame:
    """Every capture of each distinct URL of ``urls`` (column url): url and the columns of PAGES; a URL without captures gives no row.

    Each key is sent to the index files whose range may hold it, found by halving in the files' first keys, one for each
    partition of the index, which is all that the driver gets. There it meets the file's directory, is found by halving in that and then in its
    blocks, each read once by a task, and the captures' byte ranges are read in order of place. Keys that meet in one file are dealt by
    hash over as many tasks as their number asks for, each with a copy of that file's directory; a key that fills many files goes to all of them.
    """
    spark = directory.sparkSession
    ship(spark)
    tops = directory.groupBy("file").agg(F.min("first_key").alias("k"), F.min(F.struct("first_key", F.coalesce("first_id", F.lit(-(1 << 63))))).alias("o")).orderBy("o").collect()  # a row per partition
    first, names = [t["k"] for t in tops], [t["file"] for t in tops]

    def send(batches):
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                key = re.sub(r"[\t\n\r]", " ", url_key(url))
                rows += [(url, key, names[i]) for i in _may_hold(first, key)]
            yield pa.record_batch([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], names=["url", "key", "file"])

    scratch = Scratch(spark, "lookup")
    asked = scratch.save(urls.select("url").distinct().mapInArrow(send, "url string, key string, file string"), "asked")
    shares = asked.groupBy("file").agg(F.ceil(F.count("*") / most).alias("_n"))  # a row per partition of the index
    asked = asked.join(F.broadcast(shares), "file").withColumn("part", F.pmod(F.xxhash64("key"), F.col("_n"))).select("url", "key", "file", "part")
    held = directory.join(F.broadcast(shares), "file").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

    def search(wanted, blocks):
        files = Files()
        rows, own = [], sorted(zip(*(blocks.column(c).to_pylist() for c in ("first_key", "offset", "length", "file")), strict=True))
        starts = [b[0] for b in own]
        at, lines, keys = -1, [], []
        for key, url in sorted(zip(wanted.column("key").to_pylist(), wanted.column("url").to_pylist(), strict=True), key=lambda x: (x[0], x[1] or "")):
            for i in _may_hold(starts, key):
                if i != at:
                    at, lines = i, block_lines(files, own[i][3], *own[i][1:3])
                    keys = [k for k, _ in lines]
                rows += [(url, *v[1:]) for _, v in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["url", "file", "offset", "length"])

    found = asked.groupBy("file", "part").cogroup(held.groupBy("file", "part")).applyInArrow(search, "url string, file string, offset long, length long")

    def read(batches):
        files = Files()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        fields = [c.split()[0] for c in PAGES.split(", ")]
        for batch in batches:
            got = [(url, parse_record(files.read(*place))) for url, *place in zip(*(batch.column(c).to_pylist() for c in ("url", "file", "offset", "length")), strict=True)]
            rows = [(url, *(g[c] for c in fields)) for url, g in got]
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["url", *fields])

    found = scratch.save(found, "found").repartitionByRange(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return found.mapInArrow(read, "url string, " + PAGES)


def read_archives(directory: DataFrame) -> DataFrame:
    """Every page, through the directory, the index blocks and the archives' byte ranges."""

    def run(batches):
        files = Files()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [c.split()[0] for c in PAGES.split(", ")]
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                got = [parse_record(files.read(*v[1:])) for _, v in block_lines(files, file, offset, length)]
                yield pa.record_batch([pa.array([g[c] for g in got], k) for c, k in zip(names, kinds, strict=True)], names=names)

    spread = directory.select("file", "offset", "length").repartition(partitions(directory.sparkSession), "file", "offset")
    return spread.mapInArrow(run, PAGES)


def archive(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and their index to the shared folder; returns the saved directory."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    captures = scratch.save(write_archives(pages, scratch.path + "/archives"), "captures")
    return scratch.save(write_index(captures, scratch.path + "/index", partitions(spark)), "directory")
