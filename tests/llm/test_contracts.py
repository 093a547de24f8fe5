"""The registered queries that SQL cannot express, on whole small tables, against direct computation."""

import base64
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import pytest

from varlens.llm.queries import queries

DATA = os.environ.get("VARLENS_TEST_DATA", "/root/testdata/sf0.001")
LABELLED = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def encoded(texts):
    from varlens.llm.tokens import Encoder, default_path

    t = Encoder(default_path()).tokenizer
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no test tables")
def test_quality_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    got = queries()["op1_quality"](spark, LABELLED).collect()
    assert len(got) == spark.read.parquet(f"{LABELLED}/documents.parquet").count()
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) and g["predicted"] == (g["score"] >= 0.3) for g in got)
    held = [(g["score"], labels[g["doc_id"]]) for g in got if g["held_out"] and labels.get(g["doc_id"]) is not None]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    right = sum((s >= 0.3) == (q == 1) for s, q in held) / len(held)
    assert len(held) > 40 and area > 0.95 and right > 0.9


def test_media_payloads(spark, documents):
    got = queries()["op4_ogg_media"](spark, DATA).collect()
    assert {g["doc_id"] for g in got} == set(documents)
    seen = {}
    for g in got:
        raw = (documents[g["doc_id"]] or "").encode()
        whole = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert g["n_bytes"] == len(raw) and g["payload_bytes"] == len(whole)
        assert g["payload_sha256"] == hashlib.sha256(whole).hexdigest() and g["tail_crc32"] == zlib.crc32(whole[-16:])
        assert g["media_bytes"] > len(whole) and len(g["media_sha256"]) == 64
        assert seen.setdefault(raw, (g["media_sha256"], g["feature"])) == (g["media_sha256"], g["feature"])


def test_packed_pieces(spark, documents):
    ids = {i: [*x, 1] for i, x in encoded(documents).items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for g in queries()["op5_packing"](spark, DATA).collect():
        assert g["doc_tokens"] == len(ids[g["doc_id"]]) and g["ids_crc32"] == crc(ids[g["doc_id"]][g["start"] : g["start"] + g["length"]])
        pieces[g["doc_id"]].append((g["start"], g["length"]))
        sequences[g["sequence_id"]].append((g["offset"], g["length"]))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():  # each id lies in exactly one piece
        at = 0
        for start, length in sorted(p):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    stored = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        stored += at if at & (at - 1) == 0 else 2048
    assert sum(map(len, ids.values())) > 0.97 * stored


def test_token_files(spark, documents):
    ids, at = {i: [*x, 0] for i, x in encoded(documents).items()}, 0
    got = sorted(queries()["op6_token_files"](spark, DATA).collect(), key=lambda g: g["doc_id"])
    assert [g["doc_id"] for g in got] == sorted(ids)
    for g in got:
        x = ids[g["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(x), crc(x))
        at += len(x)


@pytest.mark.skipif(not os.path.isdir(LABELLED), reason="no test tables")
def test_token_files_of_bounded_size(spark):
    """Files end early; documents, their places and their ids stay the same."""
    from varlens.llm.token_store import store_tokens

    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    rows = lambda d: sorted(tuple(r) for r in d.drop("file").collect())
    small = store_tokens(docs, row=64, shards=2, most=1000).cache()
    assert small.select("file").distinct().count() > 2
    assert rows(small) == rows(store_tokens(docs, row=64, shards=2))


def test_archive_records(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    last = {}
    for i, p in sorted(pages.items()):
        last[p] = i
    got = queries()["op7_warc"](spark, DATA).collect()
    assert {g["page_id"] for g in got} == set(pages) and len(got) == len(pages)
    for g in got:
        p = pages[g["page_id"]]
        assert g["payload_bytes"] == len(p) and g["payload_digest"] == base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = last[p] == g["page_id"]
        assert (g["record_type"], g["refers_to"]) == (("response", None) if first else ("revisit", last[p]))


def test_base_scores(spark, documents):
    words = {i: (t or "").encode().lower().split() for i, t in documents.items()}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    got = queries()["op8_lm_scores"](spark, DATA).collect()
    assert {g["doc_id"] for g in got} == set(words)
    for g in got:
        w = [*words[g["doc_id"]], None]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (g["doc_id"] not in train, len(w), sum(c[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and g["score"] < 0
