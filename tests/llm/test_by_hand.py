"""Mixing, the pipeline, Ogg files and batched look-ups against plain computations of the same."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

DATA = os.environ.get("VARLENS_TEST_DATA", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_by_hand(rows, block=1024, most=3):
    """[(slot, doc_id)] of every copy, for rows (doc_id, text, source) of different ids."""
    sizes = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    own = defaultdict(list)
    for i, _, s in rows:
        own[s].append(i)
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole = {s: sum(sizes[i] for i in own[s]) for s in order}
    target, free, left = {}, set(order), sum(whole.values())
    while True:
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > most * whole[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = Fraction(most * whole[s])
            left -= most * whole[s]
        free -= over
    blocks = {s: -(-math.floor(target[s]) // block) for s in order}
    n = sum(blocks.values())
    g = round(n * (math.sqrt(5) - 1) / 2)
    g = next(c for d in range(n) for c in (g + d, g - d) if 0 < c < n and math.gcd(c, n) == 1)
    edges, upto = [], 0
    for s in order:
        edges.append((upto, upto + blocks[s], s))
        upto += blocks[s]
    slots = defaultdict(list)
    for i in range(n):
        p = i * g % n
        slots[next(s for a, b, s in edges if a <= p < b)].append(i)
    out = []
    for s in order:
        stream = sorted((i for i in own[s]), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        at = 0
        for _ in range(most):
            for i in stream:
                words = min(at + sizes[i], math.floor(target[s])) - at
                if sizes[i] and words > 0 and 2 * words >= sizes[i]:
                    out.append((slots[s][at // block], i))
                at += sizes[i]
    return sorted(out)


def dedup_by_hand(rows):
    """Texts by doc_id without later occurrences of three-line windows."""
    seen, out = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            gone |= {k, k + 1, k + 2} if w in seen else set()
            seen.add(w)
        out[i] = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def one_of_each_by_hand(texts, width=5):
    """The ids that stay: the least one of each component of similar texts."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low, ids = {i: i for i in sets}, sorted(sets)
    root = lambda i: i if low[i] == i else root(low[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i for i in ids if root(i) == i}


def corpus(n=150, seed=9):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(600)]
    line = lambda: " ".join(r.choices(vocab, k=r.randint(4, 12)))
    notice = [line() for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [line() for _ in range(r.randint(3, 14))]
        if i % 7 == 0:
            at = r.randint(0, len(lines))
            lines[at:at] = notice
        rows.append((i, "\n".join(lines), "en", None if i % 11 == 3 else f"s{min(i % 5, 3)}", len("\n".join(lines))))
    for i in range(n, n + 25):  # exact and near copies
        base = rows[r.randrange(n)][1]
        text = base if i % 2 else base.replace(base.split()[-1], "other", 1)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    return [*rows, (n + 25, None, None, "s0", None), (n + 26, "", "en", "s1", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixed_documents_in_schedule_order(spark):
    from varlens.llm.mixing import mixed_documents

    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (16, 1024):
        got = [d["doc_id"] for d in mixed_documents(df, block=block).collect()]
        assert got == [i for _, i in mixed_by_hand([(r[0], r[1], r[3]) for r in rows], block)]


def test_stretches_of_the_mix_hold_the_sources_in_proportion(spark):
    from varlens.llm.mixing import mixed_documents

    rows = [(i, " ".join(["w"] * 10), "en", f"s{i % 3}", 19) for i in range(1200)]
    got = [d["source"] for d in mixed_documents(spark.createDataFrame(rows, SCHEMA), block=20).collect()]
    for a in range(0, 1200, 200):
        part = Counter(got[a : a + 200])
        assert all(abs(part[f"s{k}"] / 200 - (k + 1) / 6) < 0.03 for k in range(3))


def test_pipeline_by_hand(spark, tmp_path):
    """Every stage after the classifier, whose choice is taken as it is."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    from varlens.llm.tokens import default_path

    rows = corpus()
    junk = [(i, "!!! " * (5 + i % 9) + "BUY", "en", "s2", 30) for i in range(300, 330)]
    spark.createDataFrame(rows + junk, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 300), 0) for i in [*range(0, 150, 3), *range(300, 330, 2)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {d["doc_id"]: d for d in cp.quality(spark, docs, str(tmp_path)).collect()}
    assert len([i for i in kept if i < 150]) >= 148 and not [i for i in kept if 300 <= i < 330]
    texts = dedup_by_hand([(i, kept[i]["text"]) for i in sorted(kept)])
    assert any(t != kept[i]["text"] for i, t in texts.items())
    stay = one_of_each_by_hand(texts)
    assert len(stay) < len(texts)
    copies = Counter(i for _, i in mixed_by_hand([(i, texts[i], kept[i]["source"]) for i in sorted(stay)]))
    tokenizer = Tokenizer.from_file(default_path())
    ids = {i: [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 1] for i in copies}
    want = Counter()
    for i, n in copies.items():
        want[i] += n * len(ids[i])
    got, places = Counter(), defaultdict(list)
    for p in cp.run(spark, str(tmp_path)).collect():
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        got[p["doc_id"]] += p["length"]
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def crc_by_bits(data):
    """The Ogg checksum, bit by bit."""
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 1 << 31 else 0)) & 0xFFFFFFFF
    return crc


def ogg_by_hand(text):
    """The media file of a text, built packet by packet."""
    payload = text + b" " * (-len(text) % 192 if text else 192)
    packets = [payload[a : a + 64 * 192] for a in range(0, len(payload), 64 * 192)]
    base = zlib.crc32(payload) & ~1
    streams = []
    for side in (0, 1):
        head = b"\x01PCM8" + bytes([side, 2]) + (8000).to_bytes(4, "little") + len(text).to_bytes(8, "little")
        segments = []  # (bytes, does a packet end with it)
        for p in packets[side::2]:
            cut = [p[a : a + 255] for a in range(0, len(p), 255)]
            if len(cut[-1]) == 255:
                cut.append(b"")
            segments += [(c, k == len(cut) - 1) for k, c in enumerate(cut)]
        groups = [segments[a : a + 255] for a in range(0, len(segments), 255)]
        pages = [(2 | (0 if groups else 4), 0, bytes([len(head)]), head)]
        done = held = 0
        for k, group in enumerate(groups):
            granule = -1
            for c, ends in group:
                held += len(c)
                if ends:
                    done = granule = held
            flags = (1 if k and not groups[k - 1][-1][1] else 0) | (4 if done == sum(len(p) for p in packets[side::2]) and granule >= 0 else 0)
            pages.append((flags, granule, bytes(len(c) for c, _ in group), b"".join(c for c, _ in group)))
        out = []
        for number, (flags, granule, lacing, body) in enumerate(pages):
            front = b"OggS\0" + bytes([flags]) + granule.to_bytes(8, "little", signed=True) + (base + side).to_bytes(4, "little") + number.to_bytes(4, "little")
            back = bytes([len(lacing)]) + lacing + body
            out.append(front + crc_by_bits(front + b"\0\0\0\0" + back).to_bytes(4, "little") + back)
        streams.append(out)
    a, b = streams
    file = a[0] + b[0]
    for k in range(1, max(len(a), len(b))):
        file += (a[k] if k < len(a) else b"") + (b[k] if k < len(b) else b"")
    return payload, file


def feature_by_hand(payload):
    x = [b - 128 for b in payload]
    frames = [sum(v * v for v in x[a : a + 192]) / 192 for a in range(0, len(x), 192)]
    turns = sum((p < 0) != (q < 0) for p, q in zip(x, x[1:], strict=False))
    return f"mean={sum(x) / len(x):.6f};rms={math.sqrt(sum(frames) / len(frames)):.6f};peak={max(map(abs, x))};crossings={turns};loudest={frames.index(max(frames))};frames={len(frames)}"


def test_media_files_by_hand(spark):
    from varlens.llm.media_ogg import decode_media, encode_media

    r = random.Random(2)
    texts = [None, "", "a", "x" * 191, "y" * 192, "z" * 193, "ü" * 5000, "".join(chr(r.randint(32, 0x24F)) for _ in range(40_000)), "q" * 12_288, "q" * 12_289, "w" * 24_576, "v" * 65_025]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    media = encode_media(df)
    files = {m["doc_id"]: bytes(m["media"]) for m in media.collect()}
    for g in decode_media(media).collect():
        payload, file = ogg_by_hand((texts[g["doc_id"]] or "").encode())
        assert files[g["doc_id"]] == file
        assert (g["media_bytes"], g["media_sha256"], g["feature"], g["error"]) == (len(file), hashlib.sha256(file).hexdigest(), feature_by_hand(payload), None)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_media_query_by_hand(spark):
    """Files and features of the table's texts of up to 3,000 bytes, which the bit by bit checksum can take."""
    from varlens.llm.queries import queries

    texts = {d["doc_id"]: (d["text"] or "").encode() for d in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    short = 0
    for g in queries()["op4_ogg_media"](spark, DATA).collect():
        if len(texts[g["doc_id"]]) <= 3000:
            payload, file = ogg_by_hand(texts[g["doc_id"]])
            assert (g["media_bytes"], g["media_sha256"], g["feature"]) == (len(file), hashlib.sha256(file).hexdigest(), feature_by_hand(payload))
            short += 1
    assert short > 100


def test_batched_lookup(spark, monkeypatch):
    """Keys in many files, a key that fills several, equal keys of different URLs, absent and null ones; also with keys dealt over tasks."""
    from varlens.llm import warc

    monkeypatch.setattr(warc, "LINES", 8)
    urls = [f"http://h{i % 9}.example.com/p{i % 37}" for i in range(200)] + ["http://hot.example.org/"] * 150 + ["https://hot.example.org:443/", None, None, "http://a.b/\t1"]
    rows = [(i, u, f"<p>{i % 50}</p>") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    directory = warc.archive(pages)
    everything = {p["page_id"]: p for p in warc.read_archives(directory).collect()}
    ask = [*sorted({u for u in urls if u}), None, "http://absent.example.com/", "aaa", "zzz://zz.zz/z", "http://hot.example.org"]
    want = sorted((str(a), i) for a in ask for i, u in enumerate(urls) if warc.url_key(a) == warc.url_key(u))
    assert any(len([w for w in want if w[0] == a]) > 100 for a in ("http://hot.example.org",))
    for most in (20_000, 3):
        got = warc.lookup_urls(spark.createDataFrame([(a,) for a in ask * 2], "url string"), directory, most).collect()
        assert sorted((str(g["url"]), g["page_id"]) for g in got) == want
        for g in got:
            assert all(g[c] == everything[g["page_id"]][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert warc.lookup_urls(spark.createDataFrame([], "url string"), directory).count() == 0
    empty = warc.archive(pages.limit(0))
    assert warc.lookup_urls(spark.createDataFrame([("aaa",)], "url string"), empty).count() == 0
