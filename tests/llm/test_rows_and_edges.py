"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import random
import zlib

import pytest
from pyspark.sql import functions as F


def test_mixing(odd, empty):
    from varlens.llm.mixing import mix, mixed_documents

    got = mix(odd, block=16)[0].collect()
    assert len(got) == odd.count()
    by = {}
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"]
        by.setdefault((g["source_size"], g["target"]), []).append(g["taken"])
    for (_, target), taken in by.items():
        assert sum(taken) == int(target)
    assert abs(sum(t for _, t in by) - sum(g["size"] for g in got)) < 1e-6
    assert mix(empty)[0].count() == 0
    assert mixed_documents(odd).columns == odd.columns
    assert mixed_documents(empty).count() == 0


def test_schedule_is_low_discrepancy(odd):
    from varlens.llm.mixing import mix

    _, schedule = mix(odd, block=64)
    slots = [r["_mx_s"] for r in schedule.select("slot", "_mx_s").distinct().orderBy("slot").collect()]
    n = len(slots)
    for s in set(slots):
        share = slots.count(s) / n
        run = 0
        for k, x in enumerate(slots, 1):
            run += x == s
            assert abs(run - share * k) < 6


def test_line_dedup_against_brute_force(odd, empty):
    from varlens.llm.line_dedup import line_dedup

    got = {(r["doc_id"], r["text"] if r["doc_id"] is None else 0): r for r in line_dedup(odd).collect()}
    seen = set()
    for d in sorted({(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None and r["text"] is not None}):
        lines = d[1].split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        r = got[d[0], 0]
        assert r["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone)
        assert (r["n_lines"], r["n_removed"]) == (len(lines), len(gone))
    assert got[6, 0]["n_removed"] == 4 and got[0, 0]["text"] is None
    assert line_dedup(empty).count() == 0
    assert line_dedup(odd).count() == odd.count()


def shingles(text, k):
    w = [bytes(x) for x in (text or "").encode().lower().split()]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_duplicates_against_brute_force(spark, odd, empty):
    from varlens.llm.neardup import near_duplicates, one_of_each

    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(60)]
    rows = [(r_["doc_id"], r_["text"]) for r_ in odd.collect() if r_["doc_id"] is not None]
    rows = list(dict.fromkeys(rows))
    for i in range(40):  # a chain of ever more changed copies
        if i % 3 == 0:
            base[r.randint(0, 59)] = f"n{i}"
        rows.append((1000 + i, " ".join(base)))
    got = {g["doc_id"]: g for g in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and low[a] > low[b]:
                    low[a], changed = low[b], True
    for i in sets:
        assert got[i]["n_shingles"] == len(sets[i])
        assert got[i]["component_id"] == low[i], i
        assert got[i]["kept"] == (low[i] == i)
    assert near_duplicates(odd).count() == odd.count()
    assert near_duplicates(empty).count() == 0
    assert one_of_each(odd).columns == odd.columns


def test_near_copies_of_one_text_stay_linear(spark):
    """A bucket whose members are linked only through one another, and members that are not linked at all."""
    from varlens.llm.neardup import near_duplicates

    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 5])):
            t[r.randint(0, 99)] = f"z{i}-{r.randint(0, 9)}"
        rows.append((i, " ".join(t)))
    got = {g["doc_id"]: g["component_id"] for g in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == low


def test_packing(odd, empty):
    from varlens.llm.packing import pack
    from varlens.llm.tokens import Encoder, default_path

    got = pack(odd, capacity=256).collect()
    e = Encoder(default_path()).tokenizer
    want = sorted((len(e.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    docs, seqs = {}, {}
    for p in got:
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], p["length"]))
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in got) == sum(want)
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 256
    one = next(r for r in odd.collect() if r["doc_id"] == 7)
    ids = [*e.encode(one["text"], add_special_tokens=False).ids, 1]
    for p in got:
        if p["doc_id"] == 7:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert sorted(seqs) == list(range(len(seqs)))
    assert sum(want) / (256 * len(seqs)) > 0.97
    assert pack(empty).count() == 0


def test_token_store(odd, empty):
    from varlens.llm.token_store import ShardReader, store_tokens
    from varlens.llm.tokens import Encoder, default_path

    got = store_tokens(odd, row=64, shards=3).collect()
    e = Encoder(default_path()).tokenizer
    rows = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    at = 0
    got.sort(key=lambda r: r["start"])
    assert [g["doc_id"] for g in got] == [r["doc_id"] for r in rows]
    for g, r in zip(got, rows, strict=True):
        if r["doc_id"] is not None:
            ids = [*e.encode(r["text"] or "", add_special_tokens=False).ids, 0]
            assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += g["n_tokens"]
    reader = ShardReader(got[0]["file"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata
    assert store_tokens(empty).count() == 0


def test_ogg(odd, empty):
    from varlens.llm import media_ogg as m

    got = m.decode_media(m.encode_media(odd)).collect()
    assert len(got) == odd.count()
    for g in got:
        assert g["error"] is None and g["payload_bytes"] % 192 == 0 and g["payload_bytes"] >= max(192, g["n_bytes"])
    assert m.decode_media(m.encode_media(empty)).count() == 0
    text = bytes(range(256)) * 700
    data = m.encode(text)
    payload, n, times = m.decode(data)
    assert payload[:n] == text and n == len(text) and set(payload[n:]) <= {32}
    streams = m.demultiplex(data)
    assert len(streams) == 2 and any(f & 1 for f, *_ in m.pages_of(data))
    for s in streams.values():
        ends, t = [], 0
        for p in s["packets"][1:]:
            t += len(p)
            ends.append(t / m.RATE)
        assert s["times"] == pytest.approx(ends)
    assert times
    for at in (0, 5, 40, 300, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            m.decode(bytes(bad))
    assert m.page_checksum(b"") == 0 and m.page_checksum(b"123456789") == slow_crc(b"123456789")


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc


def test_warc(spark):
    from varlens.llm import warc as w
    from varlens.session import Scratch

    rows = [(i, f"http://h{i % 7}.example.com:80/p/{i % 40}?q={i}#x", f"<p>{i % 60}</p>") for i in range(2000)]
    rows += [(3000, None, None), (3001, "https://A.B/\tc\n", ""), (3002, "x", "é" * 50), (None, "http://none/", "<p>1</p>"), rows[5]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("top", F.lit("t"))
    directory = w.archive(pages, Scratch(spark, "warc-test"))
    got = w.read_archives(directory).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    html = {i: h or "" for i, _, h in rows}
    for g in got:
        h = html[g["page_id"]]
        assert g["payload_bytes"] == len(h.encode()) and g["payload_digest"] == w.payload_digest(h.encode())
        assert (g["record_type"], g["refers_to"]) == (("response", None) if top[h] == g["page_id"] else ("revisit", top[h]))
    rows_d = sorted((tuple(r) for r in directory.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    found = w.lookup(rows_d, "HTTP://H3.example.com/p/3?q=3")
    assert [f["page_id"] for f in found] == [3]
    assert w.lookup(rows_d, "http://nowhere/") == []
    assert w.url_key("https://user@WWW.Example.org:8080/a?b#c") == "org,example,www:8080)/a?b"
    assert w.read_archives(w.archive(pages.limit(0))).count() == 0


def test_search_against_brute_force(spark, odd, empty):
    import math
    from collections import Counter

    from varlens.llm.search import search

    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None and (r["text"] is None or len(r["text"]) < 10_000)]
    r = random.Random(1)
    vocab = [f"t{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows += [(100 + i, " ".join(r.choices(vocab, weights, k=r.randint(1, 80)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = {}
    for g in search(docs, asked, k=7).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["doc_id"], g["score"]))
    tf = [(i, Counter((t or "").encode().lower().split())) for i, t in rows]
    n = len(tf)
    mean = sum(sum(c.values()) for _, c in tf) / n
    df = Counter(w for _, c in tf for w in c)
    for q, qc in tf:
        if q % 20:
            continue
        score = []
        for d, c in tf:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(qc[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + norm) for w in qc if w in c)
            if s > 0:
                score.append((-round(s, 9), d))
        want = sorted(score)[:7]
        assert [d for _, d, _ in sorted(got.get(q, []))] == [d for _, d in want]
        for (_, _, s), (w, _) in zip(sorted(got.get(q, [])), want, strict=True):
            assert s == pytest.approx(-w)
    assert search(empty, empty.select(F.col("doc_id").alias("query_id"), "text")).count() == 0
    assert search(odd, odd.filter("doc_id = 7").select(F.col("doc_id").alias("query_id"), "text"), k=3).count() == 3


def test_quality(spark, odd, empty):
    from varlens.llm.quality import accepted, fold, score_texts, train

    r = random.Random(2)
    good = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(40)) for _ in range(300)]
    bad = [" ".join(w + "***" for w in g.split()) for g in good[:120]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(0, 420, 2)] + [(0, None), (None, 1), (2, 1)], "doc_id long, quality int")
    t = train(docs, labels, fold("doc_id", 5) != 0)
    got = score_texts(docs, t).collect()
    right = sum(g["predicted"] == int(g["doc_id"] < 300) for g in got)
    assert right / len(got) > 0.97 and all(0 <= g["score"] <= 1 for g in got)
    assert score_texts(odd, t).count() == odd.count()
    assert accepted(odd, t).columns == odd.columns
    assert score_texts(empty, t).count() == 0
    none = train(empty, labels.limit(0), F.lit(True))
    assert {g["score"] for g in score_texts(odd, none).collect()} == {0.5}


def test_risk_is_non_negative_learning():
    import numpy as np

    from varlens.llm.quality import fit, margin

    rng = np.random.default_rng(0)
    p = rng.normal(1.5, 1, (400, 4))
    u = np.concatenate([rng.normal(1.5, 1, (600, 4)), rng.normal(-1.5, 1, (600, 4))])
    model = fit(np.concatenate([p, u]), np.arange(400), np.arange(400, 1600), 0.5)
    right = np.concatenate([margin(model, u[:600]) > 0, margin(model, u[600:]) < 0])
    assert right.mean() > 0.97


def test_one_of_each_keeps_one_row_of_repeated_rows_and_null_ids(spark):
    from varlens.llm.neardup import one_of_each

    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = b.replace("b59", "b60")
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (None, near), (2, c), (None, c), (3, ""), (3, ""), (None, None), (None, "")]
    got = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [g["doc_id"] for g in got].count(1) == 1
    assert [(g["doc_id"], g["text"]) for g in got if g["text"] == c] == [(2, c)]
    assert len([g for g in got if g["text"] in (b, near)]) == 1
    assert len(got) == 6 and len([g for g in got if g["doc_id"] is None and not g["text"]]) == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda: "\n".join(" ".join(r.choices(vocab, k=9)) + "." for _ in range(5))
    rows = [(i, text(), "en", f"s{i % 4}", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0", 1) for i in range(20)]
    rows += [(300 + i, " ".join(w + "!!!" for w in text().upper().split()), "en", "s1", 1) for i in range(40)]
    rows += [(400, None, None, None, None), (401, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 140, 2), *range(300, 340, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        ids = {d["doc_id"] for d in docs.collect()}
        if name == "quality":
            assert len([i for i in ids if i is not None and i < 300]) >= 138 and not [i for i in ids if 300 <= (i or 0) < 340]
        if name == "near_dedup":
            assert not [d for d in docs.collect() if 200 <= (d["doc_id"] or 0) < 220 and d["text"]]
            assert len([i for i in ids if i is not None and i < 120]) >= 118
    out = cp.run(spark, str(tmp_path)).collect()
    assert {o["doc_id"] for o in out} <= {i for i, *_ in rows} and len(out) >= 100


def test_families_without_links_compare_each_pair_once(spark, monkeypatch):
    """Texts that share three quarters of their shingles fill buckets with outliers: chunks meet once, and links among them are found."""
    from varlens.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 32)
    r = random.Random(4)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(240):
        t = list(base)
        for j in range(5):
            t[20 * j + r.randint(2, 15)] = f"z{i}-{j}"
        rows.append((i, " ".join(t)))
    for i in range(240, 300):  # near copies of some of them
        t = rows[r.randint(0, 239)][1].split()
        t[119] = f"e{i}"
        rows.append((i, " ".join(t)))
    got = {g["doc_id"]: g["component_id"] for g in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(3):
        for a in sets:
            for b in range(a):
                if low[a] != low[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert got == low and len(set(low.values())) > 200


def test_rows_that_share_an_id_are_one_document(spark):
    from varlens.llm.neardup import near_duplicates, one_of_each

    t = ["one two three four five six", "red green blue white black grey", "alpha beta gamma delta epsilon zeta", "tin iron zinc lead gold silver"]
    rows = [(5, t[0]), (5, t[1]), (3, t[1]), (7, ""), (7, t[0]), (8, None), (None, t[2]), (9, t[2]), (None, t[3]), (None, t[3]), (-4, t[2] + " eta"), (-4, ""), (11, " "), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for g in near_duplicates(df, width=4).collect():
        got.setdefault(g["doc_id"], set()).add((g["component_id"], g["kept"]))
    assert got == {5: {(3, False)}, 3: {(3, True)}, 7: {(3, False)}, 8: {(8, True)}, 9: {(9, True)}, -4: {(-4, True)}, 11: {(11, True)}, None: {(9, False), (None, True)}}
    kept = sorted(((r["doc_id"], r["text"]) for r in one_of_each(df, width=4).collect()), key=repr)
    assert kept == sorted([(3, t[1]), (8, None), (9, t[2]), (None, t[3]), (-4, t[2] + " eta"), (11, kept[[k[0] for k in kept].index(11)][1])], key=repr)
