"""The thirteen training-data queries, as (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from varlens.llm.common import table


def op1_quality(spark, sf_dir):
    from varlens.llm.quality import fold, score_texts, train

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_texts(docs, train(docs, labels, fold("doc_id", 5) != 0))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_near_duplicates(spark, sf_dir):
    from varlens.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_search(spark, sf_dir):
    from varlens.llm.search import search

    docs = table(spark, sf_dir, "documents")
    asked = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, asked, k=10).withColumn("score", F.round("score", 6))


def op4_ogg_media(spark, sf_dir):
    from varlens.llm.media_ogg import decode_media, encode_media

    return decode_media(encode_media(table(spark, sf_dir, "documents")))


def op5_packing(spark, sf_dir):
    from varlens.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    from varlens.llm.token_store import store_tokens

    return store_tokens(table(spark, sf_dir, "documents")).drop("file")


def op7_warc(spark, sf_dir):
    from varlens.llm.warc import archive, read_archives

    return read_archives(archive(table(spark, sf_dir, "pages")))


def op8_lm_scores(spark, sf_dir):
    from varlens.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark, sf_dir):
    from varlens.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op10_line_dedup(spark, sf_dir):
    from varlens.llm.line_dedup import line_dedup

    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op11_whitening(spark, sf_dir):
    from varlens.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    from varlens.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


def op13_language_id(spark, sf_dir):
    from varlens.llm.lang_id import identify, references
    from varlens.llm.quality import fold

    docs = table(spark, sf_dir, "documents")
    out = identify(docs, references(docs, fold("doc_id", 4) != 2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def queries():
    return {
        f.__name__: f
        for f in (op1_quality, op2_near_duplicates, op3_search, op4_ogg_media, op5_packing, op6_token_files, op7_warc, op8_lm_scores, op9_source_mixing, op10_line_dedup, op11_whitening, op12_source_divergence, op13_language_id)
    }


def oracle_sql():
    return {"op2_near_duplicates": OP2, "op3_search": OP3, "op9_source_mixing": OP9, "op10_line_dedup": OP10, "op12_source_divergence": OP12}


#: A schedule with exactly one slot per block takes the first floor(target) words of each source's repeated stream; the
#: slots are the golden-ratio lattice, and a document's first one takes the block in which its first word lies.
OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CAST(k % 3 + 1 AS BIGINT) AS wt, ss * 3 AS cap FROM s),
f AS (SELECT *, row_number() OVER o AS i, sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / wt, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(wt) OVER (ORDER BY cap / wt, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr
      FROM w WINDOW o AS (ORDER BY cap / wt, k)),
g AS (SELECT *, min(CASE WHEN CAST(wt * rest AS DOUBLE) / wr <= cap THEN i END) OVER () AS i0 FROM f),
t AS (SELECT g.*, CASE WHEN g.i < g.i0 THEN CAST(g.cap AS DOUBLE) ELSE CAST(g.wt * h.rest AS DOUBLE) / CAST(h.wr AS DOUBLE) END AS target FROM g JOIN g h ON h.i = h.i0),
p AS (SELECT d.doc_id, d.size, t.k, t.ss, t.target, sum(d.size) OVER (PARTITION BY t.k ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS st
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
need AS (SELECT k, CAST(ceil(floor(target) / 1024) AS BIGINT) AS nb FROM t WHERE target >= 1),
n AS (SELECT CAST(coalesce(sum(nb), 0) AS BIGINT) AS n FROM need),
gc AS (SELECT d, z, CAST(round(n * (sqrt(5) - 1) / 2) AS BIGINT) + z * d AS c, n FROM n, (SELECT unnest(range(0, 1000)) AS d), (VALUES (1), (-1)) v(z)),
gs AS (SELECT coalesce((SELECT c FROM gc WHERE n > 2 AND c > 0 AND c < n AND gcd(c, n) = 1 ORDER BY d, z DESC LIMIT 1), 1) AS g),
sl AS (SELECT slot, slot * g % n AS pt FROM (SELECT unnest(range(0, n)) AS slot, n FROM n), gs),
cu AS (SELECT k, sum(nb) OVER (ORDER BY k) - nb AS lo, sum(nb) OVER (ORDER BY k) AS hi FROM need),
sb AS (SELECT k, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS b FROM sl JOIN cu ON pt >= lo AND pt < hi),
r AS (SELECT doc_id, size, k, ss, st, target,
       CAST(greatest(0, least(st + size, floor(target)) - st) + greatest(0, least(st + ss + size, floor(target)) - st - ss)
            + greatest(0, least(st + 2 * ss + size, floor(target)) - st - 2 * ss) AS BIGINT) AS taken
FROM p)
SELECT doc_id, size, ss AS source_size, target, taken, CAST(CASE WHEN taken > 0 THEN slot END AS BIGINT) AS first_slot
FROM r LEFT JOIN sb ON sb.k = r.k AND sb.b = r.st // 1024
"""

OP10 = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
h AS (SELECT doc_id, pos, {'a': ls[pos + 1], 'b': ls[pos + 2], 'c': ls[pos + 3]} AS k FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM h),
c AS (SELECT DISTINCT doc_id, pos + j AS line FROM r, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1),
e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM l),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE c.line IS NULL) AS t, count(c.line) AS gone, count(*) AS n
      FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.line = e.i GROUP BY e.doc_id)
SELECT l.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text
FROM l LEFT JOIN k USING (doc_id)
"""

#: All pairs with a common shingle; the smallest doc_id spreads along links until nothing changes.
OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id WHERE r.c < b.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

#: BM25 of every query against every document.
OP3 = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS t FROM documents),
f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
l AS (SELECT d.doc_id, coalesce(sum(f.tf), 0) AS dl FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id),
s AS (SELECT count(*) AS n, avg(dl) AS m FROM l),
i AS (SELECT t, ln(1 + ((SELECT n FROM s) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f GROUP BY t),
r AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * i.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.dl / (SELECT m FROM s)))) AS sc
      FROM f q JOIN i ON i.t = q.t JOIN f d ON d.t = q.t JOIN l ON l.doc_id = d.doc_id WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
k AS (SELECT query_id, doc_id, sc, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, doc_id) AS rank FROM r)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(sc, 6) AS score FROM k WHERE rank <= 10
"""

#: Every group against every kept term of its language, then every two sources of a language.
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(g.n + 5 * v.v AS HUGEINT) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (k.n + 5)) // CAST(v.n + 5 * v.v AS HUGEINT) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(0 AS HUGEINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL SELECT a.lang, a.source, 'pair', b.source, abs(a.p - b.p) FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(sum(value) AS BIGINT) AS value FROM s GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
