"""opN_<name>: each operator with production parameters over its whole table."""

from __future__ import annotations


from pyspark.sql import functions as F

from tabveil.llm import bpe, decontam, jaccard, knn, linededup, merkle, mixing, negatives, packing, pii, quality, substrings, tokencounts
from tabveil.llm.registry import query


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op6_bpe")
def op6(spark, sf_dir):
    return bpe.encode_decode(read(spark, sf_dir, "documents"), digests=True)


@query(
    "op1_voronoi_knn",
    """WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
        CAST(list_sum(list_transform(list_zip(q.vec, d.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op1(spark, sf_dir):
    return knn.top_k(knn.integer_vectors(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


@query("op7_quality")
def op7(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op10_line_dedup",
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, pos, x[pos + 1] AS line, length(x[pos + 1]) AS chars FROM (SELECT doc_id, x, unnest(range(len(x))) AS pos FROM d)),
    c AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
    m AS (SELECT doc_id, line, chars, upto, pos FROM c),
    f AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.chars + 150 GROUP BY 1, 2),
    b AS (SELECT a.doc_id, max(b.pos) AS s, a.pos AS e FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.pos <= a.pos AND b.upto - b.chars <= a.upto - 150 GROUP BY a.doc_id, a.pos),
    w AS (SELECT * FROM f UNION SELECT * FROM b),
    r AS (SELECT w.doc_id, w.s, w.e, string_agg(m.line, chr(10) ORDER BY m.pos) AS run FROM w JOIN m ON w.doc_id = m.doc_id AND m.pos BETWEEN w.s AND w.e GROUP BY 1, 2, 3),
    n AS (SELECT *, row_number() OVER (PARTITION BY run, e - s ORDER BY doc_id, s) AS nth FROM r),
    g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM n WHERE nth > 1),
    k AS (SELECT m.doc_id, string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
      FROM m LEFT JOIN g ON m.doc_id = g.doc_id AND m.pos = g.pos GROUP BY 1)
    SELECT documents.doc_id, CASE WHEN documents.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
    FROM documents LEFT JOIN k USING (doc_id)""",
)
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs, report=True)


@query("op8_pii")
def op8(spark, sf_dir):
    return pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), "key of this registered query")


@query("op9_decontaminate")
def op9(spark, sf_dir):
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    "op3_jaccard",
    r"""WITH RECURSIVE w AS (
      SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS x FROM documents
    ), s AS (
      SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
        ELSE list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))) END AS sh FROM w
    ), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2, 3, 4),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (n + m - c)),
    u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(doc_id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id AND r.root < u.b)
    SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.root) AS component_id FROM s JOIN r USING (doc_id) GROUP BY 1, 2""",
)
def op3(spark, sf_dir):
    return jaccard.similar_documents(read(spark, sf_dir, "documents"))


@query(
    "op2_suffix_dedup",
    """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(greatest(length(x) // 2 - 99, 0))) AS i FROM h)),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
    g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f)),
    r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 100 AS hi FROM g GROUP BY 1, 2),
    p AS (SELECT r.doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r.doc_id ORDER BY lo), 0) AS prev FROM r),
    c AS (SELECT p.doc_id, string_agg(substr(x, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS head, max(hi) AS last, sum(hi - lo) AS gone, count(*) AS n FROM p JOIN h USING (doc_id) GROUP BY 1)
    SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM h LEFT JOIN c USING (doc_id)""",
)
def op2(spark, sf_dir):
    return substrings.remove_repeated(read(spark, sf_dir, "documents"), digests=True)


@query("op4_mixing_score")
def op4(spark, sf_dir):
    return mixing.score_texts(read(spark, sf_dir, "documents"))


@query("op5_token_counts")
def op5(spark, sf_dir):
    return tokencounts.count_tokens(read(spark, sf_dir, "documents"))


@query("op11_packing")
def op11(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents"), digests=True)


@query(
    "op13_merkle",
    """WITH RECURSIVE b AS (
      SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
        list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
          lambda c, d: list_reduce(list_prepend(xor(c, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
      FROM documents
    ), l AS (
      SELECT doc_id, lang, pos, n, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS now FROM b
    ), t(lang, level, pos, h, n) AS (
      SELECT lang, 0, pos, leaf, n FROM l
      UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, level, pos // 8, n
    ), s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, level FROM t WHERE n = 1),
    u(level, pos, h, n) AS (
      SELECT 0, pos, subroot, n FROM s
      UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY level, pos // 8, n
    ), a AS (
      SELECT l.doc_id, l.lang, l.leaf, coalesce(l.now, l.leaf) AS now, s.subroot, (SELECT h FROM u WHERE n = 1) AS root, l.pos AS p0, s.pos AS p1, s.level AS top FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
    ), near AS (
      SELECT a.doc_id, t.level, t.pos, t.h, t.pos = a.p0 // CAST(pow(8, t.level) AS BIGINT) AS own FROM a JOIN t ON a.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.pos // 8 = a.p0 // CAST(pow(8, t.level + 1) AS BIGINT)
      UNION ALL SELECT a.doc_id, a.top + u.level, u.pos, u.h, u.pos = a.p1 // CAST(pow(8, u.level) AS BIGINT) FROM a JOIN u ON u.n > 1 AND u.pos // 8 = a.p1 // CAST(pow(8, u.level + 1) AS BIGINT)
    ), p AS (SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY level, pos) FILTER (WHERE NOT own), '')) AS proof_sha256 FROM near GROUP BY 1),
    f(doc_id, level, h) AS (
      SELECT doc_id, 0, now FROM a
      UNION ALL SELECT f.doc_id, f.level + 1, sha256(string_agg(CASE WHEN near.own THEN f.h ELSE near.h END, '' ORDER BY near.pos)) FROM f JOIN near ON near.doc_id = f.doc_id AND near.level = f.level GROUP BY f.doc_id, f.level
    ), g AS (SELECT doc_id, arg_max(h, level) AS folded_root FROM f GROUP BY 1)
    SELECT a.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM a JOIN g USING (doc_id) LEFT JOIN p USING (doc_id)""",
)
def op13(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return merkle.tamper_report(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


@query(
    "op12_hard_negatives",
    """WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, d.vec_id AS vec_id, a.label = d.label AS same,
        CAST(list_sum(list_transform(list_zip(a.vec, d.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v d ON a.vec_id <> d.vec_id WHERE a.vec_id % 50 = 0
    ), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS INTEGER) AS positive_rank FROM s WHERE same),
    n AS (
      SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
      FROM p JOIN s USING (anchor_id) WHERE positive_rank <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    ) SELECT * FROM n WHERE rank <= 3""",
)
def op12(spark, sf_dir):
    x = read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(negatives.labelled_vectors(x), F.col("vec_id") % 50 == 0)
