"""The queries of this subpackage: opN_<name>(spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import balltree, bitslice, decontaminate, html_text, impacts, langid, lshforest, mixing, paragraphs, pii, projections, quality, secrets
from siltwork.session import read_table

WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.mark(docs, items))


OP2_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM documents),
i AS (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
              lambda a: array_to_string(w[a:a + least(len(w), 10) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n.n, unnest(range(1, len(w) - n.n + 2)) AS a, w FROM d, n WHERE len(w) >= n.n),
hits AS (SELECT dw.r, dw.a, iw.n, iw.item FROM dw JOIN iw ON iw.n = dw.n AND iw.win = array_to_string(dw.w[dw.a:dw.a + dw.n - 1], ' ')),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS p FROM (SELECT DISTINCT r, a, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.join(read_table(spark, sf_dir, "documents")).drop("h")


OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda a: array_to_string(w[a:a + least(len(w), 5) - 1], ' '))) AS g
      FROM d WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
k AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = reach.b GROUP BY a),
e AS (SELECT d.r, least(d.doc_id, coalesce(min(x.doc_id), d.doc_id)) AS copy_id FROM d LEFT JOIN l ON l.a = d.r AND l.same LEFT JOIN d x ON x.r = l.b GROUP BY d.r, d.doc_id)
SELECT d.doc_id, class_id, copy_id, (SELECT count(*) FROM l WHERE l.a = d.r) AS n_links FROM d JOIN k USING (r) JOIN e USING (r)
"""


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup(read_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.digest(langid.identify(docs, langid.train(docs)))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, x AS qx FROM v WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, cast(list_sum(list_transform(range(1, len(x) + 1), lambda k: qx[k] * x[k])) AS BIGINT) AS score
      FROM q JOIN v ON vec_id <> query_id AND len(x) = len(qx)),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("source")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  ('0x' || substr(md5('7:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16))::UBIGINT AS h FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap,
             coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
             sum(weight) OVER (ORDER BY source_size * 3.0::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
             row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, encode(source) NULLS LAST) AS place,
             sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, (SELECT arg_min((total - spent) / left_weight, place) FROM c WHERE (total - spent) / left_weight * weight <= cap) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, cast(floor(target - rounds * source_size) AS BIGINT) AS rest,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING), 0) AS upto,
             sum(size) OVER (PARTITION BY source, h) AS tied FROM r)
SELECT doc_id, size, source_size, target,
       cast(rounds * size + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size
            WHEN upto - tied <= rest THEN size * (rest - cast(upto - tied AS BIGINT)) // greatest(cast(tied AS BIGINT), 1) ELSE 0 END AS BIGINT) AS taken
FROM q
"""


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.train(docs)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.score(docs, quality.train(docs, labels))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return bitslice.mine(moved, moved.filter("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id AS anchor_id, label AS al, x AS ax FROM v WHERE vec_id % 100 = 0),
s AS (SELECT anchor_id, al, ax, vec_id, label = al AS same, cast(list_sum(list_transform(range(1, len(x) + 1), lambda k: ax[k] * x[k])) AS BIGINT) AS score
      FROM a JOIN v ON vec_id <> anchor_id AND len(x) = len(ax)),
p AS (SELECT anchor_id, al, ax, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id, al, ax ORDER BY score DESC, vec_id) AS place
      FROM s WHERE same QUALIFY place <= 5),
r AS (SELECT p.*, vec_id AS negative_id, score AS negative_score,
             cast(row_number() OVER (PARTITION BY p.anchor_id, p.al, p.ax, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.al = p.al AND s.ax = p.ax AND NOT same
      WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return projections.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT row_number() OVER () AS item, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD_RE}') AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT count(*)::HUGEINT AS n_docs, sum(len(w))::HUGEINT AS total FROM d WHERE len(w) > 0),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
t AS (SELECT r, doc_id, n, term, count(*)::HUGEINT AS tf FROM (SELECT r, doc_id, len(w)::HUGEINT AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*)::HUGEINT AS df FROM t GROUP BY term),
w AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS HUGEINT) AS w FROM f, c),
s AS (SELECT item, item_id, r, doc_id, cast(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total)))) AS BIGINT) AS score
      FROM q JOIN t USING (term) JOIN w USING (term), c GROUP BY item, item_id, r, doc_id)
SELECT item_id, cast(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s
WHERE score > 0 QUALIFY rank <= 20
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_decontaminate": op2_decontaminate,
    "op3_ngram_join": op3_ngram_join,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_language": op5_language,
    "op6_top_k": op6_top_k,
    "op7_mix_sources": op7_mix_sources,
    "op8_personal_data": op8_personal_data,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_near_vectors": op12_near_vectors,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op6_top_k": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
