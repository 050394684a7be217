"""Registered queries of the operators on spellings and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import cover_tree, spelling, vectors, voronoi_topk
from tidemark.llm.tables import query, table
from tidemark.llm.url_filters import LOWER, UPPER

#: crc32 (reflected polynomial 0xEDB88320), byte by byte over a table that a recursion builds.
_CRC = r"""steps AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8)"""


@query("op11_spelling_variants", rf"""WITH RECURSIVE {_CRC},
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
  counted AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
  named AS (SELECT *, encode(doc_id || ':' || run) AS bytes FROM counted),
  hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(bytes)), lambda i:
    ('0x' || substr(hex(bytes), 2 * i + 1, 2))::UBIGINT)), lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h FROM named, crc),
  spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed),
  words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
  cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
  pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, max(near_n) AS m FROM pairs GROUP BY word),
  told AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n,
    CASE WHEN b.m >= 10 * w.n THEN (SELECT min(near) FROM pairs p WHERE p.word = w.word AND p.near_n = b.m) END AS form FROM words w LEFT JOIN best b USING (word)),
  walk AS (SELECT word, word AS root FROM told UNION ALL SELECT walk.word, told.form FROM walk JOIN told ON walk.root = told.word WHERE told.form IS NOT NULL)
SELECT t.word, t.n, t.n_near, t.form, t.form_n, walk.root FROM told t JOIN walk ON walk.word = t.word JOIN told e ON e.word = walk.root AND e.form IS NULL""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_exact_topk", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20""")
def op12_exact_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = vectors.whole_numbers(rows, "embedding", 64, ["id"])
    return voronoi_topk.top_k(rows, vectors.divisible("id", 20), 20).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op13_hard_negatives", """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS anchor_id, d.vec_id, q.label = d.label AS same, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
  p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 5""")
def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    rows = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), label.alias("label"), "embedding")
    rows = vectors.whole_numbers(rows, "embedding", 256, ["id", "label"])
    return cover_tree.hard_negatives(rows, vectors.divisible("id", 100))
