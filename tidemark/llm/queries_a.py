"""Registered queries of the operators on urls, documents' statistics, chats, quality and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import chat_format, cnn_quality, near_dedup, quality_rules, url_filters
from tidemark.llm.tables import query, table

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filters.RULES)


@query("op1_url_filters", rf"""WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}),
  cut AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN ''
    ELSE regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') END AS rest FROM pages),
  parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
  hosts AS (SELECT DISTINCT host, path FROM parts),
  best AS (SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM hosts
    JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path""")
def op1_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, url_filters.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    trees = quality_rules.fit_rules(documents, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(documents, trees)


def _escaped(x: str) -> str:
    out = f"replace(coalesce({x}, ''), '\\', '\\\\')"
    for control in chat_format.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


_PROBE = "'</s>[INST] ok [/INST]'"


@query("op3_chat_format", f"""WITH turns AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_PROBE}), (-1, 1, 'assistant', {_PROBE})),
  told AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|start|>' || {_escaped('role')} || '<|message|>' || {_escaped('text')} || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM told GROUP BY conv_id""")
def op3_chat_format(spark, sf_dir):
    return chat_format.digests(chat_format.format_chats(chat_format.with_probe(table(spark, sf_dir, "conversations"))))


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    net = cnn_quality.train(documents, table(spark, sf_dir, "labels"))
    return cnn_quality.classify(documents, net).select(
        "doc_id", cnn_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op9_near_dedup", rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    '{url_filters.UPPER}', '{url_filters.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  sets AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
  one AS (SELECT doc_id, unnest(s) AS x FROM sets),
  pairs AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT i, j FROM pairs JOIN sets a ON a.doc_id = i JOIN sets b ON b.doc_id = j WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
  near AS (SELECT i, j FROM links UNION ALL SELECT j, i FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, n.j FROM reach r JOIN near n ON r.b = n.i)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.m AS component_id, s.doc_id = c.m AS kept
FROM sets s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.doc_id""")
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
