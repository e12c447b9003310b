"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embdedup, htmltext, packing, quality, secretscan, sentencepieces, simhash, toxicity, urlgraph
from .common import table


def op1_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.find_secrets(table(spark, sf_dir, "documents"))


def op3_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rabitq": op1_rabitq,
    "op2_secrets": op2_secrets,
    "op3_itq_dedup": op3_itq_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_text": op9_html_text,
    "op10_url_graph": op10_url_graph,
}
# SQL: what takes part, as the operators' docstrings say.
_VECTORS = """usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),"""

_NEAREST = f"""WITH {_VECTORS}
named AS (SELECT * FROM usable WHERE vec_id IS NOT NULL),
v AS (SELECT * FROM named WHERE len(v) = (SELECT len(v) FROM named GROUP BY 1 ORDER BY count(*) DESC, len(v) LIMIT 1)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

_DUPLICATES = f"""WITH RECURSIVE {_VECTORS}
v AS (SELECT * FROM usable WHERE label IS NOT NULL AND len(v) = (SELECT len(v) FROM usable WHERE label IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, len(v) LIMIT 1)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(r.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY 1) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY 1) r ON r.a = e.vec_id"""

# Rules as values, most fitting last; 80 rounds of trust and distrust, beyond which no score moves.
_RULES = ", ".join(f"('{v}', '{h}', '{p}', {len(h + p)})" for v, h, p in urlgraph.RULES)
_LINK = urlgraph.LINK.replace("'", "''")
_JUDGED = f"""WITH RECURSIVE rules(verdict, host, path, n) AS (VALUES {_RULES}),
split AS (SELECT page_id, html, row_number() OVER () AS row, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT row, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urlgraph.UPPER}', '{urlgraph.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT a.row, a.page_id, a.host, a.path, arg_max(r.host || r.path, [lpad(CAST(r.n AS VARCHAR), 4, '0'), r.host || r.path]) AS rule, arg_max(r.verdict, [lpad(CAST(r.n AS VARCHAR), 4, '0'), r.host || r.path]) AS verdict
  FROM parsed a LEFT JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path) GROUP BY ALL),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS link FROM parsed),
edges AS (SELECT src, translate(regexp_extract(substr(link, instr(link, '//') + 2), '^([^/?#]*)', 1), '{urlgraph.UPPER}', '{urlgraph.LOWER}') AS dst, count(*) AS n FROM links GROUP BY 1, 2 HAVING src <> '' AND dst <> '' AND src <> dst),
flow AS (SELECT src AS host, dst AS other, 0 AS kind, n / sum(n) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT dst, src, 1, n / sum(n) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT host, kind, avg(CASE WHEN verdict = what THEN 1.0 ELSE 0.0 END) AS seed FROM ruled CROSS JOIN (VALUES (0, 'allow'), (1, 'block')) AS k(kind, what) WHERE host <> '' GROUP BY 1, 2),
start AS (SELECT host, kind, sum(seed) AS seed FROM (SELECT * FROM seeds UNION ALL SELECT host, kind, 0.0 FROM flow UNION ALL SELECT other, kind, 0.0 FROM flow) GROUP BY 1, 2),
scores(round, host, kind, score) AS (SELECT 0, host, kind, 0.15 * seed FROM start
  UNION ALL SELECT g.round + 1, g.host, g.kind, g.score FROM (
    SELECT s.round, t.host, t.kind, 0.15 * any_value(t.seed) + 0.85 * coalesce(sum(f.share * s.score) FILTER (f.other = t.host), 0) AS score
    FROM scores s JOIN start t ON t.kind = s.kind LEFT JOIN flow f ON f.host = s.host AND f.kind = s.kind AND f.other = t.host WHERE s.round < 80 AND EXISTS (SELECT 1 FROM flow) GROUP BY s.round, t.host, t.kind) g),
bad AS (SELECT host FROM scores WHERE round = (SELECT max(round) FROM scores) GROUP BY 1 HAVING sum(CASE WHEN kind = 1 THEN score ELSE -score END) >= 0.05)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled"""

ORACLE_SQL: dict[str, str] = {"op1_rabitq": _NEAREST, "op3_itq_dedup": _DUPLICATES, "op10_url_graph": _JUDGED}
