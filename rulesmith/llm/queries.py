"""One query for each operator of this package, over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, licenses, media, mixing, packing, quality, secrets, sharding, token_counts, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _of(op, *tables: str) -> Query:
    return lambda spark, sf_dir: op(*[table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Query] = {
    "op1_packing": _of(packing.op1, "documents"),
    "op2_jaccard_join": _of(jaccard_join.op2, "documents"),
    "op3_media": _of(media.op3, "embeddings"),
    "op4_toxicity": _of(toxicity.op4, "documents", "labels"),
    "op5_sharding": _of(sharding.op5, "documents"),
    "op6_mixing": _of(mixing.op6, "documents"),
    "op7_token_counts": _of(token_counts.op7, "documents"),
    "op8_secrets": _of(secrets.op8, "documents"),
    "op9_quality": _of(quality.op9, "documents"),
    "op10_licenses": _of(licenses.op10, "documents"),
}

#: Line-first cleaning, said with unnested windows and lists; the patterns are the operator's parameters.
QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i) u),
c AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, COUNT(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
f AS (SELECT w.*, coalesce(c.n, 0) AS rep, list_filter(ls, lambda x: NOT (
  (NOT regexp_matches(x, '{quality.PUNCTUATION}') AND len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {quality.BARE_WORDS})
  OR len(regexp_extract_all(x, '{quality.MARK}')) >= {quality.MARKS}
  OR (len(regexp_extract_all(x, '{quality.SHOUT}')) >= {quality.SHOUTS} AND NOT regexp_matches(x, '\p{{Ll}}'))
  OR len(regexp_extract_all(x, '{quality.SEPARATOR}')) >= {quality.SEPARATORS}
  OR regexp_matches(x, '{quality.BOILERPLATE}'))) AS good FROM w LEFT JOIN c USING (r)),
o AS (SELECT *, CASE WHEN word_chars > 0 THEN 1 - length(regexp_replace(array_to_string(good, ' '), '[\x20\x09-\x0D]', '', 'g'))::DOUBLE / word_chars ELSE 0 END AS loss,
  len(ws) < {quality.MIN_WORDS} OR 100 * rep > 50 * len(ws) AS base_failed FROM f)
SELECT doc_id, len(ws) AS n_words, word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  rep AS n_repeat_words, base_failed, NOT base_failed AND loss <= {quality.MAX_LOSS} AS kept, loss FROM o"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs that share a shingle, counted, and the closure of the links.
JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 1, 2))) AS i) u WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.m = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, d.m AS component_id FROM (SELECT doc_id, MIN(m) AS m FROM c GROUP BY doc_id) d LEFT JOIN n USING (doc_id)"""


def _secrets_sql() -> str:
    """Places of the matches from the pieces between them, for each rule over every text."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT r, {k} AS rank, {quote(kind)} AS kind, {least} AS least, regexp_extract_all(t, {quote(pattern)}) AS ms, regexp_extract_all(t, {quote(pattern)}, {group}) AS gs, string_split_regex(t, {quote(pattern)}) AS ps FROM d" for k, (kind, pattern, group, least) in enumerate(secrets.RULES))
    shown = lambda name, where: f"coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank) FILTER (WHERE {where}), '') AS {name}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
f AS ({found}),
m AS (SELECT r, rank, kind, least, length(gs[i]) AS n, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a, length(ms[i]) AS own FROM f, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i) u),
s AS (SELECT r, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + own AS BIGINT) AS z FROM m WHERE n >= least),
j AS (SELECT d.r, any_value(doc_id) AS doc_id, {", ".join(f"COUNT(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE)}, {shown("base", f"rank < {len(secrets.BASE)}")}, {shown("spans", "rank >= 0")} FROM d LEFT JOIN s USING (r) GROUP BY d.r)
SELECT doc_id, {", ".join(f"n_{k}" for k in secrets.BASE)}, sha256(base) AS base_sha256, spans FROM j"""


ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": JACCARD_SQL, "op8_secrets": _secrets_sql(), "op9_quality": QUALITY_SQL}
