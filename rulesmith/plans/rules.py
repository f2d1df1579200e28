"""More queries of the rule engine: comparisons of all kinds, blanks, changes of thresholds, samples, correlations, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulesmith.functions.predicates import parse_rule
from rulesmith.operators import blocking, corr, measure, stats
from rulesmith.plans import lattice, samples, tasks
from rulesmith.plans.catalogue import CONFIDENCE, ORDERS, SUPPORT, VERDICT_SQL, _store, _t, query

RATIOS = "SELECT row_size, xsupp, xysupp, CASE WHEN row_size > 0 THEN xysupp / row_size::DOUBLE ELSE 0 END AS support, CASE WHEN xsupp > 0 THEN xysupp / xsupp::DOUBLE ELSE 0 END AS confidence FROM ({}) q"


def _self_join(table: str, x: str, y: str, size: str = "COUNT(*)") -> str:
    return RATIOS.format(f"SELECT {size} AS row_size, COUNT(*) FILTER (WHERE {x}) AS xsupp, COUNT(*) FILTER (WHERE {x} AND {y}) AS xysupp FROM {table} l, {table} r")


def _rule(name: str, text: str, sql: str, *names: str, **options) -> None:
    @query(name, sql)
    def _(spark, sf):
        return measure.evaluate(parse_rule(text), {t: _t(spark, sf, t) for t in names}, **options)


_rule("neq_rule", "part(t0) ^ part(t1) ^ t0.p_brand=t1.p_brand ^ t0.p_size!=t1.p_size -> t0.p_type=t1.p_type", _self_join("part", "l.p_brand = r.p_brand AND l.p_size <> r.p_size", "l.p_type = r.p_type"), "part")
_rule("neq_rhs_rule", "part(t0) ^ part(t1) ^ t0.p_brand=t1.p_brand -> t0.p_type!=t1.p_type", _self_join("part", "l.p_brand = r.p_brand", "l.p_type <> r.p_type"), "part")
_rule("range_rule", "customer(t0) ^ customer(t1) ^ t0.c_nationkey=t1.c_nationkey ^ t0.c_acctbal<t1.c_acctbal -> t0.c_mktsegment=t1.c_mktsegment", _self_join("customer", "l.c_nationkey = r.c_nationkey AND l.c_acctbal < r.c_acctbal", "l.c_mktsegment = r.c_mktsegment"), "customer")
_rule("range_only_rule", "supplier(t0) ^ supplier(t1) ^ t0.s_acctbal>=t1.s_acctbal -> t0.s_nationkey=t1.s_nationkey", _self_join("supplier", "l.s_acctbal >= r.s_acctbal", "l.s_nationkey = r.s_nationkey"), "supplier")
_rule("two_ranges_rule", "customer(t0) ^ customer(t1) ^ t0.c_nationkey=t1.c_nationkey ^ t0.c_acctbal<=t1.c_acctbal -> t0.c_custkey>t1.c_custkey", _self_join("customer", "l.c_nationkey = r.c_nationkey AND l.c_acctbal <= r.c_acctbal", "l.c_custkey > r.c_custkey"), "customer")
_rule("const_rhs_rule", "part(t0) ^ t0.p_size>=25 ^ t0.p_brand!=Brand#11 -> t0.p_type=PROMO", RATIOS.format("SELECT COUNT(*) FILTER (WHERE p_size >= 25 AND p_brand <> 'Brand#11') AS row_size, COUNT(*) FILTER (WHERE p_size >= 25 AND p_brand <> 'Brand#11') AS xsupp, COUNT(*) FILTER (WHERE p_size >= 25 AND p_brand <> 'Brand#11' AND p_type = 'PROMO') AS xysupp FROM part"), "part")
_rule("const_rhs_pair_rule", "part(t0) ^ part(t1) ^ t0.p_brand=t1.p_brand -> t0.p_size<10", _self_join("part", "l.p_brand = r.p_brand", "l.p_size < 10"), "part")
_FK = (("orders", "o_custkey", "customer", "c_custkey"),)
_rule("fk_only_rule", "orders(t0) ^ customer(t1) ^ t0.o_custkey=t1.c_custkey -> t0.o_totalprice>=t1.c_acctbal", RATIOS.format("SELECT COUNT(*) AS row_size, COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE o_totalprice >= c_acctbal) AS xysupp FROM orders JOIN customer ON o_custkey = c_custkey"), "orders", "customer", foreign=_FK)
_rule("first_row_size", "part(t0) ^ part(t1) ^ t0.p_brand=t1.p_brand ^ t0.p_size=t1.p_size -> t0.p_type=t1.p_type", _self_join("part", "l.p_brand = r.p_brand AND l.p_size = r.p_size", "l.p_type = r.p_type", "COUNT(*) FILTER (WHERE l.p_brand = r.p_brand)"), "part", row_size="first")

GRAMS = "SELECT DISTINCT name, g || CASE WHEN k > 1 THEN '_' || (k - 1) ELSE '' END AS token FROM (SELECT name, g, row_number() OVER (PARTITION BY name, g ORDER BY i) AS k FROM (SELECT name, substring('##' || name || '##', i, 3) AS g, i FROM (SELECT DISTINCT s_name AS name FROM supplier) s, LATERAL (SELECT unnest(range(1, length(name) + 3)) AS i) u))"


@query("similar_rule", f"WITH g AS ({GRAMS}), n AS (SELECT name, COUNT(*) AS n FROM g GROUP BY name), s AS (SELECT a, b FROM (SELECT x.name AS a, y.name AS b, COUNT(*) AS i FROM g x JOIN g y ON x.token = y.token GROUP BY 1, 2) p JOIN n na ON na.name = a JOIN n nb ON nb.name = b WHERE i / (na.n + nb.n - i)::DOUBLE >= 0.8) " + RATIOS.format("SELECT (SELECT COUNT(*) * COUNT(*) FROM supplier) AS row_size, COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE l.s_nationkey = r.s_nationkey) AS xysupp FROM supplier l JOIN s ON l.s_name = a JOIN supplier r ON r.s_name = b"))
def _(spark, sf):
    return measure.evaluate(parse_rule("supplier(t0) ^ supplier(t1) ^ similar('jaccard', t0.s_name, t1.s_name, 0.80) -> t0.s_nationkey=t1.s_nationkey"), {"supplier": _t(spark, sf, "supplier")})


#: customer with blanks: every seventh segment is '' and every seventh null, every fifth nation null.
BLANKS_SQL = "(SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer)"


def _blanks(spark, sf):
    key = F.col("c_custkey")
    segment = F.when(key % 7 == 0, "").when(key % 7 != 1, F.col("c_mktsegment"))
    return _t(spark, sf, "customer").select("c_custkey", segment.alias("segment"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("nation"))


@query("blank_edges", f"WITH c AS {BLANKS_SQL}, w AS (SELECT a.c_custkey AS k, b.nation AS n FROM c a JOIN c b ON a.segment = b.segment AND a.segment <> '' AND a.c_custkey % 10 = 3) " + RATIOS.format("SELECT COUNT(*) AS row_size, COUNT(*) FILTER (WHERE n IS NOT NULL AND k > n) AS xsupp, COUNT(*) FILTER (WHERE n IS NOT NULL AND k > n AND k <> n) AS xysupp FROM w"))
def _(spark, sf):
    c = _blanks(spark, sf)
    rule = parse_rule("some(t0) ^ every(t1) ^ t0.segment=t1.segment ^ t0.c_custkey>t1.nation -> t0.c_custkey!=t1.nation")
    return measure.evaluate(rule, {"some": c.where("c_custkey % 10 = 3"), "every": c}, foreign=(("some", "segment", "every", "segment"),))


@query("blank_violations", f"SELECT l.nation, COUNT(*) AS pairs FROM {BLANKS_SQL} l JOIN {BLANKS_SQL} r ON l.nation = r.nation AND l.segment <> r.segment AND l.segment <> '' AND r.segment <> '' GROUP BY 1")
def _(spark, sf):
    return measure.violations(_blanks(spark, sf), ["nation"], "segment")


@query("rule_rows", "SELECT l.o_orderkey AS t0, r.o_orderkey AS t1 FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey AND l.o_totalprice < r.o_totalprice AND l.o_orderstatus = r.o_orderstatus AND l.o_orderpriority <> r.o_orderpriority")
def _(spark, sf):
    rule = parse_rule("orders(t0) ^ orders(t1) ^ t0.o_custkey=t1.o_custkey ^ t0.o_totalprice<t1.o_totalprice ^ t0.o_orderstatus=t1.o_orderstatus -> t0.o_orderpriority=t1.o_orderpriority")
    return measure.rows_of_rule(rule, {"orders": _t(spark, sf, "orders")}, {"orders": "o_orderkey"})


# --- changes of thresholds, by way of the store ---

#: name, support and confidence before, and after.
CHANGES = (
    ("support_up", 1e-6, 0.25, 2e-4, 0.25), ("support_down", 2e-4, 0.25, 1e-6, 0.25), ("confidence_up", SUPPORT, 0.2, SUPPORT, 0.3), ("confidence_down", SUPPORT, 0.3, SUPPORT, 0.2),
    ("both_up", 1e-6, 0.2, 2e-4, 0.3), ("support_up_confidence_down", 1e-6, 0.3, 2e-4, 0.2), ("support_down_confidence_up", 2e-4, 0.2, 1e-6, 0.3), ("both_down", 2e-4, 0.3, 1e-6, 0.2),
)
MINIMAL_SQL = "WITH v AS ({}), r AS (SELECT * FROM v WHERE has_rule) SELECT lhs, rhs, support, confidence FROM r WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.prune AND o.rhs = r.rhs AND o.lhs <> r.lhs AND len(list_filter(string_split(o.lhs, ','), lambda x: NOT list_contains(string_split(r.lhs, ','), x))) = 0)"


def _change(name: str, before: tuple[float, float], after: tuple[float, float]) -> None:
    sql = VERDICT_SQL.replace(f">= {SUPPORT} ", f">= {after[0]} ").replace(f"< {SUPPORT} ", f"< {after[0]} ").replace(f">= {CONFIDENCE}", f">= {after[1]}")

    @query(f"task_{name}", MINIMAL_SQL.format(sql))
    def _(spark, sf):
        orders, store = _t(spark, sf, "orders"), _store(spark)
        tasks.run_task(orders, store, *before, columns=list(ORDERS), max_level=2)
        _, state = tasks.run_task(orders, store, *after, "latest", max_level=2)
        return lattice.as_frame(spark, state.minimal).select("lhs", "rhs", "support", "confidence")


for _name, *_four in CHANGES:
    _change(_name, tuple(_four[:2]), tuple(_four[2:]))


@query("stored_nodes", f"SELECT CASE WHEN NOT prune THEN 'samples' WHEN has_rule THEN 'minimal' ELSE 'pruned' END AS kind, lhs, rhs, support, confidence FROM ({VERDICT_SQL}) v WHERE NOT contains(lhs, ',')")
def _(spark, sf):
    """What a task of one layer left, read back from the store."""
    store = _store(spark)
    task, _ = tasks.run_task(_t(spark, sf, "orders"), store, SUPPORT, CONFIDENCE, columns=list(ORDERS), max_level=1)
    held = store.state(task)
    rows = [(kind, ",".join(r.lhs), r.rhs, r.support, r.confidence) for kind in ("minimal", "pruned", "samples") for r in getattr(held, kind)]
    return spark.createDataFrame(rows, "kind string, lhs string, rhs string, support double, confidence double")


NODES = ", ".join(f"('{x}', '{y}')" for x in ORDERS for y in ORDERS if x != y)


@query("sample_children", f"WITH s AS (SELECT * FROM (VALUES {NODES}) t(lhs, rhs)), p AS (SELECT {', '.join(f'COUNT(DISTINCT {c}) AS {c}' for c in ORDERS)} FROM orders) SELECT DISTINCT least(lhs, c) || ',' || greatest(lhs, c) AS lhs, rhs FROM s, (VALUES {', '.join(f'({c!r})' for c in ORDERS)}) k(c) WHERE c <> lhs AND c <> rhs")
def _(spark, sf):
    """Children of all open nodes of one premise."""
    state = lattice.mine(_t(spark, sf, "orders"), 0.0, 1.1, list(ORDERS), max_level=1)
    rows = [(list(r.lhs), r.rhs, [c for c in ORDERS if c not in (*r.lhs, r.rhs)], r.confidence) for r in state.samples]
    frame = spark.createDataFrame(rows, "lhs array<string>, rhs string, candidates array<string>, max_conf double")
    return samples.neighbours(frame, 0.0).select(F.array_join("lhs", ",").alias("lhs"), "rhs")


# --- correlation, splits, blocking over two tables ---

NUMBERS = ("p_size", "p_retailprice", "p_partkey")


def _measures_sql(columns, label: str, table: str, key: str) -> str:
    code = f"(SELECT *, dense_rank() OVER (ORDER BY {label}) AS y FROM {table})"
    of = lambda c: f"SELECT '{c}' AS col, (SELECT abs(corr({c}, y)) FROM {code}) AS pearson, (SELECT abs(corr(a, b)) FROM (SELECT rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM {code})) AS spearman, (SELECT abs(SUM(sign(l.{c} - r.{c}) * sign(l.y - r.y)) / sqrt(SUM((l.{c} <> r.{c})::INT)::DOUBLE * SUM((l.y <> r.y)::INT))) FROM {code} l JOIN {code} r ON l.{key} < r.{key}) AS kendall"
    return " UNION ALL ".join(map(of, columns))


@query("column_measures", _measures_sql(NUMBERS, "p_type", "part", "p_partkey"))
def _(spark, sf):
    """Three correlations of each number with the coded type; the sample holds the whole table at small scales."""
    return corr.combined(_t(spark, sf, "part"), list(NUMBERS), "p_type")


@query("chosen_columns", f"WITH m AS ({_measures_sql(NUMBERS, 'p_type', 'part', 'p_partkey')}) SELECT col FROM (SELECT col, row_number() OVER (ORDER BY round(pearson, 9) DESC, col) AS a, row_number() OVER (ORDER BY round(spearman, 9) DESC, col) AS b, row_number() OVER (ORDER BY round(kendall, 9) DESC, col) AS c FROM m) WHERE least(a, b, c) = 1")
def _(spark, sf):
    return corr.chosen_columns(corr.combined(_t(spark, sf, "part"), list(NUMBERS), "p_type"), 1)


@query("sorted_columns", f"SELECT col, CAST(row_number() OVER (ORDER BY round(spearman, 9) DESC, round(pearson, 9) DESC, round(kendall, 9) DESC, col) AS INTEGER) AS place FROM ({_measures_sql(NUMBERS, 'p_type', 'part', 'p_partkey')})")
def _(spark, sf):
    return corr.sorted_columns(corr.combined(_t(spark, sf, "part"), list(NUMBERS), "p_type")).select("col", "place")


@query("kendall_many_values", "SELECT round(s / sqrt((n * (n - 1) / 2.0 - tx) * (n * (n - 1) / 2.0 - ty)), 9) AS tau FROM (SELECT SUM(sign(l.c_acctbal - r.c_acctbal) * sign(l.c_nationkey - r.c_nationkey)) AS s FROM customer l JOIN customer r ON l.c_custkey < r.c_custkey) a, (SELECT COUNT(*) AS n FROM customer) b, (SELECT SUM(c * (c - 1) / 2.0) AS tx FROM (SELECT COUNT(*) AS c FROM customer GROUP BY c_acctbal)) x, (SELECT SUM(c * (c - 1) / 2.0) AS ty FROM (SELECT COUNT(*) AS c FROM customer GROUP BY c_nationkey)) y")
def _(spark, sf):
    return corr.kendall(_t(spark, sf, "customer"), "c_acctbal", "c_nationkey").select(F.round("tau", 9).alias("tau"))


ENTROPY = "(SELECT -SUM(c / n * ln(c / n)) FROM (SELECT c_mktsegment, COUNT(*)::DOUBLE AS c, SUM(COUNT(*)) OVER ()::DOUBLE AS n FROM customer WHERE {} GROUP BY 1))"


@query("value_gains", f"SELECT CAST(v.k AS VARCHAR) AS val, round({ENTROPY.format('TRUE')} - share * {ENTROPY.format('c_nationkey = v.k')} - (1 - share) * {ENTROPY.format('c_nationkey <> v.k')}, 7) AS gain FROM (SELECT c_nationkey AS k, COUNT(*) / SUM(COUNT(*)) OVER ()::DOUBLE AS share FROM customer GROUP BY 1) v")
def _(spark, sf):
    return stats.value_gains(_t(spark, sf, "customer"), "c_nationkey", "c_mktsegment").select("val", F.round("gain", 7).alias("gain"))


@query("cross_blocks", "WITH t AS (SELECT side, key, (i - 1) || ':' || CAST(floor(CAST(v[i] AS DOUBLE) * 10) AS BIGINT) AS token FROM (SELECT vec_id % 2 AS side, vec_id AS key, embedding AS v FROM embeddings) e, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) u), f AS (SELECT token, COUNT(*) AS freq FROM t GROUP BY token HAVING COUNT(DISTINCT side) = 2) SELECT side, key, token, freq, rank FROM (SELECT CAST(side AS INTEGER) AS side, key, token, freq, CAST(row_number() OVER (PARTITION BY key ORDER BY freq DESC, token) AS INTEGER) AS rank FROM t JOIN f USING (token)) WHERE rank <= 5")
def _(spark, sf):
    vectors = _t(spark, sf, "embeddings")
    return blocking.cross_blocks(vectors.where("vec_id % 2 = 0"), vectors.where("vec_id % 2 = 1"), "vec_id", "embedding")
