"""Queries of the rule engine over the standard tables, and the SQL that says the same in another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesmith.functions.predicates import constant_filter, parse_rule
from rulesmith.operators import blocking, corr, measure, stats
from rulesmith.plans import lattice, tasks, trees
from rulesmith.sources.store import Store, first_rows, live, rows_between

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns of orders that rules are mined over.
ORDERS = ("o_custkey", "o_orderpriority", "o_orderstatus")
SUPPORT, CONFIDENCE = 1e-5, 0.3
GRAM_SQL = "SELECT {key} AS key, substring(p, i, 3) AS gram, i FROM (SELECT {key}, '##' || {text} || '##' AS p FROM {table}) s, LATERAL (SELECT unnest(range(1, length(p) - 1)) AS i) u"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if c in columns else F.col(c) for c in df.columns])


# --- columns ---

COUNT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS val, COUNT(*) AS cnt FROM orders GROUP BY {c}" for c in ORDERS)


@query("col_value_counts", COUNT_SQL)
def _(spark, sf):
    return stats.value_counts(_t(spark, sf, "orders"), list(ORDERS))


@query("predicate_support", f"SELECT col, COUNT(*) AS n_distinct, CAST(SUM(cnt * (cnt - 1)) AS BIGINT) AS pairs, SUM(cnt * (cnt - 1)) > 0 AND SUM(cnt * (cnt - 1)) / (SUM(cnt)::DOUBLE * (SUM(cnt) - 1)) < 0.95 AS keep FROM ({COUNT_SQL}) GROUP BY col")
def _(spark, sf):
    return stats.predicate_support(_t(spark, sf, "orders"), list(ORDERS)).select("col", "n_distinct", "pairs", "keep")


@query("y_candidates", "SELECT col, n_distinct FROM (SELECT 'p_name' AS col, COUNT(DISTINCT p_name) AS n_distinct FROM part UNION ALL SELECT 'p_brand', COUNT(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', COUNT(DISTINCT p_type) FROM part) WHERE n_distinct > 1 AND n_distinct < 50")
def _(spark, sf):
    return stats.y_candidates(_t(spark, sf, "part"))


@query("dictionary_encode", "SELECT p_type AS val, CAST(COUNT(*) OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type FROM part)")
def _(spark, sf):
    return stats.dictionary(_t(spark, sf, "part"), "p_type").select("val", F.col("code").cast("int").alias("code"))


@query("value_positions", "SELECT p_type AS val, COUNT(*) AS n, MIN(p_partkey) AS first_row, MAX(p_partkey) AS last_row FROM part GROUP BY p_type")
def _(spark, sf):
    rows = stats.positions(_t(spark, sf, "part"), "p_type", "p_partkey")
    return rows.select("val", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0)).alias("first_row"), F.element_at("rows", -1).alias("last_row"))


@query("regex_class", "SELECT AVG(CASE WHEN regexp_matches(c_name, '^Customer#[0-9]+$') THEN 1.0 ELSE 0.0 END) > 0.75 AS classed FROM customer WHERE c_name <> ''")
def _(spark, sf):
    share = stats.regex_share(_t(spark, sf, "customer"), "c_name", r"^Customer#[0-9]+$")
    return spark.createDataFrame([((share or 0) > 0.75,)], "classed boolean")


@query("approx_cardinality")
def _(spark, sf):
    return _t(spark, sf, "lineitem").agg(*[F.approx_count_distinct(c).alias(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")])


# --- measures ---

PAIR_SQL = "SELECT COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE l.{y} = r.{y}) AS xysupp FROM {t} l JOIN {t} r ON {on}"
MEASURE_SQL = "SELECT n, xsupp, xysupp, xysupp / (n::DOUBLE * n) AS support, CASE WHEN xsupp > 0 THEN xysupp / xsupp::DOUBLE ELSE 0 END AS confidence FROM ({pairs}) p, (SELECT COUNT(*) AS n FROM {t}) q"


@query("rule_measure", MEASURE_SQL.format(t="orders", pairs=PAIR_SQL.format(t="orders", y="o_orderpriority", on="l.o_orderstatus = r.o_orderstatus AND l.o_custkey = r.o_custkey")))
def _(spark, sf):
    return measure.pair_counts(_t(spark, sf, "orders"), ["o_orderstatus", "o_custkey"], "o_orderpriority")


@query("xsupp", "SELECT COUNT(*) AS xsupp FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_returnflag = r.l_returnflag")
def _(spark, sf):
    pairs = measure.pair_counts(_t(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus")
    return pairs.select("xsupp")


@query("xysupp", "SELECT COUNT(*) AS xysupp FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_returnflag = r.l_returnflag AND l.l_linestatus = r.l_linestatus")
def _(spark, sf):
    return measure.pair_counts(_t(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linestatus").select("xysupp")


def _pairs_of(columns) -> str:
    return f"(SELECT CAST(SUM(c * c) AS BIGINT) FROM (SELECT COUNT(*) AS c FROM orders GROUP BY {', '.join(columns)}))"


def _layer_sql(size: int) -> str:
    from itertools import combinations

    rows = [f"SELECT '{','.join(x)}' AS lhs, '{y}' AS rhs, {_pairs_of(x)} AS xsupp, {_pairs_of((*x, y))} AS xysupp" for x in combinations(ORDERS, size) for y in ORDERS if y not in x]
    return " UNION ALL ".join(rows)


def _layer(spark, sf, size: int) -> DataFrame:
    rows = measure.layer(_t(spark, sf, "orders"), list(ORDERS), size)
    return spark.createDataFrame([(",".join(x), y, fx, fxy) for x, y, fx, fxy in rows], "lhs string, rhs string, xsupp long, xysupp long")


@query("layer1_measures", _layer_sql(1))
def _(spark, sf):
    return _layer(spark, sf, 1)


@query("layer2_measures", _layer_sql(2))
def _(spark, sf):
    return _layer(spark, sf, 2)


VERDICT_SQL = f"SELECT lhs, rhs, xsupp, xysupp, xysupp / n2 AS support, xysupp / xsupp::DOUBLE AS confidence, xysupp / n2 >= {SUPPORT} AND xysupp / xsupp::DOUBLE >= {CONFIDENCE} AS has_rule, xysupp / n2 < {SUPPORT} OR xysupp / xsupp::DOUBLE >= {CONFIDENCE} AS prune FROM ({_layer_sql(1)} UNION ALL {_layer_sql(2)}) a, (SELECT COUNT(*)::DOUBLE * COUNT(*) AS n2 FROM orders) b"


@query("layer_verdicts", VERDICT_SQL)
def _(spark, sf):
    n = _t(spark, sf, "orders").agg((F.count("*").cast("double") * F.count("*")).alias("n2"))
    both = _layer(spark, sf, 1).unionByName(_layer(spark, sf, 2)).crossJoin(n)  # one row
    made = both.withColumn("support", F.col("xysupp") / F.col("n2")).withColumn("confidence", F.col("xysupp") / F.col("xsupp"))
    enough, sure = F.col("support") >= SUPPORT, F.col("confidence") >= CONFIDENCE
    return made.select("lhs", "rhs", "xsupp", "xysupp", "support", "confidence", (enough & sure).alias("has_rule"), (~enough | sure).alias("prune"))


@query("minimal_rules", f"WITH v AS ({VERDICT_SQL}), r AS (SELECT * FROM v WHERE has_rule) SELECT lhs, rhs, support, confidence FROM r WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.prune AND o.rhs = r.rhs AND o.lhs <> r.lhs AND len(list_filter(string_split(o.lhs, ','), lambda x: NOT list_contains(string_split(r.lhs, ','), x))) = 0)")
def _(spark, sf):
    state = lattice.mine(_t(spark, sf, "orders"), SUPPORT, CONFIDENCE, list(ORDERS), max_level=2)
    return lattice.as_frame(spark, state.minimal).select("lhs", "rhs", "support", "confidence")


@query("incremental_rules", f"WITH v AS ({VERDICT_SQL.replace(str(CONFIDENCE), '0.25')}), r AS (SELECT * FROM v WHERE has_rule) SELECT lhs, rhs, support, confidence FROM r WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.prune AND o.rhs = r.rhs AND o.lhs <> r.lhs AND len(list_filter(string_split(o.lhs, ','), lambda x: NOT list_contains(string_split(r.lhs, ','), x))) = 0)")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    before = lattice.mine(orders, SUPPORT, 0.9, list(ORDERS), max_level=2)
    return lattice.as_frame(spark, lattice.mine(orders, SUPPORT, 0.25, state=before, max_level=2).minimal).select("lhs", "rhs", "support", "confidence")


@query("const_filter_rule", MEASURE_SQL.format(t="(SELECT * FROM part WHERE p_size >= 25)", pairs=PAIR_SQL.format(t="(SELECT * FROM part WHERE p_size >= 25)", y="p_type", on="l.p_brand = r.p_brand AND l.p_size = r.p_size")))
def _(spark, sf):
    part = _t(spark, sf, "part")
    return measure.pair_counts(part, ["p_brand", "p_size"], "p_type", constant_filter(F.col("p_size"), "int", ">=", "25"))


@query("calsupp_value", "SELECT xsupp, xysupp FROM (" + PAIR_SQL.format(t="(SELECT * FROM orders WHERE o_orderstatus = 'F')", y="o_orderpriority", on="l.o_orderstatus = r.o_orderstatus AND l.o_custkey = r.o_custkey") + ") p")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    return measure.pair_counts(orders, ["o_orderstatus", "o_custkey"], "o_orderpriority", constant_filter(F.col("o_orderstatus"), "string", "=", "F")).select("xsupp", "xysupp")


@query("violations", "SELECT l.o_custkey, l.o_orderstatus, COUNT(*) AS pairs FROM orders l JOIN orders r ON l.o_custkey = r.o_custkey AND l.o_orderstatus = r.o_orderstatus AND l.o_orderpriority <> r.o_orderpriority GROUP BY 1, 2")
def _(spark, sf):
    return measure.violations(_t(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")


RULE_2T = "lineitem(t0) ^ lineitem(t1) ^ orders(t2) ^ orders(t3) ^ t0.l_orderkey=t2.o_orderkey ^ t1.l_orderkey=t3.o_orderkey ^ t2.o_custkey=t3.o_custkey ^ t0.l_returnflag=t1.l_returnflag -> t0.l_linestatus=t1.l_linestatus"
RULE_3T = "lineitem(t0) ^ lineitem(t1) ^ orders(t2) ^ orders(t3) ^ customer(t4) ^ customer(t5) ^ t0.l_orderkey=t2.o_orderkey ^ t1.l_orderkey=t3.o_orderkey ^ t2.o_custkey=t4.c_custkey ^ t3.o_custkey=t5.c_custkey ^ t2.o_orderpriority=t3.o_orderpriority ^ t4.c_nationkey=t5.c_nationkey ^ t0.l_partkey=t1.l_partkey -> t4.c_mktsegment=t5.c_mktsegment"
RULE_CROSS = "customer(t0) ^ supplier(t1) ^ t0.c_nationkey>=5 ^ t0.c_nationkey=t1.s_nationkey -> t0.c_custkey=t1.s_suppkey"
WIDE_SQL = "WITH w AS ({w}) SELECT row_size, xsupp, xysupp, xysupp / row_size::DOUBLE AS support, CASE WHEN xsupp > 0 THEN xysupp / xsupp::DOUBLE ELSE 0 END AS confidence FROM (SELECT COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE l.{y} = r.{y}) AS xysupp FROM w l JOIN w r ON {on}) p, (SELECT COUNT(*) * COUNT(*) AS row_size FROM w) q"


@query("fk_join_rule_2t", WIDE_SQL.format(w="SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey", y="l_linestatus", on="l.o_custkey = r.o_custkey AND l.l_returnflag = r.l_returnflag"))
def _(spark, sf):
    return measure.evaluate(parse_rule(RULE_2T), {t: _t(spark, sf, t) for t in ("lineitem", "orders")})


@query("fk_join_rule_3t", WIDE_SQL.format(w="SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey", y="c_mktsegment", on="l.o_orderpriority = r.o_orderpriority AND l.c_nationkey = r.c_nationkey AND l.l_partkey = r.l_partkey"))
def _(spark, sf):
    return measure.evaluate(parse_rule(RULE_3T), {t: _t(spark, sf, t) for t in ("lineitem", "orders", "customer")})


@query("cross_table_rule", "SELECT row_size, xsupp, xysupp, xysupp / row_size::DOUBLE AS support, xysupp / xsupp::DOUBLE AS confidence FROM (SELECT COUNT(*) AS row_size FROM customer, supplier WHERE c_nationkey >= 5) a, (SELECT COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE c_custkey = s_suppkey) AS xysupp FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey >= 5) b")
def _(spark, sf):
    return measure.evaluate(parse_rule(RULE_CROSS), {t: _t(spark, sf, t) for t in ("customer", "supplier")})


@query("wide_table_count", "SELECT o_orderpriority, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, sf):
    wide = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return wide.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# --- trees and histograms ---


@query("gini_index", "SELECT xy, nxy, xny, nxny, round((xny + nxny) / (xy + nxy + xny + nxny)::DOUBLE * (1 - pow(xny / (xny + nxny)::DOUBLE, 2) - pow(nxny / (xny + nxny)::DOUBLE, 2)) + (xy + nxy) / (xy + nxy + xny + nxny)::DOUBLE * (1 - pow(xy / (xy + nxy)::DOUBLE, 2) - pow(nxy / (xy + nxy)::DOUBLE, 2)), 9) AS gini FROM (SELECT COUNT(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS xy, COUNT(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'O') AS nxy, COUNT(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'O') AS xny, COUNT(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'O') AS nxny FROM lineitem)")
def _(spark, sf):
    return _rounded(stats.gini_index(_t(spark, sf, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"), "gini")


@query("avc_small", "SELECT CAST(l_quantity AS DOUBLE) AS val, l_returnflag AS label, COUNT(*) AS w FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return stats.avc(_t(spark, sf, "lineitem"), "l_quantity", "l_returnflag")


@query("avc_binned", "SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 100)), 99) AS INTEGER) AS bin, o_orderstatus AS label, COUNT(*) AS w FROM orders, (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders) GROUP BY 1, 2")
def _(spark, sf):
    return stats.avc_binned(_t(spark, sf, "orders"), "o_totalprice", "o_orderstatus")


@query("entropy_split", "WITH c AS (SELECT p_size::DOUBLE AS v, SUM((p_type = t)::INT)::DOUBLE AS n, t FROM part, (SELECT DISTINCT p_type AS t FROM part) GROUP BY 1, 3), k AS (SELECT a.v AS cut_at, (SELECT MAX(v) FROM c z WHERE z.v < a.v) AS prev, b.t, SUM(CASE WHEN b.v < a.v THEN b.n ELSE 0 END) AS l, SUM(b.n) AS tot FROM (SELECT DISTINCT v FROM c) a, c b GROUP BY a.v, b.t), s AS (SELECT *, SUM(l) OVER w AS sl, SUM(tot) OVER w AS st FROM k WHERE prev IS NOT NULL WINDOW w AS (PARTITION BY cut_at)) SELECT (cut_at + prev) / 2 AS cut, round((SUM(CASE WHEN tot > 0 THEN -tot * ln(tot / st) ELSE 0 END) - SUM(CASE WHEN l > 0 THEN -l * ln(l / sl) ELSE 0 END) - SUM(CASE WHEN tot - l > 0 THEN -(tot - l) * ln((tot - l) / (st - sl)) ELSE 0 END)) / MAX(st), 9) AS gain FROM s GROUP BY cut_at, prev")
def _(spark, sf):
    return _rounded(stats.splits(_t(spark, sf, "part"), "p_size", "p_type"), "gain")


@query("onehot_train", "SELECT CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice, CAST(p_brand = 'Brand#1' AS INTEGER) AS \"p_brand=Brand#1\", CAST(p_brand = 'Brand#2' AS INTEGER) AS \"p_brand=Brand#2\", CAST(y AS INTEGER) AS y FROM part JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS y FROM (SELECT DISTINCT p_type AS t FROM part)) d ON d.t = p_type")
def _(spark, sf):
    return stats.one_hot(_t(spark, sf, "part"), {"p_brand": ["Brand#1", "Brand#2"]}, ["p_size", "p_retailprice"], "p_type").withColumn("y", F.col("y").cast("int"))


# --- correlation ---


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem")
def _(spark, sf):
    return _rounded(corr.pearson(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "r")


@query("spearman", "SELECT round(corr(a, b), 9) AS r FROM (SELECT rank() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (COUNT(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)")
def _(spark, sf):
    return _rounded(corr.spearman(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), "r")


@query("kendall", "SELECT round(s / sqrt((n0 - tx) * (n0 - ty)), 9) AS tau FROM (SELECT SUM(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice))::DOUBLE AS s, COUNT(*)::DOUBLE AS n0, COUNT(*) FILTER (WHERE a.p_size = b.p_size)::DOUBLE AS tx, COUNT(*) FILTER (WHERE a.p_retailprice = b.p_retailprice)::DOUBLE AS ty FROM part a JOIN part b ON a.p_partkey < b.p_partkey)")
def _(spark, sf):
    return _rounded(corr.kendall(_t(spark, sf, "part"), "p_size", "p_retailprice"), "tau")


@query("top_columns", "SELECT col, round(r, 9) AS r FROM (SELECT 'l_quantity' AS col, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_linenumber', abs(corr(l_linenumber, l_extendedprice)) FROM lineitem) ORDER BY r DESC LIMIT 3")
def _(spark, sf):
    return _rounded(corr.top_columns(_t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice", 3), "r")


# --- blocking ---

TOKENS_SQL = "SELECT key, CASE WHEN k = 1 THEN gram ELSE gram || '_' || (k - 1) END AS token FROM (SELECT key, gram, row_number() OVER (PARTITION BY key, gram ORDER BY i) AS k FROM (" + GRAM_SQL.format(key="p_partkey", text="p_name", table="part") + "))"


@query("ngram_tokens", TOKENS_SQL)
def _(spark, sf):
    return blocking.ngrams(_t(spark, sf, "part"), "p_partkey", "p_name")


@query("token_freq", f"SELECT token, COUNT(*) AS freq FROM ({TOKENS_SQL}) GROUP BY token")
def _(spark, sf):
    return blocking.token_freq(blocking.ngrams(_t(spark, sf, "part"), "p_partkey", "p_name"))


ORDER_SQL = f"SELECT token, freq, row_number() OVER (ORDER BY freq, token) - 1 AS ord FROM (SELECT token, COUNT(*) AS freq FROM ({TOKENS_SQL}) GROUP BY token) WHERE freq > 1 AND freq <= (SELECT COUNT(*) / 2.0 FROM part)"


@query("blocking_ids", f"SELECT key, array_to_string(list_concat([list_max(o)], list_slice(list_sort(o), 1, 10)), ',') AS ids FROM (SELECT key, list(ord) AS o FROM ({TOKENS_SQL}) t JOIN ({ORDER_SQL}) s USING (token) GROUP BY key)")
def _(spark, sf):
    return blocking.derived(blocking.ngrams(_t(spark, sf, "part"), "p_partkey", "p_name")).select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("jaccard_pairs", "WITH t AS (" + TOKENS_SQL.replace("p_partkey", "s_suppkey").replace("p_name", "s_name").replace("FROM part", "FROM supplier") + "), n AS (SELECT key, COUNT(*) AS n FROM t GROUP BY key) SELECT a, b, i / (x.n + y.n - i)::DOUBLE AS jaccard FROM (SELECT l.key AS a, r.key AS b, COUNT(*) AS i FROM t l JOIN t r ON l.token = r.token AND l.key < r.key GROUP BY 1, 2) p JOIN n x ON x.key = a JOIN n y ON y.key = b WHERE i / (x.n + y.n - i)::DOUBLE >= 0.8")
def _(spark, sf):
    return blocking.jaccard_pairs(_t(spark, sf, "supplier"), "s_suppkey", "s_name", 0.8)


@query("lsh_dim_blocks", "WITH t AS (SELECT vec_id AS key, (i - 1) || ':' || CAST(floor(CAST(embedding[i] AS DOUBLE) * 10) AS BIGINT) AS token FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i) u), f AS (SELECT token, COUNT(*) AS freq FROM t GROUP BY token HAVING COUNT(*) > 1) SELECT * FROM (SELECT key, token, freq, CAST(row_number() OVER (PARTITION BY key ORDER BY freq DESC, token) AS INTEGER) AS rank FROM t JOIN f USING (token)) WHERE rank <= 5")
def _(spark, sf):
    return blocking.dimension_blocks(_t(spark, sf, "embeddings"), "vec_id", "embedding")


# --- rules as data ---


@query("cdf_hist", "WITH r AS (" + VERDICT_SQL + ") SELECT cut, (SELECT COUNT(*) FROM r WHERE confidence >= cut) AS n FROM (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS cut)")
def _(spark, sf):
    return lattice.cdf_hist(QUERIES["layer_verdicts"](spark, sf))


COVER_SQL = f"WITH v AS ({VERDICT_SQL}), batch AS (SELECT * FROM v WHERE has_rule), inc AS (SELECT * FROM batch WHERE lhs NOT LIKE '%,%') SELECT lhs || '->' || rhs AS ree, EXISTS (SELECT 1 FROM inc WHERE inc.rhs = batch.rhs AND len(list_filter(string_split(inc.lhs, ','), lambda x: NOT list_contains(string_split(batch.lhs, ','), x))) = 0) AS covered FROM batch"


@query("rule_coverage", COVER_SQL)
def _(spark, sf):
    rules = QUERIES["layer_verdicts"](spark, sf).where("has_rule").withColumn("ree", F.concat("lhs", F.lit("->"), "rhs"))
    return lattice.coverage(rules, rules.where(~F.col("lhs").contains(",")))


@query("recall", f"SELECT round(AVG(covered::INT), 9) AS recall FROM ({COVER_SQL})")
def _(spark, sf):
    return QUERIES["rule_coverage"](spark, sf).agg(F.round(F.avg(F.col("covered").cast("int")), 9).alias("recall"))


@query("sample_first_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(spark, sf):
    from rulesmith.sources.store import first_rows

    return first_rows(_t(spark, sf, "orders"), "o_orderkey", 1000).select("o_orderkey", "o_custkey")


@query("row_projection", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    from rulesmith.sources.store import rows_where

    keys = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows_where(_t(spark, sf, "orders"), keys, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("range_filter", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS total FROM part WHERE p_size > 10 AND p_size <= 30 AND p_brand <> 'Brand#1'")
def _(spark, sf):
    part, kinds = _t(spark, sf, "part"), dict(_t(spark, sf, "part").dtypes)
    for c, op, v in (("p_size", ">", "10"), ("p_size", "<=", "30"), ("p_brand", "!=", "Brand#1")):
        part = part.where(constant_filter(F.col(c), kinds[c], op, v))
    return part.agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("id_set_operations", "SELECT l_orderkey AS key, coalesce(len(list_intersect(list(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'O'), list(DISTINCT l_partkey) FILTER (WHERE l_linestatus = 'F'))), 0) AS n_both, COUNT(DISTINCT l_partkey) AS n_any FROM lineitem GROUP BY 1")
def _(spark, sf):
    side = lambda s: F.collect_set(F.when(F.col("l_linestatus") == s, F.col("l_partkey")))
    made = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(side("O").alias("a"), side("F").alias("b"))
    return made.select("key", F.size(F.array_intersect("a", "b")).cast("long").alias("n_both"), F.size(F.array_union("a", "b")).cast("long").alias("n_any"))


@query("frequent_sets", "WITH i AS (SELECT o_orderkey AS k, 'p=' || o_orderpriority AS item FROM orders UNION ALL SELECT o_orderkey, 's=' || o_orderstatus FROM orders), f AS (SELECT item AS items, COUNT(*) AS freq FROM i GROUP BY 1 UNION ALL SELECT a.item || ',' || b.item, COUNT(*) FROM i a JOIN i b ON a.k = b.k AND a.item < b.item GROUP BY 1) SELECT items, freq FROM f WHERE freq >= 0.05 * (SELECT COUNT(*) FROM orders)")
def _(spark, sf):
    from pyspark.ml.fpm import FPGrowth

    baskets = _t(spark, sf, "orders").select(F.array(F.concat(F.lit("p="), "o_orderpriority"), F.concat(F.lit("s="), "o_orderstatus")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=0.05, minConfidence=0.5).fit(baskets).freqItemsets
    return found.select(F.array_join(F.sort_array("items"), ",").alias("items"), "freq")


@query("row_sentence", "SELECT p_partkey, p_name || '#' || p_brand || '#' || CAST(p_size AS VARCHAR) AS sentence FROM part")
def _(spark, sf):
    return blocking.row_sentence(_t(spark, sf, "part"), ["p_name", "p_brand", "p_size"]).select("p_partkey", "sentence")


@query("tree_path_rows", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_y FROM lineitem WHERE l_quantity < 10.5 AND l_discount >= 0.05")
def _(spark, sf):
    rows = _t(spark, sf, "lineitem")
    for c, op, v in trees.simplified([("l_quantity", "<", 30.5), ("l_discount", ">=", 0.05), ("l_quantity", "<", 10.5)]):
        rows = rows.where(constant_filter(F.col(c), "double", op, str(v)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_y"))


GINI_SQL = "SELECT '{v}' AS value, round(y / n * (1 - pow(xy / y, 2) - pow((y - xy) / y, 2)) + (n - y) / n * (1 - pow((x - xy) / (n - y), 2) - pow((n - y - x + xy) / (n - y), 2)), 9) AS gini FROM (SELECT COUNT(*)::DOUBLE AS n, COUNT(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS y, COUNT(*) FILTER (WHERE l_returnflag = '{v}')::DOUBLE AS x, COUNT(*) FILTER (WHERE l_returnflag = '{v}' AND l_linestatus = 'O')::DOUBLE AS xy FROM lineitem)"


@query("gini_top", "SELECT * FROM (" + " UNION ALL ".join(GINI_SQL.format(v=v) for v in "ANR") + ") q ORDER BY gini, value LIMIT 2")
def _(spark, sf):
    return stats.gini_best(_t(spark, sf, "lineitem"), "l_returnflag", F.col("l_linestatus") == "O", 2)


@query("greedy_clusters")
def _(spark, sf):
    return blocking.greedy_clusters(_t(spark, sf, "part"), "p_partkey", "p_name", "p_brand", 0.5)


@query("hash_groups", "SELECT CAST(o_custkey % 7 AS INTEGER) AS bucket, COUNT(DISTINCT o_custkey) AS n_values, COUNT(*) AS n_rows FROM orders GROUP BY 1")
def _(spark, sf):
    per = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("c"))
    return per.groupBy(F.pmod("o_custkey", F.lit(7)).cast("int").alias("bucket")).agg(F.count("*").alias("n_values"), F.sum("c").alias("n_rows"))


# --- tasks, lookups and scans ---


def _store(spark: SparkSession) -> Store:
    from uuid import uuid4

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return Store(spark, f"{folder or '/tmp/checkpoints'}/rule-store-{uuid4().hex}")


@query("task_run", ORACLE_SQL["incremental_rules"])
def _(spark, sf):
    """A task from scratch, then one from the latest task with a lower confidence, both by way of the store."""
    orders, store = _t(spark, sf, "orders"), _store(spark)
    tasks.run_task(orders, store, SUPPORT, 0.9, columns=list(ORDERS), max_level=2)
    _, state = tasks.run_task(orders, store, SUPPORT, 0.25, "latest", max_level=2)
    return lattice.as_frame(spark, state.minimal).select("lhs", "rhs", "support", "confidence")


@query("abandoned_rules", f"SELECT lhs, rhs FROM ({VERDICT_SQL}) v WHERE has_rule AND NOT (lhs = 'o_custkey' AND rhs = 'o_orderstatus')")
def _(spark, sf):
    rules = QUERIES["layer_verdicts"](spark, sf).where("has_rule").withColumn("ree", F.concat("lhs", F.lit("->"), "rhs"))
    return tasks.without(rules, spark.createDataFrame([("o_custkey->o_orderstatus",)], "ree string")).select("lhs", "rhs")


RULE_COLUMNS = "lineitem(t0) ^ lineitem(t1) ^ t0.l_partkey=t1.l_suppkey ^ t0.l_returnflag=t1.l_returnflag -> t0.l_linestatus=t1.l_linestatus"


@query("cross_column_rule", "SELECT row_size, xsupp, xysupp, xysupp / row_size::DOUBLE AS support, xysupp / xsupp::DOUBLE AS confidence FROM (SELECT COUNT(*) AS xsupp, COUNT(*) FILTER (WHERE l.l_linestatus = r.l_linestatus) AS xysupp FROM lineitem l JOIN lineitem r ON l.l_partkey = r.l_suppkey AND l.l_returnflag = r.l_returnflag) p, (SELECT COUNT(*) * COUNT(*) AS row_size FROM lineitem) q")
def _(spark, sf):
    return measure.evaluate(parse_rule(RULE_COLUMNS), {"lineitem": _t(spark, sf, "lineitem")})


@query("all_tree_rules")
def _(spark, sf):
    return spark.createDataFrame(tasks.all_tree_rules(_t(spark, sf, "orders"), 1e-5, 0.3), "ree string, support double, confidence double")


@query("pair_tree_rules")
def _(spark, sf):
    found = tasks.pair_tree_rules(_t(spark, sf, "lineitem"), "l_orderkey", ["l_partkey"], "l_linestatus", ["l_returnflag", "l_tax", "l_discount"], 1e-5, 0.5)
    return spark.createDataFrame(found, "ree string, support double, confidence double")


@query("split_weights", "WITH p AS (SELECT CASE WHEN p_size % 7 <> 0 THEN p_size END AS s FROM part), w AS (SELECT AVG((s < 25)::INT) AS l, COUNT(*) FILTER (WHERE s IS NULL) AS nulls, COUNT(*) FILTER (WHERE s < 25) AS a, COUNT(*) FILTER (WHERE s >= 25) AS b FROM p) SELECT 'L' AS side, round(a + nulls * l, 6) AS weight FROM w UNION ALL SELECT 'R', round(b + nulls * (1 - l), 6) FROM w")
def _(spark, sf):
    part = _t(spark, sf, "part").select(F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("s"))
    return tasks.weighted(part, "s", 25.0).groupBy("side").agg(F.round(F.sum("weight"), 6).alias("weight"))


@query("value_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    return rows_between(orders.where(constant_filter(F.col("o_orderstatus"), "string", "=", "F")), "o_orderkey", 10, 50, ["o_orderkey", "o_custkey"])


@query("sample_share", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil(0.01 * (SELECT COUNT(*) FROM orders))")
def _(spark, sf):
    return first_rows(_t(spark, sf, "orders"), "o_orderkey", share=0.01).select("o_orderkey")


@query("live_rows", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1")
def _(spark, sf):
    marked = _t(spark, sf, "lineitem").withColumn("deleted", F.col("l_linestatus") == "F")
    return live(marked, "deleted").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("moments", "SELECT round(AVG(l_extendedprice), 4) AS mean, round(var_samp(l_extendedprice) / 1e6, 4) AS variance, round(stddev_samp(l_extendedprice), 4) AS deviation, MAX(l_extendedprice) AS greatest, AVG((l_extendedprice IS NULL)::INT) AS null_share FROM lineitem")
def _(spark, sf):
    made = corr.moments(_t(spark, sf, "lineitem"), "l_extendedprice").withColumn("variance", F.col("variance") / 1e6)
    return made.select(*[F.round(c, 4).alias(c) for c in ("mean", "variance", "deviation")], "greatest", "null_share")


@query("prefix_tokens", f"SELECT key, array_to_string(list_slice(list_sort(o), 1, CAST(ceil(len(o) * (1 - 0.8)) AS INTEGER)), ',') AS ids FROM (SELECT key, list(ord) AS o FROM ({TOKENS_SQL}) t JOIN ({ORDER_SQL}) s USING (token) GROUP BY key)")
def _(spark, sf):
    found = blocking.prefix_tokens(blocking.ngrams(_t(spark, sf, "part"), "p_partkey", "p_name"), 0.8)
    return found.select("key", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
