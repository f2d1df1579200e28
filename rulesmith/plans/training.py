"""Queries of mined and learned rules, candidates, training rows and scans, with SQL that builds the same from joins and windows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from rulesmith.functions.dates import millis, parsed
from rulesmith.functions.predicates import constant_filter
from rulesmith.operators import measure, stats
from rulesmith.plans import lattice, tasks, trees
from rulesmith.plans.catalogue import COUNT_SQL, MEASURE_SQL, ORDERS, PAIR_SQL, QUERIES, SUPPORT, VERDICT_SQL, _store, _t, query
from rulesmith.plans.rules import MINIMAL_SQL
from rulesmith.sources.store import first_rows, in_batches

# --- mined rules ---

ITEM_COLUMNS = ("l_discount", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag", "l_tax")


def _mined_sql(table: str, columns: tuple[str, ...], levels: int, support: float, confidence: float) -> str:
    """All candidates up to a level from counts of their column sets, then the minimal rules."""
    sets = [x for size in range(1, levels + 2) for x in combinations(columns, size)]
    squares = " UNION ALL ".join(f"SELECT '{','.join(x)}' AS cols, SUM(c * c) AS s FROM (SELECT COUNT(*) AS c FROM {table} GROUP BY {', '.join(x)})" for x in sets)
    nodes = ", ".join(f"('{','.join(x)}', '{y}', '{','.join(sorted((*x, y)))}')" for x in sets if len(x) <= levels for y in columns if y not in x)
    verdicts = f"SELECT lhs, rhs, b.s / n2 AS support, b.s / a.s::DOUBLE AS confidence, b.s / n2 >= {support} AND b.s / a.s::DOUBLE >= {confidence} AS has_rule, b.s / n2 < {support} OR b.s / a.s::DOUBLE >= {confidence} AS prune FROM (VALUES {nodes}) t(lhs, rhs, all_cols) JOIN ({squares}) a ON a.cols = lhs JOIN ({squares}) b ON b.cols = all_cols, (SELECT COUNT(*)::DOUBLE * COUNT(*) AS n2 FROM {table}) n"
    named = "array_to_string(list_transform(string_split(lhs, ','), lambda x: 't0.' || x || '=t1.' || x), ' ^ ') || ' -> t0.' || rhs || '=t1.' || rhs AS ree"
    return f"SELECT {named}, * FROM ({MINIMAL_SQL.format(verdicts)})"


@query("lineitem_rules", _mined_sql("lineitem", ITEM_COLUMNS, 3, 1e-6, 0.5))
def _(spark, sf):
    state = lattice.mine(_t(spark, sf, "lineitem"), 1e-6, 0.5, list(ITEM_COLUMNS), max_level=3)
    return lattice.as_frame(spark, state.minimal)


#: Premises by text, with the number of tables they need.
WIDE_PREMISES = (("t0.o_orderpriority=t1.o_orderpriority", "o_orderpriority", 1), ("t0.o_orderstatus=t1.o_orderstatus", "o_orderstatus", 1), ("t2.c_mktsegment=t3.c_mktsegment", "c_mktsegment", 2), ("t4.n_regionkey=t5.n_regionkey", "n_regionkey", 3))
WIDE_ATOMS = ("orders(t0) ^ orders(t1)", "customer(t2) ^ customer(t3)", "nation(t4) ^ nation(t5)")
WIDE_JOINS = ("t0.o_custkey=t2.c_custkey ^ t1.o_custkey=t3.c_custkey", "t2.c_nationkey=t4.n_nationkey ^ t3.c_nationkey=t5.n_nationkey")
WIDE_TABLES = ("orders", "orders JOIN customer ON o_custkey = c_custkey", "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
EDGES = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]


def _wide_sql(targets: tuple[str, ...], support: float, confidence: float) -> str:
    rows = []
    for y in targets:
        for size in (1, 2):
            for lhs in combinations([p for p in WIDE_PREMISES if p[1] != y], size):
                n = max(p[2] for p in lhs)
                ree = " ^ ".join([*WIDE_ATOMS[:n], *WIDE_JOINS[: n - 1], *(p[0] for p in lhs)]) + f" -> t0.{y}=t1.{y}"
                squares = lambda columns, n=n: f"(SELECT SUM(c * c) FROM (SELECT COUNT(*) AS c FROM {WIDE_TABLES[n - 1]} GROUP BY {', '.join(columns)}))"
                names = [p[1] for p in lhs]
                rows.append(f"SELECT '{ree}' AS ree, {names} AS lhs, '{y}' AS rhs, {squares(names)} AS x, {squares([*names, y])} AS xy, (SELECT COUNT(*)::DOUBLE * COUNT(*) FROM {WIDE_TABLES[n - 1]}) AS n2")
    made = f"WITH v AS (SELECT ree, lhs, rhs, xy / n2 AS support, xy / x::DOUBLE AS confidence FROM ({' UNION ALL '.join(rows)}))"
    return f"{made} SELECT ree, support, confidence FROM v WHERE support >= {support} AND confidence >= {confidence} AND NOT EXISTS (SELECT 1 FROM v o WHERE o.rhs = v.rhs AND len(o.lhs) < len(v.lhs) AND list_has_all(v.lhs, o.lhs) AND (o.support < {support} OR o.confidence >= {confidence}))"


@query("table_rules", _wide_sql(("o_orderstatus", "o_orderpriority"), 1e-4, 0.3))
def _(spark, sf):
    tables = {t: _t(spark, sf, t) for t in ("orders", "customer", "nation")}
    columns = {"orders": ["o_orderstatus", "o_orderpriority"], "customer": ["c_mktsegment"], "nation": ["n_regionkey"]}
    found = tasks.table_rules(tables, EDGES, "orders", ["o_orderstatus", "o_orderpriority"], columns, 1e-4, 0.3)
    return spark.createDataFrame(found, "ree string, support double, confidence double")


# --- trees ---

TREE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")


def _tree_sql(table: str, features: tuple[str, ...], label: str, classes: str, support: float, confidence: float) -> str:
    """The tree level by level: cumulative counts of each class by window, the best cut of each leaf, rows and paths of the next level."""
    x = lambda c: f"(CASE WHEN {c} > 0 THEN ({c}) * ln({c}) ELSE 0 END)"
    ctes = [f"r0 AS (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in features)}, {label} AS y, 0 AS leaf FROM {table})", "p0 AS (SELECT 0 AS leaf, CAST([] AS STRUCT(c VARCHAR, op VARCHAR, v DOUBLE)[]) AS cuts)", "n AS (SELECT COUNT(*)::DOUBLE AS n FROM r0)"]
    for d in range(trees.MAX_DEPTH):
        cells = " UNION ALL ".join(f"SELECT leaf, {k} AS f, '{c}' AS c, {c} AS v, y FROM r{d}" for k, c in enumerate(features))
        ctes.append(f"h{d} AS (SELECT leaf, f, c, v, {', '.join(f"COUNT(*) FILTER (WHERE y = '{y}')::DOUBLE AS k{y}" for y in classes)} FROM ({cells}) GROUP BY leaf, f, c, v)")
        sums = ", ".join(f"coalesce(SUM(k{y}) OVER before, 0) AS l{y}, SUM(k{y}) OVER every AS t{y}" for y in classes)
        ctes.append(f"s{d} AS (SELECT leaf, f, c, v, lag(v) OVER (PARTITION BY leaf, f ORDER BY v) AS last, {sums} FROM h{d} WINDOW before AS (PARTITION BY leaf, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), every AS (PARTITION BY leaf, f))")
        left, whole = "+".join(f"l{y}" for y in classes), "+".join(f"t{y}" for y in classes)
        right = f"({whole})-({left})"
        of = lambda e: "+".join(x(e(y)) for y in classes)
        gain = f"{x(whole)} - ({of(lambda y: f't{y}')}) - ({x(left)} - ({of(lambda y: f'l{y}')})) - ({x(right)} - ({of(lambda y: f't{y}-l{y}')}))"
        ctes.append(f"g{d} AS (SELECT leaf, f, c, (v + last) / 2 AS cut, round({gain}, 9) AS gain FROM s{d}, n WHERE last IS NOT NULL AND least({left}, {right}) >= greatest({trees.MIN_ROWS}, {trees.MIN_RATE} * n))")
        ctes.append(f"b{d} AS (SELECT leaf, c, cut FROM g{d}, n WHERE gain / n > {trees.MIN_GAIN} QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY gain DESC, f, cut) = 1)")
        value = "CASE c " + " ".join(f"WHEN '{c}' THEN {c}" for c in features) + " END"
        ctes.append(f"r{d + 1} AS (SELECT {', '.join(features)}, y, CASE WHEN cut IS NULL THEN r.leaf WHEN {value} < cut THEN 2 * r.leaf + 1 ELSE 2 * r.leaf + 2 END AS leaf FROM r{d} r LEFT JOIN b{d} b ON b.leaf = r.leaf)")
        child = lambda k, op, d=d: f"SELECT 2 * p.leaf + {k} AS leaf, list_append(cuts, struct_pack(c := c, op := '{op}', v := cut)) AS cuts FROM p{d} p JOIN b{d} b ON b.leaf = p.leaf"
        ctes.append(f"p{d + 1} AS (SELECT leaf, cuts FROM p{d} WHERE leaf NOT IN (SELECT leaf FROM b{d}) UNION ALL {child(1, '<')} UNION ALL {child(2, '>=')})")
    end = trees.MAX_DEPTH
    ctes.append(f"u AS (SELECT leaf, unnest(cuts) AS k FROM p{end})")
    ctes.append("tight AS (SELECT leaf, k.c AS c, k.op AS op, CASE k.op WHEN '<' THEN MIN(k.v) ELSE MAX(k.v) END AS v FROM u GROUP BY leaf, k.c, k.op)")
    ctes.append("said AS (SELECT leaf, string_agg('t0.' || c || op || format('{:g}', v), ' ^ ' ORDER BY c, op) AS lhs FROM tight GROUP BY leaf)")
    ctes.append(f"ends AS (SELECT leaf, y, COUNT(*)::DOUBLE AS k, SUM(COUNT(*)) OVER (PARTITION BY leaf)::DOUBLE AS m FROM r{end} GROUP BY leaf, y)")
    return f"WITH {', '.join(ctes)} SELECT lhs || ' -> t0.{label}=' || y AS ree, k / n AS support, k / m AS confidence FROM ends JOIN said USING (leaf), n WHERE k / n > {support} AND k / m > {confidence}"


@query("tree_rules", _tree_sql("lineitem", TREE_FEATURES, "l_returnflag", "ANR", 1e-5, 0.3))
def _(spark, sf):
    items = _t(spark, sf, "lineitem")
    leaves = trees.grow(items, list(TREE_FEATURES), "l_returnflag")
    return spark.createDataFrame(trees.tree_rules(leaves, "l_returnflag", items.count(), 1e-5, 0.3), "ree string, support double, confidence double")


@query("avc_interval", "SELECT o_totalprice AS val, o_orderstatus AS label, COUNT(*) AS w FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000 GROUP BY 1, 2")
def _(spark, sf):
    return stats.avc_within(_t(spark, sf, "orders"), "o_totalprice", "o_orderstatus", 100000, 120000)


# --- tasks and candidates ---


@query("task_latest", "SELECT 0.00001::DOUBLE AS support, 0.25::DOUBLE AS confidence, COUNT(*) AS n_rows FROM orders")
def _(spark, sf):
    """The latest of three stored tasks, the last of which is deleted."""
    orders, store = _t(spark, sf, "orders"), _store(spark)
    for confidence in (0.9, 0.25, 0.5):
        tasks.run_task(orders, store, SUPPORT, confidence, columns=list(ORDERS), max_level=1)
    store.delete(SUPPORT, 0.5)
    return store.latest().select("support", "confidence", "n_rows")


@query("candidate_order", f"SELECT col, CAST(row_number() OVER (ORDER BY pairs / n2 DESC, col DESC) AS INTEGER) AS place FROM (SELECT col, SUM(cnt * (cnt - 1)) AS pairs FROM ({COUNT_SQL}) GROUP BY col) a, (SELECT COUNT(*)::DOUBLE * COUNT(*) AS n2 FROM orders) b")
def _(spark, sf):
    return lattice.ordered_candidates(stats.predicate_support(_t(spark, sf, "orders"), list(ORDERS))).select("col", "place")


_TEXTS = f"(SELECT string_split(lhs, ',') AS l, rhs FROM ({VERDICT_SQL}) v WHERE has_rule)"
_COVERED = "COUNT(*) FILTER (WHERE EXISTS (SELECT 1 FROM {} o WHERE o.rhs = x.rhs AND list_has_all(x.l, o.l)))"


@query("coverage_both_ways", f"WITH a AS {_TEXTS}, b AS (SELECT * FROM a WHERE len(l) = 2) SELECT 'a' AS side, COUNT(*) AS rules, {_COVERED.format('b')} AS covered FROM a x UNION ALL SELECT 'b', COUNT(*), {_COVERED.format('a')} FROM b x")
def _(spark, sf):
    """All rules against those of two premises, and the other way, from their texts."""
    texts = QUERIES["layer_verdicts"](spark, sf).where("has_rule").select("lhs", F.concat(F.replace("lhs", F.lit(","), F.lit(" ^ ")), F.lit(" -> "), "rhs").alias("ree"))
    return lattice.coverage_both(texts, texts.where(F.col("lhs").contains(",")))


# --- training rows ---


@query("connected_rows", f"SELECT c_mktsegment AS customer__c_mktsegment, n_regionkey AS nation__n_regionkey, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS total FROM {WIDE_TABLES[2]} GROUP BY 1, 2")
def _(spark, sf):
    tables = {t: _t(spark, sf, t) for t in ("orders", "customer", "nation")}
    rows = tasks.connected_rows(tables, EDGES, "orders", {"orders": ["o_totalprice"], "customer": ["c_mktsegment"], "nation": ["n_regionkey"]})
    return rows.groupBy("customer__c_mktsegment", "nation__n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("orders__o_totalprice"), 2).alias("total"))


@query("expression_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax AS odd FROM lineitem")
def _(spark, sf):
    made = tasks.with_expressions(_t(spark, sf, "lineitem"), {"net": "l_extendedprice * (1 - l_discount)", "odd": "l_quantity + l_tax"})
    return made.select("l_orderkey", "l_linenumber", "net", "odd")


@query("training_sample", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) <= ceil((SELECT CASE WHEN COUNT(*) >= 100000 THEN 0.1 WHEN COUNT(*) >= 1000 THEN 0.25 ELSE 1 END * COUNT(*) FROM orders))")
def _(spark, sf):
    return tasks.training_sample(_t(spark, sf, "orders"), "o_orderkey", shares={1000: 0.25, 100_000: 0.1}).select("o_orderkey")


@query("seeded_sample", "SELECT o_orderkey FROM orders WHERE substr(md5('7:' || o_orderkey), 1, 8) < '40000000'")
def _(spark, sf):
    return tasks.seeded_sample(_t(spark, sf, "orders"), "o_orderkey", 0.25, 7).select("o_orderkey")


_FIRST = "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000)"


@query("sample_measure", MEASURE_SQL.format(t=_FIRST, pairs=PAIR_SQL.format(t=_FIRST, y="o_orderpriority", on="l.o_orderstatus = r.o_orderstatus")))
def _(spark, sf):
    return measure.pair_counts(first_rows(_t(spark, sf, "orders"), "o_orderkey", 1000), ["o_orderstatus"], "o_orderpriority")


# --- scans and times ---


@query("batch_scan", "SELECT p_partkey, length(p_name) AS n_signs, p_size * 2 AS twice FROM part")
def _(spark, sf):
    run = lambda b: b.assign(n_signs=b["p_name"].str.len(), twice=b["p_size"] * 2)[["p_partkey", "n_signs", "twice"]]
    return in_batches(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size"), run, "p_partkey long, n_signs long, twice int")


@query("time_filter", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-15'")
def _(spark, sf):
    orders = _t(spark, sf, "orders")
    kind = dict(orders.dtypes)["o_orderdate"]
    for op, day in ((">=", "1997-01-01"), ("<", "1997-03-15")):
        orders = orders.where(constant_filter(F.col("o_orderdate"), kind, op, day))
    return orders.select("o_orderkey")


@query("time_millis", "SELECT event_id, epoch_us(ts) // 1000 AS at, epoch_us(date_trunc('day', ts)) // 1000 AS day FROM events")
def _(spark, sf):
    day = millis(parsed(F.date_format("ts", "yyyy-MM-dd")))
    return _t(spark, sf, "events").select("event_id", millis(F.col("ts")).alias("at"), day.alias("day"))
