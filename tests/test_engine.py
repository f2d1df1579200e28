"""The engine against DuckDB, a plain miner and the self-join definition."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulesmith.functions.dates import millis, parsed
from rulesmith.functions.predicates import is_connected, ordered, parse_predicate, parse_rule
from rulesmith.operators import blocking, corr, measure, stats
from rulesmith.plans import catalogue, lattice, rules, samples, tasks, training, trees  # noqa: F401
from rulesmith.sources.store import Store, first_rows, read_csv, read_vectors


def _values(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.8g}")
        return float(f"{float(x):.8g}") if hasattr(x, "as_tuple") else x

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = _values(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in catalogue.ORACLE_SQL:
        want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.ORACLE_SQL[name]}) q").fetchall()
        assert got == _values(want)


ROWS = [("a", "x", 1, "p"), ("a", "x", 1, "q"), ("a", "y", 2, "p"), ("b", "y", None, "p"), ("b", "", 2, "q"), (None, "x", 1, "q"), ("", "x", 2, "p"), ("b", "y", 2, "p")]


def _pairs(rows, at):
    return sum(all(r[k] == s[k] and r[k] not in (None, "") for k in at) for r in rows for s in rows)


def test_squares_are_pairs_without_blanks(spark):
    df = spark.createDataFrame(ROWS, "a string, b string, c int, d string")
    sets = [frozenset(x) for x in ("a", "ab", "abc", "abcd", "cd", "d")]
    assert measure.squares(df, sets) == {s: _pairs(ROWS, ["abcd".index(c) for c in s]) for s in sets}
    assert measure.squares(df.limit(0), sets) == dict.fromkeys(sets, 0)


def test_mining_is_the_same_from_scratch_and_from_a_state(spark):
    df = spark.createDataFrame(ROWS * 3, "a string, b string, c int, d string")
    key = lambda s: sorted(map(str, s.minimal))
    n = len(ROWS) * 3
    for start, end in (((0.05, 0.9), (0.01, 0.6)), ((0.01, 0.6), (0.1, 0.8)), ((0.01, 0.9), (0.05, 0.5))):
        before = lattice.mine(df, *start, columns=list("abcd"))
        later, fresh = lattice.mine(df, *end, state=before), lattice.mine(df, *end, columns=list("abcd"))
        assert key(later) == key(fresh) and later.counted <= fresh.counted
    found = {(r.lhs, r.rhs): r for r in fresh.minimal}
    for (x, y), r in found.items():
        fx, fxy = (_pairs(ROWS * 3, ["abcd".index(c) for c in s]) for s in (x, (*x, y)))
        assert r.confidence == fxy / fx and r.support == fxy / n**2
        assert not any(z == y and set(w) < set(x) for w, z in found)


def test_rules_parse_and_print():
    text = "orders(t0) ^ orders(t1) ^ t0.a=t1.a ^ t0.b>=3 ^ similar('jaccard', t0.c, t1.c, 0.90) -> t0.d=t1.d"
    assert str(parse_rule(text)) == text
    assert str(parse_predicate("t0.income=>50K").right) == ">50K" and parse_predicate("t0.a!=x").op == "!="
    assert is_connected(parse_rule("t0.a=t1.a -> t0.b=t1.b")) and not is_connected(parse_rule("t0.a=t1.a -> t2.b=t3.b"))
    assert [str(p) for p in ordered(map(parse_predicate, ["t2.a=t3.a", "t0.a=t1.a", "t1.b=t2.b"]))] == ["t0.a=t1.a", "t1.b=t2.b", "t2.a=t3.a"]


def test_histograms_and_relaxation():
    hist = lattice.histogram([0.85, 0.75, 0.65, 0.00001])
    assert hist == [4, 3, 3, 3, 3, 3, 3, 3, 3, 2, 2, 1, 1, 0, 0]
    assert lattice.valid(hist, 0.72) == 2 and lattice.merged(hist, hist)[0] == 8
    assert lattice.relaxed([(0.1, 10), (1.0, 10)], 0.9) == [1] and lattice.relaxed([(0.5, 2)], 1.0) == [0]


def test_tree_rules_hold(spark):
    df = spark.createDataFrame([(float(k), float(k % 7), "lo" if k < 30 else "hi") for k in range(60)], "u double, v double, y string")
    rules = trees.tree_rules(trees.grow(df, ["u", "v"], "y"), "y", 60, 0.01, 0.9)
    assert ("t0.u<29.5 -> t0.y=lo", 0.5, 1.0) in rules and ("t0.u>=29.5 -> t0.y=hi", 0.5, 1.0) in rules


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=6, max_size=20))
def test_kendall_counts_pairs(spark, rows):
    s = sum((a[0] > b[0]) - (a[0] < b[0]) and ((a[0] > b[0]) - (a[0] < b[0])) * ((a[1] > b[1]) - (a[1] < b[1])) for k, a in enumerate(rows) for b in rows[:k])
    n = len(rows) * (len(rows) - 1) / 2
    tx, ty = (sum(c * (c - 1) / 2 for c in Counter(r[k] for r in rows).values()) for k in (0, 1))
    if n in (tx, ty):
        return
    got = corr.kendall(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()[0]
    assert math.isclose(got, s / math.sqrt((n - tx) * (n - ty)), abs_tol=1e-9)


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "v.txt").write_text("1,2.5\n3,4\n")
    assert read_csv(spark, str(tmp_path / "t.csv"), limit=1).count() == 1
    assert sorted(r[0] for r in read_vectors(spark, str(tmp_path / "v.txt")).collect()) == [[1.0, 2.5], [3.0, 4.0]]
    df = spark.createDataFrame(ROWS, "a string, b string, c int, d string")
    assert first_rows(df, "c", share=0.3).count() == 3 and first_rows(df, "c").count() == len(ROWS)
    store, state = Store(spark, str(tmp_path / "store")), lattice.mine(df, 0.01, 0.6, list("abcd"))
    store.save("one", 0.01, 0.6, state)
    store.save("two", 0.02, 0.6, state)
    assert store.latest().first()["task"] == "two" and store.state("one").counts == state.counts
    store.delete(0.02, 0.6)
    assert [r["task"] for r in store.tasks().collect()] == ["one"]


def test_tasks_start_from_stored_ones(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "a string, b string, c int, d string")
    store, key = Store(spark, str(tmp_path / "tasks")), lambda s: sorted(map(str, s.minimal))
    with pytest.raises(ValueError, match="no task"):
        tasks.run_task(df, store, 0.01, 0.9, "latest")
    first, _ = tasks.run_task(df, store, 0.01, 0.9, columns=list("abcd"))
    fresh = key(lattice.mine(df, 0.01, 0.6, list("abcd")))
    for before in (first, (0.01, 0.9), "latest"):
        assert key(tasks.run_task(df, store, 0.01, 0.6, before)[1]) == fresh
        store.delete(0.01, 0.6)
    with pytest.raises(ValueError, match="thresholds"):
        tasks.run_task(df, store, 0.01, 0.9, first)
    with pytest.raises(ValueError, match="no such task"):
        tasks.run_task(df, store, 0.01, 0.6, "other")
    rules = lattice.as_frame(spark, lattice.mine(df, 0.01, 0.6, list("abcd")).minimal)
    assert tasks.without(rules, rules.limit(1)).count() == rules.count() - 1


def test_rules_over_tables_are_those_of_the_wide_table(spark):
    sales = [(k, k % 5, "xyz"[k % 3], "pq"[(k % 5) % 2]) for k in range(30)]
    shops = [(k, "mn"[k % 2], k // 2) for k in range(5)]
    tables = {"sales": spark.createDataFrame(sales, "id int, shop int, kind string, y string"), "shops": spark.createDataFrame(shops, "shop_id int, region string, size int")}
    columns = {"sales": ["kind"], "shops": ["region", "size"]}
    found = {r[0]: r[1:] for r in tasks.table_rules(tables, [("sales", "shop", "shops", "shop_id")], "sales", ["y"], columns, 0.01, 0.6)}
    wide = [(k, kind, y, *shops[s][1:]) for k, s, kind, y in sales]
    at = {"t0.kind=t1.kind": 1, "t2.region=t3.region": 3, "t2.size=t3.size": 4}
    want, ended = {}, []
    for x in ({"t0.kind=t1.kind"}, {"t2.region=t3.region"}, {"t2.size=t3.size"}, {"t0.kind=t1.kind", "t2.region=t3.region"}, {"t0.kind=t1.kind", "t2.size=t3.size"}, {"t2.region=t3.region", "t2.size=t3.size"}):
        if any(d <= x for d in ended):
            continue
        met = [r[2] == s[2] for r in wide for s in wide if all(r[at[p]] == s[at[p]] for p in x)]
        if sum(met) / 900 < 0.01 or sum(met) / len(met) >= 0.6:
            ended.append(x)
        if sum(met) / 900 >= 0.01 and sum(met) / len(met) >= 0.6:
            want[frozenset(x)] = (sum(met) / 900, sum(met) / len(met))
    got = {frozenset(str(p) for p in parse_rule(r).lhs if str(p) in at): v for r, v in found.items()}
    assert got == want and want


def test_trees_of_all_targets_and_of_pairs(spark):
    rows = [(k, float(k % 10), "red" if k % 4 == 0 else "blue", "hi" if k % 4 == 0 else "lo", None if k % 9 == 0 else k % 4 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, u double, colour string, y string, flag boolean")
    rules = tasks.all_tree_rules(df, 0.01, 0.99, ["y"])
    assert any(r[0].endswith("-> t0.y=hi") and "colour" in r[0] for r in rules)
    for text, support, confidence in rules:
        assert 0 < support <= 1 and 0.99 < confidence <= 1 and "->" in text
    pairs = tasks.pair_rows(df.withColumn("g", F.col("id") % 3), "id", ["g"], "y", ["colour", "flag"], per_row=2)
    got = pairs.collect()
    by = {r[0]: r for r in rows}
    assert len(got) == sum(2 * n - 3 for n in Counter(k % 3 for k in range(200)).values())
    for r in got:
        a, b = by[r["key_0"]], by[r["key_1"]]
        assert a[0] % 3 == b[0] % 3 and a[0] != b[0]
        assert (r["colour="], r["flag="], r["y"]) == (float(a[2] == b[2]), float(None not in (a[4], b[4]) and a[4] == b[4]), str(int(a[3] == b[3])))
    found = tasks.pair_tree_rules(df.withColumn("g", F.col("id") % 3), "id", ["g"], "y", ["colour"], 0.01, 0.99)
    assert [(r, c) for r, _, c in found] == [("t0.g=t1.g ^ t0.colour=t1.colour -> t0.y=t1.y", 1.0)]
    assert {(r["side"], r["weight"]) for r in tasks.weighted(spark.createDataFrame([(None,), (None,)], "v double"), "v", 1.0).collect()} == {("L", 0.5), ("R", 0.5)}
    assert tasks.sample_support(0.01, 0.5) == 0.04
    assert [tuple(r) for r in tasks.schema_info(spark, {"t": df.select("id", "y")}).collect()] == [("t", "id", 0, "bigint"), ("t", "y", 1, "string")]


def test_gini_and_predicate_support_of_edges(spark):
    df = spark.createDataFrame([], "a string, b int")
    assert stats.predicate_support(df, ["a", "b"]).collect() == []
    one = stats.gini_index(spark.createDataFrame([(1,), (2,)], "v int"), F.col("v") == 1, F.col("v") == 1).first()
    assert (one["xy"], one["nxny"], one["gini"]) == (1, 1, 0.0)


def test_greedy_clusters(spark):
    from rulesmith.operators import blocking

    rows = [(1, "apple, apple, 1", 0), (2, "orange, orange, 1", 0), (3, "apple, apple, 2", 0), (4, "", 0), (5, "orange, orange, 2", 0), (6, "apple, apple, 1", 1), (7, None, 1)]
    df = spark.createDataFrame(rows, "id long, t string, b int")
    assert dict(map(tuple, blocking.greedy_clusters(df, "id", "t", "b", 0.5).collect())) == {1: 1, 2: 2, 3: 1, 4: -2, 5: 2, 6: 6, 7: -2}
    blank = spark.createDataFrame([(None, None), ("a", None)], "x string, y string")
    assert sorted(r["sentence"] for r in blocking.row_sentence(blank, ["x", "y"]).collect()) == ["", "a#"]


def test_entry_stands_without_the_text_operators():
    import subprocess
    import sys

    from conftest import REPO

    code = "import sys; sys.modules['rulesmith.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'xsupp' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_samples(spark):
    node = "lhs array<string>, rhs string, added string, candidates array<string>"
    first = spark.createDataFrame([(["a"], "y", "a", ["b", "c"]), (["b"], "y", "b", ["c"]), (["c"], "y", "c", []), (["a"], "z", "a", ["b", "c"])], node)
    assert all(r["predecessors"] == [""] for r in samples.created(first).collect())
    second = spark.createDataFrame([(["a", "b"], "y", "b", ["c"]), (["a", "c"], "y", "c", []), (["b", "c"], "z", "c", [])], node)
    made = {(tuple(r["lhs"]), r["rhs"]): r["predecessors"] for r in samples.created(second, first, 3).collect()}
    assert made[("a", "b"), "y"] == ["a"]  # only a had b as a candidate
    assert made[("a", "c"), "y"] == ["a", "b"] and made[("b", "c"), "z"] == ["b", "a"]
    assert samples.created(second, first, 1).where("size(predecessors) <> 1").count() == 0
    hit = {(tuple(r["lhs"]), r["rhs"]): r["covered"] for r in samples.covered(second, first).collect()}
    assert hit == {(("a", "b"), "y"): True, (("a", "c"), "y"): True, (("b", "c"), "z"): False}
    kind = "lhs array<string>, rhs string, candidates array<string>, predecessors array<string>, max_conf double, cdf array<long>"
    a = spark.createDataFrame([(["a"], "y", ["b"], ["p", "q"], 0.4, [3, 1]), (["b"], "y", ["c"], ["p"], 0.2, [1, 0]), (["d"], "y", [], ["p"], 0.1, [1, 1])], kind)
    b = spark.createDataFrame([(["a"], "y", ["c"], ["q", "r"], 0.7, [1, 1]), (["b"], "y", ["c"], ["x"], 0.1, [2, 0]), (["d"], "y", [], ["p"], 0.3, [0, 0]), (["e"], "y", ["a"], ["s"], 0.9, [5, 5])], kind)
    got = {r["lhs"][0]: (r["candidates"], r["predecessors"], r["max_conf"], r["cdf"], r["overlap"]) for r in samples.merged(a, b).collect()}
    assert got == {"a": (["b", "c"], ["p", "q", "r"], 0.7, [4, 2], "part"), "b": (["c"], ["p", "x"], 0.2, [3, 0], "none"), "d": ([], ["p"], 0.3, [1, 1], "all"), "e": (["a"], ["s"], 0.9, [5, 5], None)}
    assert [tuple(r) for r in samples.neighbours(a, 0.2).orderBy("lhs").collect()] == [(["a", "b"], "y"), (["b", "c"], "y")]


def test_rules_that_cannot_be_counted(spark):
    df = spark.createDataFrame(ROWS, "a string, b string, c int, d string")
    with pytest.raises(ValueError, match="no model"):
        measure.evaluate(parse_rule("r(t0) ^ r(t1) ^ ML('other', t0.a, t1.a) -> t0.b=t1.b"), {"r": df})
    found = measure.evaluate(parse_rule("r(t0) ^ r(t1) ^ t0.a=t1.a -> t0.d=t1.d"), {"r": df}).first()
    assert (found["row_size"], found["xsupp"], found["xysupp"]) == (len(ROWS) ** 2, _pairs(ROWS, [0]), _pairs(ROWS, [0, 3]))
    assert measure.evaluate(parse_rule("r(t0) ^ r(t1) ^ t0.c<t1.c -> t0.d=t1.d"), {"r": df.limit(0)}).first()["row_size"] == 0


def test_trees_weigh_gaps_and_see_every_value(spark):
    # One value far out: intervals of equal width would hold all others in one.
    rows = [(float(k), None if k % 5 == 4 else float(k % 3), "u" if k < 37 else "v") for k in range(100)] + [(1e9, 1.0, "v")]
    leaves = trees.grow(spark.createDataFrame(rows, "x double, z double, y string"), ["x", "z"], "y", max_depth=1)
    assert sorted((c, op, v) for leaf in leaves for c, op, v in leaf.cuts) == [("x", "<", 36.5), ("x", ">=", 36.5)]
    gaps = [(None if k % 4 == 0 else float(k % 2), "u" if k % 2 else "v") for k in range(80)]
    leaves = trees.grow(spark.createDataFrame(gaps, "x double, y string"), ["x"], "y", max_depth=1)
    assert abs(sum(leaf.weight for leaf in leaves) - 80) < 1e-6 and all(leaf.weight == sum(leaf.counts.values()) for leaf in leaves)
    best = trees.grow(spark.createDataFrame(rows, "x double, z double, y string"), ["x", "z"], "y", max_depth=5, max_leaves=2)
    assert len(best) == 2


def test_candidates_and_sides(spark):
    near, far = parse_predicate("t0.a=t1.a"), parse_predicate("t2.b=t3.b")
    assert lattice.related([near, far], [parse_predicate("t0.c=t1.c")]) == ([near], [far])
    assert lattice.related([near, far], []) == ([near, far], [])
    assert lattice.without_keys(["a", "b", "k"], "t", [("t", "k", "u", "id"), ("u", "b", "v", "id")]) == ["a", "b"]
    rows = spark.createDataFrame([("b ^ a -> c",), ("x->y",), (None,)], "ree string")
    assert sorted(lattice.sides(rows.na.drop()).collect()) == [("b ^ a -> c", "a,b", "c"), ("x->y", "x", "y")]
    one, two = (spark.createDataFrame([(x,) for x in texts], "ree string") for texts in (["a -> c", "b -> c"], ["b ^ a -> c", "b ^ a -> c", "d -> c"]))
    assert sorted(map(tuple, lattice.coverage_both(one, two).collect())) == [("a", 2, 0), ("b", 2, 1)]


def test_training_rows(spark):
    t = spark.createDataFrame([(1, "x", 5.0), (2, "", 6.0), (3, None, 7.0), (4, "y", None)], "id int, k string, v double")
    u = spark.createDataFrame([("x", 1), ("", 2), (None, 3), ("x", 4)], "k string, w int")
    made = tasks.connected_rows({"t": t, "u": u}, [("t", "k", "u", "k")], "t", {"t": ["id"], "u": ["w"]})
    assert made.columns == ["t__id", "u__w"] and sorted(map(tuple, made.collect())) == [(1, 1), (1, 4)]
    assert [r["z"] for r in tasks.with_expressions(t, {"z": "v * 2"}).orderBy("id").collect()] == [10.0, 12.0, 14.0, None]
    size = lambda **options: tasks.training_sample(t, "id", **options).count()
    assert (size(), size(most=3), size(shares={2: 0.5, 100: 0.1}), size(shares={100: 0.1})) == (4, 3, 2, 4)
    many = spark.range(4000).withColumnRenamed("id", "k")
    some = {r[0] for r in tasks.seeded_sample(many, "k", 0.25, 3).collect()}
    assert some == {r[0] for r in tasks.seeded_sample(many.repartition(7), "k", 0.25, 3).collect()} and 850 < len(some) < 1150
    assert tasks.seeded_sample(t, "k", 1.0, 3).count() == 3 and tasks.seeded_sample(t, "k", 0.0, 3).count() == 0


def test_times(spark):
    rows = spark.createDataFrame([("1970-01-02",), ("1999-12-31T23:59:59.250",), ("1969-12-31",), ("no day",), ("",), (None,)], "s string")
    got = [r[0] for r in rows.select(millis(parsed(F.col("s")))).collect()]
    assert got == [86_400_000, 946_684_799_250, -86_400_000, None, None, None]


def test_gini_best_is_gini_index(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", True), ("c", False), (None, True), ("", False)], "x string, y boolean").where("x <> ''")
    best = {r["value"]: r["gini"] for r in stats.gini_best(df, "x", F.col("y"), 9).collect()}
    assert best == {v: pytest.approx(stats.gini_index(df, F.col("x") == v, F.col("y")).first()["gini"], abs=1e-9) for v in "abc"}


def _compares_all(df):
    """Whether a join of the plan compares all pairs of rows."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return "NestedLoopJoin" in plan or "CartesianProduct" in plan


@pytest.mark.parametrize("name", ["fk_join_rule_2t", "fk_join_rule_3t", "fk_only_rule", "rule_rows"])
def test_equalities_are_keys_of_joins(spark, name):
    assert not _compares_all(catalogue.QUERIES[name](spark, SF))


def test_candidates_of_table_rules_join_by_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(tasks, "evaluate", lambda rule, tables: seen.append(measure.evaluate(rule, tables)) or seen[-1])
    assert catalogue.QUERIES["table_rules"](spark, SF).count() and len(seen) > 5
    assert not any(map(_compares_all, seen))


@pytest.mark.parametrize("name", ["blocking_ids", "prefix_tokens"])
def test_tokens_are_not_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan  # the order of the tokens is on the right


def test_rows_without_placed_tokens_are_left(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (5, None), (6, "d"), (7, "d"), (8, "d"), (9, "d"), (10, "d")], "key int, token string")
    assert {r["key"]: r["ids"] for r in blocking.derived(tokens).collect()} == {1: [1, 0, 1], 2: [0, 0], 4: [1, 1]} | {k: [2, 2] for k in range(6, 11)}
    assert {r["key"]: r["ids"] for r in blocking.prefix_tokens(tokens, 0.5).collect()} == {1: [0], 2: [0], 4: [1]} | {k: [2] for k in range(6, 11)}


def test_ranges_are_not_compared_one_by_one(spark):
    rows = [(k % 2, float("nan") if k == 7 else (k * 7) % 5 / 2, (k * 11) % 6, (k * 5) % 4) for k in range(40)]
    a = spark.createDataFrame([(*r, 1 + k % 3) for k, r in enumerate(rows)], "k0 int, k1 double, k2 int, k3 int, c long")
    b = spark.createDataFrame([(r[0], r[2], r[3], r[1], 2) for r in rows[:25]], "k0 int, k1 int, k2 long, k3 double, c long")
    xs, ys = a.collect(), b.collect()
    at = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)  # noqa: E731  NaN is the greatest
    for signs in (["=", "<", "<="], [None, ">", ">="], ["!=", "<=", ">"], ["=", ">=", "<", "<="]):
        tests = {k: parse_predicate(f"t0.a{op}t1.b") for k, op in enumerate(signs) if op}
        made = measure._pairs(a, b, tests, {})
        want = sum(x["c"] * y["c"] for x in xs for y in ys if all(measure.SIGNS[p.op](at(x[f"k{k}"]), at(y[f"k{k}"])) for k, p in tests.items()))
        assert not ("!=" not in signs and _compares_all(made)) and made.first()["v"] == want > 0
    assert measure._pairs(a.limit(0), b, tests, {}).first()["v"] == 0


@pytest.mark.parametrize("text", ["t0.k=t1.k ^ t0.a>t1.b -> t0.a!=t1.b", "t0.k=t1.k ^ t0.a<=t1.a ^ t0.a!=t0.b ^ t1.b>=3 -> t1.a=t1.b", "t0.k=t1.k ^ t0.k=t0.s ^ t1.a<t0.b -> t0.b>=2", "t0.k=t1.k -> t0.a<t1.b"])
def test_rows_of_large_joins_are_counted_not_made(spark, monkeypatch, text):
    rows = [("xyz"[k % 3] if k % 7 else ("" if k % 2 else None), "xyz"[k % 4 % 3], None if k % 5 == 4 else k % 6, k % 9 - 2) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, s string, a int, b long")
    rule = parse_rule(f"u(t0) ^ v(t1) ^ {text}")
    run = lambda: measure.evaluate(rule, {"u": df, "v": df.limit(45)}, foreign=(("u", "k", "v", "k"),)).first()
    joined, wide = [], measure._wide
    monkeypatch.setattr(measure, "_wide", lambda own, tids, *rest: joined.append(len(tids)) or wide(own, tids, *rest))
    monkeypatch.setattr(measure, "GROWS", 0, raising=False)
    counted = run()
    assert set(joined[-2:]) == {1}
    monkeypatch.setattr(measure, "GROWS", 1000, raising=False)
    assert run() == counted and counted["row_size"]


def test_measures_of_columns_take_all_rows(spark):
    import numpy as np
    import pandas as pd

    k = np.arange(6000)
    made = pd.DataFrame({"u": (k * 7919 % 6000).astype(float), "v": (k * 31 % 40) / 4, "w": np.where(k % 2, np.nan, k % 11), "one": 1.0, "s": [f"{x:02}" for x in (k * k // 700 + k % 3) % 23], "t": (k % 977) * 1.5})
    made.loc[5999, "u"] = 1e9
    df = spark.createDataFrame(made).withColumn("w", F.nanvl("w", F.lit(None).cast("double")))
    names = ["u", "v", "w", "one"]
    for label in ("s", "t"):
        y = made[label].rank(method="dense")
        y = made[label] if label == "t" else y
        got = {r["col"]: r[1:] for r in corr.combined(df, names, label).collect()}
        assert list(got) == names and got["one"] == (0.0, 0.0, 0.0) and got["w"][2] == 0.0
        for c in names[:3]:
            fine = made[c].notna()
            a, b = made[c][fine], y[fine]
            want = [abs(a.corr(b)), abs(a.rank().corr(b.rank())), abs(corr._tau(a.to_numpy(), b.to_numpy())) if c != "w" else 0.0]
            assert got[c] == pytest.approx(want, abs=1e-12)
    assert corr.combined(df.limit(4), names, "s").collect()[0][1:] == corr.combined(df.limit(0), names, "t").collect()[0][1:] == (0.0, 0.0, 0.0)
    assert corr.spearman(df, "one", "u").first()["r"] is None


def test_choice_of_columns_takes_all_rows(spark):
    import numpy as np
    import pandas as pd

    made = pd.DataFrame(np.random.default_rng(5).integers(0, 500, (6000, 13)).astype(float), columns=[*"abcdefghijkl", "y"])
    best = {max("abcdefghijkl", key=lambda c: abs(f(made[c], made["y"]))) for f in (lambda a, b: a.corr(b), lambda a, b: a.rank().corr(b.rank()), lambda a, b: corr._tau(a.to_numpy(), b.to_numpy()))}
    got = corr.chosen_columns(corr.combined(spark.createDataFrame(made), list("abcdefghijkl"), "y"), 1)
    assert {r["col"] for r in got.collect()} == best


def test_order_of_columns_takes_all_rows(spark):
    large = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{large}/part.parquet'")
    want = dict(con.execute(f"SELECT col, place FROM ({catalogue.ORACLE_SQL['sorted_columns']}) q").fetchall())
    assert dict(map(tuple, catalogue.QUERIES["sorted_columns"](spark, large).collect())) == want
