"""Mining tasks: one entry point that starts from nothing, from a stored task or from the latest one, and keeps the result.

Also what a task needs around the miner: exclusion of given rules, predicates and edges between tables, rules over two
or three tables grown along their edges, tree rules of every fit target, and tree rules for pairs that a rule's premises
hold for but whose confidence is too low.
"""

from __future__ import annotations

from itertools import combinations
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulesmith.functions.predicates import Predicate, Ref, Rule, not_blank
from rulesmith.operators import corr, stats
from rulesmith.operators.measure import evaluate
from rulesmith.plans import lattice, trees
from rulesmith.sources.store import Store, first_rows

#: Values of a column that become one-hot columns of training rows, at most; the most frequent ones.
HOT_VALUES = 50
MAX_TABLES = 3


def run_task(df: DataFrame, store: Store, support: float, confidence: float, before: str | tuple[float, float] | None = None, columns: list[str] | None = None, targets: list[str] | None = None, max_level: int = lattice.MAX_LEVEL) -> tuple[str, lattice.State]:
    """(task, state) of a run that is saved as a new task.

    before: None for a run from scratch; a task's name; its thresholds; or "latest". A run with the thresholds of the task it
    starts from has nothing to do and raises ValueError, as does a task that isn't there.
    """
    state = None
    if before is not None:
        tasks = store.tasks() if store.exists() else None
        if tasks is None:
            raise ValueError("no task is stored")
        if isinstance(before, tuple):
            tasks = tasks.where((F.col("support") == before[0]) & (F.col("confidence") == before[1]))
        elif before != "latest":
            tasks = tasks.where(F.col("task") == before)
        row = tasks.orderBy(F.desc("at")).first()
        if row is None:
            raise ValueError(f"no such task: {before}")
        if (row["support"], row["confidence"]) == (support, confidence):
            raise ValueError("thresholds are those of the task before")
        state = store.state(row["task"])
    made = lattice.mine(df, support, confidence, columns, targets, max_level, state)
    name = uuid4().hex
    store.save(name, support, confidence, made)
    return name, made


def without(rules: DataFrame, abandoned: DataFrame) -> DataFrame:
    """rules without those whose text (ree) is listed."""
    return rules.join(abandoned.select("ree").distinct(), "ree", "left_anti")


# --- several tables ---


def path_of(tables, edges: list[tuple[str, str, str, str]], base: str, most: int = MAX_TABLES) -> tuple[dict[str, int], list[tuple[str, str, str, str]]]:
    """(place of each table that edges reach from base, the joins on the way): `most` tables at most, nearer ones first."""
    path, joins = {base: 0}, []
    for _ in range(most - 1):
        for a, ca, b, cb in edges:
            for near, cn, far, cf in ((a, ca, b, cb), (b, cb, a, ca)):
                if near in path and far not in path and far in tables and len(path) < most:
                    path[far] = len(path)
                    joins.append((near, cn, far, cf))
    return path, joins


def table_rules(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]], base: str, targets: list[str], columns: dict[str, list[str]], support: float, confidence: float, max_premises: int = 2) -> list[tuple[str, float, float]]:
    """(rule, support, confidence) of minimal rules over base joined with its neighbours along edges.

    edges: (table, column, table, column), each at most once; paths from base hold MAX_TABLES tables at most. Every
    side of a rule is one wide table, so each candidate is counted by evaluate(). Premises are added one by one; a
    candidate under the support, or one that is a rule, isn't grown. Columns that edges join by are no right sides.
    """
    path, joins = path_of(tables, edges, base)
    atoms = [(t, 2 * k + side) for t, k in path.items() for side in (0, 1)]
    fixed = [Predicate(Ref(2 * path[n] + side, cn), "=", Ref(2 * path[f] + side, cf)) for n, cn, f, cf in joins for side in (0, 1)]
    keyed = {(n, c) for n, cn, f, cf in joins for n, c in ((n, cn), (f, cf))}
    same = lambda t, c: Predicate(Ref(2 * path[t], c), "=", Ref(2 * path[t] + 1, c))
    premises = sorted((same(t, c) for t in path for c in columns.get(t, []) if (t, c) not in keyed), key=str)
    out: list[tuple[str, float, float]] = []
    for y in lattice.without_keys(targets, base, edges):
        rhs, done = same(base, y), []
        for size in range(1, max_premises + 1):
            for lhs in combinations([p for p in premises if p != rhs], size):
                if any(d <= set(lhs) for d in done):
                    continue
                # Only the tables that a premise names, and those on the way to them, are joined.
                need = {0} | {p.left.tid // 2 for p in lhs}
                for n, _, f, _ in reversed(joins):
                    if path[f] in need:
                        need.add(path[n])
                own = tuple(p for p in fixed if p.left.tid // 2 in need and p.right.tid // 2 in need)
                rule = Rule((*own, *lhs), rhs, tuple(a for a in atoms if a[1] // 2 in need))
                found = evaluate(rule, tables).first()
                if found["support"] < support:
                    done.append(set(lhs))
                elif found["confidence"] >= confidence:
                    done.append(set(lhs))
                    out.append((str(rule), found["support"], found["confidence"]))
    return out


# --- trees ---


def training_rows(df: DataFrame, label: str, top: int = 20) -> tuple[DataFrame, list[str]]:
    """Rows of numbers and one-hot columns `c=v`, and these columns: the numeric ones among the top by any of three correlations.

    Strings and booleans with fewer than HOT_VALUES values become one-hot columns; longer texts are left.
    """
    kinds = dict(df.dtypes)
    numbers = [c for c in stats.minable(df) if c != label and kinds[c] not in ("string", "boolean")]
    enums = [r["col"] for r in stats.y_candidates(df, HOT_VALUES).collect() if r["col"] != label]
    values: dict[str, list[str]] = {c: [] for c in enums}
    if enums:  # fewer than HOT_VALUES values of each column
        for r in stats.value_counts(df, enums).orderBy("col", "val").collect():
            values[r["col"]].append(r["val"])
    if len(numbers) > top:
        best = {r["col"] for r in corr.chosen_columns(corr.combined(df, numbers, label, corr.SAMPLE_ROWS), top).collect()}
        numbers = [c for c in numbers if c in best]
    hot = {f"{c}={v}": F.coalesce((F.col(f"`{c}`").cast("string") == v).cast("double"), F.lit(0.0)) for c, vs in values.items() for v in vs}
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numbers], *[x.alias(c) for c, x in hot.items()], F.col(f"`{label}`").cast("string").alias(label))
    return rows, [*numbers, *hot]


def connected_rows(tables: dict[str, DataFrame], edges: list[tuple[str, str, str, str]], base: str, columns: dict[str, list[str]], most: int = MAX_TABLES) -> DataFrame:
    """Rows of base joined with the tables that edges reach, for training: the columns asked for, as `table__column`. Blank keys join nothing."""
    path, joins = path_of(tables, edges, base, most)
    used = {t: {*columns.get(t, [])} | {c for a, ca, b, cb in joins for n, c in ((a, ca), (b, cb)) if n == t} for t in path}
    named = {t: tables[t].select(*[F.col(f"`{c}`").alias(f"{t}__{c}") for c in sorted(used[t])]) for t in path}
    out = named[base]
    for near, cn, far, cf in joins:
        left, right = F.col(f"`{near}__{cn}`"), F.col(f"`{far}__{cf}`")
        out = out.join(named[far], (left == right) & not_blank(left) & not_blank(right))
    return out.select(*[F.col(f"`{t}__{c}`") for t in path for c in columns.get(t, [])])


def with_expressions(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """df with arithmetic expressions of its columns as further numbers to learn from."""
    return df.select("*", *[F.expr(x).cast("double").alias(c) for c, x in expressions.items()])


def training_sample(df: DataFrame, key: str, most: int = -1, shares: dict[int, float] | None = None) -> DataFrame:
    """Rows that a tree learns from: the first `most` by key (-1: all); with shares (least number of rows: share), the share that the
    largest number reached by the table gives, and all rows of a table that reaches none."""
    if not shares:
        return first_rows(df, key, most)
    n = df.count()
    return first_rows(df, key, share=next((shares[k] for k in sorted(shares, reverse=True) if n >= k), 1.0))


def seeded_sample(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A share of the rows, about, chosen by a hash of seed and key: the same rows in every run and on every partitioning; no shuffle."""
    drawn = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8)
    return df.where((F.conv(drawn, 16, 10).cast("long") < int(share * (1 << 32))) & F.col(key).isNotNull())


def all_tree_rules(df: DataFrame, support: float, confidence: float, targets: list[str] | None = None) -> list[tuple[str, float, float]]:
    """Tree rules for every target that fits: booleans, and strings of few values."""
    out = []
    for y in targets if targets is not None else sorted(r["col"] for r in stats.y_candidates(df).collect()):
        rows, features = training_rows(df, y)
        safe = {c: f"x{k}" for k, c in enumerate(features)}  # names of one-hot columns may hold any sign
        named = rows.select(*[F.col(f"`{c.replace('`', '``')}`").alias(s) for c, s in safe.items()], F.col(f"`{y}`").alias("__label"))
        leaves = trees.grow(named, list(safe.values()), "__label", least_share=confidence)
        back = {s: c for c, s in safe.items()}
        for leaf in leaves:
            leaf.cuts = [(back[c], op, v) for c, op, v in leaf.cuts]
        out += trees.tree_rules(leaves, y, rows.where(F.col(f"`{y}`").isNotNull()).count(), support, confidence)
    return out


def pair_rows(df: DataFrame, key: str, lhs: list[str], rhs: str, others: list[str], per_row: int = 4, span: int = 10_000) -> DataFrame:
    """Training rows of pairs that agree on lhs: (key_0, key_1, `c=` for each of others, y: '1' if they agree on rhs).

    A sample by definition: each row meets its next per_row rows of its group in a hashed order, so that pairs grow with the
    rows, not with the square of a group. A group is cut into spans of about `span` rows, so that no task holds a large one.
    """
    rows = df.select(key, *{*lhs, rhs, *others} - {key})
    for c in lhs:
        rows = rows.where(not_blank(F.col(c)))
    held = rows.groupBy(*lhs).agg(F.ceil(F.count("*") / span).cast("long").alias("__spans"), F.count("*").alias("__n")).where("__n > 1")
    cut = rows.join(held, lhs).withColumn("__h", F.xxhash64(key)).withColumn("__span", F.pmod("__h", F.col("__spans")))
    own = [F.col(key).alias("k"), *[F.when(not_blank(F.col(c)), F.col(c)).alias(f"c{k}") for k, c in enumerate([*others, rhs])]]
    after = Window.partitionBy(*lhs, "__span").orderBy("__h", key).rowsBetween(1, per_row)
    near = cut.select(F.struct(*own).alias("l"), F.collect_list(F.struct(*own)).over(after).alias("rs"))
    agree = lambda r, k: F.coalesce(F.col(f"l.c{k}") == r[f"c{k}"], F.lit(False)).cast("int")
    pair = lambda r: F.struct(F.col("l.k").alias("key_0"), r["k"].alias("key_1"), *[agree(r, k).cast("double").alias(f"{c}=") for k, c in enumerate(others)], agree(r, len(others)).cast("string").alias("y"))
    return near.select(F.inline(F.transform("rs", pair)))


def pair_tree_rules(df: DataFrame, key: str, lhs: list[str], rhs: str, others: list[str], support: float, confidence: float) -> list[tuple[str, float, float]]:
    """(rule, support, confidence) among the pairs of pair_rows, whose premises add agreement or difference on others to lhs."""
    pairs = pair_rows(df, key, lhs, rhs, others)
    names = {f"x{k}": c for k, c in enumerate(others)}
    leaves = trees.grow(pairs.select(*[F.col(f"`{c}=`").alias(x) for x, c in names.items()], "y"), list(names), "y")
    total, out = sum(leaf.weight for leaf in leaves), []
    for leaf in leaves:
        n, yes = leaf.weight, leaf.counts.get("1", 0)
        if leaf.cuts and n and yes / total > support and yes / n > confidence:
            said = [f"t0.{names[x]}{'!=' if op == '<' else '='}t1.{names[x]}" for x, op, _ in trees.simplified(leaf.cuts)]
            out.append((" ^ ".join([*(f"t0.{c}=t1.{c}" for c in lhs), *said]) + f" -> t0.{rhs}=t1.{rhs}", yes / total, yes / n))
    return out


def weighted(df: DataFrame, column: str, cut: float) -> DataFrame:
    """df twice where column has no number: (side, weight) by the share of each side among the numbers, half each without any."""
    numbers = df.where(F.col(column).isNotNull()).agg(F.avg((F.col(column) < cut).cast("double"))).first()[0]
    left = 0.5 if numbers is None else numbers
    side: Column = F.when(F.col(column).isNull(), F.array(F.struct(F.lit("L").alias("side"), F.lit(left).alias("weight")), F.struct(F.lit("R").alias("side"), F.lit(1 - left).alias("weight")))).otherwise(F.array(F.struct(F.when(F.col(column) < cut, "L").otherwise("R").alias("side"), F.lit(1.0).alias("weight"))))
    return df.select("*", F.inline(side))


def sample_support(support: float, share: float) -> float:
    """The support to ask of a sample of that share of the rows: pairs shrink with its square."""
    return support / share**2


def schema_info(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, column, place, type) of all tables."""
    rows = [(t, c, k, kind) for t, df in sorted(tables.items()) for k, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "name string, column string, place int, type string")
