"""Rule measures by grouped counts: pairs are never made, only the squares of group sizes are summed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesmith.functions.predicates import Predicate, Ref, Rule, connected, constant_filter, not_blank
from rulesmith.operators.blocking import jaccard_pairs
from rulesmith.operators.order import bounds, bucket, running

#: Column sets of one GROUPING SETS job; each row is expanded so many times before partial aggregation.
BATCH = 48


def squares(df: DataFrame, sets: Iterable[frozenset[str]]) -> dict[frozenset[str], int]:
    """Sum of squared group sizes of each column set: the pairs of rows that agree on it. Blanks agree with nothing."""
    sets = sorted(set(sets), key=sorted)
    out: dict[frozenset[str], int] = {}
    for at in range(0, len(sets), BATCH):
        part = sets[at : at + BATCH]
        columns = sorted(set().union(*part))
        own = df.select(*[F.when(not_blank(F.col(c)), F.col(c)).alias(c) for c in columns])
        grouped = own.groupingSets([[F.col(c) for c in sorted(s)] for s in part], *[F.col(c) for c in columns]).agg(F.count("*").alias("__c"), F.grouping_id(*columns).alias("__gid"), *[F.grouping(c).alias(f"__g_{c}") for c in columns])
        for c in columns:
            grouped = grouped.where((F.col(f"__g_{c}") == 1) | F.col(c).isNotNull())
        total = F.sum(F.col("__c").cast("decimal(38,0)") * F.col("__c"))
        found = {r["__gid"]: int(r["f"]) for r in grouped.groupBy("__gid").agg(total.alias("f")).collect()}  # one number for each set
        for s in part:
            gid = sum((c not in s) << (len(columns) - 1 - k) for k, c in enumerate(columns))
            out[s] = found.get(gid, 0)
    return out


def _squared(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)") * F.col(c)


def pair_counts(df: DataFrame, lhs: list[str], rhs: str, where: Column | None = None) -> DataFrame:
    """One row: n, xsupp, xysupp, support, confidence of lhs -> rhs over pairs of rows of one table.

    Counts that a long can't hold raise an error rather than wrap.
    """
    rows = df if where is None else df.where(where)
    ok = rows
    for c in lhs:
        ok = ok.where(not_blank(F.col(c)))
    fine = ok.groupBy(*lhs, rhs).agg(F.count("*").alias("__c"))
    by_x = fine.groupBy(*lhs).agg(F.sum("__c").alias("__cx"), F.sum(F.when(not_blank(F.col(rhs)), _squared("__c")).otherwise(0)).alias("__cxy"))
    sums = by_x.agg(F.coalesce(F.sum(_squared("__cx")), F.lit(0)).cast("long").alias("xsupp"), F.coalesce(F.sum("__cxy"), F.lit(0)).cast("long").alias("xysupp"))
    return sums.crossJoin(rows.agg(F.count("*").alias("n"))).select("n", "xsupp", "xysupp", ratio("xysupp", F.col("n").cast("double") * F.col("n")).alias("support"), ratio("xysupp", F.col("xsupp")).alias("confidence"))


def ratio(top: str, bottom: Column) -> Column:
    return F.when(bottom > 0, F.col(top) / F.when(bottom > 0, bottom)).otherwise(0.0)


def violations(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """(lhs, pairs): pairs of rows that agree on lhs and differ on rhs, by group, from counts alone. Blanks neither agree nor differ."""
    for c in [*lhs, rhs]:
        df = df.where(not_blank(F.col(c)))
    fine = df.groupBy(*lhs, rhs).agg(F.count("*").alias("__c"))
    return fine.groupBy(*lhs).agg(F.sum("__c").alias("__n"), F.sum(_squared("__c")).alias("__same")).select(*lhs, (_squared("__n") - F.col("__same")).cast("long").alias("pairs")).where("pairs > 0")


def layer(df: DataFrame, columns: list[str], size: int) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(lhs, rhs, xsupp, xysupp) of every rule with size premises; each column set is counted once."""
    xs = [frozenset(x) for x in combinations(sorted(columns), size)]
    f = squares(df, [*xs, *(x | {y} for x in xs for y in columns if y not in x)])
    return [(tuple(sorted(x)), y, f[x], f[x | {y}]) for x in xs for y in sorted(columns) if y not in x]


# --- several tables ---

SIGNS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Pairs of values (a, b) that a model takes for the same: (values of the left side in a, of the right side in b, threshold) -> (a, b).
Model = Callable[[DataFrame, DataFrame, float], DataFrame]


def jaccard_model(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Values whose 3-grams have a Jaccard similarity of at least threshold."""
    text = lambda df, c: df.select(F.col(c).cast("string").alias("v")).where(not_blank(F.col("v"))).distinct()
    every = text(left, "a").unionByName(text(right, "b")).distinct()
    pairs = jaccard_pairs(every, "v", "v", threshold).select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(every.select(F.col("v").alias("a"), F.col("v").alias("b")))
    return both.join(text(left, "a").withColumnRenamed("v", "a"), "a", "left_semi").join(text(right, "b").withColumnRenamed("v", "b"), "b", "left_semi")


#: Models by name; a user adds models of their own.
MODELS: dict[str, Model] = {"jaccard": jaccard_model}


def _model(p: Predicate, models: dict[str, Model]) -> Model:
    if p.model not in models:
        raise ValueError(f"no model {p.model!r} for {p}")
    return models[p.model]


def _name(r: Ref) -> str:
    return f"t{r.tid}__{r.column}"


def meets(p: Predicate) -> Column:
    """holds() as a condition of a join or filter, where null is no: bare, so that an equality is a key of the join."""
    a, b = F.col(_name(p.left)), F.col(_name(p.right))
    return not_blank(a) & not_blank(b) & SIGNS[p.op](a, b)


def holds(p: Predicate) -> Column:
    """A comparison of two columns of one wide row; a blank compares with nothing."""
    return F.coalesce(meets(p), F.lit(False))


def _wide(tables: dict[int, DataFrame], tids: list[int], joins: list[Predicate], consts: list[Predicate], used: set[Ref]) -> DataFrame:
    """Inner join of the variables of one side; of each only the columns that are used, as t{tid}__{column}. Blanks join with nothing."""
    used = used | {r for p in joins for r in (p.left, p.right)} | {p.left for p in consts}

    def named(t: int) -> DataFrame:
        df, kinds = tables[t], dict(tables[t].dtypes)
        for p in consts:
            if p.left.tid == t:
                df = df.where(constant_filter(F.col(p.left.column), kinds[p.left.column], p.op, str(p.right)))
        return df.select(*[F.col(r.column).alias(_name(r)) for r in sorted(used, key=str) if r.tid == t])

    out, bound, left = named(tids[0]), {tids[0]}, list(joins)
    while True:
        for p in [p for p in left if p.tids <= bound]:
            out = out.where(holds(p))
            left.remove(p)
        if len(bound) == len(tids):
            return out
        t = next(t for t in tids if t not in bound and any(p.tids <= bound | {t} and t in p.tids for p in left))
        on = [p for p in left if t in p.tids and p.tids <= bound | {t}]
        out = out.join(named(t), reduce(lambda c, p: c & meets(p), on[1:], meets(on[0])))
        left = [p for p in left if p not in on]
        bound.add(t)


def _halves(a: DataFrame, b: DataFrame, c: str, op: str) -> tuple[DataFrame, DataFrame]:
    """a and b with rows repeated and c replaced, so that c of a pair of rows is equal once if `a.c op b.c` held, and else never.

    The distinct values are numbered. Of two numbers the less has a 0 and the other a 1 at one bit above which both agree, so
    the less is repeated for each of its bits 0, the other for each of its bits 1: a row for half the bits on average.
    Buckets __cuts of another column are joined two by two for each bit less, as there are fewer rows in a half.
    """
    values = a.select(c).unionByName(b.select(c)).distinct()
    numbers = running(values.withColumn("__one", F.lit(1).cast("long")), c, ["__one"]).select(c, F.col("before___one").alias("__n"))
    bits = max(1, (2 * values.count() - 1).bit_length())
    odd = op in ("<", ">=")  # whether equal values have the left side above the right one

    def side(df: DataFrame, last: int, bit: int) -> DataFrame:
        at = F.expr(f"explode(transform(filter(sequence(0, {bits - 1}), i -> (shiftright(__n, i) & 1) = {bit}), i -> shiftright(__n, i + 1) * 64 + i))")
        made = df.join(numbers.select(c, (F.col("__n") * 2 + last).alias("__n")), c).select("*", at.alias("__half")).drop(c, "__n").withColumnRenamed("__half", c)
        return made.withColumn("__cuts", F.expr(f"shiftright(__cuts, cast({bits - 1} - ({c} & 63) as int))")) if "__cuts" in df.columns else made

    less = op[0] == "<"
    return side(a, int(odd), int(not less)), side(b, int(not odd), int(less))


def _pairs(a: DataFrame, b: DataFrame, tests: dict[int, Predicate], models: dict[str, Model]) -> DataFrame:
    """One row v: the pairs of rows that pass all tests, from counts c by columns k<i> of either side, none of them blank.

    `!=` is all pairs less those of `=`; a model's pairs of values turn into equal ones; one order comparison is a running sum
    along its values, in the buckets __cuts if there; further ones turn into equalities of halves, so rows times a logarithm for each.
    """
    by = lambda kind: [k for k, p in tests.items() if p.op in kind]
    if unequal := by(("!=",)):
        k = unequal[0]
        rest = {i: p for i, p in tests.items() if i != k}
        every, same = _pairs(a, b, rest, models), _pairs(a, b, rest | {k: Predicate(tests[k].left, "=", tests[k].right)}, models)
        return every.crossJoin(same.withColumnRenamed("v", "w")).select((F.col("v") - F.col("w")).alias("v"))  # one row each
    for k in by(("similar", "ML")):
        p, c = tests[k], f"k{k}"
        alike = _model(p, models)(a.select(F.col(c).cast("string").alias("a")).distinct(), b.select(F.col(c).cast("string").alias("b")).distinct(), p.threshold or 0.0)
        a = a.withColumn("a", F.col(c).cast("string")).join(alike, "a").drop("a", c).withColumnRenamed("b", c)
        b = b.withColumn(c, F.col(c).cast("string"))
        tests = tests | {k: Predicate(p.left, "=", p.right)}
    on = [f"k{k}" for k in by(("=",))]
    orders = by(("<", "<=", ">", ">="))
    placed = [c for c in ("__cuts",) if c in a.columns]
    of = lambda df, n: df.groupBy(*on, *[f"k{k}" for k in orders]).agg(F.sum("c").alias(n))
    total = lambda l, r: F.coalesce(F.sum(l.cast("decimal(38,0)") * r), F.lit(0)).cast("decimal(38,0)").alias("v")
    if not orders:
        left, right = of(a, "ca"), of(b, "cb")
        return (left.join(right, on) if on else left.crossJoin(right)).agg(total(F.col("ca"), F.col("cb")))  # without keys one row each
    if len(orders) > 1:
        values = a.select(*[f"k{k}" for k in orders]).unionByName(b.select(*[f"k{k}" for k in orders]))
        sizes = values.agg(*[F.approx_count_distinct(f"k{k}").alias(f"k{k}") for k in orders]).first()
        k = min(orders, key=lambda k: sizes[f"k{k}"])  # fewest bits
        left, right = of(a, "c"), of(b, "c")
        if len(orders) == 2:
            last = next(f"k{x}" for x in orders if x != k)
            cuts = bounds(values, last)  # before rows are repeated
            left, right = (df.withColumn("__cuts", bucket(F.col(last), cuts)) for df in (left, right))
        return _pairs(*_halves(left, right, f"k{k}", tests[k].op), tests | {k: Predicate(tests[k].left, "=", tests[k].right)}, models)
    k, op = f"k{orders[0]}", tests[orders[0]].op
    small, large = ("ca", "cb") if op[0] == "<" else ("cb", "ca")
    none = F.lit(0).cast("long")
    one = lambda df, ca, cb: df.select(*on, k, *placed, ca.alias("ca"), cb.alias("cb"))
    both = one(a, F.col("c"), none).unionByName(one(b, none, F.col("c"))).groupBy(*on, k, *placed).agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    under = running(both, k, [small], on, *placed)
    return under.agg(total(F.col(f"before_{small}") + (F.col(small) if "=" in op else F.lit(0)), F.col(large)))


def _sided(rule: Rule, names: dict[int, str], foreign) -> tuple[list[Predicate], list[list[int]]]:
    """Equalities that join variables, and the variables of each side: one, or two that other predicates hold together.

    Joins are the predicates on foreign edges, and equalities of different tables but for those between the right side's own variables.
    """
    edges = {frozenset(((a, x), (b, y))) for a, x, b, y in foreign}
    ends = rule.rhs.tids
    place = lambda r: (names[r.tid], r.column)
    joins = [p for p in rule.lhs if not p.constant and p.op == "=" and (frozenset((place(p.left), place(p.right))) in edges or (p.tids != ends and (len(p.tids) == 1 or names[p.left.tid] != names[p.right.tid])))]
    sides: list[list[int]] = []
    bound = {t for p in [*rule.lhs, rule.rhs] for t in p.tids}
    for t in [rule.rhs.left.tid, *([] if rule.rhs.constant else [rule.rhs.right.tid]), *sorted(bound)]:
        if not any(t in side for side in sides):
            sides.append(sorted(connected(joins, {t})))
    if len(sides) > 2:
        raise ValueError(f"variables that hang together with neither side: {rule}")
    return joins, sides


#: Signs of a comparison whose sides are exchanged; the others stay.
TURNED = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
#: A join of two variables is made if it has at most so many rows for each row of theirs; else its rows are only counted.
GROWS = 4


def _facing(p: Predicate, tids: list[int]) -> Predicate:
    """p with its left operand on the side of tids."""
    return p if p.left.tid in tids else Predicate(p.right, TURNED.get(p.op, p.op), p.left, p.model, p.threshold)


def _whole(df: DataFrame, ks: Iterable[int]) -> DataFrame:
    return reduce(lambda d, k: d.where(not_blank(F.col(f"k{k}"))), ks, df)


def _linked(rule: Rule, own: dict[int, DataFrame], tids: list[int], joins: list[Predicate], tests: list[Predicate], y_const: Column | None, models: dict[str, Model]) -> DataFrame | None:
    """row_size, xsupp, xysupp of two variables that are one wide table, from counts by the columns that they are joined by and compared in.

    None if the join is to be made: it is small, or a model compares columns of one variable.
    """
    rhs, links = rule.rhs, [p for p in joins if len(p.tids) == 2]
    inner = [p for p in tests if len(p.tids) == 1]
    if not links or any(p.op not in SIGNS for p in [*inner, *([rhs] if len(rhs.tids) == 1 else [])]):
        return None
    across = [*links, *[p for p in tests if len(p.tids) == 2]]
    facing = {k: _facing(p, tids[:1]) for k, p in enumerate([*across, *([rhs] if len(rhs.tids) == 2 else [])])}

    def counted(t: int) -> DataFrame:
        refs = {k: p.left if p.left.tid == t else p.right for k, p in facing.items()}
        here = [p for p in [*inner, rhs] if p.tids == {t}]
        used = set(refs.values()) | {r for p in here for r in (p.left, p.right) if isinstance(r, Ref)}
        wide = _wide(own, [t], [p for p in joins if p.tids == {t}], [p for p in rule.lhs if p.constant and p.left.tid == t], used)
        x = reduce(lambda c, p: c & holds(p), [p for p in inner if p.tids == {t}], F.lit(True))
        y = F.lit(True) if rhs not in here else y_const if rhs.constant else holds(rhs)
        return wide.groupBy(*[F.col(_name(r)).alias(f"k{k}") for k, r in refs.items()], x.alias("x"), y.alias("y")).agg(F.count("*").alias("c"))

    a, b = map(counted, tids)
    count = lambda l, r, ks: _pairs(_whole(l, ks), _whole(r, ks), {k: facing[k] for k in ks}, models)
    size = count(a, b, range(len(links)))
    rows = a.select("c").unionByName(b.select("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    made = size.crossJoin(rows).first()  # one row each
    if made["v"] <= GROWS * made["n"]:
        return None
    a, b = a.where("x"), b.where("x")
    xs, xys = count(a, b, range(len(across))), count(a.where("y"), b.where("y"), list(facing))
    return size.withColumnRenamed("v", "row_size").crossJoin(xs.withColumnRenamed("v", "xsupp")).crossJoin(xys.withColumnRenamed("v", "xysupp"))  # one row each


def evaluate(rule: Rule, tables: dict[str, DataFrame], foreign=(), row_size: str = "pairs", models: dict[str, Model] | None = None) -> DataFrame:
    """One row: row_size, xsupp, xysupp, support, confidence of a rule over any tables of its atoms.

    Variables that are joined are one wide table. With one wide table its rows are counted: row_size has the joins and
    constants, xsupp all premises, so a rule of joins only has both equal. With two, pairs of their rows are counted, from counts by
    the compared columns; row_size is the product of both, or, with row_size="first", the pairs that pass the first premise between
    them. A right side may compare with a constant. foreign: (table, column, table, column) edges that join. Blanks compare with nothing.
    """
    models = MODELS if models is None else models
    names = {t: name for name, t in rule.tables}
    own = {t: tables[name] for t, name in names.items()}
    joins, sides = _sided(rule, names, foreign)
    consts = [p for p in rule.lhs if p.constant]
    tests = [p for p in rule.lhs if not p.constant and p not in joins]
    rhs = rule.rhs
    y_const = constant_filter(F.col(_name(rhs.left)), dict(own[rhs.left.tid].dtypes)[rhs.left.column], rhs.op, str(rhs.right)) if rhs.constant else None
    used = {r for p in [*tests, rhs] for r in (p.left, p.right) if isinstance(r, Ref)}
    wides = [_wide(own, side, [p for p in joins if p.tids <= set(side)], [p for p in consts if p.left.tid in side], {r for r in used if r.tid in side}) for side in sides]
    measures = lambda one: one.select(*[F.col(c).cast("long").alias(c) for c in ("row_size", "xsupp", "xysupp")]).select("*", ratio("xysupp", F.col("row_size").cast("double")).alias("support"), ratio("xysupp", F.col("xsupp")).alias("confidence"))

    def passing(wide: DataFrame, side: list[int]) -> DataFrame:
        for p in tests:
            if p.tids <= set(side):
                wide = _alike(wide, p, models) if p.op in ("similar", "ML") else wide.where(holds(p))
        return wide

    if len(sides) == 1 and len(sides[0]) == 2 and (linked := _linked(rule, own, sides[0], joins, tests, y_const, models)) is not None:
        return measures(linked)
    if len(sides) == 1:
        passed = passing(wides[0].withColumn("__x", F.lit(1)), sides[0]) if any(p.op in ("similar", "ML") for p in tests) else None
        y = y_const if rhs.constant else (holds(rhs) if rhs.op in SIGNS else None)
        if passed is None and y is not None:  # one scan
            x = F.lit(True)
            for p in tests:
                x = x & holds(p)
            return measures(wides[0].agg(F.count("*").alias("row_size"), F.count_if(x).alias("xsupp"), F.count_if(x & y).alias("xysupp")))
        passed = passing(wides[0], sides[0])
        met = passed.where(y) if y is not None else _alike(passed, rhs, models)
        n = lambda df, c: df.agg(F.count("*").alias(c))
        return measures(n(wides[0], "row_size").crossJoin(n(passed, "xsupp")).crossJoin(n(met, "xysupp")))  # one row each

    across = [p for p in tests if not any(p.tids <= set(side) for side in sides)]
    keys = dict(enumerate(across))
    y, y_side = len(across), 0
    compared = keys if rhs.constant else keys | {y: rhs}
    if not rhs.constant and any(rhs.tids <= set(side) for side in sides):
        raise ValueError(f"the right side compares within one side: {rule}")
    # The left operand of a predicate may stand on either side; turned around, it stands on side 0.
    facing = {k: _facing(p, sides[0]) for k, p in compared.items()}
    ref = lambda k, side: facing[k].left if side == 0 else facing[k].right

    def counted(side: int) -> DataFrame:
        wide = passing(wides[side], sides[side])
        met = [y_const.alias("y")] if rhs.constant and side == y_side else []
        return wide.groupBy(*[F.col(_name(ref(k, side))).alias(f"k{k}") for k in facing], *met).agg(F.count("*").alias("c"))

    def shape(side: int) -> tuple:
        own_tids, at = set(sides[side]), lambda r: f"{names[r.tid]}.{r.column}"
        inner = [p for p in [*joins, *tests] if p.tids <= own_tids]
        return sorted(names[t] for t in own_tids), sorted(f"{sorted([at(p.left), at(p.right)])}{p.op}{p.model}{p.threshold}" for p in inner), sorted(f"{at(p.left)}{p.op}{p.right}" for p in consts if p.left.tid in own_tids), [at(ref(k, side)) for k in facing]

    alike, equal = shape(0) == shape(1), all(p.op == "=" for p in facing.values())
    a = counted(0)
    if alike and equal and row_size == "pairs" and not rhs.constant and not any(p.tids <= set(side) for p in tests for side in sides):  # one table of counts, three sums over it
        kx = [f"k{k}" for k in keys]
        x = F.lit(True)
        for c in kx:
            x = x & not_blank(F.col(c))
        by_x = a.groupBy(*kx).agg(F.sum("c").alias("cx"), F.sum(F.when(not_blank(F.col(f"k{y}")), _squared("c")).otherwise(0)).alias("cxy"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        sums = by_x.agg(zero(F.sum("cx")).alias("n"), zero(F.sum(F.when(x, _squared("cx")))).alias("xsupp"), zero(F.sum(F.when(x, F.col("cxy")))).alias("xysupp"))
        return measures(sums.select(_squared("n").alias("row_size"), "xsupp", "xysupp"))
    b = a if alike and not rhs.constant else counted(1)
    count = lambda ks, l=a, r=b: _pairs(_whole(l, ks), _whole(r, ks), {k: facing[k] for k in ks}, models)
    if row_size == "first":
        first = next((k for k in keys if facing[k].op == "="), None)
        size = count([] if first is None else [first])
    elif any(p.tids <= set(side) for p in tests for side in sides):
        n = [w.agg(F.count("*").cast("decimal(38,0)").alias(c)) for w, c in zip(wides, "nm", strict=True)]
        size = n[0].crossJoin(n[1]).select((F.col("n") * F.col("m")).alias("v"))  # one row each
    else:
        size = count([])
    xs = count(list(keys))
    xys = count(list(keys), l=a.where("y")) if rhs.constant else count([*keys, y])
    named = lambda df, c: df.withColumnRenamed("v", c)
    return measures(named(size, "row_size").crossJoin(named(xs, "xsupp")).crossJoin(named(xys, "xysupp")))  # one row each


def _alike(wide: DataFrame, p: Predicate, models: dict[str, Model]) -> DataFrame:
    """Rows of a wide table whose two columns a model takes for the same."""
    a, b = _name(p.left), _name(p.right)
    values = lambda c, n: wide.select(F.col(c).cast("string").alias(n)).distinct()
    pairs = _model(p, models)(values(a, "a"), values(b, "b"), p.threshold or 0.0)
    return wide.join(pairs, (F.col(a).cast("string") == F.col("a")) & (F.col(b).cast("string") == F.col("b")), "left_semi")


def rows_of_rule(rule: Rule, tables: dict[str, DataFrame], ids: dict[str, str], violating: bool = True, foreign=()) -> DataFrame:
    """Row ids (t<tid> for each variable) of what meets the premises and breaks the right side, or meets it.

    ids: the id column of each table. It gives pairs of rows by definition: take a limit of it, or count with evaluate().
    """
    names = {t: name for name, t in rule.tables}
    own = {t: tables[name] for t, name in names.items()}
    joins, sides = _sided(rule, names, foreign)
    if any(p.op not in SIGNS for p in [*rule.lhs, rule.rhs]):
        raise ValueError(f"models give no rows: {rule}")
    consts = [p for p in rule.lhs if p.constant]
    tests = [p for p in rule.lhs if not p.constant and p not in joins]
    used = {r for p in [*tests, rule.rhs] for r in (p.left, p.right) if isinstance(r, Ref)} | {Ref(t, ids[names[t]]) for side in sides for t in side}
    wides = [_wide(own, side, [p for p in joins if p.tids <= set(side)], [p for p in consts if p.left.tid in side], {r for r in used if r.tid in side}) for side in sides]
    met = reduce(lambda c, p: c & meets(p), tests, F.lit(True))
    out = wides[0].where(met) if len(wides) == 1 else wides[0].join(wides[1], met)
    y = rule.rhs
    if y.constant:
        said, known = constant_filter(F.col(_name(y.left)), dict(own[y.left.tid].dtypes)[y.left.column], y.op, str(y.right)), not_blank(F.col(_name(y.left)))
    else:
        said, known = holds(y), not_blank(F.col(_name(y.left))) & not_blank(F.col(_name(y.right)))
    out = out.where(known & ~said if violating else said)
    return out.select(*[F.col(_name(Ref(t, ids[names[t]]))).alias(f"t{t}") for side in sides for t in side])
