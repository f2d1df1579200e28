"""Column statistics: value counts, predicate support, candidate targets, dictionaries, splits and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesmith.functions.predicates import not_blank
from rulesmith.operators.order import bounds, bucket, running

ENUM_SIZE = 50
SUPPORT_LIMIT = 0.95
SMALL = 100


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, val) of the non-blank cells of columns, from one scan."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in columns])
    return df.select(F.inline(cells)).where(not_blank(F.col("val")))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, val, cnt): the partition of each column, as sizes."""
    return unpivoted(df, columns).groupBy("col", "val").agg(F.count("*").alias("cnt"))


def positions(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Value to sorted row ids, where ids themselves are wanted; large values make large rows."""
    return df.where(not_blank(F.col(column))).groupBy(F.col(column).alias("val")).agg(F.sort_array(F.collect_list(row_id)).alias("rows"))


def predicate_support(df: DataFrame, columns: list[str], limit: float = SUPPORT_LIMIT) -> DataFrame:
    """(col, n_distinct, pairs, ratio, support, keep): pairs = sum c(c-1); keep a column by its share of pairs."""
    per = value_counts(df, columns).groupBy("col").agg(F.count("*").alias("n_distinct"), F.sum(F.col("cnt").cast("decimal(38,0)") * (F.col("cnt") - 1)).cast("long").alias("pairs"))
    n = F.lit(df.count()).cast("double")
    ratio, support = F.col("pairs") / (n * (n - 1)), F.col("pairs") / (n * n)
    return per.select("col", "n_distinct", "pairs", ratio.alias("ratio"), support.alias("support"), ((F.col("pairs") > 0) & (ratio < limit) & (support < limit)).alias("keep"))


def minable(df: DataFrame) -> list[str]:
    """Columns that predicates may use: all but times and nested ones."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString().split("<")[0].split("(")[0] not in ("timestamp", "timestamp_ntz", "date", "array", "map", "struct", "binary")]


def y_candidates(df: DataFrame, enum_size: int = ENUM_SIZE) -> DataFrame:
    """(col, n_distinct): booleans, and strings with more than one and fewer than enum_size values."""
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if kinds[c] in ("string", "boolean")]
    per = value_counts(df, columns).groupBy("col").agg(F.count("*").alias("n_distinct"))
    booleans = [c for c in columns if kinds[c] == "boolean"]
    return per.where(F.col("col").isin(booleans) | ((F.col("n_distinct") > 1) & (F.col("n_distinct") < enum_size)))


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(val, code): codes from 0 in the column's order."""
    values = df.where(not_blank(F.col(column))).select(F.col(column).alias("val")).distinct()
    return running(values.withColumn("one", F.lit(1).cast("long")), "val", ["one"]).select("val", F.col("before_one").alias("code"))


def regex_share(df: DataFrame, column: str, pattern: str, rows: int = 100) -> float | None:
    """Share of the first rows values that match; over 0.75 classes the column."""
    return df.where(not_blank(F.col(column))).limit(rows).agg(F.avg(F.col(column).rlike(pattern).cast("int"))).first()[0]


# --- histograms and splits ---


def avc(df: DataFrame, column: str, label: str) -> DataFrame:
    """(val, label, w): the class histogram of each value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("val"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("w"))


def avc_binned(df: DataFrame, column: str, label: str, bins: int = SMALL) -> DataFrame:
    """(bin, label, w) over bins intervals of equal width between least and greatest value."""
    least, most = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if least is None:
        return avc(df, column, label).select(F.lit(0).alias("bin"), "label", "w")
    width = (most - least) / bins or 1.0
    place = F.least(F.floor((F.col(column).cast("double") - least) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(place.alias("bin"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("w"))


def avc_within(df: DataFrame, column: str, label: str, low: float, high: float) -> DataFrame:
    """(val, label, w): the exact class histogram of the values from low to under high, as of one interval of avc_binned."""
    x = F.col(column).cast("double")
    return avc(df.where((x >= low) & (x < high)), column, label)


def _xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(F.greatest(c, F.lit(1e-300)))).otherwise(0.0)


def split_gains(cells: DataFrame, keys: list[str], cuts: str) -> DataFrame:
    """(keys, v, last, left, right, gain): for each value but the least of its keys, the entropy that the cut below it saves.

    cells: keys, v, y, w (weight of the class y at the value v) and a column of buckets that ascend with v. gain is a sum over
    the rows, in nats; left and right are the weights of both sides. A class changes sums only at values it has, so any number of them does.
    """
    ran = running(cells, "v", ["w"], [*keys, "y"], cuts)
    of_class = cells.groupBy(*keys, "y").agg(F.sum("w").alias("t"))
    before, rest = F.col("before_w"), lambda x: F.greatest(F.col("t") - x, F.lit(0.0))
    steps = ran.join(of_class, [*keys, "y"]).groupBy(*keys, "v", cuts).agg(F.sum("w").alias("n"), F.sum(_xlogx(before + F.col("w")) - _xlogx(before)).alias("dl"), F.sum(_xlogx(rest(before + F.col("w"))) - _xlogx(rest(before))).alias("dr"))
    whole = of_class.groupBy(*keys).agg(F.sum("t").alias("n_all"), F.sum(_xlogx(F.col("t"))).alias("s_all"))
    placed = running(steps, "v", ["n", "dl", "dr"], keys, cuts).where("last is not null")
    joined = placed.join(whole, keys) if keys else placed.crossJoin(whole)  # one row
    left, right = F.col("before_n"), F.col("n_all") - F.col("before_n")
    gain = (_xlogx(F.col("n_all")) - F.col("s_all")) - (_xlogx(left) - F.col("before_dl")) - (_xlogx(right) - F.col("s_all") - F.col("before_dr"))
    return joined.select(*keys, "v", "last", left.alias("left"), right.alias("right"), gain.alias("gain"))


def splits(df: DataFrame, column: str, label: str) -> DataFrame:
    """(cut, gain): every cut `column < cut` between two distinct values, gain as a share of the weight of all rows; blank labels are left."""
    counts = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(column).cast("double").alias("v"), F.col(label).cast("string").alias("y")).agg(F.count("*").cast("double").alias("w"))
    cells = counts.withColumn("cuts", bucket(F.col("v"), bounds(counts, "v")))
    made = split_gains(cells, [], "cuts")
    return made.select(((F.col("v") + F.col("last")) / 2).alias("cut"), (F.col("gain") / (F.col("left") + F.col("right"))).alias("gain"))


def value_gains(df: DataFrame, column: str, label: str) -> DataFrame:
    """(val, gain): the entropy that a split into one value and all others saves, as a share of the weight of all rows."""
    cells = df.where(not_blank(F.col(column)) & F.col(label).isNotNull()).groupBy(F.col(column).cast("string").alias("val"), F.col(label).cast("string").alias("y")).agg(F.count("*").cast("double").alias("w"))
    of_class = cells.groupBy("y").agg(F.sum("w").alias("t"))
    whole = of_class.agg(F.sum("t").alias("n"), F.sum(_xlogx(F.col("t"))).alias("s"))
    own = cells.join(of_class, "y").groupBy("val").agg(F.sum("w").alias("m"), F.sum(_xlogx(F.col("w"))).alias("inside"), F.sum(_xlogx(F.col("t") - F.col("w")) - _xlogx(F.col("t"))).alias("change"))
    gain = (_xlogx(F.col("n")) - F.col("s")) - (_xlogx(F.col("m")) - F.col("inside")) - (_xlogx(F.col("n") - F.col("m")) - F.col("s") - F.col("change"))
    return own.crossJoin(whole).select("val", (gain / F.col("n")).alias("gain"))  # one row


def _with_gini(counts: DataFrame) -> DataFrame:
    """counts (xy, nxy, xny, nxny) with the Gini impurity of x given y."""
    yes, no = F.col("xy") + F.col("nxy"), F.col("xny") + F.col("nxny")
    part = lambda a, b: F.when(a + b > 0, 1 - F.pow(a / F.nullif(a + b, F.lit(0)), 2) - F.pow(b / F.nullif(a + b, F.lit(0)), 2)).otherwise(0.0)
    return counts.withColumn("gini", no / (yes + no) * part(F.col("xny"), F.col("nxny")) + yes / (yes + no) * part(F.col("xy"), F.col("nxy")))


def gini_index(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """One row: the 2 x 2 counts of two conditions and the Gini impurity of x given y."""
    return _with_gini(df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in {"xy": x & y, "nxy": ~x & y, "xny": x & ~y, "nxny": ~x & ~y}.items()]))


def gini_best(df: DataFrame, column: str, y: Column, k: int) -> DataFrame:
    """(value, gini): the k values of a column of least impurity given y, from one scan; ties (to nine places) by value. Gaps are left out."""
    held = df.where(not_blank(F.col(column)) & y.isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("x"), F.count_if(y).alias("xy"))
    whole = held.agg(F.sum("x").alias("n"), F.sum("xy").alias("y"))
    counts = held.crossJoin(whole).select("value", "xy", (F.col("y") - F.col("xy")).alias("nxy"), (F.col("x") - F.col("xy")).alias("xny"), (F.col("n") - F.col("y") - F.col("x") + F.col("xy")).alias("nxny"))  # one row
    return _with_gini(counts).select("value", F.round("gini", 9).alias("gini")).orderBy("gini", "value").limit(k)


def one_hot(df: DataFrame, enums: dict[str, list[str]], numbers: list[str], label: str) -> DataFrame:
    """Training rows: numbers as doubles (NaN for null), `c=v` as 0 or 1, y as the label's place in its order; rows without a label are left."""
    hot = [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}={v}") for c, vs in enums.items() for v in vs]
    return df.join(dictionary(df, label).select(F.col("val").alias(label), F.col("code").cast("int").alias("y")), label).select(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(c) for c in numbers], *hot, "y")
