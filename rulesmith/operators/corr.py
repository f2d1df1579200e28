"""Correlation of numeric columns: Pearson, Spearman (average ranks) and Kendall (tau-b), and the best columns by each."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from rulesmith.operators.order import BUCKETS, bounds, bucket, running

LEAST_ROWS = 5
#: Rows that the columns of training rows are chosen from, at most.
SAMPLE_ROWS = 5000


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (r); null under LEAST_ROWS rows."""
    return _pairs(df, x, y).agg(F.when(F.count("*") >= LEAST_ROWS, F.corr("x", "y")).alias("r"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson of average ranks. Ranks come from counts by value, so one value of any frequency is one row."""
    own = _pairs(df, x, y).groupBy("x", "y").agg(F.count("*").alias("c"))

    def ranks(c: str) -> DataFrame:
        per = own.groupBy(c).agg(F.sum("c").alias("n"))
        return running(per, c, ["n"]).select(c, (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    every = own.agg(F.sum("c").alias("all"))
    middle = lambda c: (F.col(c) - (F.col("all") + 1) / 2).alias(c)  # noqa: E731  from the mean rank, so that nothing cancels
    joined = own.join(ranks("x"), "x").join(ranks("y"), "y").crossJoin(every).select("c", middle("rx"), middle("ry"))  # one row
    over = lambda a, b: F.sum(F.col("c") * F.col(a) * F.col(b))
    return joined.agg(F.when(F.sum("c") >= LEAST_ROWS, over("rx", "ry") / F.nullif(F.sqrt(over("rx", "rx")) * F.sqrt(over("ry", "ry")), F.lit(0.0))).alias("r"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tau-b of any number of rows, by merge counting.

    Distinct x are numbered; on each level, pairs meet whose numbers share all bits above it and differ in its bit, so every pair
    of different x meets on one level. There, running sums along y count concordant and discordant pairs: n log n in all.
    """
    own = _pairs(df, x, y).groupBy("x", "y").agg(F.count("*").cast("double").alias("c"))
    numbers = running(own.select("x").distinct().withColumn("one", F.lit(1).cast("long")), "x", ["one"]).select("x", F.col("before_one").alias("k"))
    levels = max(1, (max(1, numbers.count()) - 1).bit_length())
    each = own.join(numbers, "x").select("y", "c", "k", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    half = lambda bit: F.sum(F.when(F.expr("shiftright(k, level) & 1") == bit, F.col("c")).otherwise(0.0))
    cells = each.groupBy("level", F.expr("shiftright(k, level + 1)").alias("part"), "y").agg(half(0).alias("l"), half(1).alias("r"))
    cells = cells.withColumn("cuts", bucket(F.col("y"), bounds(own, "y")))
    whole = cells.groupBy("level", "part").agg(F.sum("l").alias("l_all"))
    under = running(cells, "y", ["l"], ["level", "part"], "cuts").join(whole, ["level", "part"])
    score = under.agg(F.coalesce(F.sum(F.col("r") * (2 * F.col("before_l") + F.col("l") - F.col("l_all"))), F.lit(0.0)).alias("s"))
    ties = lambda c: own.groupBy(c).agg(F.sum("c").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias(f"t{c}"))
    n = own.agg(F.sum("c").alias("n"))
    one = score.crossJoin(ties("x")).crossJoin(ties("y")).crossJoin(n)  # one row each
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    return one.select((F.col("s") / F.nullif(F.sqrt((all_pairs - F.col("tx")) * (all_pairs - F.col("ty"))), F.lit(0.0))).alias("tau"))


def _tau(x, y) -> float:
    """Tau-b of two arrays without gaps, by merge counting."""
    import numpy as np

    n = len(x)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda *cols: float(sum(k * (k - 1) / 2 for k in np.unique(np.stack(cols, 1), axis=0, return_counts=True)[1].tolist()))
    discordant, width, a = 0, 1, np.unique(y, return_inverse=True)[1]
    while width < n:
        for at in range(0, n, 2 * width):
            left, right = a[at : at + width], a[at + width : at + 2 * width]
            discordant += int((len(left) - np.searchsorted(left, right, "right")).sum())
            a[at : at + 2 * width] = np.sort(a[at : at + 2 * width], kind="stable")
        width *= 2
    pairs, tx, ty = n * (n - 1) / 2, ties(x), ties(y)
    below = ((pairs - tx) * (pairs - ty)) ** 0.5
    return (pairs - tx - ty + ties(x, y) - 2 * discordant) / below if below else float("nan")


def combined(df: DataFrame, columns: list[str], label: str, rows: int | None = None, gaps: float = 0.3) -> DataFrame:
    """(col, pearson, spearman, kendall): absolute correlations of each column with label over all rows, or over a sample of `rows`, those of least hash.

    A label that is no number is coded by its order in these rows. Kendall is 0 for a column with a larger share of gaps; a measure
    that can't be told is 0, as under LEAST_ROWS rows.
    """
    numeric = dict(df.dtypes)[label] not in ("string", "boolean")
    own = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)], (F.col(label).cast("double") if numeric else F.col(label).cast("string")).alias("y"))
    return _of_all(own, columns, numeric, gaps) if rows is None else _of_sample(own, columns, numeric, gaps, rows)


def _of_all(own: DataFrame, columns: list[str], numeric: bool, gaps: float) -> DataFrame:
    """combined() of all rows: spearman() and kendall() of all columns at once, with the column's number k as a key. A row of figures for each comes back."""
    held = own.where("y is not null and not isnan(y)") if numeric else own
    places = running(held.select("y").distinct().withColumn("one", F.lit(1).cast("long")), "y", ["one"]).select("y", F.col("before_one").alias("code"))
    coded = own.join(places, "y", "left").withColumn("y", F.col("y") if numeric else F.col("code").cast("double"))
    each = coded.select("y", "code", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("x")) for k in range(len(columns))])))
    fine = F.col("x").isNotNull() & ~F.isnan("x") & F.col("code").isNotNull()
    x, y = F.when(fine, F.col("x")), F.when(fine, F.col("y"))
    parts = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    ends = [f(v).alias(f"{n}_{c}") for n, f in (("least", F.min), ("most", F.max), ("var", F.var_pop)) for c, v in (("x", x), ("y", y))]
    known = each.groupBy("k").agg(F.count("*").alias("all"), F.count(x).alias("n"), *ends, F.covar_pop(x, y).alias("cov"), F.percentile_approx(x, parts).alias("cuts"), F.max(F.when(fine, F.col("code"))).alias("most")).collect()
    known = {r["k"]: r for r in known if r["n"] >= LEAST_ROWS and r["least_x"] < r["most_x"] and r["least_y"] < r["most_y"]}
    found = _ranked(each.where(fine & F.col("k").isin(*known)), known) if known else {}
    pearson = lambda r: r["cov"] / below if (below := math.sqrt(r["var_x"]) * math.sqrt(r["var_y"])) else None
    figures = lambda k: (pearson(known[k]), found[k]["spearman"], found[k]["kendall"] if 1 - known[k]["n"] / known[k]["all"] <= gaps else 0.0)
    out = [(c, *(0.0 if v is None or math.isnan(v) else abs(v) for v in (figures(k) if k in known else (None,) * 3))) for k, c in enumerate(columns)]
    return own.sparkSession.createDataFrame(out, "col string, pearson double, spearman double, kendall double")


def _ranked(each: DataFrame, known: dict[int, Row]) -> dict[int, Row]:
    """Rows with spearman and kendall by k, of rows (k, x, code)."""
    place = reduce(lambda c, k: c.when(F.col("k") == k, bucket(F.col("x"), sorted(set(known[k]["cuts"])))), known, F.when(F.lit(False), F.lit(0)))
    own = each.groupBy("k", "x", "code").agg(F.count("*").alias("c")).withColumn("cuts", place)

    def ranks(c: str, *cuts: str) -> DataFrame:
        per = own.groupBy("k", c, *cuts).agg(F.sum("c").alias("n"))
        return running(per, c, ["n"], ["k"], *cuts).select("k", c, F.col("n").alias(f"n{c}"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    middle = reduce(lambda c, k: c.when(F.col("k") == k, (known[k]["n"] + 1) / 2), known, F.when(F.lit(False), F.lit(0.0)))
    at = lambda c: F.col(f"r{c}") - middle  # noqa: E731  from the mean rank, so that nothing cancels
    over = lambda a, b: F.sum(F.col("c") * at(a) * at(b))
    tied = lambda c: F.sum(F.col("c").cast("double") * (F.col(f"n{c}") - 1)) / 2
    n = F.sum("c").cast("double")
    joined = own.join(ranks("x", "cuts"), ["k", "x"]).join(ranks("code"), ["k", "code"])
    rho = over("x", "code") / F.nullif(F.sqrt(over("x", "x")) * F.sqrt(over("code", "code")), F.lit(0.0))
    sums = joined.groupBy("k").agg(rho.alias("spearman"), ((n * (n - 1) / 2 - tied("x")) * (n * (n - 1) / 2 - tied("code"))).alias("below"))
    levels = max(1, max(r["most"] for r in known.values()).bit_length())
    half = lambda bit: F.sum(F.when(F.expr("shiftright(code, level) & 1") == bit, F.col("c")).otherwise(F.lit(0))).cast("double")
    cells = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).groupBy("k", "level", F.expr("shiftright(code, level + 1)").alias("part"), "x", "cuts").agg(half(0).alias("l"), half(1).alias("r"))
    whole = cells.groupBy("k", "level", "part").agg(F.sum("l").alias("l_all"))
    under = running(cells, "x", ["l"], ["k", "level", "part"], "cuts").join(whole, ["k", "level", "part"])
    score = under.groupBy("k").agg(F.sum(F.col("r") * (2 * F.col("before_l") + F.col("l") - F.col("l_all"))).alias("s"))
    made = sums.join(score, "k").select("k", "spearman", (F.col("s") / F.nullif(F.sqrt("below"), F.lit(0.0))).alias("kendall"))
    return {r["k"]: r for r in made.collect()}


def _of_sample(own: DataFrame, columns: list[str], numeric: bool, gaps: float, rows: int) -> DataFrame:
    sample = own.orderBy(F.xxhash64(*own.columns), *own.columns).limit(rows)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("x")) for k in range(len(columns))])

    def measures(own):
        import numpy as np
        import pandas as pd

        y = own["y"].to_numpy(dtype=float) if numeric else own["y"].rank(method="dense").to_numpy()
        x = own["x"].to_numpy(dtype=float)
        fine = ~(np.isnan(x) | np.isnan(y))
        a, b = pd.Series(x[fine]), pd.Series(y[fine])
        enough = len(a) >= LEAST_ROWS and a.nunique() > 1 and b.nunique() > 1
        found = [a.corr(b), a.rank().corr(b.rank()), _tau(a.to_numpy(), b.to_numpy()) if 1 - fine.mean() <= gaps else 0.0] if enough else [0.0] * 3
        return pd.DataFrame([[columns[own["k"].iloc[0]], *(0.0 if np.isnan(v) else abs(float(v)) for v in found)]], columns=["col", "pearson", "spearman", "kendall"])

    return sample.select("y", F.inline(cells)).groupBy("k").applyInPandas(measures, "col string, pearson double, spearman double, kendall double")  # `rows` rows a group at most


def sorted_columns(measured: DataFrame) -> DataFrame:
    """combined() with place: by Spearman, then Pearson, then Kendall, largest first; ties (to nine places) by name. One row a column."""
    return measured.withColumn("place", F.row_number().over(Window.orderBy(*[F.desc(F.round(m, 9)) for m in ("spearman", "pearson", "kendall")], "col")))


def chosen_columns(measured: DataFrame, k: int = 20) -> DataFrame:
    """(col): columns among the k best by any of the three measures; ties by name."""
    best = [measured.orderBy(F.desc(F.round(m, 9)), "col").limit(k).select("col") for m in ("pearson", "spearman", "kendall")]
    return best[0].unionByName(best[1]).unionByName(best[2]).distinct()


def top_columns(df: DataFrame, columns: list[str], label: str, k: int = 20) -> DataFrame:
    """(col, r): the k columns of largest absolute Pearson correlation with label, from one scan; ties by name."""
    made = df.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("r")) for c in columns])
    return made.select(F.inline(cells)).where("r is not null and not isnan(r)").orderBy(F.desc("r"), "col").limit(k)


def moments(df: DataFrame, column: str) -> DataFrame:
    """One row: mean, variance and deviation (divisor n - 1), greatest value and share of nulls of a column."""
    x = F.col(column).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance"), F.stddev_samp(x).alias("deviation"), F.max(x).alias("greatest"), F.avg(x.isNull().cast("double")).alias("null_share"))
