"""Running sums over an order without a task that holds all rows: inside buckets first, then over the buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order, and values that their bounds are taken from.
BUCKETS, SAMPLED = 64, 1024


def bounds(df: DataFrame, by: str) -> list:
    """At most BUCKETS - 1 ascending values of by, from the SAMPLED distinct values of least hash."""
    held = df.where(F.col(by).isNotNull()).select(by).distinct().orderBy(F.xxhash64(by)).limit(SAMPLED).collect()
    values = sorted(r[0] for r in held)
    return values[:: max(1, -(-len(values) // BUCKETS))][1:]


def bucket(value: Column, cuts: list) -> Column:
    """How many cuts are at or under value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value)) if cuts else F.lit(0)


def running(df: DataFrame, by: str, sums: list[str], keys: list[str] = [], cuts: str | None = None) -> DataFrame:  # noqa: B006
    """df with before_<s> for each of sums, the sum of s over the rows of the same keys whose by is less, and last, the greatest such by.

    by is unique in its keys. cuts: a column with buckets that ascend with by, or None to take them here.
    """
    place = cuts or "__bucket"
    own = df if cuts else df.withColumn(place, bucket(F.col(by), bounds(df, by)))
    in_bucket = Window.partitionBy(*keys, place).orderBy(by)
    inside = in_bucket.rowsBetween(Window.unboundedPreceding, -1)
    upto = (Window.partitionBy(*keys) if keys else Window).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    of_bucket = own.groupBy(*keys, place).agg(F.max(by).alias("__most"), *[F.sum(s).alias(s) for s in sums])
    starts = of_bucket.select(*keys, place, F.max("__most").over(upto).alias("__last"), *[F.sum(s).over(upto).alias(f"__start_{s}") for s in sums])
    joined = own.select("*", F.lag(by).over(in_bucket).alias("__lag"), *[F.sum(s).over(inside).alias(f"__inner_{s}") for s in sums]).join(starts, [*keys, place])
    before = [(F.coalesce(f"__start_{s}", F.lit(0)) + F.coalesce(f"__inner_{s}", F.lit(0))).alias(f"before_{s}") for s in sums]
    return joined.select(*df.columns, *before, F.coalesce("__lag", "__last").alias("last"))
