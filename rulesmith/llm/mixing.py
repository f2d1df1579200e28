"""Mixing sources to target weights by a time-varying curriculum. DataFrame operations only.

Each source has a weight schedule over training time t in [0, 1]: points (t, weight) joined by lines, by default of sources that
stay, fade or grow. Its integral, scaled to the source's target, is the source's cumulative token demand. A source's documents stand in a
seeded order, repeated in whole passes; the document whose tokens begin at c gets the training position at which
the demand reaches c (the integral's inverse), and documents are range-sorted by position.

Targets: the total of all sizes is shared by weight; a source takes at most MAX_EPOCHS times its size, and what is
over is shared anew by weight until none is above (one pass over the sources sorted by cap / weight finds the level).

Running sums of a source go over hash ranges first (bounded in number) and then in each range, so a source of any
share of the rows is spread over many tasks. The number of sources is taken to be moderate: one row each is sorted in one task.

Defined results: a null source is a source of its own, last; a null or white text has size 0 and takes nothing; repeated
rows each take their share (rows equal in id and text are interchangeable); an empty table gives no rows; other columns
are ignored, whatever their names. Reruns agree: the order is a hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, fresh, let

MAX_EPOCHS = 3
#: Rows of one hash range of a source, about.
RANGE_ROWS = 250
MAX_RANGES = 1 << 20
Schedule = tuple[tuple[float, float], ...]
#: Weight schedules by place of the source, repeating: (t, weight) from t = 0 to 1, of any mean.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Adds place, weight and target to (source, source_size): see the module."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", (F.col("place") % 3 + 1).cast("double")).withColumn("cap", (MAX_EPOCHS * F.col("source_size")).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every)
    return levels.withColumn("target", F.least(reached["level"] * F.col("weight"), "cap")).select("source", "source_size", "place", "weight", "target")


def segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(share, t, a, b, width) of each line: the integral up to it as a share of the whole, and the line, scaled to a mean of 1."""
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or times != sorted(times) or min(w for _, w in schedule) < 0:
        raise ValueError(f"not a schedule from 0 to 1: {schedule}")
    areas = [(v - t) * (a + b) / 2 for (t, a), (v, b) in zip(schedule, schedule[1:], strict=False)]
    whole = sum(areas)
    if whole <= 0:
        raise ValueError(f"a schedule without weight: {schedule}")
    return [(sum(areas[:k]) / whole, t, a / whole, b / whole, v - t) for k, ((t, a), (v, b)) in enumerate(zip(schedule, schedule[1:], strict=False)) if areas[k] > 0]


def position(share: Column, place: Column, schedules: tuple[Schedule, ...] = SCHEDULES) -> Column:
    """Training time at which a source's demand reaches a share of its target: in its line, x of a*x + (b-a)*x*x/(2*width) = what is left."""
    fields = ("share", "t", "a", "b", "width")
    lines = F.array(*[F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(own, fields, strict=True)]) for own in segments(s)]) for s in schedules])[place % len(schedules)]

    def inside(line: Column) -> Column:
        left, bend = F.greatest(share - line["share"], F.lit(0.0)), (line["b"] - line["a"]) / line["width"]
        flat = left / F.nullif(line["a"], F.lit(0.0))
        curved = (F.sqrt(F.greatest(line["a"] * line["a"] + 2 * bend * left, F.lit(0.0))) - line["a"]) / F.nullif(bend, F.lit(0.0))
        return F.least(F.lit(1.0), line["t"] + F.least(line["width"], F.coalesce(F.when(bend == 0, flat).otherwise(curved), F.lit(0.0))))

    return let(F.element_at(F.filter(lines, lambda x: x["share"] <= share), -1), inside)


def plan(sized: DataFrame, partial: bool = True, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """One row for each row of sized (doc_id, source, size, tie), with place, source_size, target, taken and passes.

    passes: array of (epoch, position, words), one for each time that the document is read. partial: the last
    document of a source gives only the words that the target still takes; else all of its words.
    """
    sized = sized.withColumn("order", F.xxhash64("tie"))
    rows = sized.count()
    ranges = max(1, min(MAX_RANGES, -(-rows // RANGE_ROWS)))
    cut = durable(sized.withColumn("range", F.floor(F.pmod("order", F.lit(1 << 32)) * ranges / (1 << 32)).cast("int")).withColumn("no_source", F.col("source").isNull()).withColumn("source_", F.coalesce("source", F.lit(""))))
    key = ["no_source", "source_"]
    parts = cut.groupBy(*key, "range").agg(F.sum("size").alias("held"))
    sizes = parts.groupBy(*key).agg(F.sum("held").alias("source_size")).withColumn("source", F.when(~F.col("no_source"), F.col("source_")))
    targets = source_targets(sizes.select("source", "source_size")).withColumn("no_source", F.col("source").isNull()).withColumn("source_", F.coalesce("source", F.lit(""))).drop("source")
    running = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("before", F.coalesce(F.sum("held").over(running), F.lit(0))).drop("held").join(targets, key)
    inside = Window.partitionBy(*key, "range").orderBy(F.pmod("order", F.lit(1 << 32)), "order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, [*key, "range"])
    begin = F.col("before") + F.col("inner")
    need = F.round(F.col("target")).cast("long")

    def one(epoch: Column) -> Column:
        at = begin + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), need - at)) if partial else F.when(at < need, F.col("size")).otherwise(F.lit(0).cast("long"))
        return F.struct(epoch.cast("int").alias("epoch"), position(at / F.col("target"), F.col("place"), schedules).alias("position"), words.alias("words"))

    reads = F.array(*[one(F.lit(k).cast("long")) for k in range(MAX_EPOCHS)])
    return placed.withColumn("passes", F.when(F.col("target") > 0, F.filter(reads, lambda x: x["words"] > 0)).otherwise(F.filter(reads, lambda x: F.lit(False)))).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda s, x: s + x["words"])).select("doc_id", "tie", F.when(~F.col("no_source"), F.col("source_")).alias("source"), "size", "place", "source_size", "target", "taken", "passes")


def words_of(text: Column) -> Column:
    """Words of a text: white space is exactly the six ASCII characters of WORD."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tie_of() -> Column:
    return F.xxhash64("doc_id", "text", "source")


def curriculum(docs: DataFrame, partial: bool = True, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """The plan of docs (doc_id, source, text), range-sorted by first training position; what isn't read comes last."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), tie_of().alias("tie"))
    return plan(sized, partial, schedules).withColumn("first_position", F.get("passes", F.lit(0))["position"]).orderBy(F.col("first_position").asc_nulls_last(), "tie")


def training_order(docs: DataFrame, schedules: tuple[Schedule, ...] = SCHEDULES) -> DataFrame:
    """Whole documents of docs, each as often as the mix reads it, range-sorted by training position."""
    tie, nth, copy, positions, at = fresh(docs, "tie", "nth", "copy", "positions", "position")
    copies = Window.partitionBy(tie).orderBy(tie)
    planned = curriculum(docs, False, schedules).where("taken > 0")
    planned = planned.select(F.col("tie").alias(tie), F.transform("passes", lambda x: x["position"]).alias(positions))
    planned = planned.withColumn(copy, F.row_number().over(copies))
    keyed = docs.withColumn(tie, tie_of()).withColumn(nth, F.row_number().over(copies))
    # The copies of a row meet row by row; the difference keeps the join on one key, by which both sides are dealt.
    joined = keyed.join(planned, tie).where(F.col(nth) - F.col(copy) == 0)
    return joined.withColumn(at, F.explode(positions)).orderBy(at, tie).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    return curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", "first_position", F.transform("passes", lambda x: x["position"]).alias("positions"))
