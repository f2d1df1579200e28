"""Sample nodes of a lattice: nodes that were open when a run ended, with what a later run needs to find their children.

A sample is (lhs array, rhs, candidates array, predecessors array of lhs texts, max_conf, cdf array of counts by cut). Lattice nodes
are few beside rows: these frames hold a row for each node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(lhs: str) -> Column:
    return F.array_join(lhs, " ^ ")


def created(layer: DataFrame, before: DataFrame | None = None, k: int = 3) -> DataFrame:
    """layer (lhs, rhs, added, ...) with predecessors: the root for a first layer; else the node's own parent, and k - 1 other nodes of
    the layer before, for the same right side, that had the added premise as a candidate, in hashed order."""
    if before is None:
        return layer.withColumn("predecessors", F.array(F.lit("")))
    own = layer.withColumn("__parent", F.array_join(F.array_remove("lhs", F.col("added")), " ^ "))
    had = before.select("rhs", F.explode("candidates").alias("added"), text_of("lhs").alias("node"))
    others = had.groupBy("rhs", "added").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "node"))).alias("__others"))
    names = F.filter(F.transform(F.coalesce("__others", F.array().cast("array<struct<h:bigint,node:string>>")), lambda x: x["node"]), lambda x: x != F.col("__parent"))
    return own.join(others, ["rhs", "added"], "left").withColumn("predecessors", F.concat(F.array("__parent"), F.slice(names, 1, k - 1))).select(*layer.columns, "predecessors")


def covered(layer: DataFrame, samples: DataFrame) -> DataFrame:
    """layer with covered: whether a sample of the same right side is the node's parent and has its added premise as a candidate."""
    held = samples.select("rhs", text_of("lhs").alias("__parent"), F.explode("candidates").alias("added")).distinct().withColumn("__hit", F.lit(True))
    own = layer.withColumn("__parent", F.array_join(F.array_remove("lhs", F.col("added")), " ^ "))
    return own.join(held, ["rhs", "__parent", "added"], "left").select(*layer.columns, F.coalesce("__hit", F.lit(False)).alias("covered"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples of both, one for each (lhs, rhs): predecessors and candidates united, the larger max_conf, cdf added up.

    overlap: how the predecessors compare: 'all', 'part' or 'none' of them are shared, null for a node that one side lacks.
    """
    cells = ("candidates", "predecessors", "max_conf", "cdf")
    other = b.withColumnsRenamed({c: f"__{c}" for c in cells})
    both = a.join(other, ["lhs", "rhs"], "full")
    united = lambda c: F.sort_array(F.coalesce(F.array_union(c, f"__{c}"), c, f"__{c}")).alias(c)
    shared = F.size(F.array_intersect("predecessors", "__predecessors"))
    apart = F.size(F.array_except("predecessors", "__predecessors")) + F.size(F.array_except("__predecessors", "predecessors"))
    overlap = F.when(F.col("predecessors").isNull() | F.col("__predecessors").isNull(), F.lit(None)).when(apart == 0, "all").when(shared > 0, "part").otherwise("none")
    cdf = F.coalesce(F.zip_with("cdf", "__cdf", lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))), "cdf", "__cdf")
    return both.select("lhs", "rhs", united("candidates"), united("predecessors"), F.greatest("max_conf", "__max_conf").alias("max_conf"), cdf.alias("cdf"), overlap.alias("overlap"))


def neighbours(samples: DataFrame, confidence: float) -> DataFrame:
    """(lhs, rhs): the children, by each candidate, of the samples whose max_conf reaches confidence; each once."""
    grown = samples.where(F.col("max_conf") >= confidence).select("rhs", F.explode("candidates").alias("c"), "lhs")
    return grown.where(~F.array_contains("lhs", F.col("c")) & (F.col("c") != F.col("rhs"))).select(F.sort_array(F.array_append("lhs", F.col("c"))).alias("lhs"), "rhs").distinct()
