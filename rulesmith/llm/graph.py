"""Connected components by repeated contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, durable

#: Contracted edges that one task finishes, at most; more of them go through another round.
TAIL = 16_384


class Links:
    """Union-find over labels; found: the pairs that joined two sets."""

    def __init__(self, labels=()):
        self.up: dict[int, int] = {x: x for x in labels}
        self.found: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.found.append((x, y))
            self.up[max(a, b)] = min(a, b)


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, root) of TAIL edges at most."""
    links = Links()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            links.up.setdefault(a, a)
            links.up.setdefault(b, b)
            links.join(a, b)
    nodes = list(links.up)
    yield pd.DataFrame({"node": nodes, "root": [links.root(x) for x in nodes]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a long, b long); root is one node of its component.

    In each round a node joins its neighbour of least hash, if that is less than its own; what remains is contracted.
    Every node that isn't a local minimum goes, so the rounds grow as the logarithm of the longest path. What is left
    at TAIL edges is finished by one task, whose work that number bounds.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    left, n = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    while n > TAIL:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("least"))
        step = durable(near.select(F.col("a").alias("node"), F.least(rank("a"), F.col("least"))["v"].alias("to")))
        steps.append(step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b").where("a2 <> b2")
        left, n = counted(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
    out = left.coalesce(1).mapInPandas(_forest, "node long, root long")
    for step in reversed(steps):
        later = out.select(F.col("node").alias("to"), "root")
        out = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return out
