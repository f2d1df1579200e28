"""Decision-tree rules over constants: a levelwise builder on grouped class histograms.

A leaf is a conjunction of cuts. Every level is one job for all open leaves and columns: the gains of all cuts between
distinct values are running sums, and one row for each leaf reaches the driver. Rows without a value in the split column go to
both children, weighted by the share of each side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesmith.operators.order import BUCKETS, SAMPLED, bucket
from rulesmith.operators.stats import split_gains

#: Depth, least rows of a node as a share, least gain.
MAX_DEPTH, MIN_RATE, MIN_ROWS, MIN_GAIN = 3, 1e-5, 5, 1e-9


@dataclass
class Leaf:
    """cuts lead to it; weight: its rows; counts: weight by class, of the classes that were asked for."""

    cuts: list[tuple[str, str, float]] = field(default_factory=list)
    counts: dict[str, float] = field(default_factory=dict)
    weight: float = 0.0


def grow(df: DataFrame, features: list[str], label: str, max_depth: int = MAX_DEPTH, max_leaves: int = 0, least_share: float = 0.0) -> list[Leaf]:
    """Leaves of a tree by entropy.

    With max_leaves the leaf whose split saves most is split first, until there are so many; else all of a level are. Classes
    with less than least_share of a leaf aren't counted, which bounds what reaches the driver.
    """
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.where(F.col(label).isNotNull()).select(*[number(c).alias(c) for c in features], F.col(label).cast("string").alias("__y"), F.lit(0).alias("__leaf"), F.lit(1.0).alias("__w"))
    sample = rows.orderBy(F.xxhash64(*features, "__y")).limit(SAMPLED).collect()  # for the bounds of buckets only
    cuts = {}
    for c in features:
        values = sorted({r[c] for r in sample if r[c] is not None})
        cuts[c] = values[:: max(1, -(-len(values) // BUCKETS))][1:]
    leaves, depth = {0: Leaf()}, {0: 0}

    def count(ids: list[int]) -> None:
        held = rows.where(F.col("__leaf").isin(ids or [-1])).groupBy("__leaf", "__y").agg(F.sum("__w").alias("n"))
        whole = held.groupBy("__leaf").agg(F.sum("n").alias("all"))
        for r in held.join(whole, "__leaf").where(F.col("n") >= least_share * F.col("all")).collect():
            leaves[r["__leaf"]].counts[r["__y"]], leaves[r["__leaf"]].weight = r["n"], r["all"]

    count([0])
    root = leaves[0].weight or rows.count()
    fresh, open_, ended = [0], {}, []
    while True:
        if fresh := [x for x in fresh if depth[x] < max_depth or ended.append(x)]:
            cells = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("v"), bucket(F.col(c), cuts[c]).alias("cuts")) for k, c in enumerate(features)])
            held = rows.where(F.col("__leaf").isin(fresh)).select("__leaf", F.col("__y").alias("y"), "__w", F.inline(cells)).where("v is not null").groupBy("__leaf", "f", "v", "cuts", "y").agg(F.sum("__w").alias("w"))
            gains = split_gains(held, ["__leaf", "f"], "cuts").where(F.least("left", "right") >= max(MIN_ROWS, MIN_RATE * root))
            cut = ((F.col("v") + F.col("last")) / 2).alias("cut")
            pick = F.max(F.struct(F.round("gain", 9).alias("gain"), (-F.col("f")).alias("f"), (-cut).alias("cut"), "left", "right"))  # ties: the first column, the least cut
            best = {r["__leaf"]: r["best"] for r in gains.groupBy("__leaf").agg(pick.alias("best")).collect()}
            open_ |= {x: (b["gain"] / root, features[-b["f"]], -b["cut"], b["left"] / (b["left"] + b["right"])) for x, b in best.items() if b["gain"] / root > MIN_GAIN}
            ended += [x for x in fresh if x not in open_]
        if not open_ or (max_leaves and len(ended) + len(open_) >= max_leaves):
            break
        now = [max(open_, key=lambda x: (open_[x][0], -x))] if max_leaves else list(open_)
        splits = {x: open_.pop(x) for x in now}
        stay = F.array(F.struct(F.col("__leaf").alias("leaf"), F.col("__w").alias("w")))
        to = F.when(~F.col("__leaf").isin(now), stay)
        for x, (_, c, cut, share) in splits.items():
            one = lambda k, w=1.0: F.struct(F.lit(k).alias("leaf"), (F.col("__w") * w).alias("w"))
            side = F.when(F.col(c).isNull(), F.array(one(2 * x + 1, share), one(2 * x + 2, 1 - share))).when(F.col(c) < cut, F.array(one(2 * x + 1))).otherwise(F.array(one(2 * x + 2)))
            to = to.when(F.col("__leaf") == x, side)
            for k, op in ((2 * x + 1, "<"), (2 * x + 2, ">=")):
                leaves[k], depth[k] = Leaf([*leaves[x].cuts, (c, op, cut)]), depth[x] + 1
        rows = rows.select(*features, "__y", F.inline(to)).withColumnsRenamed({"leaf": "__leaf", "w": "__w"})
        fresh = [k for x in now for k in (2 * x + 1, 2 * x + 2)]
        count(fresh)
    return [leaves[x] for x in [*ended, *open_]]


def simplified(cuts: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """The tightest cut of each column and direction."""
    tight: dict[tuple[str, str], float] = {}
    for c, op, v in cuts:
        old = tight.get((c, op))
        tight[c, op] = v if old is None else (min(old, v) if op == "<" else max(old, v))
    return [(c, op, v) for (c, op), v in sorted(tight.items())]


def tree_rules(leaves: list[Leaf], label: str, rows: int, support: float, confidence: float) -> list[tuple[str, float, float]]:
    """(rule, support, confidence) of leaves strictly over both thresholds; one-hot cuts are printed as = or !=."""
    out = []
    for leaf in leaves:
        n = leaf.weight
        for y, c in sorted(leaf.counts.items()):
            if leaf.cuts and n and c / rows > support and c / n > confidence:
                said = [f"t0.{c_.split('=')[0]}{'!=' if op == '<' else '='}{c_.split('=', 1)[1]}" if "=" in c_ else f"t0.{c_}{op}{v:g}" for c_, op, v in simplified(leaf.cuts)]
                same = {x.split("=")[0] for x in said if "!=" not in x and "<" not in x and ">" not in x}
                said = [x for x in dict.fromkeys(said) if "!=" not in x or x.split("!=")[0] not in same]
                out.append((" ^ ".join(said) + f" -> t0.{label}={y}", c / rows, c / n))
    return out
