"""Levelwise mining of rules X -> y over one table, and its upkeep when thresholds change.

Supports come from sums of squares by column set (one job for a layer); each is counted once and kept in the state, so
that any later change of thresholds counts only sets that were never reached.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulesmith.operators.measure import squares
from rulesmith.operators.stats import minable, predicate_support

#: Cut points of confidence histograms.
CUTS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
MAX_LEVEL = 4


@dataclass(frozen=True)
class Mined:
    lhs: tuple[str, ...]
    rhs: str
    support: float
    confidence: float

    def __str__(self) -> str:
        return " ^ ".join(f"t0.{c}=t1.{c}" for c in self.lhs) + f" -> t0.{self.rhs}=t1.{self.rhs}"


@dataclass
class State:
    """Sums of squares so far, rules, pruned nodes and samples: what a change of thresholds starts from."""

    columns: list[str]
    rows: int
    counts: dict[frozenset[str], int] = field(default_factory=dict)
    minimal: list[Mined] = field(default_factory=list)
    pruned: list[Mined] = field(default_factory=list)
    samples: list[Mined] = field(default_factory=list)
    counted: int = 0


def mine(df: DataFrame, support: float, confidence: float, columns: list[str] | None = None, targets: list[str] | None = None, max_level: int = MAX_LEVEL, state: State | None = None) -> State:
    """Minimal rules with support and confidence at least as given.

    With a state, sets counted before are not counted again: the incremental run gives what a run from scratch gives,
    for a rise or fall of either threshold.
    """
    if columns is None:
        columns = state.columns if state else [r["col"] for r in predicate_support(df, minable(df)).where("keep").collect()]
    out = State(sorted(columns), state.rows if state else df.count(), dict(state.counts) if state else {})
    open_: dict[str, list[tuple[str, ...]]] = {y: [()] for y in (targets or out.columns)}
    done: dict[str, list[frozenset[str]]] = {y: [] for y in open_}
    for _ in range(max_level):
        nodes = {}
        for y, layer in open_.items():
            grown = [(*x, c) for x in layer for c in out.columns if c != y and (not x or c > x[-1])]
            nodes[y] = [x for x in grown if not any(d <= frozenset(x) for d in done[y])]
        need = {frozenset(x) for y in nodes for x in nodes[y]} | {frozenset({*x, y}) for y in nodes for x in nodes[y]}
        if missing := need - out.counts.keys():
            out.counts |= squares(df, missing)
            out.counted += len(missing)
        if not need:
            break
        for y, layer in nodes.items():
            open_[y] = []
            for x in layer:
                fx, fxy = out.counts[frozenset(x)], out.counts[frozenset({*x, y})]
                node = Mined(x, y, fxy / out.rows**2 if out.rows else 0.0, fxy / fx if fx else 0.0)
                if node.support < support:
                    out.pruned.append(node)
                    done[y].append(frozenset(x))
                elif node.confidence >= confidence:
                    out.minimal.append(node)
                    done[y].append(frozenset(x))
                else:
                    out.samples.append(node)
                    open_[y].append(x)
    out.minimal = minimal(out.minimal)
    return out


def minimal(rules: list[Mined]) -> list[Mined]:
    """Rules whose premises hold no other rule's premises for the same target; each once."""
    unique = {(frozenset(r.lhs), r.rhs): r for r in rules}
    return [r for (x, y), r in unique.items() if not any(z == y and w < x for w, z in unique)]


def as_frame(spark: SparkSession, rules: list[Mined]) -> DataFrame:
    return spark.createDataFrame([(str(r), ",".join(r.lhs), r.rhs, r.support, r.confidence) for r in rules], "ree string, lhs string, rhs string, support double, confidence double")


# --- samples, histograms, recall ---


def histogram(confidences: list[float]) -> list[int]:
    """How many are at least each cut."""
    return [sum(c >= cut for c in confidences) for cut in CUTS]


def merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def valid(hist: list[int], confidence: float) -> int:
    """Nodes that may reach confidence: between cuts the lower one counts, so never too few."""
    return hist[max(0, bisect_right(CUTS, confidence) - 1)]


def relaxed(samples: list[tuple[float, int]], recall: float) -> list[int]:
    """Indexes of the samples to keep, from (share still valid, size): the fewest expected losses go first, within 1 - recall."""
    loss = [ceil(share * size) for share, size in samples]
    most = ceil(sum(loss) * (1 - recall))
    gone, spent = set(), 0
    for k in sorted(range(len(samples)), key=lambda k: (loss[k], k)):
        if spent + loss[k] > most:
            break
        gone.add(k)
        spent += loss[k]
    return [k for k in range(len(samples)) if k not in gone]


def coverage(batch: DataFrame, found: DataFrame) -> DataFrame:
    """(ree, covered) of every rule of batch: whether found has a rule for the same target with no premise more."""
    sets = lambda df, x: df.select("ree", F.col("rhs").alias(f"rhs_{x}"), F.split("lhs", ",").alias(f"lhs_{x}")).withColumnRenamed("ree", f"ree_{x}")
    met = sets(batch, "a").join(sets(found, "b"), (F.col("rhs_a") == F.col("rhs_b")) & (F.size(F.array_except("lhs_b", "lhs_a")) == 0), "left_semi")
    return batch.select("ree").join(met.select(F.col("ree_a").alias("ree"), F.lit(True).alias("hit")).distinct(), "ree", "left").select("ree", F.coalesce("hit", F.lit(False)).alias("covered"))


def sides(frame: DataFrame) -> DataFrame:
    """(ree, lhs, rhs) of rule texts `a ^ b -> c`: the premises in order, joined by commas."""
    part = F.split("ree", "->")
    premises = F.array_sort(F.transform(F.split(part[0], r"\^"), lambda x: F.trim(x)))
    return frame.select("ree", F.array_join(premises, ",").alias("lhs"), F.trim(part[1]).alias("rhs"))


def coverage_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rules, covered): the distinct rules of a, how many of them b covers, and the other way. a, b: frames of rule texts (ree), of any tasks."""
    a, b = sides(a.select("ree").distinct()), sides(b.select("ree").distinct())
    one = lambda x, y, side: coverage(x, y).agg(F.count("*").alias("rules"), F.count_if("covered").alias("covered")).select(F.lit(side).alias("side"), "rules", "covered")
    return one(a, b, "a").unionByName(one(b, a, "b"))


# --- candidates ---


def ordered_candidates(supports: DataFrame) -> DataFrame:
    """predicate_support() with place: larger support first, of equal ones the later name. One row a column."""
    return supports.withColumn("place", F.row_number().over(Window.orderBy(F.desc("support"), F.desc("col"))))


def without_keys(columns: list[str], table: str, edges) -> list[str]:
    """columns of table that no edge (table, column, table, column) joins by: keys make no right sides."""
    keys = {end for a, x, b, y in edges for end in ((a, x), (b, y))}
    return [c for c in columns if (table, c) not in keys]


def related(candidates, node) -> tuple[list, list]:
    """(related, others): candidate predicates that touch a variable of the node's predicates, and the rest; a node without any is related to all."""
    bound = {t for p in node for t in p.tids}
    near = [p for p in candidates if not bound or p.tids & bound]
    return near, [p for p in candidates if p not in near]


def cdf_hist(frame: DataFrame) -> DataFrame:
    """(cut, n): rules with at least that confidence, from one aggregation."""
    made = frame.agg(*[F.sum((F.col("confidence") >= c).cast("long")).alias(f"n{k}") for k, c in enumerate(CUTS)])
    return made.select(F.inline(F.array(*[F.struct(F.lit(c).alias("cut"), F.coalesce(f"n{k}", F.lit(0)).alias("n")) for k, c in enumerate(CUTS)])))
