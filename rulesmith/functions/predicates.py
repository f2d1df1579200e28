"""Predicates and rules: data classes, parser, printer and the helpers that plans need."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("!=", ">=", "<=", "=", ">", "<")
_term = re.compile(r"^t(\d+)\.(.+)$")
_call = re.compile(r"^(\w+)\((.*)\)$")


@dataclass(frozen=True)
class Ref:
    """Column of a tuple variable: t{tid}.{column}."""

    tid: int
    column: str

    def __str__(self) -> str:
        return f"t{self.tid}.{self.column}"


@dataclass(frozen=True)
class Predicate:
    """left op right; right is a Ref or a constant. model and threshold are for similar('m', a, b, 0.9) and ML('m', a, b)."""

    left: Ref
    op: str
    right: Ref | str
    model: str | None = None
    threshold: float | None = None

    @property
    def constant(self) -> bool:
        return not isinstance(self.right, Ref)

    @property
    def tids(self) -> set[int]:
        return {self.left.tid} | ({self.right.tid} if isinstance(self.right, Ref) else set())

    def __str__(self) -> str:
        if self.op == "similar":
            return f"similar('{self.model}', {self.left}, {self.right}, {self.threshold:.2f})"
        if self.op == "ML":
            return f"ML('{self.model}', {self.left}, {self.right})"
        return f"{self.left}{self.op}{self.right}"


@dataclass(frozen=True)
class Rule:
    """tables: (name, tid) atoms; lhs -> rhs."""

    lhs: tuple[Predicate, ...]
    rhs: Predicate
    tables: tuple[tuple[str, int], ...] = ()

    def __str__(self) -> str:
        return " ^ ".join([*(f"{t}(t{k})" for t, k in self.tables), *map(str, self.lhs)]) + f" -> {self.rhs}"


def _ref(text: str) -> Ref | None:
    m = _term.match(text.strip())
    return Ref(int(m[1]), m[2]) if m else None


def parse_predicate(text: str) -> Predicate:
    """Every operator of OPERATORS, the first one in the text counts; so values may hold operator signs."""
    text = text.strip()
    if (m := _call.match(text)) and m[1] in ("similar", "ML"):
        parts = [x.strip() for x in m[2].split(",")]
        left, right = _ref(parts[1]), _ref(parts[2])
        if left is None or right is None:
            raise ValueError(f"not a predicate: {text}")
        return Predicate(left, m[1], right, parts[0].strip("'\""), float(parts[3]) if len(parts) > 3 else None)
    found = re.search("|".join(map(re.escape, OPERATORS)), text)
    left = _ref(text[: found.start()]) if found else None
    if left is None:
        raise ValueError(f"not a predicate: {text}")
    value = text[found.end() :].strip()
    return Predicate(left, found[0], _ref(value) or value)


def parse_rule(text: str) -> Rule:
    body, arrow, head = text.rpartition("->")
    if not arrow:
        raise ValueError(f"not a rule: {text}")
    tables, lhs = [], []
    for atom in filter(None, (x.strip() for x in body.split("^"))):
        if m := re.match(r"^(\w+)\(t(\d+)\)$", atom):
            tables.append((m[1], int(m[2])))
        else:
            lhs.append(parse_predicate(atom))
    return Rule(tuple(lhs), parse_predicate(head), tuple(tables))


def connected(predicates, start: set[int]) -> set[int]:
    """Tuple variables that predicates tie to start."""
    reached = set(start)
    while more := {t for p in predicates if p.tids & reached for t in p.tids} - reached:
        reached |= more
    return reached


def is_connected(rule: Rule) -> bool:
    """All variables hang together, and the left side binds those of the right side."""
    tids = {t for p in rule.lhs for t in p.tids}
    return bool(tids) and rule.rhs.tids <= tids and connected(rule.lhs, {min(tids)}) == tids


def ordered(predicates) -> list[Predicate]:
    """Predicates such that each touches a variable bound before it, where possible; ties by text."""
    left, out, bound = sorted(predicates, key=str), [], set()
    while left:
        pick = next((p for p in left if p.tids & bound), left[0])
        left.remove(pick)
        out.append(pick)
        bound |= pick.tids
    return out


def not_blank(column: Column) -> Column:
    """NULL and '' are both blank: they equal nothing."""
    return column.isNotNull() & (column.cast("string") != "")


def constant_filter(column: Column, kind: str, op: str, value: str) -> Column:
    """column op value, both as numbers for numeric kinds; a value that is no number meets nothing but !=."""
    numeric = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    other = F.lit(value).try_cast("double") if numeric else F.lit(value).try_cast(kind)
    own = column.cast("double") if numeric else column
    made = {"=": own == other, "!=": own != other, ">": own > other, ">=": own >= other, "<": own < other, "<=": own <= other}[op]
    return not_blank(column) & F.coalesce(made, F.lit(op == "!="))
