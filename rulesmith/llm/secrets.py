"""Secret scans through a trigram inverted index. DataFrame operations only.

Every rule is a regular expression. Its mandatory literals give a Boolean query over trigrams of the lower-cased text:
an OR of ANDs. The index holds postings (trigram, text) for the trigrams that any query names; a query's candidates are
the texts whose postings intersect as it asks; only they are verified with the rule's regular expression. Rules
without mandatory trigrams scan every text.

Rows are keyed by 128 bits of their id and text, so copies of one text under many ids are keys of their own; rows that share both
are the same row and have the same spans.

Defined results: a null text is an empty one; empty texts have no spans; repeated rows and null ids each get their
result; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._parser as sre
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, let, row_hash

#: Fixed values: (kind, pattern, group whose length counts, least length of that group). Base kinds first.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("urlauth", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,80}:[^\x00-\x20/:@]{1,80}@", 0, 8),
)
BASE = ("assign", "access", "hex")
#: Strings that a piece of a pattern may spell before it is cut; trigrams kept of one alternative.
MAX_STRINGS = 64


def literals(pattern: str) -> list[set[str]]:
    """Sets of lower-case strings; each match of pattern holds one string of every set."""
    out: list[set[str]] = []

    def flush(strings: set[str]) -> set[str]:
        out.append(strings)
        return {""}

    def walk(tokens, strings: set[str]) -> set[str]:
        for op, arg in tokens:
            name = str(op)
            choice: set[str] | None = None
            if name == "LITERAL":
                choice = {chr(arg).lower()}
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
                choice = {chr(v).lower() for _, v in arg}
            elif name == "SUBPATTERN":
                strings = walk(arg[3], strings)
                continue
            elif name == "BRANCH":
                own = [spelled(x) for x in arg[1]]
                choice = set().union(*own) if all(x is not None for x in own) else None
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                own = spelled(inner)
                if own is not None and (low, high) == (0, 1):
                    choice = own | {""}
                elif own is not None and low == high and len(own) ** low <= MAX_STRINGS:
                    choice = {"".join(x) for x in product(own, repeat=low)}
                elif low >= 1:
                    flush(strings)
                    strings = flush(walk(inner, {""}))
                    continue
            if choice is None or len(choice) * len(strings) > MAX_STRINGS:
                strings = flush(strings)
                if choice is not None and len(choice) <= MAX_STRINGS:
                    strings = choice
            else:
                strings = {a + b for a in strings for b in choice}
        return strings

    def spelled(tokens) -> set[str] | None:
        """All strings that tokens match, if they are few."""
        kept = len(out)
        strings = walk(tokens, {""})
        if len(out) > kept:
            del out[kept:]
            return None
        return strings

    flush(walk(sre.parse(pattern), {""}))
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query: alternatives of trigrams that must all be there; an empty list: no trigram is mandatory."""
    clauses = [frozenset()]
    for strings in literals(pattern):
        own = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
        if frozenset() in own:
            continue
        joined = {a | b for a in clauses for b in own}
        if len(joined) <= MAX_STRINGS:
            clauses = list(joined)
    clauses = [c for c in clauses if not any(o < c for o in clauses)]
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key) of texts (key, text) for the trigrams, each once."""
    named = F.array(*[F.lit(t) for t in trigrams])
    found = let(F.lower("text"), lambda low: F.filter(named, lambda t: F.contains(low, t)))
    return texts.select("key", F.explode(found).alias("trigram"))


def candidates(texts: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): for each text, the rules with mandatory trigrams whose query its postings satisfy."""
    spark = texts.sparkSession
    clauses = [(kind, f"{kind}/{k}", len(clause), t) for kind, pattern, *_ in rules for k, clause in enumerate(trigram_query(pattern)) for t in sorted(clause)]
    trigrams = sorted({x[3] for x in clauses})
    wanted = F.broadcast(spark.createDataFrame(clauses, "kind string, clause string, needs int, trigram string"))  # a fixed table: the rules' own
    postings = index(texts, trigrams)
    met = postings.join(wanted, "trigram").groupBy("key", "clause", "kind", "needs").agg(F.count_distinct("trigram").alias("n")).where("n = needs")
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))  # as many as there are rules at most


def find(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, rank, end, kind) of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves alternate; running sums of their lengths are the
    places. Sums go by blocks of 64, so that very many matches stay cheap.
    """
    rank = [k for k, *_ in RULES].index(kind) if kind in [k for k, *_ in RULES] else len(RULES)
    lengths = lambda x: F.transform(x, lambda s: F.length(s))
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def spans(held: Column) -> Column:
        # steps[i]: the piece before match i and the match before that.
        def of(steps: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / 64).cast("int")), lambda b: add(F.slice(steps, b * 64 + 1, 64)))
            sums = lambda done: F.transform(steps, lambda _, i: F.get(done, F.floor(i / 64).cast("int")) + add(F.slice(steps, F.floor(i / 64).cast("int") * 64 + 1, i % 64 + 1)))
            before = let(blocks, lambda b: F.aggregate(b, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))))
            starts = let(before, sums)
            made = F.transform(starts, lambda at, i: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.get(held["whole"], i)).alias("end"), F.lit(kind).alias("kind"), F.get(held["part"], i).alias("n")))
            return F.transform(F.filter(made, lambda x: x["n"] >= least), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

        return let(F.transform(held["whole"], lambda _, i: F.get(held["between"], i) + F.when(i > 0, F.get(held["whole"], i - 1)).otherwise(F.lit(0))), of)

    pattern_ = F.lit(pattern)
    whole = lengths(F.regexp_extract_all(text, pattern_, F.lit(0)))
    part = lengths(F.regexp_extract_all(text, pattern_, F.lit(group)))
    held = F.struct(lengths(F.split(text, pattern, -1)).alias("between"), whole.alias("whole"), part.alias("part"))
    return F.when(text.rlike(pattern), let(held, spans)).otherwise(none())


def none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")


def spanned(docs: DataFrame, into: str, rules=RULES) -> DataFrame:
    """docs with the spans of every row in the column into."""
    key, text, own = fresh(docs, "key", "whole", "rules")
    texts = docs.withColumns({key: row_hash(F.col("doc_id").cast("long"), F.col("text")), text: F.coalesce(F.col("text").cast("string"), F.lit(""))})
    gated = {kind for kind, pattern, *_ in rules if trigram_query(pattern)}
    # Cut off here, so that the join deals out rows by key alone and Spark can split the rows of one key.
    found = durable(candidates(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), rules))
    joined = texts.join(found.select(F.col("key").alias(key), F.col("rules").alias(own)), key, "left")
    spans = [F.when(F.array_contains(own, kind), find(F.col(text), kind, *rest)).otherwise(none()) if kind in gated else find(F.col(text), kind, *rest) for kind, *rest in rules]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.sort_array(F.flatten(F.array(*spans))).alias(into))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id and spans: array of (start, rank, end, kind) by start, then by the rules' order."""
    return spanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "spans", rules).select("doc_id", "spans")


def op8(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return scan(docs).select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans by the first of them. All rows and columns stay."""
    (spans,) = fresh(docs, "spans")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(F.concat(s["out"], F.substr("text", s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at")))
    done = lambda s: F.concat(s["out"], F.substr("text", s["at"] + 1, F.length("text")))
    masked = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.aggregate(spans, start, step, done))
    return spanned(docs, spans).withColumn("text", masked).select(*[F.col(f"`{c}`") for c in docs.columns])
