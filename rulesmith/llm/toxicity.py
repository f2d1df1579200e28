"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, lexicons induced from labelled rows (whole words and word beginnings of each length,
those that nearly always stand in toxic rows apart from the others) and patterns. A generative label model estimates each voter's accuracy on either class by
expectation maximisation, with the given label as one more, noisy voter; what two voters share beyond the class
(their correlation given the posterior) divides their say. A linear classifier over all lexicon entries and patterns
is then fitted to the posterior labels and scores every text.

Fitting uses FIT_ROWS labelled rows at most (those of least id hash). Scores see the whole text and nothing else.

Defined results: a null or empty text scores the classifier's constant; a null id isn't held out; repeated rows each get their
score; labels with a null id or class are left out, of repeated ids the larger class counts; without labels, or
with labels of one class only, the fixed lexicons decide; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_id, rows_of

FIT_ROWS = 20_000
#: Entries of the induced lexicons together, at most.
ENTRIES = 6000
#: Least share of toxic rows among the rows with an entry, and least log-likelihood ratio of that share against the
#: share of all rows: with very many words, some of a few rows stand in toxic ones by chance.
PURITY, EVIDENCE = 0.8, 14.0
#: Share of toxic rows from which an entry stands in the lexicon of pure ones of its kind.
PURE = 0.97
PREFIXES = (4, 5, 6)
#: How far a given label is trusted by the label model.
LABEL_TRUST = 0.97
#: Lexicons of insults and threats.
LEXICONS = {
    "insult_en": "idiot moron stupid loser dumb fool imbecile jerk dimwit halfwit clown pathetic worthless useless",
    "scorn_en": "trash garbage scum filth vermin disgusting scumbag lowlife vile parasite subhuman",
    "threat_en": "kill murder strangle lynch exterminate",
    "profanity_en": "fuck fucking fucked shit shitty bitch bastard asshole dickhead prick",
    "insult_de": "idiot trottel arschloch depp dummkopf abschaum wichser hurensohn vollidiot",
    "insult_fr": "idiot imbécile connard connasse salaud crétin débile ordure enculé",
    "insult_es": "idiota imbécil estúpido estúpida cabrón pendejo basura gilipollas escoria",
}
#: Patterns that vote.
PATTERNS = {
    "you_are": r"\byou(?:'re| are)(?: all)?(?: an?| such an?)?(?: \w+)? (?:idiot|moron|loser|clown|fool|disgrace|pathetic|worthless|stupid)",
    "masked": r"\b(?:f|sh|b|a)[*@#$]{2,}\w*\b",
    "shut_up": r"\b(?:shut up|go to hell|drop dead|get lost)\b",
    "hate": r"\bi hate (?:you|them|those|these)\b",
}
_words = re.compile(r"\w+").findall
_patterns = {k: re.compile(v) for k, v in PATTERNS.items()}


def entries_of(word: str) -> list[str]:
    """Lexicon entries that a word may meet: itself and its beginnings."""
    return ["=" + word] + [f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]


class Finder:
    """The entries and patterns of a text; remembers what each word gave, within a bound."""

    def __init__(self, entries: dict[str, int]):
        self.entries, self.known = entries, {}
        self.patterns = [(entries["~" + k], v) for k, v in _patterns.items() if "~" + k in entries]

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        low = text.lower()
        found: set[int] = set()
        known = self.known
        for word in set(_words(low)):
            own = known.get(word)
            if own is None:
                if len(known) > 300_000:
                    known.clear()
                own = known[word] = tuple(self.entries[e] for e in entries_of(word) if e in self.entries)
            if own:
                found.update(own)
        found.update(k for k, pattern in self.patterns if pattern.search(low))
        return sorted(found)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Toxic and other rows of every entry: one partial table for each task."""
    held = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            held[int(toxic)].update({e for w in set(_words((text or "").lower())) for e in entries_of(w)})
    keys = list(held[0].keys() | held[1].keys())
    for k in range(0, len(keys), 50_000):
        part = keys[k : k + 50_000]
        yield pd.DataFrame({"entry": part, "toxic": [held[1][e] for e in part], "other": [held[0][e] for e in part]})


def _found(batches: Iterator[pd.DataFrame], entries: dict[str, int]) -> Iterator[pd.DataFrame]:
    find = Finder(entries)
    for batch in batches:
        yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "found": [find(x) for x in batch["text"]]})


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, accuracies by class and voter, correlations) from votes (rows x voters, 0 or 1)."""
    n, j = votes.shape
    trust = np.where(labels == 1, LABEL_TRUST, 1 - LABEL_TRUST)
    posterior, say = trust.copy(), np.ones(j)
    rates, related = np.zeros((2, j)), np.eye(j)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        rates = (weight @ votes + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.0)
        rest = votes - (np.outer(posterior, rates[1]) + np.outer(1 - posterior, rates[0]))
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        related = (rest.T @ rest) / n / np.outer(spread, spread)
        say = 1 / np.maximum(1.0, np.clip(related, 0, None).sum(axis=1))
        prior = np.clip(posterior.mean(), 1e-4, 1 - 1e-4)
        odds = math.log(prior / (1 - prior)) + np.log(trust / (1 - trust))
        odds = odds + votes @ (say * np.log(rates[1] / rates[0])) + (1 - votes) @ (say * np.log((1 - rates[1]) / (1 - rates[0])))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6:
            break
        posterior = new
    return posterior, rates, related


def linear(rows: list[list[int]], target: np.ndarray, start: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights (the constant last) of a logistic classifier over binary entries, drawn towards start."""
    size = len(start)
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    col = np.array([c for x in rows for c in x], dtype=np.int64)
    w, ahead, step = start.copy(), start.copy(), 1.0
    share = np.bincount(col, minlength=size)[:size] / max(1, len(rows))
    scale = 1 / (0.25 * np.maximum(share * 8, 1e-3) + 1e-3)
    scale[-1] = 2.0
    for _ in range(rounds):
        z = np.bincount(at, weights=ahead[col], minlength=len(rows)) + ahead[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.bincount(col, weights=gap[at], minlength=size)[:size] / len(rows) + 1e-4 * (ahead - start)
        slope[-1] = gap.mean()
        new = ahead - scale * 0.3 * slope
        after = (1 + math.sqrt(1 + 4 * step * step)) / 2
        ahead, w, step = new + (step - 1) / after * (new - w), new, after
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Entries and weights, from labelled rows that aren't held out."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")  # FIT_ROWS ids at most
    counted = rows.mapInPandas(_count, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = sample.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id").groupBy("toxic").count().collect()
    size = {r["toxic"]: r["count"] for r in totals}
    fixed = {"=" + w: f"lexicon {name}" for name, text in LEXICONS.items() for w in text.split()}
    kinds = dict(fixed) | {"~" + k: f"pattern {k}" for k in PATTERNS}
    induced: list = []
    if len(size) == 2:
        base = size[1] / (size[0] + size[1])
        pure = F.col("toxic") / (F.col("toxic") + F.col("other"))
        evidence = F.col("toxic") * F.log(F.col("pure") / base) + F.when(F.col("other") > 0, F.col("other") * F.log((1 - F.col("pure")) / (1 - base))).otherwise(0.0)
        induced = counted.withColumn("pure", pure).where(F.col("pure") >= PURITY).where(evidence >= EVIDENCE).orderBy(F.desc("toxic"), "entry").limit(ENTRIES).collect()
    for r in induced:
        kinds.setdefault(r["entry"], f"{'word' if r['entry'][0] == '=' else 'beginning of ' + r['entry'][0]}, {'pure' if r['pure'] >= PURE else 'mixed'}")
    entries = {e: k for k, e in enumerate(kinds)}
    # Start: what an entry alone says; a word of a fixed lexicon is to outweigh the constant.
    says = {e: 6.0 if e in fixed else 1.0 for e in kinds}
    for r in induced:
        ratio = (r["toxic"] + 0.5) / (r["other"] + 0.5) * size[0] / size[1]
        says[r["entry"]] = max(says[r["entry"]], min(7.0, math.log(ratio)))
    start = np.array([*says.values(), -3.0])
    if len(size) < 2:
        return entries, start
    # FIT_ROWS rows of entry numbers at most, so that the driver's share is bounded.
    pairs = rows.mapInPandas(lambda batches: _found(batches, entries), "toxic int, found array<int>").collect()
    found, given = [list(r["found"]) for r in pairs], np.array([r["toxic"] for r in pairs])
    voters = {name: k for k, name in enumerate(dict.fromkeys(kinds.values()))}
    voter_of = np.array([voters[x] for x in kinds.values()])
    votes = np.zeros((len(found), len(voters)))
    for k, own in enumerate(found):
        votes[k, voter_of[own]] = 1
    votes = votes[:, votes.any(axis=0)]  # a voter that never fires on the sample says nothing of it
    posterior, _, _ = label_model(votes, given)
    return entries, linear(found, posterior, start)


def _score(batches: Iterator[pd.DataFrame], entries: dict[str, int], weights: np.ndarray) -> Iterator[pd.DataFrame]:
    find = Finder(entries)
    for batch in batches:
        z = np.array([weights[find(x)].sum() + weights[-1] for x in batch["text"]])
        yield batch[["doc_id", "no_id"]].assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row of docs."""
    entries, weights = fit(docs, labels)
    return rows_of(docs).mapInPandas(lambda batches: _score(batches, entries, weights), "doc_id long, no_id boolean, score double").select(own_id(), "score")


def _keep(batches, entries: dict[str, int], weights: np.ndarray, threshold: float):
    import pyarrow as pa

    find = Finder(entries)
    least = math.log(threshold / (1 - threshold))
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        yield batch.filter(pa.array([bool(weights[find(x)].sum() + weights[-1] < least) for x in texts]))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay."""
    entries, weights = fit(docs, labels)
    return docs.mapInArrow(lambda batches: _keep(batches, entries, weights, threshold), docs.schema)


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return score(docs, labels).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
