"""Lexical retrieval packing: windows filled from a sharded BM25 inverted index.

Every document becomes token ids; each run of a whole window stands alone, and the rest of the document is one
retrieval unit. Units are dealt to bounded shards by two terms that win races weighted by rarity, so that units with much
in common are likely to meet. In a shard a BM25 index (its document
frequencies and mean length are those of the whole corpus) returns the unused neighbours of each seed unit, which
greedily fill the seed's window: neighbours that fit go in whole, best first, and the best of the others is cut so
that the window is exactly full; its rest seeds the next window. What a shard has left over at its end is cut into
sequences whose lengths are powers of two, so nothing is padded.

Defined results: a null text is an empty one (its only id is the end mark); repeated rows are packed as often as they
occur; an empty table gives no pieces; other columns of the input are ignored, whatever their names; a null id column
stays null in the pieces.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_ranges, durable, mix64, own_id, rows_of

WINDOW = 2048
END_ID = 1
#: Units in one shard's index at most; a fuller partition is worked off in several indexes.
SHARD_UNITS = 4096
#: A term that at least one in so many units of a shard holds has a dense row.
DENSE = 10
K1, B_LEN = 1.2, 0.75
RAW = "doc_id long, no_id boolean, start long, length long, doc_tokens long, ids binary, sequence_id long"
PIECES = "doc_id long, no_id boolean, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


#: White space in the sense of the vocabulary's pattern, for Python's and for Arrow's regular expressions.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: From what length on a run of white space is cut out of texts that the look ahead takes.
LONG_RUN = 10_000
_runs, _long_run = (re.compile(f"[{SPACES}]{{{n},}}") for n in (2, LONG_RUN))
#: Texts with a run of white space for each so many characters, or more, are left to the look ahead.
APART = 64
#: How the pattern takes white space: all of a run but its last character, which belongs to the word after it.
TAIL, PLAIN_TAIL = r"|\s+(?!\S)|\s+", r"|\s+"


class Encoder:
    """Ids of texts as the byte-level BPE in a tokenizers file gives them, added tokens included, without its post-processing.

    The merging is done by another library from the same vocabulary, which is four times as fast, and about twice that without the
    pattern's look ahead, which only says that of a run of white space the last character belongs to the word after it. So texts are
    cut before that character, and what is left has runs that are one piece. Where runs are many, the look ahead costs less than the
    cuts; its matcher fails on very long white space, so long runs are cut out there too.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as held:
            said = json.load(held)
        # Byte-level vocabularies write a byte as its own character where that is printable, others as characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.added = {x["content"]: x["id"] for x in said["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in word): k for word, k in said["model"]["vocab"].items() if word not in self.added}
        if not public_tokenizers.PATTERN.endswith(TAIL):
            raise ValueError(f"the pattern takes white space in another way: {public_tokenizers.PATTERN}")
        # None of the special tokens is allowed below; without any, the library would stop at each character.
        special = self.added or {"<|none|>": len(ranks)}
        core = lambda pattern: tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self._core, self._looking = core(public_tokenizers.PATTERN.removesuffix(TAIL) + PLAIN_TAIL), core(public_tokenizers.PATTERN)
        self._split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    def _plain(self, text: str, spaced: bool) -> list:
        """Buffers of ids."""
        runs, crowded = [], False
        for run in _runs.finditer(text) if spaced else ():
            runs.append(run.span())
            if crowded := len(runs) * APART > len(text):
                runs = [run.span() for run in _long_run.finditer(text)] if len(text) >= LONG_RUN else []
                break
        rest, at, out = self._looking if crowded else self._core, 0, []
        for start, end in runs:
            if crowded:
                out.append(rest.encode_to_tiktoken_buffer(text[at:start], set()))
                at = start
            end -= end < len(text)
            out.append(self._core.encode_to_tiktoken_buffer(text[at:end], set()))
            at = end
        return [*out, rest.encode_to_tiktoken_buffer(text[at:], set())]

    def raw(self, text: str, spaced: bool = True) -> bytes:
        """Ids as little-endian 32-bit numbers. spaced: whether the text may hold white space next to white space."""
        if self._split is None or not any(x in text for x in self.added):
            return b"".join(self._plain(text, spaced))
        parts = enumerate(self._split.split(text))
        return b"".join(x for k, part in parts for x in ([self.added[part].to_bytes(4, "little")] if k % 2 else self._plain(part, spaced)))

    def raws(self, texts: list[str]) -> Iterator[bytes]:
        """raw() of each text."""
        return map(self.raw, texts, pc.match_substring_regex(pa.array(texts, pa.large_string()), f"[{SPACES_RE2}]{{2}}").to_pylist())

    def __call__(self, text: str) -> list[int]:
        return np.frombuffer(self.raw(text), dtype="<u4").tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _cut(batches: Iterator[pd.DataFrame], path: str, window: int) -> Iterator[pd.DataFrame]:
    """Token ids of each document as pieces; whole windows already have their sequence, others -1."""
    columns = [c.split()[0] for c in RAW.split(", ")]
    encode = encoder(path)
    end = END_ID.to_bytes(4, "little")
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33
    for batch in batches:
        rows, size = [], 0
        for doc, no_id, ids in zip(batch["doc_id"], batch["no_id"], encode.raws([x or "" for x in batch["text"]]), strict=True):
            ids += end
            n = len(ids) // 4
            whole = n - n % window
            for at in range(0, whole, window):
                rows.append((doc, no_id, at, window, n, ids[4 * at : 4 * (at + window)], sequence * 2))
                sequence += 1
            if whole < n:
                rows.append((doc, no_id, whole, n - whole, n, ids[4 * whole :], -1))
            size += n
            if size > 2_000_000:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Units that hold each id, units and ids: one partial table for each task."""
    count, units, total = np.zeros(1 << 17, dtype=np.int64), 0, 0
    for batch in batches:
        for raw in batch["ids"]:
            ids = np.frombuffer(raw, dtype="<u4")
            own = np.unique(ids)
            if own[-1] >= len(count):
                count = np.concatenate([count, np.zeros(int(own[-1]) + 1, dtype=np.int64)])
            count[own] += 1
            units, total = units + 1, total + len(ids)
    seen = np.flatnonzero(count)
    yield pd.DataFrame({"term": np.concatenate([[-2, -1], seen]), "n": np.concatenate([[total, units], count[seen]])})


def sketch(ids: np.ndarray, races: np.ndarray) -> list[int]:
    """The term that wins each race: the chance that two units share it is what they have in common, by weight of terms."""
    own = np.unique(ids)
    return own[races[:, own].argmin(axis=1)].tolist()


def races(idf: np.ndarray, n: int = 2) -> np.ndarray:
    """Times of all terms in n races, by hash; the heavier a term (its idf squared), the sooner it is likely to be there."""
    terms = np.arange(len(idf), dtype=np.uint64)
    drawn = [(mix64(terms * np.uint64(2) + np.uint64(1) + mix64(np.array([k + 1], dtype=np.uint64))) >> np.uint64(11)).astype(float) / 2**53 for k in range(n)]
    return -np.log(np.maximum(drawn, 1e-300)) / np.maximum(idf, 1e-6) ** 2


def _sketched(batches: Iterator[pd.DataFrame], idf: np.ndarray) -> Iterator[pd.DataFrame]:
    times = races(idf)
    for batch in batches:
        won = [sketch(np.frombuffer(x, dtype="<u4"), times) for x in batch["ids"]]
        yield batch.assign(near=[x[0] for x in won], near_2=[x[1] for x in won])


class Shard:
    """BM25 over the units of one shard; units leave it as windows use them.

    Postings of terms that many units hold are dense rows, whose part of all scores is one product; the others are lists.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, docs, weights = [], [], []
        self.query: list[np.ndarray] = []
        for k, own in enumerate(ids):
            term, tf = np.unique(own, return_counts=True)
            weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B_LEN + B_LEN * len(own) / mean))
            terms.append(term)
            docs.append(np.full(len(term), k))
            weights.append(weight)
            self.query.append(term)  # a seed asks with all its distinct terms
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        term, self.docs, self.weights = term[order], np.concatenate(docs)[order], np.concatenate(weights)[order]
        bounds = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        self.begin, self.count = bounds[:-1], np.diff(bounds)
        common = np.flatnonzero(self.count * DENSE >= len(ids))
        self.row = np.full(len(self.count), -1)
        self.row[common] = np.arange(len(common))
        dense, asks = np.zeros((len(common), len(ids)), dtype=np.float32), np.zeros((len(ids), len(common)), dtype=np.float32)
        at = self.row[term] >= 0
        dense[self.row[term[at]], self.docs[at]] = self.weights[at]
        asks[self.docs[at], self.row[term[at]]] = 1
        self.common = asks @ dense  # of each seed with each unit
        self.column, self.unit = np.arange(len(ids)), np.arange(len(ids))  # units and their places in the postings
        self.unused = np.ones(len(ids), dtype=bool)
        self.left = len(ids)

    def use(self, unit: int) -> None:
        """Takes a unit out; once half of the units are gone, out of the postings too."""
        self.unused[self.column[unit]] = False
        self.left -= 1
        if 2 * self.left < len(self.unit) and len(self.unit) > 64:
            column, stays = np.cumsum(self.unused) - 1, self.unused[self.docs]
            before = np.concatenate([[0], np.cumsum(stays)])
            self.begin, self.count = before[self.begin], before[self.begin + self.count] - before[self.begin]
            self.docs, self.weights = column[self.docs[stays]], self.weights[stays]
            self.common, self.unit = self.common[:, self.unused], self.unit[self.unused]
            self.column[self.unit] = np.arange(len(self.unit))
            self.unused = self.unused[self.unused]

    def scores(self, seed: int) -> np.ndarray:
        """Of the units still in the postings (self.unit); used ones have 0."""
        q = self.query[seed]
        rare = q[self.row[q] < 0]
        at = concat_ranges(self.begin[rare], self.count[rare])
        score = self.common[seed] + np.bincount(self.docs[at], weights=self.weights[at], minlength=len(self.unused))
        score[~self.unused] = 0
        return score

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused units that share a term with the seed, best first; ties by place in the shard."""
        score = self.scores(seed)
        found = np.flatnonzero(score)
        return self.unit[found[np.argsort(-score[found], kind="stable")]]


def fill(ids: list[np.ndarray], idf: np.ndarray, mean: float, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (unit, from, to) over the units of one shard."""
    if not ids:
        return
    shard = Shard(ids, idf, mean)
    sizes = np.array([len(x) for x in ids])
    waiting = list(range(len(ids)))  # in order, for seeds and for windows whose neighbours run out
    heapq.heapify(waiting)
    used = np.zeros(len(ids), dtype=bool)

    def next_unused() -> int | None:
        while waiting and used[waiting[0]]:
            heapq.heappop(waiting)
        return waiting[0] if waiting else None

    def use(k: int) -> None:
        used[k] = True
        shard.use(k)

    rest: tuple[int, int, int] | None = None
    while True:
        if rest is None:
            if (seed := next_unused()) is None:
                return
            use(seed)
            rest = (seed, 0, int(sizes[seed]))
        own, room = [rest], window - (rest[2] - rest[1])
        seed, rest, too_long = rest[0], None, None
        if room > 0:
            score, units = shard.scores(seed), shard.unit
            size = sizes[units]
            while room > 0:
                k = int(np.where(size <= room, score, 0).argmax())  # the best that fits
                if not score[k] or size[k] > room:
                    break
                score[k] = 0
                own.append((int(units[k]), 0, int(size[k])))
                use(own[-1][0])
                room -= own[-1][2]
            if room > 0 and score.any():
                too_long = int(units[score.argmax()])
        while room > 0 and (too_long is not None or (too_long := next_unused()) is not None):
            k, too_long = too_long, None
            take = min(room, int(sizes[k]))
            use(k)
            own.append((k, 0, take))
            room -= take
            if take < sizes[k]:
                rest = (k, take, int(sizes[k]))
        if not room:
            yield own
            continue
        total = window - room  # the shard is empty: sequences whose lengths are powers of two
        power = 1 << (total.bit_length() - 1)
        out, left = [], power
        for k, a, b in own:
            while a < b:
                take = min(left, b - a)
                out.append((k, a, a + take))
                a, left, total = a + take, left - take, total - take
                if not left:
                    yield out
                    out, left = [], 1 << (total.bit_length() - 1) if total else 0
        return


def _pack(batches: Iterator[pd.DataFrame], idf: np.ndarray, mean: float, window: int) -> Iterator[pd.DataFrame]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 33

    columns = [c.split()[0] for c in PIECES.split(", ")]

    def work(units: pd.DataFrame) -> Iterator[pd.DataFrame]:
        nonlocal sequence
        ids = [np.frombuffer(x, dtype="<u4") for x in units["ids"]]
        docs, no_id, starts, whole = (units[c].tolist() for c in ("doc_id", "no_id", "start", "doc_tokens"))
        rows = []
        for pieces in fill(ids, idf, mean, window):
            at = 0
            for k, a, b in pieces:
                rows.append((docs[k], no_id[k], starts[k] + a, b - a, whole[k], ids[k][a:b].tobytes(), sequence * 2 + 1, at))
                at += b - a
            sequence += 1
        for k in range(0, len(rows), 2000):
            yield pd.DataFrame(rows[k : k + 2000], columns=columns)

    held, n = [], 0
    for batch in batches:
        while len(batch):
            part = batch[: SHARD_UNITS - n]
            batch = batch[len(part) :]
            held.append(part)
            n += len(part)
            if n == SHARD_UNITS:
                yield from work(pd.concat(held))
                held, n = [], 0
    if held:
        yield from work(pd.concat(held))


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset); ids are little-endian 32-bit numbers.

    docs needs doc_id and text. vocabulary is the path of a byte-level BPE. Memory of a task: one shard's units.
    """
    path = vocabulary or default_vocabulary()
    raw = durable(rows_of(docs).mapInPandas(lambda batches: _cut(batches, path, window), RAW))
    units = raw.where("sequence_id < 0").select("doc_id", "no_id", "start", "doc_tokens", "ids")
    # One number for each id of the vocabulary, which bounds what the driver gets.
    seen = dict(units.select("ids").mapInPandas(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    n_units, total = seen.pop(-1, 0), seen.pop(-2, 0)
    df = np.zeros(max(seen, default=0) + 1)
    df[list(seen)] = list(seen.values())
    idf = np.log1p((n_units - df + 0.5) / (df + 0.5))
    mean = max(1.0, total / max(1, n_units))
    parts = max(1, -(-n_units // (SHARD_UNITS * 3 // 4)), -(-total * 4 // 24_000_000))
    near = units.mapInPandas(lambda batches: _sketched(batches, idf), "doc_id long, no_id boolean, start long, doc_tokens long, ids binary, near long, near_2 long")
    order = ("near", "near_2", "doc_id", "start")
    dealt = near.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = dealt.drop("near", "near_2").mapInPandas(lambda batches: _pack(batches, idf, mean, window), PIECES)
    alone = raw.where("sequence_id >= 0").select("doc_id", "no_id", "start", "length", "doc_tokens", "ids", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed).select(own_id(), "start", "length", "doc_tokens", "ids", "sequence_id", "offset")


def op1(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
