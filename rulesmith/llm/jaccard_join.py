"""N-gram Jaccard join by signature trees.

1. Each text becomes its set of hashed word shingles; equal sets are one class, and the rest works on classes.
2. A linked partner holds all but a share of a set's shingles, so the first shingle that two linked sets have in
   common, in any fixed order, is among the first few of both. The order puts shingles rarest first by a table of
   counts over all documents; the table has a fixed size, and what it merges changes the order only. Classes that
   share a leading shingle and are near in size are a group; groups of the same members are one. This loses no link.
3. In each group, blocks of a bounded number of classes are put into signature trees: every node has the OR of the
   token bitmaps below it, the least number of bits of one set and the range of set sizes. Two trees are traversed
   together; a pair of nodes is left when the largest possible overlap is under what their least sizes need, or when
   all that stands below both is linked already. What the bitmaps can't part is one cluster.
4. In each cluster the same trees are traversed with the sets themselves at the leaves, where pairs are compared exactly.

Groups and clusters of several blocks go on after the blocks: neighbouring blocks first; then what is outside the
largest component against all blocks. Near copies are one component after the first step, so the work grows with
their number; only a large group that stays in pieces needs all its block pairs.

Shingles and classes are told apart by 64-bit hashes.

Defined results: null, empty and white texts have no shingles and link with nothing; a text of fewer words than a
shingle is one shingle; repeated rows, and rows that share an id, each get their result; a null id is in no minimum;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import WORD, WORD_BYTES, counted, durable, fresh, mix64, own_id, row_hash, rows_of, shuffle_width
from .graph import Links, components

BLOCK = 128
LEAF = 8
FAN = 4
#: A set of n shingles has a token bitmap of 4n to 8n bits, a power of two, of these at least and at most.
LEAST_BITS, MOST_BITS = 512, 1 << 20
#: Counters of the order, and slices of their table.
COUNTERS, SLICES = 1 << 20, 16
#: Leading shingles in one bucket, about.
BUCKET = 1_000_000
#: Rows of two numbers that are broadcast, at most; more of them are joined by a shuffle.
SMALL = 100_000
FOUND = "kind int, bucket int, doc_id long, no_id boolean, row binary, n long, fp long, bits binary, sig binary, at binary, fps binary, sizes binary"
ROUTED = "kind int, doc_id long, no_id boolean, row binary, n long, fp long, bits binary"


class _Words(dict):
    """Hashes of words; forgets all of them rather than grow without bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_hash_of = _Words()
_find = re.compile(WORD_BYTES).findall


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, of A-Z in lower case."""
    found = _find(text.encode("utf-8", "surrogatepass").lower()) if text else []
    n = len(found)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, found), dtype=np.uint64, count=n)
    width = min(n, words)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k])
    return np.unique(out)


def fingerprint(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _counts(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Documents that hold a shingle, by COUNTERS hashed counters, in slices."""
    held = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for text in batch["text"]:
            np.add.at(held, (shingles(text, words) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64), 1)
    for k, part in enumerate(held.reshape(SLICES, -1)):
        if part.any():
            yield pd.DataFrame({"slice": [k], "held": [zlib.compress(part.astype(np.min_scalar_type(part.max())).tobytes(), 1)], "wide": [np.min_scalar_type(part.max()).itemsize]})


def _classes(held: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), dtype=f"<u{wide}").astype(np.int64) for x, wide in zip(held["held"], held["wide"], strict=True))
    return pd.DataFrame({"slice": held["slice"][:1], "held": [np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()]})


def rarity(rows: DataFrame, words: int) -> np.ndarray:
    """Class of the count of each counter: one byte each, whatever the input's size."""
    parts = rows.select("text").mapInPandas(lambda x: _counts(x, words), "slice int, held binary, wide int")
    out = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.uint8)
    for k, held in parts.groupBy("slice").applyInPandas(_classes, "slice int, held binary").collect():
        out[k] = np.frombuffer(held, dtype=np.uint8)
    return out.ravel()


def leading(own: np.ndarray, per_cent: int, rare: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, so many that a linked partner holds one of them."""
    n = len(own)
    most = n + per_cent * n // -100 + 1
    if most >= n:
        return own
    key = (rare[(own >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (own & np.uint64((1 << 56) - 1))
    return own[np.argpartition(key, most - 1)[:most]]


def _signatures(sets: list[np.ndarray], per_cent: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading shingles of all sets, and the set of each."""
    if not sets:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint16)
    sig = [leading(own, per_cent, rare) for own in sets]
    return np.concatenate(sig), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in sig])


def _scan(batches: Iterator[pd.DataFrame], words: int, per_cent: int, buckets: int, rare: np.ndarray) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in FOUND.split(", ")]
    known: set[int] = set()
    turn = 0
    for batch in batches:
        for k in range(0, len(batch), 2000):
            part = batch[k : k + 2000]
            rows, sets, fps = [], [], []
            for doc, no_id, row, text in zip(part["doc_id"], part["no_id"], part["row"], part["text"], strict=True):
                own = shingles(text, words)
                fp = fingerprint(own)
                turn += 1
                new = len(own) > 0 and fp not in known
                rows.append((0, turn % buckets, doc, no_id, row, len(own), fp, bitmap(own, width_of(len(own))).to_bytes(width_of(len(own)) // 8, "big") if new else None, None, None, None, None))
                if new:
                    known.add(fp)
                    sets.append(own)
                    fps.append(fp)
            if len(known) > 1_000_000:  # copies of forgotten classes are signed again, to the same end
                known.clear()
            fps_array, sizes = np.array(fps, dtype=np.int64), np.array([len(x) for x in sets], dtype="<i4")
            sig, at = _signatures(sets, per_cent, rare)
            bucket = mix64(sig) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            sig, at = sig[order], at[order]
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in range(buckets):
                if bounds[b] < bounds[b + 1]:
                    own, place = sig[bounds[b] : bounds[b + 1]], at[bounds[b] : bounds[b + 1]]
                    used, local = np.unique(place, return_inverse=True)
                    rows.append((1, b, 0, True, None, 0, 0, None, own.astype("<u8").tobytes(), local.astype("<u2").tobytes(), fps_array[used].tobytes(), sizes[used].tobytes()))
            yield pd.DataFrame(rows, columns=columns)


def first_sizes(per_cent: int, most: int) -> np.ndarray:
    """First sizes of intervals: a set's partners are in its own interval and the two beside it."""
    out = [1]
    while out[-1] <= most:
        out.append(100 * out[-1] // per_cent + 1)
    return np.array(out)


def _members(sig: np.ndarray, fp: np.ndarray, size: np.ndarray, per_cent: int) -> np.ndarray:
    """Distinct (group, class) of the classes that share a signature and may link by their sizes.

    A group holds the sets of one interval of sizes and of the interval before; one without a set of the later interval is
    left, as the interval before has it. A group is named by what it holds.
    """
    if not len(sig):
        return np.empty((0, 2), dtype=np.int64)
    own = np.searchsorted(first_sizes(per_cent, int(size.max())), size, "right") - 1
    tag = np.concatenate([own, own + 1]).astype(np.uint64)
    late = np.concatenate([np.ones(len(own), dtype=bool), np.zeros(len(own), dtype=bool)])
    key = mix64(np.concatenate([sig, sig]) ^ mix64(tag + np.uint64(1)))
    fp = np.concatenate([fp, fp])
    order = np.lexsort((fp, key))
    key, fp, late = key[order], fp[order], late[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
    key, fp, late = key[new], fp[new], late[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(key)]]))
    with np.errstate(over="ignore"):
        names = mix64(np.add.reduceat(mix64(fp.view(np.uint64)), starts) + counts.astype(np.uint64)).view(np.int64)
    shared = np.repeat((counts > 1) & np.logical_or.reduceat(late, starts), counts)
    return np.unique(np.stack([np.repeat(names, counts)[shared], fp[shared]], axis=1), axis=0)


def _route(batches: Iterator[pd.DataFrame], per_cent: int) -> Iterator[pd.DataFrame]:
    """Passes the documents through and turns each bucket's signatures into groups (n: the group, fp: a class)."""
    held: dict[int, list] = {}
    columns = [c.split()[0] for c in ROUTED.split(", ")]
    for batch in batches:
        docs = batch[batch["kind"] == 0]
        if len(docs):
            yield docs[columns]
        rest = batch[batch["kind"] == 1]
        for b, *blobs in zip(rest["bucket"], rest["sig"], rest["at"], rest["fps"], rest["sizes"], strict=True):
            held.setdefault(b, []).append(blobs)
    for b in list(held):
        blobs = held.pop(b)
        sig = np.concatenate([np.frombuffer(x, dtype="<u8") for x, *_ in blobs])
        fp = np.concatenate([np.frombuffer(z, dtype=np.int64)[np.frombuffer(y, dtype="<u2")] for _, y, z, _ in blobs])
        size = np.concatenate([np.frombuffer(z, dtype="<i4")[np.frombuffer(y, dtype="<u2")] for _, y, _, z in blobs])
        edges = _members(sig, fp, size, per_cent)
        for k in range(0, len(edges), 50_000):
            part = edges[k : k + 50_000]
            yield pd.DataFrame({"kind": 1, "doc_id": 0, "no_id": True, "row": None, "n": part[:, 0], "fp": part[:, 1], "bits": None})


# --- signature trees ---


class Node:
    __slots__ = ("bits", "fewest", "least", "most", "below", "items")

    def __init__(self, bits, fewest, least, most, below, items):
        self.bits, self.fewest, self.least, self.most, self.below, self.items = bits, fewest, least, most, below, items


def width_of(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (4 * n - 1).bit_length()))


def bitmap(own: np.ndarray, width: int) -> int:
    """width bits (a power of two) as one integer: bit h mod width of each shingle."""
    flags = np.zeros(width, dtype=np.uint8)
    flags[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def folded(bits: int, width: int, to: int) -> int:
    """The bitmap of the same set with fewer bits."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Items:
    """Sizes, bitmaps of one width and, for exact comparison, the sets of what a task holds."""

    def __init__(self, run: dict[str, list], exact: bool):
        self.sizes = run["n"]
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in run["own"]] if exact else None
        if exact:
            width = width_of(min(self.sizes))
            self.maps = [bitmap(x, width) for x in self.sets]
        else:
            widths = [8 * len(x) for x in run["own"]]
            self.maps = [folded(int.from_bytes(x, "big"), w, min(widths)) for x, w in zip(run["own"], widths, strict=True)]
        self.fewest = [x.bit_count() for x in self.maps]

    def linked(self, a: int, b: int, per_cent: int) -> bool:
        """Whether two sets link; without the sets: whether their bitmaps allow it."""
        m, n = self.sizes[a], self.sizes[b]
        if 100 * min(m, n) < per_cent * max(m, n):
            return False
        need = -(-per_cent * (m + n) // (100 + per_cent))
        if possible((self.maps[a] & self.maps[b]).bit_count(), self.fewest[a], m, self.fewest[b], n) < need:
            return False
        return self.sets is None or m + n - len(np.union1d(self.sets[a], self.sets[b])) >= need


def tree(members: list[int], items: Items) -> Node:
    """Leaves of LEAF sets, neighbours by size and bitmap; nodes of FAN nodes."""
    members = sorted(members, key=lambda k: (items.sizes[k], items.maps[k]))
    level = []
    for at in range(0, len(members), LEAF):
        own = members[at : at + LEAF]
        bits = 0
        for k in own:
            bits |= items.maps[k]
        level.append(Node(bits, min(items.fewest[k] for k in own), items.sizes[own[0]], items.sizes[own[-1]], None, own))
    while len(level) > 1:
        up = []
        for at in range(0, len(level), FAN):
            own = level[at : at + FAN]
            bits = 0
            for x in own:
                bits |= x.bits
            up.append(Node(bits, min(x.fewest for x in own), own[0].least, own[-1].most, own, [k for x in own for k in x.items]))
        level = up
    return level[0]


def possible(bits: int, fewest_a: int, most_a: int, fewest_b: int, most_b: int) -> int:
    """Largest overlap of two sets, by the bits that both may have: each bit that only one has is a shingle outside."""
    return min(most_a - max(0, fewest_a - bits), most_b - max(0, fewest_b - bits))


def traverse(p: Node, q: Node, items: Items, labels, links: Links, per_cent: int) -> None:
    """Links between what stands below p and below q (p may be q)."""
    todo = [(p, q)]
    while todo:
        p, q = todo.pop()
        if 100 * min(p.most, q.most) < per_cent * max(p.least, q.least):
            continue
        need = -(-per_cent * (p.least + q.least) // (100 + per_cent))
        if p is not q and possible((p.bits & q.bits).bit_count(), p.fewest, p.most, q.fewest, q.most) < need:
            continue
        roots = {links.root(labels[k]) for k in p.items}
        if len(roots) == 1 and {links.root(labels[k]) for k in q.items} == roots:
            continue
        if p.below is None and q.below is None:
            for i, a in enumerate(p.items):
                for b in p.items[i + 1 :] if p is q else q.items:
                    if links.root(labels[a]) != links.root(labels[b]) and items.linked(a, b, per_cent):
                        links.join(labels[a], labels[b])
        elif p is q:
            todo += [(x, y) for i, x in enumerate(p.below) for y in p.below[i:]]
        elif q.below is None or (p.below is not None and len(p.items) >= len(q.items)):
            todo += [(x, q) for x in p.below]
        else:
            todo += [(p, x) for x in q.below]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, list]]:
    """Runs of equal keys in sorted input, as lists by column; holds one batch and one run."""
    held: dict[str, list] | None = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = {c: batch[c].tolist() for c in batch.columns}
        change = np.zeros(n, dtype=bool)
        for c in keys:
            x = batch[c].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            run = {c: x[a:b] for c, x in columns.items()}
            if held is not None and all(held[c][-1] == run[c][0] for c in keys):
                held = {c: held[c] + run[c] for c in run}
                continue
            if held is not None:
                yield held
            held = run
    if held is not None:
        yield held


def _once(run: dict[str, list]) -> dict[str, list]:
    """The first row of each class."""
    seen: set[int] = set()
    keep = [k for k, x in enumerate(run["fp"]) if not (x in seen or seen.add(x))]
    return run if len(keep) == len(run["fp"]) else {c: [x[k] for k in keep] for c, x in run.items()}


LOCAL = "fp long, label long, n long, root long, blocks long, block long, own binary"


def _within(batches: Iterator[pd.DataFrame], per_cent: int, exact: bool) -> Iterator[pd.DataFrame]:
    """Every class of a block with a label: its links are those of one tree with itself."""
    columns = [c.split()[0] for c in LOCAL.split(", ")]
    held: dict[str, list] = {c: [] for c in columns}
    for run in _groups(batches, ["root", "block"]):
        run = _once(run)
        labels = run["fp"]
        links = Links(labels)
        if len(labels) > 1:
            items = Items(run, exact)
            top = tree(list(range(len(labels))), items)
            traverse(top, top, items, labels, links, per_cent)
        run["label"] = [links.root(x) for x in labels]
        run["own"] = [x if n > 1 else None for x, n in zip(run["own"], run["blocks"], strict=True)]
        for c in columns:
            held[c] += run[c]
        if len(held["fp"]) > 2000:
            yield pd.DataFrame(held)
            held = {c: [] for c in columns}
    if held["fp"]:
        yield pd.DataFrame(held)


def _across(batches: Iterator[pd.DataFrame], per_cent: int, exact: bool) -> Iterator[pd.DataFrame]:
    """(a, b): labels linked by sets of side 0 and side 1."""
    for run in _groups(batches, ["root", "i", "j"]):
        labels, sides = run["label"], run["side"]
        left, right = ([k for k, s in enumerate(sides) if s == side] for side in (0, 1))
        if left and right:
            items, links = Items(run, exact), Links(labels)
            traverse(tree(left, items), tree(right, items), items, labels, links, per_cent)
            if links.found:
                yield pd.DataFrame(links.found, columns=["a", "b"])


def _sets(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        own = [shingles(x, words) for x in batch["text"]]
        same = [fingerprint(x) == fp if len(x) else False for x, fp in zip(own, batch["fp"], strict=True)]
        out = batch[["root", "blocks", "block", "fp"]].assign(n=[len(x) for x in own], own=[x.tobytes() for x in own])
        yield out[np.array(same, dtype=bool)]


def _linked(blocks: DataFrame, width: int, per_cent: int, exact: bool) -> DataFrame:
    """(root, fp, label) of blocks (root, blocks, block, fp, n, own); equal labels in a root: reachable by links."""
    dealt = blocks.repartition(width, "root", "block").sortWithinPartitions("root", "block")
    seen = Observation()
    local = durable(dealt.mapInPandas(lambda x: _within(x, per_cent, exact), LOCAL).observe(seen, F.count_if(F.col("blocks") > 1).alias("n")))
    n = seen.get["n"]
    large = local.where("blocks > 1")
    if not n:
        return local.select("root", "fp", "label")
    across = lambda pairs: pairs.repartition(width, "root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(lambda x: _across(x, per_cent, exact), "a long, b long")
    side = lambda rows, s, i, j: rows.select("root", F.lit(s).alias("side"), i.alias("i"), j.alias("j"), "label", "n", "own")
    # Neighbouring blocks.
    chain = side(large.where("block < blocks - 1"), 0, F.col("block"), F.col("block") + 1).unionByName(side(large.where("block > 0"), 1, F.col("block") - 1, F.col("block")))
    relabel = lambda rows, by: rows.join(by.select(F.col("node").alias("label"), F.col("root").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    large = durable(relabel(large, components(across(chain))))
    # Then what isn't in its cluster's largest component, against all of the cluster.
    sizes = large.groupBy("root", "label").agg(F.count("*").alias("m"))
    of_root = sizes.groupBy("root").agg(F.max(F.struct("m", "label"))["label"].alias("top"), F.sum("m").alias("all"), F.max("m").alias("most"), F.count("*").alias("pieces"))
    pieces, n = _small(of_root.where("pieces > 1").select("root", "top", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long").alias("asks")))
    if n:
        split = large.join(pieces, "root")
        asking = split.where("label <> top").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("asks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        asked = split.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
        pairs = side(asking, 0, F.col("i"), F.col("j")).unionByName(side(asked, 1, F.col("i"), F.col("j")))
        large = relabel(large, components(across(pairs)))
    return local.where("blocks = 1").select("root", "fp", "label").unionByName(large.select("root", "fp", "label"))


def _small(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with their number, to be broadcast if they are SMALL at most."""
    out, n = counted(rows)
    return (F.broadcast(out) if n <= SMALL else out), n


def _blocked(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows of a root with their block and the root's number of blocks; roots: the root of each row."""
    large, _ = _small(roots.groupBy("root").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK).select("root", F.ceil(F.col("held") / BLOCK).cast("long").alias("blocks")))
    return rows.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))


def _candidates(members: DataFrame, maps: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link: what the bitmaps of a group's trees can't part."""
    grouped = members.join(maps, "fp").select(F.col("name").alias("root"), "fp", "n", "own")
    return _linked(_blocked(grouped, members.select(F.col("name").alias("root"))), width, per_cent, False).where("fp <> label").select(F.col("fp").alias("a"), F.col("label").alias("b"))


def classified(docs: DataFrame, words: int, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, n_shingles, fp) of each row, and (fp, first, label) of each class of equal sets; equal labels: reachable by links."""
    rows = rows_of(docs)
    rows = rows.withColumn("row", row_hash(own_id(), F.col("text")))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(docs)
    buckets = int(max(width, size / 6 * (100 - per_cent) / 100 // BUCKET))
    rare = rarity(rows, words)
    scanned = rows.mapInPandas(lambda x: _scan(x, words, per_cent, buckets, rare), FOUND)
    found = durable(scanned.repartition(buckets, "bucket").mapInPandas(lambda x: _route(x, per_cent), ROUTED))
    perdoc = found.where("kind = 0").select(own_id(), "row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("fp")).alias("fp"))
    members = found.where("kind = 1").select(F.col("n").alias("name"), "fp").distinct()
    maps = found.where("bits is not null").groupBy("fp").agg(F.max("n").alias("n"), F.max("bits").alias("own"))
    clusters = durable(components(_candidates(members, maps, width, per_cent)).select(F.col("node").alias("fp"), "root"))
    firsts = perdoc.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    wanted = _blocked(clusters, clusters).join(firsts, "fp")
    texts = rows.select(own_id().alias("own"), "text").join(wanted, F.col("own").eqNullSafe(F.col("first")))
    blocks = texts.select("root", "blocks", "block", "fp", "text").mapInPandas(lambda x: _sets(x, words), "root long, blocks long, block long, fp long, n long, own binary")
    linked = _linked(blocks, width, per_cent, True).select("fp", "label")
    return perdoc, firsts.join(linked, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def jaccard_components(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; component_id: the smallest id reachable by links.

    docs needs doc_id and text; two texts link at 100 * intersection >= per_cent * union of their shingle sets.
    """
    perdoc, classes = classified(docs, words, per_cent)
    smallest = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    by_class = classes.join(smallest, "label").select("fp", "component_id")
    return perdoc.join(by_class, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def without_copies(docs: DataFrame, words: int = 5, per_cent: int = 80) -> DataFrame:
    """docs with one row of each group of links: the one of least id (null ids last), then of least hash of id and text.

    Rows without words link with nothing and all stay. Rows are told apart by id and text together, so a row stays
    whose id stands on a copy as well. All columns stay.
    """
    perdoc, classes = classified(docs, words, per_cent)
    own = perdoc.where("fp is not null").groupBy("fp", "row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n")).alias("least")
    kept = own.groupBy("fp").agg(least).join(classes.select("fp", "label"), "fp").groupBy("label").agg(F.min("least").alias("least"))
    row, stays, rows = fresh(docs, "row", "stays", "rows")
    stay = kept.select(F.col("least")["row"].alias(row), F.lit(True).alias(stays), F.col("least")["n"].alias(rows))
    marked = docs.withColumn(row, row_hash(F.col("doc_id").cast("long"), F.col("text"))).join(stay, row, "left")
    wordless = ~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    single = marked.where(wordless | (F.col(stays) & (F.col(rows) == 1))).select(*docs.columns)
    repeated = marked.where(~wordless & F.col(stays) & (F.col(rows) > 1)).groupBy(row).agg(F.first(F.struct(*docs.columns)).alias(stays))
    return single.unionByName(repeated.select(f"{stays}.*"))


def op2(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs, words=3, per_cent=90)
