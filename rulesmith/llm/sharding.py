"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The shards are cut into cells of a bounded number of rows, whose sizes are exact beforehand. Row v of the matrix says how
many rows of input partition v go to each cell. The matrix has the law it has under a uniform permutation: halves of the
partitions are split again and again, and how many rows of each cell come from the first half is drawn from the multivariate
hypergeometric law. Every split has a seed of its own, so each task draws its own row and nobody holds the matrix; the driver
only splits until a part has under LIMIT rows (the bound of numpy's generator). Each partition permutes its rows' cells
locally, the rows are exchanged once, and each cell permutes what it got, in ranges of its random numbers where it has many
rows. A slot is the cell's first slot plus the place in the cell, so no task sees more than a range of a cell.

Law: `rows`, counts of any two shards at most one apart. Defined results: null ids, null texts and repeated rows are
rows like others; an empty table gives no rows; all columns of the input stay, except that shard and slot replace input
columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, shuffle_width

CELL_ROWS = 5000
MAX_CELLS = 1 << 14
#: Rows from which hypergeometric numbers are drawn here rather than by numpy.
LIMIT = 10**9


def cells_each(total: int, shards: int, least: int = 1) -> int:
    """Cells of each shard: CELL_ROWS rows each, but MAX_CELLS at most (the vector that every task has) and `least` at least over all shards."""
    return max(1, min(MAX_CELLS // shards, max(-(-total // (shards * CELL_ROWS)), -(-least // shards))))


def cell_sizes(total: int, shards: int, each: int) -> np.ndarray:
    """Rows of each cell, shard after shard."""
    rows = [total // shards + (shard < total % shards) for shard in range(shards)]
    return np.array([n * (k + 1) // each - n * k // each for n in rows for k in range(each)], dtype=np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n of good + bad, by inversion around the mode: ratios of neighbours, no large factorials.

    Weights reach twelve standard deviations to each side; what is beyond is less than a double can hold beside 1.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 40 + int(12 * (n / total * good * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1)
    at = k[:-1]
    steps = np.log((good - at) / (at + 1)) + np.log((n - at) / (bad - n + at + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return int(k[min(len(k) - 1, np.searchsorted(upto, rng.random() * upto[-1], "right"))])


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows go to each cell, when `left` is what the cells still take."""
    total = int(left.sum())
    if total < LIMIT:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros_like(left)
    for k, own in enumerate(left.tolist()):
        total -= own
        out[k] = got = hypergeometric(rng, own, total, n)
        n -= got
    return out


def split(part: tuple[int, int, np.ndarray], starts: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """The two halves of a part (first partition, end, rows of each cell that come from it); its seed is its place."""
    a, b, taken = part
    mid = (a + b) // 2
    first = draw(np.random.default_rng([seed, a, b]), taken, int(starts[mid] - starts[a]))
    return [(a, mid, first), (mid, b, taken - first)]


def top_parts(starts: np.ndarray, sizes: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Parts of under LIMIT rows (or one partition), in order; starts: rows before each partition, and all rows."""
    done, todo = [], [(0, len(starts) - 1, sizes)]
    while todo:
        part = todo.pop()
        if part[1] - part[0] < 2 or int(part[2].sum()) < LIMIT:
            done.append(part)
        else:
            todo += reversed(split(part, starts, seed))
    return done


def matrix_row(v: int, parts: list[tuple[int, int, np.ndarray]], starts: np.ndarray, seed: int) -> np.ndarray:
    """Rows of partition v for each cell; the rows of all partitions add up to the cells."""
    part = next((p for p in parts if p[0] <= v < p[1]), None)
    if part is None:
        return np.zeros(0, dtype=np.int64)
    while part[1] - part[0] > 1:
        first, second = split(part, starts, seed)
        part = first if v < first[1] else second
    return part[2]


def _deal(batches: Iterator[pa.RecordBatch], parts: list, starts: np.ndarray, seed: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    v = TaskContext.get().partitionId()
    to, at = None, 0
    for batch in batches:
        if to is None:
            counts = matrix_row(v, parts, starts, seed)
            rng = np.random.default_rng([seed, v])
            to = rng.permutation(np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        n = batch.num_rows
        if at + n > len(to):
            raise RuntimeError("the input's partitions changed between two reads; write it to a table first")
        order = rng.integers(0, 1 << 62, n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n]), pa.array(order)], names=[*batch.schema.names, *names])
        at += n
    if at != (len(to) if to is not None else int(starts[v + 1] - starts[v]) if v + 1 < len(starts) else 0):
        raise RuntimeError("the input's partitions changed between two reads; write it to a table first")


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    docs must give the same rows in the same order in each partition whenever it is read, as tables and files do; write what
    comes out of a shuffle to a table first. A change of the counts is noticed and raised.
    """
    docs = docs.drop("shard", "slot")
    cell, order, sub, before = fresh(docs, "cell", "order", "sub", "before")
    # One number for each input partition, and one vector of cells for each LIMIT rows.
    found = dict(docs.select(F.spark_partition_id().alias("v")).groupBy("v").count().collect())
    starts = np.cumsum([0, *(found.get(v, 0) for v in range(max(found, default=-1) + 1))])
    total = int(starts[-1])
    each = cells_each(total, shards, 2 * shuffle_width(docs))
    sizes = cell_sizes(total, shards, each)
    parts = top_parts(starts, sizes, seed)
    schema = T.StructType([*docs.schema.fields, T.StructField(cell, T.IntegerType()), T.StructField(order, T.LongType())])
    sent = docs.mapInArrow(lambda batches: _deal(batches, parts, starts, seed, [cell, order]), schema)
    # Places in a cell go by random numbers; a cell of many rows is worked on in ranges of these, whose counts come first.
    ranges = max(1, -(-int(sizes.max()) // CELL_ROWS))
    sent = sent.withColumn(sub, F.expr(f"cast(shiftright(`{order}`, 31) * {ranges} div {1 << 31} as int)"))
    if ranges > 1:
        counts = sent.groupBy(cell, sub).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(cell).orderBy(sub).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        sent = sent.join(counts.select(cell, sub, upto.alias(before)), [cell, sub])
    else:
        sent = sent.withColumn(before, F.lit(0).cast("long"))
    place = F.col(before) + F.row_number().over(Window.partitionBy(cell, sub).orderBy(order))
    sent = sent.withColumn("shard", F.expr(f"cast(`{cell}` div {each} as int)"))
    first = F.expr(f"({total // shards} + if(shard < {total % shards}, 1, 0)) * cast(`{cell}` % {each} as bigint) div {each}")
    return sent.withColumn("slot", (first + place - 1).cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


def op5(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    out = shuffle_to_shards(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), 8)
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
