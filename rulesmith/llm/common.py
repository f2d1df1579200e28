"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only in local mode, where none is set (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or f"/tmp/checkpoints/{context.applicationId}")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df with its lineage cut into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df with its lineage cut, and its number of rows from the same job."""
    seen = Observation()
    out = durable(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Evaluate value once per row and hand it to body as a bound variable (higher-order functions only)."""
    return F.transform(F.array(value), body)[0]


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def concat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then the same for the next."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, no_id and text of docs. pandas turns whole numbers beside nulls into floats, so no_id tells a null id."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.col("text").cast("string").alias("text"))


def own_id() -> Column:
    """The id that rows_of took apart."""
    return F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")


def row_hash(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text: rows that have both in common are the same row, whatever stands beside them."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))
