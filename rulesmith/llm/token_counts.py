"""Token counts as delta-maintained rollups.

A batch holds changes of documents: inserts (no old count), deletes (no new count) and revised counts (both). It is folded to
signed sums by source, language and tokenizer version, written aside and renamed into place; a batch that is already
there is left alone, so a batch that runs again, or whose first run died half-way, counts once. Compaction adds batches up to a
base and names them in it; totals are the latest base and the batches that it doesn't name, so they cost as much as there was since.
Old files are left for readers that began before; prune() takes them away, and a batch that a base names stays committed.

Defined results: null sources and languages are groups of their own; a null or empty text counts no tokens; repeated
rows count as often as they occur; an empty batch commits and adds nothing; totals without batches are empty; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, durable, own_id, shared_folder
from .packing import default_vocabulary, encoder

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
BASE = f"{TOTALS}, batch string"
_words = re.compile(WORD_BYTES).findall


def counter(tokenizer: str):
    """Counts tokens: `words`, or `bpe:<path of a byte-level BPE>`."""
    if tokenizer == "words":
        return lambda text: len(_words(text.encode("utf-8", "surrogatepass")))
    encode = encoder(tokenizer.removeprefix("bpe:"))
    return lambda text: len(encode(text))


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_hash"), text.alias("text"))


def _counted(rows: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """rows once for each tokenizer, with tokenizer and n instead of their text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = {name: counter(kind) for name, kind in tokenizers.items()}
        for batch in batches:
            for name, own in counters.items():
                yield batch.drop(columns="text").assign(tokenizer=name, n=[own(x) if x else 0 for x in batch["text"]])

    kept = rows.drop("text")
    out = rows.select(*kept.columns, "text").mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in kept.dtypes) + ", tokenizer string, n long")
    return out.select(own_id(), *[c for c in out.columns if c not in ("doc_id", "no_id")])


def count(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, text_hash, tokenizer, n) of docs; tokenizers: version to kind."""
    return _counted(_rows(docs), tokenizers)


class Rollup:
    """Totals under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _place(self, rows: DataFrame, folder: str, name: str) -> bool:
        """Writes rows aside and renames them into place, unless something is there."""
        fs, target, aside = self._fs(), self._path(f"{self.root}/{folder}/{name}"), f"{self.root}/aside/{uuid4().hex}"
        rows.write.parquet(aside)
        fs.mkdirs(self._path(f"{self.root}/{folder}"))
        if fs.exists(target) or not fs.rename(self._path(aside), target):
            fs.delete(self._path(aside), True)
            return False
        return True

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base and the batches in it; both come from one rename."""
        bases = self._names("bases")
        if not bases:
            return None, set()
        held = self.spark.read.schema(BASE).parquet(f"{self.root}/bases/{bases[-1]}/part-*.parquet")
        return bases[-1], {r[0] for r in held.where("batch is not null").select("batch").collect()}  # names of batches, no rows of theirs

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds changes (source, lang, tokenizer, old, new) as a batch; False if it is there already."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError(f"not a batch name: {batch}")
        if batch in self._names("batches") or batch in self._base()[1]:
            return False
        signed = changes.groupBy(*KEYS).agg(F.sum(F.col("new").isNotNull().cast("long") - F.col("old").isNotNull().cast("long")).alias("n_docs"), F.sum(F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("n_tokens"))
        return self._place(signed, "batches", batch)

    def _since(self, base: str | None, within: set[str], batches: list[str]) -> DataFrame:
        """Totals of a base and of the batches that it doesn't name."""
        out = self.spark.createDataFrame([], TOTALS)
        if base:
            out = out.unionByName(self.spark.read.schema(BASE).parquet(f"{self.root}/bases/{base}/part-*.parquet").where("batch is null").drop("batch"))
        # Only files right below a batch: a folder that a late rename put inside one isn't read.
        if rest := [f"{self.root}/batches/{x}/part-*.parquet" for x in batches if x not in within]:
            out = out.unionByName(self.spark.read.schema(TOTALS).parquet(*rest))
        return out.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); groups that are back at no documents are left out."""
        return self._since(*self._base(), self._names("batches"))

    def compact(self) -> str | None:
        """Adds all batches up to a new base; its name, or None if another run was first or nothing is new."""
        base, within = self._base()
        batches = self._names("batches")
        if not set(batches) - within:
            return None
        named = self.spark.createDataFrame([(None, None, None, None, None, x) for x in sorted({*within, *batches})], BASE)
        name = f"{int(base or 0) + 1:012d}"
        return name if self._place(self._since(base, within, batches).withColumn("batch", F.lit(None).cast("string")).unionByName(named), "bases", name) else None

    def prune(self) -> None:
        """Deletes older bases and the batches that the latest base names; for times without readers."""
        base, within = self._base()
        for folder, names in (("bases", [x for x in self._names("bases") if x != base]), ("batches", [x for x in self._names("batches") if x in within])):
            for name in names:
                self._fs().delete(self._path(f"{self.root}/{folder}/{name}"), True)


def trimmed(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, text_hash, tokenizer, old, new) of the rows whose text has white space at its ends: counts with and without it."""
    cut = F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    both = F.array(F.struct(F.lit("old").alias("which"), F.col("text").alias("text")), F.struct(F.lit("new").alias("which"), cut.alias("text")))
    rows = _rows(docs).where(cut != F.col("text")).select("doc_id", "no_id", "source", "lang", "text_hash", F.inline(both))
    of = lambda which: F.sum(F.when(F.col("which") == which, F.col("n"))).alias(which)
    return _counted(rows, tokenizers).groupBy("doc_id", "source", "lang", "text_hash", "tokenizer").agg(of("old"), of("new"))


def op7(docs: DataFrame) -> DataFrame:
    """Loads all documents under two tokenizers, takes out every exact copy but the one of smallest id, compacts, and revises the
    counts of what is left to those without white space at both ends of a text."""
    spark = docs.sparkSession
    tokenizers = {"words-1": "words", "byte_bpe_50k-1": f"bpe:{default_vocabulary()}"}
    counts = durable(count(docs, tokenizers))
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid4().hex}")
    load = counts.select(*KEYS, F.lit(None).cast("long").alias("old"), F.col("n").alias("new"))
    rollup.commit("load", load)
    # Cut off here, so that the joins below deal out rows by text only, and Spark can split the rows of one text.
    first = durable(counts.groupBy("text_hash", "tokenizer").agg(F.min("doc_id").alias("first")))
    copies = counts.join(first, ["text_hash", "tokenizer"]).where("doc_id > first").select(*KEYS, F.col("n").alias("old"), F.lit(None).cast("long").alias("new"))
    rollup.commit("copies", copies)
    rollup.compact()
    rollup.commit("load", load)  # a batch that comes again changes nothing
    left = trimmed(docs, tokenizers).join(first, ["text_hash", "tokenizer"]).where("doc_id is null or doc_id = first")
    rollup.commit("trimmed", left.select(*KEYS, "old", "new"))
    return rollup.totals()
