"""Sources and the state store: tables in, rules and tasks out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, limit: int = 0, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.limit(limit) if limit > 0 else df


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One row of comma-separated numbers a line."""
    return spark.read.text(path).select(F.transform(F.split("value", ","), lambda x: x.try_cast("double")).alias("vector"))


def live(df: DataFrame, flag: str) -> DataFrame:
    """Rows that aren't marked as deleted."""
    return df.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def first_rows(df: DataFrame, key: str, rows: int = -1, share: float | None = None) -> DataFrame:
    """The first rows by key, or a share of them rounded up; -1: all."""
    if share is not None:
        rows = -(-int(df.count() * share * 1_000_000) // 1_000_000)
    return df if rows < 0 else df.orderBy(key).limit(rows)


def rows_where(df: DataFrame, keys: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of the rows whose key is listed."""
    return df.join(keys.select(key).distinct(), key, "left_semi").select(*columns)


def rows_between(df: DataFrame, key: str, offset: int, limit: int, columns: list[str] | None = None) -> DataFrame:
    """limit rows by key after the first offset ones."""
    return df.orderBy(key).offset(offset).limit(limit).select(*(columns or df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with a header."""
    df.write.option("header", True).mode("overwrite").csv(path)


def write_derived(ids: DataFrame, path: str) -> None:
    """Keeps a derived column (key, ids) for later runs."""
    ids.write.mode("overwrite").parquet(path)


def read_derived(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def in_batches(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A scan with a callback: run gets every Arrow batch where its partition is; nothing passes through the driver."""
    return df.mapInPandas(lambda batches: map(run, batches), schema)


class Store:
    """Tasks and rules as Parquet tables under a root folder; names are ids, a task is deleted by a later mark."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _add(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def save(self, task: str, support: float, confidence: float, state) -> None:
        for kind in ("minimal", "pruned", "samples"):
            rules = [(task, json.dumps(r.lhs), r.rhs, r.support, r.confidence, str(r)) for r in getattr(state, kind)]
            self._add(kind, rows=rules, schema="task string, lhs string, rhs string, support double, confidence double, ree string")
        self._add("counts", [(task, json.dumps(sorted(s)), f) for s, f in state.counts.items()], "task string, columns string, squares long")
        self._add("tasks", [(task, support, confidence, json.dumps(state.columns), state.rows, time.time_ns(), False)], "task string, support double, confidence double, columns string, n_rows long, at long, deleted boolean")

    def delete(self, support: float, confidence: float) -> None:
        gone = self.tasks().where((F.col("support") == support) & (F.col("confidence") == confidence)).collect()
        self._add("tasks", [(r["task"], r["support"], r["confidence"], r["columns"], r["n_rows"], time.time_ns(), True) for r in gone], "task string, support double, confidence double, columns string, n_rows long, at long, deleted boolean")

    def exists(self) -> bool:
        """Whether a task was ever stored."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tasks")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def tasks(self) -> DataFrame:
        last = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("at")))
        return self.spark.read.parquet(f"{self.root}/tasks").withColumn("k", last).where("k = 1 and not deleted").drop("k")

    def latest(self) -> DataFrame:
        return self.tasks().orderBy(F.desc("at")).limit(1)

    def state(self, task: str):
        """The whole state of a stored task: counts, rules, pruned nodes and samples."""
        from rulesmith.plans.lattice import Mined, State

        row = self.tasks().where(F.col("task") == task).first()
        held = lambda name: self.spark.read.parquet(f"{self.root}/{name}").where(F.col("task") == task).collect()
        rules = {kind: [Mined(tuple(json.loads(r["lhs"])), r["rhs"], r["support"], r["confidence"]) for r in held(kind)] for kind in ("minimal", "pruned", "samples")}
        return State(json.loads(row["columns"]), row["n_rows"], {frozenset(json.loads(r["columns"])): r["squares"] for r in held("counts")}, **rules)
