"""Blocking for similarity predicates: n-gram tokens, their order, derived columns, a Jaccard join and vector blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulesmith.functions.predicates import not_blank
from rulesmith.operators.order import running


def ngrams(df: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, token): n-grams of the padded text; the k-th repeat of a gram in a text is its own token gram_k."""
    padded = F.concat(F.lit("#" * (n - 1)), F.col(text), F.lit("#" * (n - 1)))
    grams = df.where(not_blank(F.col(text))).select(F.col(key).alias("key"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))).alias("pos", "gram"))
    nth = F.row_number().over(Window.partitionBy("key", "gram").orderBy("pos"))
    return grams.select("key", F.when(nth == 1, F.col("gram")).otherwise(F.concat("gram", F.lit("_"), (nth - 1).cast("string"))).alias("token"))


def token_freq(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("freq"))


def token_order(tokens: DataFrame, of_rows: float = 0.5) -> DataFrame:
    """(token, freq, ord): rarest first from 0; tokens of one row, or of over a share of the rows (over two tables together: 0.25), are left."""
    rows = tokens.select("key").distinct().agg((F.count("*") * of_rows).alias("half"))
    kept = token_freq(tokens).crossJoin(rows).where("freq > 1 and freq <= half")  # one row
    at = F.concat(F.lpad(F.col("freq").cast("string"), 20, "0"), F.lit(" "), "token")  # sorts as (freq, token)
    ranked = running(kept.select("token", "freq", at.alias("at"), F.lit(1).cast("long").alias("one")), "at", ["one"])
    return ranked.select("token", "freq", F.col("before_one").alias("ord"))


def places(tokens: DataFrame, of_rows: float = 0.5) -> DataFrame:
    """(key, ords): the places in token_order() of each row's tokens, ascending; rows without any are left.

    An outer join, as its left side is never broadcast: tokens are many times what Spark takes their size for.
    """
    placed = tokens.join(token_order(tokens, of_rows), "token", "left").groupBy("key").agg(F.sort_array(F.collect_set("ord")).alias("ords"))
    return placed.where(F.size("ords") > 0)


def derived(tokens: DataFrame, rare: int = 10, of_rows: float = 0.5) -> DataFrame:
    """(key, ids): the most frequent token's place first, then the rare rarest ones."""
    placed = places(tokens, of_rows)
    return placed.select("key", F.concat(F.array(F.element_at("ords", -1)), F.slice("ords", 1, rare)).alias("ids"))


def jaccard_pairs(df: DataFrame, key: str, text: str, threshold: float, n: int = 3) -> DataFrame:
    """(a, b, jaccard) of all pairs of keys, a < b, at or over threshold: prefix filter over rarest tokens, then exact counts."""
    tokens = ngrams(df, key, text, n)
    order = token_freq(tokens)
    placed = tokens.join(order, "token").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("freq", "token"))).withColumn("size", F.count("*").over(Window.partitionBy("key")))
    prefix = placed.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1).select("token", "key", "size")
    other = prefix.select("token", F.col("key").alias("b"), F.col("size").alias("nb"))
    cand = prefix.withColumnsRenamed({"key": "a", "size": "na"}).join(other, "token").where("a < b").where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na"))).select("a", "b", "na", "nb").distinct()
    sets = tokens.groupBy("key").agg(F.collect_set("token").alias("own"))
    both = cand.join(sets.select(F.col("key").alias("a"), F.col("own").alias("oa")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("ob")), "b")
    made = both.withColumn("i", F.size(F.array_intersect("oa", "ob"))).withColumn("jaccard", F.col("i") / (F.col("na") + F.col("nb") - F.col("i")))
    return made.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def dimension_blocks(df: DataFrame, key: str, vector: str, digits: int = 1, top: int = 5) -> DataFrame:
    """(key, token, freq, rank): equal rounded components at the same place are a token; per row the most shared top ones."""
    parts = df.select(F.col(key).alias("key"), F.posexplode(vector).alias("pos", "v")).select("key", F.concat_ws(":", "pos", F.floor(F.col("v").cast("double") * 10**digits).cast("long").cast("string")).alias("token"))
    shared = token_freq(parts).where("freq > 1")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("freq"), "token"))
    return parts.join(shared, "token").select("key", "token", "freq", rank.alias("rank")).where(F.col("rank") <= top)


def cross_blocks(left: DataFrame, right: DataFrame, key: str, vector: str, digits: int = 1, top: int = 5) -> DataFrame:
    """dimension_blocks over two tables, with side 0 or 1; a token counts that both sides have."""
    rows = lambda df, side: df.select(F.struct(F.lit(side).alias("side"), F.col(key).alias("key")).alias("key"), F.col(vector).alias("v"))
    parts = rows(left, 0).unionByName(rows(right, 1)).select("key", F.posexplode("v").alias("pos", "v")).select("key", F.concat_ws(":", "pos", F.floor(F.col("v").cast("double") * 10**digits).cast("long").cast("string")).alias("token"))
    shared = parts.groupBy("token").agg(F.count("*").alias("freq"), F.count_distinct(F.col("key.side")).alias("sides")).where("sides = 2")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("freq"), "token"))
    return parts.join(shared, "token").select("key", "token", "freq", rank.alias("rank")).where(F.col("rank") <= top).select(F.col("key.side").alias("side"), F.col("key.key").alias("key"), "token", "freq", "rank")


def cross_derived(left: DataFrame, right: DataFrame, key: str, left_text: str, right_text: str, n: int = 3, rare: int = 10) -> DataFrame:
    """(side, key, ids): derived() of two columns in one order of tokens, for rules that compare them."""
    own = lambda df, side, text: ngrams(df.select(F.struct(F.lit(side).alias("side"), F.col(key).alias("key")).alias("key"), F.col(text).alias("text")), "key", "text", n)
    return derived(own(left, 0, left_text).unionByName(own(right, 1, right_text)), rare, 0.25).select(F.col("key.side").alias("side"), F.col("key.key").alias("key"), "ids")


def row_sentence(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with sentence: the columns joined by #, nulls as empty; a row of nulls only has an empty sentence."""
    whole = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.withColumn("sentence", F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), F.lit("")).otherwise(whole))


def greedy_clusters(df: DataFrame, key: str, text: str, block: str, threshold: float, n: int = 3) -> DataFrame:
    """(key, seed): in each block, in key order, the first unassigned row is a seed and takes later rows of Jaccard over threshold.

    Order decides by definition, so a block is worked off in one task: blocks must be small (see dimension_blocks, derived).
    Blank texts have the seed -2.
    """
    import pandas as pd

    def grams(x: str) -> set[str]:
        p = "#" * (n - 1) + x + "#" * (n - 1)
        return {p[k : k + n] for k in range(len(p) - n + 1)}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        seeds: list[tuple[int, set[str]]] = []
        out = []
        for k, x in zip(rows["key"], rows["text"], strict=True):
            own = grams(x) if x else set()
            hit = next((s for s, other in seeds if len(own & other) > threshold * len(own | other)), None) if own else -2
            if hit is None:
                seeds.append((k, own))
                hit = k
            out.append(hit)
        return pd.DataFrame({"key": rows["key"], "seed": out})

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.col(block).alias("block"))
    return rows.groupBy("block").applyInPandas(run, "key long, seed long")


def prefix_tokens(tokens: DataFrame, threshold: float) -> DataFrame:
    """(key, ids): of each row's token places, rarest first, as many as a partner over the threshold can't all miss."""
    placed = places(tokens)
    return placed.select("key", F.slice("ords", 1, F.ceil(F.size("ords") * (1 - threshold)).cast("int")).alias("ids"))
