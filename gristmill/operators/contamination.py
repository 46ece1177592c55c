"""Benchmark contamination by shared word windows, as an equi-join on shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.canon import normalize_text, shingles, words
from gristmill.session import maybe_broadcast, stored


def _sets(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    w = df.select(F.col(key).alias("k"), words(normalize_text(F.coalesce(text, F.lit("")))).alias("w"))
    return w.select("k", F.array_distinct(shingles(F.col("w"), n)).alias("s"), F.array_join("w", " ").alias("t"))


def contamination(records: DataFrame, key: str, text: str, items: DataFrame, item: str, prompt: str, n: int = 8, least: int = 4, coverage: float = 0.45, top: int = 10, least_words: int = 8) -> DataFrame:
    """key, item, exact, matching_shingles, coverage of contaminated records.

    Of a record's ``top`` items by shared shingles (ties: least item) those are flagged whose text it holds word
    for word, or of which it shares ``least`` shingles and ``coverage`` of them. Items under ``least_words`` words
    are left out. The items' shingles are broadcast if their counted number is small, else joined by hash.
    """
    i = _sets(items, item, prompt, n).where(F.size(F.split("t", " ")) >= least_words).withColumnRenamed("k", "item").withColumnRenamed("t", "item_text")
    i = i.withColumn("item_shingles", F.size("s"))
    r = stored(_sets(records, key, text, n))
    asked = i.select("item", F.explode("s").alias("x"))
    shared = r.select("k", F.explode("s").alias("x")).join(maybe_broadcast(asked, asked.count()), "x").groupBy("k", "item").agg(F.count(F.lit(1)).alias("matching_shingles"))
    best = shared.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy(F.desc("matching_shingles"), "item"))).where(F.col("_r") <= top)
    full = best.join(i.select("item", "item_text", "item_shingles"), "item").join(r.select("k", "t"), "k")
    out = full.withColumn("exact", F.contains("t", "item_text")).withColumn("coverage", F.round(F.col("matching_shingles") / F.greatest(F.lit(1), "item_shingles"), 4))
    return out.where(F.col("exact") | ((F.col("matching_shingles") >= least) & (F.col("matching_shingles") / F.greatest(F.lit(1), "item_shingles") >= coverage))).select(F.col("k").alias(key), F.col("item").alias(item), "exact", "matching_shingles", "coverage")


def prompt_overlap(train: DataFrame, key: str, text: str, held: DataFrame, held_key: str, held_text: str, n: int = 8, share: float = 0.35) -> DataFrame:
    """Pairs of prompts equal after normalising, or sharing ``share`` of the shingles of the one with fewer."""
    a = _sets(train, key, text, n).where("t <> ''").withColumn("na", F.size("s"))
    b = _sets(held, held_key, held_text, n).where("t <> ''").select(F.col("k").alias("h"), F.col("s").alias("hs"), F.col("t").alias("ht")).withColumn("nb", F.size("hs"))
    same = a.join(b, F.col("t") == F.col("ht")).select("k", "h")
    asked = b.select("h", "nb", F.explode("hs").alias("x"))
    near = a.select("k", "na", F.explode("s").alias("x")).join(maybe_broadcast(asked, asked.count()), "x").groupBy("k", "h").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")).where(F.col("c") >= share * F.least("na", "nb")).select("k", "h")
    return same.union(near).distinct().select(F.col("k").alias(key), F.col("h").alias(held_key))
