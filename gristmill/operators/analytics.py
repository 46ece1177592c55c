"""Aggregates over corpora, logs and tables: quality reports, profiles, segments, latency, entropy, thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.canon import expert_words, stable_hash


def rollup_status(df: DataFrame, keys: list[str], prompt: str, completion: str) -> DataFrame:
    """Rows and token sums by keys; nulls count as 0."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(prompt, F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce(completion, F.lit(0))).alias("completion_tokens"))


def histogram(df: DataFrame, name: str, value: Column, top: int | None = None) -> DataFrame:
    """(metric, value, n), with ``top`` the most frequent only (ties: least value)."""
    h = df.groupBy(value.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "value", "n")
    return h.withColumn("_r", F.row_number().over(W.orderBy(F.desc("n"), "value"))).where(F.col("_r") <= top).drop("_r") if top else h


def corpus_fingerprint(df: DataFrame, row: Column, digits: int = 3) -> DataFrame:
    """One order-independent hash of all rows: hashes of the sorted hashes of a bucket (equal first digits), then of the buckets in order.

    A bucket's hashes meet in one task; choose ``digits`` so that rows / 16^digits hashes fit there.
    """
    h = df.select(F.sha2(row, 256).alias("h")).withColumn("b", F.substring("h", 1, digits))
    per = h.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: x["s"]), ""), 256).alias("fingerprint"), F.sum("n").alias("rows"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each numeric column: n, nulls, mean, sample deviation, exact quartiles; one pass over the table."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), (F.count(F.lit(1)) - F.count(c)).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), q(c).alias("q"), F.max(c).cast("double").alias("max")) for c in columns]
    one = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return one.select("column", "n", "nulls", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "median", "p75"))], "max")


def quantile_target(df: DataFrame, value: str, target: Column, parts: int = 5) -> DataFrame:
    """bin, n, low, high, rate: a 0/1 target over equal-width quantile edges of a value; edges come from one aggregate."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_e"))
    b = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("_e", lambda e: F.col(value) > e)) + 1)  # edges: one row
    return b.where(F.col(value).isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(target), 6).alias("rate"))


def segments(df: DataFrame, a: str, b: str, target: Column, least: int, top: int = 20) -> DataFrame:
    """The ``top`` two-feature segments by size, of at least ``least`` rows, with the target's rate."""
    g = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(target), 6).alias("rate")).where(F.col("n") >= least)
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), a, b))).where(F.col("rank") <= top)


def multi_group(df: DataFrame, kinds: dict[str, Column], arm: Column, success: Column, least: int = 20) -> DataFrame:
    """A/B rates by several groupings of the same rows at once, with absolute and relative uplift of the treated arm.

    arm is 1 for treated, 0 for control. Every grouping is partially aggregated in the one pass over the rows.
    """
    exploded = df.select(arm.alias("arm"), success.cast("int").alias("ok"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in kinds.items()])).alias("g"))
    g = exploded.groupBy("g.kind", "g.value").agg(*[x for a in (0, 1) for x in (F.sum(F.when(F.col("arm") == a, 1).otherwise(0)).alias(f"n{a}"), F.sum(F.when(F.col("arm") == a, F.col("ok")).otherwise(0)).alias(f"k{a}"))])
    r0, r1 = F.try_divide(F.col("k0"), F.col("n0")), F.try_divide(F.col("k1"), F.col("n1"))
    return g.where((F.col("n0") >= least) & (F.col("n1") >= least)).select("kind", "value", "n0", "n1", F.round(r0, 6).alias("rate0"), F.round(r1, 6).alias("rate1"), F.round(r1 - r0, 6).alias("uplift"), F.round(F.try_divide(r1 - r0, r0), 6).alias("relative_uplift"))


def compare_groups(profile: DataFrame, key: str, value: str, cap: int = 96) -> DataFrame:
    """Pairs a < b of a small group table with the difference of a value; the ``cap`` largest differences (a report)."""
    a, b = profile.select(F.col(key).alias("a"), F.col(value).alias("va")), profile.select(F.col(key).alias("b"), F.col(value).alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("difference", F.round(F.col("va") - F.col("vb"), 6)).withColumn("rank", F.row_number().over(W.orderBy(F.abs("difference").desc(), "a", "b"))).where(F.col("rank") <= cap).select("a", "b", "difference", "rank")


def nearest_rank(df: DataFrame, group: str, value: str, fractions: list[float]) -> DataFrame:
    """Percentiles by nearest rank: the value at the half-even rounded index (n - 1) * f, from a value histogram."""
    h = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(group)
    run = h.withColumn("_to", F.sum("c").over(w.orderBy(value))).withColumn("_n", F.sum("c").over(w))
    at = [F.min(F.when(F.col("_to") > F.bround((F.col("_n") - 1) * F.lit(f)), F.col(value))).alias(f"p{round(f * 100)}") for f in fractions]
    return run.groupBy(group).agg(F.max("_n").alias("n"), *at)


def semantic_entropy(df: DataFrame, item: str, signature: str) -> DataFrame:
    """item, samples, clusters, entropy of answers that mean the same."""
    c = df.groupBy(item, signature).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(W.partitionBy(item))
    return c.withColumn("p", p).groupBy(item).agg(F.sum("c").alias("samples"), F.count(F.lit(1)).alias("clusters"), F.round(F.sum(-F.col("p") * F.ln("p")), 6).alias("entropy"))


def token_f1(df: DataFrame, key: str, predicted: str, gold: str) -> DataFrame:
    """key, f1: multiset overlap of words of two texts; two empty texts agree."""
    count = lambda c: F.aggregate(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x), F.create_map(x, F.coalesce(F.try_element_at(m, x), F.lit(0)) + 1)))
    a, b = expert_words(F.coalesce(predicted, F.lit(""))), expert_words(F.coalesce(gold, F.lit("")))
    d = df.select(key, a.alias("a"), b.alias("b")).withColumn("ma", count(F.col("a"))).withColumn("mb", count(F.col("b")))
    same = F.aggregate(F.map_keys("ma"), F.lit(0), lambda s, k: s + F.least(F.element_at("ma", k), F.coalesce(F.try_element_at("mb", k), F.lit(0))))
    n = F.size("a") + F.size("b")
    return d.select(key, F.round(F.when(n == 0, 1.0).otherwise(2.0 * same / n), 6).alias("f1"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold (score >= t) of the best balanced accuracy, then precision, accuracy, threshold.

    Candidates are 0, 1 and all scores; counts come from one histogram of scores, so the sweep sees distinct
    scores, not rows.
    """
    h = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("t")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    spark = df.sparkSession
    h = h.union(spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "t double, p long, n long")).groupBy("t").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    w = W.orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = h.withColumn("tp", F.sum("p").over(w)).withColumn("fp", F.sum("n").over(w)).crossJoin(F.broadcast(h.agg(F.sum("p").alias("_pos"), F.sum("n").alias("_neg"))))  # totals: one row
    bal = F.round((F.try_divide(F.col("tp"), F.col("_pos")) + 1 - F.try_divide(F.col("fp"), F.col("_neg"))) / 2, 9)
    prec = F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), 9)
    acc = F.round((F.col("tp") + F.col("_neg") - F.col("fp")) / (F.col("_pos") + F.col("_neg")), 9)
    return run.select(F.col("t").alias("threshold"), bal.alias("balanced_accuracy"), prec.alias("precision"), acc.alias("accuracy")).agg(F.max(F.struct("balanced_accuracy", "precision", "accuracy", "threshold")).alias("m")).select("m.*")


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n"))


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(gate, passed) of named conditions over aggregates of one table, in one pass."""
    one = df.agg(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in checks.items()]).alias("g"))
    return one.select(F.inline("g"))


def consensus(a: str, b: str, names: list[str]) -> list[Column]:
    """The stricter of two reviews: least scores, both verdicts, all unsupported claims."""
    low = [F.least(F.col(f"{a}.scores")[n], F.col(f"{b}.scores")[n]).alias(f"score_{n}") for n in names]
    both = (F.col(f"{a}.verdict") == "accept") & (F.col(f"{b}.verdict") == "accept")
    return [*low, F.when(both, "accept").otherwise("reject").alias("verdict"), F.array_union(F.coalesce(f"{a}.unsupported_claim_ids", F.array().cast("array<string>")), F.coalesce(f"{b}.unsupported_claim_ids", F.array().cast("array<string>"))).alias("unsupported_claim_ids")]


def signature(x: Column) -> Column:
    return stable_hash(F.array_join(F.array_sort(F.array_distinct(expert_words(x))), " "), 16)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)
