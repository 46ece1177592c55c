"""Problem 3: capping records per dominant contributor, keeping the best by a quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.canon import label
from gristmill.llm.selection import cutoffs, key_hash, take_quota
from gristmill.session import cut, maybe_broadcast, table

Q = 1 << 30
#: Quality bins of the mergeable histogram: the leading 12 of the score's 30 bits.
BIN_SHIFT = 18


def with_quality_key(items: DataFrame, item: str, score: str) -> DataFrame:
    """Adds the order of keeping: ``_q`` (0 is best, scores to 2^-30), its bin, then a hash of the item."""
    q = F.when(F.col(score).between(0.0, 1.0), F.lit(Q) - F.floor(F.col(score) * Q)).otherwise(F.lit(Q + (1 << BIN_SHIFT))).cast("long")
    return items.withColumn("_q", q).withColumn("_bin", F.shiftright("_q", BIN_SHIFT)).withColumn("_h", key_hash(item))


def contributor_cutoffs(keyed: DataFrame, contributor: str, cap: int) -> DataFrame:
    """Contributors above the cap, with the quality bin at which each must be cut."""
    hist = keyed.where(F.col(contributor).isNotNull()).groupBy(contributor, "_bin").agg(F.count(F.lit(1)).alias("n"))
    quotas = keyed.select(contributor).where(F.col(contributor).isNotNull()).groupBy(contributor).agg(F.count(F.lit(1)).alias("_t")).where(F.col("_t") > cap).select(contributor, F.lit(cap).cast("long").alias("quota"))
    return cutoffs(hist, [contributor], "_bin", quotas).where("total > quota")


def share_cap(total: int, max_share_ppm: int) -> int:
    return total * max_share_ppm // 1_000_000


def output_cap(items: DataFrame, contributor: str, max_share_ppm: int) -> int:
    """The greatest cap with which no contributor holds more than the share of what is kept.

    What is kept under a cap c is the sum of min(size, c) over contributors, and all items without one. The cap is
    lowered to the share of what it keeps until it stays; only sizes with their numbers, at most the square root of
    twice the items, are summed on the driver. It is 0 if too few contributors share too much for any cap.
    """
    sizes = items.groupBy(contributor).agg(F.count(F.lit(1)).alias("n"))
    free = sizes.where(F.col(contributor).isNull()).agg(F.sum("n")).first()[0] or 0
    by_size = [(r["n"], r["k"]) for r in sizes.where(F.col(contributor).isNotNull()).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()]
    cap = max((n for n, _ in by_size), default=0)
    while cap:
        kept = free + sum(min(n, cap) * k for n, k in by_size)
        if (lower := min(cap, share_cap(kept, max_share_ppm))) == cap:
            break
        cap = lower
    return cap


def cap_contributors(items: DataFrame, contributor: str, item: str, score: str, cap: int) -> DataFrame:
    """At most ``cap`` items of every contributor, those of the best score.

    items: one row per (contributor, item). A null, NaN or out-of-range score ranks below every valid score; ties
    are broken by a hash of the item, then by the item. Items without contributor are all kept: nobody dominates
    through them. An empty table gives an empty result; further columns pass through.
    """
    rows = items.select(F.col(contributor).alias("c"), F.col(item).alias("i"), F.col(score).alias("s"), F.struct(*[F.col(f"`{x}`") for x in items.columns]).alias("row"))
    keyed = cut(with_quality_key(rows, "i", "s"))
    over = cut(contributor_cutoffs(keyed, "c", cap).select("c", "quota"))
    free = keyed.join(maybe_broadcast(over.select("c"), over.count()), "c", "left_anti")
    fine = keyed.withColumn("_fine", F.col("_q")).withColumn("_hb", F.shiftright("_h", BIN_SHIFT))
    best = take_quota(fine, ["c"], ["_bin", "_fine", "_hb"], ["_h", "i"], over)
    return free.select("row").union(best.select("row")).select("row.*")


def jobs_with_scores(spark: SparkSession, sf_dir: str, scores: bool = True) -> DataFrame:
    """Distinct (source_group, episode_id) of episode_job with the best valid judge_score of dpo_pair."""
    jobs = table(spark, sf_dir, "episode_job").where(F.col("episode_id").isNotNull()).select(label("source_group", "-").alias("source_group"), "episode_id").distinct()
    if not scores:
        return jobs
    s = F.col("metadata.judge_score")
    best = table(spark, sf_dir, "dpo_pair").where(s.between(0.0, 1.0)).groupBy("episode_id").agg(F.max(s).alias("judge_score"))
    return jobs.join(best, "episode_id", "left").select("source_group", "episode_id", "judge_score")


#: No group may hold more than 4 % of all jobs.
MAX_SHARE_PPM = 40_000


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = cut(with_quality_key(jobs_with_scores(spark, sf_dir), "episode_id", "judge_score"))
    total = jobs.select("episode_id").distinct().count()
    return contributor_cutoffs(jobs, "source_group", share_cap(total, MAX_SHARE_PPM)).select("source_group")


def p3_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of which no group holds more than 4 %, the best of each."""
    jobs = cut(jobs_with_scores(spark, sf_dir))
    return cap_contributors(jobs, "source_group", "episode_id", "judge_score", output_cap(jobs, "source_group", MAX_SHARE_PPM))
