"""Caps, quotas, rankings and deterministic samples. Random choices are hash orders: same rows, same answer, on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.canon import stable_hash


def even_cap(df: DataFrame, group: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of each group, evenly spaced in its order; a cap of one takes the middle row."""
    w = W.partitionBy(group)
    rn = F.row_number().over(w.orderBy(*order)) - 1
    ranked = df.withColumn("_i", rn).withColumn("_n", F.count(F.lit(1)).over(w))
    if cap == 1:
        return ranked.where("_i = floor(_n / 2)").drop("_i", "_n")
    spots = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(cap - 1)).cast("int"))
    return ranked.where((F.col("_n") <= cap) | F.array_contains(spots, F.col("_i"))).drop("_i", "_n")


def hash_cap(df: DataFrame, group: str, key: str, cap: int, seed: str = "17") -> DataFrame:
    """At most ``cap`` rows of each group, those of the least hash of seed and key; a sample without replacement."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(h, key))).where(F.col("_r") <= cap).drop("_r")


def largest_remainder(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """name, quota: a total shared by weights; what flooring leaves goes to the largest fractions (ties: greater name)."""
    share = F.col(weight) * total / F.sum(weight).over(W.partitionBy())
    f = weights.select(name, share.alias("_x")).withColumn("_floor", F.floor(F.round("_x", 9)))
    left = F.lit(total) - F.sum("_floor").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy((F.col("_x") - F.col("_floor")).desc(), F.col(name).desc()))
    return f.withColumn("_left", left).withColumn("_rank", rank).select(name, (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("int")).cast("long").alias("quota"))


def balanced_cap(df: DataFrame, quotas: DataFrame, domain: str, group: str, score: str, key: str) -> DataFrame:
    """Up to its quota of each domain, in rounds over its groups: every group's best row, then every group's second.

    Within a round rows go by score, then group; what a domain cannot fill is filled by the best rows left anywhere.
    """
    r = F.row_number().over(W.partitionBy(domain, group).orderBy(F.desc(score), key))
    turn = F.row_number().over(W.partitionBy(domain).orderBy("_r", F.desc(score), group, key))
    ranked = df.withColumn("_r", r).join(quotas.select(domain, "quota"), domain, "left").withColumn("_t", turn).withColumn("_in", F.coalesce(F.col("_t") <= F.col("quota"), F.lit(False)))
    chosen = ranked.where("_in")
    short = (quotas.agg(F.sum("quota")).first()[0] or 0) - chosen.count()
    fill = ranked.where("not _in").orderBy(F.desc(score), key).limit(max(0, int(short)))  # a distributed top-k
    return chosen.select(df.columns).union(fill.select(df.columns))


def round_robin(df: DataFrame, domain: str, key: str, limit: int, seed: str = "17") -> DataFrame:
    """The first ``limit`` rows when domains take turns, each in hash order; ``position`` counts from 1."""
    h = stable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 64)
    turn = df.withColumn("_rn", F.row_number().over(W.partitionBy(domain).orderBy(h, key))).where(F.col("_rn") <= limit)
    top = turn.orderBy("_rn", domain).limit(limit)  # a distributed top-k, so only ``limit`` rows are numbered
    return top.withColumn("position", F.row_number().over(W.orderBy("_rn", domain))).drop("_rn")


def bucket_rank(df: DataFrame, bucket: str, quotas: dict[str, int], score: Column, key: str) -> DataFrame:
    """The best rows of each bucket up to its quota, with the score."""
    pairs = [x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]
    s = df.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy(bucket).orderBy(F.desc("score"), key))
    best = s.withColumn("rank", rank).where(F.col("rank") <= max(quotas.values(), default=0))  # lets the planner limit groups early
    return best.where(F.col("rank") <= F.element_at(F.create_map(*pairs), F.col(bucket)))


def popularity_score(population: Column) -> Column:
    return F.least(F.lit(4.0), F.log10(F.greatest(population, F.lit(0)) + 1))


def derange(df: DataFrame, family: str, key: str, seed: str = "17") -> DataFrame:
    """family, key, partner: every row with the next of its family in hash order, the last with the first; a family of one has none."""
    h = stable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 64)
    w = W.partitionBy(family).orderBy(h, key)
    first = F.first(key).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    partner = F.coalesce(F.lead(key).over(w), first)
    return df.select(family, key, partner.alias("partner")).withColumn("partner", F.when(F.col("partner") != F.col(key), F.col("partner")))


def first_n(df: DataFrame, family: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(family).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def rotate(key, role: str, pool: list[str]) -> Column:
    """A member of the pool for (key, role), the same for ever."""
    h = F.conv(stable_hash(F.concat_ws(":", key, F.lit(role)), 8), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, pool)), F.pmod(h, F.lit(len(pool))).cast("int") + 1)


def queue_order(df: DataFrame, tier: Column, failed: Column, key: str, limit: int, seed: str = "17") -> DataFrame:
    """Work in order of tier, failures last, hash order within; the first ``limit``, numbered."""
    h = stable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 64)
    top = df.withColumn("_t", tier).withColumn("_f", failed).withColumn("_h", h).orderBy("_t", "_f", "_h", key).limit(limit)
    return top.withColumn("position", F.row_number().over(W.orderBy("_t", "_f", "_h", key))).drop("_t", "_f", "_h")


def epoch_order(df: DataFrame, key: str, epoch: int) -> DataFrame:
    """A shuffle of the whole table for an epoch: a sort key instead of a global number, so no task sees all rows."""
    h = stable_hash(F.concat_ws(":", F.lit(str(epoch)), F.col(key).cast("string")), 16)
    return df.withColumn("epoch_key", h)


def natural_key(x) -> Column:
    """A sort key in which digits within names count as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 20, "0")).otherwise(t)), "")


def schedule(groups: DataFrame, group: str, domain: str, quotas: DataFrame, seed: str = "17") -> DataFrame:
    """domain, slot, group, job_id: each domain's quota of jobs dealt to its groups in turn, in a hash order.

    Slots are numbered for good, so scheduling 1..m and then m+1..n gives the same jobs as 1..n at once.
    """
    h = stable_hash(F.concat_ws(":", F.lit(seed), F.col(group)), 64)
    g = groups.select(domain, group).distinct().withColumn("_i", F.row_number().over(W.partitionBy(domain).orderBy(h, group)) - 1).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(domain)))
    q = quotas.where("quota > 0").select(domain, F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota").cast("long"))).alias("slot"))
    jobs = q.join(g, domain).where("(slot - 1) % _n = _i")
    return jobs.select(domain, "slot", group, stable_hash(F.concat_ws("|", domain, group, F.col("slot").cast("string")), 20).alias("job_id"))


def hard_negatives(df: DataFrame, source: str, key: str, answer: str, seed: str = "17") -> DataFrame:
    """source, key, hard_negative: the answer of the next row of the same source in hash order, cyclic; null for a source of one."""
    h = stable_hash(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 64)
    w = W.partitionBy(source).orderBy(h, key)
    first = F.first(F.struct(key, answer)).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct(key, answer)).over(w), first)
    return df.select(source, key, nxt.alias("_x")).select(source, key, F.when(F.col("_x")[key] != F.col(key), F.col("_x")[answer]).alias("hard_negative"))


def coherent_window(df: DataFrame, group: str, order: list, size: int, seed: str = "17") -> DataFrame:
    """A contiguous window of ``size`` rows of each group in its order, its start chosen by the group's hash."""
    w = W.partitionBy(group)
    n = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.greatest(F.lit(1), F.col("_n") - size + 1))
    return n.withColumn("_s", start).where((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_s") + size)).drop("_i", "_n", "_s")
