"""Selective-prediction statistics: ranks, areas, paired tests, bounds, conformal thresholds, betting processes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def midranks(df: DataFrame, value: str, out: str = "midrank") -> DataFrame:
    """Average ranks on ties, from a histogram of values: the window runs over distinct values only."""
    h = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(h.select(value, (before + (F.col("_c") + 1) / 2).alias(out)), value)


def auroc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """n1, n0, auroc: the chance that a positive scores above a negative, ties count half."""
    h = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    u = h.withColumn("u", F.col("p") * (below + F.col("n") / 2))
    return u.agg(F.sum("p").alias("n1"), F.sum("n").alias("n0"), F.sum("u").alias("_u")).select("n1", "n0", F.round(F.try_divide(F.col("_u"), (F.col("n1") * F.col("n0")).cast("double")), 9).alias("auroc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    r = midranks(midranks(both, a, "ra"), b, "rb")
    return r.agg(F.round(F.corr("ra", "rb"), 9).alias("spearman"), F.count(F.lit(1)).alias("n"))


def risk_coverage(df: DataFrame, score: str, wrong: str, seq: str, bins: int = 1024) -> DataFrame:
    """augrc, n: area under the generalised risk-coverage curve; rows by falling score, ties in order of ``seq``.

    Ranks come from a histogram over score bins and a rank inside each bin, so no task orders the whole table.
    """
    from_hist = df.select(score, F.col(wrong).cast("long").alias("w"), seq).withColumn("_b", -F.floor(F.col(score) * bins))
    h = from_hist.groupBy("_b").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("e"))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    h = h.select("_b", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("_e"))
    inner = F.sum("w").over(W.partitionBy("_b").orderBy(F.desc(score), seq).rowsBetween(W.unboundedPreceding, W.currentRow))
    run = from_hist.join(F.broadcast(h), "_b").withColumn("errors", F.col("_e") + inner)  # at most ``bins`` rows
    return run.agg(F.count(F.lit(1)).alias("n"), F.sum("errors").alias("_s")).select("n", F.round(F.col("_s") / (F.col("n") * F.col("n")), 9).alias("augrc"))


#: Fixed value: the 0.9 quantile of the normal distribution.
Z_90 = 1.2815515655446004


def paired_lcb(df: DataFrame, a: str, b: str, z: float = Z_90) -> DataFrame:
    """n, mean, lower: the mean of paired differences and its one-sided lower bound at 90 %."""
    d = F.col(a) - F.col(b)
    return df.agg(F.count(d).alias("n"), F.round(F.avg(d), 9).alias("mean"), F.round(F.avg(d) - z * F.stddev_samp(d) / F.sqrt(F.count(d)), 9).alias("lower"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """wins, losses, p: one-sided mid-p of McNemar's test that ``a`` is right more often than ``b``; only two counts leave the cluster."""
    counts = df.agg(F.sum((F.col(a) & ~F.col(b)).cast("long")).alias("wins"), F.sum((~F.col(a) & F.col(b)).cast("long")).alias("losses"))

    @F.pandas_udf("double")
    def mid_p(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([mcnemar_mid_p(int(i or 0), int(j or 0)) for i, j in zip(x, y)])

    return counts.withColumn("p", F.round(mid_p("wins", "losses"), 9))


def mcnemar_mid_p(wins: int, losses: int) -> float:
    """The chance of more wins among as many fair coins, and half that of as many."""
    n = wins + losses
    if not n:
        return 1.0
    pmf = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2))
    return min(1.0, math.fsum(pmf(i) for i in range(wins + 1, n + 1)) + 0.5 * pmf(wins))


def stouffer(df: DataFrame, z: str) -> DataFrame:
    """n, z, p: equal-weight pooling of one-sided z scores of replications; nulls are left out, no score gives a null."""
    one = df.agg(F.count(z).alias("n"), F.sum(z).alias("_s")).select("n", F.try_divide(F.col("_s"), F.sqrt("n")).alias("z"))

    @F.pandas_udf("double")
    def upper(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore")

    return one.withColumn("p", upper("z"))


def clopper_pearson_upper(errors: int, n: int, alpha: float = 0.05) -> float:
    """The rate at which ``errors`` or fewer of n come with chance alpha, by bisection."""
    if n == 0 or errors >= n:
        return 1.0
    low, high = errors / n, 1.0
    for _ in range(80):
        p = (low + high) / 2
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + (i * math.log(p) if i else 0.0) + ((n - i) * math.log1p(-p) if p < 1 else -math.inf) for i in range(errors + 1)]
        top = max(logs)
        tail = math.exp(top) * sum(math.exp(x - top) for x in logs) if top > -math.inf else 0.0
        low, high = (p, high) if tail > alpha else (low, p)
    return high


def conformal_threshold(df: DataFrame, group: str, score: str, alpha: float) -> DataFrame:
    """group, n, threshold: the ceil((n + 1)(1 - alpha))-th least score of each fold; null if there are too few."""
    h = df.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(group)
    run = h.withColumn("_to", F.sum("c").over(w.orderBy(score))).withColumn("_n", F.sum("c").over(w))
    k = F.ceil((F.col("_n") + 1) * F.lit(1 - alpha) - 1e-12)
    return run.groupBy(group).agg(F.max("_n").alias("n"), F.min(F.when(F.col("_to") >= k, F.col(score))).alias("threshold"))


def selective_risk(df: DataFrame, score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """threshold, accepted, coverage, risk at several thresholds in one pass."""
    parts = [F.struct(F.lit(t).alias("threshold"), F.sum((F.col(score) >= t).cast("long")).alias("accepted"), F.round(F.avg((F.col(score) >= t).cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(F.col(score) >= t, 1 - F.col(correct).cast("int"))), 6).alias("risk")) for t in thresholds]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def delong_pair(df: DataFrame, a: str, b: str, positive: str) -> DataFrame:
    """auc_a, auc_b, difference and its standard error on the same rows (structural components from midranks)."""
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, F.col(positive).cast("int").alias("y"))
    r = base
    for s in (a, b):
        h = base.groupBy(s).agg(F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_q"))
        up = W.orderBy(s).rowsBetween(W.unboundedPreceding, -1)
        tot = W.partitionBy()
        h = h.select(s, ((F.coalesce(F.sum("_q").over(up), F.lit(0)) + F.col("_q") / 2) / F.sum("_q").over(tot)).alias(f"v1_{s}"), (1 - (F.coalesce(F.sum("_p").over(up), F.lit(0)) + F.col("_p") / 2) / F.sum("_p").over(tot)).alias(f"v0_{s}"))
        r = r.join(h, s)
    pos, neg = F.col("y") == 1, F.col("y") == 0
    d1, d0 = F.when(pos, F.col(f"v1_{a}") - F.col(f"v1_{b}")), F.when(neg, F.col(f"v0_{a}") - F.col(f"v0_{b}"))
    return r.agg(F.round(F.avg(F.when(pos, F.col(f"v1_{a}"))), 9).alias("auc_a"), F.round(F.avg(F.when(pos, F.col(f"v1_{b}"))), 9).alias("auc_b"), F.round(F.avg(d1), 9).alias("difference"), F.round(F.sqrt(F.var_samp(d1) / F.count(d1) + F.var_samp(d0) / F.count(d0)), 9).alias("standard_error"))


def e_process(df: DataFrame, group: str, seq: str, a: str, b: str, correct: str, bet: float = 0.5, before: DataFrame | None = None) -> DataFrame:
    """group, pairs, discordant, wealth, max_wealth, waiting: bets that scorer ``a`` ranks right answers above wrong ones where ``b`` does not.

    Wrong answers wait in line; each right one is paired with the longest waiting. Pairs on which both scorers agree
    say nothing; on others the wealth, 1 at first, is multiplied by 1 + bet or 1 - bet. ``before`` is a former result
    to go on from: a run in parts ends like one in whole. Rows with a null are left out. Sequential by nature: one
    group (an evaluation stream) is one task, so groups must be streams, not whole corpora.
    """
    if not 0 < bet < 1:
        raise ValueError("the bet must lie between 0 and 1")
    kind = df.schema[group].dataType.simpleString()
    out = f"`{group}` {kind}, pairs long, discordant long, wealth double, max_wealth double, waiting array<struct<a:double,b:double>>"

    def run(rows: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        pairs, discordant, wealth, top, waiting = 0, 0, 1.0, 1.0, []
        if len(old):
            o = old.iloc[0]
            pairs, discordant, wealth, top, waiting = int(o.pairs), int(o.discordant), float(o.wealth), float(o.max_wealth), [(w["a"], w["b"]) for w in o.waiting]
        head = 0
        for x, y, ok in rows.sort_values("_seq")[["_a", "_b", "_ok"]].itertuples(index=False):
            if not ok:
                waiting.append((x, y))
            elif head < len(waiting):
                (wx, wy), head, pairs = waiting[head], head + 1, pairs + 1
                if (x > wx) != (y > wy):
                    discordant += 1
                    wealth *= 1.0 + bet * (1.0 if x > wx else -1.0)
                    top = max(top, wealth)
        name = (rows if len(rows) else old)[group].iloc[0]
        return pd.DataFrame({group: [name], "pairs": [pairs], "discordant": [discordant], "wealth": [wealth], "max_wealth": [top], "waiting": [[{"a": x, "b": y} for x, y in waiting[head:]]]})

    rows = df.select(group, F.col(seq).alias("_seq"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.col(correct).alias("_ok")).dropna()
    old = before if before is not None else df.sparkSession.createDataFrame([], out)
    return rows.groupBy(group).cogroup(old.groupBy(group)).applyInPandas(run, out)
