"""Exact quotas per group without sorting whole groups: mergeable histograms first, ranks only where needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.session import maybe_broadcast


def key_hash(*cols, seed: int = 0) -> Column:
    """A uniform 30-bit key of the given columns."""
    return F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1))


def cutoffs(hist: DataFrame, groups: list[str], bin_col: str, quotas: DataFrame) -> DataFrame:
    """Per group: total, the first bin at which the running count reaches the quota, and what is left for that bin.

    hist has groups, bin_col and ``n``; quotas has groups and ``quota``. ``cut`` is null if the whole group fits.
    The window runs over one group's bins, whose number is bounded by the histogram, not by the rows.
    """
    w = W.partitionBy(*groups).orderBy(bin_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = hist.join(quotas, groups).withColumn("_cum", F.sum("n").over(w))
    first = F.min(F.when(F.col("_cum") >= F.col("quota"), F.struct(F.col(bin_col).alias("bin"), (F.col("quota") - F.col("_cum") + F.col("n")).alias("left"), F.col("n").alias("n"))))
    return run.groupBy(*groups).agg(F.first("quota").alias("quota"), F.sum("n").alias("total"), first.alias("cut"))


def take_quota(df: DataFrame, groups: list[str], bins: list[str], order: list[Column | str], quotas: DataFrame) -> DataFrame:
    """The first ``quota`` rows of each group in the order (bins..., order...); groups without a quota give none.

    Each level builds a histogram over one more bin column, keeps all rows before the cutoff bin and passes on
    only the rows of the cutoff bin itself; a window ranks what is left after the last level. Empty tables and
    quotas of zero give no rows; groups smaller than their quota come whole.
    """
    kept, rest, left = [], df, quotas.where("quota > 0")
    for b in bins:
        hist = rest.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("n"))
        cuts = cutoffs(hist, groups, b, left).select(*groups, F.col("total").alias("_cut_total"), F.col("quota").alias("_cut_quota"), F.col("cut.bin").alias("_cut_bin"), F.col("cut.left").alias("_cut_left"), F.col("cut.n").alias("_cut_n"))
        at = rest.join(maybe_broadcast(cuts, quotas.count()), groups)
        whole = (F.col("_cut_total") <= F.col("_cut_quota")) | (F.col(b) < F.col("_cut_bin")) | ((F.col(b) == F.col("_cut_bin")) & (F.col("_cut_left") == F.col("_cut_n")))
        kept.append(at.where(whole).select(df.columns))
        rest = at.where((F.col("_cut_total") > F.col("_cut_quota")) & (F.col(b) == F.col("_cut_bin")) & (F.col("_cut_left") < F.col("_cut_n"))).select(*df.columns)
        left = cuts.where("_cut_total > _cut_quota and _cut_left < _cut_n").select(*groups, F.col("_cut_left").alias("quota"))
    w = W.partitionBy(*groups).orderBy(*order)
    last = rest.withColumn("_rank", F.row_number().over(w)).join(maybe_broadcast(left.withColumnRenamed("quota", "_cut_want"), quotas.count()), groups)
    kept.append(last.where("_rank <= _cut_want").select(df.columns))
    return reduce(DataFrame.union, kept)


def exact_rank(df: DataFrame, groups: list[str], bin_col: str, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Rank from 1 of every row within its group, ordered by (bin, order): no task sees more than one bin of a group."""
    hist = df.groupBy(*groups, bin_col).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy(bin_col).rowsBetween(W.unboundedPreceding, -1)
    offsets = hist.select(*groups, bin_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*groups, bin_col).orderBy(*order))
    return df.join(offsets, [*groups, bin_col]).withColumn(out, F.col("_before") + inside).drop("_before")
