"""Hash splits with presets, leakage checks and set operations between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.canon import hash_fraction, stable_hash


def split_by(key, fractions: list[tuple[str, float]] | None = None, digits: int = 16, salt: str = "") -> Column:
    """The split of a key by the fraction its SHA-256 stands for; what rounding leaves goes to the last split."""
    fractions = fractions or [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    k = F.concat(F.lit(salt), key) if salt else (F.col(key) if isinstance(key, str) else key)
    f, upto = hash_fraction(k, digits), 0.0
    out = None
    for name, share in fractions[:-1]:
        upto += share
        out = F.when(f < upto, name) if out is None else out.when(f < upto, name)
    return out.otherwise(fractions[-1][0])


def packet_split(lineage, salt: str, share: float) -> Column:
    """Validation for a share of lineages: the first 8 hex digits of the hash of the canonical JSON of lineage and salt."""
    j = F.concat(F.lit('{"lineage":"'), lineage, F.lit(f'","split":"{salt}"}}'))
    return F.when(F.conv(stable_hash(j, 8), 16, 10).cast("long") / float(0xFFFFFFFF) < share, "validation").otherwise("train")


def decile_split(lineage) -> Column:
    d = F.pmod(F.conv(stable_hash(F.concat(F.lit("split:"), lineage), 8), 16, 10).cast("long"), F.lit(10))
    return F.when(d <= 7, "train").when(d == 8, "validation").otherwise("test")


def sha1_split(key) -> Column:
    f = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("long") / float(16**8)
    return F.when(f < 0.05, "test").when(f < 0.08, "validation").otherwise("train")


def in_several(df: DataFrame, key: str, split: str) -> DataFrame:
    """key, splits: keys found in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def leakage_report(rows: DataFrame, sample: str, episode: str, lineage: str, split: str) -> DataFrame:
    """check, n: lineages and episodes in several splits, repeated samples, splits without rows."""
    a = in_several(rows, lineage, split).agg(F.count(F.lit(1)).alias("n")).select(F.lit("lineage_in_several_splits").alias("check"), "n")
    b = in_several(rows, episode, split).agg(F.count(F.lit(1)).alias("n")).select(F.lit("episode_in_several_splits").alias("check"), "n")
    c = rows.groupBy(sample).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_sample").alias("check"), "n")
    d = rows.agg((F.lit(3) - F.countDistinct(F.when(F.col(split).isin("train", "validation", "test"), F.col(split)))).cast("long").alias("n")).select(F.lit("empty_split").alias("check"), "n")
    return a.union(b).union(c).union(d)


def without_held_out(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Training rows whose key no held-out row has; null keys stay."""
    return train.join(held.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def unknown_references(rows: DataFrame, key: str, refs: str, known: DataFrame, known_key: str) -> DataFrame:
    """key, reference: references that name nothing known."""
    r = rows.select(key, F.explode(refs).alias("reference")).distinct()
    return r.join(known.select(F.col(known_key).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference")
