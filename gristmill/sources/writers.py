"""Sinks: atomic JSON lines, CSV with nested cells, release manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes to a folder beside the target, then swaps it in; a failed job leaves the old files. Returns the rows written."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    staging = path.rstrip("/") + ".staging"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(staging)
    fs, target, jvm = _fs(df.sparkSession, path)
    fs.delete(target, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not put {staging} in place")
    return seen.get["n"]


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs become JSON cells."""
    nested = ("array", "map", "struct")
    df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").option("header", "true").csv(path)


def release_manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of every file of a release."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
