"""Corpus operators: chunks, language and quality gates, exact and near duplicates, audit."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.canon import normalize_text, stable_hash, words
from gristmill.functions import text as T
from gristmill.session import stored

BLANK = re.compile(r"\n\s*\n")


def pack_paragraphs(text: str, target: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, chunk): paragraphs packed up to ``target``; a new chunk opens with the last ``overlap`` characters.

    A paragraph beyond the target stays whole. Offsets count in the text of paragraphs joined by blank lines.
    """
    flat = text.replace("\r\n", "\n").replace("\r", "\n")
    parts = [p for p in (p.strip() for p in BLANK.split(flat)) if p]
    done: list[tuple[int, int, str]] = []
    body, begin, seen = "", 0, 0
    for p in parts:
        joined = len(body) + 2 + len(p)
        if body and joined > target:
            done.append((begin, begin + len(body), body))
            tail = body[len(body) - overlap :] if overlap and len(body) > overlap else body if overlap else ""
            body, begin = (f"{tail}\n\n{p}", max(seen - len(tail), 0)) if tail else (p, seen)
        elif body:
            body = f"{body}\n\n{p}"
        else:
            body, begin = p, seen
        seen += len(p) + 2
    if body:
        done.append((begin, begin + len(body), body))
    return done


def chunk(df: DataFrame, keys: list[str], text: str, target: int = 4200, overlap: int = 400) -> DataFrame:
    """keys, chunk_index, char_start, char_end, text of every chunk; null and blank texts give none."""
    names = [*keys, "chunk_index", "char_start", "char_end", "text"]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                row, rest = [], []
                for i, t in enumerate(b.column(len(keys)).to_pylist()):
                    for j, c in enumerate(pack_paragraphs(t or "", target, overlap)):
                        row.append(i)
                        rest.append((j, *c))
                cols = list(zip(*rest)) or [(), (), (), ()]
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), *(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.string())], names)

    return df.select(*keys, text).mapInArrow(run, f"{kinds}, chunk_index int, char_start int, char_end int, text string")


def chunk_records(documents: DataFrame, least: int = 300) -> DataFrame:
    """The chunk table of documents (source_id, path, part, text, metadata): ids, hashes, lineage, filtered and deduplicated.

    Indexes count rejected chunks too; of equal chunks the first in order of (source_id, index) stays.
    """
    meta = documents.select("source_id", "path", "part", "text", F.col("metadata.source_group").alias("source_group"), F.col("metadata.domain").alias("domain"), F.col("metadata.title").alias("title"), F.col("metadata.license").alias("license")).where("text is not null").dropDuplicates(["source_id", "part"])
    parts = chunk(meta, ["source_id", "path", "part", "source_group", "domain", "title", "license"], "text")
    c = parts.withColumn("chunk_id", F.concat("source_id", F.lit("-"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))).withColumn("chunk_content_hash", stable_hash(F.lower(normalize_text("text")), 32))
    c = c.withColumn("lineage_component_id", lineage("source_group", "part"))
    good = c.where(~F.col("text").contains("�") & (F.length(normalize_text("text")) >= least) & ~T.blocked_script("text") & T.non_substantive("text").isNull())
    return first_by(good, ["chunk_content_hash"], ["source_id", "part", "chunk_index"])


def lineage(group: str, part: str, mode: str = "auto", block: int = 16):
    """source, part or page_block lineage; "auto" takes page blocks for pages and parts for everything else."""
    page = F.regexp_extract(F.coalesce(part, F.lit("")), r"^page-(\d+)$", 1)
    g = F.coalesce(group, F.lit("unknown"))
    blocks = F.concat(g, F.lit("-pages-"), F.lpad(F.floor((page.try_cast("int") - 1) / block).cast("string"), 4, "0"))
    parts = F.concat(g, F.lit("-part-"), stable_hash(F.coalesce(part, F.lit("")), 12))
    return {"source": g, "part": parts, "page_block": F.when(page != "", blocks).otherwise(parts), "auto": F.when(page != "", blocks).otherwise(parts)}[mode]


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by an order, as an aggregate: partial per task, so hot keys never sort in one place."""
    cols = [F.col(c) for c in df.columns]
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_r"))
    return best.select("_r.*")


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, content_hash, kept_key, copies: every row with the representative of its exact duplicates (least key)."""
    h = df.select(key, stable_hash(F.lower(normalize_text(F.coalesce(text, F.lit("")))), 32).alias("content_hash"))
    g = h.groupBy("content_hash").agg(F.min(key).alias("kept_key"), F.count(F.lit(1)).alias("copies"))
    return h.join(g, "content_hash")


WORD = re.compile(r"[a-z0-9_]+")


def simhash64(text: str) -> int:
    """Signed 64-bit simhash over 4-word shingles; a bit is set when at least half of the shingles set it."""
    w = WORD.findall(text.lower())
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    digests = np.frombuffer(b"".join(hashlib.sha256(g.encode()).digest()[:8] for g in grams), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(digests, axis=1).sum(axis=0)
    return int(np.packbits(2 * ones.astype(np.int64) >= len(grams)).view(">u8")[0].astype(np.uint64).view(np.int64))


def simhashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, fingerprint of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([simhash64(t or "") for t in b.column(1).to_pylist()], pa.int64())], [key, "fingerprint"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint long")


def near_duplicates(df: DataFrame, key: str, text: str, distance: int = 3) -> DataFrame:
    """key, duplicate_of, type: rows removed as exact or near copies, visiting keys as strings in order.

    Exact copies of a removed row are near copies of what it copies.
    A row is a near copy of an earlier kept row whose fingerprint shares the leading 16 bits and differs in at
    most ``distance`` bits; removed rows represent nothing. Exact copies collapse first, so a bucket holds only
    different texts; equal fingerprints in a bucket collapse as well before the greedy pass.
    """
    groups = stored(exact_groups(df.select(F.col(key).cast("string").alias("k"), text), "k", text))
    exact = groups.where("k <> kept_key").select("k", F.col("kept_key").alias("duplicate_of"), F.lit("exact").alias("type"))
    kept = df.select(F.col(key).cast("string").alias("k"), text).join(groups.where("k = kept_key").select("k"), "k", "left_semi")
    prints = stored(simhashes(kept, "k", text))
    same = prints.groupBy("fingerprint").agg(F.min("k").alias("k"))
    twins = prints.withColumnRenamed("k", "other").join(same, "fingerprint").where("other <> k").select(F.col("other").alias("k"), F.col("k").alias("duplicate_of"), F.lit("near").alias("type"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, reps, names = None, np.zeros(64, np.uint64), []
        for batch in batches:  # sorted by bucket, then key
            out = []
            for b, k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy().view(np.uint64)):
                if b != bucket:
                    bucket, names = b, []
                n = len(names)
                near = np.flatnonzero(np.bitwise_count(reps[:n] ^ f) <= distance) if n else ()
                if len(near):
                    out.append((k, names[near[0]]))
                    continue
                if n == len(reps):
                    reps = np.concatenate([reps, np.zeros(n, np.uint64)])
                reps[n] = f
                names.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string()), pa.array(["near"] * len(out), pa.string())], ["k", "duplicate_of", "type"])

    bucketed = same.withColumn("b", F.expr("shiftrightunsigned(fingerprint, 48)"))
    shared = bucketed.groupBy("b").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("b")
    near = stored(bucketed.join(shared, "b", "left_semi").select("b", "k", "fingerprint").repartition("b").sortWithinPartitions("b", "k").mapInArrow(greedy, "k string, duplicate_of string, type string"))

    def resolved(copies: DataFrame, removed: DataFrame) -> DataFrame:
        """Copies of removed rows are near copies of the row for which those went."""
        r = removed.select(F.col("k").alias("_k"), F.col("duplicate_of").alias("_of"))
        return copies.join(r, F.col("duplicate_of") == F.col("_k"), "left").select("k", F.coalesce("_of", "duplicate_of").alias("duplicate_of"), F.when(F.col("_of").isNotNull(), "near").otherwise(F.col("type")).alias("type"))

    removed = stored(near.union(resolved(twins, near)))
    return removed.union(resolved(exact, removed))


def audit(chunks: DataFrame) -> DataFrame:
    """One row of violation counts over a chunk table (chunk_id, text, license, domain, source_group, chunk_content_hash)."""
    c = lambda x: F.sum(F.when(x, 1).otherwise(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("source_group").alias("groups"), F.countDistinct("domain").alias("domains"),
        (F.count("chunk_id") - F.countDistinct("chunk_id")).alias("duplicate_ids"), (F.count("chunk_content_hash") - F.countDistinct("chunk_content_hash")).alias("duplicate_hashes"),
        c(F.col("license").isNull()).alias("missing_license"), c(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty_text"), c(F.col("text").contains("�")).alias("replacement_characters"),
        c(T.blocked_script("text")).alias("blocked_script"), c(T.has_secret("text")).alias("secrets"), c(T.has_reasoning("text")).alias("reasoning_markers"),
    )


def word_count(x):
    return F.size(words(x))
