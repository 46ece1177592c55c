"""Problem 9: filling containers of a fixed number of tokens by sum-of-squares online packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.bpe import default_vocabulary, encoder
from gristmill.session import spread, stored, table

#: Tokens a container holds, and items packed by one task; the loss at a shard's end is a few containers of thousands.
CAPACITY = 2048
SHARD_ITEMS = 50_000


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container, offset) of each size, in the given order; sizes from 1 to capacity.

    levels[h] counts the open containers filled to h. An item goes where the sum of the squared counts grows
    least (ties: the fullest level), which keeps all levels in use and leaves no level crowded. At the end the
    containers still open are joined, the fullest first, into the fullest one that has room.
    """
    levels = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    container, offset, made = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    never = np.int64(1 << 60)
    for i, s in enumerate(sizes.tolist()):
        best, level = (0 if s == capacity else 2 * int(levels[s]) + 1), 0
        if s < capacity:
            low = levels[1 : capacity - s + 1]
            grow = levels[s + 1 : capacity + 1] - low
            grow *= 2
            grow += 2
            grow[-1] -= 1  # a full container leaves the levels
            grow[low == 0] = never
            h = capacity - s - int(np.argmin(grow[::-1]))
            if grow[h - 1] <= best:
                level = h
        if level:
            levels[level] -= 1
            c = open_at[level].pop()
        else:
            c, made = made, made + 1
        container[i], offset[i] = c, level
        if level + s < capacity:
            levels[level + s] += 1
            open_at[level + s].append(c)
    move_to, move_by = np.arange(made), np.zeros(made, np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, bool)
    for h in range(capacity - 1, 0, -1):
        for c in open_at[h]:
            fit = np.flatnonzero(free[: capacity - h + 1])
            level = int(fit[-1]) if len(fit) else 0
            target = room[level].pop() if level else c
            if level and not room[level]:
                free[level] = False
            move_to[c], move_by[c] = target, level
            if level + h < capacity:
                room[level + h].append(target)
                free[level + h] = True
    offset += move_by[container]
    return move_to[container], offset


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens int): tokens of each text; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(enc.encode(t.as_py() or "")) for t in b.column(1)], pa.int32())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens int")


def pack_items(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece, first_token, n_tokens, container, container_offset): where every item lies.

    An item larger than the capacity is cut into full pieces and a rest; any other is one piece, whole. Items of
    null or no size take no room: one row, container and offset null. Items are dealt to shards by hash and packed
    in hash order, so a lost task is packed again alike; repeated keys are packed as often as they come.
    """
    n, whole = F.coalesce(F.col(size), F.lit(0)), F.lit(capacity)
    shards = max(1, -(-items.count() // shard_items))
    pieces = items.where(n > 0).select(key, n.cast("int").alias("_n"), F.explode(F.sequence(F.lit(0), ((n - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select(key, "piece", (F.col("piece") * whole).cast("int").alias("first_token"), F.least(whole, F.col("_n") - F.col("piece") * whole).cast("int").alias("n_tokens"))
    pieces = pieces.withColumn("_h", F.xxhash64(key, "piece")).withColumn("_shard", F.pmod("_h", F.lit(shards)))
    kind = items.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_h", "ascending"), (key, "ascending"), ("piece", "ascending")])
        c, at = pack(t.column("n_tokens").to_numpy(), capacity)
        base = (t.column("_shard")[0].as_py() if t.num_rows else 0) << 32
        return t.select([key, "piece", "first_token", "n_tokens"]).append_column("container", pa.array(c + base, pa.int64())).append_column("container_offset", pa.array(at.astype(np.int32)))

    packed = pieces.groupBy("_shard").applyInArrow(run, f"`{key}` {kind}, piece int, first_token int, n_tokens int, container long, container_offset int")
    none = items.where(n <= 0).select(key, F.lit(0).alias("piece"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("container_offset"))
    return packed.unionByName(none)


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(stored(token_counts(spread(table(spark, sf_dir, "documents")), "doc_id", "text")), "doc_id", "n_tokens")
