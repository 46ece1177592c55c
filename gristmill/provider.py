"""The model surface: requests in, replies out, one Arrow batch at a time; the default provider replays stored replies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    def complete(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(reply, error) of each prompt."""


class Echo:
    """Answers with the prompt's last line; for tests."""

    def complete(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        return [(p.strip().rpartition("\n")[2], None) for p in prompts]


def run_provider(requests: DataFrame, key: str, prompt: str, provider: Provider, attempts: int = 3, workers: int | None = None) -> DataFrame:
    """key, reply, status, attempt, error: each prompt is tried up to ``attempts`` times; ``workers`` bounds concurrency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = [p or "" for p in b.column(1).to_pylist()]
            out: list[tuple] = [(None, "failed", attempts, "not tried")] * len(prompts)
            left = list(range(len(prompts)))
            for n in range(1, attempts + 1):
                got = provider.complete([prompts[i] for i in left])
                for i, (reply, error) in zip(left, got):
                    out[i] = (reply, "ok" if error is None else "failed", n, error)
                left = [i for i in left if out[i][1] != "ok"]
                if not left:
                    break
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], [key, "reply", "status", "attempt", "error"])

    df = requests.select(key, prompt)
    return (df.repartition(workers) if workers else df).mapInArrow(run, f"`{key}` {requests.schema[key].dataType.simpleString()}, reply string, status string, attempt int, error string")


def replay(requests: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Replies from a table instead of a model; requests without one fail."""
    one = stored.groupBy(key).agg(F.min_by(F.struct("reply"), F.struct("reply")).alias("_r")).select(key, "_r.reply")
    return requests.join(one, key, "left").withColumn("status", F.when(F.col("reply").isNotNull(), "ok").otherwise("failed"))
