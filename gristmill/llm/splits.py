"""Problem 5: splits that keep related records together, by min-cost flow over bundles of components."""

from __future__ import annotations

import heapq
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.canon import label
from gristmill.llm.components import connected_components
from gristmill.llm.selection import exact_rank, key_hash
from gristmill.session import cut, maybe_broadcast, table

#: Words and marks that stand for "not known" (after label()); they tie nothing.
UNKNOWN = ["-", "--", "?", "??", ".", "n/a", "n.a.", "#n/a", "na", "nan", "nil", "none", "null", "unknown", "not-known", "not-available", "undefined", "unspecified", "missing", "tbd", "tba"]


def known(col: Column | str) -> Column:
    x = label(col, "-")
    return F.when(~x.isin(UNKNOWN), x)


class MinCostFlow:
    """Successive shortest paths with potentials, for a graph of bundle classes; not for data."""

    def __init__(self, n: int):
        self.n, self.g = n, [[] for _ in range(n)]

    def edge(self, u: int, v: int, cap: int, cost: int) -> list:
        a = [v, cap, cost, None]
        b = [u, 0, -cost, a]
        a[3] = b
        self.g[u].append(a)
        self.g[v].append(b)
        return a

    def run(self, s: int, t: int) -> None:
        high = [0] * self.n
        while True:
            dist, via = {s: 0}, {}
            queue = [(0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u]:
                    continue
                for e in self.g[u]:
                    if e[1] > 0 and (x := d + e[2] + high[u] - high[e[0]]) < dist.get(e[0], 1 << 62):
                        dist[e[0]], via[e[0]] = x, e
                        heapq.heappush(queue, (x, e[0]))
            if t not in dist:
                return
            for v in range(self.n):
                high[v] += dist.get(v, dist[t])
            most, v = 1 << 62, t
            while v != s:
                most, v = min(most, via[v][1]), via[v][3][0]
            v = t
            while v != s:
                via[v][1] -= most
                via[v][3][1] += most
                v = via[v][3][0]


def allocate(bundles: dict[tuple[int, str], int], shares: list[int]) -> dict[tuple[int, str], list[int]]:
    """Components of each bundle (size, profile) per split, so that splits and profiles come near their shares.

    A flow in records runs from classes of bundles through (split, profile) to splits and the sink. Going over a
    profile's quota in a split costs 1 a record, over a split's quota 4; putting a component into a split whose
    quota is smaller than it costs 16. Bundles of one profile that fit into the same splits are one class, as their
    edges are alike. Rounding goes from the largest components down: each takes the split with the most flow left.
    """
    k, total = len(shares), sum(s * n for (s, _), n in bundles.items())
    whole = sum(shares)
    profiles = sorted({p for _, p in bundles})
    held = {p: sum(s * n for (s, q), n in bundles.items() if q == p) for p in profiles}
    quota = [total * x // whole for x in shares]
    kind = lambda s: tuple(s <= q for q in quota)
    classes: dict[tuple, int] = {}
    for (s, p), n in bundles.items():
        classes[kind(s), p] = classes.get((kind(s), p), 0) + s * n
    names = sorted(classes)
    cell = {(j, p): 1 + len(names) + i for i, (j, p) in enumerate((j, p) for j in range(k) for p in profiles)}
    split0 = 1 + len(names) + len(cell)
    sink = split0 + k
    flow, took = MinCostFlow(sink + 1), {}
    for i, (fit, p) in enumerate(names):
        flow.edge(0, 1 + i, classes[fit, p], 0)
        for j in range(k):
            took[fit, p, j] = flow.edge(1 + i, cell[j, p], 1 << 60, 0 if fit[j] else 16)
    for (j, p), v in cell.items():
        flow.edge(v, split0 + j, held[p] * shares[j] // whole, 0)
        flow.edge(v, split0 + j, 1 << 60, 1)
    for j in range(k):
        flow.edge(split0 + j, sink, quota[j], 0)
        flow.edge(split0 + j, sink, 1 << 60, 4)
    flow.run(0, sink)
    left = {key: e[3][1] for key, e in took.items()}
    out = {}
    for s, p in sorted(bundles, key=lambda b: (-b[0], b[1])):
        n, got = bundles[s, p], [0] * k
        have = [left[kind(s), p, j] for j in range(k)]
        for j in range(k):  # whole components first, in one step
            got[j] = min(n - sum(got), max(0, have[j]) // s)
        while sum(got) < n:  # at most k + 1 more: what is left of the flow is less than one component a split
            j = max(range(k), key=lambda j: (have[j] - got[j] * s, shares[j]))
            got[j] += 1
        for j in range(k):
            left[kind(s), p, j] -= got[j] * s
        out[s, p] = got
    return out


def rebalance(labels: np.ndarray, plan: np.ndarray, shares: list[int], most: int = 5000) -> np.ndarray:
    """Components of each bundle per split, moved one by one while the splits' deviations from their quotas fall.

    labels: bundles by labels, the members of one component; plan: bundles by splits. The cost is the sum over labels
    and splits of the squared deviation, each label weighed by its members, and of the splits' sizes. Every step takes
    the move that gains most; it ends when none gains, or after ``most`` moves.
    """
    plan = plan.copy()
    count, whole = plan.sum(1), sum(shares)
    v = np.concatenate([labels, labels.sum(1, keepdims=True)], 1).astype(np.float64)
    held = count @ v
    v /= np.sqrt(np.maximum(1.0, held))
    off = plan.T @ v - np.outer(np.array(shares) / whole, count @ v)
    square = 2 * (v * v).sum(1)
    moves = [(j, k) for j in range(len(shares)) for k in range(len(shares)) if j != k]
    for _ in range(most):
        gain = np.stack([np.where(plan[:, j] > 0, 2 * v @ (off[k] - off[j]) + square, np.inf) for j, k in moves], 1)
        b, m = np.unravel_index(np.argmin(gain), gain.shape)
        if gain[b, m] >= -1e-12:
            break
        j, k = moves[m]
        plan[b, j] -= 1
        plan[b, k] += 1
        off[j] -= v[b]
        off[k] += v[b]
    return plan


def allocate_profiles(bundles: dict[tuple[int, ...], int], shares: list[int]) -> dict[tuple[int, ...], list[int]]:
    """Components of each bundle of one label profile (members by label) per split: the flow by size and leading label, then rebalance()."""
    keys = sorted(bundles)
    if not keys:
        return {}
    labels = np.array(keys, np.int64)
    lead = [(int(x.sum()), str(int(x.argmax()))) for x in labels]
    by_lead: dict[tuple[int, str], int] = {}
    for k, p in zip(keys, lead):
        by_lead[p] = by_lead.get(p, 0) + bundles[k]
    left = {p: list(x) for p, x in allocate(by_lead, shares).items()}
    plan = np.zeros((len(keys), len(shares)), np.int64)
    for i, (k, p) in enumerate(zip(keys, lead)):
        n = bundles[k]
        for j in range(len(shares)):
            plan[i, j] = took = min(n, left[p][j])
            left[p][j] -= took
            n -= took
    return dict(zip(keys, rebalance(labels, plan, shares).tolist()))


def _node(kind: str, col: Column | str) -> Column:
    return F.when(F.col(col).isNotNull(), F.xxhash64(F.lit(kind), col)) if isinstance(col, str) else F.when(col.isNotNull(), F.xxhash64(F.lit(kind), col))


def tied_nodes(rows: DataFrame, item: str, ties: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct (item, one node per tie), and the edges between nodes: within a row, and within an item's rows.

    Nodes are 64-bit hashes of a tie's kind and value. Nulls make no node. An item whose rows disagree links the
    nodes of all its rows to the least of them; only such items are looked at a second time.
    """
    nodes = cut(rows.select(item, *[_node(t, t).alias(f"_n{i}") for i, t in enumerate(ties)]).distinct())
    cols = [F.col(f"_n{i}") for i in range(len(ties))]
    first = F.array_min(F.array(*cols))
    inside = nodes.select(F.explode(F.array(*cols)).alias("u"), first.alias("v")).where("u is not null and u <> v")
    several = nodes.groupBy(item).agg(F.count(F.lit(1)).alias("_c"), F.min(first).alias("v")).where("_c > 1 and v is not null")
    across = nodes.join(several.select(item, "v"), item).select(first.alias("u"), "v").where("u is not null and u <> v")
    return nodes, inside.union(across).distinct()


def component_of_items(nodes: DataFrame, edges: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """(item, component), one row per item, and (node, component). Items without any known tie stand alone."""
    labels = cut(connected_components(edges, "u", "v"))
    cols = [c for c in nodes.columns if c != item]
    one = nodes.groupBy(item).agg(F.min(F.array_min(F.array(*cols))).alias("node"))
    found = one.join(maybe_broadcast(labels, labels.count()), "node", "left")
    return found.select(item, F.coalesce("component", "node", F.xxhash64(F.lit("item"), item)).alias("component")), labels


SPLITS = ["train", "validation", "test"]
SHARES = [80, 10, 10]


#: Bundles of one label profile that reach the driver; smaller components are then bundled by their leading label.
PROFILES = 20_000


def grouped_splits(rows: DataFrame, item: str, ties: list[str], profile: str, shares: list[int] = SHARES, profiles: int = PROFILES) -> DataFrame:
    """(item, component, split): one row per item, all items of a component in one split.

    rows may repeat items; null items are left out, null ties tie nothing, a null profile counts as "", of several
    an item has the least. Components of one label profile (members by label) are a bundle; splits come near their
    shares as a whole and in every label. Only bundles with their numbers reach the driver: up to ``profiles``, the
    largest first; of components smaller than those only size and leading label count, as their other labels even out
    by number. A component larger than any quota still goes somewhere, whole. No rows give no rows. Labels should be
    few (as domains are).
    """
    rows = rows.where(F.col(item).isNotNull())
    nodes, edges = tied_nodes(rows, item, ties)
    of_item, _ = component_of_items(nodes, edges, item)
    of_item = cut(of_item)
    tally = of_item.join(rows.groupBy(item).agg(F.coalesce(F.min(profile), F.lit("")).alias("profile")), item).groupBy("component", "profile").agg(F.count(F.lit(1)).alias("n"))
    comps = cut(tally.groupBy("component").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("profile", "n"))).alias("labels"), F.min_by("profile", F.struct(-F.col("n"), F.col("profile"))).alias("lead")))
    by_size = sorted(((r["size"], r["n"]) for r in comps.groupBy("size").agg(F.countDistinct("labels").alias("n")).collect()), reverse=True)
    least, room = 0, profiles
    for size, n in by_size:
        room -= n
        if room < 0:
            least = size + 1
            break
    whole = F.when(F.col("size") >= least, F.col("labels")).otherwise(F.array(F.struct(F.col("lead").alias("profile"), F.col("size").alias("n"))))
    comps = comps.select("component", F.to_json(whole).alias("bundle"))
    counted = {r["bundle"]: r["n"] for r in comps.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).collect()}
    parsed = {b: {x["profile"]: x["n"] for x in json.loads(b)} for b in counted}
    names = sorted({k for x in parsed.values() for k in x})
    keys = {b: tuple(x.get(k, 0) for k in names) for b, x in parsed.items()}
    got = allocate_profiles({keys[b]: n for b, n in counted.items()}, shares)
    plan = [(b, *got[keys[b]][:2]) for b in counted]
    counts = rows.sparkSession.createDataFrame(plan, "bundle string, _a long, _b long")
    ranked = exact_rank(comps.withColumn("_h", key_hash("component", seed=5)).withColumn("_hb", F.shiftright("_h", 18)), ["bundle"], "_hb", ["_h", "component"])
    split = F.when(F.col("rank") <= F.col("_a"), SPLITS[0]).when(F.col("rank") <= F.col("_a") + F.col("_b"), SPLITS[1]).otherwise(SPLITS[2])
    placed = ranked.join(maybe_broadcast(counts, len(plan)), "bundle").select("component", split.alias("split"))
    return of_item.join(placed, "component").select(item, "component", "split")


def job_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "episode_job")
    return jobs.select("episode_id", known("source_group").alias("source_group"), known("lineage_component_id").alias("lineage_component_id"), label("domain", "_").alias("domain"))


TIES = ["source_group", "lineage_component_id"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of groups of one component. The pairs are the stated result; all before them is one row per node."""
    jobs = cut(job_ties(spark, sf_dir).where("episode_id is not null"))
    nodes, edges = tied_nodes(jobs, "episode_id", TIES)
    labels = connected_components(edges, "u", "v")
    groups = jobs.select("source_group").where("source_group is not null").distinct().withColumn("node", _node("source_group", "source_group"))
    placed = cut(groups.join(labels, "node").select("component", "source_group"))
    a, b = placed.withColumnRenamed("source_group", "source_group_a"), placed.withColumnRenamed("source_group", "source_group_b")
    return a.join(b, "component").where("source_group_a < source_group_b").select("source_group_a", "source_group_b")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_splits(job_ties(spark, sf_dir), "episode_id", TIES, "domain")
