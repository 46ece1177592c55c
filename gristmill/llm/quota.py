"""Problem 7: a sample whose cells match target proportions, by controlled rounding and exact random-key quotas."""

from __future__ import annotations

from collections import deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.canon import label
from gristmill.llm.selection import key_hash, take_quota
from gristmill.llm.splits import MinCostFlow
from gristmill.session import cut, table


class MaxFlow:
    """Dinic's algorithm on integer capacities; meant for quota tables, not for data."""

    def __init__(self, n: int):
        self.adj: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def edge(self, u: int, v: int, cap: int) -> int:
        for a, b, c in ((u, v, cap), (v, u, 0)):
            self.adj[a].append(len(self.to))
            self.to.append(b)
            self.cap.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                u = queue.popleft()
                for e in self.adj[u]:
                    if self.cap[e] and self.to[e] not in level:
                        level[self.to[e]] = level[u] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            nxt = [0] * len(self.adj)

            def push(u: int, most: int) -> int:
                if u == t:
                    return most
                while nxt[u] < len(self.adj[u]):
                    e = self.adj[u][nxt[u]]
                    if self.cap[e] and level.get(self.to[e], -1) == level[u] + 1 and (got := push(self.to[e], min(most, self.cap[e]))):
                        self.cap[e] -= got
                        self.cap[e ^ 1] += got
                        return got
                    nxt[u] += 1
                return 0

            while got := push(s, 1 << 60):
                total += got


def controlled_rounding(cells: dict[tuple[str, str], Fraction]) -> dict[tuple[str, str], int]:
    """Rounds every cell to its floor or ceiling so that row, column and grand totals are also floor or ceiling.

    The fractional parts are a feasible flow between rows and columns with lower and upper bounds one apart, so an
    integer flow exists; it is found by max-flow after the usual shift of the lower bounds to a super source.
    """
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    at = {("r", r): i for i, r in enumerate(rows)} | {("c", c): len(rows) + i for i, c in enumerate(cols)}
    s, t = len(at), len(at) + 1
    ss, tt = t + 1, t + 2
    flow, need, chosen = MaxFlow(tt + 1), [0] * (tt + 1), {}

    def bounded(u: int, v: int, low: int, high: int) -> int:
        need[v] += low
        need[u] -= low
        return flow.edge(u, v, high - low)

    low = lambda x: x.numerator // x.denominator
    high = lambda x: -(-x.numerator // x.denominator)
    rest = {k: v - low(v) for k, v in cells.items()}
    for r in rows:
        x = sum((v for (a, _), v in rest.items() if a == r), Fraction(0))
        bounded(s, at["r", r], low(x), high(x))
    for c in cols:
        x = sum((v for (_, b), v in rest.items() if b == c), Fraction(0))
        bounded(at["c", c], t, low(x), high(x))
    for (r, c), v in sorted(rest.items()):
        if v:
            chosen[r, c] = flow.edge(at["r", r], at["c", c], 1)
    x = sum(rest.values(), Fraction(0))
    bounded(t, s, low(x), high(x))
    for v, d in enumerate(need):
        if d > 0:
            flow.edge(ss, v, d)
        elif d < 0:
            flow.edge(v, tt, -d)
    flow.run(ss, tt)
    return {k: low(v) + (k in chosen and flow.cap[chosen[k]] == 0) for k, v in cells.items()}


def bounded_quotas(cells: dict[tuple[str, str], tuple[Fraction, int, int]]) -> dict[tuple[str, str], tuple[int, int, bool]]:
    """(wanted, quota, unmet) of each cell (share, minimum, held): quotas between the bounds that keep both margins.

    Wanted numbers are the controlled rounding of the shares. Minimums are given first, as far as cells hold them. The
    rest is a flow through rows and columns up to their margins: the wanted numbers, then, where a cell holds too
    few, others of its row and column up to what they hold. So only minimums go over a margin, and margins are short
    only where no cells could make up for others. A cell is unmet if what it holds narrows the bounds of its
    rounded-up share or its minimum.
    """
    wanted = controlled_rounding({k: x for k, (x, _, _) in cells.items()})
    low = {k: min(least, have) for k, (_, least, have) in cells.items()}
    margin = lambda i, x: max(0, sum(wanted[k] - low[k] for k in cells if k[i] == x))
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    at = {("r", r): 1 + i for i, r in enumerate(rows)} | {("c", c): 1 + len(rows) + i for i, c in enumerate(cols)}
    sink = 1 + len(at)
    flow, used = MinCostFlow(sink + 1), {}
    for r in rows:
        flow.edge(0, at["r", r], margin(0, r), 0)
    for c in cols:
        flow.edge(at["c", c], sink, margin(1, c), 0)
    for (r, c), (_, _, have) in sorted(cells.items()):
        share = max(low[r, c], min(wanted[r, c], have))
        used[r, c] = [flow.edge(at["r", r], at["c", c], n, cost) for n, cost in ((share - low[r, c], 0), (have - share, 1))]
    flow.run(0, sink)
    return {k: (wanted[k], low[k] + sum(e[3][1] for e in used[k]), have < -(-x.numerator // x.denominator) or have < least) for k, (x, least, have) in cells.items()}


def cell_counts(items: DataFrame, item: str, a: str, b: str) -> tuple[DataFrame, int]:
    """Distinct items per cell, and the number of distinct items (those without a cell count there only)."""
    counts = items.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("k"))
    return counts, items.select(item).distinct().count()


def quota_table(spark: SparkSession, counts: DataFrame, mix: DataFrame, n: int, per: int, a: str, b: str) -> DataFrame:
    """Integer quotas of a sample of n / per items, with what is there and what is lacking.

    mix: a, b, target_per_mille, min_rows - a fixed small table. Quotas are those of bounded_quotas(); ``row_short`` and ``column_short`` are what the cell's
    row and column lack of theirs (below 0: what minimums add). Cells missing from mix get no quota; a mix with
    repeated cells counts them once.
    """
    want = mix.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.max("target_per_mille").alias("target_per_mille"), F.max("min_rows").alias("min_rows"))
    cells = {(r[a], r[b]): (r["target_per_mille"] or 0, r["min_rows"] or 0, r["k"] or 0) for r in want.join(counts, [a, b], "left").collect()}
    got = bounded_quotas({k: (Fraction(t * n, 1000 * per), least, have) for k, (t, least, have) in cells.items()}) if cells else {}
    short = lambda i, x: sum(w - q for k, (w, q, _) in got.items() if k[i] == x)
    out = [(*k, *cells[k], *got[k], short(0, k[0]), short(1, k[1])) for k in sorted(cells)]
    return spark.createDataFrame(out, f"{a} string, {b} string, target_per_mille int, min_rows int, available long, wanted long, quota long, unmet boolean, row_short long, column_short long")


def proportional_sample(items: DataFrame, item: str, a: str, b: str, quotas: DataFrame, seed: int = 17) -> DataFrame:
    """Exactly ``quota`` items of each cell, by smallest random key; the key is a hash of the item and the seed.

    items: one row per (item, cell); items with a null cell are never drawn. Only the bin at which a cell's quota
    ends is ranked, so a cell holding a third of all rows is spread over all tasks.
    """
    rows = items.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(item).alias("i"), F.struct(*[F.col(f"`{x}`") for x in items.columns]).alias("row"))
    keyed = rows.withColumn("_h", key_hash("i", seed=seed)).withColumn("_hb", F.shiftright("_h", 18))
    return take_quota(keyed, ["a", "b"], ["_hb"], ["_h", "i"], quotas.select(F.col(a).alias("a"), F.col(b).alias("b"), "quota")).select("row.*")


#: The sample is a tenth of the distinct rows.
PER = 10


def native_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "native_row").where(F.col("sample_id").isNotNull())
    return rows.select("sample_id", label("domain", "_").alias("domain"), label("stage", "_").alias("stage")).distinct()


def target_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "target_mix").select(label("domain", "_").alias("domain"), label("stage", "_").alias("stage"), "target_per_mille", "min_rows")


def _quotas(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    counts, n = cell_counts(items, "sample_id", "domain", "stage")
    return quota_table(spark, counts, target_cells(spark, sf_dir), n, PER, "domain", "stage")


def one_cell(items: DataFrame) -> DataFrame:
    """One cell of each sample, the least, so that none is drawn or counted twice; null cells come last."""
    return items.groupBy("sample_id").agg(F.coalesce(F.min(F.when(F.col("domain").isNotNull() & F.col("stage").isNotNull(), F.struct("domain", "stage"))), F.first(F.struct("domain", "stage"))).alias("c")).select("sample_id", "c.domain", "c.stage")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir, cut(native_cells(spark, sf_dir))).where("unmet").select("domain", "stage")


def p7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(spark, sf_dir, cut(one_cell(native_cells(spark, sf_dir))))


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = cut(one_cell(native_cells(spark, sf_dir)))
    return proportional_sample(one, "sample_id", "domain", "stage", _quotas(spark, sf_dir, one))
