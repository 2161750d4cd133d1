"""Problem 6: filling containers of fixed capacity.

Texts are measured in tokens; a text longer than the capacity is cut into pieces of exactly the
capacity and one remainder, all others stay whole. What the packing needs to know is the histogram
of piece lengths, at most ``capacity`` numbers however many texts there are. On it the
configuration linear program (a covering program with one variable for each way to fill a
container) is solved by multiplicative weights, each kind of container in a task of its own:

* Prices of the lengths start from the best of a family of dual feasible functions and are
  multiplied by weights that fall with the share of a length that is covered already; a length
  leaves the program when it is covered.
* Each round prices configurations by an unbounded knapsack dynamic program over the lengths.
  Its value bounds the program from below: the prices, divided by it, are a dual solution. All
  configurations of the best value (within a tolerance) that the remaining pieces allow are taken,
  up to an equal part of the bound for each round.
* Configurations are taken whole times, so the solution comes out rounded. When less than
  :data:`REST` of the tokens are left, or no configuration is near the best value at the loosest
  tolerance, the rest fills the open space and then new containers, longest first into the
  tightest fit, still on the histogram.

:func:`report` gives the lower bound, the share of tokens placed in the last step, and what
tightest fit alone would need.

The plan is applied in Spark: pieces get a rank among the pieces of their length - counted in the
partitions first and offset by a prefix sum, so a length that a third of all texts have is never
sorted in one task - and the rank decides the container.

Defined results: null texts and texts without tokens need no container and give no row; repeated
ids are packed as separate texts; an empty table gives an empty result; capacities below 1 raise
an error. Extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import cut

#: rounds of multiplicative weights that would reach the bound, their step, and the most states of the knapsack program
ROUNDS, STEP, STATES = 48, 0.5, 2048
#: the part of a length's own size in its first price: among equal prices the fuller container is better
SIZE_PART = 0.02
#: how far a configuration may be below the best value, at first and at last; tokens left to the last step
TOLERANCE, LOOSEST, REST = 1e-3, 2e-2, 0.02


def first_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The best dual feasible function of the family, and the bound it gives.

    Sizes above capacity - t count 1, sizes from t on their share of the capacity, others nothing.
    """

    def prices(t: int) -> np.ndarray:
        return np.where(sizes > capacity - t, 1.0, np.where(sizes >= t, sizes / capacity, 0.0))

    bound, t = max((float((prices(t) * counts).sum()), -t) for t in range(capacity // 2 + 1))
    return prices(-t), bound


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The most value that fits into each space up to the capacity, every item as often as wanted."""
    best = np.zeros(capacity + 1)
    several = 2 * sizes <= capacity
    for s, v in zip(sizes[several].tolist(), values[several].tolist(), strict=True):
        if v > 0:  # along each residue of s, one more item is one row further down
            rows = -(-(capacity + 1) // s)
            grid = np.full(rows * s, -np.inf)
            grid[: capacity + 1] = best
            gain = (v * np.arange(rows))[:, None]
            best = (np.maximum.accumulate(grid.reshape(rows, s) - gain, axis=0) + gain).reshape(-1)[: capacity + 1]
    beside = best.copy()
    for s, v in zip(sizes[~several].tolist(), values[~several].tolist(), strict=True):
        if v > 0 and s <= capacity:
            np.maximum(best[s:], v + beside[: capacity + 1 - s], out=best[s:])
    return np.maximum.accumulate(best)


def one_configuration(
    values: np.ndarray, sizes: np.ndarray, left: np.ndarray, best: np.ndarray, capacity: int, grid: int
) -> tuple[dict[int, int], float]:
    """({item: times}, value) of a filling by pieces that are left, as good as the table ``best`` allows.

    The table has one entry for ``grid`` tokens; the space itself is followed exactly.
    """
    used: dict[int, int] = {}
    value, space = 0.0, capacity
    while k := int(np.searchsorted(sizes, space, side="right")):
        free = left[:k] > 0
        for i, n in used.items():
            if i < k and n >= left[i]:
                free[i] = False
        gain = np.where(free, values[:k] + best[(space - sizes[:k]) // grid], -1.0)
        most = gain.max()
        if most <= 0:
            break
        i = k - 1 - int(np.argmax((gain >= most - 1e-9)[::-1]))  # the longest of the best
        used[i] = used.get(i, 0) + 1
        value += values[i]
        space -= int(sizes[i])
    return used, value


def configurations(hist: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """([({length: times}, containers)], lower bound): the program solved in whole containers.

    Above :data:`STATES` tokens the program counts space in larger units, lengths rounded up.
    """
    s = np.array(sorted(hist))
    n = np.array([hist[x] for x in s.tolist()])
    grid = -(-capacity // STATES)
    units, first = np.unique(-(-s // grid), return_index=True)
    price, bound = first_prices(s, n, capacity)
    price = price + SIZE_PART * s / capacity
    left, total = n.copy(), int((s * n).sum())
    each, tolerance = max(1, math.ceil(bound / ROUNDS)), TOLERANCE
    out: list[tuple[dict[int, int], int]] = []
    while (s * left).sum() > REST * total and tolerance <= LOOSEST:
        open_ = left > 0
        covered = 1 - left / n
        values = np.where(open_, price * np.exp(-STEP * (covered - covered[open_].mean())), 0.0)
        best = knapsack(np.maximum.reduceat(values, first), units, capacity // grid)
        if grid == 1:  # else the table is below the program's value and bounds nothing
            bound = max(bound, float((values * n).sum()) / best[-1])
        taken = 0
        while taken < each:
            used, value = one_configuration(values, s, left, best, capacity, grid)
            if not used or value < (1 - tolerance) * best[-1]:
                break
            k = min(each - taken, *(int(left[i]) // a for i, a in used.items()))
            for i, a in used.items():
                left[i] -= k * a
            out.append(({int(s[i]): a for i, a in used.items()}, k))
            taken += k
        if not taken:
            tolerance *= 2
    return out, bound


class Plan:
    """Which container each piece of a length goes to, by its rank among those pieces."""

    def __init__(self, hist: dict[int, int], capacity: int):
        if capacity < 1:
            raise ValueError("a container needs a capacity of at least 1")
        self.capacity, self.containers, self.bound, self.rest = capacity, 0, 0, 0
        self.slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # start, first, per
        hist = {int(k): int(v) for k, v in hist.items() if v > 0}
        self._next = dict.fromkeys(hist, 0)
        full = hist.pop(capacity, 0)
        if full:
            self._put(capacity, full, 0, 1)
            self.containers = self.bound = full
        if hist:
            self._pack(hist)

    @classmethod
    def tightest_fit(cls, hist: dict[int, int], capacity: int) -> int:
        """The containers that longest first into the tightest fit needs by itself, to compare with."""
        plan = cls({}, capacity)
        full = int(hist.get(capacity, 0))
        rest = {int(k): int(v) for k, v in hist.items() if v > 0 and k != capacity}
        plan._next = dict.fromkeys(rest, 0)
        plan._fill(rest, [])
        return plan.containers + full

    def _put(self, length: int, n: int, first: int, per: int) -> None:
        self.slots[length].append((self._next[length], first, per))
        self._next[length] += n

    def _pack(self, hist: dict[int, int]) -> None:
        chosen, bound = configurations(hist, self.capacity)
        self.bound += math.ceil(bound - 1e-6)
        rest, bins = dict(hist), []  # [free, count, first]
        for config, k in chosen:
            for length, a in config.items():
                self._put(length, k * a, self.containers, a)
                rest[length] -= k * a
            bins.append([self.capacity - sum(length * a for length, a in config.items()), k, self.containers])
            self.containers += k
        rest = {x: v for x, v in rest.items() if v}
        self.rest = sum(k * v for k, v in rest.items())
        self._fill(rest, bins)

    def _fill(self, rest: dict[int, int], bins: list[list]) -> None:
        """Longest first into the tightest fit; bins are groups of containers with equal space."""
        ids, free = {}, []
        for k, b in enumerate(bins):
            ids[k] = b
            insort(free, (b[0], k))
        serial = len(bins)
        for length in sorted(rest, reverse=True):
            n = rest[length]
            while n:
                at = bisect_left(free, (length, -1))
                if at == len(free):
                    per = self.capacity // length
                    count = max(1, n // per)
                    ids[serial] = [self.capacity, count, self.containers]
                    self.containers += count
                    insort(free, (self.capacity, serial))
                    serial += 1
                    continue
                space, k = free.pop(at)
                _, count, first = ids.pop(k)
                per = min(space // length, n)
                use = min(count, n // per)
                self._put(length, use * per, first, per)
                n -= use * per
                for new_space, new_count, new_first in ((space - per * length, use, first), (space, count - use, first + use)):
                    if new_count and new_space:
                        ids[serial] = [new_space, new_count, new_first]
                        insort(free, (new_space, serial))
                        serial += 1

    def rows(self) -> list[tuple[int, int, int, int]]:
        return [(length, *slot) for length, slots in self.slots.items() for slot in slots]


def pieces(sizes: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(key, kind, piece_no, start, len) of all pieces for all kinds of containers.

    ``sizes`` has (key, tokens). Full pieces and the remainder of a long text follow in order.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(int(c)).cast("bigint").alias("cap")) for k, c in specs))
    each = sizes.where("tokens > 0").select("key", "tokens", F.explode(kinds).alias("k")).select("key", "tokens", "k.*")
    n = F.expr("int((tokens + cap - 1) div cap)")
    return each.select("key", "kind", "cap", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no")).select(
        "key",
        "kind",
        "piece_no",
        (F.col("piece_no") * F.col("cap")).alias("start"),
        F.least(F.col("cap"), F.col("tokens") - F.col("piece_no") * F.col("cap")).alias("len"),
    )


# What is known of a plan: the containers' lower bound, what tightest fit alone needs, and the tokens that its last step placed
SUMMARY = "bound bigint, tightest_fit bigint, rest bigint"


def plans(hist: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(kind, len, slot_start, first, per, ...SUMMARY) from (kind, len, n), each kind in a task.

    A group has one row for each length, at most the capacity of the kind.
    """
    caps = dict(specs)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        kind, lengths = rows["kind"].iloc[0], dict(zip(rows["len"], rows["n"], strict=True))
        plan = Plan(lengths, caps[kind])
        out = pd.DataFrame(plan.rows(), columns=["len", "slot_start", "first", "per"])
        out.insert(0, "kind", kind)
        return out.assign(bound=plan.bound, tightest_fit=Plan.tightest_fit(lengths, caps[kind]), rest=plan.rest)

    schema = f"kind string, len bigint, slot_start bigint, first bigint, per bigint, {SUMMARY}"
    return hist.groupBy("kind").applyInPandas(one, schema)


def pack(sizes: DataFrame, specs: list[tuple[str, int]]) -> tuple[DataFrame, DataFrame]:
    """The assignment (container_kind, container_id, key, piece_no, start, len), and (container_kind, ...SUMMARY)."""
    for _, c in specs:
        if c < 1:
            raise ValueError("a container needs a capacity of at least 1")
    parts = cut(pieces(sizes, specs).withColumn("part", F.spark_partition_id()))
    counts = cut(parts.groupBy("kind", "len", "part").agg(F.count("*").alias("n")))
    planned = cut(plans(counts.groupBy("kind", "len").agg(F.sum("n").alias("n")), specs))
    slots: dict[tuple[str, int], np.ndarray] = {}
    found = planned.select("kind", "len", "slot_start", "first", "per").toPandas()  # as large as the plan, whatever the data
    for (kind, length), at in found.groupby(["kind", "len"]).indices.items():
        slots[kind, length] = found.iloc[at, 2:].sort_values("slot_start").to_numpy(np.int64)
    shared = sizes.sparkSession.sparkContext.broadcast(slots)

    before = Window.partitionBy("kind", "len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("kind", "len", "part").orderBy("key", "piece_no")
    ranked = (
        parts.withColumn("rank", F.row_number().over(within) - 1)
        .join(offsets, ["kind", "len", "part"])
        .select("key", "kind", "piece_no", "start", "len", (F.col("rank") + F.col("offset")).alias("rank"))
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for (kind, length), at in b.groupby(["kind", "len"]).indices.items():
                s = table[kind, length]
                r = b["rank"].to_numpy()[at]
                i = np.searchsorted(s[:, 0], r, side="right") - 1
                out[at] = s[i, 1] + (r - s[i, 0]) // s[i, 2]
            b = b.rename(columns={"kind": "container_kind"})
            b["container_id"] = out
            yield b[["container_kind", "container_id", "key", "piece_no", "start", "len"]]

    key_type = dict(sizes.dtypes)["key"]
    schema = f"container_kind string, container_id bigint, key {key_type}, piece_no int, start bigint, len bigint"
    summary = planned.select(F.col("kind").alias("container_kind"), "bound", "tightest_fit", "rest").distinct()
    return ranked.mapInPandas(place, schema), summary


def report(assigned: DataFrame, summary: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """How full the containers are, and how the plan compares.

    (container_kind, capacity, containers, tokens, fill, over, bound, gap, tightest_fit, rest_share)
    """
    kinds = assigned.sparkSession.createDataFrame([(k, int(c)) for k, c in specs], "container_kind string, capacity bigint")
    each = assigned.groupBy("container_kind", "container_id").agg(F.sum("len").alias("used"))
    filled = (
        each.join(F.broadcast(kinds), "container_kind")
        .groupBy("container_kind", "capacity")
        .agg(
            F.count("*").alias("containers"),
            F.sum("used").alias("tokens"),
            F.round(F.sum("used") / (F.count("*") * F.first("capacity")), 6).alias("fill"),
            F.sum((F.col("used") > F.col("capacity")).cast("int")).alias("over"),
        )
    )
    gap = F.round(F.col("containers") / F.col("bound") - 1, 6)
    return filled.join(F.broadcast(summary), "container_kind").select(  # one row a kind
        *filled.columns, "bound", gap.alias("gap"), "tightest_fit", F.round(F.col("rest") / F.col("tokens"), 6).alias("rest_share")
    )
