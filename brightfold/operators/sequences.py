"""Ordered sequences: one by key, in the order of explicit columns. Frames and running extremes where they say it all; a fold in Arrow batches
by key where the order of work is sequential (a key's rows are one task's then)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def ordered(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def backwards(keys: list[str], order: list[str]) -> Window:
    """From a key's last row to its first: a frame that reaches to the end is read again for each row, one from the start is added to."""
    return Window.partitionBy(*keys).orderBy(*map(F.desc_nulls_last, order))


def running_avg(value: Column, w: Window, n: int) -> Column:
    """The mean of the last n values, of fewer at the start."""
    if n < 1:
        raise ValueError("n must be positive")
    return F.avg(value).over(w.rowsBetween(1 - n, 0))


def gain_so_far(value: Column, w: Window) -> Column:
    """What one buy before and one sale here earn."""
    return value - F.min(value).over(w.rowsBetween(FIRST, 0))


def two_gains(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """The largest sum of at most two trades, one after the other, by key."""
    w, v = ordered(keys, order), F.col(value)
    back = backwards(keys, order)
    x = df.withColumn("_g", gain_so_far(v, w)).withColumn("_f", F.max(v).over(back.rowsBetween(FIRST, 0)) - v)
    x = x.withColumn("_a", F.max("_g").over(w.rowsBetween(FIRST, 0))).withColumn("_b", F.max("_f").over(back.rowsBetween(FIRST, 0)))
    return x.groupBy(*keys).agg(F.greatest(F.max(F.col("_a") + F.col("_b")), F.lit(0)).alias("profit"))


def trapped(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    w, v = ordered(keys, order), F.col(value)
    left, right = F.max(v).over(w.rowsBetween(FIRST, -1)), F.max(v).over(backwards(keys, order).rowsBetween(FIRST, -1))
    return df.withColumn("_t", F.when(left.isNull() | right.isNull(), 0).otherwise(F.greatest(F.least(left, right) - v, F.lit(0)))).groupBy(*keys).agg(F.sum("_t").alias("water"))


def max_subarray(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Largest and least sums of runs that aren't empty, and of runs on a ring (empty allowed), by key: prefix sums less their running extremes."""
    w, v = ordered(keys, order), F.col(value)
    x = df.withColumn("_p", F.sum(v).over(w.rowsBetween(FIRST, 0)))
    lo, hi = F.coalesce(F.min("_p").over(w.rowsBetween(FIRST, -1)), F.lit(0)), F.coalesce(F.max("_p").over(w.rowsBetween(FIRST, -1)), F.lit(0))
    x = x.withColumn("_best", F.col("_p") - F.least(lo, F.lit(0))).withColumn("_worst", F.col("_p") - F.greatest(hi, F.lit(0)))
    got = x.groupBy(*keys).agg(F.max("_best").alias("best"), F.min("_worst").alias("worst"), F.sum(v).alias("total"))
    return got.select(*keys, "best", F.greatest(F.col("best"), F.col("total") - F.col("worst"), F.lit(0)).alias("ring"))


def reachable(df: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """Whether jumps of at most the value, from the first place on, reach the last."""
    w = ordered(keys, order)
    x = df.withColumn("_i", F.row_number().over(w))
    x = x.withColumn("_r", F.max(F.col("_i") + F.col(value)).over(w.rowsBetween(FIRST, -1)))
    return x.groupBy(*keys).agg(F.bool_and(F.col("_r").isNull() | (F.col("_r") >= F.col("_i"))).alias("reached"))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive distinct whole numbers by key."""
    x = df.select(*keys, F.col(value).alias("v")).distinct()
    x = x.withColumn("_k", F.col("v") - F.row_number().over(Window.partitionBy(*keys).orderBy("v")))
    return x.groupBy(*keys, "_k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).drop("_k")


def fold(df: DataFrame, keys: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each key's rows in order: for work that is sequential by nature."""
    return df.groupBy(*keys).applyInPandas(lambda g: f(g.sort_values(order, kind="stable")), schema)


def next_greater(values) -> list:
    """The next larger value to the right of each, None where there is none."""
    out, waiting = [None] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] < v:
            out[waiting.pop()] = v
        waiting.append(i)
    return out


def largest_rectangle(heights) -> float:
    best, open_ = 0, []
    for i, h in enumerate([*heights, 0]):
        start = i
        while open_ and open_[-1][1] >= h:
            start, tall = open_.pop()
            best = max(best, tall * (i - start))
        open_.append((start, h))
    return best


def increasing(values, strict: bool = True) -> list:
    """A longest increasing (or non-decreasing) subsequence."""
    from bisect import bisect_left, bisect_right

    tails, ends, back = [], [], []
    for i, v in enumerate(values):
        at = (bisect_left if strict else bisect_right)(tails, v)
        tails[at : at + 1], ends[at : at + 1] = [v], [i]
        back.append(ends[at - 1] if at else None)
    out, i = [], ends[-1] if ends else None
    while i is not None:
        out.append(values[i])
        i = back[i]
    return out[::-1]


def widest_container(heights) -> float:
    """max of (j - i) * min(h_i, h_j), by two pointers."""
    i, j, best = 0, len(heights) - 1, 0
    while i < j:
        best = max(best, (j - i) * min(heights[i], heights[j]))
        i, j = (i + 1, j) if heights[i] < heights[j] else (i, j - 1)
    return best


class Places:
    """Counts by place 0 .. n - 1, with sums and the place of a rank in log n steps."""

    def __init__(self, n: int, full: bool = False):
        self.sums = [(i & -i) if full else 0 for i in range(n + 1)]
        self.top = 1 << n.bit_length()

    def add(self, i: int, by: int) -> None:
        i += 1
        while i < len(self.sums):
            self.sums[i] += by
            i += i & -i

    def below(self, i: int) -> int:
        total = 0
        while i:
            total += self.sums[i]
            i &= i - 1
        return total

    def at(self, rank: int) -> int:
        """The place of the counted one before which `rank` others are."""
        i, step = 0, self.top
        while step:
            if i + step < len(self.sums) and self.sums[i + step] <= rank:
                i += step
                rank -= self.sums[i]
            step >>= 1
        return i


def no_less_before(values: list) -> list[int]:
    """For each value, how many of those before it are no less."""
    place = {v: i for i, v in enumerate(sorted(set(values)))}
    seen, out = Places(len(place)), []
    for n, v in enumerate(values):
        out.append(n - seen.below(place[v]))
        seen.add(place[v], 1)
    return out


def seats(pairs: list[tuple[int, int]]) -> list[int]:
    """Heights in a row from (height, how many taller-or-equal... stand before): the tallest first, each at its place among those there. Taken
    from the last one on, a place among those there is one among the seats still free."""
    free, out = Places(len(pairs), True), [None] * len(pairs)
    for i, (h, k) in reversed(list(enumerate(sorted(pairs, key=lambda p: (-p[0], p[1]))))):
        at = free.at(min(k, i))
        free.add(at, -1)
        out[at] = h
    return out


def least_after_swaps(values: list, swaps: int) -> list:
    """The least sequence after at most so many swaps of neighbours."""
    values, i = list(values), 0
    while swaps > 0 and i < len(values):
        at = min(range(i, min(len(values), i + swaps + 1)), key=lambda j: (values[j], j))
        values.insert(i, values.pop(at))
        swaps -= at - i
        i += 1
    return values
