"""Joins, ranking, set operations, k-sum joins and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut


def purchase_rank(friends: DataFrame, purchases: DataFrame, user) -> DataFrame:
    """Products of a user's friends by number of purchases, without those that the user has: friends(user, friend), purchases(user, product)."""
    theirs = friends.where(F.col("user") == user).join(purchases.withColumnRenamed("user", "friend"), "friend")
    own = purchases.where(F.col("user") == user).select("product").distinct()
    return theirs.groupBy("product").agg(F.count("*").alias("cnt")).join(own, "product", "left_anti")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def anagram_key(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def second_degree(edges: DataFrame) -> DataFrame:
    """Pairs two steps apart in edges(src, dst) that are not linked or equal."""
    hop = edges.select(F.col("src"), F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid")
    return hop.where("src <> dst").select("src", "dst").distinct().join(edges, ["src", "dst"], "left_anti")


def pair_sum(df: DataFrame, key: str, value: str, target) -> DataFrame:
    """Pairs (k1 < k2) of rows whose values add up to a target, as an equi-join on the rest."""
    a = df.select(F.col(key).alias("k1"), F.col(value).alias("v1"))
    b = df.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    return a.withColumn("v2", F.lit(target) - F.col("v1")).join(b, "v2").where("k1 < k2").select("k1", "k2", "v1", "v2")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct values and how often each stands: k-sums need no more than that."""
    return df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))


def three_sum(df: DataFrame, value: str, target) -> DataFrame:
    """Distinct a <= b <= c from the multiset with a + b + c = target; pairs of distinct values, then an equi-join on the rest."""
    c = value_counts(df, value)
    a, b, d = (c.select(F.col("v").alias(x), F.col("n").alias(f"n{x}")) for x in "abc")
    pairs = a.join(b, F.col("a") <= F.col("b")).where((F.col("a") < F.col("b")) | (F.col("na") > 1))
    got = pairs.withColumn("c", F.lit(target) - F.col("a") - F.col("b")).join(d, "c").where("b <= c")
    enough = (F.col("nc") >= 1 + (F.col("c") == F.col("b")).cast("int") + (F.col("c") == F.col("a")).cast("int"))
    return got.where(enough).select("a", "b", "c")


def four_sum(df: DataFrame, value: str, target) -> DataFrame:
    """Distinct a <= b <= c <= d from the multiset with the given sum: pair sums joined on the rest."""
    c = value_counts(df, value)
    left, right = c.select(F.col("v").alias("x"), F.col("n").alias("nx")), c.select(F.col("v").alias("y"), F.col("n").alias("ny"))
    pairs = left.join(right, F.col("x") <= F.col("y")).where((F.col("x") < F.col("y")) | (F.col("nx") > 1))
    p = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), (F.lit(target) - F.col("x") - F.col("y")).alias("rest"))
    q = pairs.select(F.col("x").alias("c"), F.col("y").alias("d"), (F.col("x") + F.col("y")).alias("rest"))
    got = p.join(q, "rest").where("b <= c").select("a", "b", "c", "d")
    for x in "abcd":
        times = sum((F.col(x) == F.col(y)).cast("int") for y in "abcd")
        got = got.join(c.select(F.col("v").alias(x), F.col("n").alias("n")), x).where(F.col("n") >= times).drop("n")
    return got


def closest_three_sum(df: DataFrame, value: str, target) -> DataFrame:
    """The three-value sum closest to the target; the smaller sum of a tie."""
    c = value_counts(df, value)
    a, b, d = (c.select(F.col("v").alias(x), F.col("n").alias(f"n{x}")) for x in "abc")
    t = a.join(b, F.col("a") <= F.col("b")).join(d, F.col("b") <= F.col("c"))
    e = lambda x, y: (F.col(x) == F.col(y)).cast("int")
    t = t.where((F.col("na") >= 1 + e("a", "b") + e("a", "c")) & (F.col("nb") >= 1 + e("b", "c")))
    return t.select((F.col("a") + F.col("b") + F.col("c")).alias("s")).agg(F.min_by("s", F.struct(F.abs(F.col("s") - target), "s")).alias("closest"))


def inversions(df: DataFrame, position: str, value: str, bits: int) -> DataFrame:
    """Pairs i < j with v[i] > v[j] of whole numbers under 2^bits, without a self-join: two values first differ in one bit, so
    each bit adds, within rows equal above it, the ones that stand before a zero."""
    total = None
    for b in range(bits):
        w = Window.partitionBy(F.shiftright(value, b + 1)).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        bit = F.shiftright(value, b).bitwiseAND(F.lit(1))
        part = df.select((F.when(bit == 0, F.sum(bit).over(w))).alias("n")).agg(F.sum("n").alias("n"))
        total = part if total is None else total.union(part)
    return total.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("inversions"))


def first_missing(df: DataFrame, value: str) -> DataFrame:
    """The least positive whole number that is not there: the first gap in the sorted positives."""
    v = df.where(F.col(value) > 0).select(F.col(value).cast("long").alias("v")).distinct()
    nxt = v.select((F.col("v") + 1).alias("v")).union(df.sparkSession.range(1, 2).select(F.col("id").alias("v")))
    return nxt.join(v, "v", "left_anti").agg(F.min("v").alias("first_missing"))


def median(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.percentile(value, 0.5).alias("median"))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Union of closed intervals by key: touching ones merge."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).withColumn("_isle", F.sum("_new").over(w))
    return marked.groupBy(*keys, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")


def intersection(a: DataFrame, b: DataFrame, key: str, place: str) -> DataFrame:
    """The keys that are in both lists, each with its first place in a."""
    return a.join(b.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min(place).alias(place))


def next_value(df: DataFrame, by: list[str], value: str, holds: Column) -> DataFrame:
    """df with `following`: the least value from the row's own on, in its group, for which the condition holds; null if there is none."""
    # backwards: a frame from the first row on is added to row by row, one to the last row is read again for each
    ahead = Window.partitionBy(*by).orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("following", F.min(F.when(holds, F.col(value))).over(ahead))


def first_lines(lines: DataFrame, line: str, *place: str) -> DataFrame:
    """Duplicate lines removed: each distinct line with its first place. Copies are combined before the shuffle; a null line is a line."""
    return lines.groupBy(line).agg(F.min(F.struct(*place)).alias("_place")).select(line, "_place.*")


def shuffled(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """df in an order told by a seeded hash of the keys: a sort by ranges, so that no task holds the whole."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)


def at_or_above(probes: DataFrame, probe: str, held: DataFrame, value: str, name: str) -> DataFrame:
    """probes with `name`: the least held value at or above the probe's; null if there is none. Both sides are sorted together by ranges, in
    which the value is carried backwards; a range without one takes the least of the next that has one."""
    both = probes.withColumn("_x", F.col(probe)).withColumn("_k", F.lit(0)).unionByName(held.where(F.col(value).isNotNull()).select(F.col(value).alias("_x"), F.lit(1).alias("_k")), allowMissingColumns=True)
    both = cut(both.where("_x IS NOT NULL").repartitionByRange("_x").withColumn("_p", F.spark_partition_id()))
    back = Window.partitionBy("_p").orderBy(F.desc("_x"), F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("_least").over(Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    after = both.groupBy("_p").agg(F.min(F.when(F.col("_k") == 1, F.col("_x"))).alias("_least")).select("_p", least.alias("_after"))
    here = F.last(F.when(F.col("_k") == 1, F.col("_x")), ignorenulls=True).over(back)
    found = both.withColumn("_here", here).where("_k = 0").join(F.broadcast(after), "_p").withColumn(name, F.coalesce("_here", "_after"))
    return found.select(*probes.columns, name).unionByName(probes.where(F.col(probe).isNull()), allowMissingColumns=True)
