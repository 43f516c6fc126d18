"""Linked lists as ordered rows: a new order is a new sort key, so no list is ever held by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import table
from . import query

LIST = "l AS (SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)"


def rows(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("g")
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return c.withColumn("pos", F.row_number().over(w.orderBy("id"))).withColumn("n", F.count("*").over(w))


def placed(df: DataFrame, *order) -> DataFrame:
    return df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long").alias("place"))


def _sql(order: str) -> str:
    return f"WITH {LIST} SELECT id, row_number() OVER (PARTITION BY g ORDER BY {order}) AS place FROM l"


@query(_sql("v >= 5000, pos"))
def partition_stable(spark: SparkSession, d: str) -> DataFrame:
    return placed(rows(spark, d), F.col("v") >= 5000, "pos")


@query(_sql("CASE WHEN pos BETWEEN 3 AND 9 THEN 12 - pos ELSE pos END"))
def reverse_between(spark: SparkSession, d: str) -> DataFrame:
    return placed(rows(spark, d), F.when(F.col("pos").between(3, 9), 12 - F.col("pos")).otherwise(F.col("pos")))


@query(_sql("least(pos - 1, n - pos), pos"))
def reorder_list(spark: SparkSession, d: str) -> DataFrame:
    """First, last, second, second to last ..."""
    return placed(rows(spark, d), F.least(F.col("pos") - 1, F.col("n") - F.col("pos")), "pos")


@query(_sql("(pos - 1) % 2, CASE WHEN pos % 2 = 0 THEN -pos ELSE pos END"))
def alternate_split(spark: SparkSession, d: str) -> DataFrame:
    """Every other one, then the rest backwards."""
    return placed(rows(spark, d), (F.col("pos") - 1) % 2, F.when(F.col("pos") % 2 == 0, -F.col("pos")).otherwise(F.col("pos")))


@query(f"WITH {LIST}, x AS (SELECT *, lead(id) OVER (PARTITION BY g ORDER BY pos) AS next, (pos * 7) % n + 1 AS r FROM l) SELECT x.id + 100000 AS id, x.next + 100000 AS next, y.id + 100000 AS random FROM x JOIN l y ON y.g = x.g AND y.pos = x.r")
def copy_random_list(spark: SparkSession, d: str) -> DataFrame:
    """A deep copy: new ids for a node, its next and its random one."""
    r = rows(spark, d)
    x = r.select("g", "id", F.lead("id").over(Window.partitionBy("g").orderBy("pos")).alias("next"), ((F.col("pos") * 7) % F.col("n") + 1).alias("pos"))
    return x.join(r.select("g", "pos", F.col("id").alias("random")), ["g", "pos"]).select((F.col("id") + 100000).alias("id"), (F.col("next") + 100000).alias("next"), (F.col("random") + 100000).alias("random"))


@query("SELECT o_orderkey AS parent, l_partkey AS child, l_linenumber AS pos FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def flatten_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lists within a list, one row each: nested arrays flattened."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    nested = o.groupBy("o_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("inner"))
    return nested.select(F.col("o_orderkey").alias("parent"), F.explode("inner").alias("x")).select("parent", F.col("x.l_partkey").alias("child"), F.col("x.l_linenumber").alias("pos"))


@query("WITH a AS (SELECT list(p_size % 3 ORDER BY p_partkey) AS x FROM part), b AS (SELECT list(p_size % 3 + (p_partkey < 25)::INT * 5 ORDER BY p_partkey) AS y FROM part) SELECT (SELECT count(*) FROM range(1, (SELECT count(*) + 1 FROM part)) r(i) WHERE list_reverse(x)[1:i] = list_reverse(y)[1:i]) AS n FROM a, b")
def common_suffix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    both = p.select("p_partkey", ((F.col("p_size") % 3) == (F.col("p_size") % 3 + (F.col("p_partkey") < 25).cast("int") * 5)).alias("same"))
    return both.agg((F.max("p_partkey") - F.coalesce(F.max(F.when(~F.col("same"), F.col("p_partkey"))), F.lit(-1))).alias("n"))
