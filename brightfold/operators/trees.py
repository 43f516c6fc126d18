"""Trees as tables (id, parent, side, val): paths from the root by rounds of joins, one a level, so depth bounds the rounds. A node's path of
L and R orders it among all others, which turns traversals into sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def heap_tree(rows: DataFrame, key: str, val: str) -> DataFrame:
    """Rows with keys 1..n as the nodes of a complete tree: the children of i are 2i and 2i + 1. Paths are a key's bits: no join at all."""
    bits = F.bin(F.col(key))
    path = F.translate(F.substring(bits, F.lit(2), F.length(bits)), "01", "LR")
    return rows.select(F.col(key).cast("long").alias("id"), F.when(F.col(key) > 1, F.floor(F.col(key) / 2)).alias("parent"), F.col(val).alias("val"), path.alias("path"), F.length(path).alias("depth"))


def with_paths(nodes: DataFrame, most: int = 64) -> DataFrame:
    """path and depth of every node of (id, parent, side, val)."""
    level = nodes.where("parent IS NULL").withColumn("path", F.lit("")).withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, most):
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("_p"))
        level = nodes.join(up, "parent").withColumn("path", F.concat("_p", "side")).withColumn("depth", F.lit(depth)).select(*out.columns)
        if not level.take(1):
            break
        out = out.unionByName(level)
    return out


def order_key(kind: str):
    """Sorts paths as the traversal visits them: a node before, between or after what is below it."""
    mark = {"pre": "0", "in": "1", "post": "2"}[kind]
    low, high = {"pre": "12", "in": "02", "post": "01"}[kind]
    return F.concat(F.translate("path", "LR", low + high), F.lit(mark))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, anc): every node with itself and all above it, from the prefixes of its path."""
    up = nodes.select("id", F.explode(F.expr("transform(sequence(0, length(path)), i -> left(path, i))")).alias("path"))
    return up.join(nodes.select("path", F.col("id").alias("anc")), "path").select("id", "anc")


def level_lists(nodes: DataFrame, zigzag: bool = False) -> DataFrame:
    x = nodes.groupBy("depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "val"))), lambda p: p["val"]).alias("vals"))
    return x.withColumn("vals", F.when(F.col("depth") % 2 == 1, F.reverse("vals")).otherwise(F.col("vals"))) if zigzag else x


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("id")), "id", "left_anti")


def neighbours(nodes: DataFrame) -> DataFrame:
    """The next node to the right on each level."""
    return nodes.select("id", F.lead("id").over(Window.partitionBy("depth").orderBy("path")).alias("next"))
