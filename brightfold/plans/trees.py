"""Queries over a complete tree made of all parts: the children of node i are 2i and 2i + 1."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import by_row
from ..operators import treerows
from ..operators import trees as op
from ..sources import table
from . import query

TREE = f"""t AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size AS val,
translate(substr(bin(p_partkey), 2), '01', 'LR') AS path, length(bin(p_partkey)) - 1 AS depth FROM part WHERE p_partkey >= 1)"""
UP = "a AS (SELECT x.id, y.id AS anc, y.val AS v, y.depth AS d FROM t x JOIN t y ON starts_with(x.path, y.path))"
LEAF = "l AS (SELECT * FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL))"


def tree(spark: SparkSession, d: str) -> DataFrame:
    return op.heap_tree(table(spark, d, "part").where("p_partkey >= 1"), "p_partkey", "p_size")


def _traverse(name: str, low: str, high: str, mark: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        return tree(spark, d).select("id", F.row_number().over(Window.orderBy(op.order_key(name))).cast("long").alias("place"))

    f.__name__ = f"{name}_order"
    query(f"WITH {TREE} SELECT id, row_number() OVER (ORDER BY translate(path, 'LR', '{low}{high}') || '{mark}') AS place FROM t")(f)


for _args in (("pre", "1", "2", "0"), ("in", "0", "2", "1"), ("post", "0", "1", "2")):
    _traverse(*_args)


@query(f"WITH {TREE} SELECT depth::INTEGER AS depth, list(val ORDER BY path) AS vals FROM t GROUP BY depth")
def level_lists(spark: SparkSession, d: str) -> DataFrame:
    return op.level_lists(tree(spark, d)).orderBy(F.desc("depth"))


@query(f"WITH {TREE} SELECT depth::INTEGER AS depth, CASE WHEN depth % 2 = 1 THEN list(val ORDER BY path DESC) ELSE list(val ORDER BY path) END AS vals FROM t GROUP BY depth")
def zigzag_lists(spark: SparkSession, d: str) -> DataFrame:
    return op.level_lists(tree(spark, d), True)


@query(f"WITH {TREE}, {LEAF} SELECT (SELECT max(depth) + 1 FROM t)::INTEGER AS height, min(depth + 1)::INTEGER AS nearest_leaf, (SELECT count(*) FROM t) AS nodes FROM l")
def tree_depths(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    return t.agg((F.max("depth") + 1).alias("height"), F.count("*").alias("nodes")).crossJoin(op.leaves(t).agg((F.min("depth") + 1).alias("nearest_leaf")))


@query(f"""WITH {TREE}, {UP}, h AS (SELECT anc AS id, max(x.depth - a.d) AS h FROM a JOIN t x ON x.id = a.id GROUP BY anc)
SELECT bool_and(abs(COALESCE(l.h, -1) - COALESCE(r.h, -1)) <= 1) AS balanced FROM t LEFT JOIN h l ON l.id = 2 * t.id LEFT JOIN h r ON r.id = 2 * t.id + 1""")
def is_balanced(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    below = op.ancestors(t).join(t.select("id", "depth"), "id").groupBy("anc").agg(F.max("depth").alias("deep"))
    sides = t.join(below, F.col("id") == F.col("anc")).groupBy("parent").agg(F.max(F.when(F.col("path").endswith("L"), F.col("deep") - F.col("depth"))).alias("l"), F.max(F.when(F.col("path").endswith("R"), F.col("deep") - F.col("depth"))).alias("r"))
    return sides.where("parent IS NOT NULL").agg(F.bool_and(F.abs(F.coalesce("l", F.lit(-1)) - F.coalesce("r", F.lit(-1))) <= 1).alias("balanced"))


@query(f"WITH {TREE}, m AS (SELECT translate(path, 'LR', 'RL') AS path, val FROM t) SELECT count(*) = 0 AS symmetric FROM t FULL JOIN m ON t.path = m.path AND t.val = m.val WHERE t.path IS NULL OR m.path IS NULL")
def is_symmetric(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d).select("path", "val")
    m = t.select(F.translate("path", "LR", "RL").alias("path"), "val")
    return t.withColumn("a", F.lit(1)).join(m.withColumn("b", F.lit(1)), ["path", "val"], "full").where("a IS NULL OR b IS NULL").agg((F.count("*") == 0).alias("symmetric"))


@query(f"WITH {TREE} SELECT count(*) = 0 AS same FROM (SELECT path, val FROM t EXCEPT SELECT path, val + (path = 'LRL')::INT FROM t)")
def same_tree(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d).select("path", "val")
    other = t.select("path", (F.col("val") + (F.col("path") == "LRL").cast("int")).alias("val"))
    return t.withColumn("a", F.lit(1)).join(other.withColumn("b", F.lit(1)), ["path", "val"], "full").agg((F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)) == 0).alias("same"))


@query(f"WITH {TREE}, o AS (SELECT val, lag(val) OVER (ORDER BY translate(path, 'LR', '02') || '1') AS before FROM t) SELECT bool_and(before IS NULL OR before < val) AS is_bst, sum(CASE WHEN before > val THEN 1 ELSE 0 END)::BIGINT AS drops FROM o")
def bst_check(spark: SparkSession, d: str) -> DataFrame:
    o = tree(spark, d).select("val", F.lag("val").over(Window.orderBy(op.order_key("in"))).alias("before"))
    return o.agg(F.bool_and(F.col("before").isNull() | (F.col("before") < F.col("val"))).alias("is_bst"), F.sum(F.when(F.col("before") > F.col("val"), 1).otherwise(0)).alias("drops"))


@query(f"""WITH {TREE}, o AS (SELECT id, val, row_number() OVER (ORDER BY translate(path, 'LR', '02') || '1') AS i FROM t), s AS (SELECT val, row_number() OVER (ORDER BY val) AS i FROM t)
SELECT o.id, s.val FROM o JOIN s USING (i)""")
def bst_recover(spark: SparkSession, d: str) -> DataFrame:
    """Values back in their order: the sorted values laid along the in-order walk."""
    t = tree(spark, d)
    walk = t.select("id", F.row_number().over(Window.orderBy(op.order_key("in"))).alias("i"))
    vals = t.select("val", F.row_number().over(Window.orderBy("val")).alias("i"))
    return walk.join(vals, "i").select("id", "val")


@query(f"WITH {TREE}, {UP}, {LEAF} SELECT l.id, sum(a.v)::BIGINT AS total, list(a.v ORDER BY a.d) AS way FROM l JOIN a ON a.id = l.id GROUP BY l.id")
def path_sums(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    up = op.ancestors(t).join(op.leaves(t).select("id"), "id", "left_semi").join(t.select(F.col("id").alias("anc"), "depth", "val"), "anc")
    way = F.array_sort(F.collect_list(F.struct("depth", "val")))
    return up.groupBy("id").agg(F.sum("val").alias("total"), F.transform(way, lambda x: x["val"]).alias("way"))


@query(f"WITH {TREE}, {UP}, {LEAF}, s AS (SELECT l.id, sum(a.v) AS s FROM l JOIN a ON a.id = l.id GROUP BY l.id) SELECT bool_or(s = 200) AS found FROM s")
def path_sum_exists(spark: SparkSession, d: str) -> DataFrame:
    return path_sums(spark, d).agg(F.bool_or(F.col("total") == 200).alias("found"))


@query(f"WITH {TREE}, {UP}, {LEAF} SELECT sum((a.v % 10) * (10 ^ (l.depth - a.d))::BIGINT)::BIGINT AS total FROM l JOIN a ON a.id = l.id")
def sum_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Exact at any depth: a digit counts by how many leaves stand how far below it, and those few sums are added up as Python's whole numbers. A
    total that no bigint holds, for which the SQL fails, is a decimal(38,0)."""
    t = tree(spark, d)
    below = op.leaves(t).select(F.explode(F.expr("transform(sequence(0, depth), i -> struct(shiftright(id, i) AS id, i AS i))")).alias("x")).groupBy("x.id", "x.i").count()
    sums = below.join(t.select("id", "val"), "id").groupBy("i").agg(F.sum(F.col("count") * (F.col("val") % 10)).alias("s")).where("s IS NOT NULL").collect()
    total = sum(r.s * 10**r.i for r in sums) if sums else None
    fits = total is None or -(2**63) <= total < 2**63
    return spark.range(1).select(F.lit(None if total is None else str(total)).cast("bigint" if fits else "decimal(38,0)").alias("total"))


@query(f"WITH {TREE}, {UP} SELECT anc AS id, sum(x.val)::BIGINT AS total FROM a JOIN t x ON x.id = a.id GROUP BY anc")
def subtree_sums(spark: SparkSession, d: str) -> DataFrame:
    t = tree(spark, d)
    return op.ancestors(t).join(t.select("id", "val"), "id").groupBy(F.col("anc").alias("id")).agg(F.sum("val").alias("total"))


@query(f"WITH {TREE} SELECT (length(replace(path, 'L', '')) - length(replace(path, 'R', '')))::INTEGER AS col, sum(val)::BIGINT AS total FROM t GROUP BY 1")
def vertical_sums(spark: SparkSession, d: str) -> DataFrame:
    col = F.length(F.replace("path", F.lit("L"), F.lit(""))) - F.length(F.replace("path", F.lit("R"), F.lit("")))
    return tree(spark, d).groupBy(col.alias("col")).agg(F.sum("val").alias("total"))


@query(f"""WITH {TREE}, {UP}, p AS (SELECT a.id AS x, b.id AS y, max(a.d) AS d FROM a JOIN a b ON a.anc = b.anc AND b.id = a.id + 1 GROUP BY ALL)
SELECT p.x, p.y, l.anc AS lca, (s.depth + e.depth - 2 * p.d)::INTEGER AS distance FROM p JOIN a l ON l.id = p.x AND l.d = p.d JOIN t s ON s.id = p.x JOIN t e ON e.id = p.y""")
def lowest_common_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Of each node and the one that comes after it by id."""
    t = tree(spark, d)
    up = op.ancestors(t)
    pairs = up.select(F.col("id").alias("x"), "anc").join(up.select(F.col("id").alias("y"), (F.col("id") - 1).alias("x"), "anc"), ["x", "anc"])
    depth = t.select(F.col("id").alias("anc"), "depth")
    best = pairs.join(depth, "anc").groupBy("x", "y").agg(F.max_by("anc", "depth").alias("lca"), F.max("depth").alias("d"))
    ends = best.join(t.select(F.col("id").alias("x"), F.col("depth").alias("dx")), "x").join(t.select(F.col("id").alias("y"), F.col("depth").alias("dy")), "y")
    return ends.select("x", "y", "lca", (F.col("dx") + F.col("dy") - 2 * F.col("d")).alias("distance"))


@query(f"WITH {TREE} SELECT id, lead(id) OVER (PARTITION BY depth ORDER BY path) AS next FROM t")
def next_right(spark: SparkSession, d: str) -> DataFrame:
    return op.neighbours(tree(spark, d))


@query(f"WITH {TREE} SELECT id, lead(id) OVER (ORDER BY translate(path, 'LR', '12') || '0') AS next, lag(id) OVER (ORDER BY translate(path, 'LR', '02') || '1') AS before, lead(id) OVER (ORDER BY translate(path, 'LR', '02') || '1') AS after FROM t")
def linked_orders(spark: SparkSession, d: str) -> DataFrame:
    """The pre-order list (flatten), and the in-order doubly linked list (threads)."""
    pre, inside = Window.orderBy(op.order_key("pre")), Window.orderBy(op.order_key("in"))
    return tree(spark, d).select("id", F.lead("id").over(pre).alias("next"), F.lag("id").over(inside).alias("before"), F.lead("id").over(inside).alias("after"))


def _as_rows(t: DataFrame) -> DataFrame:
    """A tree as one row: its ids in pre-, in- and post-order."""
    lists = [F.transform(F.array_sort(F.collect_list(F.struct(op.order_key(k).alias("k"), "id"))), lambda x: x["id"]).alias(k) for k in ("pre", "in", "post")]
    return t.agg(*lists)


@query(f"WITH {TREE} SELECT id, COALESCE(parent, 0) AS parent FROM t")
def build_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree back from its pre- and in-order lists."""
    made = by_row(lambda a, b: treerows.from_pre_in(list(a), list(b)), "array<struct<id:bigint,parent:bigint>>")
    return _as_rows(tree(spark, d)).select(F.explode(made("pre", "in")).alias("x")).select("x.*")


@query(f"WITH {TREE} SELECT id, COALESCE(parent, 0) AS parent FROM t")
def build_tree_post(spark: SparkSession, d: str) -> DataFrame:
    made = by_row(lambda a, b: treerows.from_in_post(list(a), list(b)), "array<struct<id:bigint,parent:bigint>>")
    return _as_rows(tree(spark, d)).select(F.explode(made("in", "post")).alias("x")).select("x.*")


@query(f"WITH {TREE} SELECT id, COALESCE(parent, 0) AS parent FROM t")
def serialised_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pre-order text with # for no child, and back: a text for each piece of twelve levels, so that none has more than 4,095 nodes."""
    pieces = tree(spark, d).select("id", F.coalesce("parent", F.lit(0)).alias("parent"), "path", F.expr("left(path, 12 * (depth div 12))").alias("piece"))

    def text(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [treerows.write_part(dict(zip(x["path"], zip(x["id"], x["parent"]))))]})

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["text"]:
                yield pd.DataFrame(treerows.read_part(s), columns=["id", "parent"])

    return pieces.groupBy("piece").applyInPandas(text, "text string").mapInPandas(back, "id long, parent long")


@query("WITH RECURSIVE r(lo, hi, parent) AS (SELECT 1::BIGINT, count(*)::BIGINT, 0::BIGINT FROM nation UNION ALL SELECT CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = 0 THEN (lo + hi) // 2 - 1 ELSE hi END, (lo + hi) // 2 FROM r, range(0, 2) x(s) WHERE lo <= hi) SELECT (lo + hi) // 2 AS id, parent FROM r WHERE lo <= hi")
def balanced_bst(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a sorted list as a balanced tree: the lower middle is the root."""
    n = table(spark, d, "nation").agg(F.count("*").alias("n"))
    return n.select(F.explode(by_row(lambda n: treerows.balanced(1, n), "array<struct<id:bigint,parent:bigint>>")("n")).alias("x")).select("x.*")


@query()
def all_bsts(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 7).select(F.col("id").alias("n"), F.explode(by_row(lambda n: treerows.all_bsts(1, n), "array<string>")("id")).alias("tree"))


@query()
def max_path_sum(spark: SparkSession, d: str) -> DataFrame:
    """The largest sum of a path between any two nodes, and of a set without a parent and its child (values less 25)."""

    def f(g: pd.DataFrame) -> pd.DataFrame:
        vals = {p: int(v) - 25 for p, v in zip(g["path"], g["val"])}
        return pd.DataFrame({"path_sum": [treerows.best_path(vals)], "independent": [treerows.independent(vals)]})

    return tree(spark, d).withColumn("g", F.lit(1)).groupBy("g").applyInPandas(f, "path_sum long, independent long")
