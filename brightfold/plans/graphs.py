"""Graph queries: customer groups and suppliers that trade, words that differ in a letter, a 0/1 grid of parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs as op
from ..sources import table
from . import query

LINKS = "g AS (SELECT DISTINCT l_partkey % 400 AS src, l_suppkey % 90 + 1000 AS dst FROM lineitem), e AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("src"), (F.col("l_suppkey") % 90 + 1000).alias("dst")).distinct()


REACH = f"WITH RECURSIVE {LINKS}, r(node, c) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON r.c = e.src), k AS (SELECT node, min(c) AS component FROM r GROUP BY node)"


@query(f"{REACH} SELECT node, component FROM k")
def components(spark: SparkSession, d: str) -> DataFrame:
    return op.components(links(spark, d))


@query(f"{REACH} SELECT (SELECT count(*) FROM g) = (SELECT count(*) FROM k) - 1 AND (SELECT count(DISTINCT component) FROM k) = 1 AS is_tree, bool_or(m >= n) AS has_cycle FROM (SELECT component, count(*) AS n, (SELECT count(*) FROM g JOIN k x ON x.node = g.src WHERE x.component = k.component) AS m FROM k GROUP BY component)")
def is_tree(spark: SparkSession, d: str) -> DataFrame:
    e = links(spark, d)
    k = op.components(e)
    nodes = k.groupBy("component").agg(F.count("*").alias("n"))
    edges = e.join(k.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count("*").alias("m"))
    return nodes.join(edges, "component").agg(((F.count("*") == 1) & (F.sum("m") == F.sum("n") - 1)).alias("is_tree"), F.bool_or(F.col("m") >= F.col("n")).alias("has_cycle"))


@query(f"WITH RECURSIVE {LINKS}, s AS (SELECT min(src) AS s FROM g), r(node, dist) AS (SELECT s, 0::BIGINT FROM s UNION SELECT e.dst, dist + 1 FROM r JOIN e ON e.src = r.node WHERE dist < 30) SELECT node, min(dist) AS dist FROM r GROUP BY node")
def actor_distance(spark: SparkSession, d: str) -> DataFrame:
    """Steps between two kinds of nodes, as between actors by way of films."""
    e = links(spark, d)
    both = e.union(e.select("dst", "src"))
    return op.distances(both, e.agg(F.min("src").alias("node")))


@query("""WITH RECURSIVE e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst, ((a.n_nationkey * 7 + b.n_nationkey * 3) % 19 + 1)::DOUBLE AS w FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey BETWEEN 1 AND 3),
r(node, dist) AS (SELECT 0, 0::DOUBLE UNION SELECT dst, dist + w FROM r JOIN e ON src = node) SELECT node, min(dist) AS dist FROM r GROUP BY node""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a = n.select(F.col("n_nationkey").alias("src"))
    e = a.select("src", F.explode(F.expr("array(src + 1, src + 2, src + 3)")).alias("dst")).join(n.select(F.col("n_nationkey").alias("dst")), "dst")
    e = e.select("src", "dst", ((F.col("src") * 7 + F.col("dst") * 3) % 19 + 1).cast("double").alias("w"))
    return op.distances(e, n.where("n_nationkey = 0").select(F.col("n_nationkey").alias("node")), True)


WORDS = "w AS (SELECT DISTINCT lower(x) AS word FROM (SELECT unnest(string_split(text, ' ')) AS x FROM documents WHERE lang = 'en') WHERE regexp_full_match(lower(x), '[a-z]{2}'))"


def short_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "documents").where("lang = 'en'").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return w.where(F.col("word").rlike("^[a-z]{2}$")).distinct()


LADDER = f"WITH RECURSIVE {WORDS}, e AS (SELECT a.word AS src, b.word AS dst FROM w a JOIN w b ON a.word <> b.word AND (substr(a.word, 1, 1) = substr(b.word, 1, 1) OR substr(a.word, 2, 1) = substr(b.word, 2, 1)))"


@query(f"{LADDER}, r(node, dist) AS (SELECT 'is', 1::BIGINT UNION SELECT dst, dist + 1 FROM r JOIN e ON src = node WHERE dist < 8) SELECT node AS word, min(dist) AS length FROM r GROUP BY node")
def word_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Words on the shortest ladder from one word to each."""
    w = short_words(spark, d)
    start = spark.createDataFrame([("is",)], "node string")
    return op.distances(op.one_letter_edges(w), start).select(F.col("node").alias("word"), (F.col("dist") + 1).alias("length"))


@query(f"{LADDER}, r(way, node) AS (SELECT ['is'], 'is' UNION ALL SELECT list_append(way, dst), dst FROM r JOIN e ON src = node WHERE len(way) < 4 AND NOT list_contains(way, dst)), t AS (SELECT way FROM r WHERE node = 'on') SELECT array_to_string(way, ' ') AS ladder FROM t WHERE len(way) = (SELECT min(len(way)) FROM t)")
def all_ladders(spark: SparkSession, d: str) -> DataFrame:
    """All shortest ladders: from the distances, only steps that get one further are walked."""
    e = op.cut(op.one_letter_edges(short_words(spark, d)))
    dist = op.distances(e, spark.createDataFrame([("is",)], "node string"))
    forward = e.join(dist.select(F.col("node").alias("src"), F.col("dist").alias("a")), "src").join(dist.select(F.col("node").alias("dst"), F.col("dist").alias("b")), "dst").where("b = a + 1").select("src", "dst")
    length = dist.where("node = 'on'").first()
    ways = spark.createDataFrame([("is", "is")], "src string, ladder string")
    for _ in range(length["dist"] if length else 0):
        ways = ways.join(forward, "src").select(F.col("dst").alias("src"), F.concat_ws(" ", "ladder", "dst").alias("ladder"))
    return ways.where("src = 'on'").select("ladder")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, n_nationkey + n_regionkey + 1 AS dst FROM nation), r(node, depth) AS (SELECT src, 0 FROM e UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node) SELECT node, max(depth) AS depth FROM r GROUP BY node""")
def topological_order(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + F.col("n_regionkey") + 1).alias("dst"))
    return op.topological_depth(e)


@query("SELECT c AS node, (row_number() OVER () - 1)::INTEGER AS depth FROM (VALUES ('w'), ('e'), ('r'), ('t'), ('f')) t(c)")
def alien_order(spark: SparkSession, d: str) -> DataFrame:
    """The letters' order behind a sorted word list: first differences of neighbours, then their topological depth."""
    words = spark.createDataFrame(list(enumerate(["wrt", "wrf", "er", "ett", "rftt"])), "pos int, word string")
    pairs = words.withColumn("next", F.lead("word").over(Window.orderBy("pos"))).where("next IS NOT NULL")
    first = pairs.select("word", "next", F.expr("try_element_at(filter(sequence(1, least(length(word), length(next))), i -> substr(word, i, 1) <> substr(next, i, 1)), 1)").alias("i")).where("i IS NOT NULL")
    return op.topological_depth(first.selectExpr("substr(word, i, 1) AS src", "substr(next, i, 1) AS dst"))


CELLS = "c AS (SELECT p_partkey AS id, p_partkey // 20 AS r, p_partkey % 20 AS c, (p_size % 3 > 0)::INT AS v FROM part), e AS (SELECT a.id AS src, b.id AS dst FROM c a JOIN c b ON a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1)"
ISLES = f"WITH RECURSIVE {CELLS}, k(id, m) AS (SELECT id, id FROM c UNION SELECT k.id, e.dst FROM k JOIN e ON e.src = k.m), i AS (SELECT c.*, (SELECT min(m) FROM k WHERE k.id = c.id) AS isle FROM c)"


def isles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    c = table(spark, d, "part").select(k.alias("id"), F.floor(k / 20).alias("r"), (k % 20).alias("c"), (F.col("p_size") % 3 > 0).cast("int").alias("v"))
    return op.grid_components(c)


@query(f"{ISLES} SELECT v, count(DISTINCT isle) AS n FROM i GROUP BY v")
def count_islands(spark: SparkSession, d: str) -> DataFrame:
    return isles(spark, d).groupBy("v").agg(F.countDistinct("isle").alias("n"))


@query(f"{ISLES} SELECT id, CASE WHEN v = 0 AND isle NOT IN (SELECT isle FROM i WHERE r IN (0, (SELECT max(r) FROM c)) OR c IN (0, 19)) THEN 1 ELSE v END AS v FROM i")
def surrounded_regions(spark: SparkSession, d: str) -> DataFrame:
    """Zeros that no zero links to the border become ones."""
    i = isles(spark, d)
    last = i.agg(F.max("r").alias("last"))
    border = i.crossJoin(F.broadcast(last)).where("v = 0 AND (r IN (0, last) OR c IN (0, 19))").select("isle").distinct().withColumn("open", F.lit(1))
    return i.join(border, "isle", "left").select("id", F.when((F.col("v") == 0) & F.col("open").isNull(), 1).otherwise(F.col("v")).alias("v"))


@query()
def euler_circuit(spark: SparkSession, d: str) -> DataFrame:
    """A closed walk over every edge, by component: a ring of each region's nations."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("src"), F.coalesce(F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")), F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))).alias("dst"))

    def f(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [x["g"].iloc[0]], "walk": [op.euler_circuit(sorted(zip(x["src"].tolist(), x["dst"].tolist())))]})

    return n.groupBy("g").applyInPandas(f, "g int, walk array<long>")
