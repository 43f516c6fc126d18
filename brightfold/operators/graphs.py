"""Graphs as edge tables (src, dst[, w]). Rounds of joins with min-label or frontier steps; every round's table is cut from its lineage by
checkpoint(), in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Edges that components() links on the driver at once.
FEW = 1 << 17


def least_of(pairs: list[tuple]) -> dict:
    """Each node of the pairs with the least node it is linked to."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). In a round every label takes the least label beside it, then what that leads to, by doubled steps; the
    labels left are the nodes of the next round's graph, at most half of them, so a long chain takes few rounds too. A graph of at most FEW
    edges is linked on the driver."""
    spark = edges.sparkSession
    links = cut(edges.select("src", "dst").union(edges.select("dst", "src")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    labels = cut(links.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct())
    links = links.where("src <> dst")

    def followed(to: DataFrame, by: DataFrame) -> DataFrame:
        """Each `to` replaced by what `by` (src, next) leads to."""
        return to.join(by.select(F.col("src").alias("_s"), F.col("next").alias("_n")), F.col("to") == F.col("_s"), "left").withColumn("to", F.coalesce("_n", "to")).drop("_s", "_n")

    while links.take(1):
        if len(few := links.where("src < dst").limit(FEW + 1).collect()) <= FEW:
            found = least_of([(r.src, r.dst) for r in few])
            step, links = spark.createDataFrame(list(found.items()), f"src {links.dtypes[0][1]}, next {links.dtypes[0][1]}"), links.limit(0)
        else:
            step = cut(links.groupBy("src").agg(F.min("dst").alias("dst")).select("src", F.least("src", "dst").alias("next")))
            while True:
                far = cut(followed(step.withColumn("to", F.col("next")), step))
                step = far.select("src", F.col("to").alias("next"))
                if not far.where("to <> next").take(1):
                    break
            ends = followed(followed(links.select(F.col("src").alias("to"), "dst"), step).select(F.col("to").alias("src"), F.col("dst").alias("to")), step)
            links = cut(ends.select("src", F.col("to").alias("dst")).where("src <> dst").distinct())
        labels = cut(followed(labels.withColumnRenamed("label", "to"), step).select("node", F.col("to").alias("label")))
    return labels.select("node", F.col("label").alias("component"))


def distances(edges: DataFrame, start: DataFrame, weighted: bool = False) -> DataFrame:
    """node, dist: least steps (or sum of weights) from the start nodes, by rounds of relaxation of the nodes that got nearer."""
    w = F.col("w") if weighted else F.lit(1)
    edges = cut(edges)
    best = cut(start.select(F.col("node"), F.lit(0).cast("double" if weighted else "long").alias("dist")))
    front = best
    while True:
        found = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("dist") + w).alias("d")).groupBy("node").agg(F.min("d").alias("d"))
        front = cut(found.join(best, "node", "left").where("dist IS NULL OR d < dist").select("node", F.col("d").alias("dist")))
        if not front.take(1):
            return best
        best = cut(best.join(front.select("node"), "node", "left_anti").union(front))


def topological_depth(edges: DataFrame) -> DataFrame:
    """node, depth: the longest way to each node of a graph without cycles, by removing the nodes that nothing enters; nodes on cycles are left out."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    out, depth = nodes.limit(0).withColumn("depth", F.lit(0)), 0
    while True:
        free = cut(nodes.join(left.select(F.col("dst").alias("node")), "node", "left_anti"))
        if not free.take(1):
            return out
        layer = free.withColumn("depth", F.lit(depth))
        out = out.union(layer)
        nodes = cut(nodes.join(free, "node", "left_anti"))
        left = cut(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))
        depth += 1


def one_letter_edges(words: DataFrame) -> DataFrame:
    """Pairs of words that differ in one letter: an equi-join on patterns with one letter masked, not on pairs."""
    masked = words.select("word", F.explode(F.expr("transform(sequence(1, length(word)), i -> concat(left(word, i - 1), '*', substr(word, i + 1)))")).alias("mask"))
    a, b = masked.withColumnRenamed("word", "src"), masked.withColumnRenamed("word", "dst")
    return a.join(b, "mask").where("src <> dst").select("src", "dst").distinct()


def grid_components(cells: DataFrame, rows: int = 2048) -> DataFrame:
    """cells (id, r, c, v) with `isle`: the least id that steps in four directions among cells of equal value reach. Strips of so many rows are
    linked by themselves; components() links only what meets where two strips do."""

    def strip(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("id", ignore_index=True)
        keys = list(zip(x["r"].tolist(), x["c"].tolist(), x["v"].tolist()))
        first: dict = {}
        for i, k in enumerate(keys):
            first.setdefault(k, i)
        pairs = [(i, j) for (r, c, v), i in first.items() for j in (first.get((r + 1, c, v)), first.get((r, c + 1, v))) if j is not None]
        least = least_of(pairs)
        ids = x["id"].to_numpy()
        at = [first.get(k, i) if k[2] == k[2] else i for i, k in enumerate(keys)]
        return pd.DataFrame({"id": ids, "isle": ids[[least.get(i, i) for i in at]], "r": x["r"], "c": x["c"], "v": x["v"]})

    types = dict(cells.dtypes)
    known = cells.where("id IS NOT NULL AND v IS NOT NULL").withColumn("strip", F.floor(F.col("r") / rows))
    found = cut(known.groupBy("strip").applyInPandas(strip, f"id {types['id']}, isle {types['id']}, r {types['r']}, c {types['c']}, v {types['v']}"))
    above = found.where(F.pmod("r", F.lit(rows)) == rows - 1).select((F.col("r") + 1).alias("r"), "c", "v", F.col("isle").alias("src"))
    below = found.where(F.pmod("r", F.lit(rows)) == 0).select("r", "c", "v", F.col("isle").alias("dst"))
    joined = components(above.join(below, ["r", "c", "v"]).select("src", "dst"))
    whole = found.join(joined.withColumnRenamed("node", "isle"), "isle", "left").select("id", "r", "c", "v", F.coalesce("component", "isle").alias("isle"))
    return cut(whole.unionByName(cells.where("id IS NULL OR v IS NULL").withColumn("isle", F.col("id"))))


def euler_circuit(edges: list[tuple[int, int]]) -> list[int]:
    """A closed walk over every undirected edge once; empty if there is none."""
    beside: dict[int, list] = {}
    for i, (a, b) in enumerate(edges):
        beside.setdefault(a, []).append((b, i))
        beside.setdefault(b, []).append((a, i))
    if not edges or any(len(x) % 2 for x in beside.values()):
        return []
    used, stack, out = set(), [min(beside)], []
    while stack:
        while beside[stack[-1]] and beside[stack[-1]][-1][1] in used:
            beside[stack[-1]].pop()
        if beside[stack[-1]]:
            to, i = beside[stack[-1]].pop()
            used.add(i)
            stack.append(to)
        else:
            out.append(stack.pop())
    return out if len(out) == len(edges) + 1 else []
