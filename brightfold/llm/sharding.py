"""Sharding by extendible hashing.

A row's key is a 60-bit prefix of the MD5 of its id. Buckets are prefixes of that key; only a bucket over the byte limit is
split on one more bit. Sizes are summed once per cell (a prefix of a few bits more than the average shard needs) and rolled
up to every shorter prefix; only rows of cells that are still too large are looked at again with more bits. The directory,
one entry a cell, is what rows are joined with: no row is sent by its bucket, so no bucket is one task's work.

Rows of one id share all bits, so no split parts them: such a bucket, if over the limit, gets overflow pages filled in
order, each within the limit; a single row over the limit has a page of its own. Null ids are a key like any other, null
texts weigh nothing, an empty table gives no shards, all rows and columns are carried through by write().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 60


def key(column: str) -> Column:
    """The id's key: the first 15 hexadecimal digits of the MD5 of its text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("key", BITS - bits)


def directory(rows: DataFrame, limit: int, step: int = 8, most: int = 20) -> list[tuple[int, DataFrame]]:
    """[(bits, table of cell and depth)]: rows(key, n_bytes) whose prefix of so many bits is a cell there have that depth."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(most, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    least, out = 0, []
    while True:
        cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        cells, _ = stage(cells, "cells")
        ways = cells.select("cell", "b", "lo", "hi", F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("depth"))
        ways = ways.withColumn("bucket", F.expr(f"shiftright(cell, {bits} - depth)"))
        whole = ways.groupBy("depth", "bucket").agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = whole.where((F.col("b") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "bucket")
        found = ways.select("cell", "depth", "bucket").join(fits, ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        found, _ = stage(found, "directory")
        out.append((bits, found))
        large = cells.select("cell").join(found, "cell", "left_anti")
        if bits == BITS or not large.take(1):
            return out
        rows = rows.withColumn("cell", _prefix(bits)).join(large, "cell", "left_semi").drop("cell")
        least, bits = bits + 1, min(BITS, bits + step)


def assign(docs: DataFrame, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, shard (its prefix bits), depth and page of every row."""
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), _size(text_column).alias("n_bytes"))
    rows = rows.withColumn("key", key("doc_id")).withColumn("uid", F.monotonically_increasing_id())
    rows, _ = stage(rows, "shard-rows")
    return _place(rows, limit).drop("uid")


def _size(text_column: str) -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text_column}`").cast("string")), F.lit(0)).cast("long")


def _place(rows: DataFrame, limit: int) -> DataFrame:
    """uid, doc_id, n_bytes, shard, depth and page of staged rows(doc_id, n_bytes, key, uid)."""
    placed, depth = rows, []
    for i, (bits, cells) in enumerate(directory(rows.select("key", "n_bytes"), limit)):
        placed = placed.withColumn(f"c{i}", _prefix(bits)).join(cells.select(F.col("cell").alias(f"c{i}"), F.col("depth").alias(f"d{i}")).hint("merge"), f"c{i}", "left")
        depth.append(F.col(f"d{i}"))
    placed = placed.select("doc_id", "n_bytes", "key", "uid", F.coalesce(*depth).alias("depth"))
    placed = placed.withColumn("shard", F.expr(f"left(lpad(bin(key), {BITS}, '0'), depth)"))
    # overflow pages: only keys over the limit that several rows share; sums by run of rows first, so that no key is one task's
    over = rows.groupBy("key").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).where((F.col("b") > limit) & (F.col("n") > 1)).select("key")
    runs = rows.join(over, "key", "left_semi").withColumn("run", F.shiftright("uid", 14))
    by_run = runs.groupBy("key", "run").agg(F.sum("n_bytes").alias("b"))
    before = by_run.select("key", "run", F.coalesce(F.sum("b").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_bytes").over(Window.partitionBy("key", "run").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1))
    # a small row's page holds the rows that begin in the same half of the limit, so it can't overflow; a row over half has its own
    half = max(1, limit // 2)
    begun = runs.withColumn("begin", F.coalesce(inside, F.lit(0))).join(before, ["key", "run"])
    page = F.when(F.col("n_bytes") <= half, 2 * F.floor((F.col("begin") + F.col("before")) / half)).otherwise(2 * F.col("uid") + 1)
    paged = begun.select("uid", page.cast("long").alias("page"))
    return placed.join(paged, "uid", "left").select("uid", "doc_id", "n_bytes", "shard", "depth", F.coalesce("page", F.lit(0)).alias("page"))


def with_sizes(placed: DataFrame) -> DataFrame:
    """With each shard's size in bytes and rows; sums are joined back, so that a hot shard is split like any skewed join."""
    sizes = placed.groupBy("shard", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return placed.join(sizes, ["shard", "page"])


def write(docs: DataFrame, path: str, limit: int) -> None:
    """Write docs as one folder a shard and page. Rows are joined with their places by number: ids may be null or repeated."""
    held, _ = stage(docs.withColumn("_uid", F.monotonically_increasing_id()), "shard-docs")
    places = _place(held.select("doc_id", _size("text").alias("n_bytes"), key("doc_id").alias("key"), F.col("_uid").alias("uid")), limit)
    placed = held.join(places.select(F.col("uid").alias("_uid"), "shard", "page").hint("merge"), "_uid").drop("_uid")
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
