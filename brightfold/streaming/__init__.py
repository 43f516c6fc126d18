"""Structured Streaming: windowed counts, running top words, and keyed state (a least-recently-used cache)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import shared_dir, table


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream with an event time that watermarks accept."""
    stream = table_stream(spark, sf_dir, "events")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, key: str, size: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of each key in windows of event time, tumbling or, with slide, sliding."""
    return events.withWatermark("at", late).groupBy(F.window("at", size, slide), key).agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), key, "cnt")


def lru(events: DataFrame, key: str, value: str, capacity: int) -> DataFrame:
    """The last `capacity` distinct values of each key, latest first, kept as state; a micro-batch's rows come in order of time."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        for v in rows[value]:
            kept = [v, *(x for x in kept if x != v)][:capacity]
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]], "kept": [kept]})

    return events.groupBy(key).applyInPandasWithState(update, f"{key} long, kept array<string>", "kept array<string>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what there is now and return its result table, which each micro-batch writes to the shared folder: the last one's in
    complete mode, else the last row of each of the keys (all rows, if none are named)."""
    spark, at, done = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}", []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/_batch_id={batch}")
        done.append(batch)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{at}/rows/_batch_id={done[-1]}")
    paths = [f"{at}/rows/_batch_id={i}" for i in sorted(set(done))]
    rows = spark.read.option("basePath", f"{at}/rows").parquet(*paths)
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch_id").alias("_row")).select("_row.*")
    return rows.select(*stream.columns)
