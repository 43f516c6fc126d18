"""Streaming queries, run over the events there are; SQL says the same of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming as st
from . import query


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    out = st.drain(st.window_counts(st.event_stream(spark, d), "event_type", "1 day"), "complete")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "cnt")


@query("SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id ORDER BY cnt DESC, user_id LIMIT 5")
def stream_top_keys(spark: SparkSession, d: str) -> DataFrame:
    counts = st.event_stream(spark, d).groupBy("user_id").agg(F.count("*").alias("cnt"))
    return st.drain(counts, "complete").orderBy(F.desc("cnt"), "user_id").limit(5)


@query("""WITH l AS (SELECT user_id, event_type, max((ts, event_id)) AS t FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS n FROM l)
SELECT user_id, array_to_string(list(event_type ORDER BY n), ' ') AS kept FROM r WHERE n <= 3 GROUP BY user_id""")
def stream_lru(spark: SparkSession, d: str) -> DataFrame:
    return st.drain(st.lru(st.event_stream(spark, d), "user_id", "event_type", 3), "update", ("user_id",)).select("user_id", F.array_join("kept", " ").alias("kept"))


def recent_sql(hours: int, slide: int) -> str:
    """The three commonest keys of each sliding window, as SQL."""
    return f"""WITH c AS (SELECT (floor(epoch(ts) / {slide * 3600})::BIGINT - i) * {slide * 3600} AS start, user_id, count(*) AS cnt FROM events, range(0, {hours // slide}) r(i) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY cnt DESC, user_id) AS place FROM c) SELECT start, place, user_id, cnt FROM r WHERE place <= 3"""


def recent(spark: SparkSession, d: str, size: str, slide: str) -> DataFrame:
    counts = st.drain(st.window_counts(st.event_stream(spark, d), "user_id", size, slide=slide), "complete").withColumn("start", F.unix_seconds("start"))
    place = F.row_number().over(Window.partitionBy("start").orderBy(F.desc("cnt"), "user_id"))
    return counts.withColumn("place", place).where("place <= 3").select("start", F.col("place").cast("long").alias("place"), "user_id", "cnt")


@query(recent_sql(24, 6))
def stream_recent_day(spark: SparkSession, d: str) -> DataFrame:
    """The users of most events in the past day, every six hours."""
    return recent(spark, d, "24 hours", "6 hours")


@query(recent_sql(1, 1))
def stream_recent_hour(spark: SparkSession, d: str) -> DataFrame:
    return recent(spark, d, "1 hour", "1 hour")


@query("""WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) SELECT word, count(*) AS cnt FROM w WHERE word <> '' GROUP BY word ORDER BY cnt DESC, word LIMIT 5""")
def stream_top_words(spark: SparkSession, d: str) -> DataFrame:
    words = st.table_stream(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).where("word <> ''")
    return st.drain(words.groupBy("word").agg(F.count("*").alias("cnt")), "complete").orderBy(F.desc("cnt"), "word").limit(5)
