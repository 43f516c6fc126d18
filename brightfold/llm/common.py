"""What the operators of this subpackage share: the shared folder, staged tables, words and hashes."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where a session on one machine names no spark.checkpoint.dir, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session has it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/brightfold"


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: cuts lineage, outlives executors. Returns the table and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage_by(df: DataFrame, column: str, label: str) -> tuple[DataFrame, str]:
    """stage() as a table in buckets by column, which joins on it read where they are. Returns the table and its name."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, column).format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def unstage_by(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    unstage(spark, f"{shared_dir(spark)}/{name}")


def unstage(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, by exact name, cast to the given types; extra columns can't clash with ours."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, as text, and text: numbers beside a null would reach Python as floats, which lose digits from 2^53 on."""
    return pick(docs, doc_id="long", text="string").withColumn("doc_id", F.col("doc_id").cast("string"))


def with_ids(rows: DataFrame) -> DataFrame:
    """rows with doc_id as the number again that texts() made a text."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def among(rows: DataFrame, column: str, used: DataFrame, but: bool = False, bits: int = 26) -> DataFrame:
    """The rows whose column is in used (one column of numbers) and a few others; but: all the rest, of which none is in used. A filter of
    2^bits places, one hash a number: it is broadcast as at most 2^(bits - 6) rows of 64 places each, whatever `used` holds, and
    tells less apart the more there is."""
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    bit = "shiftleft(1L, cast(_place & 63 AS int))"
    places = used.select(place(F.col(used.columns[0])).alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(F.expr(bit)).alias("_bits"))
    held = rows.withColumn("_place", place(F.col(column))).withColumn("_word", F.shiftright("_place", 6))
    held = held.join(F.broadcast(places), "_word", "left" if but else "inner")
    return held.where(f"coalesce(_bits & {bit}, 0L) {'=' if but else '!='} 0L").select(*[F.col(f"`{c}`") for c in rows.columns])


def trim() -> None:
    """Give freed memory back to the system, where the C library can: a worker process outlives its tasks."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def freed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, with trim() once all that it held is let go."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return wrapped


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words: runs of anything but space and the five ASCII controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over an array of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words seen so far; forgotten when it grows past `most`."""

    def __init__(self, most: int = 200_000):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a sequence of word hashes; fewer words: the whole sequence as one."""
    n = len(h)
    if not n:
        return h
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, np.uint64(width), np.uint64)
        for i in range(width):
            out = mix((out ^ h[i : n - width + 1 + i]) + _GOLD)
    return np.unique(out)
