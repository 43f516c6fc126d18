"""Queries of the learning operators over `embeddings` (64 features, 10 labels)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ml as op
from ..sources import table
from . import query

CLASSES, DIM = 10, 64
#: Fixed weights, by a rule that SQL can repeat.
WEIGHTS = np.array([[((7 * c + 3 * f) % 11 - 5) / 2 for f in range(DIM)] for c in range(CLASSES)])
BIAS = np.array([c / 10 for c in range(CLASSES)])
LOGITS = """z AS (SELECT vec_id, label, list_transform(range(0, 10), lambda c: list_sum(list_transform(range(0, 64), lambda f: embedding[f + 1]::DOUBLE * (((7 * c + 3 * f) % 11 - 5) / 2.0))) + c / 10.0) AS z FROM embeddings),
p AS (SELECT vec_id, label, list_transform(z, lambda v: v - ln(list_sum(list_transform(z, lambda u: exp(u))))) AS p FROM z)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.withColumn("z", op.linear("x", WEIGHTS, BIAS)).withColumn("p", op.log_softmax("z"))


@query(f"WITH {LOGITS} SELECT vec_id, list_transform(p, lambda v: round(v, 6)) AS p FROM p")
def log_softmax_model(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("vec_id", F.transform("p", lambda v: F.round(v, 6)).alias("p"))


@query(f"WITH {LOGITS} SELECT round(avg(-p[label + 1]), 6) AS nll, avg((list_position(p, list_max(p)) - 1 = label)::INT) AS accuracy FROM p")
def nll_and_accuracy(spark: SparkSession, d: str) -> DataFrame:
    right = (F.array_position("p", F.array_max("p")) - 1 == F.col("label")).cast("double")
    return scored(spark, d).agg(F.round(F.avg(-F.element_at("p", F.col("label") + 1)), 6).alias("nll"), F.avg(right).alias("accuracy"))


BATCHES = f"WITH {LOGITS}, b AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS b, -p[label + 1] AS l FROM p), g AS (SELECT b, avg(l) AS loss, count(*) AS n FROM b GROUP BY b)"


def batches(spark: SparkSession, d: str) -> DataFrame:
    b = F.floor((F.row_number().over(Window.orderBy("vec_id")) - 1) / 64)
    return scored(spark, d).select(b.alias("b"), (-F.element_at("p", F.col("label") + 1)).alias("l")).groupBy("b").agg(F.avg("l").alias("loss"), F.count("*").alias("n"))


@query(f"{BATCHES} SELECT b, round(loss, 6) AS loss, n FROM g")
def batch_losses(spark: SparkSession, d: str) -> DataFrame:
    return batches(spark, d).select("b", F.round("loss", 6).alias("loss"), "n")


@query(f"{BATCHES} SELECT round(sum(loss * n) / sum(n), 6) AS weighted, round(avg(loss), 6) AS unweighted, round(sum(loss) / sum(n), 6) AS per_row FROM g")
def validation_losses(spark: SparkSession, d: str) -> DataFrame:
    """The mean weighted by rows, the mean of batches, and the sum of batch means by rows."""
    l, n = F.col("loss"), F.col("n")
    return batches(spark, d).agg(F.round(F.sum(l * n) / F.sum(n), 6).alias("weighted"), F.round(F.avg(l), 6).alias("unweighted"), F.round(F.sum(l) / F.sum(n), 6).alias("per_row"))


@query("SELECT count(*) AS n, max(len(embedding))::INTEGER AS width, min(list_min(embedding))::DOUBLE AS lo, max(list_max(embedding))::DOUBLE AS hi FROM embeddings")
def tensor_profile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width"), F.min(F.array_min("embedding")).cast("double").alias("lo"), F.max(F.array_max("embedding")).cast("double").alias("hi"))


@query("""WITH x AS (SELECT vec_id, f, embedding[f]::DOUBLE AS v FROM embeddings, range(1, 65) r(f)), m AS (SELECT f, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY f)
SELECT x.vec_id, x.f, round((v - m) / sqrt(s + 1e-5), 6) AS v FROM x JOIN m USING (f)""")
def batch_norm(spark: SparkSession, d: str) -> DataFrame:
    """By column over all rows: its mean and variance are one small row a column."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("f"), "v")
    m = x.groupBy("f").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    return x.join(F.broadcast(m), "f").select("vec_id", "f", F.round((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + 1e-5), 6).alias("v"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, x, list_avg(x) AS m FROM x), s AS (SELECT *, list_avg(list_transform(x, lambda v: (v - m) * (v - m))) AS s FROM m)
SELECT vec_id, list_transform(x, lambda v: round((v - m) / sqrt(s + 1e-5), 6)) AS v FROM s""")
def layer_norm(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return x.withColumn("y", op.layer_norm("x")).select("vec_id", F.transform("y", lambda v: F.round(v, 6)).alias("v"))


NAMES = [f"label {i}" for i in range(CLASSES)]


@query(f"WITH {LOGITS} SELECT vec_id, ({NAMES!r})[list_position(p, list_max(p))] AS name FROM p")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, NAMES))
    return scored(spark, d).select("vec_id", F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("name"))


@query()
def softmax_regression(spark: SparkSession, d: str) -> DataFrame:
    """Training: the loss of each epoch."""
    *_, losses = op.train_softmax(table(spark, d, "embeddings"), "embedding", "label", CLASSES, DIM, 0.5, 4)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


@query()
def batch_training(spark: SparkSession, d: str) -> DataFrame:
    """Training by batches of 64 in order: the loss of each epoch."""
    *_, losses = op.train_batches(table(spark, d, "embeddings"), "vec_id", "embedding", "label", CLASSES, DIM, 0.5, 2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


@query()
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """A seeded shuffle in batches of 64."""
    order = Window.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.floor((F.row_number().over(order) - 1) / 64).alias("b"))


def _images(it: Iterator[pd.DataFrame], f) -> Iterator[pd.DataFrame]:
    for b in it:
        if len(b):
            x = np.stack(b["embedding"].to_numpy()).astype(float)
            yield pd.DataFrame({"vec_id": b["vec_id"], "out": list(np.round(f(x), 6))})


@query()
def cnn_forward(spark: SparkSession, d: str) -> DataFrame:
    """Three strided convolutions with ReLU over 8 x 8 images, then the mean of each channel."""
    r = np.random.default_rng(0)
    ks = [r.normal(0, 0.3, s) for s in ((4, 1, 3, 3), (4, 4, 3, 3), (10, 4, 3, 3))]

    def f(x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, 1, 8, 8)
        for k in ks:
            x = op.convolve(x, k)
        return x.mean((2, 3))

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(lambda it: _images(it, f), "vec_id long, out array<double>")


@query()
def mlp_forward(spark: SparkSession, d: str) -> DataFrame:
    """Three layers with layer norm and ReLU, the last ReLU on the logits too."""
    r = np.random.default_rng(1)
    ws = [r.normal(0, 0.1, s) for s in ((64, 128), (128, 64), (64, 10))]

    def f(x: np.ndarray) -> np.ndarray:
        for i, w in enumerate(ws):
            x = x @ w
            if i < 2:
                x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
            x = np.maximum(0, x)
        return x

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(lambda it: _images(it, f), "vec_id long, out array<double>")
