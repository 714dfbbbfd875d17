"""Learned re-ranking of fused candidates: features of every signal, and a class-balanced logistic regression.

Defined results: a signal that did not find a candidate gives it zeros; a signal whose scores of a query are all equal gives z = 0;
queries without a candidate are absent; with labels of one class only there is nothing to learn, and every probability is that of
the class; ties of probability go by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import materialise


def features(lists: dict[str, DataFrame]) -> DataFrame:
    """(qid, id, <signal>_z, <signal>_rr, ...) of ranked lists(qid, id, score, rank): the score against the mean and deviation of the
    query's list, and the reciprocal rank."""
    parts = None
    for name, rows in lists.items():
        part = rows.select(F.lit(name).alias("signal"), "qid", "id", F.col("score").cast("double").alias("score"), "rank")
        parts = part if parts is None else parts.unionByName(part)
    w = Window.partitionBy("signal", "qid")
    z = F.coalesce((F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_pop("score").over(w), F.lit(0.0)), F.lit(0.0))
    parts = parts.withColumns({"z": z, "rr": 1.0 / F.col("rank")})
    own = lambda name, c: F.coalesce(F.max(F.when(F.col("signal") == name, F.col(c))), F.lit(0.0)).alias(f"{name}_{c}")
    return parts.groupBy("qid", "id").agg(*(own(name, c) for name in lists for c in ("z", "rr")))


@dataclass
class Model:
    names: list[str]
    weights: list[float]
    intercept: float


def fit(examples: DataFrame, names: list[str], label: str = "label", ridge: float = 0.01) -> Model | None:
    """Logistic regression of examples(names..., label 0 or 1): both classes weigh the same, ``ridge`` holds all weights but the
    intercept. None without examples of both classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    examples = materialise(examples.select(*names, F.col(label).cast("double").alias("label")), "rerank")
    n = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}  # two rows
    if set(n) != {0.0, 1.0}:
        return None
    total = sum(n.values())
    weighted = examples.withColumn("weight", F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0])))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(weighted)
    model = LogisticRegression(weightCol="weight", regParam=ridge, standardization=False, tol=1e-9, maxIter=500).fit(vectors)
    return Model(names, [float(x) for x in model.coefficients], float(model.intercept))


def scores(feats: DataFrame, model: Model) -> DataFrame:
    """(qid, id, score): the probability of each candidate; a plain expression over its features."""
    raw = sum((F.col(c) * w for c, w in zip(model.names, model.weights, strict=True)), F.lit(model.intercept))
    return feats.select("qid", "id", (1 / (1 + F.exp(-raw))).alias("score"))


def in_training(qid) -> F.Column:
    """Half of the queries, whole, by a hash of their id."""
    return F.crc32(F.col(qid).cast("string").cast("binary")) % 2 == 0


def rerank(feats: DataFrame, gold: DataFrame, ridge: float = 0.01) -> DataFrame:
    """(qid, id, score, rank) of the held-out queries; learned from the others, where gold(qid, id) are the good candidates."""
    names = [c for c in feats.columns if c not in ("qid", "id")]
    feats = materialise(feats, "rerank")
    train = feats.where(in_training("qid")).join(gold.select("qid", "id").distinct().withColumn("_g", F.lit(1)), ["qid", "id"], "left").withColumn("label", F.coalesce("_g", F.lit(0)))
    model = fit(train, names, ridge=ridge)
    model = model or Model(names, [0.0] * len(names), 0.0)
    held = scores(feats.where(~in_training("qid")), model).withColumn("score", F.round("score", 6))
    return held.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
