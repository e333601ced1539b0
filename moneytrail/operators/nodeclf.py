"""A graph-aware fraud probability per account, and batch inference of a given neural checkpoint.

The trainable model is a class-weighted logistic regression over an account's own features and their means
over one, two and three hops of incoming transfers. It is a different model from a trained graph neural
network. ``sage_inference`` evaluates such a network from its stored weights.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneytrail.functions.ranking import roc_auc, running_total
from moneytrail.functions.skew import hot_keys, salted_join
from moneytrail.operators.traverse import directed_pairs
from moneytrail.scratch import materialize, materialize_counted

SEED = 42
VALIDATION_SHARE = 0.2
HOPS = 3
# Fixed value: the weight decay of the supervised model.
PENALTY = 5e-4


class Neighbours:
    """Incoming edges of every account, its own loop included, ready for repeated averaging."""

    def __init__(self, transfers: DataFrame, accounts: DataFrame):
        ids = accounts.select("account_id").distinct()
        known = (
            directed_pairs(transfers)
            .join(ids.withColumnRenamed("account_id", "source"), "source", "left_semi")
            .join(ids.withColumnRenamed("account_id", "target"), "target", "left_semi")
        )
        loops = ids.select(F.col("account_id").alias("source"), F.col("account_id").alias("target"))
        self.edges, rows = materialize_counted(known.unionByName(loops), "model-edges")
        self.hot = hot_keys(self.edges, "source", rows=rows)

    def mean(self, values: DataFrame, columns: list[str]) -> DataFrame:
        """Mean of the columns over the accounts that pay into each account."""
        given = values.select(F.col("account_id").alias("source"), *columns)
        return (
            salted_join(self.edges, given, "source", F.col("target"), hot=self.hot)
            .groupBy(F.col("target").alias("account_id"))
            .agg(*[F.avg(c).alias(c) for c in columns])
        )


def neighbour_means(matrix: DataFrame, neighbours: Neighbours, columns: list[str], hops: int = HOPS) -> DataFrame:
    """The matrix with ``<column>_h1``.. ``_h<hops>`` added. Each hop is written as a scratch table."""
    wide, layer = matrix.select("account_id", *columns), matrix.select("account_id", *columns)
    for hop in range(1, hops + 1):
        layer = materialize(neighbours.mean(layer, columns), "hop-means")
        wide = wide.join(layer.withColumnsRenamed({c: f"{c}_h{hop}" for c in columns}), "account_id")
    return wide


def class_weights(labels: DataFrame) -> tuple[float, float]:
    """Weights of the normal and the fraud class; equal if there is no fraud."""
    row = labels.agg(F.count("*").alias("n"), F.count_if(F.col("is_fraud")).alias("fraud")).head()
    return (1.0, (row["n"] - row["fraud"]) / row["fraud"]) if row["fraud"] else (1.0, 1.0)


def stratified_split(labels: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``is_validation``: in each class the ``share`` of accounts with the smallest seeded hashes."""
    hashed = labels.withColumn("hash", F.xxhash64("account_id", F.lit(seed)))
    placed = running_total(hashed, ["is_fraud", "hash", "account_id"], F.lit(1))
    sizes = labels.agg(F.count("*").alias("n"), F.count_if(F.col("is_fraud")).alias("fraud")).head()
    normal = sizes["n"] - sizes["fraud"]
    # the normal class comes first in the order
    position = F.when(F.col("is_fraud"), F.col("before") - normal).otherwise(F.col("before"))
    quota = F.when(F.col("is_fraud"), round(sizes["fraud"] * share)).otherwise(round(normal * share))
    return placed.select("account_id", "is_fraud", (position < quota).alias("is_validation"))


class NodeModel(NamedTuple):
    regression: LogisticRegressionModel
    columns: list[str]  # base feature names
    inputs: list[str]  # base features and their hop means, in coefficient order
    validation_auc: float


def _assembled(wide: DataFrame, inputs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=inputs, outputCol="x").transform(wide)


def train(wide: DataFrame, labels: DataFrame, columns: list[str], iterations: int = 100) -> NodeModel:
    """Fit on the training part of the stratified split and measure on the rest."""
    inputs = [c for c in wide.columns if c != "account_id"]
    normal, fraud = class_weights(labels)
    split = stratified_split(labels)
    rows = materialize(
        wide.join(split, "account_id").withColumn("weight", F.when(F.col("is_fraud"), fraud).otherwise(normal)),
        "training-rows",
    )
    prepared = _assembled(rows.withColumn("label", F.col("is_fraud").cast("double")), inputs)
    model = LogisticRegression(
        featuresCol="x", labelCol="label", weightCol="weight", regParam=PENALTY, maxIter=iterations
    ).fit(prepared.where("not is_validation"))
    held_out = prepared.where("is_validation")
    scored = model.transform(held_out).select(vector_to_array("probability")[1].alias("p"), "is_fraud")
    return NodeModel(model, columns, inputs, roc_auc(scored, "p", "is_fraud"))


def score(model: NodeModel, wide: DataFrame) -> DataFrame:
    """``(account_id, gnn_fraud_prob)``"""
    scored = model.regression.transform(_assembled(wide, model.inputs))
    return scored.select("account_id", vector_to_array("probability")[1].alias("gnn_fraud_prob"))


def save_model(model: NodeModel, path: str) -> None:
    spark = SparkSession.getActiveSession()
    model.regression.write().overwrite().save(f"{path}/regression")
    spark.createDataFrame(
        [(model.columns, model.inputs, model.validation_auc)],
        "columns array<string>, inputs array<string>, validation_auc double",
    ).write.mode("overwrite").parquet(f"{path}/inputs")


def load_model(path: str) -> NodeModel:
    row = SparkSession.getActiveSession().read.parquet(f"{path}/inputs").head()
    regression = LogisticRegressionModel.load(f"{path}/regression")
    return NodeModel(regression, list(row["columns"]), list(row["inputs"]), row["validation_auc"])


def metrics(scores: DataFrame, labels: DataFrame, threshold: float = 0.5, column: str = "gnn_fraud_prob") -> DataFrame:
    """ROC-AUC, precision and recall as ``(metric, value)``; an account without a label counts as normal."""
    joined = materialize(
        scores.join(labels, "account_id", "left").select(column, F.coalesce("is_fraud", F.lit(False)).alias("is_fraud")),
        "scored",
    )
    auc = roc_auc(joined, column, "is_fraud")
    flagged = F.col(column) > threshold
    counts = joined.agg(
        F.count_if(flagged & F.col("is_fraud")).alias("hits"), F.count_if(flagged).alias("flagged"),
        F.count_if(F.col("is_fraud")).alias("fraud"),
    )

    def share(whole):
        return F.coalesce(F.try_divide(F.col("hits"), F.col(whole)), F.lit(0.0))

    values = {"auc_roc": F.lit(float(auc)), "precision": share("flagged"), "recall": share("fraud")}
    return counts.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()])).alias("m")
    ).select("m.*")


# --- inference from stored network weights --------------------------------------------------------

# Layer names of the checkpoint, and the constant added to a variance before its root.
LAYERS = ["conv1", "conv2", "conv3"]
NORM_EPSILON = 1e-5


def read_weights(table: DataFrame) -> dict[str, np.ndarray]:
    """Named arrays from a table ``(name, shape, values)`` that holds one network."""
    return {r["name"]: np.array(r["values"], dtype=float).reshape(r["shape"]) for r in table.collect()}


def _dense(df: DataFrame, inputs: list[str], outputs: list[str], function) -> DataFrame:
    """Apply a matrix function to the input columns, batch by batch."""
    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(function(pdf[inputs].to_numpy(dtype=float)), columns=outputs)
            out.insert(0, "account_id", pdf["account_id"].to_numpy())
            yield out
    return df.mapInPandas(run, "account_id string, " + ", ".join(f"`{c}` double" for c in outputs))


def sage_inference(matrix: DataFrame, neighbours: Neighbours, weights: dict[str, np.ndarray], columns: list[str]) -> DataFrame:
    """``(account_id, gnn_fraud_prob, embedding)`` of a three-layer mean-aggregating network.

    A layer is ``W_l mean(h of payers) + b + W_r h``, normalised in layers one and two, then clipped at zero.
    The mean commutes with ``W_l``, so wide layers are projected first and the narrower result is shuffled.
    """
    hidden, names = matrix.select("account_id", *columns), list(columns)
    for layer in LAYERS:
        w_l, bias, w_r = (weights[f"{layer}.{p}"] for p in ("lin_l.weight", "lin_l.bias", "lin_r.weight"))
        norm = layer.replace("conv", "bn")
        if f"{norm}.weight" in weights:
            scale = weights[f"{norm}.weight"] / np.sqrt(weights[f"{norm}.running_var"] + NORM_EPSILON)
            shift = weights[f"{norm}.bias"] - scale * weights[f"{norm}.running_mean"]
        else:
            scale, shift = np.ones(len(bias)), np.zeros(len(bias))
        width_in, width_out = len(names), len(bias)
        outputs = [f"h{i}" for i in range(width_out)]
        received = [f"m{i}" for i in range(min(width_in, width_out))]
        project = width_out < width_in
        sent = _dense(hidden, names, received, lambda x, w=w_l: x @ w.T) if project else hidden.select(
            "account_id", *[F.col(c).alias(m) for c, m in zip(names, received)]
        )
        joined = hidden.join(neighbours.mean(sent, received), "account_id")

        def combine(x, w_l=w_l, w_r=w_r, bias=bias, scale=scale, shift=shift, width_in=width_in, project=project):
            own, mean = x[:, :width_in], x[:, width_in:]
            out = (mean if project else mean @ w_l.T) + bias + own @ w_r.T
            return np.maximum(scale * out + shift, 0.0)

        hidden = materialize(_dense(joined, names + received, outputs, combine), "hidden-layer")
        names = outputs

    w, b = weights["classifier.weight"], weights["classifier.bias"]
    logit = sum(
        (F.col(c) * float(w[1, i] - w[0, i]) for i, c in enumerate(names)), F.lit(float(b[1] - b[0]))
    )
    return hidden.select(
        "account_id", (1 / (1 + F.exp(-logit))).alias("gnn_fraud_prob"), F.array(*names).alias("embedding")
    )


def project_2d(df: DataFrame, columns: list[str], names: tuple[str, str] = ("gnn_embed_x", "gnn_embed_y")) -> DataFrame:
    """First two principal components; the largest loading of each is made positive."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).head()
    centred = df.select("account_id", *[(F.col(c) - float(means[c] or 0.0)).alias(c) for c in columns])
    assembled = VectorAssembler(inputCols=columns, outputCol="x").transform(centred)
    loadings = PCA(k=2, inputCol="x", outputCol="pc").fit(assembled).pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(2)]
    return centred.select("account_id", *[
        sum((F.col(c) * float(loadings[i, j] * signs[j]) for i, c in enumerate(columns)), F.lit(0.0)).alias(names[j])
        for j in range(2)
    ])
