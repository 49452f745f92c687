"""Baselines with Spark ML: text and structured features, balanced logistic regression, holdout scores."""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """df with ``weight`` so that both classes weigh the same; an error if one is missing."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(n) != 2:
        raise ValueError(f"training needs two classes, found {sorted(map(str, n))}")
    total = sum(n.values())
    return df.withColumn("weight", F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])))


def unaccented(c: Column) -> Column:
    """Text taken apart by Unicode's compatibility forms, without combining marks."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        one = lambda t: t if t is None or t.isascii() else "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))
        return texts.map(one)

    return plain(c)


class SmoothIdf(Estimator):
    """Weights of terms, ln((1 + n) / (1 + df)) + 1, as a stage that multiplies counts with them."""

    def __init__(self, inputCol: str, outputCol: str):  # noqa: N803
        super().__init__()
        self.columns = inputCol, outputCol

    def _fit(self, dataset: DataFrame):
        counts, weighted = self.columns
        idf = IDF(inputCol=counts, outputCol="_").fit(dataset).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1), inputCol=counts, outputCol=weighted)

    def copy(self, extra=None):
        return self


class PenalisedLogistic(Estimator):
    """Logistic regression of features that hold a constant, whose weight is penalised like others, on the features' own
    scale: minimises |w|^2 / 2 + strength * sum of weighted losses.

    Spark's own scales features to one spread, where penalties of rare and frequent terms differ by orders of magnitude:
    hundreds of passes. Here each feature is scaled by its curvature (L-BFGS on the driver, which holds vectors of one
    number a feature; losses and gradients are sums over rows packed once). The gradient's length bounds the distance to
    the optimum, as the penalty alone curves by 1, and ends the search.
    """

    def __init__(self, features: str, strength: float = 1.0, distance: float = 1e-5):
        super().__init__()
        self.features, self.strength, self.distance = features, strength, distance

    def _fit(self, dataset: DataFrame):
        rows = packed(dataset, self.features).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            blocks = rows.coalesce(4 * dataset.sparkSession.sparkContext.defaultParallelism)
            size = blocks.map(lambda b: b[0]).reduce(max)
            w, strength = np.zeros(size), self.strength

            def sums(part, at: np.ndarray | None):
                total = np.zeros(size + 1)
                for b in part:
                    total += curvature(b, size) if at is None else loss_and_gradient(b, at)
                yield total

            def summed(at: np.ndarray | None) -> np.ndarray:
                return strength * blocks.mapPartitions(lambda part: sums(part, at)).treeReduce(operator.add)

            def objective(at: np.ndarray) -> tuple[float, np.ndarray]:
                total = summed(at)
                return at @ at / 2 + total[0], at + total[1:]

            w = least(objective, w, 1 / (1 + summed(None)[1:]), self.distance)
        finally:
            rows.unpersist()
        return PenalisedLogisticModel(self.features, w)

    def copy(self, extra=None):
        return self


class PenalisedLogisticModel(Model):
    """coefficients, and for rows their probability of both classes."""

    def __init__(self, features: str, w: np.ndarray):
        super().__init__()
        self.features, self.coefficients, self.intercept = features, Vectors.dense(w), 0.0

    def _transform(self, dataset: DataFrame) -> DataFrame:
        products = ElementwiseProduct(scalingVec=self.coefficients, inputCol=self.features, outputCol="_products").transform(dataset)
        margin = F.aggregate(F.unwrap_udt("_products")["values"], F.lit(0.0), lambda total, x: total + x)
        p = 1 / (1 + F.exp(-margin))
        return products.withColumn("_p", p).withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), "_p"))).drop("_products", "_p")

    def copy(self, extra=None):
        return self


def packed(df: DataFrame, features: str) -> RDD:
    """Rows as numpy blocks: number of features, each value's row, feature and value, and the rows' labels and weights."""

    def pack(batches):
        for b in batches:
            values, indices = b.column("values"), b.column("indices")
            n = np.diff(values.offsets.to_numpy()).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows, dtype=np.int32), n)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            at[np.repeat(indices.is_valid().to_numpy(zero_copy_only=False), n)] = indices.flatten().to_numpy()  # else dense
            size = max(int(n.max(initial=0)), pc.max(b.column("size")).as_py() or 0)
            parts = row, at, values.flatten().to_numpy(), b.column("label").to_numpy(), b.column("weight").to_numpy()
            yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(names, parts, strict=True)})

    names, kinds = ("row", "at", "x", "label", "weight"), (np.int32, np.int32, float, float, float)
    v = F.unwrap_udt(features)
    rows = df.select(v["size"].alias("size"), v["indices"].alias("indices"), v["values"].alias("values"), F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"))
    blocks = rows.mapInArrow(pack, "size int, " + ", ".join(f"{k} binary" for k in names))
    return blocks.rdd.map(lambda r: (r[0], *(np.frombuffer(bytes(x), t) for x, t in zip(r[1:], kinds, strict=True))))


def curvature(block: tuple, size: int) -> np.ndarray:
    """Second derivatives of the losses at weights of 0, after a place for the loss."""
    _, row, at, x, _, c = block
    return np.concatenate(([0.0], np.bincount(at, c[row] * x * x / 4, size)))


def loss_and_gradient(block: tuple, w: np.ndarray) -> np.ndarray:
    _, row, at, x, label, c = block
    sign = 2 * label - 1
    margin = sign * np.bincount(row, x * w[at], len(label))
    pull = -c * sign * np.exp(-np.logaddexp(0, margin))
    return np.concatenate(([c @ np.logaddexp(0, -margin)], np.bincount(at, x * pull[row], len(w))))


def least(objective: Callable, w: np.ndarray, scale: np.ndarray, distance: float, kept: int = 30) -> np.ndarray:
    """Where the objective (value and gradient) of curvature 1 at least is least, up to the distance (of 1 or |w|), by
    L-BFGS that begins with scale as the inverse of the second derivatives."""
    f, g = objective(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    while np.linalg.norm(g) > distance * max(1.0, np.linalg.norm(w)):
        step, shares = -g, []
        for s, y in reversed(past):
            shares.append(s @ step / (s @ y))
            step = step - shares[-1] * y
        step = step * scale * (past[-1][0] @ past[-1][1] / (past[-1][1] @ (scale * past[-1][1])) if past else 1.0)
        for (s, y), share in zip(past, reversed(shares), strict=True):
            step = step + (share - y @ step / (s @ y)) * s
        slope, length = g @ step, 1.0
        new = objective(w + step)
        while new[0] > f + 1e-4 * length * slope + 1e-13 * abs(f):
            length /= 2
            if length < 1e-9:
                return w  # no better value in doubles
            new = objective(w + length * step)
        past = [*past, (length * step, new[1] - g)][-kept:]
        w, (f, g) = w + length * step, new
    return w


def logistic(features: str, strength: float) -> list:
    return [SQLTransformer(statement="SELECT *, 1.0D AS constant FROM __THIS__"), VectorAssembler(inputCols=[features, "constant"], outputCol="with_constant"), PenalisedLogistic("with_constant", strength)]


def structured_features(df: DataFrame, features: list[str], derived: tuple[str, ...] = ("silver_", "qa_", "review_")) -> tuple[DataFrame, list[str]]:
    """df with the features that it has as numbers (booleans 0 and 1, malformed values null), and their names.

    Columns that come from the label itself may not be features.
    """
    if bad := [c for c in features if c.startswith(derived)]:
        raise ValueError(f"label-derived columns: {bad}")
    here = [c for c in features if c in df.columns]
    if not here:
        raise ValueError("no structured feature is present")
    number = lambda c: F.col(c).cast("int").cast("double") if df.schema[c].dataType.simpleString() == "boolean" else F.col(c).try_cast("double")
    return df.withColumns({c: number(c) for c in here}), here


def text_pipeline(vocabulary: int = 20000, min_df: int = 2, strength: float = 1.0) -> Pipeline:
    """Lower-cased one- and two-grams without accents, TF-IDF scaled to length 1, logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="plain_text", outputCol="words", pattern=r"(?U)\W+", minTokenLength=2), NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=vocabulary, minDF=min_df), SmoothIdf("counts", "weighted"), Normalizer(inputCol="weighted", outputCol="features"), *logistic("features", strength),
    ])


def with_plain_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df with plain_text, what text_pipeline reads: in lower case, without accents."""
    return df.withColumn("plain_text", unaccented(F.lower(text)))


def structured_pipeline(columns: list[str], strength: float = 1.0) -> Pipeline:
    """Given columns (nulls as 0), scaled without centring, logistic regression."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=False), *logistic("features", strength)])


def fit_and_score(df: DataFrame, pipeline: Pipeline, name: str, key: str = "doc_id") -> DataFrame:
    """Trains on rows of split train and scores validation and test: key, split, model, label, score; no text."""
    empty = {"train", "validation", "test"} - {r[0] for r in df.select("split").distinct().collect()}
    if empty:
        raise ValueError(f"splits without rows: {sorted(empty)}")
    model = pipeline.fit(balanced(df.where("split = 'train'")))
    out = model.transform(df.where(F.col("split").isin("validation", "test")).withColumn("weight", F.lit(1.0)))
    return out.select(key, "split", F.lit(name).alias("model"), F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def fit_tasks(df: DataFrame, tasks: dict[str, str], models: dict[str, Pipeline], key: str = "doc_id") -> DataFrame:
    """Every model trained and scored for every task (name to label column) on the rows that have its label, in one table."""
    out = None
    for task, column in tasks.items():
        rows = df.where(F.col(column).isNotNull()).withColumn("label", F.col(column).cast("double"))
        for name, pipeline in models.items():
            one = fit_and_score(rows, pipeline, name, key).withColumn("task", F.lit(task))
            out = one if out is None else out.unionByName(one)
    return out
