"""Weak labels: joining noisy sources, features, silver labels, splits, samples and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X


def combine_labelers(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of two labelers with flags of presence."""
    return a.withColumn("has_a", F.lit(True)).join(b.withColumn("has_b", F.lit(True)), key, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_a", "has_b")})


def assign_splits(df: DataFrame, subject: str, salt: str = "split-v1") -> DataFrame:
    """df with the split of its subject; all rows of a subject go to one split."""
    return df.withColumn("split", X.split_name(X.split_bucket(F.col(subject), salt)))


def leaks(df: DataFrame, subject: str) -> DataFrame:
    """Subjects in more than one split."""
    return df.groupBy(subject).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def assert_no_leaks(df: DataFrame, subject: str, examples: int = 5) -> None:
    found = example_values(leaks(df, subject), subject, examples).first()
    if found["n"]:
        raise ValueError(f"{found['n']} subjects are in several splits, such as {found['examples']}")


def example_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """One row: how many rows there are, and the first n of the column's distinct values in order."""
    first = df.select(F.col(column).cast("string").alias("v")).distinct().orderBy("v").limit(n).agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return df.agg(F.count("*").alias("n")).join(F.broadcast(first))  # one row each


def with_split(df: DataFrame, splits: DataFrame, subject: str) -> DataFrame:
    """Rows of subjects that have a split, with it. splits: a row per subject."""
    return df.join(splits.select(subject, "split"), subject)


def reviewed(silver: DataFrame, reviews: DataFrame, key: list[str], cut: float = 50) -> DataFrame:
    """Reviewed rows with the silver label beside the reviewer's, and whether they agree (null where either is missing)."""
    human = (F.col("probability_0_100") >= cut).cast("int")
    return silver.join(reviews, key).withColumn("human_label", human).withColumn("agrees", F.col("human_label") == F.col("silver_strict"))


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df sorted by keys that are unique together, so that the order is the same at every run."""
    return df.orderBy(*keys)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least key: a limit that gives the same rows at every run."""
    return df.orderBy(key).limit(n)


def score_bin(c: Column) -> Column:
    edges = (0.1, 0.3, 0.5, 0.7, 0.9)
    out = F.when(c < edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        out = out.when(c < e, k)
    return out.when(c.isNotNull(), 5).cast("int")


def stratified_sample(df: DataFrame, score: str, key: str, per_bin: int = 50) -> DataFrame:
    """Per score bin the rows of least hash, with empty columns for a reviewer."""
    w = Window.partitionBy("score_bin").orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    rows = df.withColumn("score_bin", score_bin(F.col(score))).where("score_bin is not null")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_bin).withColumns({"review_probability": F.lit(None).cast("double"), "reviewer_notes": F.lit(None).cast("string")})


def hashed_queue(df: DataFrame, key: str, limit: int = 200) -> DataFrame:
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(limit)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def graph_features(relations: DataFrame, entities: DataFrame, key: list[str], keywords: dict[str, str], kind: str | None = None) -> DataFrame:
    """Relations expanded by both entities, then per report: count, a boolean per keyword, and examples in order.

    relations: key, source_id, target_id, relation; entities: key, entity_id, tokens.
    """
    rel = relations if kind is None else relations.where(F.col("relation") == kind)
    e = lambda side: entities.select(*key, F.col("entity_id").alias(f"{side}_id"), F.col("tokens").alias(f"{side}_tokens"))
    rows = rel.join(e("source"), [*key, "source_id"], "left").join(e("target"), [*key, "target_id"], "left")
    both = F.concat_ws(" ", "source_tokens", "target_tokens")
    return rows.groupBy(*key).agg(F.count("*").alias("n_relations"), *(F.coalesce(F.bool_or(both.rlike(p)), F.lit(False)).alias(k) for k, p in keywords.items()), F.slice(F.array_sort(F.collect_set(both)), 1, 20).alias("examples"))


def identical_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a one-to-one match: keys only on one side, or repeated."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    m = n(a, "n_a").join(n(b, "n_b"), keys, "full").fillna(0, ["n_a", "n_b"])
    return m.where("n_a <> 1 or n_b <> 1").withColumn("violation", F.when(F.col("n_a") == 0, "right_only").when(F.col("n_b") == 0, "left_only").otherwise("repeated"))


def multiset_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose multiplicities differ, with both counts."""
    n = lambda df, name: df.groupBy(*(F.col(c).alias(c) for c in columns)).agg(F.count("*").alias(name))
    left, right = n(a, "n_a").alias("l"), n(b, "n_b").alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
    m = left.join(right, on, "full").select(*(F.coalesce(f"l.{c}", f"r.{c}").alias(c) for c in columns), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    return m.where("n_a <> n_b")


def occurrence_number(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """Zero-based number of each of several identical rows."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*same).orderBy(*order)) - 1)
