"""Queries that train and apply models; SQL has no counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import split_bucket, split_name
from ..operators import learning as M
from ..operators.metrics import ranking_metrics
from .registry import query
from .tables import table


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("text is not null")
    d = d.withColumn("split", split_name(split_bucket(F.col("doc_id"), "split-v1")))
    return d.select("doc_id", "text", "toxic", "n_chars", "split", F.col("quality").cast("double").alias("label"), "quality", F.regexp_count("text", F.lit("[A-Z]")).alias("n_upper"), F.regexp_count("text", F.lit("[|!$%&*]")).alias("n_signs"))


@query()
def text_baseline(spark, sf_dir):
    """Ranking metrics of the text model per split."""
    return ranking_metrics(M.fit_and_score(M.with_plain_text(_labelled(spark, sf_dir)), M.text_pipeline(), "text"), ["model", "split"])


@query()
def structured_baseline(spark, sf_dir):
    d = _labelled(spark, sf_dir).fillna(0, ["n_chars", "n_upper", "n_signs"])
    return ranking_metrics(M.fit_and_score(d, M.structured_pipeline(["n_chars", "n_upper", "n_signs"]), "structured"), ["model", "split"])


@query()
def baselines_by_task(spark, sf_dir):
    """Structured models of two tasks, their predictions in one table, rated per task and split."""
    d, here = M.structured_features(_labelled(spark, sf_dir), ["n_chars", "n_upper", "n_signs", "absent"])
    scored = M.fit_tasks(d.fillna(0, here), {"quality": "quality", "toxic": "toxic"}, {"structured": M.structured_pipeline(here)})
    return ranking_metrics(scored, ["task", "model", "split"])
