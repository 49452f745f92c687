"""The extraction queries look for frequent words too, not only for rare ones."""

import re

import pytest
from pyspark.sql import functions as F

from labelmill.plans import registry


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text").collect()}


def test_matches_hold_frequent_terms(spark, sf_dir, texts):
    found = registry.queries()["dictionary_matches"](spark, sf_dir).where("kind = 't' and no = 0").count()
    assert found >= sum(len(re.findall(r"(?<!\S)the(?!\S)", t)) for t in texts.values()) > 300


def test_frequent_terms_are_promoted(spark, sf_dir):
    found = {r[0] for r in registry.queries()["promoted_entities"](spark, sf_dir).select("phrase").distinct().collect()}
    assert {"the", "with the"} <= found


def test_frequent_terms_decide_predictions(spark, sf_dir):
    rows = registry.queries()["document_predictions"](spark, sf_dir)
    assert rows.agg(F.sum("n_entities")).first()[0] == registry.queries()["promoted_entities"](spark, sf_dir).count() > 20


def test_stages_are_compared_without_reading_cues(spark, sf_dir, monkeypatch):
    from labelmill.operators import extraction

    seen, marks = [], extraction.marks
    monkeypatch.setattr(extraction, "marks", lambda docs, spec, *more: seen.append(spec) or marks(docs, spec, *more))
    registry.queries()["stage_agreement"](spark, sf_dir)
    assert len(seen) == 3 and not any(s.cues for s in seen)
