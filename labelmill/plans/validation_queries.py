"""Queries of checks over tables in which every so many rows are spoiled."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import validation as V
from .registry import query
from .tables import PREDICTIONS, RATINGS, predictions, ratings, table

_K = lambda n, v, c="doc_id": F.pmod(c, F.lit(n)) == v
_ROWS = lambda *pairs: " UNION ALL ".join(f"SELECT '{k}' AS \"check\", '{s}' AS severity, ({q})::BIGINT AS n_rows" for k, s, q in pairs)


def _checks(cte: str, *pairs: tuple[str, str, str]) -> str:
    return f"WITH {cte}, c AS ({_ROWS(*pairs)}) SELECT * FROM c WHERE n_rows > 0"


_REVIEWS = """v AS (SELECT source AS subject_id, CASE WHEN doc_id % 29 = 3 THEN NULL ELSE doc_id END AS study_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 31 = 5 THEN 'high' WHEN doc_id % 37 = 6 THEN '140' ELSE (doc_id % 101)::VARCHAR END AS p, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN '' WHEN doc_id % 23 = 2 THEN ' ' ELSE 'R' || (doc_id % 3)::VARCHAR END AS reviewer_id, CASE WHEN doc_id % 16 = 8 THEN 'seen' ELSE NULL END AS notes FROM documents
UNION ALL SELECT source, doc_id, '7', 'R1', NULL FROM documents WHERE doc_id % 40 = 1), w AS (SELECT *, TRY_CAST(p AS DOUBLE) AS x FROM v), d AS (SELECT * FROM w WHERE x IS NOT NULL OR trim(reviewer_id) <> '' OR coalesce(trim(notes), '') <> '')"""


def _reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = F.when(_K(4, 0), None).when(_K(31, 5), "high").when(_K(37, 6), "140").otherwise(F.pmod("doc_id", F.lit(101)).cast("string"))
    reviewer = F.when(_K(8, 0), "").when(_K(23, 2), " ").otherwise(F.concat(F.lit("R"), F.pmod("doc_id", F.lit(3)).cast("string")))
    rows = d.select(F.col("source").alias("subject_id"), F.when(~_K(29, 3), F.col("doc_id")).alias("study_id"), p.alias("probability_0_100"), reviewer.alias("reviewer_id"), F.when(_K(16, 8), "seen").alias("reviewer_notes"))
    return rows.unionByName(d.where(_K(40, 1)).select(F.col("source").alias("subject_id"), F.col("doc_id").alias("study_id"), F.lit("7").alias("probability_0_100"), F.lit("R1").alias("reviewer_id"), F.lit(None).cast("string").alias("reviewer_notes")))


@query(_checks(_REVIEWS, ("ids_present", "error", "SELECT count(*) FROM v WHERE study_id IS NULL OR subject_id IS NULL"), ("probability_range", "error", "SELECT count(*) FROM d WHERE NOT coalesce(x BETWEEN 0 AND 100, FALSE)"), ("reviewer_id", "error", "SELECT count(*) FROM d WHERE coalesce(trim(reviewer_id), '') = ''"), ("duplicate_reviewer_study", "error", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM d GROUP BY subject_id, study_id, reviewer_id HAVING count(*) > 1)")))
def review_label_checks(spark, sf_dir):
    return V.review_labels(_reviews(spark, sf_dir))[1]


@query(f"WITH {_REVIEWS} SELECT subject_id, coalesce(study_id, -1) AS study_id, coalesce(x, -1) AS probability_0_100, reviewer_id, TRUE AS review_completed FROM d")
def completed_reviews(spark, sf_dir):
    """Completed reviews without their notes."""
    return V.review_labels(_reviews(spark, sf_dir))[0].fillna(-1, ["study_id", "probability_0_100"])


_RATED = f"""{RATINGS}, v AS (SELECT CASE WHEN case_id % 41 = 4 THEN ' ' ELSE ' c' || case_id::VARCHAR END AS case_id, CASE WHEN case_id % 43 = 8 THEN NULL ELSE rater END AS rater_id, CASE WHEN case_id % 53 = 9 THEN 'both' ELSE task || '_only' END AS task, CASE WHEN case_id % 47 = 5 THEN '' WHEN case_id % 59 = 5 THEN '-3' ELSE value::VARCHAR END AS p, CASE case_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' Complete' WHEN 2 THEN 'incomplete' WHEN 3 THEN 'lost' ELSE 'completed' END AS status FROM r UNION ALL SELECT 'c' || case_id::VARCHAR, rater, task || '_only', '5', '' FROM r WHERE case_id % 60 = 13),
s AS (SELECT *, lower(trim(coalesce(status, ''))) AS st FROM v), d AS (SELECT nullif(trim(case_id), '') AS case_id, rater_id, task, TRY_CAST(p AS DOUBLE) AS x FROM s WHERE st IN ('', 'complete', 'completed'))"""


def _rated(spark, sf_dir):
    r, k = ratings(spark, sf_dir), lambda n, v: _K(n, v, "case_id")
    status = F.when(k(6, 0), None).when(k(6, 1), " Complete").when(k(6, 2), "incomplete").when(k(6, 3), "lost").otherwise("completed")
    name = F.concat(F.lit("c"), F.col("case_id").cast("string"))
    rows = r.select(F.when(k(41, 4), " ").otherwise(F.concat(F.lit(" "), name)).alias("case_id"), F.when(~k(43, 8), F.col("rater")).alias("rater_id"), F.when(k(53, 9), "both").otherwise(F.concat("task", F.lit("_only"))).alias("review_task"), F.when(k(47, 5), "").when(k(59, 5), "-3").otherwise(F.col("value").cast("string")).alias("probability_0_100"), status.alias("review_status"))
    return rows.unionByName(r.where(k(60, 13)).select(name.alias("case_id"), F.col("rater").alias("rater_id"), F.concat("task", F.lit("_only")).alias("review_task"), F.lit("5").alias("probability_0_100"), F.lit("").alias("review_status")))


@query(_checks(_RATED, ("review_status", "error", "SELECT count(*) FROM s WHERE st NOT IN ('', 'complete', 'completed', 'incomplete', 'skipped')"), ("case_id", "error", "SELECT count(*) FROM d WHERE case_id IS NULL"), ("rater_id", "error", "SELECT count(*) FROM d WHERE rater_id IS NULL"), ("review_task_known", "error", "SELECT count(*) FROM d WHERE task NOT IN ('image_only', 'report_only')"), ("probability_range", "error", "SELECT count(*) FROM d WHERE NOT coalesce(x BETWEEN 0 AND 100, FALSE)"), ("duplicate_case_rater_task", "error", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM d GROUP BY case_id, rater_id, task HAVING count(*) > 1)")))
def rating_checks(spark, sf_dir):
    return V.rating_rows(_rated(spark, sf_dir))[1]


def canonical(spark, sf_dir, spoil: bool = False):
    """Predictions as canonical rows; spoiled ones have faults in every so many rows."""
    p = predictions(spark, sf_dir)
    when = lambda n, v, bad, good: F.when(_K(n, v), F.lit(bad)).otherwise(good) if spoil else good
    text = lambda v: F.lit(v)
    study = F.col("doc_id") + 1
    out = p.select(
        when(61, 5, "case_x", X.case_id(F.length("source") + 0 * study, study)).alias("case_id"), F.length("source").alias("subject_id"), study.alias("study_id"), when(67, 7, "dev", X.split_name(X.split_bucket(F.col("doc_id"), "split-v1"))).alias("split"), F.col("lang").alias("source_dataset"), F.col("model").alias("model_name"),
        text("family").alias("model_family"), when(71, 9, "guest", F.when(F.col("model") == "m1", "external_comparator").otherwise("silver_derived_control")).alias("comparison_role"), F.when(F.col("model") == "m3", "strict").otherwise("both").alias("intended_target"), text("repo").alias("model_source_repository"),
        when(73, 2, " ", text("c0ffee")).alias("model_source_commit"), text("v1").alias("model_artifact_version"), text("full_report").alias("text_scope"), when(79, 3, 1.5, F.col("score")).alias("prediction_score"), when(83, 6, 2, (F.col("score") >= 0.5).cast("int")).alias("prediction_label"),
        F.col("label").cast("string").alias("raw_predicted_class"), when(89, 8, -0.5, F.when(F.col("model") == "m2", None).otherwise(F.lit(0.5))).alias("threshold"), text("run-1").alias("run_id"), "label", "target", "doc_id", "source",
    )
    return out.unionByName(out.where(_K(97, 10) & (F.col("model_name") == "m2"))) if spoil else out


_SPLIT = "CAST(('0x' || substr(sha256(doc_id::VARCHAR || '-split-v1'), 1, 15)) AS BIGINT) % 10000"
CANON = f"""{PREDICTIONS}, cp AS (SELECT 'case_' || length(source)::VARCHAR || '_' || (doc_id + 1)::VARCHAR AS case_id, CASE WHEN {_SPLIT} < 7000 THEN 'train' WHEN {_SPLIT} < 8500 THEN 'validation' ELSE 'test' END AS split, lang AS source_dataset, model AS model_name, CASE WHEN model = 'm1' THEN 'external_comparator' ELSE 'silver_derived_control' END AS comparison_role, CASE WHEN model = 'm3' THEN 'strict' ELSE 'both' END AS intended_target, score AS prediction_score, (score >= 0.5)::INT AS prediction_label, CASE WHEN model = 'm2' THEN NULL ELSE 0.5 END AS threshold, label, target, doc_id, source FROM p)"""


@query(_checks(CANON, ("case_id_agrees", "error", "SELECT count(*) FROM cp WHERE doc_id % 61 = 5"), ("split_known", "error", "SELECT count(*) FROM cp WHERE doc_id % 67 = 7"), ("role_known", "error", "SELECT count(*) FROM cp WHERE doc_id % 71 = 9"), ("model_source_commit_present", "error", "SELECT count(*) FROM cp WHERE doc_id % 73 = 2"), ("score_range", "error", "SELECT count(*) FROM cp WHERE doc_id % 79 = 3"), ("label_range", "error", "SELECT count(*) FROM cp WHERE doc_id % 83 = 6"), ("threshold_range", "error", "SELECT count(*) FROM cp WHERE doc_id % 89 = 8")).replace("FROM cp WHERE", "FROM (SELECT doc_id FROM cp UNION ALL SELECT doc_id FROM cp WHERE doc_id % 97 = 10 AND model_name = 'm2') WHERE").replace(" UNION ALL SELECT 'threshold_range'", " UNION ALL SELECT 'duplicate_case_model' AS \"check\", 'error' AS severity, (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM (SELECT CASE WHEN doc_id % 61 = 5 THEN 'case_x' ELSE case_id END AS i, model_name FROM (SELECT * FROM cp UNION ALL SELECT * FROM cp WHERE doc_id % 97 = 10 AND model_name = 'm2')) GROUP BY i, model_name HAVING count(*) > 1))::BIGINT AS n_rows UNION ALL SELECT 'threshold_range'"))
def canonical_checks(spark, sf_dir):
    return V.canonical_predictions(canonical(spark, sf_dir, spoil=True))[1]


_SOFT = f"{PREDICTIONS}, v AS (SELECT source AS subject_id, doc_id AS study_id, CASE WHEN doc_id % 19 = 4 THEN ' ' ELSE model END AS model, CASE WHEN doc_id % 17 = 2 THEN 'x' WHEN doc_id % 13 = 1 THEN '1.01' ELSE score::VARCHAR END AS s FROM p)"


@query(_checks(_SOFT, ("model_name_present", "error", "SELECT count(*) FROM v WHERE trim(model) = ''"), ("score_range", "error", "SELECT count(*) FROM v WHERE NOT coalesce(TRY_CAST(s AS DOUBLE) BETWEEN 0 AND 1, FALSE)"), ("duplicate_case_model", "error", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM v GROUP BY subject_id, study_id, nullif(trim(model), '') HAVING count(*) > 1)")))
def soft_prediction_checks(spark, sf_dir):
    """Case ids and model names are derived first."""
    p = predictions(spark, sf_dir)
    rows = p.select(F.col("source").alias("subject_id"), F.col("doc_id").alias("study_id"), F.when(_K(19, 4), " ").otherwise(F.col("model")).alias("model"), F.when(_K(17, 2), "x").when(_K(13, 1), "1.01").otherwise(F.col("score").cast("string")).alias("prediction_score"))
    return V.prediction_rows(rows)[1]


_REF = "v AS (SELECT CASE WHEN doc_id % 25 = 0 THEN 0 ELSE doc_id END AS case_id, CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'n/a' WHEN doc_id % 14 = 0 THEN '2' ELSE '0.5' END AS t FROM documents)"


@query(_checks(_REF, ("report_mean_range", "error", "SELECT count(*) FROM v WHERE trim(t) <> '' AND NOT coalesce(TRY_CAST(t AS DOUBLE) BETWEEN 0 AND 1, FALSE)"), ("duplicate_case", "error", "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM v GROUP BY case_id HAVING count(*) > 1)")))
def soft_reference_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(_K(25, 0), F.lit(0)).otherwise(F.col("doc_id")).alias("case_id"), F.when(_K(9, 0), " ").when(_K(11, 0), "n/a").when(_K(14, 0), "2").otherwise("0.5").alias("report_mean"))
    return V.reference_rows(d, ["report_mean", "image_mean"])[1]


@query(f"WITH {CANON}, s AS (SELECT DISTINCT source AS name FROM documents), e AS (SELECT source AS m, count(*) AS n FROM cp WHERE model_name = 'm1' GROUP BY 1), c AS (SELECT 'one_status' AS \"check\", count(*) FILTER (m LIKE '%1') AS n_rows FROM e UNION ALL SELECT 'status_available', count(*) FILTER (m NOT LIKE '%1' AND m LIKE '%2') FROM e) SELECT \"check\", 'error' AS severity, n_rows FROM c WHERE n_rows > 0")
def status_checks(spark, sf_dir):
    """Sources as external models: those that end in 1 have no status, those in 2 none that is available."""
    p = canonical(spark, sf_dir).where("model_name = 'm1'").withColumn("model_name", F.col("source"))
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct().where("name not like '%1'")
    s = s.select("name", F.when(F.col("name").endswith("2"), "failed").otherwise("available").alias("status"), F.lit("run-1").alias("run_id"), F.array().cast("array<string>").alias("models"))
    return V.status_coverage(p, s)


@query("SELECT value, side FROM (SELECT DISTINCT lang AS value, 'unexpected' AS side FROM documents WHERE lang NOT IN ('en', 'it') UNION ALL SELECT v, 'absent' FROM (VALUES ('en'), ('it')) t(v) WHERE v NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL))")
def language_differences(spark, sf_dir):
    return V.values_differ(table(spark, sf_dir, "documents"), "lang", ["en", "it"], subset=False)


@query("SELECT lang, n FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) UNION ALL SELECT v, 0 FROM (VALUES ('it'), ('pt')) t(v) WHERE v NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)")
def completed_languages(spark, sf_dir):
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return V.completed_names(g, "lang", ["en", "it", "pt"], n=0)
