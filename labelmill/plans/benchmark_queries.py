"""Queries of predictions against references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import benchmark as B
from ..operators import validation as V
from .registry import _Q, _T, _rounded, query
from .tables import table
from .validation_queries import CANON, canonical

TASKS = {"strict": "label_strict", "sensitive": "label_sensitive"}
_FLAG = "doc_id % 3 = 0"
REF = f"{CANON}, ref AS (SELECT DISTINCT case_id, split, source_dataset, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE label END AS label_strict, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE label END AS label_sensitive, 's' || (doc_id % 3)::VARCHAR AS silver_source, CASE WHEN doc_id % 4 = 0 THEN 'high' ELSE 'low' END AS review_priority, {_FLAG} AS flags_present FROM cp)"


def reference(spark, sf_dir):
    k = lambda n: F.pmod("doc_id", F.lit(n))
    c = canonical(spark, sf_dir).where("model_name = 'm1'")
    return c.select("case_id", "split", "source_dataset", F.when(k(10) != 0, F.col("label")).alias("label_strict"), F.when(k(7) == 0, 1).otherwise(F.col("label")).alias("label_sensitive"), F.concat(F.lit("s"), k(3).cast("string")).alias("silver_source"), F.when(k(4) == 0, "high").otherwise("low").alias("review_priority"), X.flags_present(F.array(F.lit("none"), F.when(k(3) == 0, "odd").otherwise(" "))).alias("flags_present"))


_EACH = f"""{REF}, j AS (SELECT cp.*, ref.* EXCLUDE (case_id, split, source_dataset) FROM cp JOIN ref USING (case_id) WHERE cp.split <> 'train'),
t AS (SELECT *, 'strict' AS task, label_strict AS y FROM j WHERE label_strict IS NOT NULL UNION ALL SELECT *, 'sensitive', label_sensitive FROM j WHERE intended_target = 'both'),
e AS (SELECT *, 'overall' AS stratum, 'all' AS value FROM t UNION ALL SELECT *, 'silver_source', silver_source FROM t UNION ALL SELECT *, 'review_priority', review_priority FROM t UNION ALL SELECT *, 'flags_present', flags_present::VARCHAR FROM t)"""


@query(f"""WITH {_EACH}, g AS (SELECT task, model_name, comparison_role, split, stratum, value, count(*) AS n, count(*) FILTER (y = 1) AS positives, avg(prediction_label) AS predicted_positive_rate, count(*) FILTER (y = 1 AND prediction_label = 1) AS tp, count(*) FILTER (y = 0 AND prediction_label = 1) AS fp, count(*) FILTER (y = 0 AND prediction_label = 0) AS tn, count(*) FILTER (y = 1 AND prediction_label = 0) AS fn, avg((prediction_score - y) ** 2) AS brier, max(threshold) AS threshold FROM e GROUP BY ALL),
s AS (SELECT task, model_name, split, stratum, value, prediction_score AS s, sum((y = 1)::INT)::DOUBLE AS pos, sum((y = 0)::INT)::DOUBLE AS neg FROM e GROUP BY ALL),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY task, model_name, split, stratum, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER v AS tp, sum(pos + neg) OVER v AS n FROM s WINDOW v AS (PARTITION BY task, model_name, split, stratum, value ORDER BY s DESC)),
k AS (SELECT task, model_name, split, stratum, value, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS roc_auc, CASE WHEN sum(neg) > 0 AND sum(pos) > 0 THEN sum(pos * tp / n) / sum(pos) END AS average_precision FROM w GROUP BY ALL)
SELECT g.task, g.model_name, comparison_role, g.split, g.stratum, g.value, n, positives, round(predicted_positive_rate, 6) AS predicted_positive_rate, round(brier + 1e-9, 6) AS brier, threshold, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(positives / n, 6) AS prevalence, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS ppv, round(tn / nullif(tn + fn, 0), 6) AS npv, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM g JOIN k USING (task, model_name, split, stratum, value)""")
def benchmark_metrics(spark, sf_dir):
    """Stored labels and scores by task, model, split and stratum."""
    m = B.benchmark(V.canonical_predictions(canonical(spark, sf_dir).drop("label", "target", "doc_id", "source"))[0], reference(spark, sf_dir), TASKS)[0]
    return _rounded(m.withColumn("brier", F.col("brier") + 1e-9))  # off the borders of rounding


@query(f"WITH {CANON} SELECT 'unmatched' AS \"check\", 'error' AS severity, count(*) AS n_rows FROM cp WHERE doc_id % 20 = 3 HAVING count(*) > 0 UNION ALL SELECT 'split_agrees', 'error', count(*) FROM cp WHERE doc_id % 20 <> 3 AND doc_id % 33 = 1 AND split <> 'test' HAVING count(*) > 0")
def benchmark_join_checks(spark, sf_dir):
    r = reference(spark, sf_dir).withColumn("n", F.split("case_id", "_")[2].cast("bigint") - 1)
    r = r.where("pmod(n, 20) <> 3").withColumn("split", F.when(F.expr("pmod(n, 33) = 1"), "test").otherwise(F.col("split"))).drop("n")
    return B.benchmark(canonical(spark, sf_dir), r, TASKS)[2]


@query(f"WITH {CANON} SELECT model_name, 'family' AS model_family, min(comparison_role) AS comparison_role, min(intended_target) AS intended_target, 'full_report' AS text_scope, count(*) AS prediction_rows, count(DISTINCT case_id) AS unique_cases, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows, round(avg(prediction_score), 6) AS mean_score, round(avg(prediction_label), 6) AS positive_rate, count(DISTINCT case_id) FILTER (doc_id % 12 = 5) AS cases_without_reference FROM cp GROUP BY model_name")
def model_catalog(spark, sf_dir):
    c = canonical(spark, sf_dir)
    return _rounded(B.catalog(c, c.where("pmod(doc_id, 12) <> 5")))


@query(f"WITH {CANON} SELECT 'required_models' AS \"check\", 'error' AS severity, 1 AS n_rows UNION ALL SELECT 'unreferenced_cases', 'error', sum(n)::BIGINT FROM (SELECT count(DISTINCT case_id) AS n FROM cp WHERE doc_id % 12 = 5 GROUP BY model_name) HAVING sum(n) > 0")
def snapshot_checks(spark, sf_dir):
    c = canonical(spark, sf_dir)
    return V.snapshot_ready(B.catalog(c, c.where("pmod(doc_id, 12) <> 5")), ["m1", "m2", "m4"])


@query(f"WITH {CANON}, v AS (SELECT * FROM cp UNION ALL SELECT * FROM cp WHERE doc_id % 15 = 2), w AS (SELECT *, CASE WHEN doc_id % 21 = 0 THEN NULL WHEN doc_id % 26 = 0 THEN 1.25 ELSE prediction_score END AS s FROM v) SELECT model_name, count(*) AS prediction_rows, count(DISTINCT case_id) AS unique_cases, round(avg(prediction_label), 6) AS positive_rate, round(avg(s), 6) AS mean_score, count(*) - count(DISTINCT case_id) AS repeated_rows, count(*) FILTER (s IS NULL) AS missing_scores, count(*) FILTER (s > 1) AS scores_outside FROM w GROUP BY model_name")
def output_summary(spark, sf_dir):
    c = canonical(spark, sf_dir)
    c = c.unionByName(c.where("pmod(doc_id, 15) = 2")).withColumn("prediction_score", F.when(F.expr("pmod(doc_id, 21) <> 0"), F.when(F.expr("pmod(doc_id, 26) = 0"), 1.25).otherwise(F.col("prediction_score"))))
    return _rounded(B.output_summary(c))


@query(f"WITH {CANON} SELECT case_id, model_name, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unexpected' ELSE 'differs' END AS side, CASE doc_id % 5 WHEN 2 THEN 'prediction_label' WHEN 3 THEN 'prediction_score' ELSE '' END AS fields FROM cp WHERE doc_id % 5 < 4 AND model_name <> 'm3'")
def expectation_differences(spark, sf_dir):
    c, k = canonical(spark, sf_dir).where("model_name <> 'm3'"), F.pmod("doc_id", F.lit(5))
    seen = c.where(k != 0).withColumns({"prediction_label": F.when(k == 2, 1 - F.col("prediction_label")).otherwise(F.col("prediction_label")), "prediction_score": F.when(k == 3, F.col("prediction_score") + 0.001).otherwise(F.col("prediction_score") + 1e-10)})
    return B.expectation_differences(seen, c.where(k != 1), ["case_id", "model_name"], ["prediction_label", "raw_predicted_class"])


@query(f"WITH {REF}, x AS (SELECT t.task, m.model, s.split FROM (VALUES ('strict'), ('sensitive')) t(task), (VALUES ('m1'), ('m2')) m(model), (VALUES ('validation'), ('test')) s(split)), w AS (SELECT task, split, count(*) AS n FROM (SELECT split, 'strict' AS task FROM ref WHERE label_strict IS NOT NULL UNION ALL SELECT split, 'sensitive' FROM ref) GROUP BY ALL), h AS (SELECT model_name AS model, split, 'strict' AS task, count(*) AS n FROM cp WHERE model_name IN ('m1', 'm2') AND doc_id % 10 <> 0 GROUP BY ALL UNION ALL SELECT model_name, split, 'sensitive', count(*) FROM cp WHERE model_name = 'm1' GROUP BY ALL) SELECT x.task, x.model, x.split, coalesce(w.n, 0) AS expected, coalesce(h.n, 0) AS found, x.model = 'm1' AS has_metrics FROM x LEFT JOIN w USING (task, split) LEFT JOIN h USING (task, model, split)")
def modelling_gaps(spark, sf_dir):
    c = canonical(spark, sf_dir).where("model_name <> 'm3'").withColumn("model", F.col("model_name"))
    p = c.where("pmod(doc_id, 10) <> 0").withColumn("task", F.lit("strict")).unionByName(c.where("model = 'm1'").withColumn("task", F.lit("sensitive")))
    m = p.where("model = 'm1'").select("task", "model", "split").distinct()
    return B.modelling_gaps(reference(spark, sf_dir), p, m, TASKS, ["m1", "m2"])


_SOFT = f"{CANON}, sr AS (SELECT DISTINCT case_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE target END AS report_mean, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE 1 - target END AS image_mean FROM cp WHERE doc_id % 8 <> 3), t AS (SELECT model_name, prediction_score AS score, 'report' AS target_type, report_mean AS target FROM cp JOIN sr USING (case_id) WHERE report_mean IS NOT NULL UNION ALL SELECT model_name, prediction_score, 'image', image_mean FROM cp JOIN sr USING (case_id) WHERE image_mean IS NOT NULL)"


def _soft(spark, sf_dir):
    c, k = canonical(spark, sf_dir), lambda n: F.pmod("doc_id", F.lit(n))
    r = c.where((F.col("model_name") == "m1") & (k(8) != 3)).select("case_id", F.when(k(6) != 0, F.col("target")).alias("report_mean"), F.when(k(4) != 1, 1 - F.col("target")).alias("image_mean"))
    return B.soft_benchmark(c.select("case_id", "model_name", "prediction_score"), r, {"report": "report_mean", "image": "image_mean"}, [0.3, 0.5, 0.7])


@query(f"WITH {_SOFT} SELECT model_name, target_type, count(*) AS n, round(avg(target), 6) AS mean_target, round(avg(score), 6) AS mean_score, round(avg((score - target) ** 2), 6) AS brier_soft, round(avg(abs(score - target)), 6) AS mae_soft, round(avg(-(target * ln({_Q}) + (1 - target) * ln(1 - {_Q}))), 6) AS log_loss_soft, round(regr_slope(ln({_T} / (1 - {_T})), ln({_Q} / (1 - {_Q}))), 6) AS slope, round(regr_intercept(ln({_T} / (1 - {_T})), ln({_Q} / (1 - {_Q}))), 6) AS intercept, round(regr_r2(ln({_T} / (1 - {_T})), ln({_Q} / (1 - {_Q}))), 6) AS r2 FROM t GROUP BY ALL")
def soft_benchmark(spark, sf_dir):
    """Every model against every kind of soft target."""
    return _rounded(_soft(spark, sf_dir)["metrics"])


@query(f"WITH {_SOFT}, n AS (SELECT case_id, count(*) AS p FROM cp GROUP BY 1), m AS (SELECT coalesce(n.p, 0) AS p, sr.case_id IS NOT NULL AS r FROM n FULL JOIN sr USING (case_id)) SELECT count(*) FILTER (r) AS reference_rows, sum(p)::BIGINT AS prediction_rows, (sum(p) FILTER (r))::BIGINT AS joined_rows, count(*) FILTER (r) AS reference_cases, count(*) FILTER (p > 0) AS prediction_cases, count(*) FILTER (r AND p = 0) AS cases_without_prediction, count(*) FILTER (NOT r AND p > 0) AS cases_without_reference FROM m")
def soft_join_audit(spark, sf_dir):
    return _soft(spark, sf_dir)["audit"]


@query(f"WITH {CANON}, e AS (SELECT model_name, 'overall' AS stratum, 'all' AS value, label, prediction_score AS s FROM cp UNION ALL SELECT model_name, 'split', split, label, prediction_score FROM cp) SELECT model_name, stratum, value, count(*) AS n, round(avg(label), 6) AS prevalence, round(avg(s), 6) AS mean_score FROM e GROUP BY ALL")
def prediction_summary(spark, sf_dir):
    return _rounded(B.prediction_summary(canonical(spark, sf_dir).withColumn("score", F.col("prediction_score")), ["model_name"], ["split"]))


@query("SELECT doc_id, coalesce((v >= 0.5)::INT, -1) AS x_ge_050, coalesce((v >= 0.67)::INT, -1) AS x_ge_067, coalesce((v BETWEEN 0.33 AND 0.67)::INT, -1) AS x_uncertain FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 101) / 100 END AS v FROM documents)")
def secondary_labels(spark, sf_dir):
    """Readings of mean probabilities; every fifth document has none, and so no reading (-1)."""
    d = table(spark, sf_dir, "documents").withColumn("mean", F.when(F.pmod("doc_id", F.lit(5)) != 0, F.pmod("doc_id", F.lit(101)) / 100))
    return d.select("doc_id", *(F.coalesce(c.cast("int"), F.lit(-1)).alias(k) for k, c in B.secondary_labels(F.col("mean"), "x").items()))


_MODES = f"{CANON}, m AS (SELECT case_id, doc_id, label FROM cp WHERE model_name = 'm1')"


@query(f"WITH {_MODES} SELECT case_id, mode, round(s, 6) AS prediction_score, (s >= 0.3)::INT AS prediction_label FROM (SELECT case_id, 'plain' AS mode, (doc_id % 10) / 10 AS s FROM m UNION ALL SELECT case_id, 'cut', (doc_id % 4) / 4 FROM m)")
def thresholded_scores(spark, sf_dir):
    m = canonical(spark, sf_dir).where("model_name = 'm1'")
    raw = lambda n: m.select("case_id", (F.pmod("doc_id", F.lit(n)) / n).alias("prediction_score"))
    return _rounded(B.thresholded({"plain": raw(10), "cut": raw(4)}, m.select("case_id"), 0.3).select("case_id", "mode", "prediction_score", "prediction_label"))


@query(f"WITH {_MODES} SELECT case_id, round((doc_id % 6) / 10, 6) AS prediction_score, (doc_id % 6 > 3)::INT AS prediction_label, CASE WHEN doc_id % 6 > 3 THEN 'bilateral' ELSE 'none' END AS raw_predicted_class FROM m")
def class_scores(spark, sf_dir):
    m = canonical(spark, sf_dir).where("model_name = 'm1'")
    p = F.pmod("doc_id", F.lit(6)) / 10
    raw = m.select("case_id", p.alias("p_both"), ((1 - p) / 2).alias("p_one"), ((1 - p) / 2).alias("p_none"), F.when(p > 0.35, "bilateral").otherwise("none").alias("raw"))
    return _rounded(B.class_probabilities(raw, m.select("case_id"), ["p_both", "p_one", "p_none"], "p_both", "raw", "bilateral").select("case_id", "prediction_score", "prediction_label", "raw_predicted_class"))


@query(f"WITH {_MODES} SELECT case_id, (label = 1 AND doc_id % 2 = 0)::INT AS prediction_label, (label = 1 AND doc_id % 2 = 0)::INT::DOUBLE AS prediction_score FROM m")
def extractor_scores(spark, sf_dir):
    m = canonical(spark, sf_dir).where("model_name = 'm1'")
    n = F.when((F.col("label") == 1) & (F.pmod("doc_id", F.lit(2)) == 0), 3).otherwise(0)
    p = m.select(F.concat(F.lit("s"), "study_id").alias("doc_id"), F.lit(" Evaluable").alias("s"), n.alias("n_entities"), (n > 0).cast("int").alias("label")).withColumn("prediction_status", F.trim("s")).drop("s")
    return B.extractor_predictions(p, m.select(F.col("study_id").alias("study"), "case_id")).select("case_id", "prediction_label", "prediction_score")


@query(f"WITH {CANON} SELECT case_id, 'silver_strict_' || CASE WHEN model_name = 'm1' THEN 'text' ELSE 'rule' END AS model_name, CASE WHEN model_name = 'm1' THEN 'trained_silver_baseline' ELSE 'silver_derived_control' END AS comparison_role FROM cp WHERE model_name <> 'm3'")
def baseline_names(spark, sf_dir):
    c = canonical(spark, sf_dir)
    p = c.where("model_name <> 'm3'").select("subject_id", "study_id", "split", F.lit("strict").alias("task"), F.when(F.col("model_name") == "m1", "text").otherwise("rule").alias("model"), "prediction_label")
    return B.baseline_predictions(p, c.where("model_name = 'm1'").select("subject_id", "study_id", "split", "case_id"))[0].select("case_id", "model_name", "comparison_role")


@query("SELECT o.o_orderkey AS k, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey > 0 GROUP BY 1")
def normalised_key_join(spark, sf_dir):
    """Orders and lines whose keys are written in different ways."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("k"))
    return B.predictions_with_extract(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), o, ["k"]).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text)::DOUBLE AS prediction_score FROM documents WHERE text IS NOT NULL")
def batch_scores(spark, sf_dir):
    return B.batch_scores(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "text", lambda texts: [float(len(t)) for t in texts])


@query(f"""WITH {_EACH}, m AS (SELECT task, split, stratum, value, count(*) AS n, round(avg(prediction_score), 6) AS mean_score FROM e WHERE model_name = 'm1' GROUP BY ALL) SELECT task, split, stratum, value, n, mean_score, 'legacy' AS only FROM m WHERE stratum = 'silver_source' UNION ALL SELECT task, split, stratum, value, n + 1, mean_score, 'mirror' FROM m WHERE stratum = 'silver_source'""")
def mirror_differences(spark, sf_dir):
    """A copy of a model's metric rows, of which those of one stratum are off by one."""
    m = B.benchmark(canonical(spark, sf_dir).where("model_name = 'm1'"), reference(spark, sf_dir), TASKS)[0]
    rows = B.by_task(canonical(spark, sf_dir).where("model_name = 'm1'").drop("label").join(reference(spark, sf_dir).drop("split", "source_dataset"), "case_id").where("split <> 'train'"), TASKS)
    mean = B.stratified(rows, list(B.STRATA)).groupBy("task", "split", "stratum", "value").agg(F.round(F.avg("prediction_score"), 6).alias("mean_score"))
    m = m.select("task", "model_name", "comparison_role", "split", "stratum", "value", "n").join(mean, ["task", "split", "stratum", "value"])
    copy = m.withColumns({"model_name": F.lit("copy"), "n": F.when(F.col("stratum") == "silver_source", F.col("n") + 1).otherwise(F.col("n"))})
    return V.mirror_differences(m.unionByName(copy), "copy", "m1")


@query(f"WITH {CANON}, g AS (SELECT source, count(DISTINCT split) AS k FROM (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY 1), c AS (SELECT 'validation_rows' AS \"check\", 1::BIGINT AS n_rows UNION ALL SELECT 'subject_overlap', count(*) FROM g WHERE k > 1 UNION ALL SELECT 'missing_text', count(*) FROM documents WHERE doc_id % 50 = 7 OR text IS NULL OR regexp_matches(text, '^\\s*$') UNION ALL SELECT 'prediction_rows', 1) SELECT \"check\", 'error' AS severity, n_rows FROM c WHERE n_rows > 0")
def modelling_checks(spark, sf_dir):
    """An extract without a validation split, with leaks and lost texts, and one model whose rows are short."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject_id"), F.when(F.pmod("doc_id", F.lit(2)) == 0, "test").otherwise("train").alias("split"), F.when(F.pmod("doc_id", F.lit(50)) != 7, F.col("text")).alias("report_text"), F.lit(1).alias("y"))
    p = d.where("split = 'test' and pmod(doc_id, 10) <> 0").select("split", F.lit("t").alias("task"), F.lit("m").alias("model"))
    gaps = B.modelling_gaps(d, p, p, {"t": "y"}, ["m"], ("test",))
    return B.modelling_checks(d, gaps)
