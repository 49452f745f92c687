"""Queries of a rating study: completion, summaries, coverage, reliability and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import resampling as R
from ..operators import validation as V
from .registry import _rounded, query
from .tables import RATINGS, ratings

RATERS = ["R0", "R1", "R2"]
_STATE = "CASE (case_id * 7 + {0}) % 11 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 2 END"
WIDE = f"{RATINGS}, wide AS (SELECT case_id, rater, avg(value) FILTER (task = 'image') AS image_rating, avg(value) FILTER (task = 'report') AS report_rating, CASE WHEN avg(value) FILTER (task = 'image') IS NOT NULL THEN {_STATE.format(1)} END AS image_complete, CASE WHEN avg(value) FILTER (task = 'report') IS NOT NULL THEN {_STATE.format(5)} END AS report_complete FROM r GROUP BY case_id, rater)"
LONG = f"{WIDE}, lg AS (SELECT case_id, rater, 'image' AS task, image_rating AS value FROM wide WHERE image_complete = 2 UNION ALL SELECT case_id, rater, 'report', report_rating FROM wide WHERE report_complete = 2)"
_OF = lambda t: f"count(*) FILTER (task = '{t}') AS {t}_n, avg(value) FILTER (task = '{t}') AS {t}_mean, stddev_samp(value) FILTER (task = '{t}') AS {t}_sd, min(value) FILTER (task = '{t}') AS {t}_low, max(value) FILTER (task = '{t}') AS {t}_high"
CASES = f"{LONG}, cs0 AS (SELECT case_id, {_OF('image')}, {_OF('report')} FROM lg GROUP BY 1), cs AS (SELECT c.case_id, cs0.* EXCLUDE (case_id) REPLACE (coalesce(image_n, 0) AS image_n, coalesce(report_n, 0) AS report_n), image_high - image_low AS image_range, report_high - report_low AS report_range, report_mean - image_mean AS difference, abs(report_mean - image_mean) AS absolute_difference FROM (SELECT DISTINCT case_id FROM wide) c LEFT JOIN cs0 USING (case_id))"


def wide(spark, sf_dir):
    """Ratings with a column for each task, and states of completion dealt by case."""
    w = ratings(spark, sf_dir).groupBy("case_id", "rater").pivot("task", ["image", "report"]).agg(F.avg("value"))
    state = lambda k: F.expr(f"CASE pmod(case_id * 7 + {k}, 11) WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 2 END")
    return w.select("case_id", "rater", F.col("image").alias("image_rating"), F.col("report").alias("report_rating"), F.when(F.col("image").isNotNull(), state(1)).alias("image_complete"), F.when(F.col("report").isNotNull(), state(5)).alias("report_complete"))


def _long(spark, sf_dir):
    return A.task_rows(wide(spark, sf_dir), RATERS)[0]


def _cases(spark, sf_dir):
    w = wide(spark, sf_dir)
    return A.case_summary(A.task_rows(w, RATERS)[0], w)


@query(f"WITH {LONG} SELECT * FROM lg")
def completed_ratings(spark, sf_dir):
    return _long(spark, sf_dir)


_WHY = "CASE WHEN {0} IS NULL THEN 'missing_completion_status' WHEN {0} = 0 THEN 'instrument_incomplete' ELSE 'instrument_unverified' END"


@query(f"""WITH {WIDE}, x AS (SELECT case_id, rater, 'image' AS task, coalesce(image_complete, -1) AS completion, {_WHY.format('image_complete')} AS reason FROM wide WHERE image_complete IS DISTINCT FROM 2 UNION ALL SELECT case_id, rater, 'report', coalesce(report_complete, -1), {_WHY.format('report_complete')} FROM wide WHERE report_complete IS DISTINCT FROM 2
UNION ALL SELECT c.case_id, v.rater, 'both', -1, 'case_absent_from_rater_export' FROM (SELECT DISTINCT case_id FROM wide) c, (VALUES ('R0'), ('R1'), ('R2')) v(rater) WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.case_id = c.case_id AND w.rater = v.rater)) SELECT * FROM x""")
def excluded_ratings(spark, sf_dir):
    return A.task_rows(wide(spark, sf_dir), RATERS)[1].fillna(-1, ["completion"])


@query(f"WITH {CASES} SELECT case_id, image_n, report_n, {', '.join(f'round({t}_{c}, 6) AS {t}_{c}' for t in ('image', 'report') for c in ('mean', 'sd', 'low', 'high', 'range'))}, round(difference, 6) AS difference, round(absolute_difference, 6) AS absolute_difference FROM cs")
def case_summary(spark, sf_dir):
    return _rounded(_cases(spark, sf_dir))


@query(f"WITH {LONG}, g AS (SELECT task, case_id, stddev_pop(value) AS sd, max(value) - min(value) AS rg FROM lg GROUP BY ALL), a AS (SELECT task, count(*) AS ratings, count(DISTINCT rater) AS raters, avg(value) AS mean, stddev_pop(value) AS sd FROM lg GROUP BY 1), b AS (SELECT task, count(*) AS cases, avg(sd) AS mean_case_sd, avg(rg) AS mean_case_range, avg((rg >= 25)::INT) AS share_25, avg((rg >= 50)::INT) AS share_50 FROM g GROUP BY 1) SELECT task, ratings, raters, round(mean, 6) AS mean, round(sd, 6) AS sd, cases, round(mean_case_sd, 6) AS mean_case_sd, round(mean_case_range, 6) AS mean_case_range, round(share_25, 6) AS share_25, round(share_50, 6) AS share_50 FROM a JOIN b USING (task)")
def agreement_summary(spark, sf_dir):
    return _rounded(A.agreement_summary(_long(spark, sf_dir)))


@query(f"""WITH {CASES}, e AS (SELECT 'image' AS task, image_n AS k, image_sd AS sd, image_range AS rg FROM cs UNION ALL SELECT 'report', report_n, report_sd, report_range FROM cs),
g AS (SELECT task, count(*) FILTER (k > 0) AS rated_cases, count(*) FILTER (k >= 2) AS spread_cases, count(*) FILTER (k = 3) AS complete_cases, count(*) FILTER (k < 3) AS incomplete_cases, avg((rg >= 25)::INT) FILTER (k >= 2) AS share_25, avg((rg >= 50)::INT) FILTER (k >= 2) AS share_50, quantile_cont(sd, 0.5) FILTER (k >= 2) AS median_sd, quantile_cont(rg, 0.5) FILTER (k >= 2) AS median_range FROM e GROUP BY 1),
f AS (SELECT *, count(*) OVER (PARTITION BY task, case_id) AS k FROM lg QUALIFY k = 3), m AS (SELECT *, avg(value) OVER (PARTITION BY task, case_id) AS mc, avg(value) OVER (PARTITION BY task, rater) AS mr, avg(value) OVER (PARTITION BY task) AS m FROM f),
i AS (SELECT task, count(DISTINCT case_id) AS n, sum((mc - m) ** 2) / (count(DISTINCT case_id) - 1) AS msc, sum((mr - m) ** 2) / 2 AS msr, sum((value - mc - mr + m) ** 2) / ((count(DISTINCT case_id) - 1) * 2) AS mse FROM m GROUP BY task)
SELECT g.task, rated_cases, spread_cases, complete_cases, incomplete_cases, round(share_25, 6) AS share_25, round(share_50, 6) AS share_50, round(median_sd, 6) AS median_sd, round(median_range, 6) AS median_range, round((msc - mse) / (msc + 2 * mse + 3 * (msr - mse) / n), 6) AS icc_single, round((msc - mse) / (msc + (msr - mse) / n), 6) AS icc_mean, 'estimated' AS status FROM g JOIN i USING (task)""")
def interrater_agreement(spark, sf_dir):
    w = wide(spark, sf_dir)
    r = A.task_rows(w, RATERS)[0]
    return _rounded(A.interrater(r, A.case_summary(r, w), 3)).drop("single_low", "single_high", "mean_low", "mean_high")


@query(f"WITH {WIDE}, n AS (SELECT count(DISTINCT case_id) AS c FROM wide) SELECT rater, count(*) AS rows, {', '.join(f'count(*) FILTER ({t}_complete = 2) AS {t}_complete, count(*) FILTER ({t}_complete = 0) AS {t}_state_0, count(*) FILTER ({t}_complete = 1) AS {t}_state_1, count(*) FILTER ({t}_complete IS NULL) AS {t}_state_missing' for t in ('image', 'report'))}, any_value(c) - count(*) AS absent FROM wide, n GROUP BY rater")
def rater_coverage(spark, sf_dir):
    return A.coverage(wide(spark, sf_dir), RATERS)


@query(f"""WITH {LONG}, p AS (SELECT case_id, count(DISTINCT rater) AS k, count(*) AS n FROM wide GROUP BY 1), t AS (SELECT case_id, count(*) FILTER (task = 'image') AS i, count(*) FILTER (task = 'report') AS r FROM lg GROUP BY 1), g AS (SELECT k, n, coalesce(i, 0) AS i, coalesce(r, 0) AS r FROM p LEFT JOIN t USING (case_id)), s AS (SELECT 3::BIGINT AS configured_raters, sum(n)::BIGINT AS case_rater_rows, count(*) AS unique_cases, count(*) FILTER (k = 3) AS cases_of_all_raters, count(*) FILTER (k < 3) AS cases_lacking_raters, sum(i)::BIGINT AS completed_image, sum(r)::BIGINT AS completed_report, count(*) FILTER (i = 3) AS complete_image_cases, count(*) FILTER (r = 3) AS complete_report_cases, count(*) FILTER (i = 3 AND r = 3) AS complete_cases FROM g),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME "check" VALUE value) SELECT "check", CASE WHEN "check" = 'cases_lacking_raters' AND value > 0 THEN 'warn' ELSE 'pass' END AS status, value FROM u
UNION ALL SELECT 'record_id_one_to_one', 'warn', 0""")
def input_checks_of_ratings(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("record_id", F.expr("case_id div 2"))
    return A.input_qa(w, A.task_rows(w, RATERS)[0], RATERS, ["record_id"])


@query(f"""WITH {CASES}, d AS (SELECT image_mean AS a, report_mean AS b, report_mean - image_mean AS d FROM cs WHERE image_mean IS NOT NULL AND report_mean IS NOT NULL), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d),
g AS (SELECT count(*) AS n, avg(d) AS mean_difference, stddev_samp(d) AS sd, avg(abs(d)) AS mae, sqrt(avg(d * d)) AS rmse, corr(a, b) AS pearson, corr(ra, rb) AS spearman, avg(d) - 1.96 * stddev_samp(d) AS lower, avg(d) + 1.96 * stddev_samp(d) AS upper FROM k),
u AS (UNPIVOT g ON mean_difference, sd, mae, rmse, pearson, spearman, lower, upper INTO NAME metric VALUE estimate) SELECT n, metric, round(estimate, 6) AS estimate, CASE WHEN metric IN ('pearson', 'spearman') THEN 'correlation' ELSE 'percentage_points' END AS unit, 'estimated' AS status FROM u""")
def task_alignment(spark, sf_dir):
    """Mean ratings of a case in both tasks against each other, a row for each metric."""
    c = _cases(spark, sf_dir)
    rows = c.select("case_id", F.col("image_mean").alias("value"), F.lit("image").alias("task")).unionByName(c.select("case_id", F.col("report_mean").alias("value"), F.lit("report").alias("task")))
    return _rounded(A.long_alignment(A.alignment(rows, "image", "report", [])))


@query()
def task_alignment_intervals(spark, sf_dir):
    """Bootstrap intervals of the alignment; draws are random, so SQL has no counterpart."""
    return R.alignment_intervals(_cases(spark, sf_dir).select("case_id", F.col("image_mean").alias("a"), F.col("report_mean").alias("b")))


@query(f"""WITH {CASES}, e AS (SELECT case_id, image_mean, report_mean, unnest(['largest_image_range', 'largest_report_range', 'largest_difference']) AS flag, unnest([image_range, report_range, absolute_difference]) AS size FROM cs), t AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY size DESC, case_id) AS place FROM e WHERE size IS NOT NULL QUALIFY place <= 10),
s AS (SELECT case_id, string_agg(rater || '=' || value::BIGINT::VARCHAR, ';' ORDER BY rater) FILTER (task = 'image') AS image_ratings, string_agg(rater || '=' || value::BIGINT::VARCHAR, ';' ORDER BY rater) FILTER (task = 'report') AS report_ratings FROM lg GROUP BY 1)
SELECT case_id, round(image_mean, 6) AS image_mean, round(report_mean, 6) AS report_mean, flag, round(size, 6) AS size, place::INT AS place, coalesce(image_ratings, '') AS image_ratings, coalesce(report_ratings, '') AS report_ratings FROM t LEFT JOIN s USING (case_id)""")
def disagreement_review(spark, sf_dir):
    w = wide(spark, sf_dir)
    r = A.task_rows(w, RATERS)[0]
    return _rounded(A.disagreement_review(r, A.case_summary(r, w)))


@query(f"WITH {WIDE}, b AS (SELECT case_id, CASE WHEN case_id % 50 = 3 THEN 'R9' ELSE rater END AS rater, CASE WHEN case_id % 40 = 7 THEN 130 ELSE image_rating END AS image_rating, image_complete, report_rating, CASE WHEN case_id % 60 = 9 THEN 5 ELSE report_complete END AS report_complete FROM wide UNION ALL SELECT case_id, rater, image_rating, image_complete, report_rating, report_complete FROM wide WHERE case_id % 90 = 11), d AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM b GROUP BY case_id, rater HAVING count(*) > 1)), c AS (SELECT 'rater_known' AS \"check\", count(*) FILTER (rater NOT IN ('R0', 'R1', 'R2')) AS n_rows FROM b UNION ALL SELECT 'image_rating', count(*) FILTER (image_complete = 2 AND NOT coalesce(image_rating BETWEEN 0 AND 100, FALSE)) FROM b UNION ALL SELECT 'report_completion', count(*) FILTER (report_complete NOT IN (0, 1, 2)) FROM b UNION ALL SELECT 'duplicate_case_rater', coalesce(n, 0)::BIGINT FROM d) SELECT \"check\", 'error' AS severity, n_rows FROM c WHERE n_rows > 0")
def wide_rating_checks(spark, sf_dir):
    """A wide table with planted faults."""
    w = wide(spark, sf_dir).select("case_id", "rater", "image_rating", "image_complete", "report_rating", "report_complete")
    k = lambda n, v: F.pmod("case_id", F.lit(n)) == v
    bad = w.withColumns({"rater": F.when(k(50, 3), "R9").otherwise(F.col("rater")), "image_rating": F.when(k(40, 7), 130).otherwise(F.col("image_rating")), "report_complete": F.when(k(60, 9), 5).otherwise(F.col("report_complete"))})
    return V.wide_ratings(bad.unionByName(w.where(k(90, 11))), RATERS)
