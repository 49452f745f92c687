"""Queries of study planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning as P
from .registry import _rounded, query
from .tables import RATINGS, ratings

PREVALENCES, PERFORMANCES, WIDTHS = [0.1, 0.25, 0.5], [0.8, 0.9], [0.05, 0.1]
MINUTES = {"image": 2.0, "report": 1.5}

_PILOT = f"""{RATINGS}, c AS (SELECT task, case_id, count(*) AS n, max(value) - min(value) AS range FROM r WHERE value IS NOT NULL GROUP BY ALL), u AS (SELECT count(DISTINCT case_id) AS unique_cases FROM r),
g AS (SELECT task, unique_cases, sum(n)::BIGINT AS completed_ratings, count(*) FILTER (n = 3) AS complete_cases, count(*) FILTER (n >= 2 AND range >= 25) / nullif(count(*) FILTER (n >= 2), 0) AS disagreement_rate FROM c, u GROUP BY ALL),
pilot AS (SELECT *, completed_ratings / (unique_cases * 3) AS rating_completion_rate, complete_cases / unique_cases AS case_completion_rate FROM g)"""
_VALUES = lambda v: ", ".join(f"({x}::DOUBLE)" for x in v)
_Z2 = "1.959963984540054::DOUBLE * 1.959963984540054"
_GRID = f"""{_PILOT}, w AS (SELECT performance, width, min(k) AS positive_cases FROM (VALUES {_VALUES(PERFORMANCES)}) a(performance), (VALUES {_VALUES(WIDTHS)}) b(width), range(2, 2000) t(k)
WHERE 1.959963984540054::DOUBLE / (1 + {_Z2} / k) * sqrt(performance * (1 - performance) / k + {_Z2} / (4.0::DOUBLE * k * k)) <= width GROUP BY ALL),
n AS (SELECT task, prevalence, performance, width, positive_cases, greatest(ceil(positive_cases / prevalence), ceil(positive_cases / (1 - prevalence)))::BIGINT AS complete_needed, case_completion_rate, disagreement_rate FROM pilot, w, (VALUES {_VALUES(PREVALENCES)}) p(prevalence) WHERE case_completion_rate > 0),
s AS (SELECT task, printf('prev_%.2f_perf_%.2f_hw_%.2f', prevalence, performance, width) AS scenario, positive_cases, complete_needed, ceil(complete_needed / case_completion_rate)::BIGINT AS invited, disagreement_rate FROM n)"""


def _pilot(spark, sf_dir):
    return P.pilot_rates(ratings(spark, sf_dir), 3)


def _grid(spark, sf_dir):
    return P.precision_grid(_pilot(spark, sf_dir), PREVALENCES, PERFORMANCES, WIDTHS)


@query(f"WITH {_PILOT} SELECT task, unique_cases, completed_ratings, complete_cases, round(disagreement_rate, 6) AS disagreement_rate, round(rating_completion_rate, 6) AS rating_completion_rate, round(case_completion_rate, 6) AS case_completion_rate FROM pilot")
def pilot_rates(spark, sf_dir):
    return _rounded(_pilot(spark, sf_dir))


@query(f"WITH {_GRID} SELECT task, scenario, positive_cases, complete_needed, invited FROM s")
def precision_grid(spark, sf_dir):
    return _grid(spark, sf_dir).select("task", "scenario", "positive_cases", "complete_needed", "invited")


@query(f"""WITH {_GRID}, d AS (SELECT s.*, x.design, CASE x.design WHEN 'all_raters' THEN 3 * invited WHEN 'one_rater_and_overlap' THEN invited + 2 * ceil(invited * 0.2::DOUBLE)::BIGINT ELSE 2 * invited + ceil(invited * disagreement_rate)::BIGINT END AS ratings
FROM s, (VALUES ('all_raters'), ('one_rater_and_overlap'), ('two_raters_and_third_on_disagreement')) x(design)), h AS (SELECT *, ratings * CASE task WHEN 'image' THEN 2.0 ELSE 1.5 END / 60 AS hours FROM d)
SELECT task, scenario, design, complete_needed, invited, ratings, round(hours::DOUBLE, 6) AS hours FROM h
UNION ALL SELECT 'both', scenario, design, max(complete_needed), max(invited), sum(ratings)::BIGINT, round(sum(hours)::DOUBLE, 6) FROM h GROUP BY scenario, design HAVING count(DISTINCT task) = 2""")
def workload_scenarios(spark, sf_dir):
    return _rounded(P.workload(_grid(spark, sf_dir), 3, 0.2, MINUTES))
