"""Planning of an annotation study from a pilot's ratings. Long frames: case_id, rater, task, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agreement import case_reference

Z95 = 1.959963984540054


def pilot_rates(r: DataFrame, raters: int, cut: float = 25) -> DataFrame:
    """Per task the shares of ratings and cases completed, and of cases rated at least twice whose range reaches cut."""
    cases = F.broadcast(r.agg(F.countDistinct("case_id").alias("unique_cases")))  # one row
    spread = case_reference(r)
    several = F.col("n") >= 2
    g = spread.groupBy("task").agg(
        F.sum("n").alias("completed_ratings"),
        F.count_if(F.col("n") == raters).alias("complete_cases"),
        (F.count_if(several & (F.col("range") >= cut)) / F.nullif(F.count_if(several), F.lit(0))).alias("disagreement_rate"),
    )
    rate = lambda c, n: F.col(c) / (F.col("unique_cases") * n)
    return g.join(cases).withColumns({"rating_completion_rate": rate("completed_ratings", raters), "case_completion_rate": rate("complete_cases", 1)})


def cases_for_width(p: Column, width: Column, z: float = Z95) -> Column:
    """The least number of cases (2 or more) whose Wilson interval for share p is at most width to either side.

    Squared, the condition is a quadratic in the number with one positive root, as width is below one half.
    """
    h2, z2 = width * width, F.lit(z * z)
    b, c = 2 * h2 * z2 - z2 * p * (1 - p), z2 * z2 * (h2 - 0.25)
    root = (-b + F.sqrt(b * b - 4 * h2 * c)) / (2 * h2)
    return F.greatest(F.ceil(root - 1e-9), F.lit(2)).cast("bigint")


def _each(df: DataFrame, **grids: list[float]) -> DataFrame:
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return df


def precision_grid(pilot: DataFrame, prevalences: list[float], performances: list[float], widths: list[float]) -> DataFrame:
    """Per task and scenario the cases needed for sensitivity and specificity within a width, and how many to invite.

    Tasks without complete cases give no scenarios.
    """
    g = _each(pilot.where("case_completion_rate > 0"), prevalence=prevalences, performance=performances, width=widths)
    g = g.withColumn("positive_cases", cases_for_width(F.col("performance"), F.col("width")))
    need = F.greatest(F.ceil(F.col("positive_cases") / F.col("prevalence")), F.ceil(F.col("positive_cases") / (1 - F.col("prevalence"))))
    g = g.withColumn("complete_needed", need).withColumn("invited", F.ceil(F.col("complete_needed") / F.col("case_completion_rate")))
    name = F.format_string("prev_%.2f_perf_%.2f_hw_%.2f", "prevalence", "performance", "width")
    return g.select("task", name.alias("scenario"), "prevalence", "performance", "width", "positive_cases", "complete_needed", "invited", "case_completion_rate", "disagreement_rate")


def workload(scenarios: DataFrame, raters: int, overlap: float, minutes: dict[str, float | None]) -> DataFrame:
    """Per scenario and review design the ratings and hours of each task, and of both where both are planned.

    scenarios: task, scenario, complete_needed, invited, disagreement_rate. Hours are null where a task has no minutes.
    """
    n = F.col("invited")
    designs = {
        "all_raters": raters * n,
        "one_rater_and_overlap": n + (raters - 1) * F.ceil(n * overlap),
        "two_raters_and_third_on_disagreement": 2 * n + F.ceil(n * F.col("disagreement_rate")),
    }
    rows = scenarios.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("design"), v.cast("bigint").alias("ratings")) for k, v in designs.items()))))
    per = F.create_map(*(F.lit(x) for t, m in minutes.items() for x in (t, None if m is None else float(m)))).cast("map<string,double>")
    rows = rows.withColumn("hours", F.col("ratings") * per[F.col("task")] / 60)
    both = rows.groupBy("scenario", "design").agg(
        F.countDistinct("task").alias("tasks"),
        F.max("complete_needed").alias("complete_needed"),
        F.max("invited").alias("invited"),
        F.sum("ratings").alias("ratings"),
        F.when(F.count("hours") == F.count("*"), F.sum("hours")).alias("hours"),
    )
    both = both.where(F.col("tasks") == len(minutes)).withColumn("task", F.lit("both"))
    columns = ["task", "scenario", "design", "complete_needed", "invited", "ratings", "hours"]
    return rows.select(*columns).unionByName(both.select(*columns))
