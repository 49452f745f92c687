"""Ratings of cases by raters: reference values, agreement, alignment. Long frames: case_id, rater, task, value."""

from __future__ import annotations

import functools
import operator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import f_quantile
from .metrics import beside_group, exact_quantiles, running


def case_reference(r: DataFrame) -> DataFrame:
    """Per case and task: count, mean, population SD, extremes and range, with flags of disagreement."""
    g = r.where("value is not null").groupBy("case_id", "task").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    spread = F.col("high") - F.col("low")
    return g.withColumns({"range": spread, "range_25": F.coalesce(spread >= 25, F.lit(False)), "range_50": F.coalesce(spread >= 50, F.lit(False))})


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def rater_summary(r: DataFrame) -> DataFrame:
    """Per task and rater: count, mean, population and sample SD, quartiles."""
    by = ["task", "rater"]
    g = r.where("value is not null").groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd_pop"), F.stddev_samp("value").alias("sd_samp"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.join(exact_quantiles(r, by, "value", QUARTILES), by)


def pairs(r: DataFrame) -> DataFrame:
    """Two raters' values side by side, each pair once."""
    r = r.where("value is not null").select("case_id", "task", "rater", "value")
    b = r.withColumnsRenamed({"rater": "rater_b", "value": "b"})
    return r.withColumnsRenamed({"rater": "rater_a", "value": "a"}).join(b, ["case_id", "task"]).where("rater_a < rater_b")


def beside(rows: DataFrame, by: list[str], *new: Column) -> DataFrame:
    """rows with aggregates of their group, by a partial aggregation and a join: no group meets in one task."""
    return beside_group(rows, rows.groupBy(*by).agg(*new), by)


def with_ranks(rows: DataFrame, values: dict[str, str], by: list[str], times: str | None = None) -> DataFrame:
    """rows with ranks from 1 of each of values (column to name of the rank), ties averaged.

    Counts of distinct values, of all columns in one table, are summed up over ranges and joined back; times: how many rows
    each row stands for.
    """
    each = F.array(*(F.struct(F.lit(k).alias("_side"), F.col(k).cast("double").alias("_value")) for k in values))
    n = F.count("*") if times is None else F.sum(times)
    counts = rows.select(*by, *([times] if times else []), F.inline(each)).groupBy(*by, "_side", "_value").agg(n.alias("_n"))
    g = running(counts, [*by, "_side"], "_value", ["_n"]).select(*by, "_side", "_value", (F.col("below__n") + (F.col("_n") + 1) / 2.0).alias("_rank"))
    for k, name in values.items():
        own = g.where(F.col("_side") == k).select(*by, F.col("_value").alias(k), F.col("_rank").alias(name))
        rows = beside_group(rows, own, [*by, k])
    return rows


def _guarded(c: Column) -> Column:
    return F.when((F.countDistinct("a") > 1) & (F.countDistinct("b") > 1), c)


def kappa(x: Column, y: Column) -> Column:
    """Cohen's kappa of two booleans, by means; null when agreement by chance is certain."""
    f = lambda c: F.avg(c.cast("double"))
    by_chance = f(x) * f(y) + (1 - f(x)) * (1 - f(y))
    return F.when(by_chance < 1, (f(x == y) - by_chance) / (1 - by_chance))


def pairwise_agreement(r: DataFrame, cuts: tuple[float, ...] = (50, 67)) -> DataFrame:
    """Per task and pair of raters with cases in common: errors, correlations, agreement and kappa at each cut.

    Equal pairs of values are counted first; all the rest is sums over different pairs.
    """
    by = ["task", "rater_a", "rater_b"]
    p = with_ranks(pairs(r).groupBy(*by, "a", "b").agg(F.count("*").alias("k")), {"a": "ra", "b": "rb"}, by, "k")
    k, d = F.col("k"), F.col("a") - F.col("b")
    total = F.sum(k)
    mean = lambda c: F.sum(k * c) / total

    def corr(x: str, y: str) -> Column:
        mx, my = mean(F.col(x)), mean(F.col(y))
        c = (mean(F.col(x) * F.col(y)) - mx * my) / F.sqrt((mean(F.col(x) ** 2) - mx * mx) * (mean(F.col(y) ** 2) - my * my))
        return _guarded(c)

    def at(cut: float) -> tuple[Column, Column]:
        x, y = ((F.col(c) >= cut).cast("double") for c in "ab")
        same, by_chance = mean((x == y).cast("double")), mean(x) * mean(y) + (1 - mean(x)) * (1 - mean(y))
        return same.alias(f"agreement_{cut:g}"), F.when(by_chance < 1, (same - by_chance) / (1 - by_chance)).alias(f"kappa_{cut:g}")

    found = [at(c) for c in cuts]
    return p.groupBy(*by).agg(total.alias("n"), mean(F.abs(d)).alias("mae"), F.sqrt(mean(d * d)).alias("rmse"), mean(d).alias("mean_difference"), corr("a", "b").alias("pearson"), corr("ra", "rb").alias("spearman"), *(f[0] for f in found), *(f[1] for f in found))


def every_pair(agreed: DataFrame, tasks: list[str], raters: list[str]) -> DataFrame:
    """pairwise_agreement with a row for each task and pair, n 0 and nulls where no case is in common."""
    names = [(t, a, b) for t in tasks for k, a in enumerate(raters) for b in raters[k + 1 :]]
    frame = agreed.sparkSession.createDataFrame(names, "task string, rater_a string, rater_b string")
    return frame.join(agreed, ["task", "rater_a", "rater_b"], "left").fillna(0, ["n"])


def alignment(r: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """Two tasks side by side per case (and by): mean difference, SD, errors, correlations, Bland-Altman limits, agreement
    and kappa at one half. by: keys of the result."""
    wide = r.groupBy(*dict.fromkeys(["case_id", *by])).pivot("task", [first, second]).agg(F.avg("value"))
    rows = wide.select(*by, F.col(first).alias("a"), F.col(second).alias("b")).where("a is not null and b is not null").withColumn("d", F.col("b") - F.col("a"))
    rows = with_ranks(rows, {"a": "ra", "b": "rb"}, by)
    mean, sd, x, y = F.avg("d"), F.stddev_samp("d"), F.col("a") >= 50, F.col("b") >= 50
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), mean.alias("mean_difference"), sd.alias("sd"), F.avg(F.abs("d")).alias("mae"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"), _guarded(F.corr("a", "b")).alias("pearson"), _guarded(F.corr("ra", "rb")).alias("spearman"),
        (mean - 1.96 * sd).alias("lower"), (mean + 1.96 * sd).alias("upper"), F.avg((x == y).cast("double")).alias("agreement"), kappa(x, y).alias("kappa"),
    )


#: Units of the metrics of an alignment.
UNITS = {"mean_difference": "percentage_points", "sd": "percentage_points", "mae": "percentage_points", "rmse": "percentage_points", "pearson": "correlation", "spearman": "correlation", "lower": "percentage_points", "upper": "percentage_points"}


def long_alignment(estimates: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """An alignment as a row per metric: estimate, unit, n, status, and the interval if there is one."""
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("estimate"), F.lit(u).alias("unit")) for k, u in UNITS.items()))
    rows = estimates.select("n", F.inline(each)).withColumn("status", F.when(F.col("estimate").isNull(), "undefined").otherwise("estimated"))
    return rows if intervals is None else rows.join(intervals, "metric", "left").fillna(0, ["n_valid"])


def leave_one_out(r: DataFrame) -> DataFrame:
    """Each rater against the mean of the others of the same case and task."""
    w = Window.partitionBy("case_id", "task")
    others = (F.sum("value").over(w) - F.col("value")) / F.nullif(F.count("value").over(w) - 1, F.lit(0))
    rows = r.where("value is not null").withColumn("d", F.col("value") - others).where("d is not null")
    return rows.groupBy("task", "rater").agg(F.count("*").alias("n"), F.avg(F.abs("d")).alias("mae"), F.avg(F.col("d") ** 2).alias("mse"))


def missing_ratings(r: DataFrame, raters: list[str]) -> DataFrame:
    """Pairs of case and expected rater without a row."""
    every = r.select("case_id").distinct().withColumn("rater", F.explode(F.array(*map(F.lit, raters))))
    return every.join(r.select("case_id", "rater").distinct(), ["case_id", "rater"], "left_anti")


def rating_strings(r: DataFrame) -> DataFrame:
    """Per case and task all ratings by rater in one string."""
    listed = F.array_sort(F.collect_list(F.struct("rater", "value")))
    return r.where("value is not null").groupBy("case_id", "task").agg(F.array_join(F.transform(listed, lambda x: F.concat(x["rater"], F.lit("="), x["value"].cast("bigint").cast("string"))), ";").alias("ratings"))


def top_disagreements(r: DataFrame, k: int = 10) -> DataFrame:
    """Per task the k cases of greatest range, ties by case."""
    w = Window.partitionBy("task").orderBy(F.desc("range"), "case_id")
    return case_reference(r).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("task", "place", "case_id", "range")


def icc(r: DataFrame, raters: int, level: float = 0.95) -> DataFrame:
    """ICC(2,1) and ICC(2,k) per task on cases rated by all raters, from two-way sums of squares, with limits and a status."""
    rows = r.where("value is not null").groupBy("task", "case_id", "rater").agg(F.avg("value").alias("value"))
    rows = beside(rows, ["task", "case_id"], F.count("*").alias("k"), F.avg("value").alias("mc")).where(F.col("k") == raters)
    rows = beside(beside(rows, ["task", "rater"], F.avg("value").alias("mr")), ["task"], F.avg("value").alias("m"))
    g = rows.groupBy("task").agg((F.count("*") / raters).cast("bigint").alias("n"), F.sum((F.col("mc") - F.col("m")) ** 2).alias("ssc"), F.sum((F.col("mr") - F.col("m")) ** 2).alias("ssr"), F.sum((F.col("value") - F.col("mc") - F.col("mr") + F.col("m")) ** 2).alias("sse"))
    k, n = float(raters), F.col("n")
    enough = (n > 1) & (F.lit(k) > 1)
    g = g.withColumns({"msc": F.try_divide("ssc", n - 1), "msr": F.try_divide("ssr", F.lit(k - 1)), "mse": F.try_divide("sse", (n - 1) * (k - 1))})
    msc, msr, mse = (F.col(c) for c in ("msc", "msr", "mse"))
    single, mean = F.try_divide(msc - mse, msc + (k - 1) * mse + k * (msr - mse) / n), F.try_divide(msc - mse, msc + (msr - mse) / n)

    @F.pandas_udf("low double, high double")
    def limits(n: pd.Series, msc: pd.Series, msr: pd.Series, mse: pd.Series, value: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([icc_limits(*x, raters, level) for x in zip(n, msc, msr, mse, value, strict=True)], columns=["low", "high"])

    out = g.select("task", "n", F.when(enough, single).alias("icc_single"), F.when(enough, mean).alias("icc_mean"), limits("n", "msc", "msr", "mse", F.when(enough, single)).alias("l"))  # a row for each task
    up = lambda c: F.try_divide(k * c, 1 + (k - 1) * c)
    low, high = F.col("l.low"), F.col("l.high")
    status = F.when(~enough, "insufficient_balanced_cases").when(F.col("icc_single").isNull(), "undefined_for_observed_values").when(low.isNull() | high.isNull(), "estimated_ci_undefined").otherwise("estimated")
    return out.select("task", "n", "icc_single", "icc_mean", low.alias("single_low"), high.alias("single_high"), up(low).alias("mean_low"), up(high).alias("mean_high"), status.alias("status"))


def icc_limits(n: float, msc: float, msr: float, mse: float, value: float, k: int, level: float) -> tuple[float | None, float | None]:
    """Confidence limits of ICC(2,1) from mean squares of cases, raters and error, by approximate degrees of freedom."""
    if value is None or value != value or not mse > 0:
        return None, None
    f = msr / mse
    rest = n * (1 + (k - 1) * value) - k * value
    v = (n - 1) * (k - 1) * (k * value * f + rest) ** 2 / ((n - 1) * (k * value * f) ** 2 + rest**2)
    q = 1 - (1 - level) / 2
    up, down = f_quantile(q, n - 1, v), f_quantile(q, v, n - 1)
    between = k * msr + (n * k - n - k) * mse
    return n * (msc - up * mse) / (up * between + n * msc), n * (down * msc - mse) / (between + n * down * msc)


def task_rows(wide: DataFrame, raters: list[str], tasks: tuple[str, ...] = ("image", "report"), complete: int = 2) -> tuple[DataFrame, DataFrame]:
    """Completed ratings one below the other, and why the others are left out.

    wide: case_id, rater, <task>_rating, <task>_complete. Pairs of case and expected rater without a row are absent for both.
    """
    each = F.array(*(F.struct(F.lit(t).alias("task"), F.col(f"{t}_rating").cast("double").alias("value"), F.col(f"{t}_complete").cast("int").alias("completion")) for t in tasks))
    rows = wide.select("case_id", "rater", F.inline(each))
    done = F.coalesce(F.col("completion") == complete, F.lit(False))
    why = F.when(F.col("completion").isNull(), "missing_completion_status").when(F.col("completion") == 0, "instrument_incomplete").otherwise("instrument_unverified")
    left = rows.where(~done).select("case_id", "rater", "task", "completion", why.alias("reason"))
    absent = missing_ratings(wide, raters).select("case_id", "rater", F.lit("both").alias("task"), F.lit(None).cast("int").alias("completion"), F.lit("case_absent_from_rater_export").alias("reason"))
    return rows.where(done).select("case_id", "rater", "task", "value"), left.unionByName(absent)


def case_summary(r: DataFrame, cases: DataFrame, tasks: tuple[str, ...] = ("image", "report")) -> DataFrame:
    """Per case of cases: number, mean, SD, extremes and range of each task's ratings, and the difference of the means."""
    of = lambda t: F.when(F.col("task") == t, F.col("value"))
    g = r.groupBy("case_id").agg(*(f(of(t)).alias(f"{t}_{k}") for t in tasks for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("low", F.min), ("high", F.max))))
    out = cases.select("case_id").distinct().join(g, "case_id", "left").fillna(0, [f"{t}_n" for t in tasks])
    out = out.withColumns({f"{t}_range": F.col(f"{t}_high") - F.col(f"{t}_low") for t in tasks})
    return out.withColumn("difference", F.col(f"{tasks[1]}_mean") - F.col(f"{tasks[0]}_mean")).withColumn("absolute_difference", F.abs("difference"))


def agreement_summary(r: DataFrame) -> DataFrame:
    """Per task: ratings, cases, raters, mean and SD, mean SD and range of cases, shares of cases with ranges of 25 and 50."""
    cases = case_reference(r).groupBy("task").agg(F.count("*").alias("cases"), F.avg("sd").alias("mean_case_sd"), F.avg("range").alias("mean_case_range"), F.avg(F.col("range_25").cast("double")).alias("share_25"), F.avg(F.col("range_50").cast("double")).alias("share_50"))
    all_of = r.where("value is not null").groupBy("task").agg(F.count("*").alias("ratings"), F.countDistinct("rater").alias("raters"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return all_of.join(cases, "task")


def interrater(r: DataFrame, summary: DataFrame, raters: int, tasks: tuple[str, ...] = ("image", "report")) -> DataFrame:
    """Per task: cases by number of raters, medians of case SD and range where two or more rated, their shares, and ICC."""
    each = F.array(*(F.struct(F.lit(t).alias("task"), F.col(f"{t}_n").alias("n_raters"), F.col(f"{t}_sd").alias("sd"), F.col(f"{t}_range").alias("range")) for t in tasks))
    cases = summary.select("case_id", F.inline(each))
    several = F.col("n_raters") >= 2
    g = cases.groupBy("task").agg(F.count_if(F.col("n_raters") > 0).alias("rated_cases"), F.count_if(several).alias("spread_cases"), F.count_if(F.col("n_raters") == raters).alias("complete_cases"), F.count_if(F.col("n_raters") < raters).alias("incomplete_cases"), F.avg(F.when(several, (F.col("range") >= 25).cast("double"))).alias("share_25"), F.avg(F.when(several, (F.col("range") >= 50).cast("double"))).alias("share_50"))
    for c in ("sd", "range"):
        g = g.join(exact_quantiles(cases.where(several), ["task"], c, {f"median_{c}": 0.5}), "task", "left")
    return g.join(icc(r, raters).drop("n"), "task", "left").withColumn("status", F.coalesce("status", F.lit("insufficient_balanced_cases")))


def coverage(wide: DataFrame, raters: list[str], tasks: tuple[str, ...] = ("image", "report"), complete: int = 2) -> DataFrame:
    """Per expected rater: rows, cases without a row, and per task how many are complete or in which other state."""
    n = F.broadcast(wide.agg(F.countDistinct("case_id").alias("cases")))  # one row
    states = {"complete": lambda c: c == complete, "state_0": lambda c: c == 0, "state_1": lambda c: c == 1, "state_missing": lambda c: c.isNull()}
    g = wide.groupBy("rater").agg(F.count("*").alias("rows"), *(F.count_if(f(F.col(f"{t}_complete"))).alias(f"{t}_{k}") for t in tasks for k, f in states.items()))
    frame = wide.sparkSession.createDataFrame([(x,) for x in raters], "rater string")
    return frame.join(g, "rater", "left").fillna(0).join(n).withColumn("absent", F.col("cases") - F.col("rows")).drop("cases")


def input_qa(wide: DataFrame, r: DataFrame, raters: list[str], ids: list[str] | None = None, tasks: tuple[str, ...] = ("image", "report")) -> DataFrame:
    """Counts about a study's input as rows of check, status and value; for each further id whether it is one to one with cases."""
    k = len(raters)
    per = wide.groupBy("case_id").agg(F.countDistinct("rater").alias("raters"), F.count("*").alias("rows"))
    rated = r.groupBy("case_id").agg(*(F.count_if(F.col("task") == t).alias(t) for t in tasks))
    g = per.join(rated, "case_id", "left").fillna(0, list(tasks))
    full = {t: F.col(t) == k for t in tasks}
    row = g.agg(F.lit(k).cast("bigint").alias("configured_raters"), F.sum("rows").alias("case_rater_rows"), F.count("*").alias("unique_cases"), F.count_if(F.col("raters") == k).alias("cases_of_all_raters"), F.count_if(F.col("raters") < k).alias("cases_lacking_raters"), *(F.sum(t).alias(f"completed_{t}") for t in tasks), *(F.count_if(c).alias(f"complete_{t}_cases") for t, c in full.items()), F.count_if(functools.reduce(operator.and_, full.values())).alias("complete_cases"))
    status = lambda c: F.when((F.lit(c) == "cases_lacking_raters") & (F.col(c) > 0), "warn").otherwise("pass")
    out = row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), status(c).alias("status"), F.col(c).alias("value")) for c in row.columns))))
    for c in ids or []:
        pairs_of = wide.where(F.col(c).isNotNull() & F.col("case_id").isNotNull()).select("case_id", c).distinct()
        crowded = pairs_of.groupBy("case_id").count().where("count > 1").select(F.lit(1).alias("x")).unionByName(pairs_of.groupBy(c).count().where("count > 1").select(F.lit(1).alias("x"))).agg(F.count("*").alias("bad")).join(F.broadcast(pairs_of.agg(F.count("*").alias("n"))))  # one row each
        out = out.unionByName(crowded.select(F.lit(f"{c}_one_to_one").alias("check"), F.when(F.col("n") == 0, "not_available").when(F.col("bad") > 0, "warn").otherwise("pass").alias("status"), F.when(F.col("n") > 0, (F.col("bad") == 0).cast("bigint")).alias("value")))
    return out


def disagreement_review(r: DataFrame, summary: DataFrame, limit: int = 10) -> DataFrame:
    """The cases of greatest range in either task and of greatest difference between tasks, with their ratings in a string."""
    kinds = {"largest_image_range": "image_range", "largest_report_range": "report_range", "largest_difference": "absolute_difference"}
    each = F.array(*(F.struct(F.lit(k).alias("flag"), F.col(c).alias("size")) for k, c in kinds.items()))
    w = Window.partitionBy("flag").orderBy(F.desc("size"), "case_id")
    top = summary.select("case_id", "image_mean", "report_mean", F.inline(each)).where("size is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    text = rating_strings(r).groupBy("case_id").pivot("task", ["image", "report"]).agg(F.first("ratings")).withColumnsRenamed({"image": "image_ratings", "report": "report_ratings"})
    return top.join(text, "case_id", "left").fillna("", ["image_ratings", "report_ratings"])


def identified(reference: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    """A case reference with the first value (by row_no) that each identifier has for the case."""
    first = rows.groupBy("case_id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(c) for c in ids))
    return reference.join(first, "case_id", "left")
