"""Classification, soft-label and calibration metrics as grouped aggregates.

Every function takes a frame with a row per prediction and names of grouping columns, and gives a row
per group; scores are grouped before any window, so one window row stands for a distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import logit

D = "double"
#: Distinct values of a group that one task sums up, in ranges.
RANGES = 64


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast(D), b.cast(D))


def threshold_metrics(df: DataFrame, by: list[str], label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Counts and rates at a threshold. Precision, recall and F1 are 0 without a denominator, specificity is null."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y).alias("positives"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"), F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(ratio(F.col("tp"), F.col("tp") + F.col("fp"))), zero(ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.select(
        *by, "n", "positives", "tp", "fp", "tn", "fn", ratio(F.col("positives"), F.col("n")).alias("prevalence"), ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), ratio(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
        zero(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"), "brier",
    )


def running(values: DataFrame, by: list[str], value: str, sums: list[str], ranges: int = RANGES) -> DataFrame:
    """values (a row per group and value) with below_<sum>: the group's total of each sum (of counts) over smaller values.

    Values are cut into ranges at approximate quantiles; windows run inside ranges, whose last rows give their totals, and
    totals of ranges are added, so no task sees a whole group. Null values come first.
    """
    cuts = values.groupBy(*by).agg(F.percentile_approx(value, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), F.lit(1000)).alias("_cuts"))
    rows = beside_group(values, cuts, by).withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(-1))).drop("_cuts")
    rows = rows.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(F.col("_range")))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_in_{k}": F.sum(k).over(inside) for k in sums})
    totals = rows.groupBy(*by, "_range").agg(*(F.max(f"_in_{k}").alias(f"_all_{k}") for k in sums))  # where the rows are
    order = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*by, "_range", *(F.coalesce(F.sum(f"_all_{k}").over(order), F.lit(0)).alias(f"_ahead_{k}") for k in sums))
    rows = beside_group(rows, ahead, [*by, "_range"])
    return rows.withColumns({f"below_{k}": F.col(f"_ahead_{k}") + F.col(f"_in_{k}") - F.col(k) for k in sums}).drop("_range", *(f"_{p}_{k}" for p in ("ahead", "in") for k in sums))


def beside_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group, nulls as a group of their own; without by, of the one row."""
    if not by:
        return rows.join(F.broadcast(groups))  # one row
    own = {k: f"_of_{k}" for k in by}
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
    return rows.join(groups.withColumnsRenamed(own), same).drop(*own.values())


#: Approximate quantiles are off by at most one part in so many.
ACCURACY = 20_000


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles per group, between neighbours by proportion.

    Approximate quantiles, whose error is bounded, bracket each exact one. Then values are counted once: each by itself
    inside a bracket, together between brackets, of which only the least and the greatest are kept. So one window row
    stands for all values between two brackets, and about a 5 000th of a group's rows per quantile meet in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    near = lambda q, d: F.lit(min(max(q + d * 2 / ACCURACY, 0.0), 1.0))
    edges = [F.percentile_approx("_v", F.array(*(near(q, d) for q in shares.values())), F.lit(ACCURACY)).alias(k) for k, d in (("_lo", -1), ("_hi", 1))]
    rows = beside_group(rows, rows.groupBy(*by).agg(F.count("*").alias("_total"), *edges), by)
    inside = F.exists(F.arrays_zip("_lo", "_hi"), lambda e: (e["_lo"] <= F.col("_v")) & (F.col("_v") <= e["_hi"]))
    rows = rows.withColumn("_exact", inside).withColumn("_at", F.when(F.col("_exact"), F.col("_v")).otherwise(F.array_max(F.filter("_hi", lambda h: h < F.col("_v")))))
    cells = rows.groupBy(*by, "_at", "_exact").agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.first("_total").alias("_total"))
    order = Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_first(), F.desc("_exact")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_last", F.sum("_n").over(order) - 1)
    place = lambda q: F.lit(q) * (F.col("_total") - 1)
    first, last = F.col("_last") - F.col("_n") + 1, F.col("_last")
    at = lambda spot: F.max(F.when((first == spot) | F.col("_exact") & (first <= spot) & (spot <= last), F.col("_least")).when(last == spot, F.col("_most")))
    parts = {k: (at(F.floor(place(q))), at(F.ceil(place(q))), F.max(place(q) - F.floor(place(q)))) for k, q in shares.items()}
    return cells.groupBy(*by).agg(*((lo + (hi - lo) * part).alias(k) for k, (lo, hi, part) in parts.items()))


def ranking_metrics(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """ROC AUC (ties count half; null with one class) and average precision over distinct thresholds."""
    s = df.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast(D)).alias("pos"), F.sum((F.col(label) != 1).cast(D)).alias("neg"))
    s = beside_group(running(s, by, score, ["pos", "neg"]), s.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), by)
    tp, taken = F.col("p") - F.col("below_pos"), F.col("p") + F.col("n") - F.col("below_pos") - F.col("below_neg")
    p, n = F.max("p"), F.max("n")
    return s.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)), p * n).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * tp / taken), p).alias("average_precision"),
    )


def stratified(df: DataFrame, strata: list[str]) -> DataFrame:
    """Each row once for all rows and once for its value of each stratum (null is a value of its own)."""
    kinds = [F.struct(F.lit("overall").alias("stratum"), F.lit("all").alias("value"))]
    kinds += [F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata]
    return df.withColumn("k", F.explode(F.array(*kinds))).select("*", "k.stratum", "k.value").drop("k")


def soft_metrics(df: DataFrame, by: list[str], target: str = "target", score: str = "score", weight: Column | None = None) -> DataFrame:
    """Brier score, mean absolute error and log loss against a soft target; incomplete rows are left out."""
    w = weight if weight is not None else F.lit(1.0)
    t, s = F.col(target), F.col(score)
    q = F.greatest(F.least(s, F.lit(1 - 1e-6)), F.lit(1e-6))
    mean = lambda e: F.sum(w * e) / F.sum(w)
    rows = df.where(t.isNotNull() & s.isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean((s - t) ** 2).alias("brier_soft"), mean(F.abs(s - t)).alias("mae_soft"), mean(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("log_loss_soft"))


def calibration_line(df: DataFrame, by: list[str], target: str = "target", score: str = "score") -> DataFrame:
    """Slope, intercept and R2 of logit(target) on logit(score); null for fewer than two distinct scores."""
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).withColumns({"y": logit(F.col(target)), "x": logit(F.col(score))})
    enough = F.countDistinct("x") > 1
    return rows.groupBy(*by).agg(F.when(enough, F.regr_slope("y", "x")).alias("slope"), F.when(enough, F.regr_intercept("y", "x")).alias("intercept"), F.when(enough & (F.countDistinct("y") > 1), F.regr_r2("y", "x")).alias("r2"))


def calibration_bins(df: DataFrame, by: list[str], n_bins: int = 10, strategy: str = "quantile", target: str = "target", score: str = "score") -> DataFrame:
    """Count, range and means per bin. Edges are distinct quantiles or even steps; bins are closed on the right."""
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull())
    if strategy == "quantile":
        quantiles = exact_quantiles(rows, by, score, {f"q{i}": i / n_bins for i in range(n_bins + 1)})
        edges = quantiles.select(*by, F.array_distinct(F.array(*(f"q{i}" for i in range(n_bins + 1)))).alias("edges"))
        rows = beside_group(rows, edges, by)
    else:
        rows = rows.withColumn("edges", F.array(*(F.lit(i / n_bins) for i in range(n_bins + 1))))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    rows = rows.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(score))).cast("bigint"))
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean_score"), F.avg(target).alias("mean_target"), F.abs(F.avg(score) - F.avg(target)).alias("gap"))


def expected_threshold_metrics(df: DataFrame, by: list[str], thresholds: list[float], target: str = "target", score: str = "score") -> DataFrame:
    """Expected confusion counts under soft labels for each threshold."""
    rows = df.where(F.col(target).isNotNull() & F.col(score).isNotNull()).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    hit, t = F.col(score) >= F.col("threshold"), F.col(target)
    g = rows.groupBy(*by, "threshold").agg(
        F.count("*").alias("n"), F.sum(F.when(hit, t).otherwise(0.0)).alias("tp"), F.sum(F.when(hit, 1 - t).otherwise(0.0)).alias("fp"),
        F.sum(F.when(~hit, t).otherwise(0.0)).alias("fn"), F.sum(F.when(~hit, 1 - t).otherwise(0.0)).alias("tn"), F.avg(hit.cast(D)).alias("alert_rate"),
    )
    return g.withColumns({"sensitivity": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "specificity": ratio(F.col("tn"), F.col("tn") + F.col("fp")), "ppv": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "npv": ratio(F.col("tn"), F.col("tn") + F.col("fn"))})


def alert_burden(df: DataFrame, by: list[str], thresholds: list[float], time: str = "time", score: str = "score") -> DataFrame:
    """Evaluated cases, alerts, and alerts per case and per 100 cases, per week (from Monday) and threshold."""
    rows = df.where(F.col(time).isNotNull() & F.col(score).isNotNull()).withColumns({"threshold": F.explode(F.array(*map(F.lit, thresholds))), "week": F.date_trunc("week", time).cast("date")})
    return rows.groupBy(*by, "threshold", "week").agg(F.count("*").alias("evaluated"), F.count_if(F.col(score) >= F.col("threshold")).alias("alerts"), F.avg((F.col(score) >= F.col("threshold")).cast(D)).alias("alert_rate"), (100 * F.avg((F.col(score) >= F.col("threshold")).cast(D))).alias("alerts_per_100"))


def timing_summary(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Count, mean and quartiles of the hours between pairs of timestamps."""
    micros = lambda c: F.unix_micros(F.col(c).try_cast("timestamp"))  # noqa: E731  a malformed time is null
    hours = [F.struct(F.lit(k).alias("interval"), ((micros(b) - micros(a)) / 3.6e9).alias("hours")) for k, (a, b) in pairs.items()]
    rows = df.select(F.inline(F.array(*hours))).where("hours is not null")
    quartiles = exact_quantiles(rows, ["interval"], "hours", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return rows.groupBy("interval").agg(F.count("*").alias("n"), F.avg("hours").alias("mean")).join(quartiles, "interval")
