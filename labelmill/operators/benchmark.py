"""Predictions against references: joins that must be complete, normalised model outputs, metrics with strata, catalogs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .labels import identical_keys
from .metrics import beside_group, calibration_bins, calibration_line, expected_threshold_metrics, ranking_metrics, ratio, soft_metrics, stratified
from .validation import failed, require

STRATA = ("silver_source", "review_priority", "flags_present")
ROLE_TABLES = {"compatibility_mirror": "compatibility", "mismatched_target_exploratory": "exploratory"}


def one_to_one(a: DataFrame, b: DataFrame, keys: list[str], what: str = "tables") -> DataFrame:
    """a with the columns of b; raises unless both have the same keys, each once."""
    bad = identical_keys(a, b, keys).groupBy("violation").count().collect()
    if bad:
        raise ValueError(f"{what}: " + ", ".join(f"{r['violation']} {r['count']}" for r in sorted(bad)))
    return a.join(b, keys)


def many_to_one(a: DataFrame, b: DataFrame, keys: list[str], agree: list[str]) -> tuple[DataFrame, DataFrame]:
    """a with b's columns where b has the key, and failed checks: rows without a match, and columns of both that differ.

    Columns of b that a has too are dropped after the comparison.
    """
    own = {c: f"_b_{c}" for c in b.columns if c in a.columns and c not in keys}
    j = a.join(b.withColumnsRenamed(own).withColumn("_there", F.lit(True)), keys, "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    checks = failed(j, {"unmatched": ~there} | {f"{c}_agrees": there & ~F.col(c).eqNullSafe(F.col(own[c])) for c in agree}, None).unionByName(failed(b, {}, {"reference_repeats": keys}))
    return j.drop("_there", *own.values()), checks


def source(reports: DataFrame, extract: DataFrame, prefix: str = "case", dataset: str = "local") -> DataFrame:
    """Reports and model extract as one table by case: same studies in both, texts present, one split per subject.

    A missing scope of impression and findings falls back to the fallback scope.
    """
    ids = {c: X.normalised_id(F.col(c).cast("string")) for c in ("subject", "study")}
    a, b = reports.withColumns(ids), extract.withColumns(ids)
    j = one_to_one(a, b, ["subject", "study"], "reports and extract")
    blank = lambda c: X.blank_to_null(F.col(c)).isNull()
    splits = j.groupBy("subject").agg(F.countDistinct("split").alias("n"))
    require(failed(j, {"report_text": blank("report_text"), "scope_fallback": blank("scope_fallback"), "split_known": ~F.col("split").isin("train", "validation", "test")}).unionByName(failed(splits, {"subject_in_several_splits": F.col("n") > 1})), "source")
    fell = blank("scope_both")
    return j.withColumns({"fallback_used": fell, "scope_both": F.when(fell, F.col("scope_fallback")).otherwise(F.col("scope_both")), "case_id": X.case_id(F.col("subject"), F.col("study"), prefix), "source_dataset": F.lit(dataset), "flags_present": X.flags_present(F.col("qa_flags"))}).drop("scope_fallback")


def named(df: DataFrame, names: dict[str, str], run_id: str) -> DataFrame:
    """df with constant columns that say which model made it, in which run."""
    return df.withColumns({k: F.lit(v) for k, v in names.items()} | {"run_id": F.lit(run_id)})


def rule_score(df: DataFrame, score: str = "silver_score") -> DataFrame:
    """The rules' own score as a model: no score counts as 0, labels are set at one half."""
    s = F.coalesce(F.col(score), F.lit(0.0))
    return df.withColumns({"prediction_score": s, "prediction_label": (s >= 0.5).cast("int")})


def class_probabilities(raw: DataFrame, manifest: DataFrame, columns: list[str], positive: str, raw_class: str, positive_class: str) -> DataFrame:
    """Scores of a model with several classes: each in [0, 1], together 1 within a thousandth; one row for each case."""
    p = [F.col(c).cast("string").try_cast("double") for c in columns]
    total = sum(p[1:], p[0])
    require(failed(raw, {f"{c}_range": ~v.between(0, 1) for c, v in zip(columns, p, strict=True)} | {"sum_of_classes": ~total.between(0.999, 1.001)}), "class probabilities")
    out = one_to_one(manifest, raw, ["case_id"], "manifest and outputs")
    return out.withColumns({"prediction_score": F.col(positive).cast("double"), "prediction_label": (F.col(raw_class) == positive_class).cast("int"), "raw_predicted_class": F.col(raw_class), "threshold": F.lit(None).cast("double")})


def thresholded(modes: dict[str, DataFrame], manifest: DataFrame, threshold: float) -> DataFrame:
    """Scores of several modes of a model under one threshold, each complete for the manifest; ``mode`` says which."""
    out = None
    for mode, raw in modes.items():
        one = one_to_one(manifest, raw, ["case_id"], f"manifest and {mode}").withColumns({"mode": F.lit(mode), "prediction_label": (F.col("prediction_score") >= threshold).cast("int"), "threshold": F.lit(threshold)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def extractor_predictions(df: DataFrame, reference: DataFrame, pattern: str = r"^s([1-9]\d*)$") -> DataFrame:
    """Document predictions (doc_id, prediction_status, label, n_entities) by study, complete for the reference.

    All must be evaluable, and the label must say whether there are entities.
    """
    study = F.nullif(F.regexp_extract("doc_id", pattern, 1), F.lit("")).try_cast("bigint")
    n, label = F.col("n_entities").cast("string").try_cast("double"), F.col("label").cast("string").try_cast("int")
    rows = df.withColumns({"study": study, "label": label})
    require(failed(rows, {"doc_id": F.col("study").isNull(), "evaluable": F.lower(F.col("prediction_status")) != "evaluable", "label_range": ~F.col("label").isin(0, 1), "entity_count": ~((n >= 0) & (n % 1 == 0)), "label_agrees": F.col("label") != (n > 0).cast("int")}, {"study_repeats": ["study"]}), "extractor predictions")
    out = one_to_one(rows, reference, ["study"], "predictions and reference")
    return out.withColumns({"prediction_label": F.col("label"), "prediction_score": F.col("label").cast("double"), "raw_predicted_class": F.col("label").cast("string"), "threshold": F.lit(0.5)})


def baseline_predictions(df: DataFrame, reference: DataFrame, trained: tuple[str, ...] = ("text",)) -> tuple[DataFrame, DataFrame]:
    """Baselines' predictions with names, role and family by model, and failed checks of the join with the reference."""
    rows, checks = many_to_one(df, reference, ["subject_id", "study_id"], ["split"])
    fitted = F.col("model").isin(*trained)
    return rows.withColumns({
        "model_name": F.concat(F.lit("silver_"), "task", F.lit("_"), "model"), "model_family": F.when(fitted, "tfidf_logistic_regression").otherwise("silver_derived_control"),
        "comparison_role": F.when(fitted, "trained_silver_baseline").otherwise("silver_derived_control"), "intended_target": F.col("task"), "threshold": F.lit(0.5), "raw_predicted_class": F.col("prediction_label").cast("string"),
    }), checks


def predictions_with_extract(p: DataFrame, extract: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be written as 10, 10.0 or '10'."""
    same = {k: X.normalised_id(F.col(k).cast("string")) for k in keys}
    return p.withColumns(same).join(extract.withColumns(same), keys)


def batch_scores(df: DataFrame, text_col: str, score: Callable[[list[str]], list[float]], batch_size: int = 256, name: str = "prediction_score") -> DataFrame:
    """df without texts and with the scores of a user's function, called on batches; it must give one for each text."""
    kept = [f for f in df.schema if f.name not in (text_col, name)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), batch_size):
                rows = part.iloc[lo : lo + batch_size]
                got = list(score(rows[text_col].fillna("").tolist()))
                if len(got) != len(rows):
                    raise ValueError(f"{len(rows)} texts gave {len(got)} scores")
                yield rows[[f.name for f in kept]].assign(**{name: got})

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def expectation_differences(observed: DataFrame, expected: DataFrame, keys: list[str], exact: list[str], score: str = "prediction_score", tolerance: float = 1e-8) -> DataFrame:
    """Rows of expected and observed that don't match: only on one side, or with fields that differ, and which."""
    b = {c: f"_o_{c}" for c in (*exact, score)}
    j = expected.select(*keys, *exact, score).withColumn("_e", F.lit(True)).join(observed.select(*keys, *(F.col(c).alias(o) for c, o in b.items())).withColumn("_o", F.lit(True)), keys, "full")
    wrong = [F.when(~F.col(c).eqNullSafe(F.col(b[c])), c) for c in exact] + [F.when(~F.coalesce(F.abs(F.col(score) - F.col(b[score])) <= tolerance, F.col(score).isNull() & F.col(b[score]).isNull()), score)]
    side = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("differs")
    return j.select(*keys, side.alias("side"), F.when(side == "differs", F.array_join(F.array_compact(F.array(*wrong)), ",")).otherwise("").alias("fields")).where("side <> 'differs' or fields <> ''")


def label_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """Rates of stored labels, with ROC AUC and average precision where both classes are there.

    df: label, prediction_label, prediction_score, threshold. Sensitivity, PPV and F1 are 0 without a denominator,
    specificity and NPV null; the threshold is told if it is the same in all rows that have one.
    """
    y, p = F.col("label") == 1, F.col("prediction_label") == 1
    n = lambda c: F.count_if(c)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), n(y).alias("positives"), F.avg(p.cast("double")).alias("predicted_positive_rate"), n(y & p).alias("tp"), n(~y & p).alias("fp"), n(~y & ~p).alias("tn"), n(y & ~p).alias("fn"),
        F.avg((F.col("prediction_score") - F.col("label")) ** 2).alias("brier"), F.when(F.countDistinct("threshold") == 1, F.max("threshold")).alias("threshold"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rates = {"prevalence": ratio(F.col("positives"), F.col("n")), "accuracy": ratio(tp + tn, F.col("n")), "sensitivity": zero(ratio(tp, tp + fn)), "specificity": ratio(tn, tn + fp), "ppv": zero(ratio(tp, tp + fp)), "npv": ratio(tn, tn + fn), "f1": zero(ratio(2 * tp, 2 * tp + fp + fn))}
    ranks = ranking_metrics(df, by, score="prediction_score")
    out = beside_group(g, ranks, by)
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    return out.withColumns(rates | {c: F.when(both, F.col(c)) for c in ("roc_auc", "average_precision")}).drop("tp", "fp", "tn", "fn")


def by_task(df: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """Each row once for each task it is meant for and has a label of: columns task and label. tasks: name to label column."""
    meant = lambda t: F.col("intended_target").isin("both", t) if "intended_target" in df.columns else F.lit(True)
    each = F.array(*(F.struct(F.lit(t).alias("task"), F.when(meant(t), F.col(c)).cast("int").alias("label")) for t, c in tasks.items()))
    return df.select("*", F.inline(each)).where("label is not null")


def benchmark(predictions: DataFrame, reference: DataFrame, tasks: dict[str, str], strata: tuple[str, ...] = STRATA) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics by task, model, split, stratum and value; the catalog of models; and failed checks of the join.

    predictions: canonical columns; reference: case_id, split, source_dataset, a label for each task and the strata. Only
    validation and test count.
    """
    joined, checks = many_to_one(predictions.drop("task", "label", *tasks.values(), *strata), reference, ["case_id"], ["split", "source_dataset"])
    rows = by_task(joined.where(F.col("split").isin("validation", "test")), tasks)
    metrics = label_metrics(stratified(rows, list(strata)), ["task", "model_name", "comparison_role", "split", "stratum", "value"])
    return metrics, catalog(predictions, reference), checks


def catalog(predictions: DataFrame, reference: DataFrame) -> DataFrame:
    """Per model: rows, cases, rows of each split, mean score, share of positives, and cases without a reference."""
    known = reference.select("case_id").distinct().withColumn("_known", F.lit(True))
    split = lambda s: F.count_if(F.col("split") == s).alias(f"{s}_rows")
    return predictions.join(known, "case_id", "left").groupBy("model_name").agg(
        *(F.min(c).alias(c) for c in ("model_family", "comparison_role", "intended_target", "text_scope")), F.count("*").alias("prediction_rows"), F.countDistinct("case_id").alias("unique_cases"), split("validation"), split("test"),
        F.avg("prediction_score").alias("mean_score"), F.avg("prediction_label").alias("positive_rate"), F.countDistinct(F.when(F.col("_known").isNull(), F.col("case_id"))).alias("cases_without_reference"),
    )


def by_role(metrics: DataFrame) -> dict[str, DataFrame]:
    """The metric tables that are published apart: primary, compatibility and exploratory."""
    role = F.coalesce(F.col("comparison_role"), F.lit(""))
    return {"primary": metrics.where(~role.isin(*ROLE_TABLES))} | {t: metrics.where(role == r) for r, t in ROLE_TABLES.items()}


def output_summary(df: DataFrame) -> DataFrame:
    """Per model: rows, cases, share of positives, mean score, rows of repeated cases, missing and impossible scores."""
    s = F.col("prediction_score")
    per = df.groupBy("model_name", "case_id").agg(F.count("*").alias("n"), F.sum("prediction_label").alias("positives"), F.sum("prediction_score").alias("total"), F.count("prediction_score").alias("scored"), F.count_if(s.isNotNull() & ~s.between(0, 1)).alias("outside"))
    return per.groupBy("model_name").agg(F.sum("n").alias("prediction_rows"), F.count("*").alias("unique_cases"), (F.sum("positives") / F.sum("n")).alias("positive_rate"), (F.sum("total") / F.sum("scored")).alias("mean_score"), F.sum(F.col("n") - 1).alias("repeated_rows"), F.sum(F.col("n") - F.col("scored")).alias("missing_scores"), F.sum("outside").alias("scores_outside"))


def modelling_gaps(extract: DataFrame, predictions: DataFrame, metrics: DataFrame, tasks: dict[str, str], models: list[str], splits: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """For each task, model and split the rows expected and found, and whether a metric row is there."""
    frame = extract.sparkSession.createDataFrame([(t, m, s) for t in tasks for m in models for s in splits], "task string, model string, split string")
    want = by_task(extract.where(F.col("split").isin(*splits)), tasks).groupBy("task", "split").agg(F.count("*").alias("expected"))
    have = predictions.groupBy("task", "model", "split").agg(F.count("*").alias("found"))
    rated = metrics.select("task", "model", "split").distinct().withColumn("has_metrics", F.lit(True))
    out = frame.join(want, ["task", "split"], "left").join(have, ["task", "model", "split"], "left").join(rated, ["task", "model", "split"], "left")
    return out.fillna(0, ["expected", "found"]).fillna(False, ["has_metrics"])


def modelling_checks(extract: DataFrame, gaps: DataFrame, subject: str = "subject_id", text: str = "report_text", splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Failed checks of modelling outputs: empty splits, subjects in several, rows without text, wrong numbers of rows."""
    per = extract.groupBy(subject).agg(F.countDistinct("split").alias("n"))
    empty = extract.agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits)).select(F.inline(F.array(*(F.struct(F.lit(f"{s}_rows").alias("check"), F.lit("error").alias("severity"), (F.col(s) == 0).cast("bigint").alias("n_rows")) for s in splits)))).where("n_rows > 0")
    text_there = failed(extract, {"missing_text": X.blank_to_null(F.col(text)).isNull()})
    return empty.unionByName(failed(per, {"subject_overlap": F.col("n") > 1})).unionByName(text_there).unionByName(failed(gaps, {"eligible_rows": F.col("expected") == 0, "prediction_rows": F.col("expected") != F.col("found"), "metric_rows": ~F.col("has_metrics")}))


def join_audit(reference: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: rows and cases of both, rows joined, and cases that only one of both has."""
    n = lambda df, name: df.groupBy("case_id").agg(F.count("*").alias(name))
    j = n(reference, "r").join(n(predictions, "p"), "case_id", "full").fillna(0, ["r", "p"])
    return j.agg(F.sum("r").alias("reference_rows"), F.sum("p").alias("prediction_rows"), F.sum(F.col("r") * F.col("p")).alias("joined_rows"), F.count_if(F.col("r") > 0).alias("reference_cases"), F.count_if(F.col("p") > 0).alias("prediction_cases"), F.count_if((F.col("r") > 0) & (F.col("p") == 0)).alias("cases_without_prediction"), F.count_if((F.col("r") == 0) & (F.col("p") > 0)).alias("cases_without_reference"))


def by_target(predictions: DataFrame, reference: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Predictions joined with the reference, once for each kind of soft target that the case has: target_type and target."""
    here = {k: c for k, c in targets.items() if c in reference.columns}
    rows = predictions.join(reference.select("case_id", *here.values()), "case_id")
    each = F.array(*(F.struct(F.lit(k).alias("target_type"), F.col(c).alias("target")) for k, c in here.items()))
    return rows.select(*predictions.columns, F.inline(each)).where("target is not null")


def soft_benchmark(predictions: DataFrame, reference: DataFrame, targets: dict[str, str], thresholds: list[float], n_bins: int = 10, strategy: str = "quantile") -> dict[str, DataFrame]:
    """Metrics, threshold metrics and calibration bins by model and kind of target, and the join's audit."""
    by = ["model_name", "target_type"]
    rows = by_target(predictions, reference, targets).withColumnRenamed("prediction_score", "score")
    means = rows.groupBy(*by).agg(F.avg("target").alias("mean_target"), F.avg("score").alias("mean_score"))
    metrics = soft_metrics(rows, by).join(calibration_line(rows, by), by).join(means, by)
    return {"metrics": metrics, "thresholds": expected_threshold_metrics(rows, by, thresholds), "calibration": calibration_bins(rows, by, n_bins, strategy), "audit": join_audit(reference, predictions)}


def prediction_summary(df: DataFrame, by: list[str], strata: list[str]) -> DataFrame:
    """n, prevalence and mean score overall and by each stratum."""
    return stratified(df, strata).groupBy(*by, "stratum", "value").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("prevalence"), F.avg("score").alias("mean_score"))


def secondary_labels(mean: Column, prefix: str) -> dict[str, Column]:
    """Binary readings of a mean probability: at one half, at two thirds, and whether it is uncertain; null stays null."""
    return {f"{prefix}_ge_050": mean >= 0.50, f"{prefix}_ge_067": mean >= 0.67, f"{prefix}_uncertain": (mean >= 0.33) & (mean <= 0.67)}
