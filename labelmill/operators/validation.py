"""Checks of tables: each gives one row per failed check (check, severity, n_rows), all counted in one pass.

``require`` raises on errors; a normaliser returns its table together with its checks, so that nothing runs until
someone asks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CHECKS = "check string, severity string, n_rows bigint"


def failed(df: DataFrame, errors: dict[str, Column], unique: dict[str, list[str]] | None = None, warnings: dict[str, Column] | None = None) -> DataFrame:
    """The checks that rows fail. errors and warnings: what is true of a bad row (null counts as bad).

    unique: names of checks with the columns whose values must not repeat; all rows that share them are counted. One
    pass and one exchange for any number of checks: a row gives an entry for each check it fails and each set of keys.
    """
    kinds = {k: ("error", c) for k, c in errors.items()} | {k: ("warning", c) for k, c in (warnings or {}).items()}
    none = F.lit(None).cast("string")
    entry = lambda name, key: F.struct(F.lit(name).alias("check"), key.alias("key"))
    found = [F.when(F.coalesce(c, F.lit(True)), entry(k, none)) for k, (_, c) in kinds.items()]
    found += [entry(k, F.md5(F.to_json(F.struct(*(F.col(c) for c in keys))))) for k, keys in (unique or {}).items()]
    per = df.select(F.inline(F.array_compact(F.array(*found)))).groupBy("check", "key").agg(F.count("*").alias("n"))
    severity = F.when(F.col("check").isin([k for k, (s, _) in kinds.items() if s == "warning"]), "warning").otherwise("error")
    return per.where("key is null or n > 1").groupBy("check").agg(F.sum("n").alias("n_rows")).select("check", severity.alias("severity"), "n_rows")


def require(checks: DataFrame, what: str = "table") -> None:
    bad = checks.where("severity = 'error'").orderBy("check").limit(20).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(f"{r['check']}: {r['n_rows']} rows" for r in bad))


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame | None:
    """A failed check where columns are absent; None where all are there. Costs no job."""
    absent = [c for c in required if c not in df.columns]
    if not absent:
        return None
    return df.sparkSession.createDataFrame([(f"required_columns: {', '.join(absent)}", "error", 0)], CHECKS)


# Three rules of which column names may hold texts or paths.
UNSAFE = {
    "annotation": r"(?i)text|(_path|_file|_uri)$|^(findings|impression|reviewer_notes|image_url)$",
    "benchmark": r"(?i)text|(_path|_file|_uri)$|^(findings|impression|image_url)$",
    "comparator": r"(?i)^(?!text_scope$).*(_text|_path|_file)$|^target_text_.*$",
}


def unsafe_columns(df: DataFrame, rule: str = "benchmark") -> list[str]:
    return [c for c in df.columns if re.search(UNSAFE[rule], c)]


def without_unsafe(df: DataFrame, rule: str = "benchmark") -> DataFrame:
    return df.drop(*unsafe_columns(df, rule))


def assert_safe(df: DataFrame, rule: str = "benchmark") -> None:
    if bad := unsafe_columns(df, rule):
        raise ValueError(f"columns that may hold texts or paths: {bad}")


def _blank(name: str) -> Column:
    return X.blank_to_null(F.col(name)).isNull()


def review_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed reviews without texts, and failed checks.

    df: subject_id, study_id, probability_0_100, reviewer_id, reviewer_notes. A review is completed if it has a number, a
    reviewer or notes; then it needs a probability of 0 to 100 and a reviewer, once for each study and reviewer.
    """
    absent = missing_columns(df, ["subject_id", "study_id", "probability_0_100", "reviewer_id", "reviewer_notes"])
    if absent is not None:
        return df.limit(0), absent
    p = F.col("probability_0_100").cast("string").try_cast("double")
    done = p.isNotNull() | ~_blank("reviewer_id") | ~_blank("reviewer_notes")
    rows = df.where(done).withColumn("probability_0_100", p)
    checks = failed(df, {"ids_present": F.col("subject_id").isNull() | F.col("study_id").isNull()}).unionByName(failed(rows, {"probability_range": ~F.col("probability_0_100").between(0, 100), "reviewer_id": _blank("reviewer_id")}, {"duplicate_reviewer_study": ["subject_id", "study_id", "reviewer_id"]}))
    return without_unsafe(rows, "annotation").withColumn("review_completed", F.lit(True)), checks


# What a rating may say about itself.
DONE = ("", "complete", "completed")
STATUSES = (*DONE, "incomplete", "skipped")
TASKS = ("image_only", "report_only")


def rating_rows(df: DataFrame, done: tuple[str, ...] = DONE, statuses: tuple[str, ...] = STATUSES, tasks: tuple[str, ...] = TASKS) -> tuple[DataFrame, DataFrame]:
    """Completed ratings with trimmed keys and a probability of 0 to 1, and failed checks.

    df: case_id, rater_id, review_task, probability_0_100 and, if known, review_status.
    """
    absent = missing_columns(df, ["case_id", "rater_id", "review_task", "probability_0_100"])
    if absent is not None:
        return df.limit(0), absent
    keys = ["case_id", "rater_id", "review_task"]
    status = F.lower(X.ws_trim(F.coalesce(F.col("review_status").cast("string"), F.lit("")))) if "review_status" in df.columns else F.lit("")
    rows = df.withColumn("review_status", status)
    whole = rows.where(F.col("review_status").isin(*done)).withColumns({k: X.blank_to_null(F.col(k)) for k in keys} | {"probability_0_100": F.col("probability_0_100").cast("string").try_cast("double")})
    bad = {k: F.col(k).isNull() for k in keys} | {"review_task_known": F.col("review_task").isNotNull() & ~F.col("review_task").isin(*tasks), "probability_range": ~F.col("probability_0_100").between(0, 100)}
    checks = failed(rows, {"review_status": ~F.col("review_status").isin(*statuses)}).unionByName(failed(whole, bad, {"duplicate_case_rater_task": keys}))
    none = whole.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("completed_rows").alias("check"), F.lit("warning").alias("severity"), F.lit(0).cast("bigint").alias("n_rows"))
    return without_unsafe(whole, "annotation").withColumn("probability", F.col("probability_0_100") / 100), checks.unionByName(none)


def wide_ratings(df: DataFrame, raters: list[str], tasks: tuple[str, ...] = ("image", "report"), complete: int = 2) -> DataFrame:
    """Failed checks of a table with a row per case and rater and two columns per task: <task>_rating and <task>_complete."""
    absent = missing_columns(df, ["case_id", "rater", *(f"{t}_{c}" for t in tasks for c in ("rating", "complete"))])
    if absent is not None:
        return absent
    errors = {"keys_present": F.col("case_id").isNull() | F.col("rater").isNull(), "rater_known": ~F.col("rater").isin(*raters)}
    for t in tasks:
        state, value = F.col(f"{t}_complete"), F.col(f"{t}_rating")
        errors[f"{t}_completion"] = state.isNotNull() & ~state.isin(0, 1, 2)
        errors[f"{t}_rating"] = F.coalesce(state == complete, F.lit(False)) & ~F.coalesce(value.between(0, 100), F.lit(False))
    checks = failed(df, errors, {"duplicate_case_rater": ["case_id", "rater"]})
    whole = df.agg(F.countDistinct(F.when(F.col("rater").isin(*raters), F.col("rater"))).alias("n"), *(F.count_if(F.col(f"{t}_complete") == complete).alias(t) for t in tasks))
    lacking = [F.struct(F.lit("every_rater").alias("check"), (F.lit(len(raters)) - F.col("n")).cast("bigint").alias("n_rows"))] + [F.struct(F.lit(f"{t}_completed_rows").alias("check"), (F.col(t) == 0).cast("bigint").alias("n_rows")) for t in tasks]
    return checks.unionByName(whole.select(F.inline(F.array(*lacking))).where("n_rows > 0").select("check", F.lit("error").alias("severity"), "n_rows"))


# The canonical prediction table and what its names may say.
CANONICAL = (
    "case_id subject_id study_id split source_dataset model_name model_family comparison_role intended_target model_source_repository "
    "model_source_commit model_artifact_version text_scope prediction_score prediction_label raw_predicted_class threshold run_id"
).split()
NAMES = "split source_dataset model_name model_family comparison_role intended_target model_source_repository model_source_commit model_artifact_version text_scope run_id".split()
SPLITS = ("train", "validation", "test")
ROLES = ("external_comparator", "legacy_teacher", "compatibility_mirror", "trained_silver_baseline", "silver_derived_control", "mismatched_target_exploratory")
TARGETS = ("strict", "sensitive", "both")


def canonical_predictions(df: DataFrame, prefix: str = "case") -> tuple[DataFrame, DataFrame]:
    """The canonical table, its columns first and extra ones after, and failed checks."""
    assert_safe(df, "comparator")
    absent = missing_columns(df, CANONICAL)
    if absent is not None:
        return df.limit(0), absent
    numbers = {c: F.col(c).cast("string").try_cast("double") for c in ("prediction_score", "prediction_label", "threshold")}
    given = X.blank_to_null(F.col("threshold")).isNotNull()
    rows = df.withColumn("_given", given).withColumns({c: X.blank_to_null(F.col(c)) for c in ("case_id", *NAMES)} | {c: X.normalised_id(F.col(c).cast("string")) for c in ("subject_id", "study_id")} | numbers)
    bad = {f"{c}_present": F.col(c).isNull() for c in ("subject_id", "study_id", "case_id", *NAMES)}
    bad |= {
        "case_id_agrees": F.col("case_id").isNotNull() & (F.col("case_id") != X.case_id(F.col("subject_id"), F.col("study_id"), prefix)),
        "split_known": ~F.col("split").isin(*SPLITS),
        "role_known": ~F.col("comparison_role").isin(*ROLES),
        "target_known": ~F.col("intended_target").isin(*TARGETS),
        "score_range": ~F.col("prediction_score").between(0, 1),
        "label_range": ~F.col("prediction_label").isin(0.0, 1.0),
        "threshold_range": F.col("_given") & ~F.coalesce(F.col("threshold").between(0, 1), F.lit(False)),
    }
    checks = failed(rows, bad, {"duplicate_case_model": ["case_id", "model_name"]})
    rows = rows.withColumn("prediction_label", F.col("prediction_label").cast("int"))
    return rows.select(*CANONICAL, *(c for c in df.columns if c not in CANONICAL)), checks


def prediction_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions for soft targets: case_id and model_name derived where absent, and failed checks."""
    assert_safe(df)
    text = lambda c: X.blank_to_null(F.col(c))
    rows = df
    if "case_id" not in df.columns and {"subject_id", "study_id"} <= set(df.columns):
        rows = rows.withColumn("case_id", F.concat(text("subject_id"), F.lit("_"), text("study_id")))
    if "model_name" not in df.columns and "model" in df.columns:
        rows = rows.withColumn("model_name", F.concat(text("task"), F.lit("__"), text("model")) if "task" in df.columns else text("model"))
    absent = missing_columns(rows, ["case_id", "model_name", "prediction_score"])
    if absent is not None:
        return rows.limit(0), absent
    rows = rows.withColumns({"case_id": text("case_id"), "model_name": text("model_name"), "prediction_score": F.col("prediction_score").cast("string").try_cast("double")})
    checks = failed(rows, {"case_id_present": F.col("case_id").isNull(), "model_name_present": F.col("model_name").isNull(), "score_range": ~F.col("prediction_score").between(0, 1)}, {"duplicate_case_model": ["case_id", "model_name"]})
    return without_unsafe(rows), checks


def reference_rows(df: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """A soft reference: unique cases and targets in [0, 1] or null, and failed checks."""
    assert_safe(df)
    here = [t for t in targets if t in df.columns]
    absent = missing_columns(df, ["case_id", *([] if here else targets[:1])])
    if absent is not None:
        return df.limit(0), absent
    parsed = {t: X.parsed_share(F.col(t)) for t in here}
    rows = df.withColumn("case_id", X.blank_to_null(F.col("case_id")))
    checks = failed(rows, {"case_id_present": F.col("case_id").isNull()} | {f"{t}_range": bad for t, (_, bad) in parsed.items()}, {"duplicate_case": ["case_id"]})
    return without_unsafe(rows.withColumns({t: v for t, (v, _) in parsed.items()})), checks


def status_coverage(predictions: DataFrame, status: DataFrame, roles: tuple[str, ...] = ("external_comparator", "mismatched_target_exploratory"), available: tuple[str, ...] = ("available",)) -> DataFrame:
    """Failed checks of external models: each has exactly one status row, which is available and of the model's one run.

    status: name, status, run_id and models (further models that the row speaks for).
    """
    runs = predictions.where(F.col("comparison_role").isin(*roles)).groupBy("model_name").agg(F.countDistinct(X.blank_to_null(F.col("run_id"))).alias("n_runs"), F.min("run_id").alias("run_id"))
    named = status.withColumn("model_name", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("models", F.array().cast("array<string>"))))))
    rows = named.groupBy("model_name").agg(F.count("*").alias("n_status"), F.min("status").alias("status"), F.min("run_id").alias("status_run"))
    found = runs.join(rows, "model_name", "left").fillna(0, ["n_status"])
    return failed(found, {"one_status": F.col("n_status") != 1, "status_available": (F.col("n_status") == 1) & ~F.coalesce(F.col("status").isin(*available), F.lit(False)), "one_run": F.col("n_runs") != 1, "run_agrees": (F.col("n_status") == 1) & ~F.col("run_id").eqNullSafe(F.col("status_run"))})


def mirror_differences(metrics: DataFrame, mirror: str, legacy: str) -> DataFrame:
    """Metric rows that only the mirror or only the legacy model has; the mirror must reproduce it exactly."""
    columns = [c for c in metrics.columns if c not in ("model_name", "comparison_role")]
    a, b = (metrics.where(F.col("model_name") == m).select(*columns) for m in (legacy, mirror))
    return a.exceptAll(b).withColumn("only", F.lit("legacy")).unionByName(b.exceptAll(a).withColumn("only", F.lit("mirror")))


def snapshot_ready(catalog: DataFrame, required: list[str]) -> DataFrame:
    """Failed checks before a snapshot: required models there, none twice, no cases without a reference."""
    models = F.collect_set("model_name")
    row = catalog.agg(F.size(F.array_except(F.array(*map(F.lit, required)), models)).cast("bigint").alias("required_models"), (F.count("*") - F.countDistinct("model_name")).alias("repeated_models"), F.coalesce(F.sum("cases_without_reference"), F.lit(0)).cast("bigint").alias("unreferenced_cases"))
    names = ("required_models", "repeated_models", "unreferenced_cases")
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), F.lit("error").alias("severity"), F.col(k).alias("n_rows")) for k in names)))).where("n_rows > 0")


def values_differ(df: DataFrame, column: str, allowed: list, subset: bool = True) -> DataFrame:
    """Values outside the allowed ones and, unless a subset will do, allowed ones that no row has: value, side."""
    have = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    names = df.sparkSession.createDataFrame([(v,) for v in allowed], f"value {df.schema[column].dataType.simpleString()}")
    said = lambda rows, side: rows.select(F.col("value").cast("string").alias("value"), F.lit(side).alias("side"))
    out = said(have.join(F.broadcast(names), "value", "left_anti"), "unexpected")
    return out if subset else out.unionByName(said(names.join(have.join(F.broadcast(names), "value", "left_semi"), "value", "left_anti"), "absent"))


def completed_names(df: DataFrame, name: str, expected: list[str], **defaults) -> DataFrame:
    """df with a row of defaults for each expected name that has none."""
    names = df.sparkSession.createDataFrame([(n,) for n in expected], f"{name} string").join(df.select(name), name, "left_anti")
    return df.unionByName(names.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in defaults.items()}), allowMissingColumns=True)
