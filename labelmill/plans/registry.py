"""All registered queries outside the training-data subpackage, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import agreement as A
from ..operators import benchmark as B
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import reports as S
from ..operators import resampling as R
from ..operators import validation as V
from .tables import PREDICTIONS, RATINGS, predictions, ratings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRAIN_SALT = "split-v1"
THRESHOLDS = [0.3, 0.5, 0.7]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("WITH b AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1) SELECT coalesce(l.doc_id, b.conv_id) AS doc_id, coalesce(quality, -9) AS quality, coalesce(last_turn, -9) AS last_turn, l.doc_id IS NOT NULL AS has_a, b.conv_id IS NOT NULL AS has_b FROM labels l FULL JOIN b ON l.doc_id = b.conv_id")
def labelers_combined(spark, sf_dir):
    """Two labelers of partly the same cases: documents' quality, and the length of the conversation of that number."""
    b = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("last_turn"))
    return L.combine_labelers(table(spark, sf_dir, "labels").select("doc_id", "quality"), b, ["doc_id"]).fillna(-9, ["quality", "last_turn"]).select("doc_id", "quality", "last_turn", "has_a", "has_b")


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber AS i, min(lower(l_returnflag) || ' ' || lower(l_linestatus)) AS t FROM lineitem GROUP BY ALL),
x AS (SELECT a.k, CASE WHEN b.t IS NULL THEN a.t ELSE a.t || ' ' || b.t END AS both_t FROM e a LEFT JOIN e b ON b.k = a.k AND b.i = a.i + 1)
SELECT k AS report, count(*) AS n_relations, bool_or(regexp_matches(both_t, 'a o')) AS returned, bool_or(regexp_matches(both_t, 'f n|f r')) AS mixed, array_to_string(list_sort(list_distinct(list(both_t)))[1:20], '|') AS examples FROM x GROUP BY k""")
def graph_features(spark, sf_dir):
    """Lines of an order as entities, each related to the next."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").cast("int").alias("entity_id"), F.concat_ws(" ", F.lower("l_returnflag"), F.lower("l_linestatus")).alias("tokens")).groupBy("report", "entity_id").agg(F.min("tokens").alias("tokens"))
    rel = e.select("report", F.col("entity_id").alias("source_id"), (F.col("entity_id") + 1).alias("target_id"), F.lit("next").alias("relation"))
    out = L.graph_features(rel, e, ["report"], {"returned": "a o", "mixed": "f n|f r"}, kind="next")
    return out.select("report", "n_relations", "returned", "mixed", F.array_join("examples", "|").alias("examples"))


_BUCKET = f"CAST(('0x' || substr(sha256(source || '-{TRAIN_SALT}'), 1, 15)) AS BIGINT) % 10000"
_SPLIT = f"CASE WHEN {_BUCKET} < 7000 THEN 'train' WHEN {_BUCKET} < 8500 THEN 'validation' ELSE 'test' END"


@query(f"SELECT doc_id, source, {_SPLIT} AS split FROM documents")
def subject_splits(spark, sf_dir):
    return L.assign_splits(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", TRAIN_SALT)


@query(f"SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT source) AS n_subjects FROM documents GROUP BY 1")
def split_summary(spark, sf_dir):
    return subject_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_subjects"))


@query(f"WITH s AS (SELECT source, CASE WHEN doc_id % 97 = 0 THEN 'test' ELSE {_SPLIT} END AS split FROM documents) SELECT source, count(DISTINCT split) AS n_splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leaks(spark, sf_dir):
    """Leakage planted in every 97th row is found."""
    d = subject_splits(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 97 == 0, "test").otherwise(F.col("split")))
    return L.leaks(d, "source")


_BIN = "CASE WHEN score < 0.1 THEN 0 WHEN score < 0.3 THEN 1 WHEN score < 0.5 THEN 2 WHEN score < 0.7 THEN 3 WHEN score < 0.9 THEN 4 ELSE 5 END"


@query(f"WITH {PREDICTIONS}, b AS (SELECT doc_id, score, {_BIN} AS score_bin FROM p WHERE model = 'm1') SELECT *, row_number() OVER (PARTITION BY score_bin ORDER BY sha256(doc_id::VARCHAR), doc_id) AS place, NULL::DOUBLE AS review_probability, NULL::VARCHAR AS reviewer_notes FROM b QUALIFY place <= 50")
def review_sample(spark, sf_dir):
    p = predictions(spark, sf_dir).where("model = 'm1'").select("doc_id", "score")
    return L.stratified_sample(p, "score", "doc_id")


@query("SELECT text_hash, n FROM (SELECT sha256(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_texts(spark, sf_dir):
    return L.duplicates(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("text_hash")), ["text_hash"])


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'pages', count(*) FROM pages")
def table_counts(spark, sf_dir):
    return _union([table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "labels", "conversations", "pages")])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@query("WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 50 = 0), m AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b FROM (SELECT doc_id, count(*) na FROM a GROUP BY 1) x FULL JOIN (SELECT doc_id, count(*) nb FROM b GROUP BY 1) y USING (doc_id)) SELECT doc_id, n_a, n_b, CASE WHEN n_a = 0 THEN 'right_only' WHEN n_b = 0 THEN 'left_only' ELSE 'repeated' END AS violation FROM m WHERE n_a <> 1 OR n_b <> 1")
def key_set_violations(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id")  # noqa: E741
    return L.identical_keys(table(spark, sf_dir, "documents").select("doc_id"), l.unionByName(l.where("doc_id % 50 = 0")), ["doc_id"])


@query("WITH a AS (SELECT l_orderkey AS k, l_returnflag AS f FROM lineitem), b AS (SELECT l_orderkey AS k, CASE WHEN l_linenumber = 2 THEN 'X' ELSE l_returnflag END AS f FROM lineitem), x AS (SELECT k, f, count(*) n FROM a GROUP BY ALL), y AS (SELECT k, f, count(*) n FROM b GROUP BY ALL) SELECT coalesce(x.k, y.k) AS k, coalesce(x.f, y.f) AS f, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b FROM x FULL JOIN y ON x.k = y.k AND x.f = y.f WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
def entity_parity(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), "l_linenumber")
    return L.multiset_difference(a, a.withColumn("f", F.when(F.col("l_linenumber") == 2, "X").otherwise(F.col("f"))), ["k", "f"])


@query("SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) - 1 AS occurrence FROM lineitem")
def occurrence_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return L.occurrence_number(d, ["l_orderkey", "l_returnflag"], ["l_linenumber"]).withColumn("occurrence", F.col("occurrence").cast("bigint"))


_RATES = "count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label <> 1 AND score >= 0.5) AS fp, count(*) FILTER (label <> 1 AND score < 0.5) AS tn, count(*) FILTER (label = 1 AND score < 0.5) AS fn, avg((score - label) ** 2) AS brier0"
_RATIOS = "n, positives, tp, fp, tn, fn, round(positives / n, 6) AS prevalence, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(brier0, 6) AS brier"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {PREDICTIONS}, e AS (SELECT model, 'overall' AS stratum, 'all' AS value, label, score FROM p UNION ALL SELECT model, 'lang', lang, label, score FROM p UNION ALL SELECT model, 'source', source, label, score FROM p), g AS (SELECT model, stratum, value, {_RATES} FROM e GROUP BY ALL) SELECT model, stratum, value, {_RATIOS} FROM g")
def stratified_metrics(spark, sf_dir):
    return _rounded(M.threshold_metrics(M.stratified(predictions(spark, sf_dir), ["lang", "source"]), ["model", "stratum", "value"]))


@query(f"WITH {PREDICTIONS}, s AS (SELECT model, score, sum((label = 1)::INT)::DOUBLE AS pos, sum((label <> 1)::INT)::DOUBLE AS neg FROM p GROUP BY ALL), w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(pos + neg) OVER (PARTITION BY model ORDER BY score DESC) AS n FROM s) SELECT model, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc, round(sum(pos * tp / n) / sum(pos), 6) AS average_precision FROM w GROUP BY model")
def ranking_metrics(spark, sf_dir):
    return _rounded(M.ranking_metrics(predictions(spark, sf_dir), ["model"]))


@query(f"WITH {PREDICTIONS} SELECT model, count(*) AS n, count(DISTINCT doc_id) AS n_cases, round(avg(score), 6) AS mean_score, round(avg((score >= 0.5)::INT), 6) AS positive_rate, count(*) FILTER (lang = 'en') AS n_en FROM p GROUP BY model")
def prediction_catalog(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return _rounded(p.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_cases"), F.avg("score").alias("mean_score"), F.avg((F.col("score") >= 0.5).cast("double")).alias("positive_rate"), F.count_if(F.col("lang") == "en").alias("n_en")))


_Q = "greatest(least(score, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)"
_T = "greatest(least(target, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)"


@query(f"WITH {PREDICTIONS} SELECT model, count(*) AS n, round(avg((score - target) ** 2), 6) AS brier_soft, round(avg(abs(score - target)), 6) AS mae_soft, round(avg(-(target * ln({_Q}) + (1 - target) * ln(1 - {_Q}))), 6) AS log_loss_soft FROM p GROUP BY model")
def soft_metrics(spark, sf_dir):
    return _rounded(M.soft_metrics(predictions(spark, sf_dir), ["model"]))


@query(f"WITH {PREDICTIONS}, x AS (SELECT model, ln({_Q} / (1 - {_Q})) AS x, ln({_T} / (1 - {_T})) AS y FROM p) SELECT model, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM x GROUP BY model")
def calibration_line(spark, sf_dir):
    return _rounded(M.calibration_line(predictions(spark, sf_dir), ["model"]))


@query(f"WITH {PREDICTIONS}, e AS (SELECT model, list_sort(list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS edges FROM p GROUP BY model), b AS (SELECT model, score, target, len(list_filter(edges[2:len(edges) - 1], lambda x: x < score)) AS bin FROM p JOIN e USING (model)) SELECT model, bin, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean_score, round(avg(target), 6) AS mean_target, round(abs(avg(score) - avg(target)), 6) AS gap FROM b GROUP BY ALL")
def calibration_bins(spark, sf_dir):
    return _rounded(M.calibration_bins(predictions(spark, sf_dir), ["model"]))


@query(f"WITH {PREDICTIONS}, b AS (SELECT model, score, target, len(list_filter([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9], lambda x: x::DOUBLE < score)) AS bin FROM p) SELECT model, bin, count(*) AS n, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean_score, round(avg(target), 6) AS mean_target, round(abs(avg(score) - avg(target)), 6) AS gap FROM b GROUP BY ALL")
def calibration_steps(spark, sf_dir):
    """Calibration in bins of even width."""
    return _rounded(M.calibration_bins(predictions(spark, sf_dir), ["model"], strategy="uniform"))


@query(f"WITH {PREDICTIONS}, t AS (SELECT * FROM p, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(threshold)), g AS (SELECT model, threshold, count(*) AS n, sum(CASE WHEN score >= threshold THEN target ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold THEN 1 - target ELSE 0 END) AS fp, sum(CASE WHEN score < threshold THEN target ELSE 0 END) AS fn, sum(CASE WHEN score < threshold THEN 1 - target ELSE 0 END) AS tn, avg((score >= threshold)::INT) AS alert_rate FROM t GROUP BY ALL) SELECT model, threshold, n, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(tn, 4) AS tn, round(alert_rate, 4) AS alert_rate, round(tp / nullif(tp + fn, 0), 4) AS sensitivity, round(tn / nullif(tn + fp, 0), 4) AS specificity, round(tp / nullif(tp + fp, 0), 4) AS ppv, round(tn / nullif(tn + fn, 0), 4) AS npv FROM g")
def expected_thresholds(spark, sf_dir):
    return _rounded(M.expected_threshold_metrics(predictions(spark, sf_dir), ["model"], THRESHOLDS), 4)


@query("WITH t AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, least(abs(value) / 100, 1.0) AS score, threshold FROM events, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(threshold)) SELECT event_type, threshold, week::VARCHAR AS week, count(*) AS evaluated, count(*) FILTER (score >= threshold) AS alerts, round(avg((score >= threshold)::INT), 6) AS alert_rate, round(100 * count(*) FILTER (score >= threshold) / count(*), 6) AS alerts_per_100 FROM t GROUP BY ALL")
def weekly_alert_burden(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("time"), F.least(F.abs("value") / 100, F.lit(1.0)).alias("score"))
    return _rounded(M.alert_burden(e, ["event_type"], THRESHOLDS)).withColumn("week", F.col("week").cast("string"))


_TIMES = ("first_to_last", "first_to_even", "even_to_last", "first_to_written")


@query("""WITH g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, min(ts) FILTER (event_id % 2 = 0) AS c FROM events GROUP BY 1), h AS (SELECT unnest(['first_to_last', 'first_to_even', 'even_to_last', 'first_to_written']) AS interval, unnest([epoch_us(b) - epoch_us(a), epoch_us(c) - epoch_us(a), epoch_us(b) - epoch_us(c), CASE WHEN user_id % 3 <> 0 THEN epoch_us(b) - epoch_us(a) END]) / 3.6e9 AS hours FROM g)
SELECT interval, count(*) AS n, round(avg(hours), 6) AS mean, round(quantile_cont(hours, 0.25), 6) AS p25, round(quantile_cont(hours, 0.5), 6) AS median, round(quantile_cont(hours, 0.75), 6) AS p75 FROM h WHERE hours IS NOT NULL GROUP BY 1""")
def timing_summary(spark, sf_dir):
    """Four pairs of times, of which one side is missing for some and one is written text, malformed for every third user."""
    even = F.min(F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("ts")))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"), even.cast("timestamp").alias("c"))
    g = g.withColumn("w", F.when(F.pmod("user_id", F.lit(3)) == 0, "not a time").otherwise(F.col("b").cast("string")))
    return _rounded(M.timing_summary(g, dict(zip(_TIMES, (("a", "b"), ("a", "c"), ("c", "b"), ("a", "w")), strict=True))))


@query(f"WITH {RATINGS} SELECT case_id, task, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high, max(value) - min(value) AS range, max(value) - min(value) >= 25 AS range_25, max(value) - min(value) >= 50 AS range_50 FROM r GROUP BY ALL")
def case_reference(spark, sf_dir):
    return _rounded(A.case_reference(ratings(spark, sf_dir)))


@query(f"WITH {RATINGS} SELECT task, rater, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75, min(value) AS low, max(value) AS high FROM r GROUP BY ALL")
def rater_summary(spark, sf_dir):
    return _rounded(A.rater_summary(ratings(spark, sf_dir)))


@query(f"""WITH {RATINGS}, q AS (SELECT x.task, x.rater AS rater_a, y.rater AS rater_b, x.value AS a, y.value AS b FROM r x JOIN r y ON x.case_id = y.case_id AND x.task = y.task AND x.rater < y.rater),
k AS (SELECT *, rank() OVER (PARTITION BY task, rater_a, rater_b ORDER BY a) + (count(*) OVER (PARTITION BY task, rater_a, rater_b, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY task, rater_a, rater_b ORDER BY b) + (count(*) OVER (PARTITION BY task, rater_a, rater_b, b) - 1) / 2 AS rb, (a >= 50)::INT AS x, (b >= 50)::INT AS y, (a >= 67)::INT AS x2, (b >= 67)::INT AS y2 FROM q),
g AS (SELECT task, rater_a, rater_b, count(*) AS n, avg(abs(a - b)) AS mae, sqrt(avg((a - b) ** 2)) AS rmse, avg(a - b) AS mean_difference, corr(a, b) AS pearson, corr(ra, rb) AS spearman, avg((x = y)::INT) AS agreement, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS c, avg((x2 = y2)::INT) AS agreement2, avg(x2) * avg(y2) + (1 - avg(x2)) * (1 - avg(y2)) AS c2 FROM k GROUP BY ALL)
SELECT task, rater_a, rater_b, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mean_difference, 6) AS mean_difference, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(agreement, 6) AS agreement_50, round(CASE WHEN c < 1 THEN (agreement - c) / (1 - c) END, 6) AS kappa_50, round(agreement2, 6) AS agreement_67, round(CASE WHEN c2 < 1 THEN (agreement2 - c2) / (1 - c2) END, 6) AS kappa_67 FROM g""")
def pairwise_agreement(spark, sf_dir):
    return _rounded(A.pairwise_agreement(ratings(spark, sf_dir)))


_WIDE = "w AS (SELECT case_id, rater, avg(value) FILTER (task = 'image') AS a, avg(value) FILTER (task = 'report') AS b FROM r GROUP BY ALL), d AS (SELECT *, b - a AS d, rank() OVER (PARTITION BY rater ORDER BY a) + (count(*) OVER (PARTITION BY rater, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY rater ORDER BY b) + (count(*) OVER (PARTITION BY rater, b) - 1) / 2 AS rb, (a >= 50)::INT AS x, (b >= 50)::INT AS y FROM w WHERE b - a IS NOT NULL)"
_ALIGN = "count(*) AS n, round(avg(d), 6) AS mean_difference, round(stddev_samp(d), 6) AS sd, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, round(avg(d) - 1.96 * stddev_samp(d), 6) AS lower, round(avg(d) + 1.96 * stddev_samp(d), 6) AS upper, round(avg((x = y)::INT), 6) AS agreement, round((avg((x = y)::INT) - (avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)))) / (1 - (avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)))), 6) AS kappa"


@query(f"WITH {RATINGS}, {_WIDE} SELECT rater, {_ALIGN} FROM d GROUP BY rater")
def within_rater_alignment(spark, sf_dir):
    return _rounded(A.alignment(ratings(spark, sf_dir), "image", "report", ["rater"]))


@query(f"WITH {RATINGS}, o AS (SELECT task, rater, value - (sum(value) OVER (PARTITION BY case_id, task) - value) / nullif(count(*) OVER (PARTITION BY case_id, task) - 1, 0) AS d FROM r) SELECT task, rater, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse FROM o WHERE d IS NOT NULL GROUP BY ALL")
def leave_one_rater_out(spark, sf_dir):
    return _rounded(A.leave_one_out(ratings(spark, sf_dir)))


@query(f"WITH {RATINGS} SELECT c.case_id, v.rater FROM (SELECT DISTINCT case_id FROM r) c, (VALUES ('R0'), ('R1'), ('R2'), ('R3')) v(rater) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.case_id = c.case_id AND r.rater = v.rater)")
def missing_ratings(spark, sf_dir):
    return A.missing_ratings(ratings(spark, sf_dir), ["R0", "R1", "R2", "R3"])


@query(f"WITH {RATINGS} SELECT case_id, task, string_agg(rater || '=' || value::BIGINT::VARCHAR, ';' ORDER BY rater) AS ratings FROM r GROUP BY ALL")
def rating_strings(spark, sf_dir):
    return A.rating_strings(ratings(spark, sf_dir))


@query(f"WITH {RATINGS}, g AS (SELECT case_id, task, max(value) - min(value) AS range FROM r GROUP BY ALL) SELECT task, row_number() OVER (PARTITION BY task ORDER BY range DESC, case_id) AS place, case_id, range FROM g QUALIFY place <= 10")
def top_disagreements(spark, sf_dir):
    return A.top_disagreements(ratings(spark, sf_dir)).withColumn("place", F.col("place").cast("bigint"))


@query(f"""WITH {RATINGS}, f AS (SELECT *, count(*) OVER (PARTITION BY task, case_id) AS k FROM r QUALIFY k = 3), m AS (SELECT *, avg(value) OVER (PARTITION BY task, case_id) AS mc, avg(value) OVER (PARTITION BY task, rater) AS mr, avg(value) OVER (PARTITION BY task) AS m FROM f),
g AS (SELECT task, count(DISTINCT case_id) AS n, sum((mc - m) ** 2) / (count(DISTINCT case_id) - 1) AS msc, sum((mr - m) ** 2) / 2 AS msr, sum((value - mc - mr + m) ** 2) / ((count(DISTINCT case_id) - 1) * 2) AS mse FROM m GROUP BY task)
SELECT task, n, round((msc - mse) / (msc + 2 * mse + 3 * (msr - mse) / n), 6) AS icc_single, round((msc - mse) / (msc + (msr - mse) / n), 6) AS icc_mean FROM g""")
def intraclass_correlation(spark, sf_dir):
    return _rounded(A.icc(ratings(spark, sf_dir), 3)).select("task", "n", "icc_single", "icc_mean")


# The names and patterns of what may identify a person or a machine.
IDENTIFIERS = {
    "mimic_deidentification_marker": r"\[\*\*",
    "mimic_identifier": r"(?i)\bmimic[_-]",
    "record_identifier_label": r"(?i)\b(?:mrn|medical record|accession|subject[_ ]?id|study[_ ]?id|patient[_ ]?id|dob|date of birth|ssn)\b",
    "email_address": r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b",
    "phone_number": r"\b\d{3}[-.) ]+\d{3}[- ]+\d{4}\b",
    "ssn_number": r"\b\d{3}-\d{2}-\d{4}\b",
    "long_numeric_identifier": r"\b\d{4,}\b",
    "absolute_posix_path": r"(?:^|[^:])/(?:Users|home|Volumes|mnt)/",
    "windows_path": r"\b[A-Za-z]:\\",
}


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in IDENTIFIERS.items()) + "], lambda x: x IS NOT NULL), '|') AS found FROM documents WHERE text IS NOT NULL")
def identifier_screen(spark, sf_dir):
    """Names of the kinds of identifiers that a text holds."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(F.col("text").rlike(p), k) for k, p in IDENTIFIERS.items()))), "|").alias("found"))


@query(f"SELECT doc_id, d.source, {_SPLIT.replace('source', 's.source')} AS split FROM documents d JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s USING (source)".replace("d.source,", "source,"))
def split_join(spark, sf_dir):
    """Subjects are dealt to splits once; their rows get it by a join."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return L.with_split(d, L.assign_splits(d.select("source").where("source is not null").distinct(), "source", TRAIN_SALT), "source").select("doc_id", "source", "split")


@query("SELECT (SELECT count(*) FROM documents WHERE lang = 'de') AS n, (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT doc_id::VARCHAR AS v FROM documents WHERE lang = 'de' ORDER BY v LIMIT 5)) AS examples")
def example_ids(spark, sf_dir):
    return L.example_values(table(spark, sf_dir, "documents").where("lang = 'de'"), "doc_id").withColumn("examples", F.array_join("examples", ","))


@query("SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def sources_by_size(spark, sf_dir):
    """Sources in order of size; places count sizes of whole groups of equal size first, then names inside a group."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("minus", -F.col("n"))
    ahead = M.running(g.groupBy("minus").agg(F.count("*").alias("k")), [], "minus", ["k"]).select("minus", "below_k")
    inside = F.row_number().over(Window.partitionBy("minus").orderBy(F.col("source").asc_nulls_last()))
    return g.withColumn("inside", inside).join(ahead, "minus").select("source", "n", (F.col("below_k") + F.col("inside")).cast("bigint").alias("place"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def first_documents(spark, sf_dir):
    return L.first_rows(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 25)


@query("SELECT d.doc_id, (hash_p >= 50)::INT AS human_label, quality AS silver_strict, (hash_p >= 50)::INT = quality AS agrees FROM (SELECT doc_id, doc_id * 37 % 101 AS hash_p FROM documents) d JOIN labels USING (doc_id)")
def reviewed_against_silver(spark, sf_dir):
    silver = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("silver_strict"))
    reviews = table(spark, sf_dir, "documents").select("doc_id", F.expr("pmod(doc_id * 37, 101)").alias("probability_0_100"))
    return L.reviewed(silver, reviews, ["doc_id"]).select("doc_id", "human_label", "silver_strict", "agrees")


@query(f"WITH {RATINGS}, c AS (SELECT t.task, v.a AS rater_a, v.b AS rater_b FROM (VALUES ('image'), ('report')) t(task), (VALUES ('R0', 'R1'), ('R0', 'R2'), ('R0', 'R9'), ('R1', 'R2'), ('R1', 'R9'), ('R2', 'R9')) v(a, b)), q AS (SELECT x.task, x.rater AS rater_a, y.rater AS rater_b, count(*) AS n, round(avg(abs(x.value - y.value)), 6) AS mae FROM r x JOIN r y ON x.case_id = y.case_id AND x.task = y.task AND x.rater < y.rater GROUP BY ALL) SELECT task, rater_a, rater_b, coalesce(n, 0) AS n, coalesce(mae, -1) AS mae FROM c LEFT JOIN q USING (task, rater_a, rater_b)")
def every_rater_pair(spark, sf_dir):
    """A row for each pair of expected raters, also where no case is in common."""
    return _rounded(A.every_pair(A.pairwise_agreement(ratings(spark, sf_dir)), ["image", "report"], ["R0", "R1", "R2", "R9"])).select("task", "rater_a", "rater_b", "n", "mae").fillna(-1, ["mae"])


@query(f"WITH {RATINGS}, i AS (SELECT event_id // 6 AS case_id, arg_min(event_type, event_id) AS kind, arg_min(user_id, event_id) FILTER (user_id % 2 = 0) AS even_user FROM events GROUP BY 1) SELECT case_id, task, count(*) AS n, kind, coalesce(even_user, -1) AS even_user FROM r JOIN i USING (case_id) GROUP BY ALL")
def identified_cases(spark, sf_dir):
    """A case reference with the first value of each identifier."""
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 6").alias("case_id"), F.col("event_id").alias("row_no"), F.col("event_type").alias("kind"), F.when(F.pmod("user_id", F.lit(2)) == 0, F.col("user_id")).alias("even_user"))
    return A.identified(A.case_reference(ratings(spark, sf_dir)), e, ["kind", "even_user"]).select("case_id", "task", "n", "kind", "even_user").fillna(-1, ["even_user"])


@query("WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), c AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cluster FROM t) SELECT conv_id, cluster::BIGINT AS cluster, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM c GROUP BY ALL")
def adjacent_clusters(spark, sf_dir):
    """Gaps and islands: runs of turns of one role."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(w))
    c = c.withColumn("cluster", F.sum(F.when(F.col("before").isNull() | (F.col("before") != F.col("role")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("conv_id", "cluster").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query(f"WITH {PREDICTIONS} SELECT 'score_range' AS \"check\", 'error' AS severity, count(*) AS n_rows FROM p WHERE NOT (score BETWEEN 0.05 AND 0.95) HAVING count(*) > 0 UNION ALL SELECT 'lang_known', 'error', count(*) FROM p WHERE NOT coalesce(lang IN ('en', 'fr', 'de'), FALSE) HAVING count(*) > 0")
def prediction_checks(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return V.failed(p, {"score_range": ~F.col("score").between(0.05, 0.95), "lang_known": ~F.coalesce(F.col("lang").isin("en", "fr", "de"), F.lit(False))})


@query("WITH g AS (SELECT source, avg(quality)::DOUBLE AS p, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, n, round(1.959963984540054 * sqrt(p * (1 - p) / n + 1.959963984540054 * 1.959963984540054 / (4.0 * n * n)) / (1 + 1.959963984540054 * 1.959963984540054 / n), 6) AS half_width FROM g")
def wilson_widths(spark, sf_dir):
    g = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("p"), F.count("*").alias("n"))
    return g.select("source", "n", F.round(X.wilson_half_width(F.col("p"), F.col("n").cast("double")), 6).alias("half_width"))


@query("WITH g AS (SELECT source, avg(quality)::DOUBLE AS r, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT source, CASE WHEN r > 0 THEN greatest(ceil(0.9 * (1 - r) / (r * (1 - 0.9)) - 1e-12), 1)::BIGINT ELSE -1 END AS raters FROM g")
def raters_for_reliability(spark, sf_dir):
    """How many raters as reliable as a source's share of good documents reach a reliability of 0.9."""
    g = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("r"))
    return g.select("source", F.coalesce(X.raters_required(F.col("r"), F.lit(0.9)), F.lit(-1).cast("bigint")).alias("raters"))


#: Terms in groups, some with blanks and signs; SQL spells their patterns out.
VOCABULARY = {"joined": ["On The", "a.b", "of the", "of"], "signs": ["(c)", "+", "***"], "rare": ["Retion", "ertion", "et la"]}
_PATTERNS = {"joined": r"(?:on\s+the|of\s+the|a\.b|of)", "signs": r"(?:\*\*\*|\(c\)|\+)", "rare": r"(?:ertion|retion|et\s+la)"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}'))::INT AS {k}" for k, p in _PATTERNS.items()) + " FROM documents WHERE text IS NOT NULL")
def vocabulary_matches(spark, sf_dir):
    """How often the terms of each group stand in a text."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("low", F.lower("text"))
    return d.select("doc_id", *(F.regexp_count("low", F.lit(X.terms_to_regex(terms))).alias(k) for k, terms in VOCABULARY.items()))


@query("SELECT subject, study, n FROM (SELECT CASE WHEN doc_id % 10 = 3 THEN NULL ELSE doc_id // 7 END AS subject, CASE WHEN doc_id % 11 = 4 THEN NULL ELSE doc_id END AS study, length(text) AS n, doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 5) ORDER BY doc_id".replace("SELECT subject, study, n FROM", "SELECT coalesce(subject, -1) AS subject, coalesce(study, -1) AS study, n FROM"))
def typed_reports(spark, sf_dir):
    """Raw rows of strings as reports: malformed ids are null (-1), rows without a text are left out."""
    d = table(spark, sf_dir, "documents")
    subject = F.when(F.pmod("doc_id", F.lit(10)) == 3, "p12").otherwise(F.expr("doc_id div 7").cast("string"))
    study = F.when(F.pmod("doc_id", F.lit(11)) == 4, "").otherwise(F.col("doc_id").cast("string"))
    raw = d.select(subject.alias("subject"), study.alias("study"), F.when(F.pmod("doc_id", F.lit(13)) != 5, F.col("text")).alias("report_text"))
    return S.base(raw).select(F.coalesce("subject", F.lit(-1)).alias("subject"), F.coalesce("study", F.lit(-1)).alias("study"), F.char_length("report_text").cast("bigint").alias("n"))


@query(f"WITH {PREDICTIONS}, s AS (SELECT doc_id, avg(score) FILTER (model = 'm1') AS x FROM p WHERE doc_id % 4 <> 1 GROUP BY 1) SELECT doc_id, round(coalesce(x, 0.0), 6) AS prediction_score, (coalesce(x, 0.0) >= 0.5)::INT AS prediction_label FROM labels LEFT JOIN s USING (doc_id)")
def rule_scores(spark, sf_dir):
    """The rules' own score as a model; a quarter of the rows has none."""
    p = predictions(spark, sf_dir).where("model = 'm1'")
    rows = table(spark, sf_dir, "labels").select("doc_id").join(p.select("doc_id", F.when(F.pmod("doc_id", F.lit(4)) != 1, F.col("score")).alias("silver_score")), "doc_id", "left")
    return _rounded(B.rule_score(rows).select("doc_id", "prediction_score", "prediction_label"))


@query()
def bootstrap_brier(spark, sf_dir):
    """Intervals of each model's Brier score over clusters (sources); draws are random, so SQL has no counterpart."""
    p = predictions(spark, sf_dir).withColumn("error", (F.col("score") - F.col("label")) ** 2)
    return R.bootstrap_interval(p, ["model"], {"e": F.sum("error"), "n": F.count("*")}, F.sum("e") / F.sum("n"), cluster="source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import benchmark_queries, extraction_queries, learning_queries, parity_queries, planning_queries, rating_queries, report_queries, validation_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
