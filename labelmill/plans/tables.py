"""The test tables seen as the engine's inputs, in Spark and as DuckDB SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sentences that give the invented prose something to find, dealt by doc_id.
PHRASES = (
    "There is bilateral hazy opacity.", "No bilateral opacities are seen.", "Possible diffuse interstitial edema.", "Right lower consolidation, left lung opacity.",
    "Both lungs show volume loss.", "Multifocal pneumonia with edema.", "The prior bilateral infiltrates have cleared.", "Nothing of note.", "Bibasilar atelectasis; diffuse edema cannot exclude disease.",
)
HEADS = ("FINDINGS:", "Findings", "  findings :", "Indication: none\nFINDINGS")
TAILS = ("IMPRESSION:", "Impression", " impression :", "Conclusion")


def _dealt(values: tuple[str, ...]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col("doc_id"), F.lit(len(values))).cast("int"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as reports: subject, study and a text with sections under headers of many forms."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    half = F.floor(F.char_length("text") / 2).cast("int")
    body = F.concat(_dealt(HEADS), F.lit("\n"), F.substr("text", F.lit(1), half), F.lit(" "), _dealt(PHRASES), F.lit("\r\n\r\n\r\n\n"), _dealt(TAILS), F.lit("\n"), F.substr("text", half + 1))
    added = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit("\nADDENDUM\nseen again ")).otherwise("")
    return d.select(F.col("source").alias("subject"), F.col("doc_id").alias("study"), F.concat(body, added).alias("report_text"))


TOKENS = ("opacity", "consolidation", "edema", "volume loss", "left lower lobe", "right base", "bilateral", "diffuse", "rib", "Left Lung", "Haze", "heart")
LABELS = ("OBS-DP", "OBS-U", "OBS-DA", "ANAT-DP")


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as entities of the report of its number, and every line as a relation to the next."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("study"), F.col("l_linenumber").cast("int").alias("entity_id")).agg(F.min("l_partkey").alias("doc_id"), F.min("l_suppkey").alias("s"))
    e = one.select("study", "entity_id", _dealt(TOKENS).alias("tokens"), F.get(F.array(*map(F.lit, LABELS)), F.pmod("s", F.lit(4)).cast("int")).alias("label"))
    rel = e.select("study", F.col("entity_id").alias("source_id"), (F.col("entity_id") + 1).alias("target_id"), F.when(F.col("label") == "ANAT-DP", "modify").otherwise("located_at").alias("relation"))
    return rel, e


def silver_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the four tri-state labels of a labeler."""
    l = table(spark, sf_dir, "labels")  # noqa: E741
    k = F.pmod(F.col("doc_id"), F.lit(7))
    return l.select(F.col("doc_id").alias("study"), F.when(F.col("toxic") == 1, -1).when(k == 0, None).otherwise(F.col("quality")).alias("label_opacity"), F.when(k == 1, 1).otherwise(0).alias("label_edema"), F.when(k == 2, -1).alias("label_consolidation"), F.lit(0).alias("label_atelectasis"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as truth with scores of three models drawn from hashes, rounded so that ties occur."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")  # noqa: E741
    rows = l.withColumn("model", F.explode(F.array(*map(F.lit, ("m1", "m2", "m3")))))
    score = F.round(0.6 * hash_unit(F.concat_ws("-", F.col("doc_id").cast("string"), "model")) + 0.4 * F.col("quality"), 2)
    return rows.select("doc_id", "lang", "source", "model", F.col("quality").alias("label"), score.alias("score"), F.round(hash_unit(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit("t"))), 3).alias("target"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ratings: six events in a row are a case, rated by three raters in two tasks; repeated ratings are averaged."""
    e = table(spark, sf_dir, "events")
    task = F.when(F.pmod("event_id", F.lit(2)) == 0, "image").otherwise("report")
    rows = e.select(F.expr("event_id div 6").alias("case_id"), F.concat(F.lit("R"), F.pmod("user_id", F.lit(3)).cast("string")).alias("rater"), task.alias("task"), F.least(F.abs("value"), F.lit(100.0)).alias("v"))
    return rows.groupBy("case_id", "rater", "task").agg(F.floor(F.avg("v")).cast("double").alias("value"))


def _sql_list(values: tuple[str, ...]) -> str:
    one = lambda v: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in v.split("\n"))
    return "[" + ", ".join(map(one, values)) + "]"


UNIT = "CAST(('0x' || substr(sha256({0}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_DEALT = "list_extract({0}, ({1} % {2})::INT + 1)"
REPORTS = (
    "reports AS (SELECT source AS subject, doc_id AS study, " + _DEALT.format(_sql_list(HEADS), "doc_id", len(HEADS)) + " || chr(10) || substr(text, 1, (length(text) // 2)::INT) || ' ' || "
    + _DEALT.format(_sql_list(PHRASES), "doc_id", len(PHRASES)) + " || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || " + _DEALT.format(_sql_list(TAILS), "doc_id", len(TAILS))
    + " || chr(10) || substr(text, (length(text) // 2)::INT + 1) || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'ADDENDUM' || chr(10) || 'seen again ' ELSE '' END AS report_text FROM documents WHERE text IS NOT NULL)"
)
GRAPHS = (
    "e0 AS (SELECT l_orderkey AS study, l_linenumber AS i, min(l_partkey) AS a, min(l_suppkey) AS s FROM lineitem GROUP BY ALL), "
    f"e AS (SELECT study, i, lower({_DEALT.format(_sql_list(TOKENS), 'a', len(TOKENS))}) AS t, {_DEALT.format(_sql_list(LABELS), 's', 4)} AS label FROM e0), "
    "x AS (SELECT a.study, a.t AS st, a.label AS l, b.t AS tt FROM e a LEFT JOIN e b ON b.study = a.study AND b.i = a.i + 1 WHERE a.label <> 'ANAT-DP')"
)
TRISTATE = "tri AS (SELECT doc_id AS study, CASE WHEN toxic = 1 THEN -1 WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS lo, CASE WHEN doc_id % 7 = 1 THEN 1 ELSE 0 END AS le, CASE WHEN doc_id % 7 = 2 THEN -1 END AS lc, 0 AS la FROM labels)"
PREDICTIONS = (
    "p AS (SELECT l.doc_id, d.lang, d.source, m.model, l.quality AS label, "
    f"round(0.6::DOUBLE * {UNIT.format('l.doc_id::VARCHAR || chr(45) || m.model')} + 0.4::DOUBLE * l.quality, 2) AS score, "
    f"round({UNIT.format('l.doc_id::VARCHAR || chr(45) || chr(116)')}, 3) AS target "
    "FROM labels l JOIN documents d USING (doc_id), (VALUES ('m1'), ('m2'), ('m3')) m(model))"
)
RATINGS = "r AS (SELECT event_id // 6 AS case_id, 'R' || (user_id % 3)::VARCHAR AS rater, CASE WHEN event_id % 2 = 0 THEN 'image' ELSE 'report' END AS task, floor(avg(least(abs(value), 100.0))) AS value FROM events GROUP BY ALL)"
