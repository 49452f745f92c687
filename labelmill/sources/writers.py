"""Sinks: tables, text packets with manifests, published tables, ledgers, and outputs that appear whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.benchmark import by_role
from ..operators.parity import DOCUMENT_MISMATCH, ENTITY_MISMATCH, ORDER_MISMATCH
from ..operators.validation import assert_safe


def create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def replace_table(df: DataFrame, name: str, database: str | None = None) -> None:
    """df as a table that takes the place of any of that name."""
    if database:
        create_schema(df.sparkSession, database)
        name = f"{database}.{name}"
    df.write.mode("overwrite").saveAsTable(name)


def load_table(df: DataFrame, name: str, replace: bool = False) -> None:
    """df as a table; without replace only where there is none, or one without rows."""
    spark = df.sparkSession
    if not replace and spark.catalog.tableExists(name):
        if spark.table(name).limit(1).count():
            raise ValueError(f"table {name} has rows")
        replace = True
    df.write.mode("overwrite" if replace else "errorifexists").saveAsTable(name)


def counted(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Writes df as Parquet; the number of rows, observed while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return seen.get["n"]


def flattened(parsed: DataFrame, cuts: dict[str, Callable[[DataFrame], DataFrame]], path: str) -> dict[str, int]:
    """Several tables cut from one parse, which alone is kept while they are written; the number of rows of each."""
    kept = parsed.persist()
    try:
        return {name: counted(cut(kept), f"{path}/{name}") for name, cut in cuts.items()}
    finally:
        kept.unpersist()


def packet(df: DataFrame, path: str, id_col: str, text_cols: list[str], more: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts in order of id as gzip JSON lines under path/packet; a manifest without texts, and a summary of one row.

    The manifest (path/manifest) has each text's length and hash and the row's place in the order, counted inside ranges
    of ids to which the sizes of the ranges before are added, so no task numbers all rows.
    """
    keep = [id_col, *(more or [])]
    df.select(*keep, *text_cols).orderBy(id_col).write.mode("errorifexists").option("compression", "gzip").json(f"{path}/packet")
    ids = df.select(id_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    ids = ids.withColumn("_range", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("bigint"), 33)).persist()
    sizes = ids.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # a row for each range
    order = ids.join(F.broadcast(ahead), "_range").select(id_col, (F.col("_ahead") + F.col("_nth")).alias("input_order"))
    facts = [c for t in text_cols for c in (F.char_length(t).alias(f"{t}_characters"), F.sha2(t, 256).alias(f"{t}_sha256"))]
    df.select(*keep, *facts).join(order, id_col).write.mode("errorifexists").parquet(f"{path}/manifest")
    ids.unpersist()
    manifest = df.sparkSession.read.parquet(f"{path}/manifest")
    summary = manifest.agg(F.count("*").alias("n_rows"), F.countDistinct(id_col).alias("n_ids"), *(F.sum(f"{t}_characters").alias(f"{t}_characters") for t in text_cols), F.lit(True).alias("holds_texts"))
    summary.write.mode("errorifexists").parquet(f"{path}/summary")
    return manifest, df.sparkSession.read.parquet(f"{path}/summary")


def plain(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON, as flat files need it."""
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in df.schema))


def shared_table(df: DataFrame, path: str, fmt: str = "parquet", by: list[str] | None = None) -> None:
    """A table that leaves the restricted area: refused if a column may hold text or paths."""
    assert_safe(df)
    w = (plain(df) if fmt == "csv" else df).write.mode("overwrite").format(fmt).option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def role_tables(metrics: DataFrame, path: str) -> None:
    """Metric tables by what a model's comparison is for: path/primary, path/compatibility, path/exploratory."""
    for name, df in by_role(metrics).items():
        shared_table(df, f"{path}/{name}", "csv")


def soft_tables(results: dict[str, DataFrame], path: str) -> None:
    """Soft-target metrics as CSV and JSON, calibration bins in a folder for each kind of target, and the audit."""
    shared_table(results["metrics"], f"{path}/metrics", "csv")
    shared_table(results["metrics"], f"{path}/metrics_json", "json")
    shared_table(results["thresholds"], f"{path}/thresholds", "csv")
    shared_table(results["calibration"], f"{path}/calibration", "csv", ["target_type"])
    shared_table(results["audit"], f"{path}/audit", "json")


def documents(df: DataFrame, manifest: DataFrame, path: str, id_col: str, text_col: str, files: int = 64) -> DataFrame:
    """Texts of the rows that the manifest (id_col, safe_id, export_status) lets through, by safe id, in about so many files
    a folder of the hash; the manifest with what became of each row is written beside and returned."""
    good = manifest.where("export_status = 'candidate'").select(id_col, "safe_id")
    out = df.select(id_col, text_col).join(good, id_col).select("safe_id", F.col(text_col).alias("text"))
    out.repartition(files, "safe_id").sortWithinPartitions("safe_id").write.mode("errorifexists").parquet(f"{path}/texts")
    written = manifest.withColumn("export_status", F.when(F.col("export_status") == "candidate", "written").otherwise(F.col("export_status")))
    written.write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def with_manifest(frames: dict[str, tuple[DataFrame, str, bool]], path: str) -> DataFrame:
    """Writes named outputs (frame, category, restricted; one at least) and a table that lists them with their numbers of
    rows, which are counted as they are written."""
    rows = []
    for name, (df, category, restricted) in frames.items():
        if not restricted:
            assert_safe(df)
        rows.append((name, category, counted(df, f"{path}/{name}"), restricted))
    listed = df.sparkSession.createDataFrame(rows, "artifact string, category string, n_rows bigint, restricted boolean")
    listed.write.mode("errorifexists").parquet(f"{path}/output_manifest")
    return listed


def ledgers(entities: DataFrame, documents_: DataFrame, orders: DataFrame, path: str) -> None:
    """Mismatch tables with their full schemas even when empty, and all of them in one CSV."""
    spark = entities.sparkSession
    typed = {"entities": (entities, ENTITY_MISMATCH), "documents": (documents_, DOCUMENT_MISMATCH), "orders": (orders, ORDER_MISMATCH)}
    every = None
    for name, (df, schema) in typed.items():
        frame = spark.createDataFrame([], schema).unionByName(df)
        frame.write.mode("errorifexists").parquet(f"{path}/{name}")
        frame = spark.read.parquet(f"{path}/{name}")
        every = frame if every is None else every.unionByName(frame, allowMissingColumns=True)
    every.write.mode("errorifexists").option("header", True).csv(f"{path}/all")


def all_or_nothing(frames: dict[str, DataFrame], path: str, check: Callable[[dict[str, DataFrame]], None]) -> None:
    """Writes all frames beside path, checks what was written, then moves it into place; nothing is replaced on failure.

    Each run writes to a folder of its own. The old output is moved aside before the new one takes its place, moved back
    if that fails, and dropped last.
    """
    spark = next(iter(frames.values())).sparkSession
    mark = uuid.uuid4().hex
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, source, aside = path_of(path), path_of(f"{path}.staging-{mark}"), path_of(f"{path}.old-{mark}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        for name, df in frames.items():
            df.write.mode("errorifexists").parquet(f"{path}.staging-{mark}/{name}")
        check({name: spark.read.parquet(f"{path}.staging-{mark}/{name}") for name in frames})
        had = fs.exists(target)
        if had and not fs.rename(target, aside):
            raise OSError(f"cannot move {path} aside")
        if not fs.rename(source, target):
            if had:
                fs.rename(aside, target)
            raise OSError(f"cannot move the new output to {path}")
        if had:
            fs.delete(aside, True)
    finally:
        fs.delete(source, True)
