"""Where operators put data that must outlive a job: the shared folder that the session names. ``clean_up`` drops it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (local tests) a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables and folders that operators of this process have written, by application.
_written: dict[str, list[tuple[str, str]]] = {}


def remember(spark: SparkSession, kind: str, name: str) -> None:
    _written.setdefault(spark.sparkContext.applicationId, []).append((kind, name))


def clean_up(spark: SparkSession) -> int:
    """Drops all tables and folders that operators have written in this application; how many there were.

    Results are lazy and read them: call it when the results have been written.
    """
    found = _written.pop(spark.sparkContext.applicationId, [])
    for kind, name in found:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(found)


def materialise(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a lost executor costs no recomputation beyond it."""
    path = f"{shared_folder(df.sparkSession)}/labelmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(df.sparkSession, "folder", path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which grow with the data that the cluster is set up for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
