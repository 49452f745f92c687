"""The corpus pipeline: rejects poor and toxic documents, keeps one of each group of near copies, drops
documents that hold benchmark passages, redacts secrets, and encodes what is left.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents`` in any order and
possibly more, and works on all rows it gets; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.llm import bpe, decontaminate, jaccard, quality, secrets
from labelmill.llm.storage import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    heads = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), heads).where("kept").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one of smallest id: of its rows one for each text.

    Documents without words, and rows without an id, are linked with nothing and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    stay = jaccard.join(docs).where("doc_id = component_id").select("doc_id").distinct()
    one = Window.partitionBy("doc_id", F.sha2("text", 256)).orderBy("n_chars", "lang", "source")
    kept = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    found = decontaminate.matches(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.where(~F.col("hits").contains(F.lit(b"\1"))).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts redacted; n_chars is brought up to date."""
    found = secrets.scan(docs.select(*COLUMNS), redacted_col="text")
    return found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each text and the digest of their decoded form."""
    out = bpe.encode(docs.select(*COLUMNS), bpe.tokenizer_path(), decoded_col="decoded", keep_text=False)
    return out.select("doc_id", "lang", "source", "n_chars", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", encode_stage),
]

#: The trained classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
