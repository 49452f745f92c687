"""How operators that compare all documents with all others move little: batches and packed keys.

Documents are hashed into batches and written once as a table bucketed by batch, so that each later
step groups a batch's whole texts without shuffling them. What a batch must learn from the others it
asks for by sorted 64-bit keys, packed into one row per range of keys; the answer comes back to the
batch the same way. Rows moved are keys, never texts, and a key that many documents share counts
once per batch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import parallelism, remember
from .textbuf import give_back

#: Batches per shuffle partition: a bucket holds several, which evens out what tasks get.
PER_PARTITION = 3


def in_batches(docs: DataFrame, *columns: str, by: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The columns of docs with their batch, in a table bucketed by batch in the shared warehouse.

    ``tie`` orders rows of one id, ``row_no`` those that are equal; it is given to a row as it is written, so it is
    fixed from then on.
    """
    spark = docs.sparkSession
    n = parallelism(spark)
    rows = docs.select(*columns, F.xxhash64(*by).alias("tie")).withColumn("batch", F.pmod("tie", F.lit(PER_PARTITION * n)))
    return bucketed(rows, "batch", n, "row_no")


def bucketed(df: DataFrame, key: str, n: int, row_no: str | None = None) -> DataFrame:
    """df in a table of n buckets by key in the shared warehouse, with a number for each row if a name for it is given."""
    name = f"labelmill_{uuid.uuid4().hex}"
    rows = df.repartition(n, key)
    rows = rows.withColumn(row_no, F.monotonically_increasing_id()) if row_no else rows
    rows.write.format("parquet").option("compression", "zstd").bucketBy(n, key).saveAsTable(name)
    remember(df.sparkSession, "table", name)
    return df.sparkSession.table(name)


def in_order(table: pa.Table) -> pa.Table:
    """A batch's rows in the one order that all steps use. What the batch before held is given back first."""
    give_back()
    return table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("row_no", "ascending")]).combine_chunks()


def key_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the 64-bit space starts in sorted keys, and the end."""
    bounds = np.array([(k << 64) // n for k in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpacked(column, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])
