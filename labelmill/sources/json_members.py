"""Large JSON objects in parts: the members of one object a file, read by many tasks.

A file is read as text that ends at closing braces, which Spark cuts into blocks like any text. Whether a block begins
inside a string, and how deep, follows from the blocks before it:

1. Each block is summed up for both beginnings, inside a string or not: how it ends, and what it adds to the depth.
2. The blocks of a file are put together in order (a row for each block), which gives each its beginning.
3. Each block is read again: where the depth comes back to one, a member ends. What a block begins or ends in the middle
   of is handed out as fragments, which are put together by file.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def scanned(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after text, and what text adds to the depth; inside: whether one is open before."""
    if inside:
        end = _STRING_END.match(text)
        if not end:
            return True, 0
        text = text[end.end() :]
    bare = _STRING.sub("", text)
    cut = bare.find('"')  # a string that stays open
    bare = bare if cut < 0 else bare[:cut]
    return cut >= 0, bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of text up to each closing brace, with their file, where their block starts and whether it is the file's
    last; in order within a block."""
    meta = F.col("_metadata")
    last = meta["file_block_start"] + meta["file_block_length"] >= meta["file_size"]
    return spark.read.option("lineSep", "}").text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), last.alias("last"))


def _runs(batches):
    """((file, block), piece with its brace) of rows in order. Only blanks at the end of a file have no brace after them."""
    before = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "last", "value")), strict=True):
            if before:
                yield before[:2], before[3] + ("" if before[2] and row[:2] != before[:2] and not before[3].strip() else "}")
            before = row
    if before:
        yield before[:2], before[3] + ("" if before[2] and not before[3].strip() else "}")


def _summed(batches):
    names = ["file", "block", "open_0", "depth_0", "open_1", "depth_1"]
    at, ends = None, [(False, 0), (True, 0)]

    def row():
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*at, *ends[0], *ends[1]), kinds, strict=True)], names)

    for key, piece in _runs(batches):
        if key != at:
            if at:
                yield row()
            at, ends = key, [(False, 0), (True, 0)]
        ends = [(is_open, depth + more) for (was, depth) in ends for is_open, more in [scanned(piece, was)]]
    if at:
        yield row()


def begins(summed: list) -> dict[tuple[str, int], tuple[bool, int]]:
    """For each block whether it begins inside a string, and how deep."""
    out, state, before = {}, (False, 0), None
    for r in sorted(summed, key=lambda r: (r["file"], r["block"])):
        if r["file"] != before:
            state, before = (False, 0), r["file"]
        out[r["file"], r["block"]] = state
        k = int(state[0])
        state = r[f"open_{k}"], state[1] + r[f"depth_{k}"]
    return out


def json_members(spark: SparkSession, path: str) -> DataFrame:
    """file and member: the text of each member of the files' objects, of members without an object as value together
    with the next one's."""
    rows = _blocks(spark, path)
    # A row for each block, as many as the scan has tasks.
    summed = rows.mapInArrow(_summed, "file string, block bigint, open_0 boolean, depth_0 bigint, open_1 boolean, depth_1 bigint").collect()
    shared = spark.sparkContext.broadcast(begins(summed))

    def cut(batches):
        names, kinds = ["file", "block", "part", "done", "text"], (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        at, inside, depth, held, first, out, size = None, False, 0, [], True, [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for key, piece in _runs(batches):
            if key != at:
                if at:
                    out.append((*at, 0 if first else 2, False, "".join(held)))
                at, held, first = key, [], True
                inside, depth = shared.value[key]
            inside, more = scanned(piece, inside)
            depth += more
            held.append(piece.removesuffix("}") if not depth and not inside else piece)  # the object's own end is left out
            if depth == 1 and not inside:
                out.append((*at, 0 if first else 1, True, "".join(held)))
                size += len(out[-1][-1])
                held, first = [], False
                if size > 4 << 20:
                    yield batch()
                    out, size = [], 0
        if at:
            out.append((*at, 0 if first else 2, False, "".join(held)))
        if out:
            yield batch()

    found = rows.mapInArrow(cut, "file string, block bigint, part int, done boolean, text string")
    whole = found.where("part = 1").select("file", "text")
    ends = found.where("part <> 1")  # at most two rows a block
    chain = F.coalesce(F.sum(F.col("done").cast("int")).over(Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = F.array_sort(F.collect_list(F.struct("block", "part", "text")))
    joined = ends.withColumn("chain", chain).groupBy("file", "chain").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text")).select("file", "text")
    member = F.regexp_replace("text", r"^[\s,\x{FEFF}]*\{?[\s,]*(?=\")", "")
    return whole.unionByName(joined).where(F.col("text").contains('"')).select("file", F.concat(F.lit("{"), member, F.lit("}")).alias("member"))
