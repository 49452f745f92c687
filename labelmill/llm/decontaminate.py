"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (an item with fewer words is one window).
Of the k-grams inside every run of ``window`` words the least hash (the rightmost of equals) is kept,
for benchmark and documents alike, so that equal windows keep the same k-gram: no shared window can
be missed. A document's kept hashes are joined with the benchmark's; each hit is extended by testing
the whole windows around it. Items shorter than a window are looked up by their own length.

A benchmark of at most ``broadcast_bytes`` of text, measured first, is broadcast as sorted arrays. A larger
one is joined by hash: documents' kept hashes with its kept hashes, then only the windows around the
hashes found with its windows. Both ways give the same rows.

Null text has no words; an empty benchmark hits nothing. An item without an id hits words but is not
listed; of items that share an id, the id is listed once. Rows of equal doc_id are matched each on its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import beside
from .exchange import member
from .storage import materialise
from .textbuf import ALNUM, LOWER, batch_pieces, gram_hashes, mix, pieces, rightmost_least, span_hashes, starts_of, utf8, word_bounds

WINDOW, GRAM, BROADCAST_BYTES = 10, 5, 16 << 20
#: Stands for a missing item id.
NO_ID = np.iinfo(np.int64).min


@dataclass
class Index:
    """A benchmark: kept hashes, and by length of window the window hashes with the items that have them."""

    kept: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word."""
    low = LOWER[data]
    s, e, row = word_bounds(low, offsets, ALNUM)
    return span_hashes(low, s, e), row


def winnow(grams: np.ndarray, runs: int) -> np.ndarray:
    """For each run of consecutive k-grams the position of its least hash, the rightmost of equals."""
    return rightmost_least(grams, runs) if len(grams) >= runs else np.zeros(0, np.int64)


def build_index(items: list[tuple[int, str]], window: int = WINDOW, gram: int = GRAM) -> Index:
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    words, row = words_of(data, offsets)
    ids = np.array([NO_ID if i is None else i for i, _ in items], np.int64)
    counts = np.bincount(row, minlength=len(items))
    first = np.r_[0, np.cumsum(counts)]
    kept: list[np.ndarray] = []
    found: dict[int, list] = {}
    for k, n in enumerate(counts.tolist()):
        w = words[first[k] : first[k + 1]]
        if n >= window:
            g = gram_hashes(w, gram)
            kept.append(g[np.unique(winnow(g, window - gram + 1))])
        if n:
            h = np.unique(gram_hashes(w, min(n, window)))
            found.setdefault(min(n, window), []).append((h, np.full(len(h), ids[k])))
    windows = {}
    for n, parts in found.items():
        h, i = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((i, h))
        windows[n] = h[order], i[order]
    return Index(np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64), windows)


def match(words: np.ndarray, row: np.ndarray, rows: int, index: Index, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which words are hit, and the sorted items that occur in each row."""
    hit_from, hit_to, found = [], [], []

    def take(starts: np.ndarray, size: int) -> None:
        """Keeps the starts at which a whole window of this size stands; finds the items that have it."""
        starts = starts[row[starts] == row[starts + size - 1]]
        if not len(starts):
            return
        values, items = index.windows[size]
        grams = windows_at(starts, size)
        lo, hi = np.searchsorted(values, grams, "left"), np.searchsorted(values, grams, "right")
        ok = hi > lo
        starts, lo, n = starts[ok], lo[ok], (hi - lo)[ok]
        if len(starts):
            hit_from.append(starts)
            hit_to.append(starts + size)
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            found.append(np.stack([np.repeat(row[starts], n), items[at]]))

    def windows_at(starts: np.ndarray, size: int) -> np.ndarray:
        return gram_hashes_at(words, starts, size)

    for size in index.windows:
        if len(words) < size:
            continue
        if size == window and len(index.kept):
            grams = gram_hashes(words, gram)
            spots = winnow(grams, window - gram + 1)
            spots = spots[starts_of(spots)]
            spots = spots[member(index.kept, grams[spots])]
            take(around(spots, words, row, size, gram), size)
        elif size < window:
            whole = gram_hashes(words, size)
            take(np.flatnonzero(member(index.windows[size][0], whole)), size)
    hit = np.zeros(len(words) + 1, np.int64)
    for s, e in zip(hit_from, hit_to, strict=True):
        np.add.at(hit, s, 1)
        np.add.at(hit, e, -1)
    hit = np.cumsum(hit)[:-1] > 0
    items = [np.zeros(0, np.int64)] * rows
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        for lo, hi in zip(b := starts_of(pairs[0]), [*b[1:], pairs.shape[1]], strict=True):
            ids = pairs[1][lo:hi]
            items[pairs[0][lo]] = ids[ids != NO_ID]
    return hit, items


def gram_hashes_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes at the given starts only."""
    return gram_hashes(words[starts[:, None] + np.arange(n)].ravel(), n)[::n] if len(starts) else np.zeros(0, np.uint64)


def around(spots: np.ndarray, words: np.ndarray, row: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Starts of the windows of size words within one row that a gram at one of the spots lies in."""
    starts = np.unique((spots[:, None] - np.arange(size - gram + 1)).ravel())
    starts = starts[(starts >= 0) & (starts <= len(words) - size)]
    return starts[row[starts] == row[starts + size - 1]]


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


ADDED = (T.StructField("n_words", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType())))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: n_words, hits (binary: a byte per word, 1 if hit) and the sorted ids of items that occur.

    keep names further columns of docs to pass on; such a column gives way to an added one of its name.
    """
    rows = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    return (looked_up if size <= broadcast_bytes else joined)(rows, items, window, gram)


def _out(b, names: list[str], schema: T.StructType, ends: np.ndarray, hit: np.ndarray, items: list) -> pa.RecordBatch:
    hits = [hit[a:z].astype(np.uint8).tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], schema.names)


def looked_up(rows: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """matches with a benchmark that is broadcast; the caller has checked its size."""
    index = rows.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in items.collect()], window, gram))
    schema = beside(rows.schema, *ADDED)
    names = schema.names[:-3]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j, d, o in pieces(data, offsets):
                words, row = words_of(d, o)
                hit, found = match(words, row, j - i, index.value, window, gram)
                yield _out(batch.slice(i, j - i), names, schema, np.cumsum(np.bincount(row, minlength=j - i)), hit, found)

    return rows.mapInArrow(run, schema)


def joined(rows: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """matches with a benchmark of any size: two joins by hash, of kept hashes and of windows.

    The benchmark's side of the first join has each hash once, so a hash that very many documents keep adds no rows
    and adaptive execution can split it.
    """
    rows = materialise(rows.withColumn("decontaminate_row", F.monotonically_increasing_id()))

    def list_windows(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                words, row = words_of(*utf8(b.column("text")))
                ids = b.column("item_id").to_pylist()
                first = np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))]
                out = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], []]
                for k in range(b.num_rows):
                    w = words[first[k] : first[k + 1]]
                    if not len(w):
                        continue
                    n = min(len(w), window)
                    whole = gram_hashes(w, n)
                    grams = gram_hashes(w, gram)
                    out[0].append(grams[winnow(grams, window - gram + 1)] if n == window else mix(whole ^ np.uint64(n)))
                    out[1].append(whole)
                    out[2] += [n] * len(whole)
                    out[3] += [ids[k]] * len(whole)
                yield pa.RecordBatch.from_arrays([as_long(np.concatenate(out[0])), as_long(np.concatenate(out[1])), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], ["key", "whole", "size", "item_id"])

    listed = materialise(items.mapInArrow(list_windows, "key long, whole long, size int, item_id long").distinct())
    sizes = [r[0] for r in listed.select("size").distinct().collect()]  # at most one for each length up to a window

    def spots(words, row, n):
        """Starts and keys of what a batch asks for windows of n words."""
        if n < window:
            at = np.arange(max(len(words) - n + 1, 0))
            at = at[row[at] == row[at + n - 1]] if len(at) else at
            return at, mix(gram_hashes(words, n)[at] ^ np.uint64(n)) if len(at) else np.zeros(0, np.uint64)
        if len(words) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = gram_hashes(words, gram)
        at = winnow(grams, window - gram + 1)
        at = at[starts_of(at)]
        return at, grams[at]

    def ask(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                words, row = words_of(*utf8(b.column("text")))
                own = b.column("decontaminate_row").to_numpy()
                for n in sizes:
                    at, keys = spots(words, row, n)
                    both = np.unique(np.stack([own[row[at]].astype(np.uint64), keys], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([as_long(np.ascontiguousarray(both[:, 0])), as_long(np.ascontiguousarray(both[:, 1]))], ["decontaminate_row", "key"])

    asked = rows.select("decontaminate_row", "text").mapInArrow(ask, "decontaminate_row long, key long")
    found = asked.join(listed.select("key").distinct(), "key", "left_semi").groupBy("decontaminate_row").agg(F.collect_set("key").alias("keys"))

    def extend(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                words, row = words_of(*utf8(b.column("text")))
                own = b.column("decontaminate_row").to_numpy()
                ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
                first = np.r_[0, ends[:-1]].astype(np.int64)
                keys = np.unique(b.column("keys").flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
                for n in sizes:
                    at, k = spots(words, row, n)
                    at = at[member(np.sort(keys), k)]
                    starts = around(at, words, row, n, gram) if n == window else at
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[starts]], pa.int64()), pa.array(starts - first[row[starts]], pa.int64()), as_long(gram_hashes_at(words, starts, n)), pa.array([n] * len(starts), pa.int32())], ["decontaminate_row", "start", "whole", "size"])

    near = rows.select("decontaminate_row", "text").join(found, "decontaminate_row").mapInArrow(extend, "decontaminate_row long, start long, whole long, size int")
    hit = near.join(listed.select("size", "whole", "item_id").distinct(), ["size", "whole"])
    spans = hit.groupBy("decontaminate_row").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    schema = beside(rows.drop("decontaminate_row").schema, *ADDED)
    names = schema.names[:-3]

    def mark(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                words, row = words_of(*utf8(b.column("text")))
                ends = np.cumsum(np.bincount(row, minlength=b.num_rows))
                edge = np.zeros(len(words) + 1, np.int64)
                for k, some in enumerate(b.column("decontaminate_spans").to_pylist()):
                    for x in some or ():
                        edge[ends[k - 1] * (k > 0) + x["start"]] += 1
                        edge[ends[k - 1] * (k > 0) + x["start"] + x["size"]] -= 1
                yield _out(b, names, schema, ends, np.cumsum(edge)[:-1] > 0, [x or [] for x in b.column("decontaminate_items").to_pylist()])

    named = spans.withColumnsRenamed({"spans": "decontaminate_spans", "items": "decontaminate_items"})
    return rows.join(named, "decontaminate_row", "left").mapInArrow(mark, schema)


def report(found: DataFrame) -> DataFrame:
    """n_hit, n_items, the digest of the items as sorted strings, and whether anything is hit."""

    def count(batches):
        for b in batches:
            n = [int(np.frombuffer(x, np.uint8).sum()) for x in b.column("hits").to_pylist()]
            sha = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for i in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(n, pa.int64()), pa.array([len(i) for i in b.column("items").to_pylist()], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(count, "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return report(matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
