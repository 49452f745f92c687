"""Ranked lexical search: the best documents for each query item, by an inverted index in chunks of documents.

The index has a row for each chunk of documents: their ids and lengths, and of each term the documents that hold it
and how often. Sums over all chunks give the number of documents, their length, and how many documents hold a term.
A document's score is the sum over the item's terms, once each, of

    w * ((1000000000 * tf) div (1000 * tf + 8 * m)),  w = floor(1000 ln((2 N + 2) / (2 df + 1))),  m = 100 - 90 + (90 n N) div L,

whole numbers but for w. In each chunk all items are worked through by a hybrid of two ways:

* Term at a time: an item's short lists (in a chunk, at most a ``SHORT``-th of its documents) are added up into
  accumulators, whose sums are one more list, with a bound for each block of ``BLOCK`` documents like any other; the
  k-th of them is the first threshold.
* Document at a time: blocks are taken in order of documents; one whose bounds (of the accumulators and the long
  lists) stay below the threshold is skipped, and within a block lists are added from the greatest bound on until the
  rest can lift no document to the threshold. The threshold rises with the k-th best score so far.

Each chunk gives its k best for each item, of which the k best are kept. Chunks hold about ``CHUNK`` bytes of text;
queries come in blocks of at most about ``QUERY_TERMS`` terms, each broadcast and taken over the whole index, so
both sides may grow.

Null texts have no terms. Rows are documents each on its own, whatever their ids; a document without an id is ranked
after others of its score. Rows of items with equal ids are one item; an item without terms, or that nothing matches,
has no result. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exchange import joined
from .storage import materialise
from .textbuf import ALNUM, LOWER, batch_pieces, span_hashes, starts_of, utf8, word_bounds

CHUNK, BLOCK, SHORT, QUERY_TERMS = 8 << 20, 64, 8, 1 << 20
#: Shares of a document's length in its score (in hundredths), and the weight of m beside tf (tf counts 1000).
FIXED, BY_LENGTH, SATURATION = 10, 90, 8
INDEX = "chunk bigint, doc_id array<bigint>, n_docs bigint, n_terms bigint, sizes binary, terms binary, ends binary, docs binary, tf binary"


def terms_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term of a column."""
    data, offsets = utf8(texts)
    low = LOWER[data]
    s, e, row = word_bounds(low, offsets, ALNUM)
    return span_hashes(low, s, e), row


def _packed(values: np.ndarray, kind) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype(kind)).tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def build(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder."""

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row():
            ids = [i for h in held for i in h[0]]
            h, of = joined([x[1] for x in held]), joined([x[2] + b for x, b in zip(held, np.cumsum([0, *(len(x[0]) for x in held)]), strict=False)], np.int64)
            by_id = np.array(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0)), np.int64)  # ties go to the smaller id
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            of = rank[of]
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, np.int64)
            tf, h, of, sizes = np.diff(np.r_[first, len(h)]), h[first], of[first], np.bincount(of, minlength=len(ids))
            lists = starts_of(h)
            values = (number, [ids[k] for k in by_id.tolist()], int((sizes > 0).sum()), int(sizes.sum()), _packed(sizes, np.uint32), _packed(h[lists], np.uint64), _packed(np.r_[lists[1:], len(h)] if len(h) else lists, np.uint32), _packed(np.diff(of, prepend=0), np.int32), _packed(tf, np.uint32))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for b in batch_pieces(batch, "text"):
                held.append((b.column("doc_id").to_pylist(), *terms_of(b.column("text"))))
                size += utf8(b.column("text"))[1][-1]
                if size >= chunk:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX))


class Chunk:
    """One row of the index, with the postings of the terms asked for and what each gives to a score."""

    def __init__(self, row: dict, asked: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """asked: sorted terms, with their weights. n_docs and n_terms: of all chunks together."""
        self.ids, self.n = row["doc_id"], len(row["doc_id"])
        self.held, self.number = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
        if not row["n_terms"]:
            return
        terms, ends, docs, tf, sizes = _lists(row)
        at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
        self.held = terms[at] == asked
        at = at[self.held]
        begin = np.r_[0, ends[:-1]][at]
        count = ends[at] - begin
        self.start = np.r_[0, np.cumsum(count)]
        place = np.repeat(begin - self.start[:-1], count) + np.arange(self.start[-1])
        self.docs, tf = docs[place].astype(np.int64), tf[place].astype(np.int64)
        m = FIXED + (BY_LENGTH * sizes.astype(np.int64) * n_docs) // max(n_terms, 1)
        self.gain = np.repeat(weights[self.held], count) * ((1_000_000_000 * tf) // (1000 * tf + SATURATION * m[self.docs]))
        self.number = np.cumsum(self.held) - 1
        # Blocks of each list: which, where they start, and the greatest gain.
        self.blocks = -(-self.n // BLOCK)
        of = np.repeat(np.arange(len(at)), count) * self.blocks + self.docs // BLOCK
        edge = starts_of(of)
        self.bound = np.zeros(len(at) * self.blocks, np.int64)
        self.bound[of[edge]] = np.maximum.reduceat(self.gain, edge)
        self.bound = self.bound.reshape(len(at), self.blocks)
        self.cut = np.searchsorted(of, np.arange(len(at) * self.blocks + 1))

    def best(self, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents (places, of equal scores the smallest) and their scores, for terms given by place."""
        lists = self.number[wanted[self.held[wanted]]]
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.start[lists + 1] - self.start[lists]
        short, long = lists[size * SHORT <= self.n], lists[size * SHORT > self.n]
        sums, bound = np.zeros(self.n, np.int64), np.zeros(self.blocks, np.int64)
        if len(short):
            for x in short.tolist():
                a, b = self.start[x], self.start[x + 1]
                sums[self.docs[a:b]] += self.gain[a:b]  # a list has a document once
            bound = np.maximum.reduceat(sums, np.arange(0, self.n, BLOCK))
        if not len(long):
            return _top(np.flatnonzero(sums), sums[sums > 0], k)
        floor = int(np.partition(sums, self.n - k)[self.n - k]) if self.n >= k else 0
        total = bound + self.bound[long].sum(0)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in np.flatnonzero((total >= floor) & (total > 0)).tolist():
            if total[block] < floor:
                continue
            base = block * BLOCK
            own, left = sums[base : base + BLOCK].copy(), int(total[block] - bound[block])
            greatest = self.bound[long, block]
            for j in np.argsort(-greatest, kind="stable").tolist():
                if own.max() + left < floor or not greatest[j]:
                    break
                cell = long[j] * self.blocks + block
                a, b = self.cut[cell], self.cut[cell + 1]
                own[self.docs[a:b] - base] += self.gain[a:b]
                left -= int(greatest[j])
            if left and own.max() + left < floor:
                continue
            some = np.flatnonzero((own >= floor) & (own > 0))
            if len(some):
                found, scores = _top(np.r_[found, some + base], np.r_[scores, own[some]], k)
                if len(scores) == k:
                    floor = max(floor, int(scores[-1]))
        return found, scores


def _lists(row: dict) -> tuple[np.ndarray, ...]:
    """Terms, ends of their lists, documents, counts and sizes of a row."""
    terms = np.frombuffer(_all(row["terms"]), np.uint64)
    ends = _unpacked(row["ends"], len(terms), np.uint32).astype(np.int64)
    n = int(ends[-1])
    docs = np.cumsum(_unpacked(row["docs"], n, np.int32), dtype=np.int64)
    return terms, ends, docs, _unpacked(row["tf"], n, np.uint32), _unpacked(row["sizes"], len(row["doc_id"]), np.uint32)


def _all(packed: bytes) -> bytes:
    """A zstd frame of unknown size."""
    return pa.CompressedInputStream(pa.BufferReader(packed), "zstd").read()


def _top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def query_terms(items: DataFrame) -> DataFrame:
    """The different terms of each item: item_id, term."""

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                h, row = terms_of(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "term"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id bigint, term bigint").distinct()


def document_frequencies(index: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """In how many documents each of the terms asked for is; at most one number for each of them."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                if r["n_terms"]:
                    terms = np.frombuffer(_all(r["terms"]), np.uint64)
                    n = np.diff(_unpacked(r["ends"], len(terms), np.uint32).astype(np.int64), prepend=0)
                    at = np.minimum(np.searchsorted(terms, shared.value), len(terms) - 1)
                    there = terms[at] == shared.value
                    yield pa.RecordBatch.from_arrays([pa.array(shared.value[there].view(np.int64)), pa.array(n[at[there]])], ["term", "df"])

    found = index.select("n_terms", "terms", "ends").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r["term"]: r["df"] for r in found.collect()}


def search(index: DataFrame, items: DataFrame, k: int = 10, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """The k best documents of each item (item_id, text): item_id, rank, doc_id, score."""
    spark = index.sparkSession
    wanted = materialise(query_terms(items))
    rounds = -(-wanted.count() // query_terms_at_once)
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    out = None
    for block in range(rounds if n_docs else 0):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == block).collect()  # about query_terms_at_once
        if rows:
            found = _best(index, rows, n_docs, n_terms, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _best(index: DataFrame, rows: list, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Of each chunk the k best documents of each item; rows: (item_id, term)."""
    terms = np.array([r["term"] for r in rows], np.int64).view(np.uint64)
    asked, number = np.unique(terms, return_inverse=True)
    df = document_frequencies(index, asked)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in asked.view(np.int64).tolist()], np.int64)
    by_item: dict = {}
    for r, t in zip(rows, number.tolist(), strict=True):
        by_item.setdefault(r["item_id"], []).append(t)
    queries = [(i, np.array(sorted(t), np.int64)) for i, t in by_item.items()]
    shared = index.sparkSession.sparkContext.broadcast((asked, weights, queries))  # about query_terms_at_once terms

    def run(batches):
        asked, weights, queries = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                chunk = Chunk(r, asked, weights, n_docs, n_terms)
                found = [(i, *chunk.best(t, k)) for i, t in queries]
                items = [i for i, d, _ in found for _ in range(len(d))]
                docs = [chunk.ids[d] for _, ds, _ in found for d in ds.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64()), pa.array(np.concatenate([s for *_, s in found]), pa.int64())], ["item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, whole GROUP BY term),
gains AS (SELECT item_id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * all_docs) // all_terms))) AS gain
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole),
scores AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM gains GROUP BY ALL HAVING sum(gain) > 0),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 10
"""
