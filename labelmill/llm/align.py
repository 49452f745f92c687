"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over all documents.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a ``sentencepiece`` model; both read a blank and the
text. Where a token of A and one of B end at the same byte, a group ends; tokens of one group are linked. Batches
of documents are worked on as Arrow columns:

* Texts are cut into segments where neither tokenizer can join what stands on both sides (a blank after a visible
  ASCII sign; checked against both vocabularies), different segments are encoded once (a worker keeps the last
  ``KEPT``), and lists of ids are taken by segment and flattened; parent indices lead from token to segment to document.
* Running sums of token lengths, less the sum at the document's start, are ends. A hash join of both sides on
  document and end gives the shared ends, from which groups are numbered; a hash join on the group gives the links.
* ``Table.group_by`` counts links by document and pair of ids, and documents by pair. These partial counts, one for
  each chunk of documents and pair, Spark adds up; the highest of an id of A is a window over at most B's vocabulary.
* Chunks ask for the counts of their pairs, packed by range of hashes; a range's counts are copied to as many tasks
  as the number of chunks demands, so no pair that every chunk holds meets in one task.

A group of many tokens is first counted by id, so that equal pairs in it are never listed one by one. Null and empty
texts, and texts that either tokenizer does not give back byte for byte, have no tokens. Rows are documents each on
its own, whatever their ids.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import beside
from .storage import materialise, parallelism
from .textbuf import batch_pieces, mix, utf8

#: Bytes of text of a chunk, and of those aligned at once; pairs a group may list one by one; ranges of hashes that counts are dealt over.
CHUNK, AT_ONCE, LISTED, RANGES = 8 << 20, 1 << 19, 64, 32
#: Encoded segments that a worker keeps, and bytes of the longest of them.
KEPT, KEPT_BYTES = 1 << 17, 48


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Both:
    """Two tokenizers, the bytes of their tokens, and whether texts may be cut into segments."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec, alphabet = json.loads(a_file), byte_alphabet()
        self.a = tokenizers.Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        extra = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.a_bytes = [extra[i] if i in extra else bytes(alphabet[c] for c in names.get(i, "")) for i in range(1 + max([*names, *extra]))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        split = spec["pre_tokenizer"] or {}
        self.cuts = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not any("▁" in p.lstrip("▁") for p in pieces)
        signs = [f"{i}{end}" for x, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(x))]
        self.signs = pa.array(signs, pa.large_string())
        self.names = [pa.array(x, pa.binary()) for x in (self.a_bytes, self.b_bytes)]
        self.forget()

    def key_space(self) -> int:
        return len(self.a_bytes) * len(self.b_bytes)

    def add(self, some: list[str]) -> None:
        """Encodes segments (they begin with a blank) and keeps the ids of both tokenizers, and whether both give the bytes back."""
        data, offsets = utf8(pa.array(some, pa.large_string()))
        ids = [e.ids for e in self.a.encode_batch_fast(some, add_special_tokens=False)], self.b.encode([s[1:] for s in some], num_threads=1)
        fits = np.ones(len(some), bool)
        for k, (lists, names, sizes) in enumerate(zip(ids, self.names, (self.a_sizes, self.b_sizes), strict=True)):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int32, n.sum())
            ends = np.r_[0, np.cumsum(n)]
            same = np.diff(np.r_[0, np.cumsum(sizes[flat])][ends]) == np.diff(offsets)  # as long; then byte for byte
            given = utf8(names.take(pa.array(flat[np.repeat(same, n)])))[0]
            row = np.repeat(np.arange(len(some)), np.diff(offsets))
            asked = same[row]
            same[row[asked][given != data[asked]]] = False
            fits &= same
            self.ids[k], self.ends[k] = np.r_[self.ids[k], flat], np.r_[self.ends[k], ends[1:] + self.ends[k][-1]]
        self.fits = np.r_[self.fits, fits]

    def encoded(self, segments: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """Lists of ids of A and of B, whether both give the bytes back, and the place of each segment among them."""
        if len(self.kept) > KEPT:
            self.forget()
        kept = self.kept
        place = np.fromiter((kept.get(s, -1) for s in segments), np.int64, len(segments))
        new = np.flatnonzero(place < 0)
        if len(new):
            first, some = len(self.fits), [segments[i] for i in new.tolist()]
            self.add(some)
            place[new] = np.arange(first, first + len(new))
            kept.update((s, first + k) for k, s in enumerate(some) if len(s) <= KEPT_BYTES)
        a, b = (pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(i)) for e, i in zip(self.ends, self.ids, strict=True))
        return a, b, self.fits, place

    def forget(self) -> None:
        self.kept: dict[str, int] = {}
        self.ids, self.ends, self.fits = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2, np.zeros(0, bool)


@lru_cache(1)
def _load(a_file: bytes, b_file: bytes) -> Both:
    return Both(a_file, b_file)


def segments_of(data: np.ndarray, offsets: np.ndarray, cuts: bool) -> np.ndarray:
    """Where segments of texts (end to end, each after a blank) begin, and the end: at each text's start and at each
    blank after a visible ASCII sign, unless only blanks follow in the text."""
    if not cuts or not len(data):
        return offsets
    at = np.flatnonzero((data[1:] == 32) & (data[:-1] > 32) & (data[:-1] < 127)) + 1
    solid = np.flatnonzero(data != 32)
    row = np.searchsorted(offsets, at, "right") - 1
    last = np.r_[-1, solid][np.searchsorted(solid, offsets[1:])]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = begins[at[last[row] > at]] = True
    return np.flatnonzero(begins)


@dataclass
class Aligned:
    """Tokens of some documents end to end: ids, document and group of each, and the groups' documents."""

    n: int
    a: np.ndarray
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_doc: np.ndarray


def aligned(texts: pa.ChunkedArray | pa.Array, both: Both) -> Aligned:
    """The alignment of each text; texts without tokens have none."""
    n = len(texts)
    full = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    data, offsets = utf8(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts.take(pa.array(full)), pa.scalar("", texts.type)))
    bounds = segments_of(data, offsets, both.cuts)
    spans = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(data)))
    coded = spans.dictionary_encode()
    a_of, b_of, fits, place = both.encoded(coded.dictionary.to_pylist())
    segment = place[coded.indices.to_numpy()]
    seg_doc = np.searchsorted(offsets, bounds[:-1], "right") - 1
    bad = np.unique(seg_doc[~fits[segment]])
    # Bytes that one segment lacks may only be made up for by another of the same text.
    whole = lambda d, lists, names: b"".join(names[i] for i in lists.take(pa.array(segment[seg_doc == d])).flatten().to_pylist())
    bad = [d for d in bad.tolist() if any(whole(d, *x) != data[offsets[d] : offsets[d + 1]].tobytes() for x in ((a_of, both.a_bytes), (b_of, both.b_bytes)))]
    good = ~np.isin(seg_doc, bad) if bad else slice(None)
    taken, seg_doc = pa.array(segment[good]), seg_doc[good]

    def side(lists: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, documents and ends within the document of all tokens."""
        some = lists.take(taken)
        ids, doc = some.flatten(), seg_doc[pc.list_parent_indices(some).to_numpy()]
        size = pc.take(pa.array(sizes), ids)
        ends = pc.cumulative_sum(size).to_numpy()
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        before = np.repeat(ends[first] - size.to_numpy()[first], np.diff(np.r_[first, len(doc)]))
        return ids.to_numpy(), doc, ends - before

    (a, a_doc, a_end), (b, b_doc, b_end) = side(a_of, both.a_sizes), side(b_of, both.b_sizes)
    left = pa.table({"doc": a_doc.astype(np.int32), "end": a_end, "i": np.arange(len(a))})
    right = pa.table({"doc": b_doc.astype(np.int32), "end": b_end, "j": np.arange(len(b))})
    shared = left.join(right, ["doc", "end"], join_type="inner", use_threads=False)
    a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_last[shared.column("i").to_numpy()] = True
    b_last[shared.column("j").to_numpy()] = True
    return Aligned(n, a, b, full[a_doc], full[b_doc], np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last, full[a_doc[a_last]])


def links(x: Aligned, both: Both) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair (a times B's size, plus b) and number of links of each pair in each document, in order."""
    groups = len(x.group_doc)
    many = np.bincount(x.a_group, minlength=groups) * np.bincount(x.b_group, minlength=groups) > LISTED

    def of(group: np.ndarray, ids: np.ndarray, name: str, large: bool) -> pa.Table:
        at = many[group] == large
        t = pa.table({"group": group[at], name: ids[at].astype(np.int64)})
        return t.group_by(["group", name], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"]) if large else t

    found = []
    for large in (False, True) if many.any() else (False,):
        t = of(x.a_group, x.a, "a", large).join(of(x.b_group, x.b, "b", large), "group", join_type="inner", use_threads=False)
        times = t.column("n_a").to_numpy() * t.column("n_b").to_numpy() if large else np.ones(len(t), np.int64)
        pair = x.group_doc[t.column("group").to_numpy()] * both.key_space() + t.column("a").to_numpy() * len(both.b_bytes) + t.column("b").to_numpy()
        found.append(pa.table({"pair": pair, "times": times}))
    t = pa.concat_tables(found).group_by("pair", use_threads=False).aggregate([("times", "sum")]).sort_by("pair")
    pair, times = t.column("pair").to_numpy(), t.column("times_sum").to_numpy()
    return pair // both.key_space(), pair % both.key_space(), times


def digests(x: Aligned, both: Both) -> list[str]:
    """Per document the digest of its groups, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    groups, (n_a, n_b) = len(x.group_doc), (len(both.a_bytes), len(both.b_bytes))
    a_first, b_first = (np.searchsorted(g, np.arange(groups + 1)) for g in (x.a_group, x.b_group))
    last = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool)
    order = np.empty(len(x.a) + len(x.b), np.int64)
    order[np.arange(len(x.a)) + b_first[x.a_group]] = x.a + n_a * last(x.a_group)
    order[np.arange(len(x.b)) + a_first[x.b_group + 1]] = 2 * n_a + x.b + n_b * last(x.b_group)
    data, at = utf8(both.signs.take(pa.array(order)))
    view = memoryview(np.ascontiguousarray(data))
    ends = np.searchsorted(x.a_doc, np.arange(x.n + 1)) + np.searchsorted(x.b_doc, np.arange(x.n + 1))
    place = at[ends].tolist()
    return [hashlib.sha256(view[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(place[:-1], place[1:], strict=True)]


def small(values: np.ndarray) -> bytes:
    """Numbers (zstd), with their size before them."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def large(packed: bytes, kind) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)


CHUNKS = "chunk bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, n_pairs binary, pairs binary, times binary, keys binary, n_docs binary"


def _files(spark: SparkSession, *paths: str):
    """The tokenizers' files (of fixed size, a parameter), broadcast."""
    found = []
    for p in paths:
        with open(p, "rb") as f:
            found.append(f.read())
    return spark.sparkContext.broadcast(tuple(found))


def chunks(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of documents: figures of each document, its pairs as places among the chunk's pairs
    (keys) with their numbers of links, and in how many of the chunk's documents each pair is."""
    files = _files(docs.sparkSession, a_path, b_path)

    def run(batches):
        both, number, held, size = _load(*files.value), TaskContext.get().partitionId() << 32, [], 0

        def row():
            doc, key, times = (np.concatenate(z) for z in zip(*(h[2] for h in held), strict=True))
            t = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")]).sort_by("key")
            keys = t.column("key").to_numpy()
            figures = [np.concatenate(z).tolist() for z in zip(*(h[1] for h in held), strict=True)]
            place = np.searchsorted(keys, key).astype(np.uint32)
            n_pairs = np.concatenate([np.bincount(h[2][0], minlength=len(h[3])) for h in held]).astype(np.uint32)
            packed = (small(n_pairs), small(np.diff(place, prepend=np.uint32(0))), small(times.astype(np.uint32)), small(np.diff(keys, prepend=0)), small(t.column("count_all").to_numpy().astype(np.uint32)))
            values = (number, [i for h in held for i in h[0]], *figures, [s for h in held for s in h[3]], *packed)
            kinds = (pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.binary()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for b in batch_pieces(batch, "text", AT_ONCE):
                x = aligned(b.column("text"), both)
                found = links(x, both)
                count = lambda at, w=None, n=x.n: np.bincount(at, w, n).astype(np.int64)
                figures = (count(x.a_doc), count(x.b_doc), count(x.group_doc), count(found[0], found[2]))
                held.append((b.column("doc_id").to_pylist(), figures, found, digests(x, both)))
                size += utf8(b.column("text"))[1][-1]
                if size >= chunk:
                    yield row()
                    number, held, size = number + 1, [], 0
        if held:
            yield row()

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """Of each pair of ids linked anywhere: a, b, n_docs (in how many documents), and whether no b' has more with a."""

    def listed(batches):
        for batch in batches:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n_docs").to_pylist(), strict=True):
                key = np.cumsum(large(keys, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((key // n_b).astype(np.int32)), pa.array((key % n_b).astype(np.int32)), pa.array(large(n, np.uint32).astype(np.int64))], ["a", "b", "n_docs"])

    every = found.select("keys", "n_docs").mapInArrow(listed, "a int, b int, n_docs bigint").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"))
    return every.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def answered(found: DataFrame, counts: DataFrame, n_b: int, ranges: int, copies: int) -> DataFrame:
    """To each chunk the counts of its keys, in ranges of their hashes: chunk, part, n_docs and best (binary)."""
    range_of = lambda key: (mix(key.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)

    def ask(batches):
        for batch in batches:
            for chunk, keys in zip(batch.column("chunk").to_pylist(), batch.column("keys").to_pylist(), strict=True):
                key = np.cumsum(large(keys, np.int64))
                part = range_of(key)
                some = np.unique(part).tolist()
                copy = int(mix(np.array([chunk], np.uint64))[0]) % copies
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([copy] * len(some), pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([small(np.diff(key[part == p], prepend=0)) for p in some], pa.binary())], ["part", "copy", "chunk", "keys"])

    def deal(batches):
        for batch in batches:
            key = batch.column("a").to_numpy().astype(np.int64) * n_b + batch.column("b").to_numpy()
            n, best, part = batch.column("n_docs").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False), range_of(key)
            for p in np.unique(part).tolist():
                at = part == p
                kept = [small(v[at]) for v in (key, n, best)]
                yield pa.RecordBatch.from_arrays([pa.array([p] * copies, pa.int32()), pa.array(range(copies), pa.int32()), *(pa.array([v] * copies, pa.binary()) for v in kept)], ["part", "copy", "keys", "n_docs", "best"])

    def answer(_, asked: pa.Table, known: pa.Table) -> pa.Table:
        key, n, best = (np.concatenate([np.zeros(0, k), *(large(v, k) for v in known.column(c).to_pylist())]) for c, k in (("keys", np.int64), ("n_docs", np.int64), ("best", bool)))
        order = np.argsort(key)
        key, n, best = key[order], n[order], best[order]
        at = [np.searchsorted(key, np.cumsum(large(v, np.int64))) for v in asked.column("keys").to_pylist()]
        return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "n_docs": pa.array([small(n[i]) for i in at], pa.binary()), "best": pa.array([small(best[i]) for i in at], pa.binary())})

    asked = found.select("chunk", "keys").mapInArrow(ask, "part int, copy int, chunk bigint, keys binary")
    dealt = counts.mapInArrow(deal, "part int, copy int, keys binary, n_docs binary, best binary")
    return asked.groupBy("part", "copy").cogroup(dealt.groupBy("part", "copy")).applyInArrow(answer, "chunk bigint, part int, n_docs binary, best binary")


ALIGNMENT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def alignment(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, ranges: int = RANGES) -> DataFrame:
    """Per row of docs (doc_id, text): numbers of tokens, groups and links, how many links have the highest count of
    their A id, the sum of the counts over links, and the digest of the groups."""
    spark = docs.sparkSession
    found = materialise(chunks(docs, a_path, b_path, chunk))
    n_b = len(_load(*_files(spark, a_path, b_path).value).b_bytes)
    counts = materialise(pair_counts(found, n_b))
    answers = answered(found, counts, n_b, ranges, max(1, parallelism(spark) // ranges))

    def finish(_, own: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in own.to_pylist():
            key = np.cumsum(large(r["keys"], np.int64))
            part = (mix(key.astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
            n, best = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            for t in told.to_pylist():
                at = part == t["part"]
                n[at], best[at] = large(t["n_docs"], np.int64), large(t["best"], bool)
            place, times = np.cumsum(large(r["pairs"], np.uint32), dtype=np.uint32), large(r["times"], np.uint32).astype(np.int64)
            ends = np.r_[0, np.cumsum(large(r["n_pairs"], np.uint32), dtype=np.int64)]
            total = lambda v, e=ends: np.diff(np.r_[0, np.cumsum(v)][e])
            sums = (total(times * best[place]), total(times * n[place]))
            out.append(pa.table([pa.array(r["doc_id"], pa.int64()), *(pa.array(r[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), pa.array(r["groups_sha256"], pa.string())], names))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.string() if c == names[-1] else pa.int64()) for c in names})

    names = [c.split()[0] for c in ALIGNMENT.split(", ")]
    return found.drop("n_docs").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, ALIGNMENT)


def with_alignment(df: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """df with a_ids, b_ids (the tokens of each text) and a_group, b_group (the number of each token's group, from 0)."""
    from pyspark.sql import types as T

    added = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a_ids", "b_ids", "a_group", "b_group")]
    files, schema = _files(df.sparkSession, a_path, b_path), beside(df.schema, *added)
    names = schema.names[:-4]

    def run(batches):
        both = _load(*files.value)
        for batch in batches:
            for b in batch_pieces(batch, text_col, AT_ONCE):
                x = aligned(b.column(text_col), both)
                first = np.searchsorted(x.group_doc, np.arange(x.n))
                columns = []
                for doc, values in ((x.a_doc, x.a), (x.b_doc, x.b), (x.a_doc, x.a_group - first[x.a_doc]), (x.b_doc, x.b_group - first[x.b_doc])):
                    at = np.searchsorted(doc, np.arange(x.n + 1)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *columns], schema.names)

    return df.mapInArrow(run, schema)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_paths())
