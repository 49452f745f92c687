"""Language-model scores from a log-frequency Bloom filter.

Words and pairs of words are counted over all training documents. The filter holds, for an n-gram of
count c, the items (n-gram, 1) ... (n-gram, level) with level = 1 + floor(2 log2(c / least)): a few
probes until the first miss give the count back, quantised. Every n-gram seen enters it (least is 1),
and it has ``ITEM_BITS`` bits for each item, so it grows with the corpus. It is cut into shards by the
leading bits of the n-gram's hash, each as large as its items need, so it has no size that could be broadcast whole: the
shards are stored as a table by range of hashes (``Model``), and go to the tasks that ask them. Batches of documents ask
for their words, then for their pairs, by range (see exchange). The task that fills a range's shards from the training
counts answers the training batches from them at once; ``apply`` joins the stored shards with the questions of any other
documents, and gives the same scores. Shards don't depend on the number of ranges. Texts are scored with an interpolated
two-word model. A level stands for the least count it can come from, q, and for the greatest, u:

    p(w) = (q(w) + 0.1) / (Q + 0.1 (V + 1)), Q the sum of q over the V distinct training tokens,
    p(w after v) = (1 - weight) p(w) + weight q(v, w) / u(v); p(w) alone if v is unknown.

p(w) sums to 1 over the training tokens and one unknown, p(w after v) to at most 1, as q never exceeds a count and u is
never less (both but for false hits of the filter, about 1 in 700 probes of absent n-grams).

The exact counts behind ``base_score`` come back with the words' levels.

A text's tokens are its words and one end. Null text counts as empty and has the end only. Words are
known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import in_batches, in_order, joined, packed, unpacked
from .langid import remainder
from .storage import materialise, parallelism
from .textbuf import LOWER, NOT_BLANK, mix, pieces, span_hashes, starts_of, utf8, word_bounds

#: FILTER_BITS is the width of a filter in one piece, where none is given.
FILTER_BITS, PROBES, WEIGHT = 1 << 25, 5, 0.25
#: Bits of a shard for each item and at least; leading bits of a hash that name its shard; n-grams worked on at once.
ITEM_BITS, LEAST_BITS, SHARD_BITS, AT_ONCE = 16, 64, 16, 1 << 17
END = np.uint64(0xE0D0F7E87E9D1357)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token of a batch, ends included, in order."""
    data, offsets = utf8(table.column("text"))
    hashes, rows = [], []
    for i, j, d, o in pieces(data, offsets):
        low = LOWER[d]
        s, e, row = word_bounds(low, o, NOT_BLANK)
        n = np.bincount(row, minlength=j - i)
        at = np.cumsum(n)
        hashes.append(np.insert(span_hashes(low, s, e), at, END))
        rows.append(np.repeat(np.arange(i, j), n + 1))
    return joined(hashes), joined(rows, np.int64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * _PAIR) ^ (b + _STEP))


def levels(counts: np.ndarray, least: int) -> np.ndarray:
    """The quantised logarithm of counts: 0 below least."""
    return np.where(counts >= least, 1 + np.floor(2 * np.log2(np.maximum(counts, 1) / least) + 1e-9), 0).astype(np.int64)


def items(keys: np.ndarray, level: np.ndarray, first=0, width=FILTER_BITS) -> np.ndarray:
    """The positions in the filter of all items of the n-grams."""
    n = np.repeat(keys, level)
    nth = np.arange(len(n)) - np.repeat(np.cumsum(level) - level, level) + 1
    return positions(n, nth, *(np.repeat(np.broadcast_to(x, keys.shape), level) for x in (first, width))).ravel()


def positions(keys: np.ndarray, level, first=0, width=FILTER_BITS) -> np.ndarray:
    """Where the items are, in shards of width bits that start at bit first (numbers, or one for each key)."""
    h = mix(keys + np.asarray(level, np.uint64) * _STEP)
    step = mix(h) | np.uint64(1)
    first, width = np.asarray(first, np.uint64), np.asarray(width, np.uint64)
    return np.stack([first + (h + np.uint64(i) * step) % width for i in range(PROBES)], 1)


def told(bits: np.ndarray, keys: np.ndarray, first=0, width=FILTER_BITS) -> np.ndarray:
    """Levels as the filter tells them; 0 for what it does not hold."""
    level, asking = np.zeros(len(keys), np.int64), np.arange(len(keys))
    first, width = np.broadcast_to(first, keys.shape), np.broadcast_to(width, keys.shape)
    while len(asking) and level.max(initial=0) < 200:
        p = positions(keys[asking], level[asking] + 1, first[asking], width[asking])
        there = ((bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(1)
        asking = asking[there]
        level[asking] += 1
    return level


def as_counts(level: np.ndarray, least: int = 1) -> np.ndarray:
    """The least count that a level stands for."""
    return np.where(level > 0, np.ceil(least * 2.0 ** ((level.astype(np.float64) - 1) / 2) - 1e-9), 0.0)


def most_counts(level: np.ndarray) -> np.ndarray:
    """The greatest count that a level stands for."""
    return np.where(level > 0, np.ceil(2.0 ** (level.astype(np.float64) / 2) - 1e-9) - 1, 0.0)


def estimate(bits: np.ndarray, keys: np.ndarray, least: int) -> np.ndarray:
    """Counts as the filter tells them; 0 for what it does not hold."""
    return as_counts(told(bits, keys), least)


def shards_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the shards of all these n-grams tell of each, and the shards: numbers, widths and bits end to end (bytes). keys:
    distinct, in order, whole shards; count 0 does not enter."""
    level, out = levels(counts, 1), np.zeros(len(keys), np.uint8)
    start = starts_of(keys >> np.uint64(64 - SHARD_BITS))
    if not len(keys):
        return out, np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    width = np.maximum(np.add.reduceat(level, start) * ITEM_BITS, LEAST_BITS)  # whole bytes
    edge, i, bits = np.r_[start, len(keys)], 0, []
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + AT_ONCE, "right")) - 1)
        own, n, some = width[i:j], np.diff(edge[i : j + 1]), slice(edge[i], edge[j])
        first, wide = np.repeat(np.cumsum(own) - own, n), np.repeat(own, n)
        flags = np.zeros(own.sum(), bool)
        flags[items(keys[some], level[some], first, wide)] = True
        bits.append(np.packbits(flags, bitorder="little"))
        out[some] = told(bits[-1], keys[some], first, wide)
        i = j
    return out, (keys[start] >> np.uint64(64 - SHARD_BITS)).astype(np.uint32), width, np.concatenate(bits)


def shard_levels(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return shards_of(keys, counts)[0]


def told_by(shards: np.ndarray, widths: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of n-grams as stored shards tell them; 0 where there is no shard."""
    out = np.zeros(len(keys), np.uint8)
    if len(shards) and len(keys):
        of = (keys >> np.uint64(64 - SHARD_BITS)).astype(np.uint32)
        at = np.minimum(np.searchsorted(shards, of), len(shards) - 1)
        there = shards[at] == of
        first = np.cumsum(widths) - widths
        for lo in range(0, len(keys), AT_ONCE):
            some = np.flatnonzero(there[lo : lo + AT_ONCE]) + lo
            out[some] = told(bits, keys[some], first[at[some]], widths[at[some]])
    return out


def shard_ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n ranges of whole shards starts in sorted keys, and the end."""
    bounds = np.array([-(-(k << SHARD_BITS) // n) for k in range(1, n)], np.uint64)
    return np.r_[0, np.searchsorted(keys >> np.uint64(64 - SHARD_BITS), bounds), len(keys)]


ASKED = "batch bigint, part int, keys binary, counts binary"
ANSWERS = "batch bigint, part int, counts binary, levels binary, n_tokens bigint, n_types bigint, n_quantised double, shards binary, widths binary, bits binary"


def _asked(batch: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    cut = shard_ranges(keys, parts)
    some = [k for k in range(parts) if cut[k] < cut[k + 1]]
    return pa.table({"batch": pa.array([batch] * len(some), pa.int64()), "part": pa.array(some, pa.int32()), "keys": pa.array([packed(keys[cut[k] : cut[k + 1]]) for k in some], pa.binary()), "counts": pa.array([packed(counts[cut[k] : cut[k + 1]].astype(np.uint32)) for k in some], pa.binary())})


def _answered(table: pa.Table, exact: bool) -> pa.Table:
    """To each batch the levels, and if asked for the exact counts, of its keys; under batch -1 the range's sums and shards."""
    asked = unpacked(table.column("keys"))
    keys, inverse = np.unique(joined(asked), return_inverse=True)
    totals = np.bincount(inverse, joined(unpacked(table.column("counts"), np.uint32), np.uint32), len(keys)).astype(np.uint64)
    ends = np.cumsum([len(a) for a in asked])[:-1]
    levels_of, shards, widths, bits = shards_of(keys, totals)
    told_levels = np.split(levels_of[inverse], ends)
    n, part = len(asked), table.column("part")[0].as_py()
    return pa.table({
        "batch": pa.array([*table.column("batch").to_pylist(), -1], pa.int64()),
        "part": pa.array([part] * (n + 1), pa.int32()),
        "counts": pa.array([*((packed(x) for x in np.split(totals[inverse], ends)) if exact else [None] * n), None], pa.binary()),
        "levels": pa.array([*(packed(x) for x in told_levels), None], pa.binary()),
        "n_tokens": pa.array([None] * n + [int(totals.sum())], pa.int64()),
        "n_types": pa.array([None] * n + [int((totals > 0).sum())], pa.int64()),
        "n_quantised": pa.array([None] * n + [float(as_counts(levels_of[totals > 0]).sum())], pa.float64()),
        **{name: pa.array([None] * n + [packed(v)], pa.binary()) for name, v in (("shards", shards), ("widths", widths), ("bits", bits))},
    })


def word_counts(docs: DataFrame, parts: int) -> DataFrame:
    """Training counts and levels of words: to each batch those it asks for."""

    def ask(table: pa.Table) -> pa.Table:
        t = in_order(table)
        h, row = tokens(t)
        keys, inverse = np.unique(h, return_inverse=True)
        counts = np.bincount(inverse, t.column("train").to_numpy().astype(bool)[row], len(keys))
        return _asked(t.column("batch")[0].as_py(), keys, counts, parts)

    def answer(table: pa.Table) -> pa.Table:
        return _answered(table, True)

    return docs.groupBy("batch").applyInArrow(ask, ASKED).groupBy("part").applyInArrow(answer, ANSWERS)


def _known(table: pa.Table, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's tokens, their rows, and their counts (as far as asked for) and levels."""
    h, row = tokens(table)
    keys, inverse = np.unique(h, return_inverse=True)
    answers = answers.sort_by("part")
    counts, level = joined(unpacked(answers.column("counts").drop_null())), joined(unpacked(answers.column("levels"), np.uint8), np.uint8)
    if len(level) != len(keys):
        raise ValueError("a batch's answers don't fit its words")
    return h, row, counts[inverse] if len(counts) else counts, level[inverse]


def _pairs(h: np.ndarray, row: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Which tokens follow another of their text, both in the filter."""
    return np.flatnonzero((row[1:] == row[:-1]) & (level[1:] > 0) & (level[:-1] > 0)) + 1


def pair_counts(docs: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """Levels of pairs of words: to each batch those it asks for."""

    def ask(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        t = in_order(table)
        h, row, _, level = _known(t, answers)
        at = _pairs(h, row, level)
        keys, inverse = np.unique(pair_keys(h[at - 1], h[at]), return_inverse=True)
        counts = np.bincount(inverse, t.column("train").to_numpy().astype(bool)[row[at]], len(keys))
        return _asked(t.column("batch")[0].as_py(), keys, counts, parts)

    def answer_pairs(table: pa.Table) -> pa.Table:
        return _answered(table, False)

    asked = docs.groupBy("batch").cogroup(words.where("batch >= 0").groupBy("batch")).applyInArrow(ask, ASKED)
    return asked.groupBy("part").applyInArrow(answer_pairs, ANSWERS)


@dataclass
class Model:
    """A filter's shards by range (columns pair, part, shards, widths, bits), the number of ranges, and the sums behind p(w)."""

    shards: DataFrame
    parts: int
    tokens: int
    types: int
    quantised: float

    def save(self, path: str) -> None:
        self.shards.withColumns({k: F.lit(getattr(self, k)) for k in ("parts", "tokens", "types", "quantised")}).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.parquet(path)
        known = rows.select("parts", "tokens", "types", "quantised").first()
        return cls(rows.select(*SHARDS), *known) if known else cls(rows.select(*SHARDS), 1, 0, 0, 0.0)


SHARDS = ("pair", "part", "shards", "widths", "bits")


def _counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, Model]:
    """Texts by batch, the answers for their words and pairs, and the model of those with train true."""
    parts = parallelism(docs.sparkSession)
    texts = in_batches(docs, "doc_id", "text", "train")
    words = materialise(word_counts(texts, parts))
    sums = words.where("batch = -1").agg(F.sum("n_tokens"), F.sum("n_types"), F.sum("n_quantised")).first()
    pairs = materialise(pair_counts(texts, words, parts))
    words, pairs = words.withColumn("pair", F.lit(False)), pairs.withColumn("pair", F.lit(True))
    return texts, words, pairs, Model(words.unionByName(pairs).where("batch = -1").select(*SHARDS), parts, *(x or 0 for x in sums))


def fit(docs: DataFrame) -> Model:
    """The model of docs (doc_id, text, and train: those that count)."""
    return _counted(docs)[3]


def probabilities(h: np.ndarray, row: np.ndarray, level: np.ndarray, answers: pa.Table, model: tuple[int, int, float], weight: float) -> np.ndarray:
    """The probability of each token, from the levels of words and the answers for pairs."""
    _, types, quantised = model
    p = (as_counts(level) + 0.1) / (quantised + 0.1 * (types + 1))
    p[np.flatnonzero((row[1:] == row[:-1]) & (level[:-1] > 0)) + 1] *= 1 - weight
    ask = _pairs(h, row, level)
    k, back = np.unique(pair_keys(h[ask - 1], h[ask]), return_inverse=True)
    held = joined(unpacked(answers.filter(answers.column("pair")).sort_by("part").column("levels"), np.uint8), np.uint8)
    if len(held) != len(k):
        raise ValueError("a batch's answers don't fit its pairs")
    p[ask] += weight * np.minimum(as_counts(held)[back] / most_counts(level[ask - 1]), 1.0)
    return p


def score(docs: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Scores of all documents under a model of those with train true. docs: doc_id, text, train.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score and score.
    """
    texts, words, pairs, m = _counted(docs)
    sums = m.tokens, m.types, m.quantised

    def apply_own(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        t = in_order(table)
        h, row, counts, level = _known(t, answers.filter(pc.invert(answers.column("pair"))))
        n, scale = t.num_rows, sums[0] + 0.1 * (sums[1] + 1)
        p = probabilities(h, row, level, answers, sums, weight)
        return pa.table({
            "doc_id": t.column("doc_id"), "train": t.column("train"), "n_tokens": pa.array(np.bincount(row, minlength=n), pa.int64()),
            "n_known": pa.array(np.bincount(row, counts > 0, n).astype(np.int64)), "train_tokens": pa.array([sums[0]] * n, pa.int64()),
            "base_score": pa.array(np.bincount(row, np.log10((counts + 0.1) / scale), n)), "score": pa.array(np.bincount(row, np.log10(p), n)),
        })

    answers = words.unionByName(pairs).where("batch >= 0").select("batch", "part", "counts", "levels", "pair")
    return texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(apply_own, "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


TOLD = "batch bigint, part int, counts binary, levels binary"


def apply(model: Model, docs: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """Scores of any documents (doc_id, text) under a stored model: doc_id, n_tokens, n_known (words that the filter holds)
    and score."""
    texts, parts, sums = in_batches(docs, "doc_id", "text"), model.parts, (model.tokens, model.types, model.quantised)

    def ask_words(table: pa.Table) -> pa.Table:
        t = in_order(table)
        keys = np.unique(tokens(t)[0])
        return _asked(t.column("batch")[0].as_py(), keys, np.zeros(len(keys), np.uint32), parts)

    def ask_pairs(_, table: pa.Table, found: pa.Table) -> pa.Table:
        t = in_order(table)
        h, row, _, level = _known(t, found)
        at = _pairs(h, row, level)
        keys = np.unique(pair_keys(h[at - 1], h[at]))
        return _asked(t.column("batch")[0].as_py(), keys, np.zeros(len(keys), np.uint32), parts)

    def probe(_, asked: pa.Table, stored: pa.Table) -> pa.Table:
        shards, widths, bits = (joined(unpacked(stored.column(c), k), k) for c, k in (("shards", np.uint32), ("widths", np.int64), ("bits", np.uint8)))
        found = [packed(told_by(shards, widths, bits, k)) for k in unpacked(asked.column("keys"))]
        return pa.table({"batch": asked.column("batch"), "part": asked.column("part"), "counts": pa.nulls(len(found), pa.binary()), "levels": pa.array(found, pa.binary())})

    def told_of(asked: DataFrame, pair: bool) -> DataFrame:
        stored = model.shards.where(F.col("pair") == pair).select("part", "shards", "widths", "bits")
        return materialise(asked.groupBy("part").cogroup(stored.groupBy("part")).applyInArrow(probe, TOLD).withColumn("pair", F.lit(pair)))

    def finish(_, table: pa.Table, answers: pa.Table) -> pa.Table:
        t = in_order(table)
        h, row, _, level = _known(t, answers.filter(pc.invert(answers.column("pair"))))
        p, n = probabilities(h, row, level, answers, sums, weight), t.num_rows
        return pa.table({"doc_id": t.column("doc_id"), "n_tokens": pa.array(np.bincount(row, minlength=n), pa.int64()), "n_known": pa.array(np.bincount(row, level > 0, n).astype(np.int64)), "score": pa.array(np.bincount(row, np.log10(p), n))})

    words = told_of(texts.groupBy("batch").applyInArrow(ask_words, ASKED), False)
    pairs = told_of(texts.groupBy("batch").cogroup(words.drop("pair").groupBy("batch")).applyInArrow(ask_pairs, ASKED), True)
    return texts.groupBy("batch").cogroup(words.unionByName(pairs).groupBy("batch")).applyInArrow(finish, "doc_id bigint, n_tokens bigint, n_known bigint, score double")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    out = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held).alias("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
