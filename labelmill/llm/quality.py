"""Quality classifier by co-training two views of a document.

The text view sees words and how they are spread; the metadata view sees source, language and
length. Each round both are fitted, score all documents without labels and hand the other view those
that they are surest of, as labels. On labelled documents kept out of fitting, each view is
calibrated and a last logistic step weighs the two. All documents are scored.

There are two targets, quality and toxicity; a document is kept unless its combined quality is
below ``quality_floor`` or its toxicity above ``toxic_ceiling``. Models are fitted on at most
``labelled`` labelled documents, those with the least hash of their id, as far as their texts hold ``SAMPLE_BYTES``
together (documented bounds on the sample, the same at every size of the input), and on what the views hand over: per round, view and label the ``handed``
surest of all other documents, within the same bytes.

Null text counts as empty, null metadata as a value of its own. Rows of equal or null id are scored each on its
own; of rows that share an id that of least text hash serves for fitting. A document with several labels takes the worst. Input
columns whose names equal an added one in any case are replaced. Without usable labels (none, or of one class) scores are 0.5 and nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import beside
from .storage import materialise
from .textbuf import ALNUM, LOWER, batch_pieces, byte_class, span_hashes, starts_of, utf8, word_bounds

LABELLED, ROUNDS, SURE, HANDED = 6000, 3, 0.98, 400
#: Bytes of all texts of a sample together: bounds the features that the driver holds.
SAMPLE_BYTES = 64 << 20
BITS, META_BITS, SHAPES = 17, 10, 8
QUALITY_FLOOR, TOXIC_CEILING = 0.5, 0.5
_UPPER, _DIGIT = byte_class(lambda b: 65 <= b <= 90), byte_class(lambda b: 48 <= b <= 57)
_SIGN = byte_class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)


@dataclass
class Rows:
    """Sparse rows: row r has columns col[start[r]:start[r + 1]] with values val."""

    start: np.ndarray
    col: np.ndarray
    val: np.ndarray

    def __len__(self):
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(w[self.col] * self.val)]
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.start)[rows]
        start = np.r_[0, np.cumsum(n)]
        at = np.repeat(self.start[rows] - start[:-1], n) + np.arange(start[-1])
        return Rows(start, self.col[at], self.val[at])


def text_rows(data: np.ndarray, offsets: np.ndarray) -> Rows:
    """Logarithmic counts of hashed words, scaled to length 1, and eight shapes of the text."""
    n = len(offsets) - 1
    low = LOWER[data]
    s, e, row = word_bounds(low, offsets, ALNUM)
    size = np.diff(offsets)
    word = span_hashes(low, s, e) >> np.uint64(64 - BITS)
    key, count = np.unique(row.astype(np.uint64) << np.uint64(BITS) | word, return_counts=True)
    r, col = (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    val = np.log1p(count)
    norm = np.sqrt(np.bincount(r, val * val, n))
    val = val / np.maximum(norm[r], 1e-9) * 4
    words, kinds = np.bincount(row, minlength=n), np.bincount(r, minlength=n)

    def share(table):
        sums = np.r_[0, np.cumsum(table[data])]
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)

    repeated = np.zeros(len(word), bool)
    repeated[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    most = np.zeros(n)
    if len(r):
        b = starts_of(r)
        most[r[b]] = np.maximum.reduceat(count, b)
    w1 = np.maximum(words, 1)
    shapes = np.stack([np.log1p(words) / 8, kinds / w1, share(_UPPER) * 4, share(_SIGN) * 8, share(_DIGIT) * 8, np.bincount(row, repeated, n) / w1 * 4, most / w1 * 2, size / w1 / 10], 1)
    order = np.argsort(np.r_[r, np.repeat(np.arange(n), SHAPES)], kind="stable")
    cols = np.r_[col, np.tile((1 << BITS) + np.arange(SHAPES), n)][order]
    return Rows(np.r_[0, np.cumsum(kinds + SHAPES)], cols, np.r_[val, shapes.ravel()][order])


def meta_rows(source: list, lang: list, size: np.ndarray) -> Rows:
    """Hashed source, language, their pair, and the length's octave."""
    n = len(source)
    hashed: dict = {}

    def slot(x):
        if x not in hashed:
            data, off = utf8(pa.array([repr(x)]))
            hashed[x] = int(span_hashes(data, off[:1], off[1:])[0] >> np.uint64(64 - META_BITS))
        return hashed[x]

    octave = np.floor(np.log2(np.maximum(size, 0) + 1)).astype(int).tolist()
    col = [slot(x) for s, g, o in zip(source, lang, octave, strict=True) for x in (("source", s), ("lang", g), ("both", s, g), ("octave", o))]
    return Rows(np.arange(n + 1) * 4, np.array(col, np.int64), np.ones(4 * n))


@dataclass
class Logistic:
    w: np.ndarray
    b: float

    @classmethod
    def fit(cls, x: Rows, y: np.ndarray, width: int, penalty: float = 1e-3, steps: int = 80, hashed: int = 0) -> Logistic:
        """Full-batch Adam on the class-balanced logistic loss.

        hashed: the first so many columns are presences of words or values; they are scaled by the log ratio of
        their rates in both classes, and left out where fewer than three rows have them.
        """
        p = y.mean()
        scale = np.ones(width)
        if hashed:
            on = np.repeat(y, np.diff(x.start))
            pos, n = np.bincount(x.col, on, width)[:hashed], np.bincount(x.col, minlength=width)[:hashed]
            ratio = np.log((pos + 1) / (pos.sum() + hashed)) - np.log((n - pos + 1) / ((n - pos).sum() + hashed))
            scale[:hashed] = np.where(n >= 3, ratio, 0.0)
            x = Rows(x.start, x.col, x.val * scale[x.col])
        weight = np.where(y > 0, 0.5 / max(p, 1e-6), 0.5 / max(1 - p, 1e-6)) / len(y)
        row = np.repeat(np.arange(len(x)), np.diff(x.start))
        w, b, m, v, mb, vb = np.zeros(width), 0.0, np.zeros(width), np.zeros(width), 0.0, 0.0
        for t in range(1, steps + 1):
            err = (sigmoid(x.dot(w) + b) - y) * weight
            g = np.bincount(x.col, err[row] * x.val, width) + penalty * w
            gb = err.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.1 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w = w - rate * m / (np.sqrt(v) + 1e-7)
            b -= rate * mb / (np.sqrt(vb) + 1e-7)
        return cls((w * scale).astype(np.float32), float(b))

    def logit(self, x: Rows) -> np.ndarray:
        return x.dot(self.w) + self.b


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def dense(*columns: np.ndarray) -> Rows:
    x = np.stack(columns, 1)
    return Rows(np.arange(len(x) + 1) * x.shape[1], np.tile(np.arange(x.shape[1]), len(x)), np.clip(x, -10, 10).ravel())


@dataclass
class Head:
    """One target: two calibrated views and their combination."""

    text: Logistic
    meta: Logistic
    text_scale: Logistic
    meta_scale: Logistic
    both: Logistic

    def scores(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.text_scale.logit(dense(self.text.logit(text))), self.meta_scale.logit(dense(self.meta.logit(meta)))
        return sigmoid(self.both.logit(dense(t, m))), sigmoid(t), sigmoid(m)


def calibrated(logit: list[np.ndarray], y: np.ndarray) -> Logistic:
    """A logistic step without class balancing, so that its result is a probability."""
    x = dense(*logit)
    fit = Logistic.fit(x, y, len(logit), 1e-3, 300)
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    return Logistic(fit.w, fit.b + float(np.log(p / (1 - p))))


class CoTraining:
    """Both views of one target, fitted in rounds on labelled rows and on what each view hands the other.

    A quarter of the labelled rows is kept out for calibration.
    """

    WIDTHS = (((1 << BITS) + SHAPES, 1 << BITS), (1 << META_BITS, 1 << META_BITS))

    def __init__(self, text: Rows, meta: Rows, y: np.ndarray):
        fold = np.arange(len(y)) % 4 == 3
        self.views, self.y = (text, meta), y
        self.fitting, self.held = np.flatnonzero(~fold), np.flatnonzero(fold)
        self.given: tuple[dict, dict] = {}, {}
        self.fitted: list[Logistic] = []

    def possible(self) -> bool:
        """Whether both classes are there for fitting and for calibration."""
        parts = [self.y[self.fitting], self.y[self.held]]
        return len(self.y) >= 8 and min(v for p in parts for v in (p.sum(), (1 - p).sum())) >= 1

    def fit(self, pool: dict) -> None:
        """Fits both views. pool: the two views' rows of each handed document by its id."""
        self.fitted = []
        for k, (x, (width, hashed)) in enumerate(zip(self.views, self.WIDTHS, strict=True)):
            more = sorted(i for i in self.given[k] if i in pool)
            both = _end_to_end([x.take(self.fitting), *(pool[i][k] for i in more)])
            labels = np.r_[self.y[self.fitting], np.array([self.given[k][i] for i in more], np.float64)]
            self.fitted.append(Logistic.fit(both, labels, width, hashed=hashed))

    def head(self) -> Head:
        y = self.y[self.held]
        t, m = (f.logit(x.take(self.held)) for f, x in zip(self.fitted, self.views, strict=True))
        ts, ms = calibrated([t], y), calibrated([m], y)
        return Head(*self.fitted, ts, ms, calibrated([ts.logit(dense(t)), ms.logit(dense(m))], y))


def _end_to_end(rows: list[Rows]) -> Rows:
    sizes = np.concatenate([np.diff(r.start) for r in rows])
    return Rows(np.r_[0, np.cumsum(sizes)].astype(np.int64), np.concatenate([r.col for r in rows]), np.concatenate([r.val for r in rows]))


def confident(docs: DataFrame, known: DataFrame, models: dict[str, list[Logistic]], handed: int = HANDED, sure: float = SURE) -> DataFrame:
    """Of all documents without labels those that a view is surest of: target, view, label, doc_id.

    Every document is scored; for each target, view and label the ``handed`` of greatest confidence (sure at least)
    are taken, ties by the hash of the id. known: the ids that have labels.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)  # two weight vectors of fixed size for each target
    schema = "doc_id long, target string, view int, label int, p double"

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                views = _views(b)
                out = []
                for target, fitted in shared.value.items():
                    for k, (f, x) in enumerate(zip(fitted, views, strict=True)):
                        p = sigmoid(f.logit(x))
                        for label, q in ((1, p), (0, 1 - p)):
                            at = np.flatnonzero(q >= sure)
                            out.append(pa.record_batch([b.column("doc_id").take(pa.array(at)).cast(pa.int64()), pa.array([target] * len(at), pa.string()), pa.array([k] * len(at), pa.int32()), pa.array([label] * len(at), pa.int32()), pa.array(q[at], pa.float64())], ["doc_id", "target", "view", "label", "p"]))
                yield from out

    found = docs.where("doc_id is not null").mapInArrow(run, schema).join(known.select("doc_id"), "doc_id", "left_anti")
    place = Window.partitionBy("target", "view", "label").orderBy(F.desc("p"), F.xxhash64("doc_id"), "doc_id")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= handed).select("target", "view", "label", "doc_id")


def serving(docs: DataFrame, ids: DataFrame, most_bytes: int) -> DataFrame:
    """Of docs one row for each of ids (doc_id, order_no and more; a bounded number), that of least text hash, in order of
    order_no as far as their texts have most_bytes together (the first in any case)."""
    rest = [F.first(c).alias(c) for c in ids.columns if c != "doc_id"]
    row = F.min_by(F.struct("text", "lang", "source", "n_chars"), F.struct(F.xxhash64("text"), "n_chars", "lang", "source")).alias("row")
    one = materialise(docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(row, *rest))
    sized = one.withColumn("bytes", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long"))
    fits = sized.select("doc_id", "order_no", "bytes").withColumn("so_far", F.sum("bytes").over(Window.orderBy("order_no", "doc_id"))).where((F.col("so_far") <= most_bytes) | (F.col("so_far") == F.col("bytes")))
    return one.select("doc_id", "row.*", *ids.drop("doc_id").columns).join(F.broadcast(fits.select("doc_id")), "doc_id", "left_semi")


def _features(rows: DataFrame, keep: list[str]) -> list[tuple]:
    """Features of a bounded sample, computed in tasks, gathered at the driver in order of doc_id's hash."""
    schema = "order_no bigint, " + "".join(f"{k} double, " for k in keep) + "tcol binary, tval binary, mcol binary"

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                text, meta = _views(b)
                cut = lambda x, a, t: [x.__dict__[a][x.start[i] : x.start[i + 1]].astype(t).tobytes() for i in range(len(x))]
                yield pa.RecordBatch.from_arrays([b.column("order_no"), *(b.column(k) for k in keep), *(pa.array(v, pa.binary()) for v in (cut(text, "col", np.int32), cut(text, "val", np.float32), cut(meta, "col", np.int32)))], ["order_no", *keep, "tcol", "tval", "mcol"])

    return sorted(rows.mapInArrow(run, schema).collect())


def _views(b) -> tuple[Rows, Rows]:
    data, offsets = utf8(b.column("text"))
    size = pc.fill_null(b.column("n_chars").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    return text_rows(data, offsets), meta_rows(b.column("source").to_pylist(), b.column("lang").to_pylist(), np.where(size < 0, np.diff(offsets), size))


def _joined(packs: list[tuple], n: int) -> tuple[Rows, Rows]:
    col, val, meta = ([np.frombuffer(p[n + k], t) for p in packs] for k, t in ((0, np.int32), (1, np.float32), (2, np.int32)))
    rows = lambda c, v: Rows(np.r_[0, np.cumsum([len(x) for x in c])].astype(np.int64), np.concatenate([np.zeros(0, np.int32), *c]), np.concatenate([np.zeros(0), *v]))
    return rows(col, val), rows(meta, [np.ones(len(x)) for x in meta])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> dict[str, Head | None]:
    """The heads for quality and toxic. docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality, toxic."""
    order = F.xxhash64("doc_id").alias("order_no")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    known = known.where("quality is not null and toxic is not null")
    chosen = docs.where("doc_id is not null").select("doc_id").join(known, "doc_id").select("doc_id", "quality", "toxic", order).distinct().orderBy("order_no").limit(labelled)
    a = _features(serving(docs, chosen, SAMPLE_BYTES), ["quality", "toxic"])
    if not a:
        return {"quality": None, "toxic": None}
    text, meta = _joined(a, 3)
    targets = {k: CoTraining(text, meta, np.array([r[i] for r in a])) for i, k in ((1, "quality"), (2, "toxic"))}
    training = {k: t for k, t in targets.items() if t.possible()}
    pool: dict[int, tuple[Rows, Rows]] = {}
    for n in range(rounds):
        for t in training.values():
            t.fit(pool)
        if not training or n == rounds - 1:
            break
        picked = confident(docs, labels, {k: t.fitted for k, t in training.items()}, handed).collect()  # at most 8 x handed ids
        new = []
        for r in picked:
            given = training[r["target"]].given[1 - r["view"]]
            if r["doc_id"] not in given:
                given[r["doc_id"]] = r["label"]
                new.append(r["doc_id"])
        missing = sorted({i for i in new if i not in pool})
        if not new:
            break
        if missing:
            ids = docs.sparkSession.createDataFrame([(i, i) for i in missing], "doc_id long, order_no long")
            got = _features(serving(docs, ids, SAMPLE_BYTES), [])
            rows = _joined(got, 1)
            for i, pack in enumerate(got):
                pool.setdefault(pack[0], tuple(v.take(np.array([i])) for v in rows))
    return {k: t.head() if k in training else None for k, t in targets.items()}


NEW = ("quality_score", "text_quality", "meta_quality", "toxic_score")


def score(docs: DataFrame, heads: dict[str, Head | None], quality_floor: float = QUALITY_FLOOR, toxic_ceiling: float = TOXIC_CEILING) -> DataFrame:
    """docs with quality_score (both views), text_quality, meta_quality, toxic_score and the decision ``kept``."""
    schema = beside(docs.schema, *(T.StructField(n, T.DoubleType()) for n in NEW), T.StructField("kept", T.BooleanType()))
    names = schema.names[: -len(NEW) - 1]
    shared = docs.sparkSession.sparkContext.broadcast(heads)  # two weight vectors of fixed size

    def run(batches):
        for batch in batches:
            for b in batch_pieces(batch, "text"):
                text, meta = _views(b)
                flat = np.full(b.num_rows, 0.5)
                q = shared.value["quality"].scores(text, meta) if shared.value["quality"] else (flat,) * 3
                x = shared.value["toxic"].scores(text, meta)[0] if shared.value["toxic"] else flat
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v, pa.float64()) for v in (*q, x)), pa.array((q[0] >= quality_floor) & (x <= toxic_ceiling), pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    heads = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, heads).select("doc_id", *NEW, "kept")
