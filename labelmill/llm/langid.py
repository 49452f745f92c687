"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Text is lower-cased; each run of anything but letters is one blank. Per language an order-4 model is
trained on at most ``per_language`` whole texts, those with the least hash of their id (a documented
bound on the classifier's sample, the same at every size of the input; rows of equal id, language and text
count as one). A packed n-gram is its own
hash; the n-grams of all languages share one sorted array, beside which stands, per language, the
interpolated log probability. A text takes the language of least cross-entropy per character; the
probability beside it is calibrated by a temperature fitted on texts kept out of the counts, and a
text whose cross-entropy exceeds what such texts show is marked as rejected.

Null text and text without a letter give ``und`` with score 0. Ties go to the first language by name; with one
language every text with a letter takes it. Rows are predicted each on its own, whatever repeats. Input columns
whose names equal an added one in any case are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import beside
from .textbuf import PIECE, batch_pieces

ORDER, PER_LANGUAGE, DISCOUNT, ALPHABET = 4, 300, 0.75, 1 << 10
SPACE = np.uint64(32)
_table: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """16-bit code of each code point: its lower-case letter, or a blank."""
    if not _table:
        t = np.full(0x110000, 32, np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                t[cp] = low if low < 0x10000 else 0x8000 | low & 0x7FFF
        _table.append(t)
    return _table[0]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts end to end, each text with a blank before and after, and where each starts."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    blank = np.array([32], np.uint32)
    cp = np.concatenate([x for r in raw for x in (blank, r, blank)]) if raw else np.zeros(0, np.uint32)
    sizes = np.array([len(r) + 2 for r in raw], np.int64)
    c = letter_codes()[cp]
    start = np.r_[0, np.cumsum(sizes)]
    keep = np.r_[True, (c[1:] != 32) | (c[:-1] != 32)] if len(c) else np.zeros(0, bool)
    keep[start[:-1]] = True
    before = np.r_[0, np.cumsum(keep)]
    return c[keep].astype(np.uint64), before[start]


def packed(c: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n codes that end at each place, packed into 64 bits; before a text's start stand blanks."""
    out = c.copy()
    place = np.arange(len(c)) - np.repeat(starts[:-1], np.diff(starts))
    for j in range(1, n):
        back = np.r_[np.full(j, SPACE), c[:-j]][: len(c)]
        out |= np.where(place >= j, back, SPACE) << np.uint64(16 * j)
    return out


def train(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: n-grams, their discounted shares; contexts, their back-off weights (Kneser-Ney)."""
    c, starts = codes(texts)
    inside = np.ones(len(c), bool)
    inside[starts[:-1]] = False
    grams, counts = np.unique(packed(c, starts, ORDER)[inside], return_counts=True)
    model = {}
    for n in range(ORDER, 0, -1):
        context = grams >> np.uint64(16)
        # The packed context of n-1 codes is what stands above the last code.
        ctx, inv, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inv, counts)
        # A gram is (context << 16) | code, so equal contexts stand together.
        model[n] = grams, np.maximum(counts - DISCOUNT, 0) / total[inv], ctx, DISCOUNT * kinds / total
        lower = grams & np.uint64((1 << 16 * (n - 1)) - 1) if n > 1 else grams
        if n > 1:
            grams, counts = np.unique(lower, return_counts=True)
    return model


def find(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(values, x), max(len(values) - 1, 0))
    return at, (values[at] == x if len(values) else np.zeros(len(x), bool))


def probability(model, x: np.ndarray, n: int) -> np.ndarray:
    """Interpolated probability of the last code of each packed n-gram."""
    if n == 0:
        return np.full(len(x), 1 / ALPHABET)
    grams, share, ctx, weight = model[n]
    lower = probability(model, x & np.uint64((1 << 16 * (n - 1)) - 1) if n > 1 else x, n - 1)
    at, ok = find(ctx, x >> np.uint64(16))
    w = np.where(ok, weight[at], 1.0)
    at, ok = find(grams, x)
    return np.where(ok, share[at], 0.0) + w * lower


@dataclass
class Models:
    """All languages side by side."""

    langs: list[str]
    grams: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    back: dict[int, tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0
    limits: tuple[float, ...] = ()

    @classmethod
    def build(cls, models: dict[str, dict]) -> Models:
        langs = sorted(models)
        grams, logp, back = {}, {}, {}
        for n in range(1, ORDER + 1):
            g = grams[n] = np.unique(np.concatenate([models[k][n][0] for k in langs]))
            logp[n] = np.log(np.stack([probability(models[k], g, n) for k in langs], 1)).astype(np.float32)
            ctx = np.unique(np.concatenate([models[k][n][2] for k in langs]))
            w = np.ones((len(ctx), len(langs)))
            for i, k in enumerate(langs):
                at, ok = find(models[k][n][2], ctx)
                w[ok, i] = models[k][n][3][at[ok]]
            back[n] = ctx, np.log(w).astype(np.float32)
        return cls(langs, grams, logp, back)

    def score(self, x: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Log probability under each language of the last code of each packed n-gram: one look-up for most."""
        if n == 0:
            return np.full((len(x), len(self.langs)), -np.log(ALPHABET), np.float32)
        at, ok = find(self.grams[n], x)
        out = self.logp[n][at]
        if not ok.all():
            miss = x[~ok]
            ctx, w = self.back[n]
            c, known = find(ctx, miss >> np.uint64(16))
            out[~ok] = np.where(known[:, None], w[c], 0) + self.score(miss & np.uint64((1 << 16 * (n - 1)) - 1) if n > 1 else miss, n - 1)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per code (texts by languages) and number of codes, blanks at the start left out."""
        c, starts = codes(texts)
        if not len(c):
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        logs = self.score(packed(c, starts, ORDER))
        logs[starts[:-1]] = 0
        n = np.diff(starts) - 1
        return -np.add.reduceat(logs, starts[:-1], axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None], n

    def chances(self, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -ce * np.minimum(n, 400)[:, None] * self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Temperature of least log loss, and per language the cross-entropy beyond which a text is rejected."""
        ce, n = self.entropy(texts)
        if not len(ce):
            self.limits = (float("inf"),) * len(self.langs)
            return
        y = np.array([self.langs.index(t) for t in truth])

        def loss(t):
            self.temperature = t
            return -np.log(np.maximum(self.chances(ce, n)[np.arange(len(y)), y], 1e-9)).mean()

        self.temperature = min((0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), key=loss)
        self.limits = tuple(float(np.quantile(ce[y == i, i], 0.995) * 1.15) if (y == i).any() else float("inf") for i in range(len(self.langs)))


def remainder(col: str, n: int) -> Column:
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def sampled(training: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, nth and text of at most per_language different rows of each language, by the hash of their id."""
    rows = training.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text", F.xxhash64("text").alias("of_text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "of_text")
    picked = rows.select("doc_id", "lang", "of_text").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    # picked: per_language numbers for each language; however often a row is repeated, one of it is gathered.
    return rows.join(F.broadcast(picked), ["doc_id", "lang", "of_text"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))


def fit(training: DataFrame, per_language: int = PER_LANGUAGE) -> Models | None:
    """Models from doc_id, text and lang of the training rows; None if there are none."""
    sample = sampled(training, per_language)

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by([("nth", "ascending"), ("text", "ascending")])
        texts, nth = t.column("text").to_pylist(), t.column("nth").to_pylist()
        used = [x for x, k in zip(texts, nth, strict=True) if k % 10 or len(texts) < 10]
        held = [x for x, k in zip(texts, nth, strict=True) if not k % 10 and len(texts) >= 10]
        parts = [(n, k, np.ascontiguousarray(a).tobytes()) for n, four in train(used).items() for k, a in enumerate(four)]
        lang = t.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(parts)), "n": pa.array([p[0] for p in parts], pa.int32()), "part": pa.array([p[1] for p in parts], pa.int32()), "data": pa.array([p[2] for p in parts], pa.binary()), "held": pa.array([held] + [[]] * (len(parts) - 1), pa.list_(pa.string()))})

    packs = sample.select("lang", "text", "nth").groupBy("lang").applyInArrow(one, "lang string, n int, part int, data binary, held array<string>").collect()  # bounded by the sample
    if not packs:
        return None
    models: dict[str, dict] = {}
    for r in packs:
        models.setdefault(r["lang"], {}).setdefault(r["n"], [None] * 4)[r["part"]] = np.frombuffer(r["data"], np.float64 if r["part"] in (1, 3) else np.uint64)
    built = Models.build(models)
    held = [(x, r["lang"]) for r in packs for x in r["held"]]
    built.calibrate([h[0] for h in held], [h[1] for h in held])
    return built


def predict(df: DataFrame, models: Models | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1), cross_entropy and rejected."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    schema = beside(df.schema, *new)
    names = schema.names[: -len(new)]
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in batch_pieces(batch, text_col, PIECE // 2):
                texts = pc.fill_null(b.column(text_col), "").to_pylist()
                ce, n = m.entropy(texts) if m else (np.zeros((len(texts), 1)), np.full(len(texts), 2))
                best = ce.argmin(1)
                rows = np.arange(len(texts))
                ok = np.array([any(map(str.isalpha, t)) for t in texts], bool) if m else np.zeros(len(texts), bool)
                score = np.where(ok, m.chances(ce, n)[rows, best] if m else 0.0, 0.0)
                worst = np.array(m.limits)[best] if m else np.zeros(len(texts))
                lang = [m.langs[i] if o else "und" for i, o in zip(best.tolist(), ok.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(ok, ce[rows, best], 0.0), pa.float64()), pa.array(~ok | (ce[rows, best] > worst), pa.bool_())], schema.names)

    return df.mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    models = fit(docs.where(~held).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", held.alias("held_out"), "text"), models)
    return out.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
