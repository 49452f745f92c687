"""BPE encoding and decoding by dynamic programming over the prefixes of a word.

Every prefix of a word has exactly one last token in its encoding. An automaton finds all tokens
that end at a prefix; the right one is that whose predecessor (the last token of the prefix before
it) is compatible: no merge would have crossed their border. Back-pointers then give the ids.

Words are what the tokenizer's file says: NFC, lower case, split into contractions, letters, single
digits and other signs, with special tokens taken out first. Null text counts as empty; an empty
text has no ids. Extra columns are passed on, but for ``ids`` and ``decoded``, which are replaced.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import unicodedata
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import beside
from .textbuf import batch_pieces

#: Stands for the tokenizer's end-of-word mark, which no word can hold as one character.
END = "\ue000"
NEVER = 1 << 60
#: Distinct words that one Python worker remembers before it starts anew: frequent ones come back at once.
CACHED_WORDS = 200_000
#: Pairs of tokens whose compatibility it remembers.
CACHED_PAIRS = 200_000


class WordBpe:
    def __init__(self, spec: dict):
        import ahocorasick

        model = spec["model"]
        mark = model["end_of_word_suffix"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or not mark:
            raise ValueError("only word-level BPE with NFC, lower case and an end-of-word mark is known")
        inner = lambda t: t[: -len(mark)] + END if t.endswith(mark) and t != mark else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.decode = Names(spec).decode
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = self.ids[inner(a)], self.ids[inner(b)]
            self.rank[pair] = r
            self.parts.setdefault(self.ids[inner(a + b)], (*pair, r))
        self.match = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.match.add_word(t, (len(t), i))
        self.match.make_automaton()
        self.edges: tuple[dict, dict] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.split = regex.compile(split.replace(r"^\s", "^" + blank))
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.opening = os.path.commonprefix(list(self.special))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's outermost parts on one side, from itself inwards, each with the rank of the merge that uses it up."""
        found = self.edges[side].get(token)
        if found is None:
            found, used, part = [], NEVER, token
            while True:
                found.append((part, used))
                if part not in self.parts:
                    break
                *both, used = self.parts[part]
                part = both[side]
            self.edges[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding left's and right's text together gives just these two tokens."""
        rank, begins = self.rank, self.edge(right, 0)
        for a, gone_a in self.edge(left, 1):
            for b, gone_b in begins:
                r = rank.get((a, b))
                if r is not None and r < gone_a and r <= gone_b:
                    return False
        return True

    def word(self, w: str) -> list[int]:
        """The ids of one word, given in the byte alphabet."""
        n = len(w)
        start, last = [0] * (n + 2), [-1] * (n + 2)
        pairs = self.pairs
        for end, found in itertools.groupby(self.match.iter(w + END), itemgetter(0)):
            if end + 1 == n:
                continue  # a last token ends with the word's end mark
            for _, (size, token) in found:  # the longest comes first
                j = end + 1 - size
                if j:
                    left = last[j]
                    if left < 0:
                        continue
                    key = left << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(left, token)
                    if not fits:
                        continue
                start[end + 1], last[end + 1] = j, token
                break
        out, i = [], n + 1
        while i > 0:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def encoded(self, w: str) -> bytes:
        ids = self.word(w if w.isascii() and w.isalnum() else "".join(map(self.alphabet.__getitem__, w.encode())))
        return struct.pack(f"<{len(ids)}I", *ids)

    def text(self, s: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        out: list[bytes] = []
        for part in self.apart.split(s) if self.apart and self.opening in s else [s]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            for w in self.split.findall(part):
                known = self.words.get(w)
                if known is None:
                    if len(self.words) >= CACHED_WORDS:
                        self.words.clear()
                    if len(self.pairs) >= CACHED_PAIRS:
                        self.pairs.clear()
                    known = self.encoded(w)
                    if len(w) <= 64:
                        self.words[w] = known
                out.append(known)
        return b"".join(out)


class Names:
    """What decoding needs of a tokenizer: a fraction of what encoding holds in memory."""

    def __init__(self, spec: dict):
        if spec["decoder"] is not None:
            raise ValueError("only tokenizers without a decoder are known")
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}

    def decode(self, ids: bytes) -> str:
        """The tokens' names with a blank between, which is how a tokenizer without a decoder does it."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(1)
def _load(text: str) -> WordBpe:
    return WordBpe(json.loads(text))


@lru_cache(1)
def _names(text: str) -> Names:
    return Names(json.loads(text))


def _tokenizer(spark: SparkSession, path: str):
    """The tokenizer file (of fixed size, a parameter) as a broadcast text."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", decoded_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """df with ``ids`` (binary: the ids as little-endian unsigned 32-bit integers) of each text.

    decoded_col: also decodes the ids, in the same pass, so that a task needs one Python worker and not two.
    Without keep_text the text is left out of the result.
    """
    new = ["ids"] + [decoded_col] * (decoded_col is not None)
    kinds = [T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.StringType()) for c in new[1:])]
    spec, schema = _tokenizer(df.sparkSession, tokenizer), beside(df.schema, *kinds)
    if not keep_text:
        schema = T.StructType([f for f in schema if f.name != text_col])
    kept = [f.name for f in schema if f.name not in new]

    def run(batches):
        bpe = _load(spec.value)
        for batch in batches:
            for b in batch_pieces(batch, text_col):
                ids = [bpe.text(s or "") for s in b.column(text_col).to_pylist()]
                out = [pa.array(ids, pa.binary())]
                if decoded_col:
                    out.append(pa.array(map(bpe.decode, ids), pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *out], [*kept, *new])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """df with ``decoded``, the text of each row's ids; null ids give an empty text."""
    spec, schema = _tokenizer(df.sparkSession, tokenizer), beside(df.schema, T.StructField("decoded", T.StringType()))
    kept = [f.name for f in schema if f.name != "decoded"]

    def run(batches):
        names = _names(spec.value)
        for batch in batches:
            for b in batch_pieces(batch, ids_col, 4 << 20):
                texts = [names.decode(x or b"") for x in b.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    return df.mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, tokenizer_path(), decoded_col="decoded", keep_text=False)
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
