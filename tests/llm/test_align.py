"""Alignment of two tokenizers against a plain loop over characters and tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS

from labelmill.llm import align

PATHS = align.tokenizer_paths()


@pytest.fixture(scope="module")
def both():
    return align.Both(*(open(p, "rb").read() for p in PATHS))


def plain(texts):
    """Per text: n_a, n_b, groups as lists of ids; from the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib = Tokenizer.from_file(PATHS[0])
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = align.byte_alphabet()
    out = []
    for t in texts:
        if not t:
            out.append([])
            continue
        a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
        ab = [bytes(alphabet[c] for c in a_lib.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
        if not b"".join(ab) == (" " + t).encode() == b"".join(bb):
            out.append([])
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(ab), ends(bb)
        groups = [([], []) for _ in range(len(set(ea) & set(eb)))]
        shared = sorted(set(ea) & set(eb))
        for side, (ids, at) in enumerate(((a, ea), (b, eb))):
            for i, e in zip(ids, at, strict=True):
                groups[sum(s < e for s in shared)][side].append(i)
        out.append(groups)
    return out


def expected(rows):
    groups = plain([t for _, t in rows])
    held = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    docs = Counter(p for h in held for p in h)
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (i, _), g, h in zip(rows, groups, held, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        links = sum(h.values())
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), links, sum(n for p, n in h.items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in h.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    bits = ["the", " cat", " ", "  ", "\n", "\t", "é", "ß ", "日本語", "\U0001f642", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "'s", "1234", ".", ", ", "xyzzy", "▁", " ", "　 a", "\x00", "q" * 20, " \r\n ", "don't"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25))) for _ in range(n)]


def test_segments_give_what_whole_texts_give(both):
    texts = odd_texts(1500, 1) + ["", " ", "   ", "a ", " a  ", "x" * 5000, "a b " * 3000, None]
    x = align.aligned(pa.array(texts), both)
    want = plain(texts)
    for d, groups in enumerate(want):
        assert x.a[x.a_doc == d].tolist() == [i for a, _ in groups for i in a]
        assert x.b[x.b_doc == d].tolist() == [i for _, b in groups for i in b]
    assert np.bincount(x.group_doc, minlength=len(texts)).tolist() == [len(g) for g in want]


def test_alignment_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(120, 2))] + [(900, None), (901, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (902, "zq" * 2000), (903, "a▁b")]
    frame = spark.createDataFrame(rows, DOCS).withColumns({"Chunk": F.lit(1), "n_a": F.lit("x")})
    for chunk, ranges in ((8 << 20, 32), (300, 2)):  # one chunk a task; many chunks, and copies of the counts
        got = [tuple(r) for r in align.alignment(frame.repartition(3), *PATHS, chunk, ranges).collect()]
        assert sorted(got, key=repr) == expected(rows)
    assert align.alignment(frame.limit(0), *PATHS).count() == 0
    assert {r["n_a"] for r in align.alignment(spark.createDataFrame([(1, None), (2, "")], DOCS), *PATHS).collect()} == {0}


def test_groups_of_many_tokens_are_counted_by_id(both):
    a, b = np.array([5] * 40 + [6] * 3, np.int32), np.array([7, 8] * 30, np.int32)
    x = align.Aligned(1, a, b, np.zeros(43, np.int64), np.zeros(60, np.int64), np.zeros(43, np.int64), np.zeros(60, np.int64), np.zeros(1, np.int64))
    doc, key, times = align.links(x, both)
    n = len(both.b_bytes)
    assert dict(zip([divmod(k, n) for k in key.tolist()], times.tolist(), strict=True)) == {(5, 7): 1200, (5, 8): 1200, (6, 7): 90, (6, 8): 90} and doc.tolist() == [0] * 4


def test_ids_and_groups_beside_other_columns(spark):
    rows = [(1, "the cat sat", "x"), (2, None, "y"), (3, "日本 ok", "z")]
    out = align.with_alignment(spark.createDataFrame(rows, "doc_id long, text string, A_ids string"), *PATHS).orderBy("doc_id").collect()
    assert out[0].__fields__ == ["doc_id", "text", "a_ids", "b_ids", "a_group", "b_group"]
    for r, groups in zip(out, plain([t for _, t, _ in rows]), strict=True):
        assert r["a_ids"] == [i for a, _ in groups for i in a] and r["b_ids"] == [i for _, b in groups for i in b]
        assert r["a_group"] == [k for k, (a, _) in enumerate(groups) for _ in a] and r["b_group"] == [k for k, (_, b) in enumerate(groups) for _ in b]


def test_query_on_the_smallest_tables(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in align.op11_align(spark, sf_dir).collect()), key=repr) == expected(rows)
