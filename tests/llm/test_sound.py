"""Words of a regular build, samples of tables where one id has most rows, and literals in lists, calls and arms."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ALNUM, BLANK, DOCS, components, covered, low

from labelmill.llm import decontaminate, jaccard, langid, lm, quality, secrets, suffixes, textbuf

VALUE = "Zx9!kQ2#Lm8@pR"


def regular(n, a="a", b="b"):
    """The word of n characters whose k-th is a or b by the parity of k's ones, and the word with both swapped."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


SIZES = (64, 128, 1024, 2048, 4096, 8192)


def test_regular_words_differ():
    texts = [w for n in SIZES for w in regular(n)] + ["x" * n for n in (15, 16, 17, 64)]
    data, offsets = textbuf.utf8(__import__("pyarrow").array(texts + texts))
    h = textbuf.span_hashes(data, offsets[:-1], offsets[1:])
    assert len(set(h.tolist())) == len(texts) and (h[: len(texts)] == h[len(texts) :]).all()


def test_regular_words_are_not_taken_for_one_another(spark):
    docs = [(2 * k + j, f"{w} ends" if k % 2 else w) for k, n in enumerate(SIZES) for j, w in enumerate(regular(n))]
    docs += [(100 + i, t.replace("a", "p").replace("b", "q")) for i, t in docs]
    frame = spark.createDataFrame(docs, DOCS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame).collect()} == components(docs)
    items = spark.createDataFrame([(k, regular(n)[1]) for k, n in enumerate(SIZES)], "item_id long, text string")
    want = {i: sum(w in [regular(n)[1] for n in SIZES] for w in ALNUM.findall(low(t))) for i, t in docs}
    for limit in (1 << 20, 0):
        assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(decontaminate.matches(frame, items, broadcast_bytes=limit)).collect()} == want
    known = {w for i, t in docs if i % 2 for w in BLANK.findall(low(t))}
    for r in lm.score(frame.withColumn("train", F.col("doc_id") % 2 == 1)).collect():
        assert r["n_known"] == 1 + sum(w in known for w in BLANK.findall(low(dict(docs)[r["doc_id"]])))


@pytest.mark.parametrize("hot", [3, 1 << 40])
def test_repeats_of_regular_bytes_and_often_seen_anchors(spark, hot):
    rnd = random.Random(5)
    one, two = regular(400)
    passage = "".join(rnd.choices("abcdefgh ", k=260))
    texts = [one, two, one[:250] + two[:250], one[100:350], *(f"{rnd.random()}{passage}{rnd.random()}" for _ in range(12))]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.removal(spark.createDataFrame(rows, DOCS), hot).collect()}
    assert out == dict(covered([(i, t.encode()) for i, t in rows]))


def test_language_sample_counts_rows_not_ids(spark):
    many = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the cat "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    same = spark.range(5000).select(F.lit(8).cast("long").alias("doc_id"), F.lit("der hund").alias("text"), F.lit("de").alias("lang"))
    got = langid.sampled(many.union(same).union(spark.createDataFrame([(None, "x", "en"), (9, None, "en"), (9, "le chat", None)], DOCS + ", lang string")))
    assert {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()} == {"en": langid.PER_LANGUAGE, "de": 1}
    assert langid.fit(many.limit(0)) is None
    models = langid.fit(many.union(same))
    assert [r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "hund"), (1, "the cat"), (1, None)], DOCS), models).collect()] == ["de", "en", "und"]
    assert langid.predict(many.limit(0), models).count() == 0


def test_quality_sample_counts_rows_not_ids(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"word{i % 2} " * 20, "en", f"s{i % 2}", 100) for i in range(40)] + [(3, f"copy {k}", "en", "s", k) for k in range(5000)] + [(None, "x", None, None, None)]
    docs = spark.createDataFrame(rows, columns)
    ids = spark.createDataFrame([(i, -i) for i in range(40)], "doc_id long, order_no long")
    got = quality.serving(docs, ids, 1 << 20)
    assert got.count() == 40 and set(got.columns) == {"doc_id", "order_no", "text", "lang", "source", "n_chars"}
    sizes = [r["n"] for r in got.select(F.octet_length("text").alias("n"), "order_no").orderBy("order_no").collect()]
    few = quality.serving(docs, ids, sum(sizes[:5]))
    assert sorted(r["order_no"] for r in few.collect()) == [-39, -38, -37, -36, -35]
    assert quality.serving(docs, ids, 1).count() == 1  # the first in any case
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    heads = quality.fit(docs, labels, labelled=40)
    assert heads["toxic"] is None and quality.score(docs, heads).count() == len(rows)


@pytest.mark.parametrize("text", [
    f'"password": ["{VALUE}"]', f'tokens = [["x", "{VALUE}"],\n  "y"]', 'password = base64("Zx9kQ2#Lm8@pRaWb71")', f'password =\n    "{VALUE}"', f'password:\r\n  \'{VALUE}\'', "Authorization: Bearer Zx9kQ2#Lm8@pR71cc",
    'auth = "Bearer Zx9kQ2#Lm8@pRaW"', f'db_password = debug == 1 ? "{VALUE}" : "none"', f'pwd = x ? "none" : "{VALUE}"', f'<add key="{"x" * 300}_api_token"\n   value="{VALUE}"/>', f'pwd = Buffer.from(\n"{VALUE}", "hex")',
])
def test_literals_in_lists_calls_arms_and_on_the_next_line(text):
    assert "kQ2#Lm8@pR" in text.replace("!", "") and "Q2#Lm8@pR" not in secrets.redacted(text, secrets.spans(text))


def test_names_of_places_are_no_secrets():
    for text in ('password = os.environ["API_PASSWORD_1x"]', 'password = get_setting("API_PASSWORD_1x")', 'password:\n  "key1aB": "Zx9!kQ2#Lm8@pR"'):
        assert secrets.lexed_spans(text) == []


def test_new_syntax_costs_no_more_than_length():
    import time

    for unit in ("password=[", "password=base64(", "token ? ", "password: Bearer ", 'key="a" value="b" ', 'p=("x",', "pwd=c?", "password=\n'", 'key="a"' + " " * 50):
        began = time.time()
        secrets.spans(unit * (300_000 // len(unit)))
        assert time.time() - began < 20


def test_samples_are_the_same_however_rows_lie(spark):
    rows = [(i, f"text {i} {'ab'[i % 2]}", "xy"[i % 2]) for i in range(1000)]
    frame = spark.createDataFrame(rows, DOCS + ", lang string")
    both = [sorted(langid.sampled(f, 50).collect()) for f in (frame, frame.repartition(5, "text"))]
    assert both[0] == both[1] and len(both[0]) == 100
    assert np.isfinite(langid.fit(frame, 50).temperature)


def test_pipeline_from_end_to_end(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from labelmill.llm import bpe

    w = [f"word{k}" for k in range(60)]
    leak = " ".join(f"leak{k}" for k in range(14))
    rows = [
        (1, " ".join(w), "en", "a", 1), (2, " ".join([*w, "more"]), "en", "b", 2), (2, " ".join([*w, "more"]), "en", "b", 2), (3, " ".join(reversed(w)), None, None, None), (4, f"begins {leak[:50]} ends", "en", "a", 3),
        (5, f"Some words before, {leak.upper()} and after", "de", "a", 4), (6, f'my_token = "{VALUE}" stays', "en", "a", 5), (7, None, "en", "a", 0), (8, "", None, "a", 0), (None, "no id <|endoftext|> é", "fr", "c", 9), (9, "  \t\n", "en", "a", 4),
    ]
    extra = {"Hits": F.lit("x"), "rep": F.lit(1), "kept": F.lit(True), "secret_spans": F.lit("s"), "ids": F.lit("i"), "batch": F.lit(7)}
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    same = components([(i, t) for i, t, *_ in rows if i is not None])
    windows = {tuple(leak.split()[k : k + 10]) for k in range(5)}
    want = []
    for i, t, *rest in dict.fromkeys(rows):
        words = ALNUM.findall(low(t))
        if i is not None and same[i][1] != i or any(tuple(words[k : k + 10]) in windows for k in range(len(words))):
            continue
        found = secrets.spans(t) if t else []
        redacted = secrets.redacted(t, found) if t else ""
        lib = Tokenizer.from_file(bpe.tokenizer_path())
        ids = lib.encode(redacted, add_special_tokens=False).ids
        want.append((i, rest[0], rest[1], len(redacted) if found else rest[2], len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded_sha256"]
    got = [(r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_tokens"], r["decoded_sha256"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {r[0] for r in want} == {1, 3, 4, 6, 7, 8, 9, None}
