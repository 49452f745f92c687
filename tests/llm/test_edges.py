"""Nulls, repeats, ties, long texts, hot groups and clashing names, each against brute force or a stated result."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ALNUM, BLANK, DOCS, components, covered, low, sha

import corpus_pipeline
from labelmill.llm import chat, decontaminate, fingerprint, jaccard, langid, lm, quality, secrets, storage, suffixes, textbuf

VALUE = "Zx9!kQ2#Lm8@pR"


def test_equal_windows_choose_alike_at_any_place_and_length():
    rnd = np.random.default_rng(4)
    near = (rnd.integers(0, 1 << 20, 6, dtype=np.uint64) | np.uint64(7 << 60)) + np.uint64(1)  # tied but for low bits
    for before, after in ((0, 0), (3, 200_000), ((1 << 22) - 3, 40), ((1 << 22) + 5, 9)):
        v = np.full(before + 6 + after, np.uint64((1 << 64) - 1))
        v[before : before + 6] = near
        assert textbuf.rightmost_least(v, 6)[before] - before == textbuf.rightmost_least(near, 6)[0]
    v = rnd.integers(0, 5, 3000, dtype=np.uint64) << np.uint64(60)
    want = [max(range(i, i + 9), key=lambda k: (-int(v[k]), k)) for i in range(len(v) - 8)]
    assert textbuf.rightmost_least(v, 9).tolist() == want


def test_jaccard_of_repeated_and_null_ids(spark):
    w = [f"w{k}" for k in range(40)]
    a, a2, b, b2 = " ".join(w), " ".join(w + ["x"]), " ".join(w[::-1]), " ".join(w[::-1] + ["y"])
    rows = [(1, a), (1, b), (2, a2), (3, b2), (1, None), (4, " "), (4, a[:60] + " q"), (None, a), (None, None), (5, "lone words"), (5, "lone words"), (6, "z " * 30000), (7, "z " * 30000)]
    out = jaccard.join(spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == len(rows) and {(r["doc_id"], r["component_id"]) for r in out} == {(1, 1), (2, 1), (3, 1), (4, 4), (None, None), (5, 5), (6, 6), (7, 6)}


def test_jaccard_of_a_large_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    docs = []
    for i in range(900):
        t = list(base)
        t[rnd.randrange(60)] = f"v{rnd.randrange(400)}"
        docs.append((i, " ".join(t)))
    out = jaccard.join(spark.createDataFrame(docs, DOCS).repartition(7)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == components(docs)


def test_suffixes_of_long_texts_and_a_passage_in_every_row(spark):
    rnd = random.Random(11)
    passage = "".join(rnd.choices("abcdefgh ", k=700))
    long = "".join(rnd.choices("abcdefghijklmnop ", k=2_300_000))
    rows = [(i, f"{rnd.random()} {passage} {rnd.random()}") for i in range(300)] + [(1000, long), (1001, None), (None, "x"), (1002, long[1_048_000:1_049_400]), (1003, "q" * 100 + long[2_299_000:])]
    out = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffixes.removal(spark.createDataFrame(rows, DOCS)).collect()}
    small = [(i, t.encode()) for i, t in rows if i is not None and i < 300]
    want = {i: (x[1], x[2]) for i, x in covered(small)}
    assert {i: out[i] for i, _ in small} == want
    assert out[1000] == (2400, 2) and out[1002] == (1400, 1) and out[1003] == (1000, 1) and out[1001] == out[None] == (0, 0)


def test_suffixes_with_clashing_columns_and_repeats(spark):
    rows = [(1, "a" * 250, "p", 1), (1, "a" * 250, "q", 2), (2, "short", "r", 3)]
    out = suffixes.removal(spark.createDataFrame(rows, DOCS + ", Part string, row_no int")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in out) == [(1, 250), (1, 250), (2, 0)]


@pytest.mark.parametrize("text", [
    f"'password' => '{VALUE}'", 'password = "Zx9!\\"kQ2#Lm8@pR"', f'secret_key = """{VALUE}"""', f'("password", "{VALUE}")', f'user, password = "bob", "{VALUE}"',
    f'password: str = "{VALUE}"', f'const password string = "{VALUE}"', f'config["password"] = "{VALUE}"', f"<password>{VALUE}</password>", f'<add key="ApiToken" value="{VALUE}"/>',
    f'connect(user="bob", password="{VALUE}")', f"don't, it's auth_key = \"{VALUE}\"", f'he wrote "password: {VALUE}" there', f'db_password{" " * 400}= "{VALUE}"', f'k = "{VALUE}"\nauth_key = k',
])
def test_pairs_of_many_syntaxes(text):
    found = [text[s["value_start"] : s["value_end"]] for s in secrets.spans(text)]
    assert found and VALUE.replace("#", "") in found[-1].replace('\\"', "!").replace("#", "").replace("!!", "!")
    assert "kQ2#Lm8@pR" not in secrets.redacted(text, secrets.spans(text))


def test_values_in_several_parts():
    cases = {
        "private_key: |\n  MIIEvQ8Zk2\n\n  Xk29dkQplA\nother: 1": ["MIIEvQ8Zk2\n\n  Xk29dkQplA"],
        "a:\n  - token: >-\n      Zx9kQ2Lm8pR0aa\n  - b: 1": ["Zx9kQ2Lm8pR0aa"],
        'password = (\n  "Zx9!kQ"\n  "2#Lm8@pR"\n)': ["Zx9!kQ", "2#Lm8@pR"],
        'a = "Zx9!kQ"; b = "2#Lm8@pR"\npassword = a + b': ["Zx9!kQ", "2#Lm8@pR"],
        "password = ${DB_PASSWORD}; token = os.environ['DB_PASSWORD_LONG']; secret: {{ vault.Pass1word }}": [],
        "The secret: he was there all along, and nobody knew.": [],
    }
    for text, want in cases.items():
        assert [text[s["value_start"] : s["value_end"]] for s in secrets.lexed_spans(text)] == want


def test_hostile_texts_cost_no_more_than_their_length():
    import time

    n = 30_000
    texts = ['a = "Zx9kQ2Lm8pR0"\n' + "a = a + a\n" * 60 + "password = a", 'a="Zx9kQ2Lm8pR0"\n' + "a = a + a\n" * n, "".join(f'password{i} = "{VALUE}{i}" {i:016x}\n' for i in range(n // 4)), '\\"' * n + "password=", "a," * n + "password=1", 'password=("' * n, 'password="""' * n, "password: |\n " * n]
    for t in texts:
        began = time.time()
        secrets.spans(t)
        assert time.time() - began < 20
    assert len(secrets.lexed_spans(texts[0])) == 1


def test_base_spans_by_brute_force(spark):
    rnd = random.Random(6)
    bits = ["password", "Token", "api_key", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "ABCDEF0123456789", "abcdef0123456789", "deadbeef", "/x+", "é", "\n", "zzzzzzzzzzzz", ";"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 60)))) for i in range(200)] + [(900, None), (901, "")]
    rows += rows[:3]
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    out = secrets.scan(spark.createDataFrame([(i, t, 1, "s") for i, t in rows], DOCS + ", Secret_Spans int, kind string"))
    assert out.columns == ["doc_id", "text", "kind", "secret_spans"] and out.limit(0).count() == 0
    for r in out.collect():
        t = r["text"] or ""
        want = [("assign", m.start(), m.end()) for m in assign.finditer(t) if len(m[1]) >= 12] + [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [(s["kind"], s["start"], s["end"]) for s in r["secret_spans"] if s["base"]] == sorted(want, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, formatted int"
    rows = [(1, 0, "user", "hi", 1), (1, 0, "user", "hi", 1), (1, None, "assistant", "a", 1), (None, 3, None, None, 1), (2, 1, "assistant", "é" * 300_000, 1)]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["turns_sha256"] == sha("assistant\na\nuser\nhi\nuser\nhi\n") and out[1]["loss_chars"] == 1
    assert out[None]["n_turns"] == 1 and out[None]["turns_sha256"] == sha("\n\n") and out[None]["loss_sha256"] == sha("")
    assert out[2]["loss_chars"] == 300_000 and out[2]["loss_sha256"] == sha("é" * 300_000)
    assert chat.digests(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    part = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    odd = spark.createDataFrame([(1, 0, "user", [("video", None, "v.mp4", 9), (None, "t", None, None), None]), (1, 1, "user", None)], f"conv_id long, turn long, role string, content {part}")
    first = chat.format_turns(odd, "content").collect()[0]
    assert "<|other:0|>t" in first["formatted"] and first["attachments"][0]["ref"] == "v.mp4" and first["expanded_tokens"] == 9


def kneser_ney(texts, order=4, discount=0.75):
    """Interpolated Kneser-Ney by dictionaries: a function of context and character."""
    grams = Counter()
    for t in texts:
        s = " " * (order - 1) + re.sub(r"[^a-z]+", " ", " " + t + " ")
        for k in range(order, len(s)):
            grams[s[k - order + 1 : k + 1]] += 1
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(context, c):
        out = 1 / langid.ALPHABET
        for n in range(1, order + 1):
            ctx = context[len(context) - n + 1 :] if n > 1 else ""
            same = {g: m for g, m in levels[n].items() if g[:-1] == ctx}
            if same:
                total = sum(same.values())
                out = max(same.get(ctx + c, 0) - discount, 0) / total + discount * len(same) / total * out
        return out

    return p


def test_kneser_ney_by_brute_force():
    texts = ["the cat sat on the mat", "a cat and a hat", "the the the"]
    models = langid.Models.build({"x": langid.train(texts), "y": langid.train(["zz zz top", "jazz"])})
    p = kneser_ney(texts)
    for t in ("the hat", "zebra", "cat and dog"):
        s = "   " + re.sub(r"[^a-z]+", " ", " " + t + " ")
        want = -sum(math.log(p(s[k - 3 : k], s[k])) for k in range(4, len(s))) / (len(s) - 4)
        assert models.entropy([t])[0][0, 0] == pytest.approx(want, rel=1e-4)


def test_langid_edges(spark):
    docs = [(i, "the quick brown fox and the dog " * 3, "en") for i in range(12)] + [(20 + i, "der schnelle braune fuchs und der hund " * 3, "de") for i in range(12)]
    models = langid.fit(spark.createDataFrame(docs, DOCS + ", lang string"))
    rows = [(1, "the dog"), (1, "the dog"), (2, None), (3, ""), (4, "12 %"), (None, "der hund"), (5, "the fox " * 200_000)]
    out = langid.predict(spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], DOCS + ", Score double, lang_pred string"), models)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "cross_entropy", "rejected"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (5, "en")], key=str)
    tied = langid.Models.build({k: langid.train(["same text"]) for k in ("b", "a")})
    assert tied.langs[tied.entropy(["same"])[0].argmin(1)[0]] == "a"
    one = langid.fit(spark.createDataFrame(docs[:12], DOCS + ", lang string"))
    assert [r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "hund"), (2, "?")], DOCS), one).collect()] == ["en", "und"]


def test_quality_features_and_step_by_brute_force():
    texts = ["Free free MONEY!! 100 free", "A calm, plain note.", ""]
    data, offsets = textbuf.utf8(__import__("pyarrow").array(texts))
    rows = quality.text_rows(data, offsets)
    for k, t in enumerate(texts):
        words = Counter(ALNUM.findall(low(t)))
        val = rows.val[rows.start[k] : rows.start[k + 1]][: len(words)]
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in words.values()))
        assert sorted(val) == pytest.approx(sorted(4 * math.log1p(n) / norm for n in words.values()))
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 3))
    y = (x @ [2.0, -1.0, 0.0] + rnd.normal(size=200) * 0.3 > 0).astype(float)
    fit = quality.Logistic.fit(quality.dense(*x.T), y, 3, steps=400)
    grad = lambda w, b: ((1 / (1 + np.exp(-(x @ w + b))) - y) * np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)) @ x + 1e-3 * w
    assert np.abs(grad(fit.w.astype(float), fit.b)).max() < 0.01


def test_quality_edges(spark):
    rnd = random.Random(2)
    good, bad = "calm plain useful note about rivers and hills".split(), "WIN!!! free $$$ click now".split()
    rows = [(i, " ".join(rnd.choices(good if i % 2 else bad, k=30)), "en", "a" if i % 2 else "b", None) for i in range(400)]
    rows += [(None, "calm note", None, None, None), (500, None, "en", "a", 0), (501, "", None, None, 5), (1, "calm plain river", "en", "a", 20)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)] + [(3, 1, 0), (None, 1, 1), (700, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    heads = quality.fit(docs, labels)
    assert heads["toxic"] is None
    picked = quality.confident(docs, labels, {"quality": [heads["quality"].text, heads["quality"].meta]}, handed=5, sure=0.6).collect()
    assert picked and max(Counter((r["view"], r["label"]) for r in picked).values()) <= 5 and all(r["doc_id"] >= 120 for r in picked)
    out = quality.score(docs.withColumns({"Kept": F.lit(1), "TOXIC_score": F.lit("x")}), heads)
    assert out.count() == len(rows) and out.columns.count("kept") == 1 and "Kept" not in out.columns
    share = {r[0]: r[1] for r in out.where("doc_id >= 120 and doc_id < 400").groupBy(F.col("doc_id") % 2).agg(F.avg(F.col("kept").cast("double"))).collect()}
    assert share[1] > 0.95 and share[0] < 0.05
    assert quality.score(docs.limit(0), heads).count() == 0 and quality.fit(docs.limit(0), labels) == {"quality": None, "toxic": None}


PAGES = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_rows(spark, tmp_path):
    long, key = " ".join(f"word{k}" for k in range(3000)), f'password = "{VALUE}"'
    rows = [(1, long, "en", "a", 1), (1, "another text of this id entirely", "en", "a", 1), (1, long, "en", "a", 1), (2, long + " x", "en", "b", None), (3, None, None, None, None), (3, "", "en", None, 0), (None, "no id " + key, "en", "c", 3), (5, "one two three four five six seven eight nine ten eleven", "en", "d", 4), (6, key, "de", "e", 5)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], PAGES + ", batch int, Kept string")
    spark.createDataFrame([(1, "ONE two, three four five six seven eight nine ten!"), (None, "another text of this id")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages, d = dict(corpus_pipeline.STAGES), str(tmp_path)
    plain = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    every = plain(docs)
    assert plain(stages["quality classifier"](spark, docs, d)) == every  # no labels: nothing is rejected
    kept = plain(stages["n-gram Jaccard join"](spark, docs, d))
    assert kept == sorted([x for x in set(every) if x[0] != 2], key=str)
    clean = plain(stages["benchmark decontamination"](spark, docs, d))
    assert clean == sorted([x for x in every if x[0] != 5 and "another" not in (x[1] or "")], key=str)
    out = stages["secret scans"](spark, docs, d)
    assert out.columns == list(corpus_pipeline.COLUMNS) and not [x for _, x in plain(out) if "kQ2" in (x or "")]
    assert [r["n_chars"] for r in out.where("doc_id = 6").collect()] == [len('password = "[REDACTED:lexed]"')]
    last = stages["BPE encoding and decoding"](spark, docs, d)
    assert last.count() == len(rows) and last.where("doc_id = 3").agg(F.sum("n_tokens")).first()[0] == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_clean_up_drops_what_operators_wrote(spark):
    jaccard.join(spark.createDataFrame([(1, "a b")], DOCS)).count()
    mine = lambda: [t.name for t in spark.catalog.listTables() if t.name.startswith("labelmill_")]
    assert mine() and storage.clean_up(spark) > 1 and not mine()


def test_language_model_edges(spark):
    rows = [(1, "a b", True), (1, "a b", True), (2, None, False), (3, "a " * 400_000, True), (None, "c", None), (4, "", True)]
    out = sorted(((r["doc_id"], r["n_tokens"], r["n_known"]) for r in lm.score(spark.createDataFrame([(*r, 5) for r in rows], DOCS + ", train boolean, batch int")).collect()), key=str)
    assert out == sorted([(1, 3, 3), (1, 3, 3), (2, 1, 1), (3, 400_001, 400_001), (None, 2, 1), (4, 1, 1)], key=str)


def test_language_model_by_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(25)]
    docs = [(k, " ".join(rnd.choices(vocabulary, weights=range(1, 26), k=rnd.randrange(0, 60))), k % 5 > 0) for k in range(120)] + [(500, "w24 w24 unknown w1", False), (501, "unknown", False)]
    toks = {i: [*BLANK.findall(t), "</s>"] for i, t, _ in docs}
    c = Counter(w for i, _, train in docs if train for w in toks[i])
    c2 = Counter(p for i, _, train in docs if train for p in zip(toks[i], toks[i][1:], strict=False))
    q = lambda n: math.ceil(2 ** (math.floor(2 * math.log2(n) + 1e-9) / 2) - 1e-9) if n else 0
    z = sum(map(q, c.values())) + 0.1 * (len(c) + 1)
    p1 = lambda w: (q(c[w]) + 0.1) / z
    u = lambda n: math.ceil(2 ** ((math.floor(2 * math.log2(n) + 1e-9) + 1) / 2) - 1e-9) - 1
    assert all(q(n) <= n <= u(n) for n in range(1, 3000))
    p2 = lambda v, w: 0.75 * p1(w) + 0.25 * q(c2[v, w]) / u(c[v]) if v and c[v] else p1(w)
    equal = 0
    for r in lm.score(spark.createDataFrame(docs, DOCS + ", train boolean")).collect():
        t = toks[r["doc_id"]]
        want = sum(math.log10(p2(v, w)) for v, w in zip([None, *t], t, strict=False))
        assert want - 1e-6 <= r["score"] <= want + 0.3  # the filter's false hits can only raise it
        equal += r["score"] == pytest.approx(want)
    assert equal > 0.6 * len(docs)
    assert sum(p1(w) for w in [*c, "new"]) == pytest.approx(1)
    assert all(0.8 < sum(p2(v, w) for w in [*c, "new"]) <= 1 + 1e-9 for v in c if v != "</s>")


def test_a_stored_model_scores_like_the_first_pass(spark, tmp_path):
    rnd = random.Random(8)
    docs = [(k, " ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.randrange(0, 50))), k % 4 > 0) for k in range(150)] + [(None, None, False)]
    rows = spark.createDataFrame(docs, DOCS + ", train boolean")
    first = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lm.score(rows).collect()}
    lm.fit(rows).save(str(tmp_path / "model"))
    model = lm.Model.load(spark, str(tmp_path / "model"))
    assert model.tokens == sum(len(BLANK.findall(t)) + 1 for _, t, train in docs if train)
    new = spark.createDataFrame([(900, "w1 w2 zebra w1 w2"), (901, None), (902, "w1 w2 zebra w1 w2")], DOCS).withColumn("Part", F.lit("x"))
    got = {r["doc_id"]: r for r in lm.apply(model, rows.select("doc_id", "text").unionByName(new.drop("Part"))).collect()}
    assert {i: (got[i]["n_tokens"], got[i]["score"]) for i in first} == {i: (n, pytest.approx(s, abs=1e-9)) for i, (n, s) in first.items()}
    assert got[900]["n_known"] == 5 and got[900]["score"] == got[902]["score"] < got[901]["score"]
    assert lm.apply(model, new.drop("Part").limit(0)).count() == 0
    none = lm.fit(rows.limit(0))
    assert (none.tokens, none.types) == (0, 0)


def test_fingerprints_by_brute_force(spark):
    xxhash = pytest.importorskip("xxhash")
    rnd = random.Random(12)
    texts = ["", "one", "two words", " ".join(rnd.choices("a bb ccc dddd eeeee".split(), k=60)), "x" * 40 + " tail of words here and there", "".join(rnd.choices("\u4e00\u4e8c\u4e09", k=90)), "tab\tand\nline " * 9, " ".join(f"w{k}" for k in range(64)), " ".join(f"w{k}" for k in range(65)), "z" * 128 + " a b"]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    left = lambda v, k: (v << k % 64 | v >> 64 - k % 64) & (1 << 64) - 1 if k % 64 else v

    def rolling(pieces, size):
        """The hash of each window, from the one before it; windows at the end are shorter."""
        codes, out, h, end = [xxhash.xxh64_intdigest(x.encode(), 42) for x in pieces], [], 0, 0
        for i in range(len(codes)):
            if end <= i:
                h, end = 0, i
            while end < min(i + size, len(codes)):
                h, end = left(h, 1) ^ codes[end], end + 1
            out.append(signed(h))
            h ^= left(codes[i], end - 1 - i)
        return out

    def kept(text):
        blanks = re.sub("[\t\n\x0b\x0c\r]", " ", " " + text)
        pieces = re.findall(r" \S(?!\S)|(?<!\S)\S{2,16}(?!\S)|\S", blanks)
        n, out = len(pieces), []
        short, long = rolling(pieces, 3), rolling(pieces, fingerprint.LONG_GRAM)
        grams = [(long[i] if len(pieces[i]) == 1 else short[i]) >> 24 for i in range(max(n - 2, 1))] if n else []
        for i in range(max(len(grams) - 7, 1) if grams else 0):
            best = min(range(i, min(i + 8, len(grams))), key=lambda k: (grams[k], -k))
            if not out or out[-1] != best:
                out.append(best)
        return ",".join(f"{grams[k] & ((1 << 40) - 1):010X}:{k}" for k in out)

    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: kept(t) for i, t in enumerate(texts)}


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(3, "b c d e f"), (3, "a b c d e"), (None, "z y x w"), (1, "q" * 20000), (1, None), (2, "one inserted character " * 200)]
    out = fingerprint.compare_edited(spark.createDataFrame([(i, t, 4) for i, t in rows], DOCS + ", Bucket int")).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -1), r[1] or ""))
    want = sorted((i if i is not None else -1, len(t or ""), sha((t or "")[: len(t or "") - len(t or "") // 3] + (order[(k + 1) % len(order)][1] or "")[: len(t or "") // 3])) for k, (i, t) in enumerate(order))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["edited_sha256"]) for r in out) == want
    long = "".join(random.Random(3).choices("\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03", k=3000))
    words = " ".join(random.Random(4).choices([f"w{k}" for k in range(300)], k=3000))
    for text in (long, words):
        m = [r["h"] for r in spark.createDataFrame([(0, text), (1, "x" + text)], DOCS).select(fingerprint.hashes(fingerprint.marks(F.col("text"))).alias("h")).collect()]
        assert len(set(m[0]) & set(m[1])) / len(set(m[0]) | set(m[1])) > 0.9


def test_words_of_brute_force_agree():
    data, offsets = textbuf.utf8(__import__("pyarrow").array(["Ab  c\td", None, "é e"]))
    s, e, row = textbuf.word_bounds(textbuf.LOWER[data], offsets, textbuf.NOT_BLANK)
    assert [bytes(data[a:b]).decode().lower() for a, b in zip(s, e, strict=True)] == BLANK.findall("ab  c\td") + ["é", "e"]
    assert decontaminate.winnow(np.arange(3, dtype=np.uint64), 6).tolist() == []
