"""Hand-computed cases of functions and operators."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.functions.distributions import f_quantile
from labelmill.operators import agreement as A
from labelmill.operators import benchmark as B
from labelmill.operators import extraction as E
from labelmill.operators import labels as L
from labelmill.operators import learning as T
from labelmill.operators import metrics as M
from labelmill.operators import planning as P
from labelmill.operators import reports as S
from labelmill.operators import stemming
from labelmill.operators import validation as V
from labelmill.sources import readers as R
from labelmill.sources import writers as W


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_sections(spark):
    text = "Findings\r\nclear lungs\n\n\n\n  impression no change  \n"
    assert one(spark, text, lambda c: X.section(X.normalise(c), "FINDINGS")) == "clear lungs"
    assert one(spark, text, lambda c: X.section(X.normalise(c), "IMPRESSION")) == "no change"
    assert one(spark, text, lambda c: X.section(c, "ADDENDUM")) is None
    assert one(spark, "FINDINGS:\n\n ", lambda c: X.section(c, "FINDINGS")) is None
    assert one(spark, "a\n\nb \n\n", X.last_paragraph) == "b"
    assert one(spark, "FINDINGS: x\nIMPRESSION is part\nmore", lambda c: X.section(c, "FINDINGS")) == "x"
    assert one(spark, "FINDINGS: x\nIMPRESSION is part\nTechnique :\nmore", lambda c: X.section(c, "FINDINGS", own_line=True)) == "x\nIMPRESSION is part"
    assert one(spark, "Findings: x here IMPRESSION\nz", lambda c: X.section(c, "FINDINGS")) == "x here IMPRESSION\nz"


@pytest.mark.parametrize(("value", "want"), [("12", 12), ("12.0", 12), ("1.5", None), ("-3", None), ("x", None), (None, None)])
def test_normalised_id(spark, value, want):
    assert one(spark, value, X.normalised_id) == want


@pytest.mark.parametrize(("value", "want"), [(None, "missing"), ("", "empty"), (" a", "leading_or_trailing_whitespace"), ("..", "dot_path_component"), ("a.", "trailing_dot"), ("a:b", "windows_invalid_character"), ("con.txt", "windows_reserved_device_name"), ("ok", None)])
def test_unsafe_ids(spark, value, want):
    assert one(spark, value, X.unsafe_id_reason) == want


def test_split_bucket_is_fixed(spark):
    assert one(spark, "1", lambda c: X.split_bucket(c, "x")) == 1642


def test_utf16_offsets(spark):
    assert one(spark, "a\U0001f642b", lambda c: X.utf16_offset(c, F.lit(2))) == 3


def test_ranking_metrics_by_hand(spark):
    d = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    r = M.ranking_metrics(d, []).first()
    assert r["roc_auc"] == pytest.approx(0.875)
    assert r["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert M.ranking_metrics(d.where("label = 1"), []).first()["roc_auc"] is None


def test_threshold_metrics_without_denominators(spark):
    r = M.threshold_metrics(spark.createDataFrame([(1, 0.1)], "label int, score double"), []).first()
    assert (r["precision"], r["recall"], r["specificity"], r["f1"]) == (0.0, 0.0, None, 0.0)


def test_icc_of_equal_raters(spark):
    d = spark.createDataFrame([(c, r, "t", float(c)) for c in range(5) for r in "ab"], "case_id long, rater string, task string, value double")
    r = A.icc(d, 2).first()
    assert r["icc_single"] == pytest.approx(1) and r["icc_mean"] == pytest.approx(1)


@pytest.mark.parametrize(("p", "width"), [(0.8, 0.05), (0.9, 0.1), (0.5, 0.49), (0.99, 0.02)])
def test_cases_for_width_is_the_least(spark, p, width):
    n = spark.range(1).select(P.cases_for_width(F.lit(p), F.lit(width)).alias("n")).first()["n"]
    half = lambda k: P.Z95 / (1 + P.Z95**2 / k) * (p * (1 - p) / k + P.Z95**2 / (4 * k * k)) ** 0.5
    assert half(n) <= width and (n == 2 or half(n - 1) > width)


def test_workload_without_minutes_of_a_task(spark):
    d = spark.createDataFrame([("image", "s", 10, 20, 0.25), ("report", "s", 12, 18, 0.5), ("image", "alone", 1, 1, 0.0)], "task string, scenario string, complete_needed long, invited long, disagreement_rate double")
    got = {(r["task"], r["scenario"], r["design"]): (r["ratings"], r["hours"]) for r in P.workload(d, 3, 0.2, {"image": 3.0, "report": None}).collect()}
    assert got["image", "s", "all_raters"] == (60, 3.0) and got["report", "s", "one_rater_and_overlap"] == (26, None)
    assert got["both", "s", "two_raters_and_third_on_disagreement"] == (45 + 45, None)
    assert ("both", "alone", "all_raters") not in got


def test_silver_ladder(spark):
    names = ["text_present", "text_uncertain", "text_negated", "text_edema", "text_atelectasis", "text_airspace", "graph_strict", "graph_sensitive", "graph_both_uncertain", "graph_edema", "graph_atelectasis", "graph_airspace"]
    case = lambda label, has, *true: (*(n in true or (None if n in ("graph_edema", "text_edema") else False) for n in names), has, label, 0, None, 0)
    rows = [case(1, True, "text_present", "graph_strict", "graph_sensitive"), case(0, True), case(None, False), case(1, True), case(-1, True), case(0, True, "text_present", "text_negated"), case(0, True, "text_uncertain"), case(0, True, "graph_sensitive")]
    d = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", has_labels boolean, label_opacity int, label_edema int, label_consolidation int, label_atelectasis int")
    got = [(r["silver_strict"], r["silver_sensitive"], r["silver_score"], r["review_priority"], r["qa_flags"]) for r in S.silver(d, "v1").collect()]
    assert got == [
        (1, 1, 0.95, "low", []), (0, 0, 0.05, "low", []), (None, None, None, "low", []), (None, None, 0.35, "medium", ["broad_opacity_without_bilateral_signal"]), (None, None, 0.3, "low", []),
        (None, None, 0.05, "high", ["radgraph_regex_disagreement", "positive_and_negated_conflict"]), (None, 1, 0.55, "high", []), (None, 1, 0.75, "low", []),
    ]


def test_offsets_both_ways(spark):
    text = "a\U0001f642b\U0001f642"
    units = [len(text[:k].encode("utf-16-be")) // 2 for k in range(len(text) + 1)]
    for n in range(-1, 8):
        assert one(spark, text, lambda c, n=n: X.code_point_offset(c, F.lit(n))) == (units.index(n) if n in units else None)
    assert one(spark, text, lambda c: X.covered_text(c, F.lit(1), F.lit(3))) == "\U0001f642b" and one(spark, text, lambda c: X.covered_text(c, F.lit(2), F.lit(9))) is None


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("opacities", "opac"), ("Infiltrates", "infiltr"), ("edema", "edema"), ("probate", "probat"), ("controll", "control"), ("O2s", "o2s"), ("adoption", "adopt"), ("y", "y")])
def test_stems(word, want):
    assert stemming.stem(word) == want


def test_violations_raise(spark):
    found = V.failed(spark.createDataFrame([(1,), (-1,)], "x int"), {"positive": F.col("x") < 0, "known": F.col("x").isNull()})
    assert [(r["check"], r["n_rows"]) for r in found.collect()] == [("positive", 1)]
    with pytest.raises(ValueError, match="positive"):
        V.require(found)


def spec(**more):
    base = {"terms": (("bilateral", "SIDE"), ("opacity", "OBJECT"), ("both lungs", "SIDE")), "cues": (("no", E.NEGATION), ("ruled out", E.AFTER), ("no change", E.PSEUDO), ("not only", E.PSEUDO), ("but", E.CONJUNCTION), ("not", E.NEGATION)), "rules": (("SIDE", "OBJECT"), ("OBJECT", "SIDE")), "stem": stemming.stem}
    return E.Spec(**base | more)


def test_extraction_negation_and_promotion(spark):
    texts = ["bilateral opacities. no bilateral opacity\nopacity", "no change but bilateral opacity", None, "\U0001f642 Bilateral opacities ruled out", "there is no change, bilateral opacity", "No change bilateral opacity", "not only bilateral opacity", "opacity in both Lungs", "", "bilateral and some other kinds of very far opacity"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    found, per_doc, again = E.extract(docs, spec())
    got = sorted((r["doc_id"], r["begin"], r["end"], r["begin16"], r["phrase"]) for r in found.collect())
    assert got == [(1, 10, 19, 10, "opacity"), (2, 24, 31, 24, "opacity"), (5, 30, 37, 30, "opacity"), (7, 19, 26, 19, "opacity"), (8, 11, 21, 11, "both lungs")]
    assert {r["doc_id"]: r["label"] for r in per_doc.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1, 8: 1, 9: 0, 10: 0}
    assert again.count() == 0
    with pytest.raises(ValueError, match="document_id_repeats: 1 rows"):
        V.require(E.extract(docs.union(docs.where("doc_id = 1")), spec())[2])


def test_sentences_and_offsets(spark):
    text = "Dr. smith saw approx. three opacities in St. Mary. New one\r\nlast opacity " + "x " * 300 + "opacity"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    m = E.marks(docs, spec(terms=(("opacity", "O"),), cues=(), abbreviations=frozenset({"Dr.", "approx"}), longest_sentence=100)).orderBy("begin").collect()
    assert [text[r["begin"] : r["end"]] for r in m] == ["opacities", "opacity", "opacity"] and [(r["sentence"], r["part"]) for r in m] == [(0, 0), (3, 0), (3, 3)]


def test_report_tree(spark, tmp_path):
    d = tmp_path / "p10" / "p10000001"
    d.mkdir(parents=True)
    (d / "s50000001.txt").write_bytes(b"FINDINGS: x\xff")
    rows, checks = R.report_tree(spark, str(tmp_path))
    r = rows.first()
    assert (r["subject_id"], r["study_id"]) == (10000001, 50000001) and r["report_text"].startswith("FINDINGS: x") and checks.count() == 0
    (tmp_path / "sbad.txt").write_text("x")
    (d / "p10000002").mkdir()
    (d / "p10000002" / "s50000001.txt").write_text("again")
    with pytest.raises(ValueError, match="ids_in_path: 1 rows; study_repeats: 2 rows"):
        V.require(R.report_tree(spark, str(tmp_path))[1])
    assert [c["check"] for c in R.report_tree(spark, str(tmp_path), subject="/nothing(.)/")[1].collect()] == ["ids_in_path", "study_repeats"]


def test_entity_graphs(spark, tmp_path):
    e = {"1": {"tokens": ["left", "lung"], "label": "A", "start_ix": 0, "end_ix": 1, "relations": [["at", "2"], ["bad"]]}, "2": {"tokens": "lung", "labels": ["B", "C"], "relations": []}}
    (tmp_path / "g.json").write_text(json.dumps({"r1": {"text": "t", "entities": e}}) + "\n")
    reports, entities, relations = R.entity_graphs(spark, str(tmp_path / "g.json"))
    assert reports.count() == 1
    assert sorted((r["entity_id"], r["tokens"], r["label"]) for r in entities.collect()) == [("1", "left lung", "A"), ("2", "lung", "B|C")]
    assert [tuple(r) for r in relations.collect()] == [("r1", "1", "at", "2")]


def test_extractor_outputs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("Start\tEnd\tSemantic\tEntity\n1\t4\tX\tabc\n")
    (tmp_path / "b.tsv").write_text("Start\tEnd\n1\t2\n")
    (tmp_path / "c.tsv").write_text("\n")
    entities, status = R.extractor_outputs(spark, str(tmp_path))
    assert [(r["doc_id"], r["start"], r["end"], r["semantic_tag"], r["entity_text"]) for r in entities.collect()] == [("a", 1, 4, "X", "abc")]
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {"a": "parsed", "b": "parse_error", "c": "parsed_empty"}


def test_label_csv_and_documents(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Subject ID,No Finding\n1,1.0\n2,x\n")
    assert [tuple(r) for r in R.label_csv(spark, str(tmp_path / "l.csv"), ["subject_id"], ["no_finding", "other"]).collect()] == [(1, 1), (2, None)]
    with gzip.open(tmp_path / "d.jsonl.gz", "wt") as f:
        f.write('{"i": 1, "t": "x"}\n{"i": " ", "t": "y"}\n')
    rows, checks = R.documents(spark, str(tmp_path / "d.jsonl.gz"), "json", "i", "t", "x-")
    assert [(r["check"], r["n_rows"]) for r in checks.collect()] == [("id_present", 1)] and rows.where("doc_id = 'x-1'").count() == 1
    with pytest.raises(ValueError, match="columns"):
        R.documents(spark, str(tmp_path / "d.jsonl.gz"), "json", "i", "nope")


def test_no_task_or_pair_of_raters_meets_in_one_window(spark):
    r = spark.createDataFrame([(c, f"R{k}", "image", float((c * 7 + k * k) % 5)) for c in range(30) for k in range(3)], "case_id long, rater string, task string, value double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(A.icc(r, 3))
    lines = plan(A.pairwise_agreement(r)).splitlines()
    windows = [x for x in lines if "Window [" in x]
    assert windows and all("_range" in x for x in windows)
    for n, want in ((4, [1.0, 3.0, 4.0, 2.0]), (6, [1.5, 4.0, 6.0, 3.0, 5.0, 1.5])):
        assert [x["rank"] for x in A.with_ranks(r.where(f"rater = 'R0' and case_id < {n}"), {"value": "rank"}, ["task"]).orderBy("case_id").collect()] == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 11, 200, 30_000])
def test_quantiles_equal_sorting(spark, n):
    import numpy as np

    rng = np.random.default_rng(n)
    columns = {"even": rng.random(n), "ties": rng.integers(0, 4, n) * 1.0, "most": np.where(rng.random(n) < 0.9, 7.0, rng.normal(0, 50, n)), None: np.arange(n) % 97.0}
    rows = [(g, float(v)) for g, x in columns.items() for v in x] + [("even", None)]
    shares = {f"q{int(q * 1000)}": q for q in (0, 0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975, 1)}
    got = {r["g"]: r for r in M.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", shares).collect()}
    for g, x in columns.items():
        assert [got[g][k] for k in shares] == pytest.approx(list(np.quantile(x, list(shares.values()))))
    whole = M.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.quantile(np.concatenate(list(columns.values())), 0.5))


def test_learning_inputs_and_tasks(spark):
    rows = [(i, ("train", "validation", "test")[i % 3], i % 2, 1 - i % 2 if i % 5 else None, "high" if i % 2 else "x", bool(i % 2), float(i % 2 * 3 + i % 4)) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, split string, a int, b int, word string, flag boolean, size double")
    f, here = T.structured_features(d, ["flag", "size", "word", "nope"])
    assert here == ["flag", "size", "word"] and f.first()["word"] is None and f.where("doc_id = 1").first()["flag"] == 1.0
    with pytest.raises(ValueError, match="label-derived"):
        T.structured_features(d, ["silver_score"])
    scored = T.fit_tasks(f.fillna(0, here), {"a": "a", "b": "b"}, {"m": T.structured_pipeline(["flag", "size"])})
    assert {(r["task"], r["split"]): r["roc_auc"] for r in M.ranking_metrics(scored, ["task", "split"]).collect()} == {(t, s): 1.0 for t in "ab" for s in ("validation", "test")}
    assert scored.columns == ["doc_id", "split", "model", "label", "score", "task"]
    with pytest.raises(ValueError, match="without rows"):
        T.fit_tasks(f.where("split <> 'test'").fillna(0, here), {"a": "a"}, {"m": T.structured_pipeline(["size"])})
    with pytest.raises(ValueError, match="two classes"):
        T.fit_tasks(f.where("a = 1").fillna(0, here), {"a": "a"}, {"m": T.structured_pipeline(["size"])})
    assert one(spark, "Ünï ça ñ ø \u1ea5 \ufb01 \u0430\u0301 \u2167", lambda c: T.unaccented(c)) == "Uni ca n ø a fi \u0430 VIII" and one(spark, None, lambda c: T.unaccented(c)) is None
    with pytest.raises(ValueError, match="several splits"):
        L.assert_no_leaks(d.withColumn("word", F.lit("s")), "word")


def test_text_model_tells_words_apart(spark):
    rows = [(i, ("train", "validation", "test")[i % 3], float(i % 2), ("good fine calm " if i % 2 else "bad loud wild ") * 3 + f"word{i % 7}") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, split string, label double, text string")
    assert all(r["roc_auc"] == 1.0 for r in M.ranking_metrics(T.fit_and_score(T.with_plain_text(d), T.text_pipeline(50), "text"), ["split"]).collect())


def test_f_quantiles_and_reliability_limits():
    assert f_quantile(0.975, 5, 10) == pytest.approx(4.2361, abs=1e-4) and f_quantile(0.95, 1, 1) == pytest.approx(161.4476, rel=1e-4) and f_quantile(0.5, 7.5, 3.25) == pytest.approx(1 / f_quantile(0.5, 3.25, 7.5))
    low, high = A.icc_limits(6, 11.2417, 32.4861, 1.0194, 0.2898, 4, 0.95)
    assert low == pytest.approx(0.0188, abs=2e-3) and high == pytest.approx(0.7611, abs=2e-3)


def test_reliability_by_hand(spark):
    scores = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    r = spark.createDataFrame([(c, f"R{k}", "t", float(v)) for c, row in enumerate(scores) for k, v in enumerate(row)], "case_id long, rater string, task string, value double")
    got = A.icc(r, 4).first()
    assert (got["icc_single"], got["icc_mean"], got["status"]) == (pytest.approx(0.2898, abs=1e-4), pytest.approx(0.6201, abs=1e-4), "estimated")
    assert got["single_low"] == pytest.approx(0.0188, abs=2e-3) and got["mean_high"] == pytest.approx(0.9272, abs=2e-3)
    assert A.icc(r.where("case_id = 0"), 4).first()["status"] == "insufficient_balanced_cases"


def test_benchmark_refusals(spark):
    a = spark.createDataFrame([("1", 0.5), ("2", 0.7)], "case_id string, prediction_score double")
    with pytest.raises(ValueError, match="left_only 1"):
        B.one_to_one(a, a.where("case_id = '1'"), ["case_id"])
    raw = spark.createDataFrame([("1", 0.5, 0.4, "x"), ("2", 1.2, 0.0, "x")], "case_id string, p double, q double, raw string")
    with pytest.raises(ValueError, match="p_range: 1 rows; sum_of_classes: 2 rows"):
        B.class_probabilities(raw, a.select("case_id"), ["p", "q"], "p", "raw", "x")
    with pytest.raises(Exception, match="gave 1 scores"):
        B.batch_scores(a.withColumn("text", F.lit("x")).coalesce(1), "text", lambda t: [1.0], name="s").collect()
    r = spark.createDataFrame([(1, 2, "text here", "", "fall", "train", ["none"]), (1, 3, "t", "both", "f", "train", ["odd"])], "subject long, study long, report_text string, scope_both string, scope_fallback string, split string, qa_flags array<string>")
    out = {x["case_id"]: (x["scope_both"], x["fallback_used"], x["flags_present"]) for x in B.source(r.drop("split", "qa_flags"), r.select("subject", "study", "split", "qa_flags")).collect()}
    assert out == {"case_1_2": ("fall", True, False), "case_1_3": ("both", False, True)}
    with pytest.raises(ValueError, match="subject_in_several_splits"):
        B.source(r.drop("split", "qa_flags"), r.select("subject", "study", F.when(F.col("study") == 2, "test").otherwise("train").alias("split"), "qa_flags"))
    with pytest.raises(ValueError, match="texts or paths"):
        V.canonical_predictions(a.withColumn("report_text", F.lit("x")))
    assert V.canonical_predictions(a)[1].first()["check"].startswith("required_columns")


def test_text_model_equals_a_fit_by_hand(spark):
    import itertools
    import re

    import numpy as np

    rnd = np.random.default_rng(4)
    words = ["alpha", "beta", "gämma", "delta", "a", "opacity", "x1"]
    rows = [(i, " ".join(rnd.choice(words, 6)) + (" clear" if i % 3 else " Opacity seen"), float(i % 3 == 0)) for i in range(40)]
    d = T.with_plain_text(spark.createDataFrame(rows, "doc_id long, text string, label double"))
    model = T.text_pipeline(strength=2.0).fit(T.balanced(d))
    vocabulary, fit = model.stages[3].vocabulary, model.stages[-1]
    grams = []
    for _, text, _ in rows:
        w = re.findall(r"\b\w\w+\b", text.lower().replace("ä", "a"))
        grams.append(w + [f"{a} {b}" for a, b in itertools.pairwise(w)])
    df = {g: sum(g in x for x in grams) for x in grams for g in x}
    assert set(vocabulary) == {g for g, n in df.items() if n >= 2}
    x = np.array([[g.count(v) * (np.log((1 + len(rows)) / (1 + df[v])) + 1) for v in vocabulary] for g in grams])
    x = np.c_[x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.ones(len(rows))]
    y = np.array([r[2] for r in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps on |w|^2 / 2 + 2 * sum of weighted losses
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(np.eye(len(w)) + 2 * (x * (weight * p * (1 - p))[:, None]).T @ x, w + 2 * x.T @ (weight * (p - y)))
    assert fit.coefficients.toArray() == pytest.approx(w, abs=1e-4) and fit.intercept == 0
    got = {r["doc_id"]: r["probability"][1] for r in model.transform(d).collect()}
    assert [got[i] for i, *_ in rows] == pytest.approx(1 / (1 + np.exp(-x @ w)), abs=1e-4)
