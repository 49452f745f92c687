"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from labelmill.operators import parity as P
from labelmill.operators import validation as V
from labelmill.operators.extraction import NEGATION
from labelmill.sources import readers as R
from labelmill.sources import writers as W


def docs(spark):
    return spark.createDataFrame([("b", "some text", "en"), ("a", "more", "de"), ("c", "", "en")], "id string, body string, lang string")


def test_whole_file_graphs_and_ids(spark, tmp_path):
    e = {"1": {"tokens": ["left", "lung"], "label": "A", "start_ix": 0, "end_ix": 1, "relations": [["at", "2"]]}, "2": {"tokens": "lung", "labels": ["B", "C"], "relations": []}}
    (tmp_path / "g.json").write_text(json.dumps({"p10/s50000001.txt": {"text": "t", "entities": e}, "p11/s50000002.txt": {"text": "u", "entities": {}}}, indent=2))
    reports, entities, relations = R.entity_graphs(spark, str(tmp_path / "g.json"), whole_file=True)
    assert sorted(r["text"] for r in reports.collect()) == ["t", "u"] and relations.count() == 1
    assert {(r["study_id"], r["tokens"]) for r in R.mapped_ids(entities).collect()} == {(50000001, "left lung"), (50000001, "lung")}
    with pytest.raises(ValueError, match="no study id"):
        R.mapped_ids(entities.withColumn("report_key", F.lit("x")))


def test_rater_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,img,img_done,rep,rep_done,free\n001,50,2,,0,secret\n002,130,2,9,1,x\n002,5,7,9,1.5,x\n,1,2,,,\n")
    rows, checks = R.rater_exports(spark, {"R1": str(tmp_path / "a.csv")}, "id", {"image": "img", "report": "rep"}, {"image": "img_done", "report": "rep_done"}, {"record": "no"})
    assert set(rows.columns) == {"case_id", "rater", "record", "image_rating", "report_rating", "image_complete", "report_complete"}
    assert [r["case_id"] for r in rows.where("image_rating = 50").collect()] == ["001"]
    assert {r["check"]: r["n_rows"] for r in checks.collect()} == {"case_id_present": 1, "image_completion": 1, "image_rating": 1, "report_completion": 1, "case_repeats": 2}
    with pytest.raises(ValueError, match="missing columns"):
        R.rater_exports(spark, {"R1": str(tmp_path / "a.csv")}, "id", {"image": "nope"}, {"image": "img_done"})


HEAD = "Start\tEnd\tSemantic\tAssertion\tCUI\tEntity\n"


@pytest.mark.parametrize(("body", "reason"), [("", "missing_output"), ("\n\n", "missing_header"), ("Start\tEnd\n1\t2\n", "missing_required_fields:assertion,cui,entity_text,semantic_tag"), (HEAD + "1\t2\tX\tpresent\tnull\tab\n3\tx\tX\t\t\tab\n5\t4\t\t\t\t\n", "invalid_offsets:row_3"), (HEAD + "1\t2\t \t\t\tab\n", "blank_semantic_tag:row_2"), (HEAD + "1\t2\tX\t\t\t\n", "blank_entity_text:row_2"), (HEAD + "1\t2\tX\t\t\ta\tb\n", "extra_fields:row_2")])
def test_complete_outputs_refuse(spark, tmp_path, body, reason):
    (tmp_path / "d1.txt").write_text(body)
    with pytest.raises(ValueError, match=reason):
        R.complete_outputs(spark, str(tmp_path), spark.createDataFrame([("d1",)], "doc_id string"))


def test_complete_outputs(spark, tmp_path):
    (tmp_path / "d1.txt").write_text("\ufeff" + HEAD.replace("Semantic", "semantic_tag") + "1\t2\tX\tNULL\tC1\tab\n")
    (tmp_path / "d2.txt.txt").write_text(HEAD)
    manifest = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    entities, status = R.complete_outputs(spark, str(tmp_path), manifest)
    assert [(r["doc_id"], r["start"], r["assertion"], r["cui"], r["entity_text"]) for r in entities.collect()] == [("d1", 1, None, "C1", "ab")]
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {"d1": "parsed", "d2": "parsed_empty"}
    with pytest.raises(ValueError, match="d3:missing_output"):
        R.complete_outputs(spark, str(tmp_path), manifest.union(spark.createDataFrame([("d3",)], "doc_id string")))
    with pytest.raises(ValueError, match="d2:unexpected_output"):
        R.complete_outputs(spark, str(tmp_path), manifest.limit(1))


def test_tables_packets_and_status(spark, tmp_path):
    docs(spark).write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert R.typed_table(spark, str(tmp_path / "t.csv")).count() == 3
    with pytest.raises(ValueError, match="neither"):
        R.typed_table(spark, str(tmp_path / "t.json"))
    (tmp_path / "p.jsonl").write_text('{"case_id": "1", "n": 2}\n\n{"case_id": "2"}\n')
    assert [tuple(r) for r in R.packet_rows(spark, str(tmp_path / "p.jsonl"), "case_id string, n int").collect()] == [("1", 2), ("2", None)]
    (tmp_path / "q.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        R.packet_rows(spark, str(tmp_path / "q.jsonl"), "case_id string").collect()
    (tmp_path / "s1.json").write_text(json.dumps({"name": "m", "status": "available", "details": {"run_id": "r", "models": ["m"]}}, indent=1))
    (tmp_path / "s2.json").write_text("[1, 2]")
    got = R.status_files(spark, [str(tmp_path / f"s{k}.json") for k in (1, 2, 3)]).collect()
    assert [(r["name"], r["run_id"], r["models"]) for r in got] == [("m", "r", ["m"])] and R.status_files(spark, [str(tmp_path / "no.json")]).count() == 0
    (tmp_path / "m1.csv").write_text("task,auc\na,0.5\n")
    (tmp_path / "m2.csv").write_text("task,f1\nb,0.25\n")
    assert R.metric_tables(spark, [str(tmp_path / "m1.csv"), str(tmp_path / "m2.csv")], ["task"]).count() == 2
    with pytest.raises(ValueError, match="missing columns"):
        R.metric_tables(spark, [str(tmp_path / "m1.csv")], ["f1"])
    (tmp_path / "i.csv").write_text("task,rated_cases,complete_cases,share_25,share_50,icc_single,status\nimage,1,1,0,0,0,x\n")
    (tmp_path / "q.csv").write_text("check,value\na,1\n")
    with pytest.raises(ValueError, match="report"):
        R.planning_inputs(spark, str(tmp_path / "i.csv"), str(tmp_path / "q.csv"))


def test_specification_files(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"terms": [{"term": "a b", "tag": "X"}], "rules": [["X", "Y"]], "final": "Z", "excluded": ["q"], "scope": 7}))
    (tmp_path / "c.txt").write_text(f"no\t{NEGATION}\n\n")
    (tmp_path / "r.txt").write_text("DELIMETER=.DEL,DEL\\t\nSTRING_NO_SPLIT=x\n")
    (tmp_path / "a.txt").write_text("Dr.\n")
    s = R.extraction_spec(spark, *(str(tmp_path / n) for n in ("d.json", "c.txt", "r.txt", "a.txt")))
    assert (s.terms, s.cues, s.rules, s.final, s.scope, s.delimiters, s.abbreviations) == ((("a b", "X"),), (("no", NEGATION),), (("X", "Y"),), "Z", 7, ".,\t", {"Dr."})
    (tmp_path / "c.txt").write_text("no\n")
    with pytest.raises(ValueError, match="malformed"):
        R.extraction_spec(spark, *(str(tmp_path / n) for n in ("d.json", "c.txt", "r.txt")))


def test_catalog(spark):
    W.replace_table(docs(spark), "docs_1", "study_x")
    W.replace_table(docs(spark).limit(2), "docs_1", "study_x")
    assert [r["tableName"] for r in R.catalog_listing(spark, "study_x").collect()] == ["docs_1"]
    assert "study_x" in [r[0] for r in R.schema_listing(spark).collect()]
    rows = R.named_table(spark, "study_x.docs_1", ["id"], "body", "local", limit=1).collect()
    assert len(rows) == 1 and rows[0]["source_dataset"] == "local"
    with pytest.raises(ValueError, match="not a table name"):
        R.named_table(spark, "a; drop", ["id"], "body", "x")
    with pytest.raises(ValueError, match="has rows"):
        W.load_table(docs(spark), "study_x.docs_1")
    W.load_table(docs(spark), "study_x.docs_1", replace=True)
    W.load_table(docs(spark).limit(0), "study_x.docs_2")
    W.load_table(docs(spark), "study_x.docs_2")
    assert spark.table("study_x.docs_1").count() == spark.table("study_x.docs_2").count() == 3
    spark.sql("DROP DATABASE study_x CASCADE")


def test_packet_and_shared_tables(spark, tmp_path):
    manifest, summary = W.packet(docs(spark), str(tmp_path / "p"), "id", ["body"], ["lang"])
    assert sorted((r["input_order"], r["id"], r["body_characters"]) for r in manifest.collect()) == [(0, "a", 4), (1, "b", 9), (2, "c", 0)]
    assert V.unsafe_columns(manifest.drop("body_characters"), "comparator") == [] and summary.first()["n_rows"] == 3
    with pytest.raises(ValueError, match="texts or paths"):
        W.shared_table(docs(spark).withColumnRenamed("body", "body_text"), str(tmp_path / "s"))
    W.shared_table(docs(spark).withColumn("flags", F.array("lang")), str(tmp_path / "s"), "csv", ["lang"])
    assert (tmp_path / "s" / "lang=en").exists() and '["en"]' in "".join(p.read_text() for p in (tmp_path / "s" / "lang=en").glob("*.csv")).replace('""', '"').replace('\\"', '"')
    m = spark.createDataFrame([("m", "compatibility_mirror", 1), ("n", None, 2), ("o", "mismatched_target_exploratory", 3)], "model_name string, comparison_role string, n int")
    W.role_tables(m, str(tmp_path / "roles"))
    assert [spark.read.csv(str(tmp_path / "roles" / k), header=True).first()["n"] for k in ("primary", "compatibility", "exploratory")] == ["2", "1", "3"]
    assert W.flattened(docs(spark), {"a": lambda d: d, "b": lambda d: d.where("id = 'a'"), "none": lambda d: d.limit(0)}, str(tmp_path / "flat")) == {"a": 3, "b": 1, "none": 0}
    assert spark.read.parquet(str(tmp_path / "flat" / "b")).count() == 1


def test_document_export_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x y", "a"), (2, None, "b"), (3, "z", "con"), (4, "z", "t"), (5, "z", "t")], "n int, text string, name string")
    m = P.export_manifest(rows, "{name}", ["name"])
    out = W.documents(rows, m, str(tmp_path / "e"), "n", "text", 2)
    assert {r["n"]: (r["export_status"], r["reason"]) for r in out.collect()} == {1: ("written", ""), 2: ("skipped", "missing_text"), 3: ("skipped", "unsafe_doc_id:windows_reserved_device_name"), 4: ("skipped", "duplicate_doc_id"), 5: ("skipped", "duplicate_doc_id")}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "e" / "texts")).collect()] == [("a", "x y")]
    listed = W.with_manifest({"open": (docs(spark).select("id"), "metrics", False), "closed": (docs(spark), "texts", True)}, str(tmp_path / "o"))
    assert {(r["artifact"], r["n_rows"], r["restricted"]) for r in listed.collect()} == {("open", 3, False), ("closed", 3, True)}


def test_ledgers_keep_their_schemas(spark, tmp_path):
    e = spark.createDataFrame([("d", 1, 2, "h", "T", "present", None, 1)], "doc_id string, start long, end long, entity_sha256 string, semantic_tag string, assertion string, cui string, position int")
    p = spark.createDataFrame([("d", "evaluable", 1, 1)], "doc_id string, status string, label int, n_entities long")
    *tables, summary = P.parity((e, p), (e, p), require_order=True)
    W.ledgers(*tables, str(tmp_path / "l"))
    assert summary.first()["passed"] and P.parity_complete(summary, 1, p).count() == 0 and P.parity_complete(summary, 2, p).count() == 1
    assert spark.read.parquet(str(tmp_path / "l" / "entities")).columns[-1] == "actual_hash"
    swapped = e.union(e.withColumns({"start": F.lit(5).cast("long"), "position": F.lit(0)}))
    moved = swapped.withColumn("position", -F.col("position"))
    q = p.withColumn("n_entities", F.lit(2).cast("long"))
    *_, s = P.parity((swapped, q), (moved, q), require_order=True)
    assert (s.first()["order_documents"], s.first()["order_positions"], s.first()["passed"]) == (1, 2, False)
    other = e.withColumn("semantic_tag", F.lit("U"))
    found = P.parity((e, p), (other, p))[0]
    assert sorted(r["mismatch"] for r in found.collect()) == ["field_mismatch", "missing_entity", "unexpected_entity"]


def test_status_from_either_column(spark):
    p = spark.createDataFrame([("a", "Evaluable ", "parsed"), ("b", "evaluable", "parse_error"), ("c", "?", "parsed_empty")], "doc_id string, prediction_status string, parse_status string")
    rows, checks = P.status_of(p)
    assert {r["doc_id"]: r["status"] for r in rows.collect()} == {"a": "evaluable", "b": "evaluable", "c": "evaluable"}
    assert {r["check"]: r["n_rows"] for r in checks.collect()} == {"prediction_status_known": 1, "status_conflict": 1}
    with pytest.raises(ValueError, match="need"):
        P.status_of(p.select("doc_id"))


def test_outputs_appear_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "o")

    def refuse(_):
        raise ValueError("refused")

    with pytest.raises(ValueError, match="refused"):
        W.all_or_nothing({"old": docs(spark)}, path, refuse)
    assert not (tmp_path / "o").exists() and list(tmp_path.iterdir()) == []
    W.all_or_nothing({"new": docs(spark)}, path, lambda _: None)
    W.all_or_nothing({"newer": docs(spark).limit(1)}, path, lambda f: f["newer"].count())
    assert [p.name for p in (tmp_path / "o").iterdir()] == ["newer"] and [p.name for p in tmp_path.iterdir()] == ["o"]
    with pytest.raises(ValueError, match="refused"):
        W.all_or_nothing({"bad": docs(spark)}, path, refuse)
    assert spark.read.parquet(f"{path}/newer").count() == 1


def test_outputs_with_commas_and_sniffed_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Start,End,Semantic,Entity\n1,4,X,"one, ""two""\nthree"\nx,9,Y,\n\n')
    (tmp_path / "b.txt").write_text("Begin;Stop;Type;Covered Text\n1;2;X;a,b\n")
    (tmp_path / "c.txt").write_text("Begin,Stop,Type\n1,2,X\n")
    (tmp_path / "d.tsv").write_text("Semantic\tCUI\n\n")
    (tmp_path / "e.txt").write_text("one\ntwo\n")
    (tmp_path / "f.xmi").write_text("<x/>")
    (tmp_path / "g.csv").write_text("Start,End\n1,2\n")
    (tmp_path / "h.json").write_text("{}")
    (tmp_path / "Archive").mkdir()
    (tmp_path / "Archive" / "a.csv").write_text("Semantic\nX\n")
    entities, status = R.extractor_outputs(spark, str(tmp_path))
    got = sorted(((r["doc_id"], r["start"], r["end"], r["semantic_tag"], r["entity_text"]) for r in entities.collect()), key=repr)
    assert got == sorted([("a", 1, 4, "X", 'one, "two"\nthree'), ("a", None, 9, "Y", None), ("b", 1, 2, "X", "a,b"), ("c", 1, 2, "X", None)], key=repr)
    assert {r["file"]: (r["status"], r["reason"]) for r in status.collect()} == {
        "a.csv": ("parsed", None), "b.txt": ("parsed", None), "c.txt": ("parsed", None), "d.tsv": ("parsed_empty", None), "e.txt": ("parse_error", "no_recognized_fields"),
        "f.xmi": ("parse_error", "unsupported_output_format:.xmi"), "g.csv": ("parse_error", "missing_required_field:semantic_tag"),
    }


def test_soft_tables(spark, tmp_path):
    frame = lambda *c: spark.createDataFrame([tuple(range(len(c)))], ", ".join(f"{x} int" for x in c))
    calibration = spark.createDataFrame([("image", 1), ("report", 2)], "target_type string, bin int")
    W.soft_tables({"metrics": frame("model", "brier"), "thresholds": frame("model", "threshold"), "calibration": calibration, "audit": frame("joined_rows")}, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["audit", "calibration", "metrics", "metrics_json", "thresholds"]
    assert {p.name for p in (tmp_path / "s" / "calibration").iterdir() if p.is_dir()} == {"target_type=image", "target_type=report"}
    assert spark.read.json(str(tmp_path / "s" / "metrics_json")).first()["brier"] == 1
    with pytest.raises(ValueError, match="texts or paths"):
        W.soft_tables({"metrics": frame("model", "case_text"), "thresholds": frame("a"), "calibration": calibration, "audit": frame("b")}, str(tmp_path / "t"))


def test_graphs_from_one_parse(spark, tmp_path):
    e = {"1": {"tokens": "lung", "label": "A", "relations": [["at", "2"], ["x"]]}, "2": {"tokens": ["a", "b"], "label": "B", "relations": []}}
    (tmp_path / "g.json").write_text(json.dumps({"r1": {"text": "t", "entities": e}, "r2": {"text": "u", "entities": {}}}))
    assert W.flattened(R.graph_rows(spark, str(tmp_path / "g.json"), whole_file=True), R.GRAPH_TABLES, str(tmp_path / "out")) == {"reports": 2, "entities": 2, "relations": 1}
