"""Large JSON objects by blocks against the standard parser."""

import json
import random

import pytest

from labelmill.sources import json_members as J
from labelmill.sources import readers as R


def made(n, seed):
    rnd = random.Random(seed)
    odd = ["plain words", 'a "quoted" one', "braces } { ] [ }}", "back\\slash \\\\", "line\nbreak", "é\U0001f642", "", '\\"', "}", '"}', "x" * 700]
    out = {}
    for k in range(n):
        entities = {str(i): {"tokens": rnd.choice([["left", "lung}"], "lung"]), "label": rnd.choice(odd), "start_ix": i, "end_ix": i, "relations": [["at{", str(i + 1)]] * rnd.randrange(3)} for i in range(rnd.randrange(5))}
        out[f"p1/s{k:08}.txt" + rnd.choice(["", "}", '{"'])] = {"text": " ".join(rnd.choice(odd) for _ in range(rnd.randrange(6))), "data_source": "s", "entities": entities}
    return out


@pytest.mark.parametrize(("indent", "block"), [(None, 700), (2, 1500), (1, 300), (None, 1 << 20)])
def test_blocks_give_what_the_parser_gives(spark, tmp_path, indent, block):
    data = {f"f{k}.json": made(n, k) for k, n in enumerate((16, 0, 1, 5))}
    for name, x in data.items():
        (tmp_path / name).write_text(json.dumps(x, indent=indent, ensure_ascii=bool(indent)) + ("\n" if indent else ""), encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = J.json_members(spark, str(tmp_path)).collect()
        graphs = [f.collect() for f in R.entity_graphs(spark, str(tmp_path), whole_file=True)]
        if block < 1000:
            assert J._blocks(spark, str(tmp_path)).select("block").distinct().count() > 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, x in data.items():
        found = [json.loads(r["member"]) for r in rows if r["file"].endswith(name)]
        assert all(len(f) == 1 for f in found) and {k: v for f in found for k, v in f.items()} == x and len(found) == len(x)
    merged = {k: v for x in data.values() for k, v in x.items()}
    assert len(graphs[0]) == sum(len(x) for x in data.values()) and {(r["report_key"], r["text"]) for r in graphs[0]} == {(k, v["text"]) for x in data.values() for k, v in x.items()}
    assert len(graphs[1]) == sum(len(v["entities"]) for x in data.values() for v in x.values()) and {r["report_key"] for r in graphs[2]} <= set(merged)


def test_members_without_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text(' \n{"a": null, "b": {"text": "t"}, "c": [1, {"x": 2}], "d": {"text": "u", "entities": {}} , "e": 5}\n ')
    found = {}
    for r in J.json_members(spark, str(tmp_path / "a.json")).collect():
        found |= json.loads(r["member"])
    assert {k: found.get(k) for k in "abd"} == {"a": None, "b": {"text": "t"}, "d": {"text": "u", "entities": {}}}
    reports = R.entity_graphs(spark, str(tmp_path / "a.json"), whole_file=True)[0]
    assert {r["report_key"] for r in reports.where("text is not null").collect()} == {"b", "d"}
