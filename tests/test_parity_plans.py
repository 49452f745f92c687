"""Comparing two runs reads their entities few times."""

from labelmill.operators import parity as P

SCHEMA = 'doc_id string, start bigint, "end" bigint, entity_sha256 string, semantic_tag string, assertion string, cui string, position int'.replace('"', "")


def sides(spark):
    row = lambda d, s, tag, at: (d, s, s + 5, "h", tag, "present", None, at)
    a = [row("same", 1, "A", 1), row("same", 1, "A", 2), row("moved", 1, "A", 1), row("moved", 9, "B", 2), row("less", 1, "A", 1), row("less", 1, "A", 2), row("gone", 1, "A", 1)]
    b = [row("same", 1, "A", 2), row("same", 1, "A", 1), row("moved", 1, "A", 2), row("moved", 9, "B", 1), row("less", 1, "A", 1), row("new", 1, "A", 1)]
    return spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def test_numbered_entities_are_kept(spark):
    for side in P.differing(*sides(spark)):
        assert side.storageLevel.useDisk
        assert {r["doc_id"] for r in side.select("doc_id").collect()} <= {"moved", "less", "gone", "new"}


def test_both_sides_are_summed_in_one_exchange(spark):
    both = P.compared(*sides(spark))
    assert both._jdf.queryExecution().sparkPlan().toString().count("HashAggregate") == 2  # partial and final
    got = {r["doc_id"]: (r["same_entities"], r["same_rows"]) for r in both.collect()}
    assert got == {"same": (True, True), "moved": (True, False), "less": (False, False), "gone": (False, False), "new": (False, False)}
