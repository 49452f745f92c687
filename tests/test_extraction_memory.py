"""What a worker of the extraction holds is bounded by bytes and matches, not by tokens and rows."""

import pyarrow as pa

from labelmill.operators import extraction as X


def test_long_tokens_are_found_but_not_remembered():
    long = "x" * 10_000
    words = X.Words({"the": 1, long: 2}, {"to": 3}, None)
    assert [words[w] for w in ("The", long, long.upper(), "TO", "none")] == [1 << 20, 2 << 20, 2 << 20, 3, 0]
    assert not any(words[f"{long}{k}"] for k in range(100))
    assert set(words) == {"The", "TO", "none"}


def test_matches_of_long_texts_leave_in_pieces(spark, monkeypatch):
    """300 texts of 2000 matches, with texts that have none between: each match leaves once, in order."""
    docs, ran = spark.createDataFrame([(1, "")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: ran.append(run))
    X.marks(docs, X.Spec(terms=(("the", "SIDE"),), cues=(("to", X.NEGATION),)))
    texts = ["\U0001f600 the to " + "the to " * 999, None, "none"] * 300
    out = list(ran[0](iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(900), pa.int64()), "text": pa.array(texts, pa.string())})])))
    assert max(b.num_rows for b in out) <= 10_000
    rows = [(r["doc_id"], r["first"], r["kind"]) for b in out for r in b.select(["doc_id", "first", "kind"]).to_pylist()]
    assert rows == [(3 * k, 1 + i, "tc"[i % 2]) for k in range(300) for i in range(2000)]
    assert {r["begin16"] - r["begin"] for r in out[0].to_pylist()} == {1}
