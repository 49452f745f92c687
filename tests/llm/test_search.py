"""Ranked search against a plain loop over all documents and terms, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import DOCS, low

from labelmill.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def plain(docs, items, k):
    held = [(i, Counter(TERM.findall(low(t)))) for i, t in docs]
    n_all, long = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(low(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_all) // max(long, 1)
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def made(seed, n):
    rnd = random.Random(seed)
    common, rare = ["the", "Of", "and", "x1", "été"], [f"w{k}" for k in range(300)]
    text = lambda size: " ".join(rnd.choice(common) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(size))
    docs = [(k, text(rnd.choice([0, 1, 3, 10, 40, 200]))) for k in range(n)]
    docs += [(docs[k][0] + 5000, docs[k][1]) for k in range(0, n, 7)] + [(None, "the w1 w2"), (None, None), (9999, None), (3, "w1 w1 w1"), (3, "w1 w1 w1"), (9998, "the-" * 20000)]
    items = [(k, text(rnd.randrange(1, 30))) for k in range(40)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w1 w2"), (53, "w1"), (53, "w5 w1 the"), (54, "THE the")]
    return docs, items


@pytest.mark.parametrize(("n", "chunk", "k", "at_once"), [(900, 8 << 20, 10, 1 << 20), (400, 2000, 3, 100), (30, 8 << 20, 10, 1 << 20)])
def test_search_by_brute_force(spark, n, chunk, k, at_once):
    docs, items = made(n, n)
    frame = spark.createDataFrame(docs, DOCS).withColumns({"Chunk": F.lit("x"), "terms": F.lit(1)}).repartition(3)
    index = search.build(frame, chunk)
    got = [tuple(r) for r in search.search(index, spark.createDataFrame(items, ITEMS).withColumn("term", F.lit(1)), k, at_once).collect()]
    assert sorted(got, key=repr) == plain(docs, items, k)


def test_common_terms_in_many_documents(spark):
    # Two thirds of all documents are copies that hold the same two terms: ties go to the smallest ids.
    docs = [(k, "alpha beta") for k in range(4000)] + [(4000 + k, f"alpha {'gamma ' * (k % 5)}d{k}") for k in range(2000)]
    items = [(1, "alpha beta"), (2, "gamma alpha"), (3, "alpha"), (4, "d5 beta")]
    got = search.search(search.build(spark.createDataFrame(docs, DOCS).repartition(5)), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, items, 10)


def test_empty_sides(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    items = spark.createDataFrame([(1, "a"), (2, None)], ITEMS)
    for docs, asked in ((none, items), (some, items.limit(0)), (some.where("doc_id = 2"), items)):
        out = search.search(search.build(docs), asked)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    assert search.search(search.build(some), items).count() == 1


def test_same_rows_as_sql(spark, sf_dir):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.queries()["op12_search"](spark, sf_dir)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["rank"].dataType.simpleString() == "int"
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.execute(search.SQL).fetchall())
