"""Bootstraps against plain loops over the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.operators import resampling as R


def test_draws_add_up_and_follow_the_multinomial_law():
    starts = np.r_[0, np.cumsum([3, 0, 10, 1, 6])]
    parts = [R.dealt(20, 4000, R.way_to(i, starts), 5) for i in range(5)]
    n = np.stack([p[0] for p in parts])
    assert (n.sum(0) == 20).all() and (n[1] == 0).all()
    assert all((parts[i][1] == n[:i].sum(0)).all() for i in range(5))
    assert n.mean(1) == pytest.approx([3, 0, 10, 1, 6], abs=0.15) and n.var(1) == pytest.approx([k * (1 - k / 20) for k in (3, 0, 10, 1, 6)], abs=0.35)
    counts = np.concatenate([c for _, c in R.leaf_draws(n[2], 10, 5, 0, 2)])
    assert (counts.sum(1) == n[2]).all() and counts.mean(0) == pytest.approx([1] * 10, abs=0.1)


@pytest.mark.parametrize("leaf", [8192, 4])
def test_cluster_bootstrap_by_a_plain_loop(spark, leaf):
    rng = np.random.default_rng(3)
    rows = [(g, f"c{k}", float(v), float(t)) for g in ("x", None) for k in range(37) for v, t in rng.random((1 + k % 3, 2))] + [("x", None, 5.0, 5.0), ("y", "only", 0.5, 0.25)]
    d = spark.createDataFrame(rows, "g string, case_id string, v double, t double").withColumn("e", F.col("v") - F.col("t"))
    sums, metric, n_boot = {"s": F.sum("e"), "n": F.count("*"), "k": F.lit(1.0)}, F.sum("s") / F.sum("n"), 150
    drawn = R.replicates(d, ["g"], {"s": F.sum("e"), "n": F.count("*"), "k": F.max(F.lit(1.0))}, n_boot, 11, leaf=leaf)
    per = {(r["g"], r["replicate"]): r for r in drawn.groupBy("g", "replicate").agg(*(F.sum(k).alias(k) for k in ("s", "n", "k"))).collect()}
    assert len(per) == 3 * n_boot and all(r["k"] == (1 if r["g"] == "y" else 37) for r in per.values())  # as many clusters in every draw
    if leaf == 4:
        assert drawn.count() > 3 * n_boot  # several leaves
    else:
        units = sorted({r[1] for r in rows if r[0] == "x" and r[1]})
        e = np.array([[sum(v - t for g, c, v, t in rows if g == "x" and c == u), sum(1 for g, c, *_ in rows if g == "x" and c == u)] for u in units])
        counts = np.concatenate([c for _, c in R.leaf_draws(np.full(n_boot, 37), 37, 11, R.group_word(["x"]), 0, 0)])
        for r in range(n_boot):
            plain = sum(np.repeat(e, counts[r], axis=0))
            assert (per["x", r + 1]["s"], per["x", r + 1]["n"]) == (pytest.approx(plain[0]), plain[1])
    out = {r["g"]: r for r in R.bootstrap_interval(d, ["g"], sums | {"k": F.max(F.lit(1.0))}, metric, n_boot, 11, leaf=leaf).collect()}
    assert out["x"]["estimate"] == pytest.approx(np.mean([v - t for g, c, v, t in rows if g == "x" and c])) and out["x"]["n_clusters"] == 37
    values = [r["s"] / r["n"] for (g, _), r in per.items() if g == "x"]
    assert (out["x"]["low"], out["x"]["high"]) == (pytest.approx(np.percentile(values, 2.5)), pytest.approx(np.percentile(values, 97.5)))
    assert out["y"]["low"] == out["y"]["high"] == pytest.approx(0.25) and out[None]["n_valid"] == n_boot
    whole = R.bootstrap_interval(d, [], {"s": F.sum("e"), "n": F.count("*")}, metric, 20, leaf=leaf).collect()
    assert len(whole) == 1 and whole[0]["low"] <= whole[0]["mean"] <= whole[0]["high"]
    assert R.bootstrap_interval(d.limit(0), ["g"], {"s": F.sum("e"), "n": F.count("*")}, metric, 20).count() == 0


def average_ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def plain_metrics(a, b):
    d = b - a
    corr = lambda x, y: np.corrcoef(x, y)[0, 1] if np.ptp(x) and np.ptp(y) else None
    return d.mean(), np.abs(d).mean(), np.sqrt((d * d).mean()), corr(a, b), corr(average_ranks(a), average_ranks(b))


@pytest.mark.parametrize("leaf", [1024, 7])
def test_alignment_draws_rank_each_draw_anew(spark, leaf):
    rng = np.random.default_rng(8)
    a = np.r_[rng.integers(0, 8, 40) * 10.0, [20.0] * 30]  # ties, and one value of very many cases
    b = np.round(a + rng.normal(0, 15, 70), 1)
    b[:9] = b[9]
    rows = [(f"c{i:03}", float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    d = spark.createDataFrame([*rows, ("none", None, 1.0)], "case_id string, a double, b double")
    n_boot, seed = 40, 3
    got = {r["replicate"]: r for r in R.alignment_draws(d, n_boot, seed, leaf).collect()}
    base = spark.createDataFrame(rows, "case_id string, a double, b double")
    placed, order, starts = R.leaves_of(base, "a", R.cuts_of(base, ["a", "b"], 70, leaf)["a"], leaf)
    held: dict = {}
    for r in placed.collect():
        held.setdefault((r["_place"], r["_part"]), []).append((r["a"], r["b"], r["case_id"]))
    assert (len(order) > 8 and any(p for _, p in order)) if leaf == 7 else len(order) == 1
    times = {}
    for i, k in enumerate(order):
        n, _ = R.dealt(70, n_boot, R.way_to(i, starts), seed)
        counts = np.concatenate([c for _, c in R.leaf_draws(n, len(held[k]), seed, 0, i)])
        for j, (_, _, case) in enumerate(sorted(held[k])):
            times[case] = counts[:, j]
    for r in range(n_boot):
        w = np.array([times[c][r] for c, _, _ in rows])
        assert w.sum() == 70 == got[r + 1]["n"]
        want = plain_metrics(np.repeat(a, w), np.repeat(b, w))
        for name, x in zip(("mean_difference", "mae", "rmse", "pearson", "spearman"), want, strict=True):
            assert got[r + 1][name] == (None if x is None else pytest.approx(x, abs=1e-9)), (r, name)
    out = {r["metric"]: r for r in R.alignment_intervals(d, n_boot, seed, leaf).collect()}
    values = [got[r + 1]["spearman"] for r in range(n_boot)]
    assert out["spearman"]["low"] == pytest.approx(np.percentile(values, 2.5)) and out["spearman"]["n_valid"] == n_boot


def test_undefined_and_empty_alignments(spark):
    flat = spark.createDataFrame([(f"c{i}", 5.0, float(i)) for i in range(6)], "case_id string, a double, b double")
    out = {r["metric"]: r["n_valid"] for r in R.alignment_intervals(flat, 30).collect()}
    assert out == {"mean_difference": 30, "mae": 30, "rmse": 30}
    assert R.alignment_intervals(flat.limit(0), 30).count() == 0
