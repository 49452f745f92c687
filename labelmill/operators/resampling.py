"""Bootstrap intervals by exact resampling: of n units n are drawn with replacement, alike in every draw.

How often each unit is drawn follows a multinomial law. It is drawn in a tree: the draws of a node are split between
its two halves by a binomial law of their sizes, down to leaves of at most about ``leaf`` units, which deal them out
evenly. Each split has a random stream of its own, named by seed and node, so that any task can follow the way down to
its leaf and knows how many draws went to the leaves before it, without seeing other units. What leaves a task is a
matrix of sums for each replicate, however often its units were drawn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .metrics import beside_group

#: Units of a leaf; replicates worked on at once.
LEAF, ROWS = 8192, 64


def stream(*words: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([w % (1 << 63) for w in words])))


def dealt(total: int, n_boot: int, way: list[tuple[int, int, bool]], *words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of total draws those that a leaf gets in each replicate, and those that go to leaves before it.

    way: from the root down the size of the left half, of both, and whether the leaf is in the right half.
    """
    n, before, node = np.full(n_boot, total, np.int64), np.zeros(n_boot, np.int64), 1
    for left, size, right in way:
        x = stream(*words, node).binomial(n, left / size)
        before, n = (before + x, n - x) if right else (before, x)
        node = 2 * node + right
    return n, before


def leaf_draws(n: np.ndarray, units: int, *words: int) -> Iterator[tuple[int, np.ndarray]]:
    """First replicate and numbers of draws (replicates by units) for ROWS replicates after another."""
    rng = stream(*words)
    for r in range(0, len(n), ROWS):
        some = n[r : r + ROWS]
        at = rng.integers(0, max(units, 1), int(some.sum())) + np.repeat(np.arange(len(some)), some) * units
        yield r, np.bincount(at, minlength=len(some) * units).reshape(len(some), units)


def way_to(index: int, starts: np.ndarray) -> list[tuple[int, int, bool]]:
    """The way to a leaf of a row of leaves, of which starts has the units before each, and all at the end."""
    lo, hi, way = 0, len(starts) - 1, []
    while hi - lo > 1:
        middle = (lo + hi) // 2
        way.append((int(starts[middle] - starts[lo]), int(starts[hi] - starts[lo]), index >= middle))
        lo, hi = (middle, hi) if index >= middle else (lo, middle)
    return way


def group_word(values: list) -> int:
    return int.from_bytes(hashlib.blake2b(repr(values).encode(), digest_size=7).digest(), "little")


def replicates(df: DataFrame, by: list[str], sums: dict[str, Column], n_boot: int = 2000, seed: int = 7, cluster: str = "case_id", leaf: int = LEAF) -> DataFrame:
    """For each group, leaf and replicate the sums over drawn clusters, each as often as it was drawn.

    sums: additive aggregates, taken once for each cluster; rows without a cluster are left out. A group's clusters are
    leaves by hash, twice as many as long as they hold more than leaf clusters on average.
    """
    per = df.where(F.col(cluster).isNotNull()).groupBy(*by, F.col(cluster).cast("string").alias("_unit")).agg(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in sums.items()))
    depth = F.greatest(F.ceil(F.log2(F.count("*") / leaf)), F.lit(0)).cast("int").alias("_depth")
    rows = beside_group(per, per.groupBy(*by).agg(depth), by).withColumn("_leaf", F.pmod(F.xxhash64("_unit"), F.expr("shiftleft(1L, _depth)")))
    leaves = rows.groupBy(*by, "_depth", "_leaf").agg(F.count("*").alias("_n"))
    up = leaves.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_depth")))).withColumn("_node", F.expr("shiftright(_leaf, _depth - _level)"))
    nodes = up.groupBy(*by, "_level", "_node").agg(F.sum("_n").alias("_size"))
    step = F.struct("_level", "_node", "_size")
    ways = beside_group(up.select(*by, "_leaf", "_level", "_node"), nodes, [*by, "_level", "_node"]).groupBy(*by, "_leaf").agg(F.sort_array(F.collect_list(step)).alias("_way"))  # a step for each doubling of the leaves
    kinds = [*(per.schema[c] for c in by), T.StructField("replicate", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in sums)]

    names = list(sums)

    def draw(key, units, way):
        *group, at = (k.as_py() for k in key)
        steps = way.column("_way")[0].as_py()
        words = (seed, group_word(group))
        down = []
        for a, b in zip(steps, steps[1:], strict=False):
            right = bool(b["_node"] & 1)
            down.append((a["_size"] - b["_size"] if right else b["_size"], a["_size"], right))
        n, _ = dealt(steps[0]["_size"], n_boot, down, *words)
        units = units.sort_by("_unit")
        values = np.stack([units.column(k).to_numpy() for k in names], 1)
        out = np.concatenate([c @ values for _, c in leaf_draws(n, units.num_rows, *words, 0, at)])
        return pa.table([*(pa.array([g] * n_boot, to_arrow_type(kinds[i].dataType)) for i, g in enumerate(group)), pa.array(range(1, n_boot + 1), pa.int32()), *map(pa.array, out.T)], [k.name for k in kinds])

    keys = [*by, "_leaf"]
    ways = ways.select(*(F.col(c).alias(f"_way_{c}") for c in keys), "_way")
    return rows.groupBy(*keys).cogroup(ways.groupBy(*(f"_way_{c}" for c in keys))).applyInArrow(draw, T.StructType(kinds))


def bootstrap_interval(df: DataFrame, by: list[str], sums: dict[str, Column], metric: Column, n_boot: int = 2000, seed: int = 7, cluster: str = "case_id", leaf: int = LEAF) -> DataFrame:
    """A metric of each group, and its percentile interval over replicates in which whole clusters are drawn.

    metric: an aggregate over the sums. Returns estimate, n_clusters, n_valid (replicates in which the metric is
    defined), mean, low and high.
    """
    known = df.where(F.col(cluster).isNotNull())
    per = known.groupBy(*by, cluster).agg(*(c.alias(k) for k, c in sums.items()))
    point = per.groupBy(*by).agg(metric.alias("estimate"), F.count("*").alias("n_clusters"))
    drawn = replicates(df, by, sums, n_boot, seed, cluster, leaf).groupBy(*by, "replicate").agg(metric.alias("value")).where("value is not null and not isnan(value)")
    spread = drawn.groupBy(*by).agg(F.count("*").alias("n_valid"), F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    if not by:
        return point.join(F.broadcast(spread))  # one row each
    own = {k: f"_of_{k}" for k in by}
    same = [F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()]
    return point.join(spread.withColumnsRenamed(own), same, "left").drop(*own.values()).fillna(0, ["n_valid"])


#: Units of a leaf of values in order; cuts between them at most.
VALUES, CUTS = 1024, 1 << 16


def cuts_of(rows: DataFrame, columns: list[str], n: int, leaf: int) -> dict[str, list[float]]:
    """Values that cut each column into ranges of about leaf rows: at most CUTS numbers a column."""
    ranges = min(CUTS, -(-n // leaf))
    if ranges < 2:
        return {c: [] for c in columns}
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = rows.agg(*(F.percentile_approx(c, shares, F.lit(20 * ranges)).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c])) for c in columns}


def place(value: str, cuts: list[float]) -> Column:
    """The range of a value: 2 i between the cuts, 2 i + 1 for the i-th cut itself, so that a value of very many rows
    that is a cut has a range of its own."""
    if not cuts:
        return F.lit(0)
    edges = F.lit(cuts)
    below = F.size(F.filter(edges, lambda c: c < F.col(value)))
    return 2 * below + F.array_contains(edges, F.col(value)).cast("int")


def leaves_of(rows: DataFrame, value: str, cuts: list[float], leaf: int) -> tuple[DataFrame, list[tuple[int, int]], np.ndarray]:
    """rows with their range and part; the leaves (range, part) in order, and the rows before each.

    A range that is one value is cut into parts by hash, as its rows have one rank. At the driver: a number for each
    leaf.
    """
    rows = rows.withColumn("_place", place(value, cuts))
    sizes = {r[0]: r[1] for r in rows.groupBy("_place").count().collect()}
    parts = {p: -(-n // leaf) for p, n in sizes.items() if p % 2 and n > leaf}
    part = F.lit(0)
    if parts:
        of = F.create_map(*(F.lit(x) for item in parts.items() for x in item))
        part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), of[F.col("_place")]), F.lit(0)).cast("int")
    rows = rows.withColumn("_part", part)
    if parts:
        count = {(r[0], r[1]): r[2] for r in rows.where(F.col("_place").isin(list(parts))).groupBy("_place", "_part").count().collect()}
    else:
        count = {}
    count |= {(p, 0): n for p, n in sizes.items() if p not in parts}
    order = sorted(count)
    return rows, order, np.r_[0, np.cumsum([count[k] for k in order])].astype(np.int64)


OWN = ("n", "d", "abs_d", "dd", "a", "b", "aa", "bb", "ab", "ra", "rara")
RANKED = "place int, replicate int, w double, p double, pl double, wl double, wll double"


def alignment_draws(paired: DataFrame, n_boot: int = 2000, seed: int = 7, leaf: int = VALUES) -> DataFrame:
    """Of each replicate the metrics of paired values (case_id, a, b), cases drawn with replacement and ranked anew.

    Cases are leaves in order of a. The draws before a leaf and the running draws inside it give the ranks of a; for
    each value of b a leaf sends how often it was drawn and the sum of its ranks of a, in one vector each over all
    replicates, to its range of b, where ranks of b are given alike. A range's ranks lack the draws of ranges before it,
    which are added at the end, from sums of ranges.
    """
    rows = paired.where("a is not null and b is not null").select(F.col("case_id").cast("string").alias("case_id"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    total = rows.count()
    cuts = cuts_of(rows, ["a", "b"], total, leaf)
    rows, order, starts = leaves_of(rows, "a", cuts["a"], leaf)
    rows = rows.withColumn("_of_b", place("b", cuts["b"]))
    index = {k: i for i, k in enumerate(order)}
    first_of = {p: min(i for k, i in index.items() if k[0] == p) for p, _ in order}
    last_of = {p: max(i for k, i in index.items() if k[0] == p) + 1 for p, _ in order}
    shared = rows.sparkSession.sparkContext.broadcast((index, first_of, last_of, starts))  # a number for each leaf

    def before(i: int) -> np.ndarray:
        starts = shared.value[3]
        return np.full(n_boot, total, np.int64) if i >= len(starts) - 1 else dealt(total, n_boot, way_to(i, starts), seed)[1]

    def draw(key, units):
        index, first_of, last_of, starts = shared.value
        at, part = (k.as_py() for k in key)
        own = index[at, part]
        n, ahead = dealt(total, n_boot, way_to(own, starts), seed)
        units = units.sort_by([("a", "ascending"), ("b", "ascending"), ("case_id", "ascending")])
        a, b, of_b = (units.column(c).to_numpy() for c in ("a", "b", "_of_b"))
        d = b - a
        values = np.stack([np.ones(len(a)), d, np.abs(d), d * d, a, b, a * a, b * b, a * b], 1)
        tie = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        of_tie = np.repeat(np.arange(len(tie)), np.diff(np.r_[tie, len(a)]))
        split = last_of[at] - first_of[at] > 1
        if split:  # one value in several leaves
            ahead, whole = before(first_of[at]), before(last_of[at]) - before(first_of[at])
        by_b = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.r_[True, b[by_b][1:] != b[by_b][:-1]])
        sums, w_b, p_b = [], [], []
        for r, c in leaf_draws(n, len(a), seed, 0, own):
            some = slice(r, r + len(c))
            drawn = whole[some, None] if split else np.add.reduceat(c, tie, axis=1)
            rank = ahead[some, None] + np.cumsum(drawn, axis=1) - drawn + (drawn + 1) / 2
            weighed = c * rank[:, of_tie]
            sums.append(np.column_stack([c @ values, weighed.sum(1), (weighed * rank[:, of_tie]).sum(1)]))
            w_b.append(np.add.reduceat(c[:, by_b], cut, axis=1))
            p_b.append(np.add.reduceat(weighed[:, by_b], cut, axis=1))
        w_b, p_b = np.concatenate(w_b).T, np.concatenate(p_b).T
        m = len(cut)
        return pa.table({
            "place": pa.array([-1, *of_b[by_b][cut].tolist()], pa.int32()), "value": pa.array([None, *b[by_b][cut].tolist()], pa.float64()),
            "w": pa.array([None, *(w_b[i].astype(np.float64).tobytes() for i in range(m))], pa.binary()), "p": pa.array([None, *(p_b[i].tobytes() for i in range(m))], pa.binary()),
            "own": pa.array([np.concatenate(sums).tobytes(), *[None] * m], pa.binary()),
        })

    found = rows.groupBy("_place", "_part").applyInArrow(draw, "place int, value double, w binary, p binary, own binary")

    def listed(batches):
        for batch in batches:
            for raw in batch.column("own").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(range(1, n_boot + 1), pa.int32()), *map(pa.array, np.frombuffer(raw).reshape(n_boot, -1).T)], ["replicate", *OWN])

    def rank(key, held):
        held = held.sort_by("value")
        value, running = held.column("value").to_numpy(), np.zeros(n_boot)
        w_of, p_of = held.column("w"), held.column("p")
        out = np.zeros((5, n_boot))
        edge = np.flatnonzero(np.r_[True, value[1:] != value[:-1], True]).tolist()
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            w, p = (sum(np.frombuffer(x[k].as_py()) for k in range(i, j)) for x in (w_of, p_of))
            local = running + (w + 1) / 2
            out += [w, p, p * local, w * local, w * local * local]
            running = running + w
        return pa.table([pa.array([key[0].as_py()] * n_boot, pa.int32()), pa.array(range(1, n_boot + 1), pa.int32()), *map(pa.array, out)], [c.split()[0] for c in RANKED.split(", ")])

    own = found.where("place < 0").select("own").mapInArrow(listed, "replicate int, " + ", ".join(f"{k} double" for k in OWN)).groupBy("replicate").agg(*(F.sum(k).alias(k) for k in OWN))
    by_range = found.where("place >= 0").select("place", "value", "w", "p").groupBy("place").applyInArrow(rank, RANKED)
    ahead = F.coalesce(F.sum("w").over(Window.partitionBy("replicate").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each range
    of_b = by_range.withColumn("o", ahead).groupBy("replicate").agg(F.sum(F.col("wl") + F.col("o") * F.col("w")).alias("rb"), F.sum(F.col("wll") + 2 * F.col("o") * F.col("wl") + F.col("o") * F.col("o") * F.col("w")).alias("rbrb"), F.sum(F.col("pl") + F.col("o") * F.col("p")).alias("rarb"))
    x = {k: F.col(k) / F.col("n") for k in (*OWN[1:], "rb", "rbrb", "rarb")}

    def corr(p: str, q: str, pq: str) -> Column:
        vp, vq = x[p + p] - x[p] * x[p], x[q + q] - x[q] * x[q]
        return F.when((vp > 1e-9) & (vq > 1e-9), (x[pq] - x[p] * x[q]) / F.sqrt(vp * vq))

    return own.join(of_b, "replicate").select("replicate", "n", x["d"].alias("mean_difference"), x["abs_d"].alias("mae"), F.sqrt(x["dd"]).alias("rmse"), corr("a", "b", "ab").alias("pearson"), corr("ra", "rb", "rarb").alias("spearman"))


def alignment_intervals(paired: DataFrame, n_boot: int = 2000, seed: int = 7, leaf: int = VALUES) -> DataFrame:
    """Percentile intervals of the metrics of alignment_draws: metric, n_valid, low, high. A replicate in which a metric
    is undefined is left out of it."""
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("mean_difference", "mae", "rmse", "pearson", "spearman")))
    per = alignment_draws(paired, n_boot, seed, leaf).select(F.inline(each)).where("value is not null and not isnan(value)")
    return per.groupBy("metric").agg(F.count("*").alias("n_valid"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
