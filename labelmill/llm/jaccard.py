"""N-gram Jaccard join: documents whose shingle sets have a similarity of 0.8 or more.

A document's set holds the hashes of its distinct ``SHINGLE``-word shingles (of the whole sequence, if it
has fewer words). Documents of equal sets are one class, of which one row stands for all.

* Prefix filter. Under any global order two linked sets share one of their first
  ``n - ceil(0.8 n) + 1`` elements. First, batches exchange the elements of low hash; a set with enough
  of these that no other has is linked with nothing and is done with. Among the rest, exact document
  frequencies give the order: rare elements first.
* Index-level skipping. Lists of the sets that have an element in their prefix are ordered by size;
  for each set the block of lists that sizes allow is found by position, and the places of the element
  in both sets bound the overlap that is left.
* Answer-level skipping. Each set is first compared with one set that it shares most lists with, its
  leader: each list proposes the set whose elements are most frequent, the likely source of near copies. Sets linked to the same leader are connected and need no comparison. For other pairs x, y under
  a leader l the answer follows from the differences: |x & y| = |l| - |l - x| - |l - y| + c, where c counts
  the elements in which both differ from l in the same way. If c = 0 is enough, both are linked to the set
  that differs least; else a join over the few differences, with its own prefix filter, finds them.
  Pairs under different leaders come from the lists. What is left is compared exactly on whole sets.
* Components are found by joins over links, label by label.

Null text, and text without words, have the empty set and are linked with nothing. A null id has a null component
and is linked with nothing. Rows of one id are one document: they share a component, whatever their texts.
Links are 100 * intersection >= 80 * union in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import PER_PARTITION, bucketed, in_batches, in_order, joined, key_ranges, member, packed, unpacked
from .storage import materialise, parallelism
from .textbuf import LOWER, NOT_BLANK, gram_hashes, mix, pieces, span_hashes, starts_of, utf8, word_bounds

SHINGLE, PERCENT = 5, 80
#: Share of the hash range whose elements are exchanged first.
LOW = 0.3
#: Pairs that one copy of a set serves.
SHARE = 128
#: Members of a list that a tile compares with as many.
TILE = 2048
_OTHER = np.uint64(0x8BB84B93962EACC9)


def shingle_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All sets of a batch end to end, each sorted, and where each starts."""
    data, offsets = utf8(table.column("text"))
    values, sizes = [], []
    for i, j, d, o in pieces(data, offsets):
        low = LOWER[d]
        s, e, row = word_bounds(low, o, NOT_BLANK)
        words = span_hashes(low, s, e)
        n = np.bincount(row, minlength=j - i)
        grams = gram_hashes(words, SHINGLE)
        of = row[: len(grams)]
        inside = of == row[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
        hashes, rows = [grams[inside]], [of[inside]]
        first = np.cumsum(n) - n
        for k in range(1, SHINGLE):
            short = np.flatnonzero(n == k)
            if len(short):
                hashes.append(gram_hashes(words[(first[short][:, None] + np.arange(k)).ravel()], k)[::k] ^ np.uint64(k))
                rows.append(short)
        h, r = joined(hashes), joined(rows, np.int64)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        if len(h):
            keep = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])]
            h, r = h[keep], r[keep]
        values.append(h)
        sizes.append(np.bincount(r, minlength=j - i))
    return joined(values), np.r_[0, np.cumsum(joined(sizes, np.int64))].astype(np.int64)


def set_digests(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set that do not depend on order; zeros for an empty set."""
    out = np.zeros((len(start) - 1, 2), np.uint64)
    for k, salt in enumerate((np.uint64(0), _OTHER)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ salt), out=sums[1:])
        n = start[1:] - start[:-1]
        out[:, k] = np.where(n > 0, mix(sums[start[1:]] - sums[start[:-1]] + n.astype(np.uint64)), 0)
    return out


def prefix_size(n):
    """How many elements of a set of n must hold one shared with any linked set."""
    return n - -(-n * PERCENT // 100) + 1


def _low(values: np.ndarray) -> np.ndarray:
    return values < np.uint64(int(LOW * 2**64))


def exchanged(docs: DataFrame, parts: int) -> DataFrame:
    """To each batch: low elements (scrambled) that other batches have too; and for the classes of equal sets in it
    the least row number and the smallest id anywhere."""

    def ask(table: pa.Table) -> pa.Table:
        t = in_order(table)
        values, start = shingle_sets(t)
        keys = np.unique(mix(values[_low(values)]))
        ok = ~np.asarray(t.column("doc_id").is_null())
        d = set_digests(values, start)
        ok &= d.any(1)
        d, ids, own = d[ok], np.asarray(t.column("doc_id").filter(pa.array(ok))).astype(np.int64), t.column("row_no").to_numpy()[ok]
        order = np.lexsort((ids, d[:, 1], d[:, 0]))
        d, ids, own = d[order], ids[order], own[order]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]).any(1)]) if len(d) else np.zeros(0, np.int64)
        d, ids = d[at], np.stack([np.minimum.reduceat(own, at), ids[at]], 1) if len(at) else np.zeros((0, 2), np.int64)
        a, b = key_ranges(keys, parts), key_ranges(d[:, 0], parts)
        some = [k for k in range(parts) if a[k] < a[k + 1] or b[k] < b[k + 1]]
        cut = lambda x, at: pa.array([packed(x[at[k] : at[k + 1]]) for k in some], pa.binary())
        return pa.table({"batch": pa.array([t.column("batch")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some, pa.int32()), "keys": cut(keys, a), "sets": cut(d, b), "ids": cut(ids, b)})

    def answer(table: pa.Table) -> pa.Table:
        keys = unpacked(table.column("keys"))
        u, n = np.unique(joined(keys), return_counts=True)
        twice = u[n > 1]
        sets = np.concatenate([np.zeros((0, 2), np.uint64), *(x.reshape(-1, 2) for x in unpacked(table.column("sets")))])
        ids = joined(unpacked(table.column("ids"), np.int64), np.int64).reshape(-1, 2)
        _, inverse = np.unique(sets, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        least = np.full((inverse.max(initial=-1) + 1, 2), np.iinfo(np.int64).max)
        np.minimum.at(least, inverse, ids)
        ends = np.cumsum([len(x) // 16 for x in table.column("ids").to_pylist()])
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "keys": pa.array([packed(k[member(twice, k)]) for k in keys], pa.binary()), "sets": table.column("sets"), "ids": pa.array([packed(x) for x in np.split(least[inverse], ends[:-1])], pa.binary())})

    asked = docs.groupBy("batch").applyInArrow(ask, "batch bigint, part int, keys binary, sets binary, ids binary")
    return asked.groupBy("part").applyInArrow(answer, "batch bigint, part int, keys binary, sets binary, ids binary")


def classes(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Per row: doc_id, rep (the least row number with the same set), rep_id (the smallest id with it), n_shingles;
    and the set (binary, sorted hashes) of each class that may have links, at the row that stands for it."""

    def work(_, table: pa.Table, found: pa.Table) -> pa.Table:
        t = in_order(table)
        values, start = shingle_sets(t)
        n = np.diff(start)
        null = np.asarray(t.column("doc_id").is_null())
        own_no = t.column("row_no").to_numpy()
        d = set_digests(values, start)
        known = {}
        for s, i in zip(unpacked(found.column("sets")), unpacked(found.column("ids"), np.int64), strict=True):
            known |= dict(zip(map(tuple, s.reshape(-1, 2).tolist()), map(tuple, i.reshape(-1, 2).tolist()), strict=True))
        best = np.array([known.get(tuple(x), (-1, -1)) for x in d.tolist()], np.int64).reshape(-1, 2)
        scrambled = mix(values[_low(values)])
        elsewhere = np.unique(joined(unpacked(found.column("keys"))))
        row = np.repeat(np.arange(len(n)), n)
        low_row = row[_low(values)]
        own = (best[:, 0] == own_no) & ~null & (n > 0)
        # Of equal sets in the batch only the one that stands for them counts.
        first_of: dict = {}
        counts = np.array([first_of.setdefault(tuple(x), k) == k for k, x in enumerate(d.tolist())], bool)
        u, m = np.unique(scrambled[counts[low_row]], return_counts=True)
        alone = ~member(elsewhere, scrambled) & ~member(u[m > 1], scrambled)
        lonely = np.bincount(low_row, alone, len(n))
        live = own & (lonely < prefix_size(n))
        none = null | (n == 0)
        return pa.table({
            "doc_id": t.column("doc_id"), "rep": pa.array(best[:, 0], pa.int64(), mask=none), "rep_id": pa.array(best[:, 1], pa.int64(), mask=none), "n_shingles": pa.array(n, pa.int64()),
            "elements": pa.array([packed(values[start[k] : start[k + 1]]) if live[k] else None for k in range(len(n))], pa.binary()),
        })

    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(work, "doc_id bigint, rep bigint, rep_id bigint, n_shingles bigint, elements binary")


def _split(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, elements end to end and where each set starts, in order of id."""
    t = table.sort_by("doc").combine_chunks()
    sets = unpacked(t.column("elements"))
    return t.column("doc").to_numpy(), joined(sets), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def frequencies(sets: DataFrame, parts: int) -> DataFrame:
    """To each batch of sets: its elements that another set has too, and in how many sets each is."""

    def ask(table: pa.Table) -> pa.Table:
        _, values, _ = _split(table)
        keys, n = np.unique(values, return_counts=True)
        cut = key_ranges(keys, parts)
        some = [k for k in range(parts) if cut[k] < cut[k + 1]]
        return pa.table({"batch": pa.array([table.column("batch")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some, pa.int32()), "keys": pa.array([packed(keys[cut[k] : cut[k + 1]]) for k in some], pa.binary()), "counts": pa.array([packed(n[cut[k] : cut[k + 1]].astype(np.uint32)) for k in some], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = unpacked(table.column("keys"))
        u, inverse = np.unique(joined(keys), return_inverse=True)
        total = np.bincount(inverse, joined(unpacked(table.column("counts"), np.uint32), np.uint32), len(u)).astype(np.uint32)[inverse]
        at = np.r_[0, np.cumsum([len(k) for k in keys])]
        back = [(k[m > 1], m[m > 1]) for k, m in ((k, total[a:b]) for k, a, b in zip(keys, at[:-1], at[1:], strict=True))]
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "keys": pa.array([packed(b[0]) for b in back], pa.binary()), "counts": pa.array([packed(b[1]) for b in back], pa.binary())})

    asked = sets.groupBy("batch").applyInArrow(ask, "batch bigint, part int, keys binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "batch bigint, part int, keys binary, counts binary")


LIST = ("key", "doc", "n", "place", "group", "leader", "weight")
_KINDS = (np.uint64, *(np.int64,) * 6)
POSTINGS = "part int, " + ", ".join(f"`{x}` binary" for x in LIST)


def postings(sets: DataFrame, answers: DataFrame, parts: int, central: bool = False) -> DataFrame:
    """Entries of the lists, packed by range of elements: a set's place in the list of each element of its prefix
    that another set has. sets: doc, batch, elements, prefix (how many elements to list), and group, leader, weight
    as known so far. central: the weight is how often, on average, the set's elements occur (thousandths of a power
    of two): in a group of near copies it is greatest for what most of them come from."""

    def work(_, table: pa.Table, found: pa.Table) -> pa.Table:
        docs, values, start = _split(table)
        t = table.sort_by("doc")
        keys, counts = joined(unpacked(found.sort_by("part").column("keys"))), joined(unpacked(found.sort_by("part").column("counts"), np.uint32), np.uint32)
        n = np.diff(start)
        row = np.repeat(np.arange(len(n)), n)
        f = np.ones(len(values), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            f = np.where(keys[at] == values, counts[at], 1).astype(np.int64)
        order = np.lexsort((values, f, row))
        place = np.arange(len(values)) - start[row]
        keep = (place < t.column("prefix").to_numpy()[row]) & (f[order] > 1)
        k, r, p = values[order][keep], row[keep], place[keep]
        extra = [t.column(c).to_numpy() for c in ("group", "leader", "weight")]
        if central:
            extra[2] = (1000 * np.bincount(row, np.log2(f), len(n)) / np.maximum(n, 1)).astype(np.int64)
        columns = [k, docs[r], n[r], p, *(x[r] for x in extra)]
        by = np.argsort(k, kind="stable")
        columns = [np.asarray(c)[by].astype(kind) for c, kind in zip(columns, _KINDS, strict=True)]
        cut = key_ranges(columns[0], parts)
        some = [k for k in range(parts) if cut[k] < cut[k + 1]]
        return pa.table({"part": pa.array(some, pa.int32())} | {name: pa.array([packed(c[cut[k] : cut[k + 1]]) for k in some], pa.binary()) for name, c in zip(LIST, columns, strict=True)})

    return sets.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(work, POSTINGS)


def _lists(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The entries of a range in order of element, size and id, and where each list starts."""
    columns = [joined(unpacked(table.column(c), kind), kind) for c, kind in zip(LIST, _KINDS, strict=True)]
    order = np.lexsort((columns[1], columns[2], columns[0]))
    columns = [c[order] for c in columns]
    return columns, np.r_[starts_of(columns[0]), len(columns[0])]


def needed(x, y):
    """Least overlap of linked sets of sizes x and y."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def leaders(lists: DataFrame) -> DataFrame:
    """For each set, of the most central sets of its lists whose size allows a link, the one that shares most lists."""

    def work(table: pa.Table) -> pa.Table:
        (_, doc, n, _, _, _, weight), cut = _lists(table)
        a, b = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            # Sizes ascend; each block of sizes within the bound has one leader, the most central (of equals the first).
            while lo < hi:
                end = lo + int(np.searchsorted(n[lo:hi], n[lo] * 100 // PERCENT, "right"))
                w = weight[lo:end]
                head = doc[lo:end][w == w.max()].min()
                a.append(doc[lo:end])
                b.append(np.full(end - lo, head))
                lo = end
        x, y = joined(a, np.int64), joined(b, np.int64)
        ok = x != y
        pairs, count = np.unique(np.stack([x[ok], y[ok]], 1), axis=0, return_counts=True) if ok.any() else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "count": pa.array(count, pa.int64())})

    found = lists.groupBy("part").applyInArrow(work, "a bigint, b bigint, count bigint").groupBy("a", "b").agg(F.sum("count").alias("count"))
    return found.groupBy("a").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("b"))


def _pairs(own: list[np.ndarray], other: list[np.ndarray], most: int, differences: bool) -> np.ndarray:
    """Pairs of members of a list that no bound rules out. own and other: doc, n, place, group, leader, weight and number
    in the list, in order of size; groups other than most are worked through."""
    d1, m1, p1, g1, l1, w1, i1 = own
    d, m, p, g, le, w, number = other
    found = [np.zeros((0, 2), np.int64)]
    for i in np.flatnonzero(g1 != most).tolist():
        if differences:
            j = np.arange(len(d))
            least = np.maximum(-(-(w1[i] + w) // 18), 1)
        else:
            # The block of sizes that a link allows, by position.
            j = np.arange(np.searchsorted(m, -(-m1[i] * PERCENT // 100), "left"), np.searchsorted(m, m1[i] * 100 // PERCENT, "right"))
            j = j[((le[j] != l1[i]) | (l1[i] < 0)) & (le[j] != d1[i]) & (d[j] != l1[i])]
            least = needed(m1[i], m[j])
        # If this is the first element that both have, no more than what stands from here on is shared; a linked pair
        # passes at its first.
        bound = np.minimum(m1[i] - p1[i], m[j] - p[j])
        j = j[(bound >= least) & (g[j] != g1[i]) & ((g[j] == most) | (number[j] > i1[i]))]
        if len(j):
            found.append(np.stack([np.minimum(d1[i], d[j]), np.maximum(d1[i], d[j])], 1))
    return np.unique(np.concatenate(found), axis=0)


def candidates(lists: DataFrame, differences: bool = False, tile: int = TILE) -> DataFrame:
    """Pairs of different groups that share a list and that no bound rules out.

    Of whole sets: pairs under different leaders, neither the other's leader. Of differences: pairs (of one leader,
    as their elements say) that must share at least (weight + weight) / 18 of them. A list with more than tile x tile
    pairs to look at is cut into tiles, which are dealt over tasks; tiles whose sizes allow no link are left out.
    """
    schema = "a bigint, b bigint, most bigint, own binary, other binary"

    def table_of(pairs, tiles=()):
        n = len(pairs)
        column = lambda k, kind: pa.array([None] * n + [t[k] for t in tiles], kind)
        return pa.table({"a": pa.array([*pairs[:, 0].tolist(), *[None] * len(tiles)], pa.int64()), "b": pa.array([*pairs[:, 1].tolist(), *[None] * len(tiles)], pa.int64()), "most": column(0, pa.int64()), "own": column(1, pa.binary()), "other": column(2, pa.binary())})

    def work(table: pa.Table) -> pa.Table:
        columns, cut = _lists(table)
        group, leader = columns[4], columns[5]
        found, tiles, waiting = [np.zeros((0, 2), np.int64)], [], 0
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            g, le = group[lo:hi], leader[lo:hi]
            if hi - lo < 2 or (g == g[0]).all() or not differences and (le == le[0]).all() and le[0] >= 0:
                continue
            ids, size = np.unique(g, return_counts=True)
            most = ids[size.argmax()]
            every = [x[lo:hi] for x in columns[1:]] + [np.arange(hi - lo)]
            rest = np.flatnonzero(g != most)
            if len(rest) * (hi - lo) <= tile * tile:
                found.append(_pairs([x[rest] for x in every], every, most, differences))
                waiting += len(found[-1])
            else:
                n = every[1]
                for i in range(0, len(rest), tile):
                    own = rest[i : i + tile]
                    for j in range(0, hi - lo, tile):
                        other = slice(j, min(j + tile, hi - lo))
                        if differences or (n[other][0] * PERCENT <= 100 * n[own[-1]] and n[own[0]] * PERCENT <= 100 * n[other][-1]):
                            tiles.append((int(most), packed(np.stack([x[own] for x in every])), packed(np.stack([x[other] for x in every]))))
            if waiting > 500_000:
                found, waiting = [np.unique(np.concatenate(found), axis=0)], 0
        return table_of(np.unique(np.concatenate(found), axis=0), tiles)

    def tiled(batches):
        for batch in batches:
            for most, own, other in zip(batch.column("most").to_pylist(), *(unpacked(batch.column(c), np.int64) for c in ("own", "other")), strict=True):
                pairs = _pairs(list(own.reshape(7, -1)), list(other.reshape(7, -1)), most, differences)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    first = materialise(lists.groupBy("part").applyInArrow(work, schema))
    rest = first.where("own is not null").select("most", "own", "other")
    rest = rest.repartition(F.xxhash64("own", "other")).mapInArrow(tiled, "a bigint, b bigint")
    return first.where("a is not null").select("a", "b").union(rest).distinct()


COMPARED = "a bigint, b bigint, common bigint, linked boolean, size_a bigint, size_b bigint, differences binary"


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the exact overlap and the sizes of their sets, whether they are linked, and the elements that
    only one of the two has, as sorted hashes that b is part of."""
    # A set that many pairs have as b, as a leader has, is copied once for every SHARE of them, and its pairs are dealt over the copies.
    pairs = materialise(pairs)
    hot = materialise(pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("copies")).where("copies > 1"))
    first = sets.select(F.col("doc").alias("a"), F.col("elements").alias("x"))
    second = sets.select(F.col("doc").alias("b"), F.col("elements").alias("y"))
    few = pairs.join(hot, "b", "left_anti").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    dealt = pairs.join(hot, "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).join(first, "a").select("a", "b", "copy", "x")
    copied = second.join(hot, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    both = few.unionByName(dealt.join(copied, ["b", "copy"]).select("a", "b", "x", "y"))

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                t = batch.slice(lo, 256)
                out = []
                for b, x, y in zip(t.column("b").to_pylist(), unpacked(t.column("x")), unpacked(t.column("y")), strict=True):
                    z = np.concatenate([x, y])
                    z.sort()
                    twice = np.r_[z[1:] == z[:-1], False]
                    k = int(twice.sum())
                    twice[1:] |= twice[:-1]
                    only = np.sort(mix(z[~twice] ^ mix(np.array([b], np.int64).view(np.uint64))))
                    out.append((k, 100 * k >= PERCENT * (len(x) + len(y) - k), len(x), len(y), packed(only)))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], ["a", "b", "common", "linked", "size_a", "size_b", "differences"])

    return both.mapInArrow(work, COMPARED)


def under_leaders(star: DataFrame, groups: DataFrame, sets: DataFrame, parts: int, tile: int = TILE) -> DataFrame:
    """Links among sets compared with the same leader that are needed besides those with it."""
    # 9 |x & y| >= 4 (|x| + |y|) with c shared differences: 18 c >= v(x) + v(y).
    weight = (9 * F.col("size_b") - 18 * F.col("common") + 8 * F.col("size_a")).alias("v")
    rows = star.select("a", "b", "linked", "differences", weight)
    heads = rows.groupBy("b").agg(F.min("v").alias("least"), F.min_by("a", F.struct("v", "a")).alias("nearest"), F.min(F.when(~F.col("linked"), F.col("v"))).alias("least_apart"), F.count("*").alias("n"))
    heads = heads.where("least_apart is not null and n > 1")
    rows = rows.join(heads, "b")
    at_once = rows.where("v + least <= 0 and a <> nearest").select("a", F.col("nearest").alias("b"))
    size = F.octet_length("differences") / 8
    least = F.greatest(F.ceil((F.col("v") + F.when(F.col("linked"), F.col("least_apart")).otherwise(F.col("least"))) / 18), F.lit(1))
    few = rows.join(groups.withColumnRenamed("doc", "a"), "a", "left").select(
        F.col("a").alias("doc"), F.pmod(F.xxhash64("a"), F.lit(PER_PARTITION * parts)).alias("batch"), F.col("differences").alias("elements"),
        (size - least + 1).cast("long").alias("prefix"), F.coalesce("group", "a").alias("group"), F.col("b").alias("leader"), F.col("v").alias("weight"),
    )
    few = materialise(few)
    pairs = candidates(postings(few, materialise(frequencies(few.select("doc", "batch", "elements"), parts)), parts), True, tile)
    return at_once.union(compared(pairs, sets).where("linked").select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """For each end of a link (a, b) the smallest id that links reach: columns doc, component."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"))
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.least("l", "m").alias("l"), F.col("l").alias("was"))
        up = step.select(F.col("v").alias("l"), F.col("l").alias("u"))
        new = materialise(step.join(up, "l", "left").select("v", F.least("l", F.coalesce("u", "l")).alias("l"), "was"))
        changed = new.where("l <> was").limit(1).count()
        labels = new.select("v", "l")
        if not changed:
            return labels.select(F.col("v").alias("doc"), F.col("l").alias("component"))


def links(sets: DataFrame, parts: int, tile: int = TILE) -> DataFrame:
    """A set of links (a, b) that connects all linked sets. sets: doc, batch, elements."""
    answers = materialise(frequencies(sets, parts))
    n = (F.octet_length("elements") / 8).cast("long")
    # n - ceil(n PERCENT / 100) + 1
    sized = sets.withColumn("prefix", n - F.ceil(n * PERCENT / 100).cast("long") + 1)
    bare = sized.withColumns({"group": F.col("doc"), "leader": F.lit(-1).cast("long"), "weight": F.lit(0).cast("long")})
    star = materialise(compared(leaders(postings(bare, answers, parts, central=True)), sets))
    joined_to = star.where("linked").select(F.col("a").alias("doc"), F.col("b").alias("head"))
    over = joined_to.select(F.col("doc").alias("head"), F.col("head").alias("top"))
    groups = joined_to.join(over, "head", "left").select("doc", F.coalesce("top", "head").alias("group"))
    known = sized.join(groups, "doc", "left").join(star.select(F.col("a").alias("doc"), F.col("b").alias("leader")), "doc", "left")
    known = known.select("doc", "batch", "elements", "prefix", F.coalesce("group", "doc").alias("group"), F.coalesce("leader", F.lit(-1).cast("long")).alias("leader"), F.lit(0).cast("long").alias("weight"))
    rest = compared(candidates(postings(known, answers, parts), tile=tile), sets)
    return star.where("linked").select("a", "b").union(under_leaders(star, groups, sets, parts, tile)).union(rest.where("linked").select("a", "b"))


def join(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, class_id (the smallest id with the same set), component_id.

    Sets are known by the number of a row that has them, so ids may repeat: rows of one id are one document, which is
    linked with all that any of its texts is linked with.
    """
    spark = docs.sparkSession
    parts = parallelism(spark)
    texts = in_batches(docs, "doc_id", "text")
    known = materialise(classes(texts, exchanged(texts, parts)))
    live = known.where("elements is not null").select(F.col("rep").alias("doc"), "elements")
    sets = bucketed(live.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(PER_PARTITION * parts))), "doc", parts)
    reps = known.where("rep is not null").select("doc_id", "rep", "rep_id").distinct()
    several = reps.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("doc_id", "b")
    same_id = reps.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    found = components(links(sets, parts, tile).unionByName(same_id))
    members = found.join(reps.select(F.col("rep").alias("doc"), "rep_id").distinct(), "doc")
    least = members.groupBy("component").agg(F.min("rep_id").alias("least"))
    named = members.join(least, "component").select("doc", "least")
    out = known.select("doc_id", "n_shingles", "rep", "rep_id").join(named, F.col("rep") == F.col("doc"), "left")
    # Without words a row is alone, but for other rows of its id.
    bare = known.where("rep is null and doc_id is not null").select("doc_id").distinct()
    by_id = reps.join(bare, "doc_id", "left_semi").join(named.withColumnRenamed("doc", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("least", "rep_id")).alias("of_id"))
    out = out.join(by_id, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep_id", "doc_id").alias("class_id"), F.coalesce("least", "rep_id", "of_id", "doc_id").alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return join(docs)
