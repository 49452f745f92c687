"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Sorting a suffix at every byte would move each text hundreds of times. Every window of LENGTH bytes
picks an anchor inside it by its content (the least hash of its GRAM-byte strings, the rightmost of
equals), so equal windows have equal anchors at equal places. Steps:

1. Batches exchange the hashes of their anchors' strings; only anchors seen twice go on. Whole texts
   that are equal are found alike, by a 128-bit digest: one copy goes on, the others are all repeats.
2. The suffixes at these anchors are sorted within each batch and sent, front-coded, to a key range.
3. There the runs are merged by a loser tree that keeps the common prefix of each loser with the last
   winner, so known prefixes are never compared again; it gives the suffix order with its LCP array.
   What stands left of the anchors is ordered the same way, reversed.
   Anchors that occur very often are left out of this: their windows are compared by 128-bit digests.
4. A window that starts ``a`` bytes before its anchor is repeated if another anchor has the same class
   of left strings of length a and of suffixes of length LENGTH - a; classes are runs of the two
   orders between LCPs that are too short. So these windows are decided on bytes.

Null text counts as empty. Texts shorter than LENGTH lose nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import in_batches, in_order, joined, key_ranges, member, packed, unpacked
from .storage import materialise, parallelism
from .textbuf import BYTE_CODES, PIECE, byte_digests, mix, pieces, powers, rightmost_least, utf8

LENGTH, GRAM = 200, 100
SPAN = LENGTH - GRAM
#: Occurrences of an anchor's string from which its windows are compared one by one, all over the key space.
HOT = 2000


def anchors(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor with the first and the last window that picks it, of texts end to end."""
    n = len(x) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(BYTE_CODES[x] * up[: len(x)], out=sums[1:])
    g = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(x) - GRAM + 1])
    place = rightmost_least(g, SPAN + 1)
    ends = offsets[np.searchsorted(offsets, np.arange(n), "right")]
    window = np.flatnonzero(np.arange(n) + LENGTH <= ends)
    if not len(window):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
    p = place[window]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (window[1:] != window[:-1] + 1)])
    last = np.r_[first[1:], len(window)] - 1
    # Chosen hashes are the least of many; scrambled again they fall evenly into ranges.
    return mix(g[p[first]]), p[first], window[first], window[last]


def batch_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """anchors over a batch by pieces; a long text is cut into overlapping blocks. Places are the batch's."""
    out: list[tuple] = []
    for i, _, d, o in pieces(data, offsets):
        for lo in range(0, max(1, len(d) - LENGTH + 1), PIECE):
            block = d[lo : lo + PIECE + LENGTH - 1] if len(d) > 2 * PIECE else d
            h, p, s, e = anchors(block, np.clip(o - lo, 0, len(block)))
            out.append((h, *(v + lo + offsets[i] for v in (p, s, e))))
            if block is d:
                break
    return tuple(joined([x[k] for x in out], np.uint64 if not k else np.int64) for k in range(4))


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of each text's digest; texts too short to lose anything have none (zeros)."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    out[long] = np.frombuffer(byte_digests(data, offsets[long], offsets[long + 1], 16), np.uint64).reshape(-1, 2)
    return out


def _repeated_in(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.unique(values, return_counts=True)
    return u, u[n > 1]


def window_digests(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit halves of a digest of the LENGTH bytes at each start."""
    return np.frombuffer(byte_digests(data, starts, starts + LENGTH, 16), np.uint64).reshape(-1, 2)


def shared_keys(docs: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """To each batch: anchor hashes that other batches have too, those that occur more than hot times, and digests of
    its texts that others have (with whether this batch keeps the one copy)."""

    def ask(table: pa.Table) -> pa.Table:
        t = in_order(table)
        data, offsets = utf8(t.column("text"))
        keys, times = np.unique(batch_anchors(data, offsets)[0], return_counts=True)
        whole = np.unique(digests(data, offsets), axis=0)
        whole = whole[whole.any(1)]
        whole = whole[np.argsort(whole[:, 0], kind="stable")]
        a, b = key_ranges(keys, parts), key_ranges(whole[:, 0], parts)
        some = [k for k in range(parts) if a[k] < a[k + 1] or b[k] < b[k + 1]]
        return pa.table({"batch": pa.array([t.column("batch")[0].as_py()] * len(some), pa.int64()), "part": pa.array(some, pa.int32()), "keys": pa.array([packed(keys[a[k] : a[k + 1]]) for k in some], pa.binary()), "times": pa.array([packed(times[a[k] : a[k + 1]].astype(np.uint32)) for k in some], pa.binary()), "whole": pa.array([packed(whole[b[k] : b[k + 1]]) for k in some], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        t = table.sort_by("batch")
        keys, whole = unpacked(t.column("keys")), [w.reshape(-1, 2) for w in unpacked(t.column("whole"))]
        u, inverse, n = np.unique(joined(keys), return_inverse=True, return_counts=True)
        twice, often = u[n > 1], u[np.bincount(inverse, joined(unpacked(t.column("times"), np.uint32), np.uint32), len(u)) > hot]
        every = np.concatenate([np.zeros((0, 2), np.uint64), *whole])
        owner = np.repeat(np.arange(len(whole)), [len(w) for w in whole])
        _, first, inverse, n = np.unique(every, axis=0, return_index=True, return_inverse=True, return_counts=True)
        inverse = inverse.ravel()
        many, keeps = n[inverse] > 1, first[inverse] == np.arange(len(every))
        pick = lambda k, keep: packed(every[many & (owner == k) & (keeps == keep)])
        return pa.table({"batch": t.column("batch"), "keys": pa.array([packed(k[member(twice, k)]) for k in keys], pa.binary()), "hot": pa.array([packed(k[member(often, k)]) for k in keys], pa.binary()), "kept": pa.array([pick(k, True) for k in range(len(whole))], pa.binary()), "copies": pa.array([pick(k, False) for k in range(len(whole))], pa.binary())})

    asked = docs.groupBy("batch").applyInArrow(ask, "batch bigint, part int, keys binary, times binary, whole binary")
    return asked.groupBy("part").applyInArrow(answer, "batch bigint, keys binary, hot binary, kept binary, copies binary")


def lcp(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which the first at bytes are known to be equal."""
    n, step = min(len(a), len(b)), 64
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at = min(n, at + step)
        elif step == 1:
            return at
        else:
            step = step // 8 or 1
    return n


def front_coded(sorted_strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """For each string the length of the prefix it shares with the one before, and the rest."""
    shared, rest, before = [], [], b""
    for s in sorted_strings:
        k = lcp(before, s, 0)
        shared.append(k)
        rest.append(s[k:])
        before = s
    return shared, rest


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (strings, and LCP of each with the one before) by an LCP loser tree.

    Returns (run, index) in order and the LCP of each with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # LCP of each run's head with the last output
    at = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two heads whose known prefixes refer to the same string."""
        a, b = head[i], head[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        x, y = known[i], known[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        m = lcp(a, b, x)
        if m == len(a) or m < len(b) and a[m] < b[m]:
            known[j] = m
            return i, j
        known[i] = m
        return j, i

    loser = [0] * k
    winner = list(range(k))
    size = k
    while size > 1:
        size //= 2
        nxt = []
        for n in range(size):
            w, lost = play(winner[2 * n], winner[2 * n + 1])
            loser[size + n] = lost
            nxt.append(w)
        winner = nxt
    w = winner[0]
    order, shared = [], []
    while head[w] is not None:
        order.append((w, at[w]))
        shared.append(known[w])
        at[w] += 1
        strings, own = runs[w]
        if at[w] < len(strings):
            head[w], known[w] = strings[at[w]], own[at[w]]
        else:
            head[w] = None
        n = (k + w) // 2
        while n:
            w, loser[n] = play(w, loser[n])
            n //= 2
    return order, shared


RUNS = "batch bigint, part int, place binary, first binary, last binary, shared binary, rest binary, lefts binary, windows binary"


def suffix_runs(docs: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at repeated anchors, one per batch and key range; and, under part
    -1, the first and last windows that the batch itself knows to be repeated: of texts that are copies as a whole,
    and of anchors with the same bytes on both sides, of which one goes on. So a passage that many documents share
    is sent once per batch. Where such a passage begins or ends each document has bytes of its own around the same anchor:
    of anchors that occur very often, each window goes by its own digest to a range (column windows), so they spread."""

    def send(_, table: pa.Table, found: pa.Table) -> pa.Table:
        t = in_order(table)
        data, offsets = utf8(t.column("text"))
        h, p, s, e = batch_anchors(data, offsets)
        mine = digests(data, offsets)
        kept, copies = (np.concatenate([np.zeros((0, 2), np.uint64), *(x.reshape(-1, 2) for x in unpacked(found.column(c)))]) for c in ("kept", "copies"))
        known = {tuple(x) for x in kept.tolist()}
        away = {tuple(x) for x in copies.tolist()}
        n = len(offsets) - 1
        drop, covered, first_of = np.zeros(n, bool), np.zeros(n, bool), {}
        for r, d in enumerate(map(tuple, mine.tolist())):
            if d == (0, 0):
                continue
            if d in away:
                drop[r] = covered[r] = True
            elif d in first_of:
                drop[r] = covered[r] = covered[first_of[d]] = True
            else:
                first_of[d] = r
                covered[r] = d in known
        row = np.searchsorted(offsets, p, "right") - 1
        repeated = np.union1d(_repeated_in(h)[1], np.unique(joined(unpacked(found.column("keys")))))
        often = member(np.unique(joined(unpacked(found.column("hot")))), h)
        go = np.flatnonzero(member(repeated, h) & ~drop[row] & ~often)
        go = go[np.argsort(h[go], kind="stable")]
        cut = key_ranges(h[go], parts)
        out = {k: [] for k in ("batch", "part", "place", "first", "last", "shared", "rest", "lefts", "windows")}
        whole = data.tobytes()
        batch = t.column("batch")[0].as_py() if t.num_rows else None
        again = []  # entries of a context that the batch has sent once: all their windows are repeated
        for k in range(parts):
            some = go[cut[k] : cut[k + 1]]
            if not len(some):
                continue
            contexts: dict[tuple[bytes, bytes], int] = {}
            first_with = np.array([contexts.setdefault((whole[a:b], whole[b : c + LENGTH]), i) for i, (a, b, c) in enumerate(zip(s[some].tolist(), p[some].tolist(), e[some].tolist(), strict=True))], np.int64)
            times = np.bincount(first_with, minlength=len(some))
            again.append(some[times[first_with] > 1])
            some = some[times > 0]
            strings = [x[1] for x in contexts]
            order = sorted(range(len(some)), key=strings.__getitem__)
            some = some[order]
            shared, rest = front_coded([strings[i] for i in order])
            values = (batch, k, packed(p[some]), packed(s[some]), packed(e[some]), packed(np.array(shared, np.uint16)), b"".join(rest), b"".join(whole[a:b] for a, b in zip(s[some].tolist(), p[some].tolist(), strict=True)), None)
            for name, v in zip(out, values, strict=True):
                out[name].append(v)
        rows, again = np.flatnonzero(covered), joined(again, np.int64)
        twice = np.zeros(0, np.int64)
        if (hot := np.flatnonzero(often & member(repeated, h) & ~drop[row])).size:
            n = e[hot] - s[hot] + 1
            starts = np.repeat(s[hot] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            digest = window_digests(data, starts)
            order = np.lexsort((digest[:, 1], digest[:, 0]))
            digest, starts = digest[order], starts[order]
            new = np.r_[True, (digest[1:] != digest[:-1]).any(1)]
            one = np.diff(np.r_[np.flatnonzero(new), len(new)]) == 1
            twice = starts[~np.repeat(one, np.diff(np.r_[np.flatnonzero(new), len(new)]))]
            digest, starts = digest[new], starts[new]
            cut = key_ranges(digest[:, 0], parts)
            for k in range(parts):
                if cut[k] < cut[k + 1]:
                    some = starts[cut[k] : cut[k + 1]]
                    for name, v in zip(out, (batch, k, b"", packed(some), packed(some), b"", b"", b"", packed(digest[cut[k] : cut[k + 1]])), strict=True):
                        out[name].append(v)
        if len(rows) or len(again) or len(twice):
            first, last = np.r_[offsets[rows], s[again], twice], np.r_[offsets[rows + 1] - LENGTH, e[again], twice]
            for name, v in zip(out, (batch, -1, b"", packed(first), packed(last), b"", b"", b"", None), strict=True):
                out[name].append(v)
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 7]
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})

    return docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(send, RUNS)


def decided(order_r: np.ndarray, lcp_r: np.ndarray, order_l: np.ndarray, lcp_l: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each anchor and each distance a of the window's start: is the window repeated? (anchors by SPAN + 1)"""
    n = len(least)
    out = np.zeros((n, SPAN + 1), bool)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(SPAN + 1):
        who = np.flatnonzero((least <= a) & (a <= most))
        if len(who) < 2:
            continue
        right[order_r] = np.cumsum(lcp_r < LENGTH - a)
        left[order_l] = np.cumsum(lcp_l < a)
        both = left[who] * (n + 1) + right[who]
        order = np.argsort(both, kind="stable")
        v = both[order]
        same = np.r_[False, v[1:] == v[:-1]]
        same[:-1] |= same[1:]
        out[who[order[same]], a] = True
    return out


def repeated_windows(runs: DataFrame) -> DataFrame:
    """First and last windows (places in the batch) of stretches of repeated windows, by batch."""

    def work(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_pylist()
        place, first, last = (unpacked(table.column(c), np.int64) for c in ("place", "first", "last"))
        decoded, lefts, base = [], [], np.r_[0, np.cumsum([len(p) for p in place])]
        for k, (shared, rest, left) in enumerate(zip(unpacked(table.column("shared"), np.uint16), table.column("rest").to_pylist(), table.column("lefts").to_pylist(), strict=True)):
            strings, lcps, at, before = [], shared.tolist(), 0, b""
            for m, size in zip(lcps, (last[k] + LENGTH - place[k]).tolist(), strict=True):
                before = before[:m] + rest[at : at + size - m]
                at += size - m
                strings.append(before)
            decoded.append((strings, lcps))
            cut = np.r_[0, np.cumsum(place[k] - first[k])].tolist()
            lefts += [left[a:b][::-1] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        order, shared = merge(decoded)
        order_r, lcp_r = np.array([base[r] + i for r, i in order], np.int64), np.array(shared, np.int64)
        # Anchors alone in their class of GRAM bytes had only a hash in common.
        alone = (lcp_r < GRAM) & np.r_[lcp_r[1:] < GRAM, True]
        keep = np.ones(len(order_r), bool)
        keep[order_r[alone]] = False
        new = np.cumsum(keep) - 1
        ids = np.flatnonzero(keep)
        order_r, lcp_r = new[order_r[~alone]], lcp_r[~alone]
        lefts = [lefts[i] for i in ids.tolist()]
        order_l = sorted(range(len(lefts)), key=lefts.__getitem__)
        lcp_l = [lcp(lefts[a], lefts[b], 0) for a, b in zip(order_l[:-1], order_l[1:], strict=True)]
        p, s, e = (joined(x, np.int64)[ids] for x in (place, first, last))
        found = decided(order_r, lcp_r, np.array(order_l, np.int64), np.array([0, *lcp_l] if len(ids) else [], np.int64), p - e, p - s)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        run = np.searchsorted(base, ids[who], "right") - 1
        begin, end = p[who] - b + 1, p[who] - a
        groups: dict[int, list[int]] = {}
        for k in np.unique(run).tolist():
            groups.setdefault(batches[k], []).append(k)
        rows = [(batch, np.isin(run, ks)) for batch, ks in groups.items()]
        return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "first": pa.array([packed(begin[r[1]]) for r in rows], pa.binary()), "last": pa.array([packed(end[r[1]]) for r in rows], pa.binary())})

    return runs.where("part >= 0 and windows is null").groupBy("part").applyInArrow(work, "batch bigint, first binary, last binary")


def repeated_digests(runs: DataFrame) -> DataFrame:
    """repeated_windows for windows that were sent by digest: those that another batch has too."""

    def work(table: pa.Table) -> pa.Table:
        asked = [w.reshape(-1, 2) for w in unpacked(table.column("windows"))]
        _, inverse, n = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *asked]), axis=0, return_inverse=True, return_counts=True)
        found = np.split(n[inverse.ravel()] > 1, np.cumsum([len(a) for a in asked])[:-1])
        places = [packed(p[f]) for p, f in zip(unpacked(table.column("first"), np.int64), found, strict=True)]
        return pa.table({"batch": table.column("batch"), "first": pa.array(places, pa.binary()), "last": pa.array(places, pa.binary())})

    return runs.where("windows is not null").groupBy("part").applyInArrow(work, "batch bigint, first binary, last binary")


def removal(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes),
    removed (arrays of start and length of each maximal removed run)."""
    parts = parallelism(docs.sparkSession)
    texts = in_batches(docs, "doc_id", "text")
    answers = materialise(shared_keys(texts, parts, hot))
    runs = materialise(suffix_runs(texts, answers, parts))
    stretches = repeated_windows(runs).unionByName(repeated_digests(runs)).unionByName(runs.where("part = -1").select("batch", "first", "last"))

    def cut(_, table: pa.Table, found: pa.Table) -> pa.Table:
        t = in_order(table)
        data, offsets = utf8(t.column("text"))
        cover = np.zeros(len(data) + 1, np.int32)
        np.add.at(cover, joined(unpacked(found.column("first"), np.int64), np.int64), 1)
        np.add.at(cover, joined(unpacked(found.column("last"), np.int64), np.int64) + LENGTH, -1)
        gone = np.cumsum(cover)[:-1] > 0
        sums = np.r_[0, np.cumsum(gone)]
        n_removed = sums[offsets[1:]] - sums[offsets[:-1]]
        kept, starts, sizes = [], [], []
        for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_removed.tolist(), strict=True):
            edge = np.diff(np.r_[0, gone[a:b].astype(np.int8), 0]) if n else np.zeros(0, np.int8)
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            starts.append(lo.tolist())
            sizes.append((hi - lo).tolist())
            kept.append(data[a:b].tobytes() if not n else data[a:b][~gone[a:b]].tobytes())
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(x) for x in starts], pa.int64()), "kept": pa.array(kept, pa.binary()), "removed_start": pa.array(starts, pa.list_(pa.int64())), "removed_size": pa.array(sizes, pa.list_(pa.int64()))})

    return texts.groupBy("batch").cogroup(stretches.groupBy("batch")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, removed_start array<bigint>, removed_size array<bigint>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return removal(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
