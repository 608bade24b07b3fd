"""Exact join of token sets by Jaccard similarity: pairs that can reach 3/5, found in numpy from parts of the sets.

Of a pair with sizes n and n', at least 3/8 (n + n') tokens are common. The tokens are dealt to
parts by their hash; in at least one part the same holds for what the two sets have there (a
mediant). There, tokens are ordered by frequency, rarest first, and the rarest of both sets have
min(K, common) tokens in common, so the tuples of those are join keys. No pair is lost. A parity sketch of
128 bits, whose distance is never more than the symmetric difference, drops most of the others;
what is left must be checked by the caller.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sets up to the first edge are one part, those up to the second one 8 parts, and so on; a set lies in the bands of all smaller sets it may pair with.
EDGES, PARTS = (12, 160, 640, 2560, 10240), (1, 8, 40, 160, 640, 2560)
# Tokens in fewer than 1 of RARE sets aren't told apart by frequency, so that the list of the others has a bound.
RARE = 4096
TASKS, SETS_PER_TASK, KEYS_PER_PASS, PAIRS_PER_STEP = 24, 4_000_000, 4_000_000, 500_000
_FIRST = np.cumsum((0, *PARTS))
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def least_common(a: int, b: int) -> int:
    """Common tokens of two sets with a and b at a Jaccard similarity of 3/5."""
    return -(-3 * (a + b) // 8)


@cache
def key_plan(b: int, most: int) -> list[tuple[int, list[tuple[tuple[int, ...], bool]]]]:
    """(k, [(places, whether the set may be the smaller one)]): the key tuples of b ordered tokens."""
    larger: dict[int, int] = {}
    smaller: dict[int, int] = {}
    for o in range(-(-3 * b // 5), 5 * b // 3 + 1):
        c = least_common(b, o)
        if 0 < c <= min(b, o):
            k = min(most, c)
            for role in (larger,) * (o <= b) + (smaller,) * (o >= b):
                role[k] = max(role.get(k, 0), b - c + k)
    return [(k, [(x, x[-1] < smaller.get(k, 0)) for x in itertools.combinations(range(max(larger.get(k, 0), smaller.get(k, 0))), k)]) for k in sorted(larger.keys() | smaller.keys())]


def dealt(cid: np.ndarray, length: np.ndarray, cuts: np.ndarray, h: np.ndarray, common: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(part, packed sets) of a batch; h: token hashes, set i has h[cuts[i]:cuts[i + 1]]; common, rank: hashes of frequent tokens in order, and their ranks from 1."""
    n = np.diff(cuts)
    at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
    order = np.where(common[at] == h, rank[at], 0).astype(np.uint64) if len(common) else np.zeros(len(h), np.uint64)
    order = order << np.uint64(40) | h >> np.uint64(24)
    bit = (h >> np.uint64(8)) * _ODD[0] >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    sketch = [np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, one, np.uint64(0)), cuts[:-1]) for w in (0, 1)]
    row = np.repeat(np.arange(len(n)), n)
    spread = h * _ODD[1] >> np.uint64(33)
    low = 0
    for band, parts in enumerate(PARTS):
        high = EDGES[band] if band < len(EDGES) else np.inf
        own = (n >= low) & (3 * (n - 1) < 5 * high)  # also sets that are larger than a set of this band, up to 5/3
        low = high
        if not own.any():
            continue
        take = own[row]
        r, t, o = row[take], h[take], order[take]
        p = (spread[take] % np.uint64(parts)).astype(np.int64)
        by = np.lexsort((t, o, r, p))
        r, t, p = r[by], t[by], p[by]
        starts = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
        size = np.diff(np.append(starts, len(r)))
        sets, part = r[starts], p[starts]
        for q in range(parts):
            i, j = np.searchsorted(part, [q, q + 1])
            if i < j:
                s, tokens = sets[i:j], t[starts[i] : starts[i] + size[i:j].sum()]
                fields = (cid[s].astype(np.int64), sketch[0][s], sketch[1][s], n[s].astype(np.int32), length[s].astype(np.int32), size[i:j].astype(np.int32), (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                yield int(_FIRST[band]) + q, np.array([j - i], np.int64).tobytes() + b"".join(f.tobytes() for f in fields)


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    """cid, two sketches, n, length, size and tokens of all sets of a part."""
    out = []
    for blob in blobs:
        m, at, fields = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
        for kind in (np.int64, np.uint64, np.uint64, np.int32, np.int32, np.int32):
            fields.append(np.frombuffer(blob, kind, m, at))
            at += fields[-1].nbytes
        out.append([*fields, np.frombuffer(blob, np.uint32, -1, at)])
    return [np.concatenate(x) for x in zip(*out)]


def pairs_of_part(blobs: list[bytes], most: int, split: int = 0, splits: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(cids, cids) of pairs of one part that have a key in common and sketches that are near enough; of the keys, only those of the split."""
    cid, s0, s1, n, length, size, tokens = _unpacked(blobs)
    first = np.cumsum(size) - size
    by = np.argsort(length, kind="stable")  # so the partners of similar length are a range
    cid, s0, s1, n, length, size, first = (x[by] for x in (cid, s0, s1, n, length, size, first))
    beyond = np.searchsorted(length, 5 * length.astype(np.int64) // 4, "right").astype(np.uint64)
    before = np.searchsorted(length, -(-4 * length.astype(np.int64) // 5), "left").astype(np.uint64)
    idx_bits = np.uint64(max(1, int(len(cid)).bit_length()))
    low_bits = idx_bits + np.uint64(1)
    sizes, counts = np.unique(size, return_counts=True)
    total = sum(int(c) * sum(len(x) for _, x in key_plan(int(b), most)) for b, c in zip(sizes, counts))
    passes = splits * max(1, -(-total // (splits * KEYS_PER_PASS)))
    large = np.uint64(1) << idx_bits
    groups = [(int(b), np.flatnonzero(size == b)) for b in sizes]
    for turn in range(split, passes, splits):
        made = []
        for b, own in groups:
            for k, tuples in key_plan(b, most):
                seed = np.uint64(int(_ODD[5]) * k % 2**64)
                for q, those in itertools.groupby(tuples, lambda x: x[0][0]):
                    head = tokens[first[own] + q].astype(np.uint64)
                    # a pass has the keys of some first tokens
                    mine = np.flatnonzero((head * _ODD[2] >> np.uint64(40)) % np.uint64(passes) == turn)
                    if not len(mine):
                        continue
                    rows = own[mine]
                    head = head[mine] * _ODD[0] + seed
                    columns = {(j, z): tokens[first[rows] + z].astype(np.uint64) * _ODD[j] for z in range(q + 1, b) for j in range(1, min(k, z - q + 1))}
                    rows = rows.astype(np.uint64)
                    for places, small in those:
                        key = head.copy()
                        for j in range(1, k):
                            key += columns[j, places[j]]
                        key ^= key >> np.uint64(29)
                        key *= _ODD[4]
                        key ^= key >> np.uint64(32)
                        key *= _ODD[0]
                        key >>= low_bits
                        key <<= low_bits
                        key |= rows if small else rows | large
                        made.append(key)
        if not made:
            continue
        v = np.concatenate(made)
        del made
        v.sort()
        found = list(_joined(v, idx_bits, low_bits, cid, s0, s1, n, beyond, before))
        if found:  # a pair has many keys in common
            a, b = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            yield a[new], b[new]


def _joined(v, idx_bits, low_bits, cid, s0, s1, n, beyond, before) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within equal keys: sets that may be the smaller one among themselves, and with those that may only be the larger one."""
    one = np.uint64(1)
    same = v[1:] ^ v[:-1] < one << low_bits
    v = v[np.append(False, same) | np.append(same, False)]
    mask, large = (one << idx_bits) - one, one << idx_bits
    who = (v & mask).astype(np.int64)
    small = np.flatnonzero(v & large == 0)
    base, w = v[small] >> low_bits << low_bits, who[small]
    ends = np.searchsorted(v, base | beyond[w])
    for start, end in ((small + 1, ends), (np.searchsorted(v, base | large | before[w]), np.searchsorted(v, base | large | beyond[w]))):
        count = np.maximum(end - start, 0)
        some = np.flatnonzero(count)
        run = np.cumsum(count[some])
        at = 0
        while at < len(some):
            done = run[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(run, done + PAIRS_PER_STEP, "right")))
            part, c = some[at:to], count[some[at:to]]
            skip = np.cumsum(c) - c
            j = who[np.arange(c.sum()) + np.repeat(start[part] - skip, c)]
            near = np.bitwise_count(np.repeat(s0[w[part]], c) ^ s0[j])
            most = np.repeat(n[w[part]], c) + n[j]
            kept = np.flatnonzero(near * np.int64(4) <= most)
            i, j = np.repeat(w[part], c)[kept], j[kept]
            near = near[kept].astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
            kept = (near * 4 <= most[kept]) & (i != j)
            if kept.any():
                a, b = cid[i[kept]], cid[j[kept]]
                yield np.minimum(a, b), np.maximum(a, b)
            at = to


def candidates(sets: DataFrame, n_sets: int) -> DataFrame:
    """(a, b) with a < b, some of them repeated: all pairs with a similarity of at least 3/5 and a ratio of lengths of at least 4/5, and few others.

    sets: (cid bigint, len int, h: hashes of the distinct tokens, at least one). The table is read twice.
    """
    spark = sets.sparkSession
    most = 3 if n_sets < 100_000 else 4 if n_sets < 1_000_000 else 5
    frequent = sets.select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") * RARE >= n_sets)
    frequent = frequent.toPandas()  # at most RARE times the mean size of a set
    frequent["rank"] = frequent.sort_values(["df", "h"]).assign(r=range(1, len(frequent) + 1))["r"]
    hashes = frequent.h.to_numpy(np.int64).view(np.uint64)
    by = np.argsort(hashes)
    sent = spark.sparkContext.broadcast((hashes[by], frequent["rank"].to_numpy(np.int64)[by]))
    splits = -(-n_sets // SETS_PER_TASK) or 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            cuts = np.asarray(lists.offsets).astype(np.int64)
            h = np.asarray(lists.values)[cuts[0] : cuts[-1]].view(np.uint64)
            out = list(dealt(np.asarray(b.column(0)), np.asarray(b.column(1)), cuts - cuts[0], h, *sent.value))
            for s in range(splits):
                for part, blob in out:
                    yield pa.RecordBatch.from_arrays([pa.array([part * splits + s], pa.int32()), pa.array([blob], pa.binary())], ["part", "sets"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for b in batches:
            for part, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts.setdefault(part, []).append(blob)
        for part in list(parts):
            for a, b in pairs_of_part(parts.pop(part), most, part % splits, splits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    blobs = sets.select("cid", "len", "h").mapInArrow(deal, "part int, sets binary")
    return blobs.repartitionById(TASKS * splits, F.col("part")).mapInArrow(join, "a bigint, b bigint")
