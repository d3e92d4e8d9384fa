"""Similarity join of documents on sets of word n-grams (Jaccard), by an R-tree over count vectors.

Every document's set of n-grams is hashed into groups; the number of its n-grams in each group is a coordinate of its point. Two
documents with sizes a and b and a similarity of t or more differ in at most d = (1-t)/(1+t) * (a+b) n-grams. The number of
coordinates is the power of two not below that of the n-grams, so that bounds are as sharp for long texts as for short ones; a finer point is folded to compare it with a coarser one.

1. Equal sets are folded into one class (its least doc_id), however many copies there are.
2. Blocks. The n-grams of a document in one group form a token. A pair that links differs in d groups at most, so if each
   document emits the first d+1 of its tokens, fullest groups first, a linking pair shares one (the argument of
   prefix filters, on tokens). A token is several n-grams at once, so passages that many documents share make few and small blocks. The number of
   groups depends on a size class; documents near a class's upper end also emit tokens for the next class. Tokens travel once,
   packed by range; a token that many documents of one task hold stays with them, and only the least document of these travels for it.
3. Each block's documents are first held against its least document (a star, linear in the block). Pairs whose points' bound allows a link are verified
   on their n-grams. Connected documents get one label; large groups of near copies end here.
4. Blocks that still hold several labels are joined by an R-tree over the points: a node's coordinate maxima and size range
   bound the overlap of all that lies below it by the sum of coordinate minima. Blocks with the same members are joined once. Large
   blocks are cut into leaves, by label first; leaf pairs are tested by their nodes, and only those that pass are dealt, with points, never texts.
   A first round verifies, of each block, a spanning forest of the pairs that pass (likeliest first). A second takes every pair whose labels still differ,
   but for those tested.
5. Verified links, not all pairs, give the components. Pairs that are connected already are not tested: their number grows with the square of a group. `similar_pairs` lists all links.

N-grams are compared by 64-bit hashes. A text with fewer words than n is one n-gram; without words it has none and links with
nothing. A null text has no words. Documents with a null doc_id have a null component and link with nothing. Rows that repeat a doc_id with different texts count as one document for the components (its links are those of all its texts).
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, discard, keep, small_or_not
from .components import components, joined_further

#: Points below a node of the tree; documents in a leaf, and pairs in a task, about; n-grams for each coordinate, at most; least coordinates.
FAN, LEAF, SPREAD, LEAST_DIMS = 8, 400, 1, 128
#: Groups for each n-gram that may differ, and more of them for short texts; ratio of size classes (never below 1/t).
GROUPS, MORE_GROUPS, CLASSES = 1.15, 12, 2.0
#: Tokens that a task sorts at once when it packs them, and in a range of tokens; documents of one task with a token beyond which they stay there.
PACK, RANGE, LOCAL = 1 << 21, 1 << 19, 64
#: Narrow rows up to which a table is broadcast; coordinates that a tree holds, and one of its steps compares (points are folded to that).
SMALL, STEP = 500_000, 1 << 23
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The inverse of _A modulo 2**64.
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)  # A-Z as a-z
with np.errstate(over="ignore"):
    _BYTE = _mix((_BYTE + np.uint64(1)) * _A)
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(size, x, np.uint64)) for x in (_A, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    gap = _GAP[raw]
    word = ~gap
    start = np.flatnonzero(word & np.append(True, gap[:-1])) if len(raw) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64)
    end = np.flatnonzero(word & np.append(gap[1:], True)) + 1
    with np.errstate(over="ignore"):
        up, down = _powers(len(raw))
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * up, dtype=np.uint64))
        words = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        k = min(n, len(words))
        grams = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            grams = grams * _A + words[i : len(words) - k + 1 + i]
        return np.unique(_mix(grams + np.uint64(k)))


def differ_at_most(size: int, num: int, den: int) -> int:
    """Most n-grams in which a set of `size` can differ from one that links with it: the partner may be larger by 1/t."""
    return (den - num) * size // num


@lru_cache(64)
def class_ends(num: int, den: int) -> tuple[int, ...]:
    """Least sizes of the size classes. Partners of a set lie in its own class or the ones beside it."""
    ends, ratio = [1], max(CLASSES, den / num)
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, math.ceil(ends[-1] * ratio)))
    return tuple(ends)


def tokens(grams: np.ndarray, num: int, den: int) -> np.ndarray:
    """The document's tokens in its size class, and in the next class if a partner can lie there."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    ends = class_ends(num, den)
    own, d, out = bisect_right(ends, n) - 1, differ_at_most(n, num, den), []
    for c in (own, own + 1):
        if c > own and n * den // num < ends[c]:
            break
        k = int(GROUPS * differ_at_most(ends[c + 1] - 1, num, den)) + MORE_GROUPS
        with np.errstate(over="ignore"):
            g = ((_mix(grams * _C + _A) >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            order = np.argsort(g, kind="stable")
            g = g[order]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sums = np.add.reduceat(grams[order], first)
            count = np.diff(np.append(first, n))
            t = _mix(sums ^ _mix(g[first] + np.uint64(c + 1) * _A))
            rank = (np.uint64(255) - np.minimum(count, 255).astype(np.uint64)) << np.uint64(56) | (t >> np.uint64(8))
            best = np.argpartition(rank, d)[: d + 1] if len(rank) > d + 1 else np.arange(len(rank))
            out.append(t[best].view(np.int64))
            if len(t) <= d:  # all groups may differ: a linking partner has as few filled groups, and meets this set in one block
                out.append(_mix(np.array([c + 1], np.uint64) * _B + _C).view(np.int64))
    return np.concatenate(out)


def point(grams: np.ndarray) -> np.ndarray:
    """The count of n-grams in each group."""
    dims = LEAST_DIMS
    while dims * SPREAD < len(grams):
        dims *= 2
    return np.bincount((grams % np.uint64(dims)).astype(np.int64), minlength=dims).astype(np.int32)


def packed(p: np.ndarray) -> bytes:
    """One byte a coordinate, or four after a zero byte."""
    return p.astype(np.uint8).tobytes() if p.max(initial=0) < 256 else b"\0" + p.astype(np.uint32).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).astype(np.int32) if len(raw) % 2 == 0 else np.frombuffer(raw[1:], np.uint32).astype(np.int32)


def folded(p: np.ndarray, dims: int) -> np.ndarray:
    """The point with `dims` coordinates, a divisor of its own number."""
    return p if len(p) == dims else p.reshape(-1, dims).sum(0)


def allowed(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Whether the bound lets two documents of these points link."""
    sizes, dims = int(p.sum() + q.sum()), min(len(p), len(q))
    return int(np.minimum(folded(p, dims), folded(q, dims)).sum()) * (num + den) >= num * sizes


class RTree:
    """Points packed by size and then by their fullest coordinates; each level has the maxima, size ranges and label ranges of FAN nodes below."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.order = np.lexsort((*points.T[:4], sizes))
        top, low, high, first, last = points[self.order], sizes[self.order], sizes[self.order], labels[self.order], labels[self.order]
        self.levels = [(top, low, high, first, last)]
        while len(top) > 1:
            cuts = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            first, last = np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)
            self.levels.append((top, low, high, first, last))

    def pairs(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices i, j of points with different labels whose bound lets them link, each pair once, and the bound of their overlap; from the root down by pairs of nodes."""
        i = j = np.zeros(1, np.int64)
        bound = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high, first, last = self.levels[depth]
            leaf = depth == 0
            ok = (high[i] * den >= num * low[j]) & (high[j] * den >= num * low[i])
            ok &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
            i, j = (i[ok & (i < j)], j[ok & (i < j)]) if leaf else (i[ok], j[ok])
            bound = np.zeros(len(i), np.int64)
            for at in range(0, len(i), step := max(1, STEP // top.shape[1])):
                bound[at : at + step] = np.minimum(top[i[at : at + step]], top[j[at : at + step]]).sum(1)
            # The least sizes below both nodes that can still link with each other.
            a, b = np.maximum(low[i], -(-num * low[j] // den)), np.maximum(low[j], -(-num * low[i] // den))
            ok = bound * (num + den) >= num * (a + b)
            i, j, bound = i[ok], j[ok], bound[ok]
            if not leaf:
                below = len(self.levels[depth - 1][1])
                x, y = (np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN))
                i, j = (i[:, None] * FAN + x).ravel(), (j[:, None] * FAN + y).ravel()
                ok = (i <= j) & (i < below) & (j < below)
                i, j = i[ok], j[ok]
        return self.order[i], self.order[j], bound


def candidates(ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, points: list[np.ndarray], num: int, den: int, spanning: bool, sides: np.ndarray | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (a > b) with different labels whose bound allows a link, across the sides only if there are two; of these a spanning forest, likeliest first, if `spanning`.

    Also whether pairs were left out.
    """
    dims = min(map(len, points))
    while dims > LEAST_DIMS and dims * len(points) > STEP:
        dims //= 2
    i, j, bound = RTree(np.array([folded(p, dims) for p in points]), sizes, labels).pairs(num, den)
    if sides is not None and len(set(sides.tolist())) > 1:
        across = sides[i] != sides[j]
        i, j, bound = i[across], j[across], bound[across]
    if not spanning:
        return [(int(a), int(b)) for a, b in zip(np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j]), strict=True)], False
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := top.get(x, x)) != x:
            top[x] = top.get(up, up)
            x = up
        return x

    out = []
    for k in np.argsort(-bound / (sizes[i] + sizes[j]), kind="stable"):
        x, y = int(i[k]), int(j[k])
        p, q = root(int(labels[x])), root(int(labels[y]))
        if p != q:
            top[p] = q
            out.append((int(max(ids[x], ids[y])), int(min(ids[x], ids[y]))))
    return out, len(out) < len(i)


def _flat(raw: np.ndarray) -> bytes:
    """The bytes of 8-byte numbers, the first of each number first: high zero bytes then compress."""
    return raw.view(np.uint8).reshape(-1, 8).T.tobytes()


def _wide(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _blocks(classes: DataFrame, total: int) -> DataFrame:
    """token, id, hub: the members of each token that two classes or more share, and the least of them (of those that stayed in one task, and of the rest)."""
    bits = max(0, math.ceil(math.log2(max(1, total / RANGE))))
    kinds = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            token = np.concatenate([t for t, _ in held])
            ids = np.repeat(np.array([i for _, i in held], np.int64), [len(t) for t, _ in held])
            order = np.lexsort((ids, token))
            token, ids = token[order], ids[order]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(first, len(token)))
            rows: list[tuple[int, bytes, bytes]] = []
            goes = np.ones(len(token), bool)
            for f, n in zip(first[length > LOCAL].tolist(), length[length > LOCAL].tolist(), strict=True):
                rows.append((-1 - int((token[f] ^ np.uint64(ids[f])) >> np.uint64(1)), _flat(token[f : f + 1]), _flat(ids[f : f + n])))
                goes[f + 1 : f + n] = False
            token, ids = token[goes], ids[goes]
            bucket = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(token)).tolist()
            for f, e in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(bucket[f]), _flat(token[f:e]), _flat(ids[f:e])))
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[at : at + 1000], strict=True), kinds, strict=True)], schema=kinds)

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                held.append((np.frombuffer(t, np.uint64), i))
                size += len(t) // 8
                if size >= PACK:
                    yield from flushed()
                    held, size = [], 0
        if size:
            yield from flushed()

    def members(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["bucket"].iloc[0] < 0:  # a token that many of one task share; equal keys of several tokens are rows of their own
            parts = [(np.repeat(_wide(t, np.uint64), len(i) // 8), _wide(i, np.int64)) for t, i in zip(frame["tokens"], frame["ids"], strict=True)]
            parts = [(t, i, np.full(len(i), i.min())) for t, i in parts]
            token, ids, hub = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            token = np.concatenate([_wide(t, np.uint64) for t in frame["tokens"]])
            ids = np.concatenate([_wide(i, np.int64) for i in frame["ids"]])
            order = np.lexsort((ids, token))
            token, ids = token[order], ids[order]
            new = np.append(True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1]))
            token, ids = token[new], ids[new]
            first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            length = np.diff(np.append(first, len(token)))
            many = np.repeat(length > 1, length)
            token, ids, hub = token[many], ids[many], np.repeat(ids[first], length)[many]
        return pd.DataFrame({"token": token.view(np.int64), "id": ids, "hub": hub})

    rows = classes.select("id", "tokens").mapInArrow(pack, "bucket long, tokens binary, ids binary")
    return rows.groupBy("bucket").applyInPandas(members, "token long, id long, hub long")


def _tested(pairs: DataFrame, payload: DataFrame, made: Callable, test: Callable[[object, object], bool]) -> DataFrame:
    """The pairs (a, b) of a kept table that pass `test`, on what `made` makes of the payloads (id, payload) of both.

    Pairs of one b meet in one task, those of a frequent b in several; a task has about LEAF pairs.
    """
    n = pairs.count()
    often = keep(pairs.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF), "often")
    salted = pairs.join(small_or_not(often, often.count(), SMALL), "b", "left")
    leaf = F.coalesce(F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / LEAF)), F.lit(0).cast("long"))
    salted = salted.select("a", "b", F.pmod(F.xxhash64("b", leaf), F.lit(max(1, -(-n // LEAF)))).alias("bin"))
    tops = salted.select(F.col("b").alias("id"), "b", "bin").distinct()
    rows = salted.select(F.col("a").alias("id"), "b", "bin").unionByName(tops)
    rows = payload.join(small_or_not(rows, 2 * n, SMALL), "id")  # few pairs go to the payloads, which then are not shuffled

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_hub = (frame["id"] == frame["b"]).to_numpy()
        tops = dict(zip(frame["b"][is_hub], frame["payload"][is_hub], strict=True))
        found, last, hub = [], None, None
        for ident, b, p in frame.loc[~is_hub].sort_values("b", kind="stable")[["id", "b", "payload"]].itertuples(index=False):
            if b != last:
                last, hub = b, made(tops[b])
            if test(made(p), hub):
                found.append((ident, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bin").applyInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs that link."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) * den < num * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return den * both >= num * (len(x) + len(y) - both)

    return _tested(pairs, texts, lambda t: shingles(t, n), test)


def _leaf_units(rows: DataFrame, num: int, den: int) -> DataFrame:
    """unit, id, label, n, point, side: the pairs of leaves, of blocks with more than LEAF documents, that may hold a link.

    Documents of a frequent label share leaves with no others, so that leaves of one label are not paired.
    """
    counts = rows.groupBy("token", "label").agg(F.count("*").alias("m"))
    counts = keep(counts.withColumn("own", F.when(F.col("m") * 2 > LEAF, F.col("label"))), "label-counts")
    heavy = keep(counts.filter("own is not null").select("token", "label", "own", F.col("m").alias("m_own")), "heavy-labels")
    light = keep(counts.filter("own is null").groupBy("token").agg(F.sum("m").alias("m_rest")), "light-labels")
    leafy = rows.join(small_or_not(heavy, heavy.count(), SMALL), ["token", "label"], "left").join(small_or_not(light, light.count(), SMALL), "token", "left")
    leaves = F.ceil(F.coalesce("m_own", "m_rest") / LEAF)
    leafy = leafy.withColumn("leaf", F.xxhash64("own", F.pmod(F.xxhash64(F.lit(3), "id"), leaves))).select("token", "leaf", "id", "label", "n", "point")
    leafy = keep(leafy, "leaves")

    def node(frame: pd.DataFrame) -> pd.DataFrame:
        points = [unpacked(p) for p in frame["point"]]
        dims, labels = min(map(len, points)), set(frame["label"])
        top = np.max([folded(p, dims) for p in points], axis=0)
        only = labels.pop() if len(labels) == 1 else None
        return pd.DataFrame({"token": [frame["token"].iloc[0]], "leaf": [frame["leaf"].iloc[0]], "top": [packed(top)], "lo": [frame["n"].min()], "hi": [frame["n"].max()], "only": pd.array([only], "Int64")})

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        tops = [unpacked(p) for p in frame["top"]]
        dims = min(map(len, tops))
        tops, lo, hi = np.array([folded(p, dims) for p in tops]), frame["lo"].to_numpy(), frame["hi"].to_numpy()
        leaf, only = frame["leaf"].to_numpy(), frame["only"].to_numpy(float, na_value=np.nan)
        found = []
        for i in range(len(leaf)):
            a, b = np.maximum(lo[i], -(-num * lo[i:] // den)), np.maximum(lo[i:], -(-num * lo[i] // den))
            ok = (np.minimum(tops[i], tops[i:]).sum(1) * (num + den) >= num * (a + b)) & (hi[i] * den >= num * lo[i:]) & (hi[i:] * den >= num * lo[i]) & ~(only[i:] == only[i])
            found += [(leaf[i], leaf[i + k]) for k in np.flatnonzero(ok)]
        return pd.DataFrame({"token": [frame["token"].iloc[0]] * len(found), "i": [x for x, _ in found], "j": [y for _, y in found]}, dtype="int64")

    nodes = leafy.groupBy("token", "leaf").applyInPandas(node, "token long, leaf long, top binary, lo long, hi long, only long")
    met = keep(nodes.groupBy("token").applyInPandas(meet, "token long, i long, j long"), "leaf-pairs")
    ends = met.select("token", F.col("i").alias("leaf"), "i", "j").unionByName(met.filter("i <> j").select("token", F.col("j").alias("leaf"), "i", "j"))
    return leafy.join(ends, ["token", "leaf"]).select("token", F.xxhash64("token", "i", "j").alias("unit"), "id", "label", "n", "point", F.col("leaf").alias("side"))


def _open_pairs(blocks: DataFrame, points: DataFrame, roots: DataFrame, num: int, den: int, spanning: bool) -> DataFrame:
    """Pairs (a, b) inside blocks that hold several labels and three documents or more, that an R-tree over their points lets pass, and the tokens `more` of blocks with pairs left out."""
    labelled = blocks.select("token", "id").join(small_or_not(roots.withColumnRenamed("node", "id"), roots.count(), SMALL), "id", "left")
    rows = keep(labelled.select("token", "id", F.coalesce("root", "id").alias("label")), "labelled")  # the least member of a task's rows may stand here twice
    h = F.xxhash64("id")
    sums = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.sum(F.shiftright(h, 24)).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(7), "id"), 24)).alias("y"))
    sums = keep(sums.filter("m > 2 and lo < hi").groupBy("m", "x", "y").agg(F.min("token").alias("token")).select("token", "m"), "open")  # equal members: once
    found = sums.agg(F.count("*").alias("n"), F.max("m").alias("most"), F.sum("m").alias("rows")).head()
    held = rows.join(small_or_not(sums, found["n"], SMALL), "token").join(points, "id")
    columns = ("token", "unit", "id", "label", "n", "point", "side")
    units = held.filter(F.col("m") <= LEAF).withColumn("unit", F.col("token")).withColumn("side", F.lit(0).cast("long")).select(*columns)
    if (found["most"] or 0) > LEAF:
        units = units.unionByName(_leaf_units(held.filter(F.col("m") > LEAF).drop("m"), num, den).select(*columns))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b, more = [], [], []
        for _, part in frame.groupby("unit", sort=False):
            pairs, left = candidates(*[part[c].to_numpy() for c in ("id", "label", "n")], [unpacked(v) for v in part["point"]], num, den, spanning, part["side"].to_numpy())
            pairs = [(x, y, None) for x, y in pairs] + [(None, None, part["token"].iloc[0])] * left
            a, b, more = ([*old, *(p[k] for p in pairs)] for k, old in enumerate((a, b, more)))
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "more": pd.array(more, "Int64")})

    bins = max(1, -(-(found["rows"] or 0) // (2 * LEAF)))
    return units.withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins))).groupBy("bin").applyInPandas(run, "a long, b long, more long").distinct()


class Prepared(NamedTuple):
    """What blocks and stars leave: rows (doc_id, n_shingles, digest), classes by digest (named), blocks of two classes or more, their points and texts, and the star pairs whose bound allows a link."""

    rows: DataFrame
    named: DataFrame
    blocks: DataFrame
    points: DataFrame
    bodies: DataFrame
    near: DataFrame


def _prepared(docs: DataFrame, n: int, num: int, den: int) -> Prepared:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))

    def run(b: pa.RecordBatch) -> dict:
        import hashlib

        sets = [shingles(t, n) for t in b.column("text").to_pylist()]
        return {
            "doc_id": b.column("doc_id"),
            "mark": b.column("mark"),
            "n": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "point": [packed(point(s)) for s in sets],
            "tokens": [tokens(s, num, den).tobytes() for s in sets],
        }

    signed = keep(by_batch(texts, "doc_id long, mark long, n long, digest binary, point binary, tokens binary", run, 500), "signed")
    held = signed.filter("digest is not null and doc_id is not null")
    # The copy with the least doc_id stands for a set: its row is chosen before the shuffle, so that no number of copies meets in one task.
    classes = held.groupBy("digest").agg(F.min("doc_id").alias("set_id"), F.min_by(F.struct("mark", "n", "point", "tokens"), "doc_id").alias("of"))
    classes = keep(classes.select("digest", "set_id", "of.*"), "classes")
    rows = keep(signed.select("doc_id", F.col("n").alias("n_shingles"), "digest"), "rows")
    discard(signed)
    # The set's id: its least doc_id, or a hash where one doc_id is the least of several sets (rows that repeat an id with other texts).
    repeated = keep(classes.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1").select("set_id", F.lit(True).alias("twice")), "repeated")
    several = not repeated.isEmpty()

    def of(df: DataFrame) -> DataFrame:
        if not several:
            return df.withColumn("id", F.col("set_id"))
        return df.join(repeated, "set_id", "left").withColumn("id", F.when(F.col("twice"), F.xxhash64("digest")).otherwise(F.col("set_id"))).drop("twice")

    named = keep(of(classes.select("digest", "set_id")), "named")
    total = classes.agg(F.sum(F.length("tokens")).alias("n")).head()["n"] or 0
    blocks = keep(_blocks(of(classes), total // 8), "blocks")
    inside = keep(blocks.select("id").distinct(), "in-blocks")
    n_inside = inside.count()
    points = keep(of(classes.drop("tokens")).join(small_or_not(inside, n_inside, SMALL), "id").select("id", "set_id", "mark", "n", "point"), "points")
    discard(classes, inside)
    wanted = points.select("id", F.col("set_id").alias("doc_id"), "mark")
    bodies = keep(texts.join(small_or_not(wanted, n_inside, SMALL), ["doc_id", "mark"]).select("id", F.col("text").alias("payload")), "bodies")
    if bodies.count() > n_inside:  # rows that repeat an id and a text
        bodies = keep(bodies.groupBy("id").agg(F.min("payload").alias("payload")), "bodies")
    star = keep(blocks.filter("id > hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "star")
    near = keep(_tested(star, points.select("id", F.col("point").alias("payload")), unpacked, lambda p, q: allowed(p, q, num, den)), "near")
    discard(star)
    return Prepared(rows, named, blocks, points, bodies, near)


def similar_pairs(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets: (a, b) with a > b, ids of classes; and the membership (doc_id, id) of every document with a set.

    A class's id is its least doc_id (or a hash, where that is the least of several classes). All pairs inside blocks that pass the R-tree's bound are verified, so the work grows with
    the number of links, which is the square of a group's different texts; `similar_groups` needs a small part of them.
    """
    p = _prepared(docs, n, num, den)
    alone = docs.sparkSession.createDataFrame([], "node long, root long")  # every class has a label of its own
    found = _open_pairs(p.blocks, p.points.select("id", "n", "point"), alone, num, den, False)
    pairs = keep(p.near.unionByName(found.filter("a is not null").select("a", "b")).distinct(), "pairs")
    links = keep(_verified(pairs, p.bodies, n, num, den).distinct(), "links")
    members = p.rows.filter("digest is not null and doc_id is not null").join(p.named.select("digest", "id"), "digest").select("doc_id", "id")
    return links, members


def similar_groups(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id (the least doc_id with the same set) of every row; links need num/den similarity of n-gram sets."""
    rows, named, blocks, points, bodies, near = _prepared(docs, n, num, den)
    roots = keep(components(keep(_verified(near, bodies, n, num, den), "star-links"), "a", "b"), "roots")
    discard(near)
    tested, open_ = None, blocks
    for spanning in (True, False):
        found = keep(_open_pairs(open_, points.select("id", "n", "point"), roots, num, den, spanning), "open-pairs")
        pairs = found.filter("a is not null").select("a", "b").distinct()
        tested = keep(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "candidates")
        links = keep(_verified(tested, bodies, n, num, den), "links")
        if not links.isEmpty():
            roots = keep(joined_further(roots, links, "a", "b"), "roots")
        more = keep(found.filter("more is not null").select(F.col("more").alias("token")).distinct(), "more")
        n_more = more.count()
        if not n_more:
            break
        open_ = keep(blocks.join(small_or_not(more, n_more, SMALL), "token"), "open-blocks")
    linked = named.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = linked.groupBy("root").agg(F.min("set_id").alias("least"))
    linked = keep(linked.join(least, "root").select("digest", "set_id", F.col("least").alias("root")), "linked")
    discard(bodies, blocks, points)
    # One id with several texts ties its sets together.
    by_id = rows.filter("digest is not null and doc_id is not null").join(linked, "digest")
    own = keep(by_id.groupBy("doc_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("doc_id", "lo"), "tied")
    if not own.isEmpty():
        again = components(by_id.join(own, "doc_id").select("root", "lo").filter("root > lo"), "root", "lo").select(F.col("node").alias("root"), F.col("root").alias("top"))
        linked = linked.join(again, "root", "left").select("digest", "set_id", F.coalesce("top", "root").alias("root"))
    out = rows.join(linked, "digest", "left")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id"))


def distinct_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The columns of documents: of each group of similar documents only the one with the least doc_id; others and empty ones stay.

    Of rows equal in all columns one stays. Rows that repeat an id with other values stay if the id does.
    """
    names = ("doc_id", "text", "lang", "source", "n_chars")
    gone = keep(similar_groups(docs, n, num, den).filter("doc_id > component_id").select("doc_id").distinct(), "gone")
    rest = docs.select(*names).join(small_or_not(gone, gone.count(), SMALL), "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return rest if twice.isEmpty() else rest.dropDuplicates(list(names))


__all__ = ["RTree", "allowed", "candidates", "distinct_documents", "folded", "point", "shingles", "similar_groups", "similar_pairs", "tokens"]
