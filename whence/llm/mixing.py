"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document's sources overlap with those of others: its text may occur in several sources. Documents are aggregated by membership pattern (the set of the sources that hold their text,
or an array of sources that the caller gives), and a flow routes words from patterns to the quotas of their sources. A pattern's different texts are free in their first
pass; each further pass over them costs more, and so does each further pass over the rows that one source has of them (convex repetition costs), at most `repeats` passes over a row. So
a text that several sources hold is taken where words are needed most, and repeated where nothing else is left. The flow is solved exactly, by shortest paths over arrays,
over sums only, for all patterns of any number of sources: patterns, not documents, reach the driver, a row for each pair of a pattern and one of its sources. Whole documents are then selected: every document for the full passes, and
for the last part of a pass the documents that a seeded hash puts first, up to the words routed; what is then left of a source's quota is filled in the same way from all its documents.

The running total for that cut is taken over hash buckets first and inside buckets then, with as many buckets as a bucket has rows, so a source that holds a third
of all rows is never sorted in one task.

Nulls: a null text has no words; a null source is a source of its own, last in order, and so is that of a null or empty array; a null doc_id is an id like
another. Documents without words are taken 0 times. Equal rows may be told apart only by chance, and count alike; rows that repeat an id are documents of their own.
An empty table gives an empty result. Extra columns are neither read nor returned, but for those named in `extra`.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep, n_words, text_of

WEIGHTS, REPEATS, FILLS = (5, 2, 1), 3, 2
#: Rows up to which a table is broadcast; parts that a frequent text or group is dealt to beyond; pairs of a pattern and a source up to which the patterns' names are broadcast.
SMALL, SALTS, MOST_PATTERNS = 500_000, 32, 1000
#: No path; and how often paths of one pair are filled at once before the rest goes path by path.
FAR, PASSES = np.int64(1) << 60, 20


def targets_of(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the sum of `sizes` by weight; none above `most` times its size, the excess shared again by weight."""
    left, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        share = {i: most * sizes[i] for i in over}
        for i, v in share.items():
            out[i] = v
        left -= sum(share.values())
        open_ -= set(over)
    return out


def route(patterns: Sequence[tuple[int, dict[int, int]]], quotas: Sequence[int], repeats: int) -> list[dict[int, int]]:
    """Words that each pattern (the words of its different texts, and for each of its sources the words of the rows there) sends to each of its sources, as `flow_of` has them."""
    pairs = [(i, j, w) for i, (_, held) in enumerate(patterns) for j, w in held.items()]
    pat, src, held = np.array(pairs, np.int64).reshape(-1, 3).T.copy()
    sent = flow_of(np.array([w for w, _ in patterns], np.int64), pat, src, held, np.array(quotas, np.int64), repeats).tolist()
    out: list[dict[int, int]] = [{} for _ in patterns]
    for (i, j, _), f in zip(pairs, sent, strict=True):
        out[i][j] = f
    return out


def flow_of(words: np.ndarray, pat: np.ndarray, src: np.ndarray, held: np.ndarray, quotas: np.ndarray, repeats: int) -> np.ndarray:
    """Words sent along each pair of a pattern and a source; sums of costs are least for the most words routed. Any number of patterns and of sources of a pattern.

    `words`: of each pattern's different texts; `pat`, `src`, `held`: the pairs, and the words of the pattern's rows in the source. Costs of a word: k in pass k over the different texts (from
    the `repeats`-th pass on the costs rise with each doubling), and k in pass k over a source's rows. Distances from an origin by way of patterns and sources are found over arrays of all
    pairs; along paths of the least cost, those of one pair are filled at once, longer ones one by one. Only the words sent are state: costs and rooms follow from them.
    """
    sent, order = np.zeros(len(pat), np.int64), np.argsort(pat, kind="stable")
    order = order[(held[order] > 0) & (words[pat[order]] > 0)]
    pat, src, held = pat[order], src[order], held[order]
    x, total, rest, words = np.zeros(len(pat), np.int64), np.zeros(len(words), np.int64), quotas.astype(np.int64), np.maximum(words, 1)
    most = np.zeros(len(words), np.int64)
    np.add.at(most, pat, repeats * held)
    while len(pat):
        units = total // words
        price = np.where(units < repeats, units, repeats - 2 + np.frexp(np.maximum(units - repeats + 2, 1).astype(float))[1])
        top = np.where(price < repeats, price + 1, repeats - 2 + (1 << np.maximum(price - repeats + 2, 0)))
        room = np.minimum(words * top, most) - total
        to_pat, to_src = _distances(np.where(room > 0, price, FAR), pat, src, held, x, len(rest), repeats)
        best = to_src[rest > 0].min(initial=FAR)
        if best == FAR:
            break
        # Pairs on paths of the least cost, by the pass in which they are: words that fit ahead, and that can be taken back.
        step = to_src[src] - to_pat[pat]
        on = (to_pat[pat] < FAR) & (to_src[src] < FAR) & (step >= 0) & (step < repeats)
        ahead, back = np.where(on, (step + 1) * held - x, 0).clip(0), np.where(on, x - step * held, 0).clip(0)
        first, last = to_pat == price, to_src == best
        e = np.flatnonzero((ahead > 0) & first[pat] & last[src])
        moved = 0
        for _ in range(PASSES):
            e = e[(ahead[e] > 0) & (room[pat[e]] > 0) & (rest[src[e]] > 0)]
            if not len(e):
                break
            give, by = _fitting(ahead[e], pat[e], room), np.argsort(src[e], kind="stable")
            give[by] = _fitting(give[by], src[e][by], rest)
            for at, sign, where in ((x, 1, e), (ahead, -1, e), (back, 1, e), (total, 1, pat[e]), (room, -1, pat[e]), (rest, -1, src[e])):
                np.add.at(at, where, sign * give)
            moved += int(give.sum())
        moved += _by_paths(pat, src, x, ahead, back, total, rest, np.where(first, room, 0), last)
        assert moved, "a path of finite cost must take words"
    sent[order] = x
    return sent


def _distances(start: np.ndarray, pat: np.ndarray, src: np.ndarray, held: np.ndarray, x: np.ndarray, m: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """The least costs of one more word at each pattern and at each source; `start`: of one taken from the pattern's texts."""
    up, down = np.flatnonzero(x < repeats * held), np.flatnonzero(x > 0)
    more, less = x[up] // held[up], (x[down] - 1) // held[down]
    to_pat = start
    while True:
        to_src = np.full(m, FAR)
        np.minimum.at(to_src, src[up], np.where(to_pat[pat[up]] < FAR, to_pat[pat[up]] + more, FAR))
        now = start.copy()
        np.minimum.at(now, pat[down], np.where(to_src[src[down]] < FAR, to_src[src[down]] - less, FAR))
        if np.array_equal(now, to_pat):
            return to_pat, to_src
        to_pat = now


def _fitting(wanted: np.ndarray, of: np.ndarray, room: np.ndarray) -> np.ndarray:
    """What fits of `wanted` into the room of its owner, in order; rows of one owner follow each other."""
    before = np.cumsum(wanted) - wanted
    first = np.append(True, of[1:] != of[:-1])
    before -= before[first][np.cumsum(first) - 1]
    return np.clip(room[of] - before, 0, wanted)


def _by_paths(pat: np.ndarray, src: np.ndarray, x: np.ndarray, ahead: np.ndarray, back: np.ndarray, total: np.ndarray, rest: np.ndarray, room: np.ndarray, last: np.ndarray) -> int:
    """Sends words along paths of several pairs (out along `ahead`, back along `back`) on the part of the graph that lies between open patterns and open sources; how many."""
    n, m = len(room), len(rest)

    def reached(a: np.ndarray, b: np.ndarray, there: np.ndarray, again: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while True:
            had = np.count_nonzero(a) + np.count_nonzero(b)
            b[of_b[there & a[of_a]]] = True
            a[of_a[again & b[of_b]]] = True
            if np.count_nonzero(a) + np.count_nonzero(b) == had:
                return a, b

    from_p, from_s = reached(room > 0, np.zeros(m, bool), ahead > 0, back > 0, pat, src)
    to_s, to_p = reached(last & (rest > 0), np.zeros(n, bool), ahead > 0, back > 0, src, pat)
    in_p, in_s = from_p & to_p, from_s & to_s
    pairs = np.flatnonzero(in_p[pat] & in_s[src] & (ahead + back > 0))
    if not len(pairs):
        return 0
    ps, ss = np.unique(pat[pairs]), np.unique(src[pairs])
    origin, end = len(ps) + len(ss), len(ps) + len(ss) + 1
    to: list[int] = []
    left: list[int] = []
    out_of: list[list[int]] = [[] for _ in range(end + 1)]

    def arcs(a: np.ndarray, b: np.ndarray, there: np.ndarray, again: np.ndarray) -> int:
        begin = len(to)
        for p, q, c, r in zip(a.tolist(), b.tolist(), there.tolist(), again.tolist(), strict=True):
            out_of[p].append(len(to))
            out_of[q].append(len(to) + 1)
            to.extend((q, p))
            left.extend((c, r))
        return begin

    opens, ends = ps[room[ps] > 0], ss[last[ss] & (rest[ss] > 0)]
    none = np.zeros(n + m, np.int64)
    a = arcs(np.full(len(opens), origin), np.searchsorted(ps, opens), room[opens], none[: len(opens)])
    b = arcs(len(ps) + np.searchsorted(ss, ends), np.full(len(ends), end), rest[ends], none[: len(ends)])
    c = arcs(np.searchsorted(ps, pat[pairs]), len(ps) + np.searchsorted(ss, src[pairs]), ahead[pairs], back[pairs])
    _push(origin, end, out_of, to, left)
    total[opens] += np.array(left[a + 1 : b : 2], np.int64)
    rest[ends] -= np.array(left[b + 1 : c : 2], np.int64)
    x[pairs] += np.array(left[c + 1 :: 2], np.int64) - back[pairs]
    return sum(left[b + 1 : c : 2])


def _push(origin: int, end: int, out_of: list[list[int]], to: list[int], room: list[int]) -> None:
    """Sends what fits along paths, all of the least cost, until none is left."""
    tried, path, on_path = [0] * len(out_of), [], {origin}
    at = origin
    while True:
        if at == end:
            step = min(room[e] for e in path)
            for e in path:
                room[e] -= step
                room[e ^ 1] += step
            first = next(k for k, e in enumerate(path) if not room[e])
            at = to[path[first] ^ 1]
            for e in path[first:]:
                on_path.discard(to[e])
            del path[first:]
            continue
        while tried[at] < len(out_of[at]):
            e = out_of[at][tried[at]]
            if room[e] > 0 and to[e] not in on_path:
                path.append(e)
                at = to[e]
                on_path.add(at)
                break
            tried[at] += 1
        else:
            if not path:
                return
            on_path.discard(at)
            at = to[path.pop() ^ 1]
            tried[at] += 1


def _fill(df: DataFrame, groups: int) -> DataFrame:
    """Sets `more` to 1 for further documents, in seeded order, as long as their words fit what is left of `rest`.

    Running totals are taken over seeded buckets first and inside buckets then.
    """
    had = df.groupBy("group").agg(F.sum(F.col("size") * F.col("more")).alias("had"))
    df = _with(df, had, ["group"], groups).withColumn("gap", F.col("rest") - F.col("had")).drop("had")
    fits = F.when(F.col("open") & (F.col("more") == 0) & (F.col("size") <= F.col("gap")), F.col("size")).otherwise(F.lit(0))
    df = df.withColumn("fits", fits)
    sums = df.groupBy("group", "bucket").agg(F.sum("fits").alias("words"))
    over = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("group", "bucket").orderBy("dice", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("inside", F.sum("fits").over(inside)).join(sums, ["group", "bucket"])
    taken = (F.col("fits") > 0) & (F.col("before") + F.col("inside") <= F.col("gap"))
    return df.withColumn("more", F.greatest("more", taken.cast("int"))).drop("gap", "fits", "before", "inside")


def _with(df: DataFrame, per_group: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """`df` (with `dice`) and the row of its group: broadcast if the known number of groups is small, dealt by salt beyond. A frequent group never meets in one task."""
    if groups <= SMALL:
        return df.join(F.broadcast(per_group), keys)
    salted = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod("dice", F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


def _key(sources: Column) -> Column:
    """The text that stands for a set of sources, in order; null and empty sets stand for the null source."""
    held = F.array_sort(F.array_distinct(sources))
    return F.to_json(F.when(F.size(F.coalesce(held, F.array().cast("array<string>"))) > 0, held).otherwise(F.array(F.lit(None).cast("string"))))


def _patterns_of_texts(narrow: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with pattern: a digest of the sources that hold their text if there are several, else their own source as JSON; and the sources (JSON) of each digest, the latter as `found`.

    Rows carry the digest, so that a text of many sources does not repeat their names in each of its rows.
    """
    held = narrow.filter(F.col("size") > 0).groupBy("mark", "size").agg(F.min("home").alias("lo"), F.max("home").alias("hi"), F.collect_set("home").alias("sources"))
    held = held.filter(F.col("lo") != F.col("hi")).select("mark", "size", F.to_json(F.array_sort("sources")).alias("shape"))
    held = keep(held.withColumn("found", F.md5("shape")), "shared-texts")
    each = held.select("mark", "size", "found")
    narrow = narrow.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    if held.count() <= SMALL:
        got = narrow.join(F.broadcast(each), ["mark", "size"], "left")
    else:
        got = narrow.join(each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mark", "size", "salt"], "left")
    return got.withColumn("pattern", F.coalesce("found", F.to_json(F.array("home")))).drop("found", "salt"), held.groupBy("found").agg(F.min("shape").alias("shape"))


def _plan(groups: pa.Table, different: pa.Table, given: bool, weights: Sequence[float], repeats: int) -> tuple[pa.Table, int]:
    """pattern, home, full (passes over all documents), rest (words beyond), target and source_size of each group, and the number of sources.

    `groups`: pattern, home, size and rows; `different`: the words of each pattern's different texts. With `given`, a pattern's name lists its sources; else its homes are its sources.
    """
    number = lambda a, of: pc.index_in(a, value_set=of.combine_chunks()).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    pattern, held = number(groups["pattern"], different["pattern"]), groups["size"].to_numpy()
    if given:  # each source of the pattern may have all of its words
        members = [["s" + h if h is not None else "t" for h in json.loads(p)] for p in groups["pattern"].to_pylist()]
        names = sorted({h for m in members for h in m})
        at = {h: j for j, h in enumerate(names)}
        group = np.repeat(np.arange(len(members)), [len(m) for m in members])
        src = np.array([at[h] for m in members for h in m], np.int64)
    else:  # a home is "s" and the source's name, or "t" for the null source, so that it is last
        names = sorted(pc.unique(groups["home"]).to_pylist())
        group, src = np.arange(groups.num_rows), number(groups["home"], pa.chunked_array([names], pa.string()))
    sizes = np.zeros(len(names), np.int64)
    np.add.at(sizes, src, held[group])
    goals = targets_of(sizes.tolist(), [weights[j % len(weights)] for j in range(len(names))], repeats) if names else []
    quotas = np.array([round(g) for g in goals], np.int64)
    sent = flow_of(different["words"].to_numpy(), pattern[group], src, held[group], quotas, repeats)
    flow, target, source_size = np.zeros(len(held), np.int64), np.zeros(len(held)), np.zeros(len(held), np.int64)
    for out, values in ((flow, sent), (target, np.array(goals)[src]), (source_size, sizes[src])):
        np.add.at(out, group, values)
    flow, some = np.minimum(flow, repeats * held), np.maximum(held, 1)
    return pa.table({"pattern": groups["pattern"], "home": groups["home"], "full": flow // some, "rest": flow % some, "target": target, "source_size": source_size}), len(names)


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, seed: int = 7, extra: Sequence[str] = (), named: bool = True) -> DataFrame:
    """doc_id, pattern (its sources, as JSON), size, source_size, target, taken, passes and the columns `extra`: how often the mix takes each document, and its words so taken.

    `sources`: an array column of the document's sources; if it is not given, a document is its source's, and in the pattern of all sources that hold its text. Weights go to the sources in
    order of their code points, null last, and repeat. source_size and target are those of the document's source, or the sums over its sources if an array is given. Without `named` there is
    no column `pattern`: in each row of a text it names all sources that hold the text, which grows with the square of their number.
    """
    home = F.concat(F.lit("s"), F.col("source")) if sources is None else F.lit("")
    narrow = docs.select("doc_id", F.coalesce(home, F.lit("t")).alias("home"), n_words(text_of()).alias("size"), F.xxhash64(text_of()).alias("mark"), *([] if sources is None else [_key(sources).alias("pattern")]), *extra)
    narrow = keep(narrow, "mix")
    if sources is None:
        narrow, shapes = _patterns_of_texts(narrow)
        narrow = keep(narrow, "mix-patterns")
    # Rows of a pattern in a source, and their words; and the words of its different texts.
    per_group = narrow.groupBy("pattern", "home").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toArrow()
    once = narrow.groupBy("pattern", "mark", "size").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.sum("size").alias("words")).toArrow()
    groups, n_rows = per_group.num_rows, pc.sum(per_group["rows"]).as_py() or 0
    plan, n_sources = _plan(per_group, once, sources is not None, weights, repeats)
    kind = "pattern string, home string, full long, rest long, target double, source_size long"
    plan = docs.sparkSession.createDataFrame(plan if groups else [], kind).withColumn("group", F.xxhash64("pattern", "home"))
    dice = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "mark")
    buckets = max(512, math.isqrt(n_rows))
    narrow = narrow.withColumn("dice", dice).withColumn("bucket", F.pmod(F.shiftright("dice", 20), F.lit(buckets)).cast("int"))
    df = _with(narrow, plan, ["pattern", "home"], groups).withColumn("more", F.lit(0)).withColumn("open", F.lit(True))
    done: list[DataFrame] = []

    def filled(df: DataFrame, groups: int) -> DataFrame:
        done.append(keep(_fill(df, groups), "mix-fill"))
        if len(done) > 1:
            discard(done.pop(0))
        return done[0]

    for _ in range(FILLS):  # the first takes whole documents up to the words routed, the others what still fits in the gap
        df = filled(df, groups)
    if sources is None:  # what whole documents of small patterns left open is filled from all of a source's documents
        got = df.withColumn("full", F.col("full") + F.col("more")).withColumn("more", F.lit(0)).withColumn("open", F.col("full") < repeats)
        reached = got.groupBy("home").agg(F.sum(F.col("size") * F.col("full")).alias("reached"))
        got = _with(got.drop("rest"), reached, ["home"], n_sources).withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("reached"))).drop("reached")
        df = got.withColumn("group", F.xxhash64("home"))
        for _ in range(FILLS):
            df = filled(df, n_sources)
    passes = F.when((F.col("size") > 0), F.least(F.lit(repeats), F.col("full") + F.col("more"))).otherwise(F.lit(0)).cast("int")
    if sources is None and named:
        shapes = F.broadcast(shapes) if groups <= MOST_PATTERNS else shapes
        df = df.withColumn("found", F.when(F.col("pattern").startswith("["), F.col("dice").cast("string")).otherwise(F.col("pattern"))).join(shapes, "found", "left").withColumn("pattern", F.coalesce("shape", "pattern"))
    return df.select("doc_id", *(["pattern"] if named else []), "size", "source_size", "target", passes.alias("passes"), (passes * F.col("size")).cast("long").alias("taken"), *extra)
