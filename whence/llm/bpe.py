"""BPE encoding with a minimal acyclic transducer as lexicon, and decoding.

Frequent chunks of text (a word with the space before it) are encoded once and compiled into a minimal acyclic automaton:
states with equal continuations are shared, and outputs on its arcs add up to a chunk's number, which points to its ids. Its
arrays form one file, which Spark ships to every executor and workers map into memory. A batch walks all its distinct chunks
through the automaton at once. Chunks that it lacks are merged exactly, all of a batch together: in each round every
chunk merges its leftmost pair of least rank, until no pair has a rank. Pieces of more than LONG bytes, as unspaced scripts make them, are merged each by a heap over a linked list.

The lexicon changes speed only: its size is a bound on a cache (LEXICON chunks of at most LONG characters, documented parameters), and any chunk gives the
same ids with or without it. A null text counts as empty and has no ids. Rows are encoded each for itself, rows that repeat an id too; an empty table gives an empty result; extra columns
are neither read nor returned.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, keep, shared_dir, small_batches

LEXICON, LEAST_COUNT, LONG = 60_000, 4, 256
#: Distinct chunks kept in a worker between batches, and chunks counted before a partial count is passed on.
CACHED, COUNTED = 400_000, 100_000
# Unicode white space, as the tokenizer's pattern understands it, and that pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks: unions of whole pieces, since no piece holds white space but for its first character or alone.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and bytes of a byte-level BPE tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        to_byte = {c: b for b, c in byte_letters().items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in t)
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = np.array([ids[c] for _, c in sorted(byte_letters().items())], np.int32)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        first, second = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.append(np.array([ids[a + b] for a, b in pairs], np.int32), -1)
        self.pairs = first << 32 | second
        self.rank_of: dict[int, int] = {}  # the same for single look-ups, filled when a long piece needs them
        self._hash_pairs(self.pairs)
        every = np.arange(256)
        self.byte_ranks = self._rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256)).reshape(len(every), len(every))
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @classmethod
    @lru_cache(4)
    def parsed(cls, text: str) -> Vocabulary:
        return cls(json.loads(text))

    #: The rank of a pair that merges into nothing; bits for a place in a word of at most LONG bytes.
    NONE, BITS = (1 << 31) - 1, 24

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open table from pair to rank, at most a quarter full."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.NONE, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at[todo]] < 0
            who, where = todo[free][::-1], at[todo[free]][::-1]
            self.slots[where] = keys[who]  # of several that want one slot the last stays
            self.values[where] = who
            todo = todo[self.slots[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a.astype(np.int64) << 32) | b
        at = self._slot(want)
        got = self.slots[at]
        out = np.where(got == want, self.values[at], np.int32(self.NONE))
        open_ = np.flatnonzero((got != want) & (got >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slots) - 1)
            got = self.slots[at]
            hit = got == want[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (got >= 0)
            open_, at = open_[more], at[more]
        return out

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (a piece of the pattern), merged exactly; words of like length go together."""
        out: list[list[int]] = [[] for _ in words]
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
                continue
            by_size.setdefault(len(w) if len(w) <= 24 else 1 << (len(w) - 1).bit_length(), []).append(i)
        for size, all_of in by_size.items():
            step = max(1, 400_000 // max(1, size))
            for s in range(0, len(all_of), step):
                mine = all_of[s : s + step]
                for i, got in zip(mine, self._merge_block([words[i] for i in mine], size), strict=True):
                    out[i] = got
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for one long word: the pairs in a heap by rank and place, the tokens in a linked list."""
        if not self.rank_of:
            self.rank_of.update(zip(self.pairs.tolist(), range(len(self.pairs)), strict=True))
        rank, made, n = self.rank_of.get, self.made.tolist(), len(word)
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank(ids[i] << 32 | ids[j]) != r:  # a pair that earlier merges have changed
                continue
            ids[i], ids[j], k = made[r], -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := rank(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i))
            if (h := before[i]) >= 0 and (x := rank(ids[h] << 32 | ids[i])) is not None:
                heapq.heappush(heap, (x, h))
        return [t for t in ids if t >= 0]

    def _merge_block(self, words: list[bytes], size: int) -> list[list[int]]:
        """Words of at most `size` bytes; a column is a word, so that each step runs along whole rows."""
        if not size:
            return [[] for _ in words]
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size).T
        left = np.array([len(w) for w in words], np.int64)  # tokens that each word still has
        ids = self.byte_id[raw]
        place = np.arange(size, dtype=np.int64)[:, None]
        ranks = np.where(place[1:] < left, self.byte_ranks[raw[:-1], raw[1:]], self.NONE).astype(np.int64) << self.BITS | place[:-1]
        final: list = [None] * n
        live = np.arange(n)
        while len(live):
            best = ranks.min(0) if len(ranks) else np.full(len(live), self.NONE << self.BITS)
            going = best < self.NONE << self.BITS
            if not going.all():
                done = ~going
                for i, row, k in zip(live[done].tolist(), ids[:, done].T.tolist(), left[done].tolist(), strict=True):
                    final[i] = row[:k]
                live, ids, ranks, best, left = live[going], ids[:, going], ranks[:, going], best[going], left[going]
                if not len(live):
                    break
            at, cols, width = best & ((1 << self.BITS) - 1), np.arange(len(live)), len(ids)
            left = left - 1
            moved = place[: width - 1] > at  # what stands right of the merged pair moves one to the left
            ids[at, cols] = self.made[best >> self.BITS]
            ids = np.where(moved, ids[1:], ids[:-1])
            ranks = np.where(moved[:-1], (ranks[1:] >> self.BITS << self.BITS) | place[: width - 2], ranks[:-1])
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < left - 1))
                r, c = side[ok], cols[ok]
                ranks[r, c] = self._rank(ids[r, c], ids[r + 1, c]).astype(np.int64) << self.BITS | r
            gone = np.flatnonzero((at >= left - 1) & (at < width - 2))  # the pair was the word's last
            ranks[at[gone], gone] = (self.NONE << self.BITS) | at[gone]
        return final

    def encode_chunks(self, chunks: list[str], known: Callable[[str], list[int] | None] = lambda _: None) -> list[list[int]]:
        """Ids of each chunk: its pieces by the tokenizer's pattern, each merged, unless `known` has its ids."""
        find = _pieces().findall
        # A run of letters is one piece, the most frequent case.
        cut = [[c] if (c[1:] if c[0] == " " else c).isalpha() else find(c) for c in chunks]
        of: dict[str, list[int]] = dict.fromkeys(chain.from_iterable(cut))
        for p in of:
            of[p] = known(p)
        todo = [p for p, ids in of.items() if ids is None]
        of.update(zip(todo, self.merge([p.encode() for p in todo]), strict=True))
        return [of[parts[0]] if len(parts) == 1 else [x for p in parts for x in of[p]] for parts in cut]


@lru_cache(1)
def _pieces():
    import regex

    return regex.compile(PIECES)


class Transducer:
    """A minimal acyclic automaton from byte strings to lists of ids, as flat arrays that can be mapped from a file.

    Arcs are sorted keys state * 256 + byte, each with the next state and an output; the outputs along a word's path sum up to its
    number in sorted order, and `starts` says where that number's ids begin.
    """

    NAMES = ("keys", "next", "add", "final", "starts", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.next, self.add, self.final, self.starts, self.ids = (arrays[n] for n in self.NAMES)

    @classmethod
    def build(cls, entries: Iterable[tuple[bytes, list[int]]]) -> Transducer:
        entries = sorted(entries)
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (state, byte, child) of the last word, not yet shared

        def share(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (final[child], tuple(arcs[child].items()))
                arcs[parent][byte] = register.setdefault(key, child)

        last = b""
        for word, _ in entries:
            n = 0
            while n < min(len(word), len(last)) and word[n] == last[n]:
                n += 1
            share(n)
            at = path[-1][2] if path else 0
            for byte in word[n:]:
                arcs.append({})
                final.append(False)
                arcs[at][byte] = len(arcs) - 1
                path.append((at, byte, len(arcs) - 1))
                at = len(arcs) - 1
            final[at] = True
            last = word
        share(0)
        number = {0: 0}
        order, stack = [], [0]
        while stack:
            s = stack.pop()
            order.append(s)
            for t in arcs[s].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)
        reach: dict[int, int] = {}  # words below each state, children first

        def count(top: int) -> None:
            todo = [top]
            while todo:
                s = todo[-1]
                missing = [t for t in arcs[s].values() if t not in reach]
                if missing:
                    todo += missing
                else:
                    reach[s] = final[s] + sum(reach[t] for t in arcs[s].values())
                    todo.pop()

        count(0)
        keys, nxt, add = [], [], []
        for s in order:
            below = int(final[s])
            for byte in sorted(arcs[s]):
                t = arcs[s][byte]
                keys.append(number[s] * 256 + byte)
                nxt.append(number[t])
                add.append(below)
                below += reach[t]
        o = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        ends = np.zeros(len(number), np.uint8)
        for s in order:
            ends[number[s]] = final[s]
        starts = np.cumsum([0] + [len(i) for _, i in entries])
        return cls({
            "keys": np.array(keys, np.int64)[o], "next": np.array(nxt, np.int64)[o], "add": np.array(add, np.int64)[o],
            "final": ends, "starts": starts.astype(np.int64), "ids": np.array([x for _, i in entries for x in i], np.int64),
        })

    def to_bytes(self) -> bytes:
        parts = [getattr(self, n) for n in self.NAMES]
        kinds = ["<i8"] * 3 + ["<u1"] + ["<i8"] * 2
        head = np.array([len(p) for p in parts], "<i8").tobytes()
        return head + b"".join(p.astype(k).tobytes() + b"\0" * (-len(p) % 8 if k == "<u1" else 0) for p, k in zip(parts, kinds, strict=True))

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        """The automaton in a file, mapped into memory: workers on one machine share its pages."""
        whole = np.memmap(path, np.uint8, "r")
        sizes = whole[: 8 * len(cls.NAMES)].view("<i8").tolist()
        at, arrays = 8 * len(cls.NAMES), {}
        for n, size in zip(cls.NAMES, sizes, strict=True):
            wide = 1 if n == "final" else 8
            arrays[n] = whole[at : at + size * wide].view("<u1" if wide == 1 else "<i8")
            at += -(-size * wide // 8) * 8
        return cls(arrays)

    def look_up(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, or None where the lexicon lacks it; all words take one step at a time."""
        out: list[list[int] | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        length = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        live, state, total, step = np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        while len(live):
            done = length[live] == step
            for i in np.flatnonzero(done):
                if self.final[state[i]]:
                    n = total[i]
                    out[live[i]] = self.ids[self.starts[n] : self.starts[n + 1]].tolist()
            live, state, total = live[~done], state[~done], total[~done]
            if not len(live):
                break
            want = state * 256 + flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            live, at, total = live[hit], at[hit], total[hit]
            state, total, step = self.next[at], total + self.add[at], step + 1
        return out


class Encoder:
    """Texts to ids, through a cache, the lexicon and exact merges.

    Known chunks have numbers; the ids of all of them lie in one array, from `starts` on, `lengths` long. A group of texts becomes ids by gathering from it.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None = None):
        self.v, self.lexicon = vocabulary, lexicon
        self.table = pa.array(vocabulary.bytes_of, pa.large_binary())
        self._clear()

    def _clear(self) -> None:
        self.known = {c: k for k, c in enumerate(self.v.added)}  # tokens that are split off before are chunks of their own
        self.flat = np.fromiter(self.v.added.values(), np.uint32, len(self.known))
        self.starts, self.lengths = np.arange(len(self.known)), np.ones(len(self.known), np.int64)

    def _learn(self, chunks: list[str]) -> None:
        found: list = self.lexicon.look_up([c.encode() for c in chunks]) if self.lexicon is not None else [None] * len(chunks)
        rest = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(rest, self.v.encode_chunks([chunks[k] for k in rest], self._ids_of), strict=True):
            found[k] = ids
        self.known.update(zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))])

    def _ids_of(self, chunk: str) -> list[int] | None:
        k = self.known.get(chunk)
        return None if k is None else self.flat[self.starts[k] : self.starts[k] + self.lengths[k]].tolist()

    def _forget(self, chunks: list[str], numbers: int) -> None:
        """Drops the chunks that were learned last: what is held has a bounded size."""
        for c in chunks:
            del self.known[c]
        self.flat = self.flat[: self.starts[numbers]].copy()
        self.starts, self.lengths = self.starts[:numbers].copy(), self.lengths[:numbers].copy()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as 32-bit integers; texts are taken in groups of bounded length."""
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > 2_000_000:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _cut(self, text: str) -> list[str]:
        if self.v.split_added and any(a in text for a in self.v.added):
            return [c for p in self.v.split_added.split(text) for c in ([p] if p in self.v.added else CHUNK.findall(p))]
        return CHUNK.findall(text)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        cut = [self._cut(t) for t in texts]
        chunks = list(chain.from_iterable(cut))
        codes, long, held = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks)), [], 0
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            first = list(map(chunks.__getitem__, missing.tolist()))
            new = set(first)
            if len(self.known) + len(new) > CACHED:
                self._clear()
                missing, first = np.arange(len(chunks)), chunks
                new = set(chunks) - self.known.keys()
            long = [c for c in new if len(c) > LONG]
            self._learn([c for c in new if len(c) <= LONG])
            held = len(self.starts)
            self._learn(long)
            codes[missing] = np.fromiter(map(self.known.__getitem__, first), np.int64, len(first))
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.starts[codes] - ends + lengths, lengths) + np.arange(len(lengths) and ends[-1])]
        if long:
            self._forget(long, held)
        at = np.append(0, ends)[np.append(0, np.cumsum([len(c) for c in cut]))].tolist()
        for i, j in zip(at[:-1], at[1:], strict=True):
            yield ids[i:j]

    def decode(self, ids: Iterable[int]) -> str:
        """What the ids' bytes are as text: one look-up of all of them, whose values are the text's bytes in a row."""
        got = self.table.take(pa.array(ids if isinstance(ids, np.ndarray) else list(ids), pa.uint32()))
        data = got.buffers()[2]
        return data.to_pybytes().decode("utf-8", "replace") if len(got) and data is not None else ""


def frequent_chunks(docs: DataFrame, most: int = LEXICON, least: int = LEAST_COUNT) -> list[str]:
    """The most frequent chunks over all texts: counted in the workers, summed by Spark; `most` of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:  # what is longer is no word, and the lexicon would not be bounded in bytes
            held = {c: n for c, n in seen.items() if len(c) <= LONG}
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["chunk", "n"])

        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(CHUNK.findall(t))
            if len(seen) > COUNTED:  # chunks seen once here are passed on too: sums are whole
                yield out()
                seen.clear()
        if seen:
            yield out()

    small_batches(docs.sparkSession)
    sums = docs.select("text").mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    sums = keep(sums.filter(F.col("n") >= least), "chunks")
    # The least count that leaves `most` chunks at most, from a histogram with few bars: no task or driver sorts chunks.
    bar = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.floor(F.log2("n") * 100) + 10_000)
    bars = sums.groupBy(bar.alias("bar")).agg(F.count("*").alias("chunks"), F.min("n").alias("low")).orderBy(F.col("bar").desc()).collect()
    held, cut = 0, None
    for r in bars:
        held += r["chunks"]
        if held > most:
            break
        cut = r["low"]
    return sorted(r["chunk"] for r in sums.filter(F.col("n") >= cut).select("chunk").collect()) if cut is not None else []


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """Puts bytes into the shared folder and has Spark copy them to every executor; the name to ask SparkFiles for."""
    name = f"{name}-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    with tempfile.NamedTemporaryFile(suffix=".bin") as f:  # the driver's own copy, gone when it is uploaded
        f.write(data)
        f.flush()
        fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path("file://" + f.name), p)
    spark.sparkContext.addFile(fs.makeQualified(p).toString())
    return name


def encoder_for(docs: DataFrame, tokenizer_json: str, lexicon_chunks: int = LEXICON):
    """A function that gives each worker its Encoder; the lexicon is compiled from `docs` and shipped."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.parsed(tokenizer_json)
    chunks = frequent_chunks(docs, lexicon_chunks)
    lexicon = Transducer.build(zip([c.encode() for c in chunks], vocabulary.encode_chunks(chunks), strict=True))
    name = ship(spark, lexicon.to_bytes(), "lexicon")
    spec = spark.sparkContext.broadcast(tokenizer_json)  # of the tokenizer's size, whatever the input

    def get() -> Encoder:
        if name not in _READY:
            _READY.clear()
            gc.collect()
            gc.freeze()
            gc.set_threshold(200_000, 50, 1000)  # a cache of many small tuples, none of them in a cycle
            _READY[name] = Encoder(Vocabulary.parsed(spec.value), Transducer.mapped(SparkFiles.get(name)))
        return _READY[name]

    return get


_READY: dict[str, Encoder] = {}


def tokenizer_text(path: str | None = None) -> str:
    """The tokenizer file's content; by default the public byte-level vocabulary of 50k entries."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def encode_documents(docs: DataFrame, path: str | None = None, lexicon_chunks: int = LEXICON) -> DataFrame:
    """doc_id and the array of ids of every text."""
    get = encoder_for(docs, tokenizer_text(path), lexicon_chunks)

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "ids": [x.astype(np.int32) for x in get().encode([t or "" for t in b.column("text").to_pylist()])]}

    return by_batch(docs.select("doc_id", "text"), "doc_id long, ids array<int>", run)


def encoded_digests(docs: DataFrame, path: str | None = None, lexicon_chunks: int = LEXICON) -> DataFrame:
    """n_tokens, and digests of the ids and of what they decode to, for every text."""
    get = encoder_for(docs, tokenizer_text(path), lexicon_chunks)

    def run(b: pa.RecordBatch) -> dict:
        e = get()
        n, ids, back = [], [], []
        for x in e.encode([t or "" for t in b.column("text").to_pylist()]):
            n.append(len(x))
            ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
            back.append(hashlib.sha256(e.decode(x).encode()).hexdigest())
        return {"doc_id": b.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    return by_batch(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
