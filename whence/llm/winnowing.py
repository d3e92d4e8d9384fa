"""Document fingerprints by winnowing: rolling hashes of k characters, the least of each window, rightmost on ties.

Any two texts that share at least K + WINDOW - 1 characters in a row share a fingerprint. Positions are kept. Hashes and windows run over
code points in numpy, by doubling: a hash of 2k characters from two of k, a least of 2w from two of w.

A null text counts as empty and has no fingerprint. A text shorter than K is hashed whole; one with fewer hashes than a
window has one window. Equal texts have equal fingerprints. `neighbours` orders by descending doc_id, nulls last, equal ids by text; rows that repeat an id lie in one range. An empty
table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches


K, WINDOW = 16, 16
#: Bytes of a batch of texts sent to a worker (one text at least), and characters of fingerprints that a worker gathers before it sends them back.
BATCH_BYTES, OUT_CHARS = 4 << 20, 4 << 20
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xBF58476D1CE4E5B9)


def _gram_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each run of k code points."""
    h = (x.astype(np.uint64) + np.uint64(1)) * _MUL
    h ^= h >> np.uint64(29)
    out, got, power, width = None, 0, _ODD, 1
    while k:
        if k & 1:
            out = h if out is None else out[: len(x) - got - width + 1] * power + h[got : got + len(x) - got - width + 1]
            got += width
        k >>= 1
        if k:
            h = h[: len(h) - width] * power + h[width:]
            with np.errstate(over="ignore"):
                power, width = power * power, 2 * width
    out = (out ^ (out >> np.uint64(31))) * _MUL
    return (out >> np.uint64(32)).astype(np.uint64)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions) of the fingerprint."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        h = _gram_hashes(x, min(k, len(x)))
    low = np.uint64(0xFFFFFFFF)
    v = (h << np.uint64(32)) | (low - np.arange(len(h), dtype=np.uint64))  # the least value: least hash, then rightmost
    left, width = min(window, len(v)), 1
    while 2 * width <= left:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    if left > width:
        v = np.minimum(v[: len(v) - (left - width)], v[left - width :])
    v = v[np.append(True, v[1:] != v[:-1])]
    return (v >> np.uint64(32)).astype(np.uint32), (low - (v & low)).astype(np.int64)


def as_string(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """Hashes (8 hexadecimal digits each), a colon, gaps between positions (2 digits each, from position 0; at most WINDOW)."""
    hashes, at = fingerprint
    return hashes.astype(">u4").tobytes().hex() + ":" + np.diff(at, prepend=0).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard index of two sets of hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) + len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, and the hashes and positions of the fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [winnow(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    small_batches(docs.sparkSession, size=BATCH_BYTES)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """part, doc_id, text, extra: rows in ranges of descending doc_id, sorted, each range closed by the next range's first row (extra).

    Range ends are quantiles of the ids, so one shuffle of the texts puts every document beside the next one; the rows that
    close ranges are one per range. The last range is closed by the first row of all.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = parts or max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts) if parts > 1 else F.lit(None)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.lit(len(cuts) + 1) if not cuts else F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - F.aggregate(F.lit(cuts), F.lit(0), lambda a, c: a + (c < F.col("doc_id")).cast("int")))
    ranged = docs.withColumn("part", part.cast("int")).withColumn("extra", F.lit(0))
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("top")).collect()  # one row a range
    if not tops:
        return ranged
    order = sorted(r["part"] for r in tops)
    closes = {p: order[i - 1] for i, p in enumerate(order)}
    heads = spark.createDataFrame([(r["part"], r["top"], closes[r["part"]]) for r in tops], "part int, top long, closes int")
    first = ranged.join(F.broadcast(heads), (ranged["part"] == heads["part"]) & ranged["doc_id"].eqNullSafe(heads["top"])).select("doc_id", "text", F.col("closes").alias("part"), F.lit(1).alias("extra"))
    first = first.groupBy("doc_id", "part", "extra").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", "part", "extra")
    both = ranged.select("doc_id", "text", "part", "extra").unionByName(first)
    return both.repartitionByRange(len(order), "part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), F.coalesce("text", F.lit("")))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `winnowed_pairs` from the rows of a range in order; a batch goes out as soon as its strings take OUT_CHARS."""
    last, rows, chars = None, [], 0
    for b in batches:
        for i in range(b.num_rows):  # texts one by one: those of a whole batch are never held twice
            part, doc_id, text = (b.column(c)[i].as_py() for c in ("part", "doc_id", "text"))
            text = text or ""
            now = (part, doc_id, text, winnow(text))
            if last and last[0] == part:
                new = edited(last[2], text)
                mark = last[3] if new == last[2] else winnow(new)
                rows.append((last[1], len(last[2]), hashlib.sha256(new.encode()).hexdigest(), as_string(last[3]), as_string(mark), likeness(last[3][0], mark[0]), likeness(last[3][0], now[3][0])))
                chars += len(rows[-1][3]) + len(rows[-1][4])
            last = now
            if chars >= OUT_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS, strict=True)], NAMES)
                rows, chars = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS, strict=True)], NAMES)


def winnowed_pairs(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text, of its edited form, and their likeness, and the likeness to the next document's."""
    small_batches(docs.sparkSession, size=BATCH_BYTES)
    return neighbours(docs).select("part", "doc_id", "text").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


__all__ = ["as_string", "edited", "fingerprints", "likeness", "neighbours", "winnow", "winnowed_pairs"]
