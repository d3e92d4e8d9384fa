"""Sharding along a Hilbert curve over several metadata dimensions, in DataFrame operations only.

Each document becomes a point: the logarithm of its size, and order-preserving codes of `source` and `lang`, each
quantised to BITS bits. Documents are ordered by the point's index on the Hilbert curve and the order is cut into runs
of equal row counts, so that one shard holds neighbouring values in every dimension and a reader that filters on any
of them skips most files by their minima and maxima.

The global rank needs no single sorted task: counts by (curve index, salt) are summed first, their running totals give
each bucket's offset, and row numbers are taken inside buckets. The curve has at most 2**(3*BITS) indices, whatever
the input; the salt splits an index that holds a large part of all rows.

Nulls: a null text has no bytes and the checksum of the empty text; a null source or lang takes the code 0; a null
doc_id sorts first. Equal rows, and rows that repeat an id, are placed each for itself; equal rows get neighbouring slots. An empty table gives an empty result; extra columns are
neither read nor returned.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, own_columns, text_of

BITS, DIMS = 4, 3
#: Rows that one salted bucket should hold.
BUCKET_ROWS = 50_000
LEAST_SALTS = 32


@lru_cache(None)
def hilbert_indices(bits: int, dims: int) -> tuple[int, ...]:
    """For each point, its coordinates concatenated bit field by bit field, the index on the Hilbert curve."""
    out = []
    for point in range(1 << (bits * dims)):
        x = [(point >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:  # undo the rotations of the levels above
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[d]) & (q - 1)
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):  # Gray code
            x[d] ^= x[d - 1]
        t = 0
        for k in range(bits - 1, 0, -1):
            if x[-1] >> k & 1:
                t ^= (1 << k) - 1
        x = [v ^ t for v in x]
        index = 0
        for k in range(bits - 1, -1, -1):
            for d in range(dims):
                index = index << 1 | (x[d] >> k & 1)
        out.append(index)
    return tuple(out)


def hilbert_index(*coordinates: Column, bits: int = BITS) -> Column:
    """The curve index of integer columns in 0..2**bits-1, by one look-up in a constant that the optimizer folds."""
    if bits * len(coordinates) > 16:
        raise ValueError("the curve's table would be too large: bits times dimensions is 16 at most")
    table = F.split(F.lit(",".join(map(str, hilbert_indices(bits, len(coordinates))))), ",")
    point = coordinates[0].cast("int")
    for c in coordinates[1:]:
        point = point * F.lit(1 << bits) + c.cast("int")
    return F.element_at(table, point + 1).cast("int")


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _string_code(col: Column, low: str | None, high: str | None, bits: int) -> Column:
    """An order-preserving code of a string between the column's least and greatest values; nulls get 0."""
    if low is None:
        return F.lit(0)
    n = _common(low, high)
    unit = lambda s: (min(ord(s[n]), 255) if len(s) > n else 0) * 256 + (min(ord(s[n + 1]), 255) if len(s) > n + 1 else 0)
    at = lambda k: F.least(F.coalesce(F.ascii(F.substring(col, n + k, 1)), F.lit(0)), F.lit(255))
    value, lo, hi = at(1) * 256 + at(2), unit(low), unit(high)
    scaled = F.floor((value - lo) * F.lit(float(1 << bits)) / F.lit(float(hi - lo + 1)))
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), scaled.cast("int"))), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = 24, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, source, lang, curve, shard, slot: every row of `docs` in one of `shards` runs of the curve.

    Row counts of shards differ by one at most; slots count from 0 without gaps inside a shard.
    """
    meta = own_columns(docs, "doc_id", "text", "source", "lang").select(
        "doc_id", "source", "lang", (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32")
    )
    meta = keep(meta, "shard-meta")
    ends = meta.agg(F.count("*").alias("n"), F.max("size").alias("most"), *[f(c).alias(f"{n}_{c}") for c in ("source", "lang") for n, f in (("low", F.min), ("high", F.max))]).first()
    rows = ends["n"]
    top = max(1.0, float(ends["most"] or 8)) + 1
    x = F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.col("size").cast("double")) * F.lit(float(1 << bits)) / F.log2(F.lit(top))).cast("int"))
    curve = hilbert_index(_string_code(F.col("source"), ends["low_source"], ends["high_source"], bits), _string_code(F.col("lang"), ends["low_lang"], ends["high_lang"], bits), x, bits=bits)
    salts = max(LEAST_SALTS, rows // BUCKET_ROWS)
    placed = meta.withColumn("curve", curve).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).cast("int"))
    # Running totals in two steps: over indices of the curve (bounded by its length), then over the salts of each index.
    fine = placed.groupBy("curve", "salt").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("curve").agg(F.sum("n").alias("n"))
    over = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("curve", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    over = Window.partitionBy("curve").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.select("curve", "salt", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("inside"))
    starts = fine.join(coarse, "curve").select("curve", "salt", (F.col("before") + F.col("inside")).alias("start"))
    own = Window.partitionBy("curve", "salt").orderBy("doc_id", "text_crc32", "size")
    ranked = placed.withColumn("nth", F.row_number().over(own)).join(starts, ["curve", "salt"])
    total = F.lit(max(1, rows)).cast("long")
    rank = F.col("start") + F.col("nth") - 1
    shard = F.expr("div(rank * parts, total)").cast("int")
    first = F.expr("div(shard * total + parts - 1, parts)")
    return (
        ranked.select("doc_id", "size", "text_crc32", "source", "lang", "curve", rank.cast("long").alias("rank"), F.lit(shards).cast("long").alias("parts"), total.alias("total"))
        .withColumn("shard", shard)
        .withColumn("slot", (F.col("rank") - first).cast("long"))
        .drop("rank", "parts", "total")
    )
