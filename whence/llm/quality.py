"""Quality rules: per-document base rules, and lines that too many documents of one host share; DataFrame operations only.

Lines are normalised (lower case, white space collapsed, trimmed) and hashed. For each host the number of its documents (different ids; rows that
repeat an id count once) that hold a line is counted. A line is above the limit when SHARE of the host's documents hold it, LEAST_DOCS at least; MOST_DOCS documents are always
enough, so that the limit does not grow with the host. At least LEAST_DOCS different texts must hold it: copies of a text count as documents, but alone do not condemn its
lines. Lines above the limit are removed, and a document that keeps fewer than LEAST_WORDS words, or less than LEAST_PART of its words, is depleted and rejected.

Repeated words are found inside the row: every 8-word window is hashed to 64 bits, and windows whose hash occurs twice or
more cover their words. Frequent lines are rows of host and hash, as many as there are. Up to BROADCAST_LINES of them are broadcast, by host in
buckets; beyond, the lines of each text are joined with them, salted, and each text keeps only the hashes of its own frequent lines.

Nulls: a null text has no words (rejected by the base rule); a null source is a host of its own; null ids pass through, and are one document of a host.
An empty table gives an empty result; equal rows get equal verdicts; of rows that repeat an id each is judged by its own text. Extra columns are neither read nor returned, but for those named in `extra`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, WORD, keep, text_of

LEAST_DOCS, SHARE, MOST_DOCS, LEAST_WORDS, LEAST_PART = 5, 0.1, 200, 20, 0.3
WINDOW = 8
#: Hashes of frequent lines, over all hosts, up to which they are broadcast; buckets of a host's hashes; parts that a key is dealt to beyond.
BROADCAST_LINES, BUCKETS, SALTS = 500_000, 1024, 32


def host_of(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), GAP, " ")))


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, from the array `words`."""
    df = df.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    at = lambda i: [F.get("hashed", i + k) for k in range(WINDOW)]
    df = df.withColumn("windows", F.when(F.size("hashed") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashed") - WINDOW), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("ranked", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.get("ranked", i)["h"] == F.get("ranked", j)["h"]
    starts = F.array_sort(F.transform(F.filter("ranked", lambda x, i: F.coalesce((x["h"] == F.get("ranked", i + 1)["h"]) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))), (i > 0) & same(i, F.greatest(i - 1, F.lit(0))))), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.when(F.col("ranked").isNull(), F.lit(0)).otherwise(covered).cast("long")).drop("hashed", "windows", "ranked")


def measured(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, the base measures, host, mark (of the text) and lines (hash and words of each line with a word), in one pass over the text."""
    text = text_of()
    df = docs.select("doc_id", *extra, host_of(F.col("source")).alias("host"), text.alias("t_"), F.array_remove(F.split(text, GAP), "").alias("words"))
    df = df.withColumn("parts", F.filter(F.split("t_", "\n"), lambda x: x.rlike(WORD)))
    df = df.select(
        "doc_id",
        *extra,
        "host",
        F.xxhash64("t_").alias("mark"),
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t_", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct("parts"))).cast("long").alias("n_dup_lines"),
        F.transform("parts", lambda x: F.struct(_line_hash(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("lines"),
    )
    df = _repeats(df).drop("words")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def frequent_lines(rows: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS) -> DataFrame:
    """host, h: the hashes of the lines that are above the host's limit; from the output of `measured`.

    The share matters only in hosts of most_docs / share documents at most; their sizes are broadcast if few, or else joined with salt.
    """
    hosts = rows.groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("n_docs"))
    hosts = keep(hosts.filter(F.col("n_docs") * share < most_docs), "hosts")
    held = own_lines(rows, "doc_id").groupBy("host", "h", "doc_id").agg(F.min("mark").alias("mark"))
    held = held.groupBy("host", "h", "mark").agg(F.count("*").alias("docs"))
    held = held.groupBy("host", "h").agg(F.sum("docs").alias("n"), F.count("*").alias("texts")).filter((F.col("n") >= least_docs) & (F.col("texts") >= least_docs))
    held = held.withColumn("salt_", F.pmod("h", F.lit(SALTS)).cast("int"))
    sizes = F.broadcast(hosts) if hosts.count() <= BROADCAST_LINES else hosts.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = held.join(sizes, [c for c in ("host", "salt_") if c in sizes.columns], "left")
    return held.filter((F.col("n") >= most_docs) | (F.col("n") >= share * F.col("n_docs"))).select("host", "h")


def own_lines(rows: DataFrame, *more: str) -> DataFrame:
    """host, mark, h: the different line hashes of each row; and the columns `more`."""
    return rows.select("host", "mark", *more, F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))


def _bucketed(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The rows with frequent: the hashes of the row's own frequent lines, looked up in the buckets of its host."""
    hosts = above.groupBy("host").agg(F.collect_set("h").alias("hs")).withColumn("size_", F.least(F.lit(BUCKETS), F.size("hs")))
    buckets = F.transform(F.sequence(F.lit(0), F.col("size_") - 1), lambda b: F.filter("hs", lambda h: F.pmod(h, F.col("size_").cast("long")) == b))
    df = rows.join(F.broadcast(hosts.select("host", "size_", buckets.alias("buckets_"))), "host", "left")
    held = F.filter(F.array_distinct(F.transform("lines", lambda x: x["h"])), lambda h: F.array_contains(F.get("buckets_", F.pmod(h, F.col("size_").cast("long")).cast("int")), h))
    return df.withColumn("frequent", F.when(F.col("size_").isNotNull(), held)).drop("size_", "buckets_")


def _salted(rows: DataFrame, above: DataFrame) -> DataFrame:
    """The same by joins: of lines with frequent ones, then of texts with what they hold; keys are dealt to SALTS parts."""
    copied = lambda df: df.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda c: F.pmod(c, F.lit(SALTS)).cast("int")
    own = own_lines(rows).distinct().withColumn("salt_", salt(F.col("mark")))
    hits = own.join(copied(above), ["host", "h", "salt_"]).groupBy("host", "mark").agg(F.collect_set("h").alias("frequent"))
    return rows.withColumn("salt_", salt(F.xxhash64("doc_id"))).join(copied(hits), ["host", "mark", "salt_"], "left").drop("salt_")


def judged(rows: DataFrame, least_words: int = LEAST_WORDS, least_part: float = LEAST_PART, most_docs: int = MOST_DOCS) -> DataFrame:
    """The rows of `measured` with frequent (of the row's own lines), removed_words and kept."""
    above = keep(frequent_lines(rows, most_docs=most_docs), "frequent-lines")
    df = _bucketed(rows, above) if above.count() <= BROADCAST_LINES else _salted(rows, above)
    removed = F.aggregate(F.filter("lines", lambda x: F.array_contains(F.col("frequent"), x["h"])), F.lit(0), lambda a, x: a + x["w"])
    df = df.withColumn("removed_words", F.when(F.col("frequent").isNull(), F.lit(0)).otherwise(removed).cast("long"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < least_part * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality(docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, removed_words and the columns `extra`."""
    return judged(keep(measured(docs, extra), "quality")).drop("host", "mark", "lines", "frequent")


def cleaned(docs: DataFrame) -> DataFrame:
    """The columns of documents, of the kept documents only, frequent lines removed from their texts."""
    names = ("text", "lang", "source", "n_chars")
    df = judged(keep(measured(docs, names), "quality")).filter("kept")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("frequent"), _line_hash(x))), "\n")
    df = df.withColumn("text_", F.when(F.col("removed_words") > 0, left).otherwise(F.col("text")))
    return df.select("doc_id", F.col("text_").alias("text"), "lang", "source", F.when(F.col("removed_words") > 0, F.char_length("text_").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
