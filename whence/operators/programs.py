"""Example programs: jobs with planted faults, and star joins with a UDF measure, each with its suspicious output.

The normal rows of the first kind are made by seeded arithmetic from any table with a column `id`, so a job grows with its input. The group with the fault has FAULTY rows and negative ids, and
holds nothing random, so that `sql` can state the values of its records.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udf import TracedUDF, element_reads, udf
from ..sources.tables import table

FAULTY = 300


def _noise(seed: int, n: int) -> Column:
    """A number in 0..n-1 from the row's id."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n))


def _planted(base: DataFrame, normal: dict[str, Column], faulty: dict[str, Column], fault: Column) -> DataFrame:
    """The base's rows with normal values, and the faulty group; `rid` and `__fault` say which row is which."""
    bad = base.sparkSession.range(FAULTY).select((-F.col("id") - 1).alias("rid"), *[c.alias(n) for n, c in faulty.items()], fault.alias("__fault"))
    return base.select(F.col("id").alias("rid"), *[c.alias(n) for n, c in normal.items()], F.lit(False).alias("__fault")).unionByName(bad)


def flight_rows(base: DataFrame) -> DataFrame:
    """Flights by hour of takeoff. The fault: clocks that wrapped at midnight, so a landing lies before its takeoff."""
    off, wrapped = _noise(1, 1380), F.col("id") < 20
    normal = {"takeoff": off.cast("int"), "landing": (off + 30 + _noise(2, 60)).cast("int"), "hour": F.floor(off / 60).cast("int")}
    faulty = {"takeoff": (F.lit(1380) + F.col("id") % 55).cast("int"), "landing": F.when(wrapped, 15).otherwise(1440).cast("int"), "hour": F.lit(23)}
    return _planted(base, normal, faulty, wrapped)


def rain_rows(base: DataFrame) -> DataFrame:
    """Rain by month. The fault: one reading whose millimetres are marked as inches."""
    wrong = F.col("id") == 0
    normal = {"reading": _noise(1, 80).cast("double"), "scale": F.lit("mm"), "month": (F.lit(1) + _noise(2, 11)).cast("int")}
    faulty = {"reading": F.when(wrong, 90.0).otherwise(F.col("id").cast("double") % 80), "scale": F.when(wrong, "in").otherwise("mm"), "month": F.lit(12)}
    return _planted(base, normal, faulty, wrong)


def exam_rows(base: DataFrame) -> DataFrame:
    """Points by year. The fault: points with a zero too many."""
    wrong = F.col("id") < 20
    normal = {"points": _noise(1, 400).cast("double"), "year": (F.lit(1) + _noise(2, 11)).cast("int")}
    return _planted(base, normal, {"points": F.when(wrong, 4000.0).otherwise(F.col("id").cast("double")), "year": F.lit(12)}, wrong)


def crash_rows(base: DataFrame) -> DataFrame:
    """Sight by severity. The fault: a sensor's missing values, which the job takes for zero."""
    lost = F.col("id") < 120
    normal = {"miles": F.lit(5.0) + _noise(1, 6), "severity": F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.lit(1) + _noise(2, 3)).cast("int"))}
    return _planted(base, normal, {"miles": F.when(lost, None).otherwise(F.lit(8.0)), "severity": F.lit(2)}, lost)


def sale_rows(base: DataFrame) -> DataFrame:
    """Sales by store and day. The fault: refunds booked as sales, all on one day."""
    refund = F.col("id") < 20
    normal = {"store": _noise(1, 99).cast("int"), "day": (F.lit(1) + _noise(2, 5)).cast("int"), "paid": F.lit(1.0) + _noise(3, 100)}
    faulty = {"store": F.lit(99), "day": F.when(refund, 3).otherwise(1 + F.col("id") % 5).cast("int"), "paid": F.when(refund, -1000.0).otherwise(1.0 + F.col("id") % 100)}
    return _planted(base, normal, faulty, refund)


def request_rows(base: DataFrame) -> DataFrame:
    """Times of requests by server. The fault: a few that wait for a timeout."""
    slow = F.col("id") < 15
    normal = {"server": _noise(1, 99).cast("int"), "millis": F.lit(1.0) + _noise(3, 9)}
    return _planted(base, normal, {"server": F.lit(99), "millis": F.when(slow, 1000.0).otherwise(1.0 + F.col("id") % 9)}, slow)


#: Words of the reviews, and what a reader makes of them.
LEXICON = {"the": 0.0, "screen": 0.0, "fine": 0.5, "battery": 0.0, "slow": -0.4, "bright": 0.6, "broken": -0.8, "light": 0.2}
WORST = ("abysmal", -100.0)


def review_rows(base: DataFrame) -> DataFrame:
    """Reviews of items: words, and their scores by the lexicon. The fault: one word with a score out of all proportion."""
    words, extreme = F.array(*map(F.lit, LEXICON)), F.col("id") < 20
    scores = F.create_map(*[F.lit(x) for w in (*LEXICON.items(), WORST) for x in w])
    word = lambda k: F.element_at(words, (F.lit(1) + k).cast("int"))
    drawn = F.transform(F.sequence(F.lit(0), (F.lit(2) + _noise(2, 20)).cast("int")), lambda j: word(F.pmod(F.xxhash64("id", j), F.lit(len(LEXICON)))))
    told = F.transform(F.sequence(F.lit(0), (F.lit(2) + F.col("id") % 5).cast("int")), lambda j: word((F.col("id") + j) % len(LEXICON)))
    told = F.when(extreme, F.concat(told, F.array(F.lit(WORST[0])))).otherwise(told)
    scored = lambda tokens: F.transform(tokens, lambda w: F.element_at(scores, w))
    return _planted(base, {"item": (F.lit(1) + _noise(1, 99)).cast("int"), "tokens": drawn, "scores": scored(drawn)}, {"item": F.lit(1000), "tokens": told, "scores": scored(told)}, extreme)


@udf("double")
def aloft(landing, takeoff):
    return 1.0 * (landing - takeoff)


@udf("double")
def gate_wait(takeoff):
    return takeoff % 60 / 1.0


@udf("double")
def millimetres(reading, scale):
    if scale == "in":
        return reading * 25.4
    return reading


@udf("double")
def millimetres_np(reading, scale):
    import numpy as np

    factor = 25.4 if scale == "in" else 1.0
    return float(np.prod([reading, factor]))


@udf("double")
def marks(points):
    return points / 100


@udf("double")
def sight(miles):
    return 0.0 if miles is None else miles


@udf("double")
def taken(paid):
    return paid + 0.0


@udf("double")
def waited(millis):
    return millis + 0.0


@udf("double")
def sentiment(tokens, scores):
    total = 0.0
    used = 0
    for word, score in zip(tokens, scores):
        if word != "the":
            total += score
            used += 1
    return total / used if used > 0 else 0.0


def token_trace(review: dict) -> list[tuple[str, float, bool]]:
    """For one review, each token, its score, and whether the score flows into the review's sentiment."""
    data, _, _ = element_reads(sentiment.fn, sentiment.params, review)
    return [(w, s, f"scores[{k}]" in data) for k, (w, s) in enumerate(zip(review["tokens"], review["scores"], strict=True))]


@dataclass(frozen=True)
class Program:
    """A job: its rows over a table with a column id, its query, the UDFs it measures with, the suspicious output and the column it stands out by.

    group: the faulty group's key as a predicate on the rows. agg, sql: the aggregate behind `column`, and the values of the faulty group's records, by number, as SQL.
    """

    rows: Callable[[DataFrame], DataFrame]
    query: Callable[[DataFrame], DataFrame]
    measures: tuple[TracedUDF, ...]
    suspicious: str
    column: str
    group: str
    agg: str
    sql: str


def _by(key: str, measure: TracedUDF, columns: tuple[str, ...], **aggs: str) -> Callable[[DataFrame], DataFrame]:
    return lambda d: d.withColumn("m", measure(*columns)).groupBy(key).agg(*[F.expr(c).alias(n) for n, c in aggs.items()])


_ALOFT = "CASE WHEN i < 20 THEN 15 ELSE 1440 END - (1380 + i % 55)"
_RAIN = "CASE WHEN i = 0 THEN 90 * 25.4 ELSE i % 80 END"
_WORDS = f"[{', '.join(str(v) for v in LEXICON.values())}]"
_HEARD = f"list_transform(list_filter(range(3 + i % 5), lambda j: (i + j) % {len(LEXICON)} <> 0), lambda j: {_WORDS}[(i + j) % {len(LEXICON)} + 1])"
_MOOD = f"(coalesce(list_sum({_HEARD}), 0) + CASE WHEN i < 20 THEN {WORST[1]} ELSE 0 END) / (len({_HEARD}) + CASE WHEN i < 20 THEN 1 ELSE 0 END)"

PROGRAMS: dict[str, Program] = {
    "airport": Program(flight_rows, _by("hour", aloft, ("landing", "takeoff"), total="sum(m)"), (aloft,), "total < 9000 and hour = 23", "total", "hour = 23", "sum", _ALOFT),
    "airport_multi": Program(flight_rows, lambda d: d.withColumn("m", aloft("landing", "takeoff")).withColumn("w", gate_wait("takeoff")).groupBy("hour").agg(F.sum("m").alias("total"), F.avg("w").alias("wait"), F.max("m").alias("longest")), (aloft, gate_wait), "hour = 23", "total", "hour = 23", "sum", _ALOFT),
    "weather": Program(rain_rows, _by("month", millimetres, ("reading", "scale"), most="max(m)"), (millimetres,), "most > 1000", "most", "month = 12", "max", _RAIN),
    "weather_np": Program(rain_rows, _by("month", millimetres_np, ("reading", "scale"), most="max(m)"), (millimetres_np,), "most > 1000", "most", "month = 12", "max", _RAIN),
    "sentiment": Program(review_rows, _by("item", sentiment, ("tokens", "scores"), mean="avg(m)"), (sentiment,), "mean < -0.5 and item = 1000", "mean", "item = 1000", "avg", _MOOD),
    "student": Program(exam_rows, _by("year", marks, ("points",), mean="avg(m)"), (marks,), "mean > 3.5", "mean", "year = 12", "avg", "CASE WHEN i < 20 THEN 4000 ELSE i END / 100.0"),
    "accidents": Program(crash_rows, _by("severity", sight, ("miles",), mean="avg(m)"), (sight,), "mean < 5", "mean", "severity = 2", "avg", "CASE WHEN i < 120 THEN 0 ELSE 8 END"),
    "nested": Program(sale_rows, lambda d: d.withColumn("m", taken("paid")).groupBy("store", "day").agg(F.sum("m").alias("daily")).groupBy("store").agg(F.avg("daily").alias("mean")), (taken,), "mean < 0", "daily", "store = 99", "sum", "CASE WHEN i < 20 THEN -1000 ELSE 1 + i % 100 END"),
    "holistic": Program(request_rows, _by("server", waited, ("millis",), p95="percentile(m, 0.95)"), (waited,), "p95 > 20", "p95", "server = 99", "p95", "CASE WHEN i < 15 THEN 1000 ELSE 1 + i % 9 END"),
}


# ---- star joins over the order tables


@udf("double")
def revenue(l_extendedprice, l_discount):
    return float(l_extendedprice) * (1.0 - float(l_discount))


@udf("double")
def one(l_quantity):
    return 1.0


@udf("double")
def quantity(l_quantity):
    return float(l_quantity)


def _star(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    keys = {"orders": "l_orderkey = o_orderkey", "part": "l_partkey = p_partkey", "supplier": "l_suppkey = s_suppkey", "customer": "o_custkey = c_custkey", "nation": "s_nationkey = n_nationkey", "region": "n_regionkey = r_regionkey"}
    df = table(spark, sf_dir, "lineitem")
    for n in names:
        df = df.join(table(spark, sf_dir, n), F.expr(keys[n]))
    return df


@dataclass(frozen=True)
class Star:
    """A fact table with dimensions: filter, key, measure and aggregate; the output traced has the largest value, ties by key."""

    tables: tuple[str, ...]
    where: str
    key: str
    measure: TracedUDF
    columns: tuple[str, ...]
    agg: str

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _star(spark, sf_dir, *self.tables).filter(self.where)
        return df.withColumn("m", self.measure(*self.columns)).groupBy(self.key).agg(getattr(F, self.agg)("m").alias("measure"))


_PRICE = ("l_extendedprice", "l_discount")
STARS: dict[str, Star] = {
    "brand_by_month": Star(("orders", "part"), "month(o_orderdate) = 11", "p_brand", revenue, _PRICE, "sum"),
    "type_in_year": Star(("orders", "part"), "year(o_orderdate) = 1996", "p_type", revenue, _PRICE, "sum"),
    "brand_in_year": Star(("orders", "part"), "year(o_orderdate) = 1997 and month(o_orderdate) = 12", "p_brand", revenue, _PRICE, "sum"),
    "returned_types": Star(("orders", "part"), "l_returnflag = 'R' and p_size < 20", "p_type", revenue, _PRICE, "sum"),
    "priority_by_supplier": Star(("orders", "supplier"), "o_orderpriority = '1-URGENT'", "s_name", revenue, _PRICE, "sum"),
    "nation_revenue": Star(("orders", "supplier", "nation"), "o_orderstatus <> 'P'", "n_name", revenue, _PRICE, "sum"),
    "region_count": Star(("orders", "supplier", "nation", "region"), "month(o_orderdate) <= 6", "r_name", one, ("l_quantity",), "sum"),
    "segment_quantity": Star(("orders", "customer", "part"), "p_size > 25", "c_mktsegment", quantity, ("l_quantity",), "avg"),
    "brand_quantity": Star(("orders", "customer", "part", "supplier"), "c_mktsegment = 'BUILDING'", "p_brand", quantity, ("l_quantity",), "avg"),
    "brand_customers": Star(("orders", "customer", "part", "supplier", "nation"), "c_nationkey <> s_nationkey", "p_brand", revenue, _PRICE, "sum"),
}
