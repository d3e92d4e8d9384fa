"""Record lineage of RDD jobs: a facade over pair RDDs of (id, value).

Source records get ids; narrow operations keep them; operations that bring records together by key store (key id, record id) links
before the shuffle and go on with stock RDD operations. Lineage of a join is by key: an output comes from all records of its key on either side. Every RDD also knows how it was made
from its sources' values, so a job can be replayed, without lineage, on traced records alone.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark import RDD, SparkContext, StorageLevel
from pyspark.sql import SparkSession

#: Ids up to which a frontier is sent to the tasks as a set; a larger one is joined.
SMALL_FRONTIER = 500_000
#: Ids of string keys that a task remembers.
REMEMBERED = 1 << 16


def key_id(key: Any) -> int:
    """A 63-bit id of a key, the same in every process. (Among n keys, n**2 / 2**64 pairs are expected to share one.)"""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") >> 1


def _with_key_ids(of: Callable[[Any], Any], make: Callable[[int, Any], Any]) -> Callable[[Iterable], Iterator]:
    """For mapPartitions: make(id of the key of x, x) for every x; ids of strings are remembered."""

    def run(items: Iterable) -> Iterator:
        seen: dict[str, int] = {}
        for x in items:
            key = of(x)
            if type(key) is not str:
                yield make(key_id(key), x)
                continue
            if (i := seen.get(key)) is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                i = seen[key] = key_id(key)
            yield make(i, x)

    return run


_OUT = _with_key_ids(lambda kv: kv[0], lambda i, kv: (i, kv))
_LINK = _with_key_ids(lambda x: x[1][0], lambda i, x: (i, x[0]))


@dataclass(eq=False)
class _Level:
    """Where ids come from: a source's records, or links to the levels before (out id, in id), one RDD a branch."""

    records: RDD | None = None
    links: list[RDD] = field(default_factory=list)
    before: list[_Level] = field(default_factory=list)


Sources = dict[_Level, RDD]


class LineageContext:
    def __init__(self, sc: SparkContext, storage: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.sc, self.storage, self.capturing, self._held = sc, storage, True, []
        self.position: LineageCursor | None = None

    def setCaptureLineage(self, on: bool) -> None:
        self.capturing = on

    def isLineageActive(self) -> bool:
        return self.capturing

    def _hold(self, rdd: RDD) -> RDD:
        if not self.capturing:
            return rdd
        self._held.append(rdd.persist(self.storage))
        return rdd

    def _source(self, rdd: RDD) -> Lineage:
        numbered = rdd.zipWithIndex().map(lambda x: (x[1], x[0]))
        level = _Level(records=numbered)
        return Lineage(self, numbered, level, lambda sources: sources.get(level, rdd))

    def textFile(self, path: str, minPartitions: int | None = None) -> Lineage:
        return self._source(self.sc.textFile(path, minPartitions))

    def parallelize(self, items: Iterable, numSlices: int | None = None) -> Lineage:
        return self._source(self.sc.parallelize(items, numSlices))

    def hadoopFile(self, path: str, inputFormatClass: str, keyClass: str, valueClass: str, **options: Any) -> Lineage:
        return self._source(self.sc.hadoopFile(path, inputFormatClass, keyClass, valueClass, **options))

    def releaseLineage(self) -> None:
        for r in self._held:
            r.unpersist()
        self._held = []

    # ---- a walk whose position the context keeps

    def getLineage(self, job: Lineage) -> LineageCursor:
        self.position = LineageCursor(job, job.level, job.rdd.keys())
        return self.position

    def _at(self) -> LineageCursor:
        if self.position is None:
            raise ValueError("no walk has begun: call getLineage first")
        return self.position

    def getBackward(self, path: int = 0) -> LineageCursor:
        """One level back from the position."""
        self.position = self._at().goBack(path)
        return self.position

    def getForward(self) -> LineageCursor:
        """One level on, the way that the walk came."""
        self.position = self._at().goNext()
        return self.position

    @staticmethod
    def search(job: Lineage, target: Lineage) -> list[int]:
        """The branches that lead from a job's level back to that of an RDD it was made from; an error if there is no way."""
        ways: deque[tuple[_Level, list[int]]] = deque([(job.level, [])])
        while ways:
            level, way = ways.popleft()
            if level is target.level:
                return way
            ways.extend((x, [*way, i]) for i, x in enumerate(level.before))
        raise ValueError("the job was not made from that RDD")


class Lineage:
    """An RDD whose records know where they come from; `rdd` holds (id, value), and `made` makes the values from those of the sources."""

    def __init__(self, context: LineageContext, rdd: RDD, level: _Level, made: Callable[[Sources], RDD]):
        self.context, self.rdd, self.level, self.made = context, rdd, level, made

    def _narrow(self, rdd: RDD, again: Callable[[RDD], RDD]) -> Lineage:
        return Lineage(self.context, rdd, self.level, lambda sources: again(self.made(sources)))

    # ---- narrow operations

    def map(self, f: Callable) -> Lineage:
        return self._narrow(self.rdd.map(lambda x: (x[0], f(x[1]))), lambda r: r.map(f))

    def flatMap(self, f: Callable) -> Lineage:
        return self._narrow(self.rdd.flatMap(lambda x: ((x[0], v) for v in f(x[1]))), lambda r: r.flatMap(f))

    def filter(self, f: Callable) -> Lineage:
        return self._narrow(self.rdd.filter(lambda x: f(x[1])), lambda r: r.filter(f))

    def keyBy(self, f: Callable) -> Lineage:
        return self.map(lambda v: (f(v), v))

    def mapValues(self, f: Callable) -> Lineage:
        return self.map(lambda kv: (kv[0], f(kv[1])))

    def flatMapValues(self, f: Callable) -> Lineage:
        return self.flatMap(lambda kv: ((kv[0], v) for v in f(kv[1])))

    def values(self) -> Lineage:
        return self.map(lambda kv: kv[1])

    def keys(self) -> Lineage:
        return self.map(lambda kv: kv[0])

    def mapPartitions(self, f: Callable, preservesPartitioning: bool = False) -> Lineage:
        """f maps an iterator of values to one value for each, in order; for more or fewer use mapPartitionsWithIds."""
        return self.mapPartitionsWithIndex(lambda _, it: f(it), preservesPartitioning)

    def mapPartitionsWithIndex(self, f: Callable, preservesPartitioning: bool = False) -> Lineage:
        """The k-th output is credited to the k-th input, however far f reads ahead. Another number of outputs is an error."""

        def run(index: int, records: Iterable) -> Iterable:
            waiting: deque = deque()

            def values() -> Iterator:
                for i, v in records:
                    waiting.append(i)
                    yield v

            inputs = values()
            for v in f(index, inputs):
                if not waiting:
                    raise ValueError("the function gives more outputs than it reads inputs: use mapPartitionsWithIds")
                yield waiting.popleft(), v
            if waiting or next(inputs, inputs) is not inputs:
                raise ValueError("the function gives fewer outputs than it has inputs: use mapPartitionsWithIds")

        return self._narrow(self.rdd.mapPartitionsWithIndex(run, preservesPartitioning), lambda r: r.mapPartitionsWithIndex(f, preservesPartitioning))

    def mapPartitionsWithIds(self, f: Callable, preservesPartitioning: bool = False) -> Lineage:
        """f maps an iterator of (id, value) to any number of (id, value), and so says itself which record an output comes from."""
        return self._narrow(self.rdd.mapPartitions(f, preservesPartitioning), lambda r: r.mapPartitions(lambda it: (v for _, v in f(enumerate(it)))))

    def coalesce(self, n: int, shuffle: bool = False) -> Lineage:
        return self._narrow(self.rdd.coalesce(n, shuffle), lambda r: r.coalesce(n, shuffle))

    def sortBy(self, f: Callable, ascending: bool = True, numPartitions: int | None = None) -> Lineage:
        return self._narrow(self.rdd.sortBy(lambda x: f(x[1]), ascending, numPartitions), lambda r: r.sortBy(f, ascending, numPartitions))

    def sortByKey(self, ascending: bool = True, numPartitions: int | None = None) -> Lineage:
        return self.sortBy(lambda kv: kv[0], ascending, numPartitions)

    def repartitionAndSortWithinPartitions(self, numPartitions: int | None = None) -> Lineage:
        byKey = self.rdd.map(lambda x: (x[1][0], (x[0], x[1][1]))).repartitionAndSortWithinPartitions(numPartitions)
        return self._narrow(byKey.map(lambda x: (x[1][0], (x[0], x[1][1]))), lambda r: r.repartitionAndSortWithinPartitions(numPartitions))

    def zipWithUniqueId(self) -> Lineage:
        return self._narrow(self.rdd.zipWithUniqueId().map(lambda x: (x[0][0], (x[0][1], x[1]))), lambda r: r.zipWithUniqueId())

    def zipPartitions(self, others: list[Lineage], f: Callable) -> Lineage:
        """f(iterators of values) for each group of partitions with one index; the k-th output is credited to this RDD's k-th record, more outputs than records are an error.

        A group of partitions is one task's list, since f may read its iterators in any order; nothing is shuffled.
        """

        def zipped(rdds: list[RDD]) -> RDD:
            out = rdds[0].glom().map(lambda x: (x,))
            for r in rdds[1:]:
                out = out.zip(r.glom()).map(lambda x: (*x[0], x[1]))
            return out

        def run(lists: tuple) -> Iterator:
            mine = iter(lists[0])
            for v in f(*[iter([v for _, v in one]) for one in lists]):
                i = next(mine, None)
                if i is None:
                    raise ValueError("the function gives more outputs than the first RDD has records")
                yield i[0], v

        again = lambda sources: zipped([x.made(sources) for x in (self, *others)]).flatMap(lambda lists: f(*map(iter, lists)))
        return Lineage(self.context, zipped([x.rdd for x in (self, *others)]).flatMap(run), self.level, again)

    # ---- operations that bring records together

    def _keyed(self, pairs: Lineage, make: Callable[[RDD], RDD]) -> Lineage:
        base = self.context._hold(pairs.rdd)
        out = make(base.values()).mapPartitions(_OUT)
        return Lineage(self.context, out, _Level(links=[base.mapPartitions(_LINK)], before=[pairs.level]), lambda sources: make(pairs.made(sources)))

    def reduceByKey(self, f: Callable, numPartitions: int | None = None) -> Lineage:
        return self._keyed(self, lambda r: r.reduceByKey(f, numPartitions))

    def groupByKey(self, numPartitions: int | None = None) -> Lineage:
        return self._keyed(self, lambda r: r.groupByKey(numPartitions).mapValues(list))

    def aggregateByKey(self, zero: Any, seq: Callable, comb: Callable, numPartitions: int | None = None) -> Lineage:
        return self._keyed(self, lambda r: r.aggregateByKey(zero, seq, comb, numPartitions))

    def combineByKey(self, create: Callable, merge: Callable, combine: Callable, numPartitions: int | None = None) -> Lineage:
        return self._keyed(self, lambda r: r.combineByKey(create, merge, combine, numPartitions))

    def groupBy(self, f: Callable, numPartitions: int | None = None) -> Lineage:
        return self.keyBy(f).groupByKey(numPartitions)

    def distinct(self, numPartitions: int | None = None) -> Lineage:
        return self._keyed(self.map(lambda v: (v, None)), lambda r: r.reduceByKey(lambda a, _: a, numPartitions)).map(lambda kv: kv[0])

    def cogroup(self, other: Lineage, numPartitions: int | None = None) -> Lineage:
        return self._paired(other, lambda a, b: a.cogroup(b, numPartitions).mapValues(lambda x: (list(x[0]), list(x[1]))))

    def join(self, other: Lineage, numPartitions: int | None = None) -> Lineage:
        return self._paired(other, lambda a, b: a.join(b, numPartitions))

    def _paired(self, other: Lineage, make: Callable) -> Lineage:
        sides = [self.context._hold(x.rdd) for x in (self, other)]
        links = [s.mapPartitions(_LINK) for s in sides]
        out = make(*[s.values() for s in sides]).mapPartitions(_OUT)
        return Lineage(self.context, out, _Level(links=links, before=[self.level, other.level]), lambda sources: make(self.made(sources), other.made(sources)))

    def union(self, other: Lineage) -> Lineage:
        sides = [self.context._hold(x.rdd) for x in (self, other)]
        moved = [s.map(lambda x, b=b: (key_id((b, x[0])), x[1])) for b, s in enumerate(sides)]
        links = [s.map(lambda x, b=b: (key_id((b, x[0])), x[0])) for b, s in enumerate(sides)]
        out = moved[0].union(moved[1]).coalesce(max(1, self.rdd.getNumPartitions()))
        return Lineage(self.context, out, _Level(links=links, before=[self.level, other.level]), lambda sources: self.made(sources).union(other.made(sources)))

    # ---- actions

    def collect(self) -> list:
        return [v for _, v in self.rdd.collect()]

    def collectWithId(self) -> list[tuple[Any, int]]:
        return [(v, i) for i, v in self.rdd.collect()]

    def replay(self, *traced: LineageCursor) -> RDD:
        """The job's outputs, without lineage, from the records at these cursors (each at a source) alone; sources without a cursor are read whole."""
        sources: Sources = {}
        for c in traced:
            if not c.atSource:
                raise ValueError("a job is replayed from records of its sources: go back first")
            sources[c.level] = c.toRDD() if c.level not in sources else sources[c.level].union(c.toRDD())
        return self.made(sources)

    def replayCollect(self, *traced: LineageCursor) -> list:
        return self.replay(*traced).collect()

    def count(self) -> int:
        return self.rdd.count()

    def saveAsTextFile(self, path: str) -> None:
        self.rdd.map(lambda x: str(x[1])).saveAsTextFile(path)

    def saveAsHadoopFile(self, path: str, outputFormatClass: str, **options: Any) -> None:
        self.rdd.values().saveAsHadoopFile(path, outputFormatClass, **options)

    def saveAsHadoopDataset(self, conf: dict) -> None:
        self.rdd.values().saveAsHadoopDataset(conf)

    def getLineage(self) -> LineageCursor:
        return self.context.getLineage(self)


class LineageCursor:
    """Ids at a level of an RDD job."""

    def __init__(self, job: Lineage, level: _Level, ids: RDD, path: tuple = ()):
        self.job, self.level, self.ids, self.path = job, level, ids, path

    def filter(self, wanted: int | Iterable[int] | Callable) -> LineageCursor:
        keep = wanted if callable(wanted) else {wanted}.__contains__ if isinstance(wanted, int) else set(wanted).__contains__
        return LineageCursor(self.job, self.level, self.ids.filter(keep), self.path)

    def collect(self) -> list[int]:
        return sorted(set(self.ids.collect()))

    @property
    def atSource(self) -> bool:
        return self.level.records is not None

    def _of(self, pairs: RDD) -> RDD:
        """The pairs (id, x) of the ids here: by a set in the tasks if the ids are few, or else by a join."""
        marks = self.ids.distinct()
        few = marks.take(SMALL_FRONTIER + 1)
        if len(few) <= SMALL_FRONTIER:
            wanted = pairs.context.broadcast(frozenset(few))
            return pairs.filter(lambda x: x[0] in wanted.value)
        return pairs.join(marks.map(lambda i: (i, None))).mapValues(lambda x: x[0])

    def _through(self, links: RDD) -> RDD:
        return self._of(links).values().distinct()

    def goBack(self, path: int = 0) -> LineageCursor:
        if self.atSource:
            raise ValueError("the walk is at a source: nothing lies further back")
        return LineageCursor(self.job, self.level.before[path], self._through(self.level.links[path]), (*self.path, (self, path)))

    getBack = goBack

    def goNext(self) -> LineageCursor:
        if not self.path:
            raise ValueError("the walk is at the result: nothing lies further on")
        before, branch = self.path[-1]
        return LineageCursor(self.job, before.level, self._through(before.level.links[branch].map(lambda x: (x[1], x[0]))), self.path[:-1])

    def goBackAll(self, times: int | None = None) -> LineageCursor:
        at = self
        while not at.atSource and (times is None or times > 0):
            at, times = at.goBack(), None if times is None else times - 1
        return at

    def goNextAll(self, times: int | None = None) -> LineageCursor:
        at = self
        while at.path and (times is None or times > 0):
            at, times = at.goNext(), None if times is None else times - 1
        return at

    def intersection(self, other: LineageCursor) -> LineageCursor:
        return LineageCursor(self.job, self.level, self.ids.intersection(other.ids), self.path)

    def dump(self) -> RDD:
        """(id, source record) for the ids here."""
        if not self.atSource:
            raise ValueError("records can be shown at a source only")
        return self._of(self.level.records)

    def toRDD(self) -> RDD:
        return self.dump().values()

    def replay(self) -> RDD:
        """The job's outputs from the source records here alone."""
        return self.job.replay(self)

    def show(self) -> list:
        return [v for _, v in sorted(self.dump().collect(), key=lambda x: x[0])]

    def pairs(self, branch: int = 0) -> RDD:
        """(id here, id one level back)."""
        if self.atSource:
            return self.ids.distinct().map(lambda i: (i, i))
        return self._of(self.level.links[branch])

    def saveAsCSVFile(self, path: str, branch: int = 0) -> None:
        def line(x: tuple) -> str:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(x)
            return out.getvalue()

        self.pairs(branch).map(line).coalesce(1).saveAsTextFile(path)

    def saveAsDBTable(self, url: str, user: str, password: str, table: str, driver: str, branch: int = 0) -> None:
        spark = SparkSession.builder.getOrCreate()
        df = spark.createDataFrame(self.pairs(branch), "input long, output long")
        df.write.option("batchsize", 1000).jdbc(url, table, "append", {"user": user, "password": password, "driver": driver})
