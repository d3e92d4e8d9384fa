"""The entry point: capture a query, collect its rows with ids, trace them."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import udf as _udf
from ..functions.taint import REGIMES, column_provenance, trace
from ..plans.graph import CaptureGraph
from ..plans.rewrite import NotCaptured, Rewriter
from .cursor import Cursor, SourceWitnesses


class Lineage:
    """Record lineage of DataFrame and SQL queries.

        t = Lineage(spark)
        t.enable_capture()
        out = t.collect_with_lineage(df)            # [(row, id), ...]
        bad = [i for row, i in out if row.total < 0]
        t.trace(df, bad).go_back().show()           # the source rows behind those outputs

    strict: refuse operators whose lineage the level of a group or key cannot express (global sorts, joins without equal keys, ranges).
    storage: level of the stored tables. prune: read only files that hold wanted rows when ids become rows again.

    Settings that are not given come from the session's configuration: spark.whence.capture, spark.whence.influence, spark.whence.focus,
    spark.whence.storageLevel (a name such as DISK_ONLY), spark.whence.prune and spark.whence.lazyCellDriverMax (witnesses up to which lazy-cell runs on the driver; or the
    environment variable LAZY_CELL_DRIVER_MAX). As a context manager it drops all that it stored at the end.
    """

    def __init__(self, spark: SparkSession, strict: bool = True, storage: StorageLevel | None = None, prune: bool | None = None):
        of = lambda name, default: spark.conf.get(f"spark.whence.{name}", default)
        on = lambda name, default: str(of(name, default)).lower() == "true"
        self.spark, self.strict = spark, strict
        self.storage = storage or getattr(StorageLevel, of("storageLevel", "MEMORY_AND_DISK"))
        self.prune = on("prune", "true") if prune is None else prune
        self.capturing, self.influence_on, self.focus = on("capture", "true"), on("influence", "false"), of("focus", "")
        self.measures: list[_udf.TracedUDF] = []
        self.mode, self.fallback = "column", None
        self._graphs: dict[int, tuple[DataFrame, CaptureGraph | None]] = {}

    def __enter__(self) -> Lineage:
        return self

    def __exit__(self, *_: object) -> None:
        self.release_all()
        self.disable_udf_aware()

    # ---- settings

    def enable_capture(self) -> None:
        self.capturing = True

    def disable_capture(self) -> None:
        self.capturing = False

    def enable_influence(self, agg: str | None = None, on: Any = None) -> None:
        """Also store each record's contribution to every aggregate. agg: used where a query's own aggregate has no closed form."""
        self.influence_on, self.fallback = True, agg

    def disable_influence(self) -> None:
        self.influence_on, self.fallback = False, None

    def enable_focus(self, predicate: str) -> None:
        """Store lineage only for records of groups that satisfy a predicate on the group's keys."""
        self.focus = predicate

    def disable_focus(self) -> None:
        self.focus = ""

    def enable_udf_aware(self, *measures: _udf.TracedUDF, mode: str = "column") -> None:
        """Report which fields these UDFs read. column: one static answer; cell: recorded for each call; lazy-cell: traced for the witnesses."""
        if mode not in ("column", "cell", "lazy-cell"):
            raise ValueError(f"no such mode: {mode}")
        self.measures, self.mode = list(measures), mode
        for m in self.measures:
            m.recording = mode == "cell"

    def disable_udf_aware(self) -> None:
        for m in self.measures:
            m.recording = False
        self.measures = []

    # ---- capture

    def graph(self, df: DataFrame) -> CaptureGraph | None:
        """What capture stored for this query; None where it runs uncaptured (a bare LIMIT, a command, capture off)."""
        if id(df) not in self._graphs:
            try:
                got = Rewriter(self.spark, self.strict, self.influence_on, self.focus, self.storage).capture(df) if self.capturing else None
            except NotCaptured:
                got = None
            self._graphs[id(df)] = (df, got)
        return self._graphs[id(df)][1]

    def result(self, df: DataFrame, ident: str = "__id") -> DataFrame:
        """The query's rows with their ids in a last column."""
        g = self.graph(df)
        if g is None:
            raise ValueError("the query is not captured")
        return g.result.select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(g.names)], F.col(g.ident).alias(ident))

    def collect_with_lineage(self, df: DataFrame) -> list[tuple[Row, int | None]]:
        g = self.graph(df)
        if g is None:
            return [(r, None) for r in df.collect()]
        make = Row(*g.names)
        while g.apart:
            g.apart.pop().write.format("noop").mode("overwrite").save()  # fills the stored table
        return [(make(*r[: len(g.names)]), r[-1]) for r in g.result.select(*[f"__c{i}" for i in range(len(g.names))], g.ident).collect()]

    def result_ids(self, df: DataFrame) -> list[int]:
        return [i for _, i in self.collect_with_lineage(df)]

    # ---- trace

    def trace(self, df: DataFrame, output_ids: Iterable[int] | DataFrame, limit: int = 0) -> Cursor:
        """A cursor at the result. output_ids: a list, or a table with one column id. limit: ids that a hop may fetch, see Cursor."""
        g = self.graph(df)
        if g is None:
            return Cursor(CaptureGraph(released=True), None, [], session=self)
        if not isinstance(output_ids, DataFrame):
            output_ids = [int(i) for i in output_ids if i is not None]
        return Cursor(g, g.level, output_ids, (), limit, self)

    def trace_where(self, df: DataFrame, predicate: str, limit: int = 0) -> Cursor:
        """A cursor at the result rows that satisfy a predicate, without a list of ids."""
        return self.trace(df, self.result(df, "id").filter(predicate).select("id"), limit)

    def backward(self, df: DataFrame, output_ids: Iterable[int]) -> list[int]:
        return self.trace(df, output_ids).to_scan().ids

    def show_inputs(self, df: DataFrame, input_ids: Sequence[int]) -> list[Row]:
        """Source rows by id, for queries with one scan."""
        scans = [x for x in self.graph(df).levels() if x.kind == "scan"]
        if len(scans) != 1:
            raise ValueError(f"the query has {len(scans)} scans; use a cursor")
        return scans[0].source.rows(list(input_ids), prune=self.prune).collect()

    def trace_all_sources(self, df: DataFrame, output_ids: Iterable[int]) -> list[SourceWitnesses]:
        return self.trace(df, output_ids).show_all_sources()

    def release_lineage(self, df: DataFrame) -> None:
        """Drops what was stored; a later trace finds nothing."""
        g = self.graph(df)
        if g is not None and not g.released:
            for s in g.stored:
                s.unpersist()
            g.released = True

    def release_all(self) -> None:
        """Drops what was stored for every query, and forgets the queries."""
        for df, g in list(self._graphs.values()):
            if g is not None:
                self.release_lineage(df)
        self._graphs.clear()

    def lineage_size(self, df: DataFrame) -> tuple[int, int]:
        """Bytes in memory and on disk of what is stored."""
        g = self.graph(df)
        if g is None or g.released:
            return 0, 0
        wanted = set()
        for s in g.stored:
            plan = self.spark._jsparkSession.sharedState().cacheManager().lookupCachedData(s._jdf)
            if plan.isDefined():
                wanted.add(plan.get().cachedRepresentation().cacheBuilder().cachedColumnBuffers().id())
        infos = [i for i in self.spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.id() in wanted]
        return sum(i.memSize() for i in infos), sum(i.diskSize() for i in infos)

    # ---- what UDFs read

    def annotated(self, cursor: Cursor, full: bool) -> list[dict]:
        """The witnesses as dicts, with what the UDFs read; rows that no traced call read have no such keys."""
        most = int(self.spark.conf.get("spark.whence.lazyCellDriverMax", os.environ.get("LAZY_CELL_DRIVER_MAX", "50000")))
        if self.mode == "lazy-cell" and cursor.at_most(most):
            rows = [r.asDict(True) for r in cursor.witnesses(full).collect()]
            mine = [(m.params, m.fn, trace(m.fn)) for m in self.measures if rows and set(m.params) <= set(rows[0])]
            for r in rows:
                _udf.annotate(r, [_udf.traced_call(fn, params, r, traced) for params, fn, traced in mine])
            return rows
        rows = [r.asDict(True) for r in self.annotations(cursor, full).collect()]
        return [{k: v for k, v in r.items() if k not in _udf.READS or r["_regime"] is not None} for r in rows]

    def annotations(self, cursor: Cursor, full: bool = False) -> DataFrame:
        """The witnesses as a table, with _data and _control (names of fields that the UDFs read) and _regime; null where no traced call is known."""
        if self.mode == "cell":
            return self._cells(cursor, full)
        rows = cursor.witnesses(full)
        if self.mode == "lazy-cell":
            return self._lazy(rows)
        found = [p for m in self.measures if set((p := column_provenance(m.fn))[0]) | set(p[1]) <= set(rows.columns)]
        one: dict = {}
        _udf.annotate(one, found)
        names = lambda c: F.array(*map(F.lit, one[c])).cast("array<string>") if one else F.lit(None).cast("array<string>")
        return rows.select("*", names("_data").alias("_data"), names("_control").alias("_control"), F.lit(one.get("_regime")).cast("string").alias("_regime"))

    def _cells(self, cursor: Cursor, full: bool) -> DataFrame:
        """Joins the codes that capture stored; several calls on a record add up."""
        rows, found = cursor.witnesses(full, keep_id="__id"), None
        for level in cursor.graph.levels():
            if level is cursor.level and level.code_table is not None:
                for m in self.measures:
                    if m.code_name in level.codes:
                        ident, code = level.codes[m.code_name]
                        data, control, regime = _udf.reads_of_code(F.col("__code"), m.params)
                        t = level.code_table.select(F.col(ident).alias("__id"), F.col(code).alias("__code")).filter("__code is not null")
                        t = t.join(cursor.frontier.withColumnRenamed("id", "__id"), "__id", "left_semi").distinct().select("__id", data.alias("d"), control.alias("c"), regime.alias("r"))
                        found = t if found is None else found.unionByName(t)
        if found is None:
            return rows.drop("__id").select("*", *[F.lit(None).cast("array<string>").alias(c) for c in _udf.READS[:2]], F.lit(None).cast("string").alias("_regime"))
        all_of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))  # noqa: E731  a set of few masks for each record
        regime = F.element_at(F.array(*map(F.lit, REGIMES)), F.max("r") + 1)
        found = found.groupBy("__id").agg(all_of("d").alias("_data"), all_of("c").alias("_control"), regime.alias("_regime"))
        return rows.join(found, "__id", "left").drop("__id")

    def _lazy(self, rows: DataFrame) -> DataFrame:
        """Traces the calls again, for the witnesses only, in batches on the cluster."""
        jobs = [(m.fn, m.params) for m in self.measures if set(m.params) <= set(rows.columns)]
        none = [F.lit(None).cast("array<string>").alias(c) for c in _udf.READS[:2]]
        out = rows.select("*", *none, F.lit(None).cast("string").alias("_regime")).schema
        names = rows.columns

        def run(batches):
            import pyarrow as pa

            made = [(fn, params, trace(fn)) for fn, params in jobs]
            kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            for b in batches:
                found = [{} for _ in range(b.num_rows)]
                if made:
                    for got, r in zip(found, b.to_pylist(), strict=True):
                        _udf.annotate(got, [_udf.traced_call(fn, params, r, traced) for fn, params, traced in made])
                more = [pa.array([x.get(c) for x in found], k) for c, k in zip(_udf.READS, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, *_udf.READS])

        return rows.mapInArrow(run, out)
