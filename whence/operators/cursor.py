"""Cursors: positions in a walk from an output back to the source rows, and forward again."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.influence import Influence, has_closed_form, influences
from ..plans.graph import CaptureGraph, Level

#: Ids up to which `write_witnesses_auto` holds frontiers on the driver.
DRIVER_IDS = 500_000


class SourceWitnesses(NamedTuple):
    """The witnesses in one source table."""

    path: str | None
    rows: list
    schema: StructType


class Cursor:
    """A set of ids at one level of a captured query.

    A frontier is the list that the walk started from, or a table: hops add semi joins to one plan, and nothing is fetched until rows or `ids` are asked for. With a `limit`, a frontier of at most so many ids is
    fetched at each hop (their number is checked first).
    """

    def __init__(self, graph: CaptureGraph, level: Level | None, ids: Iterable[int] | DataFrame, path: tuple = (), limit: int = 0, session: Any = None):
        self.graph, self.level, self.path, self.limit, self.session = graph, level, path, limit, session
        self._table = ids if isinstance(ids, DataFrame) else None
        self._ids = None if isinstance(ids, DataFrame) else sorted(set(ids))

    def _spark(self):
        return self.graph.result.sparkSession

    def _moved(self, level: Level, found: DataFrame, path: tuple) -> Cursor:
        if not self.limit:
            return Cursor(self.graph, level, found, path, 0, self.session)
        got = found.limit(self.limit + 1).collect()
        ids = found if len(got) > self.limit else [r["id"] for r in got]
        return Cursor(self.graph, level, ids, path, self.limit, self.session)

    def at_most(self, n: int) -> bool:
        """Whether there are at most n ids."""
        return (len(self._ids) if self._ids is not None else self._table.limit(n + 1).count()) <= n

    @property
    def frontier(self) -> DataFrame:
        """The ids as a table with one column, id."""
        if self._table is None:
            return self._spark().createDataFrame([(i,) for i in self._ids], "id long")
        return self._table

    @property
    def ids(self) -> list[int]:
        if self.graph.released:
            return []
        if self._ids is None:
            self._ids = sorted(r["id"] for r in self._table.collect())
        return self._ids

    @property
    def at_scan(self) -> bool:
        return self.level is not None and self.level.kind == "scan"

    def go_back(self, branch: int = 0) -> Cursor:
        """One level back, along one input of a join or union."""
        if self.level is None or self.at_scan:
            raise ValueError("the walk is at a source: nothing lies further back")
        if not 0 <= branch < len(self.level.branches):
            raise IndexError(f"the level has {len(self.level.branches)} branches")
        path = (*self.path, (self, branch))
        if self.graph.released:
            return Cursor(self.graph, self.level.branches[branch], [], path, self.limit, self.session)
        return self._moved(self.level.branches[branch], self.level.hop(self.frontier, branch), path)

    def go_next(self) -> Cursor:
        """One level forward along the path taken: all ids there that come from these."""
        if not self.path:
            raise ValueError("the walk is at the result: nothing lies further on")
        before, branch = self.path[-1]
        return self._moved(before.level, before.level.hop(self.frontier, branch, forward=True), self.path[:-1])

    def to_scan(self, branch: int = 0) -> Cursor:
        at = self
        while not at.at_scan:
            at = at.go_back(min(branch, len(at.level.branches) - 1))
        return at

    def sources(self) -> list[Cursor]:
        """A cursor at every scan that lies behind this position."""
        if self.level is None:
            return []
        if self.at_scan:
            return [self]
        return [c for b in range(len(self.level.branches)) for c in self.go_back(b).sources()]

    def witnesses(self, full: bool = False, keep_id: str | None = None) -> DataFrame:
        """The source rows of a cursor at a scan, as a table: the columns that the query used, or all."""
        if not self.at_scan:
            raise ValueError("rows can be shown at a source only; go back first")
        prune = self.session is None or self.session.prune
        known = self._table if self._ids is None else self._ids
        if self.graph.released:
            known = []
        return self.level.source.rows(known, full, prune, keep_id)

    def show(self, full: bool = False) -> list[dict]:
        """The source rows as dicts; with traced UDFs also what they read (`_data`, `_control`, `_regime`)."""
        if self.session is not None and self.session.measures:
            return self.session.annotated(self, full)
        return [r.asDict(True) for r in self.witnesses(full).collect()]

    def annotations(self, full: bool = False) -> DataFrame:
        """The source rows as a table; with traced UDFs also what they read (`_data`, `_control`, `_regime`)."""
        if self.session is not None and self.session.measures:
            return self.session.annotations(self, full)
        return self.witnesses(full)

    def show_all_sources(self, full: bool = False) -> list[SourceWitnesses]:
        out = []
        for c in self.sources():
            w = c.witnesses(full)
            out.append(SourceWitnesses(c.level.source.path, w.collect(), w.schema))
        return out

    # ---- writing witnesses

    def _lines(self) -> DataFrame:
        w = self.witnesses()
        return w.select(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in w.columns]).alias("value"))

    def write_witnesses(self, path: str, branch: int = 0) -> int:
        """Writes the rows as text, columns joined by '|'; the number of rows."""
        lines = self.to_scan(branch)._lines().persist()
        n = lines.count()
        lines.write.text(path)
        lines.unpersist()
        return n

    def write_witnesses_distributed(self, path: str, parallelism: int = 0, branch: int = 0) -> int:
        """The same with a frontier that never leaves the cluster."""
        far = Cursor(self.graph, self.level, self.frontier, self.path, 0, self.session).to_scan(branch)
        lines = far._lines()
        lines = (lines.repartition(parallelism) if parallelism else lines).persist()
        n = lines.count()
        lines.write.text(path)
        lines.unpersist()
        return n

    def write_witnesses_auto(self, path: str, threshold: int = DRIVER_IDS) -> int:
        """On the driver's lists as long as each hop has at most `threshold` ids, distributed from there on."""
        return Cursor(self.graph, self.level, self._table if self._ids is None else self._ids, self.path, threshold, self.session).write_witnesses(path)

    # ---- influence

    def influence_table(self, column: str | None = None, agg: str | None = None) -> DataFrame:
        """out, in, value, influence: every record of the traced outputs' groups, scored for the aggregate that made `column`."""
        level, slot = self._slot(column)
        start = self.path[0][0] if self.path else self
        at = start
        for _, branch in self._steps(start.level, level):
            at = at.go_back(branch)
        name = agg or self._named(slot)
        rows = level.linked().select(F.col(level.out).alias("out"), F.col(level.ins[0]).alias("in"), F.col(slot.column).alias("value"))
        rows = rows.join(at.frontier.withColumnRenamed("id", "out"), "out", "left_semi")
        fallback = self.session.fallback if self.session is not None else None
        if agg is None and fallback is not None and not has_closed_form(name):
            name = fallback
        return influences(rows, name)

    def influence(self, column: str | None = None, agg: str | None = None) -> Influence:
        """Scores of the records one level below the aggregate that made `column` (the outermost one if not named)."""
        table = self.influence_table(column, agg)
        level, slot = self._slot(column)
        fallback = self.session.fallback if self.session is not None else None
        name = agg or (fallback if fallback is not None and not has_closed_form(self._named(slot)) else self._named(slot))
        return Influence({r["in"]: r["influence"] for r in table.select("in", "influence").collect()}, name)

    @staticmethod
    def _steps(top: Level, target: Level) -> Sequence[tuple[Level, int]]:
        return CaptureGraph(level=top).path_to(target)

    @staticmethod
    def _named(slot) -> str:
        from ..functions.influence import ALSO

        name = ALSO.get(slot.function, slot.function)
        return f"percentile:{slot.arguments[0]}" if name == "percentile" else name

    def _slot(self, column: str | None):
        levels = [x for x in self.graph.levels() if x.kind == "keyed"]
        if not any(x.slots for x in levels):
            raise ValueError("no contributions were captured: call enable_influence() before the job runs")
        for x in levels:
            for s in x.slots:
                if column is None or column in s.names:
                    return x, s
        raise KeyError(f"no aggregate made a column {column!r}")
