"""The graph that capture leaves behind: levels, the tables that link their ids, and what to release."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..sources.scan import Source


@dataclass(eq=False)
class Slot:
    """One aggregate of a level: its function, the columns of the result it feeds, and the column of its inputs."""

    function: str
    names: list[str]
    column: str
    arguments: list[float] = field(default_factory=list)


@dataclass(eq=False)
class Level:
    """One step of a walk.

    kind: scan, keyed (a group's members), peers (rows of a window's partition), join, semi, union or top.
    table: holds `out` (ids of this level) and `ins` (ids of each branch's level), set when the job's boundary is stored; `later` makes it when it is first asked for, so that the job
    does not wait for plans that only a trace needs.
    """

    kind: str
    branches: list[Level] = field(default_factory=list)
    out: str = ""
    ins: list[str] = field(default_factory=list)
    table: DataFrame | None = None
    source: Source | None = None
    slots: list[Slot] = field(default_factory=list)
    side: DataFrame | None = None  # semi joins: keys of the right side
    keys: tuple[str, str] = ("", "")
    codes: dict[str, tuple[str, str]] = field(default_factory=dict)  # traced UDF: (id column, code column) of `code_table`
    code_table: DataFrame | None = None
    later: Callable[[], DataFrame] | None = None

    def linked(self) -> DataFrame:
        """The table, made if need be."""
        if self.table is None and self.later is not None:
            self.table, self.later = self.later(), None
        return self.table

    def pairs(self, branch: int) -> DataFrame:
        """out, in: every link from this level to a branch's level."""
        from pyspark.sql import functions as F

        if not 0 <= branch < len(self.branches):
            raise IndexError(f"level {self.kind} has {len(self.branches)} branches")
        t = self.linked()
        if self.kind == "peers":
            left = t.select(F.col(self.out).alias("out"), F.col(self.keys[0]).alias("k"))
            return left.join(t.select(F.col(self.ins[0]).alias("in"), F.col(self.keys[0]).alias("k")), "k").select("out", "in")
        if self.kind == "semi" and branch == 1:
            left = t.select(F.col(self.out).alias("out"), F.col(self.keys[0]).alias("k"))
            return left.join(self.side.select(F.col(self.ins[1]).alias("in"), F.col(self.keys[1]).alias("k")), "k").select("out", "in")
        return t.select(F.col(self.out).alias("out"), F.col(self.ins[branch]).alias("in")).filter("out is not null and `in` is not null")

    def hop(self, wanted: Column | DataFrame, branch: int, forward: bool = False) -> DataFrame:
        """Ids of the branch's level that ids of this level come from, or the other way round; a frontier goes in before peers fan out."""
        from pyspark.sql import functions as F

        a, b = ("in", "out") if forward else ("out", "in")
        if self.kind == "peers" or self.kind == "semi" and branch == 1:
            t = self.linked().select(F.col(self.out).alias("id"), F.col(self.keys[0]).alias("k"))
            o = (self.linked().select(F.col(self.ins[0]).alias("id"), F.col(self.keys[0]).alias("k")) if self.kind == "peers" else self.side.select(F.col(self.ins[1]).alias("id"), F.col(self.keys[1]).alias("k")))
            here, there = (o, t) if forward else (t, o)
            keys = here.join(wanted, "id", "left_semi").select("k").distinct()
            return there.join(keys, "k", "left_semi").select("id").distinct()
        links = self.pairs(branch).withColumnRenamed(a, "id")
        return links.join(wanted, "id", "left_semi").select(F.col(b).alias("id")).distinct()


@dataclass(eq=False)
class CaptureGraph:
    result: DataFrame | None = None
    names: list[str] = field(default_factory=list)
    ident: str = ""
    level: Level | None = None
    stored: list[DataFrame] = field(default_factory=list)
    apart: list[DataFrame] = field(default_factory=list)  # stored tables that the job itself does not read
    released: bool = False

    def levels(self) -> list[Level]:
        out: list[Level] = []

        def visit(x: Level) -> None:
            out.append(x)
            for b in x.branches:
                visit(b)

        if self.level is not None:
            visit(self.level)
        return out

    def path_to(self, target: Level) -> list[tuple[Level, int]]:
        """(level, branch) steps from the result to `target`."""

        def find(x: Level) -> list | None:
            if x is target:
                return []
            for i, b in enumerate(x.branches):
                if (rest := find(b)) is not None:
                    return [(x, i), *rest]
            return None

        got = find(self.level)
        if got is None:
            raise KeyError("no such level")
        return got
