"""Capture: a query's optimized plan with ids carried through it, and the graph of levels that link them.

Ids travel as ordinary columns. At every aggregate, window and right side of a semi join (the places where rows lose their identity) the
columns that the rest of the job needs are stored once, with their ids, and the job goes on from the stored table: it runs once, and the stored
tables are the lineage. Ids of groups, and what each record contributes, are expressions over the stored columns, taken when a trace asks for them. Ids of groups and joined rows are
hashes of keys and ids, so recomputing a lost part of a stored table yields the same ids. They have 64 bits: among n groups or joined rows of one query n**2 / 2**65 pairs are expected to share an id
(3e-8 for a million, 3 for ten thousand million), and a shared id adds the other group's witnesses to a trace. Ids of Parquet rows share none.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import Source, parquet_ident
from .catalyst import Bridge, UnsupportedOperatorError
from .graph import CaptureGraph, Level, Slot

#: Names of result columns that traced UDFs add to carry what each call read.
CODE_FIELD = "__prov"


@dataclass
class State:
    """A rewritten plan: its rows, the name of the id column, its level, columns that await the next stored table, and levels that do."""

    df: DataFrame
    ident: str
    level: Level
    trail: list[str] = field(default_factory=list)
    pending: list[Level] = field(default_factory=list)

    @property
    def extras(self) -> list[str]:
        return list(dict.fromkeys([self.ident, *self.trail]))


class Later:
    """A table that is made once, when it is first asked for."""

    def __init__(self, make: Callable[[], DataFrame]):
        self.make, self.got = make, None

    def __call__(self) -> DataFrame:
        if self.got is None:
            self.got = self.make()
        return self.got


class NotCaptured(Exception):
    """The query runs without capture, without an error."""


class Rewriter:
    def __init__(self, spark: SparkSession, strict: bool = True, influence: bool = False, focus: str = "", storage: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.b, self.strict, self.influence, self.focus, self.storage = Bridge(spark), strict, influence, focus, storage
        self.graph, self.number = CaptureGraph(), count()
        self.used: set[int] = set()

    # ---- entry

    def capture(self, df: DataFrame) -> CaptureGraph:
        plan = self.b.optimized(df)
        kinds = [self.b.kind(n) for n in self.b.walk(plan)]
        if any(k.endswith("Command") for k in kinds):
            raise NotCaptured
        for n in self.b.walk(plan):
            self.used |= self.b.references(n)
        self.used |= {self.b.expr_id(a) for a in self.b.output(plan)}
        state = self.walk(plan)
        out = self.b.output(plan)
        final = self.b.of_rows(self.b.select(self.b.plan(state.df), out, state.extras))
        names = [a.name() for a in out]
        state.df = final.toDF(*[f"__c{i}" for i in range(len(names))], *state.extras)
        stored = self.store(state, state.df)
        self.graph.result, self.graph.names, self.graph.ident, self.graph.level = stored, names, state.ident, state.level
        return self.graph

    def store(self, state: State, df: DataFrame) -> DataFrame:
        """Stores rows; the levels that wait for a table take this one."""
        df = df.persist(self.storage)
        self.graph.stored.append(df)
        for level in state.pending:
            if level.table is None:
                level.table = df
            if level.codes and level.code_table is None:
                level.code_table = df
        return df

    def name(self, what: str) -> str:
        return f"__w{what}{next(self.number)}"

    def walk(self, node: Any) -> State:
        kind = self.b.kind(node)
        handler: Callable[[Any], State] | None = getattr(self, f"on_{kind}", None)
        if handler is None:
            raise UnsupportedOperatorError(kind)
        return handler(node)

    def over(self, node: Any, state: State) -> State:
        """The node above a rewritten child; its own attributes first, extras after them."""
        plan = self.b.with_children(node, [self.b.plan(state.df)])
        state.df = self.b.of_rows(self.b.select(plan, self.b.output(node), state.extras))
        return state

    # ---- sources

    def _source(self, leaf: Any, ident: Column, files: dict | None, path: str | None, by_file: bool = False) -> State:
        base = self.b.of_rows(leaf)
        used = [a.name() for a in self.b.output(leaf) if self.b.expr_id(a) in self.used]
        name = self.name("s")
        level = Level("scan", source=Source(base, ident, used, path, files, by_file))
        return State(base.select("*", ident.alias(name)), name, level, [], [level])

    def on_LogicalRelation(self, leaf: Any) -> State:
        relation = leaf.relation()
        if self.b.kind(relation) != "HadoopFsRelation":
            raise UnsupportedOperatorError("LogicalRelation", self.b.kind(relation))
        roots = self.b.items(relation.location().rootPaths())
        path = roots[0].toString() if roots else None
        base = self.b.of_rows(leaf)
        if "parquet" in relation.fileFormat().toString().lower():
            ident, files = parquet_ident(base)
            return self._source(leaf, ident, files, path, True)
        return self._source(leaf, F.monotonically_increasing_id(), None, path)

    def _numbered(self, leaf: Any) -> State:
        return self._source(leaf, F.monotonically_increasing_id(), None, None)

    on_InMemoryRelation = on_LocalRelation = on_OneRowRelation = _numbered

    def on_LogicalRDD(self, leaf: Any) -> State:
        return self._numbered(leaf)

    def on_Range(self, leaf: Any) -> State:
        if self.strict:
            raise UnsupportedOperatorError("Range")
        return self._numbered(leaf)

    # ---- operators that keep rows apart

    def on_Filter(self, node: Any) -> State:
        return self.over(node, self.walk(node.child()))

    on_Repartition = on_RepartitionByExpression = on_RebalancePartitions = on_SubqueryAlias = on_Generate = on_Filter

    def on_Project(self, node: Any) -> State:
        state = self.walk(node.child())
        plan = self.b.plan(state.df)
        by_name = {a.name(): a for a in self.b.output(plan)}
        state.df = self.b.of_rows(self.b.project(self.b.items(node.projectList()) + [by_name[n] for n in state.extras], plan))
        return state

    def on_BatchEvalPython(self, node: Any) -> State:
        state = self.over(node, self.walk(node.child()))
        for a in self.b.items(node.resultAttrs()):
            kind = a.dataType()
            if self.b.kind(kind) == "StructType" and CODE_FIELD in list(kind.fieldNames()):
                u = self.b.items(node.udfs())[[self.b.expr_id(x) for x in self.b.items(node.resultAttrs())].index(self.b.expr_id(a))]
                code = self.name("p")
                state.df = state.df.select("*", self.b.column(a).getField(CODE_FIELD).alias(code))
                state.trail = [*state.trail, state.ident, code]
                state.level.codes[u.name()] = (state.ident, code)
                if state.level not in state.pending:
                    state.pending = [*state.pending, state.level]
                    state.level.code_table = None
        return state

    on_ArrowEvalPython = on_BatchEvalPython

    def on_Expand(self, node: Any) -> State:
        state = self.walk(node.child())
        plan = self.b.plan(state.df)
        by_name = {a.name(): a for a in self.b.output(plan)}
        mine = [by_name[n] for n in state.extras]
        rows = [self.b.seq(self.b.items(p) + mine) for p in self.b.items(node.projections())]
        out = self.b.output(node) + [a.newInstance() for a in mine]
        state.df = self.b.of_rows(self.b.logical.Expand(self.b.seq(rows), self.b.seq(out), plan))
        return state

    def on_Sort(self, node: Any) -> State:
        if self.strict and getattr(node, "global")():
            raise UnsupportedOperatorError("Sort", "a global sort")
        return self.over(node, self.walk(node.child()))

    def on_GlobalLimit(self, node: Any) -> State:
        chain, at = [node], node.child()
        while self.b.kind(at) in ("LocalLimit", "Project"):
            chain.append(at)
            at = at.child()
        if self.b.kind(at) != "Sort":
            raise NotCaptured
        chain.append(at)
        state = self.walk(at.child())
        for n in reversed(chain):
            if self.b.kind(n) == "Project":
                plan = self.b.plan(state.df)
                by_name = {a.name(): a for a in self.b.output(plan)}
                state.df = self.b.of_rows(self.b.project(self.b.items(n.projectList()) + [by_name[x] for x in state.extras], plan))
            else:
                state = self.over(n, state)
        level = Level("top", [state.level], state.ident, [state.ident])
        return State(state.df, state.ident, level, state.trail, [*state.pending, level])

    def on_LocalLimit(self, node: Any) -> State:
        raise NotCaptured

    # ---- operators that bring rows together

    def _hashed(self, columns: list[Column], kinds: list[str], salt: int) -> Column:
        """One id for a list of keys: nulls differ from values, negative zero does not from zero."""
        parts: list[Column] = [F.lit(salt)]
        for c, kind in zip(columns, kinds, strict=True):
            if kind in ("double", "float"):
                c = c + F.lit(0.0)
            parts += [c, c.isNull()]
        return F.xxhash64(*parts)

    def on_Aggregate(self, node: Any) -> State:
        state, salt = self.walk(node.child()), next(self.number)
        keys = self.b.items(node.groupingExpressions())
        kinds = [k.dataType().simpleString() for k in keys]
        out, plan = self.name("g"), self.b.plan(state.df)
        wanted = [a for a in self.b.output(plan) if self.b.expr_id(a) in self.b.references(node)]
        flow = self.b.of_rows(self.b.select(plan, wanted, state.extras))
        members = [self._hashed([self.b.column(k) for k in keys], kinds, salt).alias(out)]
        slots, distinct = self._slots(node, members)
        level = Level("keyed", [state.level], out, [state.ident], slots=slots)
        if distinct is not None:
            inner = self.name("d")
            members.append(self._hashed([self.b.column(k) for k in [*keys, *distinct]], kinds + [x.dataType().simpleString() for x in distinct], salt + 1_000_003).alias(inner))
        lineage = [*state.extras, out, *[s.column for s in slots], *([inner] if distinct is not None else [])]
        focused = self._focus(flow)
        if focused is None:  # hashes and contributions are taken from the stored columns when a trace asks for them
            inputs = self.store(state, flow)
            made = Later(lambda: inputs.select("*", *members).select(*lineage))
        else:  # the job's rows are not stored, only the lineage of the named groups
            stored = self.store(state, focused.select("*", *members).select(*lineage))
            self.graph.apart.append(stored)
            inputs, made = flow, Later(lambda: stored)
        level.later = made
        if distinct is not None:
            values = Level("keyed", [state.level], inner, [state.ident], later=made)
            level.branches, level.ins = [values], [inner]
            level.later = lambda: made().select(out, inner, *[s.column for s in slots]).distinct()
        shown = [self.name("k") for _ in keys]
        plus = [self.b.alias(k, n) for k, n in zip(keys, shown, strict=True)]
        agg = self.b.logical.Aggregate(node.groupingExpressions(), self.b.seq(self.b.items(node.aggregateExpressions()) + plus), self.b.plan(inputs), node.hint())
        done = self.b.of_rows(agg)
        done = done.select("*", self._hashed([F.col(n) for n in shown], kinds, salt).alias(out))
        df = self.b.of_rows(self.b.select(self.b.plan(done), self.b.output(node), [out]))
        return State(df, out, level)

    def _slots(self, node: Any, members: list[Column]) -> tuple[list[Slot], list | None]:
        """An aggregate's inputs as columns of doubles (null where a filter or the value is), and the arguments of a DISTINCT."""
        slots, distinct = [], None
        for named in self.b.items(node.aggregateExpressions()):
            for a in self.b.aggregates(named):
                fn = a.aggregateFunction()
                inputs = self.b.items(fn.children())
                if a.isDistinct():
                    distinct = distinct or inputs
                if not self.influence:
                    continue
                column, name = self.name("c"), fn.prettyName()
                kind = inputs[0].dataType().simpleString() if inputs else "int"
                value = self.b.column(inputs[0]) if inputs else F.lit(1)
                plain = kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")
                if name == "count":
                    value = F.when(F.array_max(F.array(*[self.b.column(x).isNull() for x in inputs])), None).otherwise(F.lit(1.0)) if inputs else F.lit(1.0)
                else:
                    value = value.cast("double") if plain else F.lit(None).cast("double")
                if a.filter().isDefined():
                    value = F.when(self.b.column(a.filter().get()), value)
                members.append(value.alias(column))
                more = [float(x.value()) for x in inputs[1:] if self.b.kind(x) == "Literal" and isinstance(x.value(), (int, float))]
                if name.startswith("percentile") and not more:
                    more = [float(x.eval(None)) for x in inputs[1:2] if x.foldable() and isinstance(x.eval(None), (int, float))]
                slots.append(Slot(name, [named.name()], column, more))
        return slots, distinct

    def _focus(self, seen: DataFrame) -> DataFrame | None:
        if not self.focus:
            return None
        try:
            got = seen.filter(self.focus)
            got.schema  # noqa: B018  resolves the predicate
            return got
        except AnalysisException as e:
            if "UNRESOLVED_COLUMN" not in str(e):
                raise
            warnings.warn(f"the focus {self.focus!r} names columns that an aggregate's input does not have: its lineage is captured whole", stacklevel=2)
            return None

    def on_WindowGroupLimit(self, node: Any) -> State:
        """Rows that a filter on a rank above the window drops early: the window and its filter do the same without, and all rows stay peers."""
        return self.walk(node.child())

    def on_Window(self, node: Any) -> State:
        state, salt = self.walk(node.child()), next(self.number)
        spec = self.b.items(node.partitionSpec())
        key = self.name("w")
        part = self._hashed([self.b.column(k) for k in spec], [k.dataType().simpleString() for k in spec], salt)
        stored = self.store(state, state.df.select("*", part.alias(key)))
        plan = self.b.with_children(node, [self.b.plan(stored)])
        df = self.b.of_rows(self.b.select(plan, self.b.output(node), [state.ident]))
        level = Level("peers", [state.level], state.ident, [state.ident], stored, keys=(key, key))
        return State(df, state.ident, level)

    def on_Join(self, node: Any) -> State:
        how = node.joinType().toString()
        keys = self.b.equi_keys(node)
        if how == "Cross" or how.startswith("Existence") or (keys is None and (self.strict or how != "Inner")):
            raise UnsupportedOperatorError("Join", f"{how} without equal keys" if keys is None else how)
        left, right = self.walk(node.left()), self.walk(node.right())
        if how in ("LeftSemi", "LeftAnti"):
            return self._semi(node, how, left, right, keys)
        plan = self.b.with_children(node, [self.b.plan(left.df), self.b.plan(right.df)])
        trail = list(dict.fromkeys([*left.extras, *right.extras]))
        df = self.b.of_rows(self.b.select(plan, self.b.output(node), trail))
        ident = self.name("j")
        a, b = F.col(left.ident), F.col(right.ident)
        df = df.select("*", F.xxhash64(F.lit(next(self.number)), a, a.isNull(), b, b.isNull()).alias(ident))
        level = Level("join", [left.level, right.level], ident, [left.ident, right.ident])
        return State(df, ident, level, trail, [*left.pending, *right.pending, level])

    def _semi(self, node: Any, how: str, left: State, right: State, keys: tuple[list, list]) -> State:
        mine, other, salt = self.name("l"), self.name("r"), next(self.number)
        kinds = [k.dataType().simpleString() for k in keys[0]]
        stored = self.store(right, right.df.select("*", self._hashed([self.b.column(k) for k in keys[1]], kinds, salt).alias(other)))
        marked = left.df.select("*", self._hashed([self.b.column(k) for k in keys[0]], kinds, salt).alias(mine))
        plan = self.b.with_children(node, [self.b.plan(marked), self.b.plan(stored)])
        trail = list(dict.fromkeys([*left.extras, mine]))
        df = self.b.of_rows(self.b.select(plan, self.b.output(node), trail))
        side = stored.limit(0) if how == "LeftAnti" else stored  # what is absent has no witness
        level = Level("semi", [left.level, right.level], left.ident, [left.ident, right.ident], side=side, keys=(mine, other))
        return State(df, left.ident, level, trail, [*left.pending, level])

    def on_Union(self, node: Any) -> State:
        states = [self.walk(c) for c in self.b.children(node)]
        ident, branch, came = self.name("u"), self.name("b"), [self.name("i") for _ in states]
        every = list(dict.fromkeys([n for s in states for n in s.extras]))
        types = {n: dict(s.df.dtypes)[n] for s in states for n in s.extras}
        plans, salt = [], next(self.number)
        for i, s in enumerate(states):
            cols = self.b.output(self.b.children(node)[i])
            df = self.b.of_rows(self.b.select(self.b.plan(s.df), cols, s.extras))
            has = set(s.extras)
            more = [(F.col(n) if n in has else F.lit(None).cast(types[n])).alias(f"{n}_") for n in every]
            more += [(F.col(s.ident) if i == j else F.lit(None).cast("bigint")).alias(c) for j, c in enumerate(came)]
            more += [F.lit(i).alias(branch), F.xxhash64(F.lit(salt), F.lit(i), F.col(s.ident)).alias(ident)]
            df = df.select(*[self.b.column(a) for a in cols], *more)
            plans.append(self.b.plan(df))
        plan = self.b.with_children(node, plans)
        extras = [f"{n}_" for n in every] + came + [branch, ident]
        out = self.b.output(plan)
        width = len(self.b.output(node))
        mine = [a if self.b.expr_id(a) == self.b.expr_id(o) else self._renamed(a, o) for a, o in zip(out[:width], self.b.output(node), strict=True)]
        df = self.b.of_rows(self.b.project(mine + out[width:], plan))
        df = df.select(*[self.b.column(a) for a in self.b.output(self.b.plan(df))[:width]], *[F.col(x).alias(x.removesuffix("_") if x.removesuffix("_") in types else x) for x in extras])
        level = Level("union", [s.level for s in states], ident, came)
        trail = [*every, *came, branch, ident]
        return State(df, ident, level, trail, [*[p for s in states for p in s.pending], level])

    def _renamed(self, a: Any, wanted: Any) -> Any:
        nothing = self.b.jvm.scala.Option.empty()
        return self.b.expressions.Alias(a, wanted.name(), wanted.exprId(), self.b.seq([]), nothing, self.b.seq([]))


for _kind in ("WithCTE", "CTERelationRef", "Sample"):
    assert not hasattr(Rewriter, f"on_{_kind}")  # these are refused
