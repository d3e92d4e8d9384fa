"""A thin bridge to Catalyst's logical plans from Python."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.classic.column import Column as ClassicColumn


class UnsupportedOperatorError(NotImplementedError):
    """A plan holds an operator whose lineage is not vouched for."""

    def __init__(self, node: str, why: str = ""):
        super().__init__(f"no lineage for operator {node}{': ' + why if why else ''}; call disable_capture() to run the query without lineage")
        self.node = node


class Bridge:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.logical = self.jvm.org.apache.spark.sql.catalyst.plans.logical
        self.expressions = self.jvm.org.apache.spark.sql.catalyst.expressions

    def seq(self, items: list) -> Any:
        return self.jvm.org.apache.spark.api.python.PythonUtils.toSeq(items)

    @staticmethod
    def items(jseq: Any) -> list:
        return [jseq.apply(i) for i in range(jseq.size())]

    @staticmethod
    def kind(node: Any) -> str:
        return node.getClass().getSimpleName().rstrip("$")

    def optimized(self, df: DataFrame) -> Any:
        return df._jdf.queryExecution().optimizedPlan()

    @staticmethod
    def plan(df: DataFrame) -> Any:
        return df._jdf.queryExecution().analyzed()

    def of_rows(self, plan: Any) -> DataFrame:
        return DataFrame(self.jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)

    def column(self, expression: Any) -> Column:
        return ClassicColumn(self.jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))

    def children(self, node: Any) -> list:
        return self.items(node.children())

    def output(self, node: Any) -> list:
        return self.items(node.output())

    def with_children(self, node: Any, plans: list) -> Any:
        return node.withNewChildren(self.seq(plans))

    def project(self, expressions: list, plan: Any) -> Any:
        return self.logical.Project(self.seq(expressions), plan)

    def alias(self, expression: Any, name: str) -> Any:
        nothing = self.jvm.scala.Option.empty()
        return self.expressions.Alias(expression, name, self.expressions.NamedExpression.newExprId(), self.seq([]), nothing, self.seq([]))

    @staticmethod
    def expr_id(attribute: Any) -> int:
        return attribute.exprId().id()

    def select(self, plan: Any, wanted: list, extras: list[str]) -> Any:
        """A projection of `plan` to the attributes `wanted` (by id) and the columns named `extras`."""
        out = self.output(plan)
        by_id = {self.expr_id(a): a for a in out}
        by_name = {a.name(): a for a in out}
        return self.project([by_id[self.expr_id(a)] for a in wanted] + [by_name[n] for n in extras], plan)

    def walk(self, node: Any) -> list:
        """The node and all below it."""
        return [node, *[x for c in self.children(node) for x in self.walk(c)]]

    def references(self, node: Any) -> set[int]:
        return {self.expr_id(a) for a in self.items(node.references().toSeq())}

    def aggregates(self, expression: Any) -> list:
        """AggregateExpression nodes inside an expression."""
        if self.kind(expression) == "AggregateExpression":
            return [expression]
        return [x for c in self.items(expression.children()) for x in self.aggregates(c)]

    def equi_keys(self, join: Any) -> tuple[list, list] | None:
        got = self.jvm.org.apache.spark.sql.catalyst.planning.ExtractEquiJoinKeys.unapply(join)
        if got.isEmpty():
            return None
        found = got.get()
        return self.items(found._2()), self.items(found._3())
