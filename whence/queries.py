"""Registered queries: each traces, scores or explains an output, and returns plain columns that SQL can check.

Every query has a DuckDB statement over the same tables in `oracle_sql`. Doubles are rounded on both sides. Frontiers are tables throughout: no list of ids is fetched.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.udf import udf
from .operators.cursor import Cursor
from .operators.programs import FAULTY, PROGRAMS, STARS
from .operators.rdd import LineageContext, key_id
from .operators.session import Lineage
from .plans.catalyst import UnsupportedOperatorError
from .sources.tables import table

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
Query = Callable[[SparkSession, str], DataFrame]


def _frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SQL text with {table} for each table."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in NAMES if f"{{{n}}}" in sql})


def _trace(sql: str, where: str, steps: tuple[int, ...], columns: str, strict: bool = True) -> Query:
    """The source rows, some of their columns, that lie `steps` behind the outputs that satisfy `where`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark, strict)
        c: Cursor = t.trace_where(_frame(spark, sf_dir, sql), where)
        for b in steps:
            c = c.go_back(b)
        return c.witnesses(full=True).selectExpr(*[x.strip() for x in columns.split(",")])

    return run


def _influence(sql: str, where: str, column: str, digits: int = 4) -> Query:
    """Sorted scores of the records behind the outputs that satisfy `where`: value and influence."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark)
        t.enable_influence()
        c = t.trace_where(_frame(spark, sf_dir, sql), where)
        return c.influence_table(column).select(F.round("value", digits).alias("value"), F.round("influence", digits).alias("influence"))

    return run


_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _Q[name] = query
    if sql is not None:
        _SQL[name] = sql


def _lines(where: str, columns: str = LINE) -> str:
    return f"SELECT {columns} FROM lineitem WHERE {where}"


# ---- narrow operators and aggregates
_SUM = "select l_returnflag as f, sum(l_quantity) as s from {lineitem} group by l_returnflag"
_add("trace_filter_project", _trace("select l_orderkey, l_quantity * 2 as q from {lineitem} where l_quantity > 45", "q < 96", (), LINE), _lines("l_quantity > 45 and l_quantity * 2 < 96"))
_add("trace_agg_sum", _trace(_SUM, "f = 'R'", (0,), LINE), _lines("l_returnflag = 'R'"))
_add("trace_agg_having", _trace("select l_returnflag as f, l_linestatus as t, sum(l_quantity) as s, count(*) as c from {lineitem} where l_quantity > 5 group by 1, 2 having sum(l_quantity) > 100", "f = 'A' and t = 'F'", (0,), LINE), _lines("l_returnflag = 'A' and l_linestatus = 'F' and l_quantity > 5"))
_add("trace_agg_expr_key", _trace("select lower(l_returnflag) as f, sum(l_quantity + 1) as s from {lineitem} where l_extendedprice > 1000 group by lower(l_returnflag)", "f = 'n'", (0,), LINE), _lines("l_returnflag = 'N' and l_extendedprice > 1000"))
_add("trace_distinct", _trace("select distinct o_orderpriority as p from {orders}", "p = '1-URGENT'", (0,), "o_orderkey, o_custkey, o_totalprice, o_orderpriority"), "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'")


def _shown(full: bool) -> Query:
    """The witnesses of one group as they are shown: the columns that the query used, or every column of the source."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark)
        return t.trace_where(_frame(spark, sf_dir, "select n_regionkey as r, max(n_name) as m from {nation} group by 1"), "r = 2").go_back().witnesses(full)

    return run


_add("trace_used_show", _shown(False), "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
_add("trace_full_show", _shown(True), "SELECT * FROM nation WHERE n_regionkey = 2")
_add("trace_count_distinct", _trace("select l_returnflag as f, count(distinct l_suppkey) as n from {lineitem} group by 1", "f = 'R'", (0, 0), LINE), _lines("l_returnflag = 'R'"))
_add("trace_mixed_distinct", _trace("select l_returnflag as f, count(distinct l_suppkey) as n, sum(l_quantity) as q from {lineitem} group by 1", "f = 'A'", (0, 0), LINE), _lines("l_returnflag = 'A'"))
_GROUPS = "select l_returnflag as f, l_linestatus as t, sum(l_quantity) as s from {{lineitem}} where l_quantity > 30 group by {}"
_add("trace_rollup_total", _trace(_GROUPS.format("rollup(l_returnflag, l_linestatus)"), "f is null and t is null", (0,), LINE), _lines("l_quantity > 30"))
_add("trace_rollup_group", _trace(_GROUPS.format("rollup(l_returnflag, l_linestatus)"), "f = 'R' and t is null", (0,), LINE), _lines("l_quantity > 30 and l_returnflag = 'R'"))
_add("trace_cube", _trace(_GROUPS.format("cube(l_returnflag, l_linestatus)"), "f is null and t = 'O'", (0,), LINE), _lines("l_quantity > 30 and l_linestatus = 'O'"))
_add("trace_grouping_sets", _trace(_GROUPS.format("grouping sets ((l_returnflag), (l_linestatus))"), "f = 'A'", (0,), LINE), _lines("l_quantity > 30 and l_returnflag = 'A'"))
for _name, _call in (("percentile", "percentile(l_quantity, 0.9)"), ("collect_list", "size(collect_list(l_quantity))"), ("percentile_approx", "percentile_approx(l_quantity, 0.5)"), ("min_max_avg", "min(l_quantity) + max(l_quantity) + avg(l_quantity)")):
    _add(f"trace_{_name}", _trace(f"select l_linestatus as t, {_call} as v from {{lineitem}} where l_discount > 0.05 group by 1", "t = 'F'", (0,), LINE), _lines("l_linestatus = 'F' and l_discount > 0.05"))


_add("trace_agg_global", _trace("select sum(l_quantity) as s, count(*) as c from {lineitem}", "c > 0", (0,), LINE), _lines("true"))
_LEVEL = "case when l_quantity > 40 then 'high' when l_quantity > 20 then 'middle' else 'low' end"
_add("trace_conditional", _trace(f"select {_LEVEL} as k, sum(coalesce(nullif(l_tax, 0.0), 1.0)) as s from {{lineitem}} group by 1", "k = 'middle'", (0,), LINE), _lines("l_quantity > 20 and l_quantity <= 40"))
_add("trace_json", _trace("select get_json_object(to_json(named_struct('f', l_returnflag, 'q', l_quantity)), '$.f') as f, count(*) as c from {lineitem} group by 1", "f = 'R'", (0,), LINE), _lines("l_returnflag = 'R'"))
_add("trace_empty", _trace("select n_name from {nation} where 1 = 0", "true", (), "n_name"), "SELECT n_name FROM nation WHERE 1 = 0")

# ---- joins
_ORDER, _ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE "
_CUST, _CUSTS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE "
_JOIN = "select l_orderkey, l_linenumber, o_totalprice from {lineitem} join {orders} on l_orderkey = o_orderkey"
_add("trace_join_left", _trace(_JOIN, "true", (0,), LINE), _lines("l_orderkey in (select o_orderkey from orders)"))
_add("trace_join_right", _trace(_JOIN, "true", (1,), _ORDER), _ORDERS + "o_orderkey in (select l_orderkey from lineitem)")
_FLAGS = "select name, sum(l_quantity) as s from {lineitem} join values ('R', 'returned'), ('A', 'accepted') as v(flag, name) on l_returnflag = flag group by name"
_add("trace_inline_join", _trace(_FLAGS, "name = 'returned'", (0, 0), LINE), _lines("l_returnflag = 'R'"))
_LONE = "o_orderkey not in (select l_orderkey from lineitem)"
_add("trace_left_outer_unmatched", _trace("select o_orderkey, l_linenumber from {orders} left join {lineitem} on l_orderkey = o_orderkey", "l_linenumber is null", (0,), _ORDER), _ORDERS + _LONE)
_add("trace_right_outer", _trace("select l_linenumber, o_orderkey from {lineitem} right join {orders} on l_orderkey = o_orderkey", "l_linenumber is null", (1,), _ORDER), _ORDERS + _LONE)
_add("trace_full_outer", _trace("select o_orderkey, l_linenumber from {orders} full join {lineitem} on l_orderkey = o_orderkey", "l_linenumber is null", (0,), _ORDER), _ORDERS + _LONE)
_add("trace_outer_other_side", _trace("select o_orderkey, o_orderpriority, l_linenumber from {orders} left join (select * from {lineitem} where l_quantity > 45) on l_orderkey = o_orderkey", "o_orderpriority = '1-URGENT'", (1,), LINE), _lines("l_quantity > 45 and l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')"))
_SEMI = "select o_orderkey from {orders} where o_orderkey in (select l_orderkey from {lineitem} where l_quantity > 48)"
_add("trace_semi", _trace(_SEMI, "o_orderkey > 0", (0,), _ORDER), _ORDERS + "o_orderkey in (select l_orderkey from lineitem where l_quantity > 48)")
_add("trace_semi_right", _trace(_SEMI, "o_orderkey > 0", (1,), LINE), _lines("l_quantity > 48"))
_add("trace_anti", _trace("select o_orderkey from {orders} where not exists (select 1 from {lineitem} where l_orderkey = o_orderkey)", "true", (0,), _ORDER), _ORDERS + _LONE)
_CHAIN = "select n_name, sum(l_extendedprice) as s from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey group by n_name"
_IN = "o_custkey in (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = (select max(n_name) from nation))"
_LAST = "n_name = (select max(n_name) from {nation})"


def _last_nation(steps: tuple[int, ...], columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        last = table(spark, sf_dir, "nation").agg(F.max("n_name")).first()[0]
        return _trace(_CHAIN, f"n_name = '{last}'", steps, columns)(spark, sf_dir)

    return run


_add("trace_join_chain", _last_nation((0, 0, 0, 0), LINE), _lines(f"l_orderkey in (select o_orderkey from orders where {_IN})"))
_add("trace_join_agg_left", _last_nation((0, 0, 0, 1), _ORDER), _ORDERS + f"{_IN} and o_orderkey in (select l_orderkey from lineitem)")
_add("trace_join_agg_right", _last_nation((0, 0, 1), _CUST), _CUSTS + "c_nationkey in (select n_nationkey from nation where n_name = (select max(n_name) from nation)) and c_custkey in (select o_custkey from orders join lineitem on o_orderkey = l_orderkey)")
_add("trace_self_join", _trace("select a.n_nationkey as x, b.n_nationkey as y from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey", "x < 3", (1,), "n_nationkey, n_name"), "SELECT DISTINCT b.n_nationkey, b.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_nationkey < 3")
# ---- windows, top-k, set operations, generators
_add("trace_window_peers", _trace("select c_custkey, c_mktsegment, rank() over (partition by c_mktsegment order by c_acctbal desc) as r from {customer}", "r = 1 and c_mktsegment = 'BUILDING'", (0,), _CUST), _CUSTS + "c_mktsegment = 'BUILDING'")
_BEST = "select c_custkey, c_mktsegment from (select *, {}() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from {{customer}}) where r <= 3"
for _name in ("row_number", "rank", "dense_rank"):
    _add(f"trace_topn_{_name}", _trace(_BEST.format(_name), "c_mktsegment = 'BUILDING'", (0,), _CUST), _CUSTS + "c_mktsegment = 'BUILDING'")
_TOP = "order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 5"
_add("trace_topk", _trace(f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice from {{lineitem}} {_TOP}", "true", (0,), LINE), f"SELECT {LINE} FROM lineitem {_TOP}")
_add("trace_topk_pruned_key", _trace(f"select l_quantity from {{lineitem}} {_TOP}", "true", (0,), LINE), f"SELECT {LINE} FROM lineitem {_TOP}")
_add("trace_topk_of_groups", _trace("select l_suppkey as k, sum(l_quantity) as s from {lineitem} group by 1 order by s desc, k limit 2", "true", (0, 0), LINE), _lines("l_suppkey in (select l_suppkey from lineitem group by 1 order by sum(l_quantity) desc, 1 limit 2)"))
_UNION = "select l_orderkey as k, l_quantity as v from {lineitem} where l_quantity > 49 union all select o_orderkey as k, o_totalprice as v from {orders} where o_totalprice > 300000"
_add("trace_union_b0", _trace(_UNION, "true", (0,), LINE), _lines("l_quantity > 49"))
_add("trace_union_b1", _trace(_UNION, "true", (1,), _ORDER), _ORDERS + "o_totalprice > 300000")
_add("trace_union_agg", _trace("select f, sum(q) as s from (select l_returnflag as f, l_quantity as q from {lineitem} union all select l_returnflag as f, l_tax as q from {lineitem} where l_tax > 0.04) group by f", "f = 'R'", (0, 1), LINE), _lines("l_returnflag = 'R' and l_tax > 0.04"))
_add("trace_union_of_aggs", _trace("select l_returnflag as f, sum(l_quantity) as s from {lineitem} group by 1 union all select o_orderstatus as f, sum(o_totalprice) as s from {orders} group by 1", "true", (1, 0), _ORDER), _ORDERS + "true")
_add("trace_union_distinct", _trace("select l_suppkey as k from {lineitem} where l_quantity > 49 union select s_suppkey as k from {supplier}", "true", (0, 1), "s_suppkey, s_name"), "SELECT s_suppkey, s_name FROM supplier")
_add("trace_intersect", _trace("select c_custkey as k from {customer} where c_acctbal > 0 intersect select o_custkey as k from {orders}", "true", (0, 0), _CUST), _CUSTS + "c_acctbal > 0 and c_custkey in (select o_custkey from orders)")
_add("trace_except", _trace("select o_orderkey as k from {orders} except select l_orderkey as k from {lineitem}", "true", (0, 0), _ORDER), _ORDERS + _LONE)
_add("trace_explode", _trace("select w, count(*) as n from (select explode(split(text, ' ')) as w from {documents}) group by w", "w = 'the'", (0,), "doc_id, lang, source"), "SELECT doc_id, lang, source FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
_NESTED = "select c_nationkey as n, avg(s) as a from (select c_nationkey, c_custkey, sum(o_totalprice) as s from {orders} join {customer} on o_custkey = c_custkey group by 1, 2) group by 1"
_add("trace_nested_agg", _trace(_NESTED, "n = 3", (0, 0, 0), _ORDER), _ORDERS + "o_custkey in (select c_custkey from customer where c_nationkey = 3)")


def trace_cached_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = table(spark, sf_dir, "customer").filter("c_acctbal > 0").persist()
    t = Lineage(spark)
    df = cached.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"))
    return t.trace_where(df, "c_mktsegment = 'BUILDING'").go_back().witnesses(full=True).select(*_CUST.split(", "))


_add("trace_cached_source", trace_cached_source, _CUSTS + "c_mktsegment = 'BUILDING' and c_acctbal > 0")


def trace_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the source rows of one group of one query, all groups of another that they reach."""
    t = Lineage(spark)
    df = _frame(spark, sf_dir, "select l_suppkey as k, sum(l_quantity) as s, count(*) as c from {lineitem} group by 1")
    back = t.trace_where(df, "true").go_back()
    some = back.witnesses(full=True, keep_id="__id").filter("l_shipdate >= timestamp_ntz'2001-09-01 00:00:00' and l_quantity > 45").select(F.col("__id").alias("id"))
    up = Cursor(back.graph, back.level, some, back.path, 0, t).go_next()
    return t.result(df, "id").join(up.frontier, "id", "left_semi").select("k", F.round("s", 2).alias("s"), "c")


_add("trace_forward", trace_forward, "SELECT l_suppkey AS k, round(sum(l_quantity), 2) AS s, count(*) AS c FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate >= timestamp '2001-09-01' AND l_quantity > 45) GROUP BY 1")


def trace_all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For one output, the key of every witness in each source table."""
    t = Lineage(spark)
    last = table(spark, sf_dir, "nation").agg(F.max("n_name")).first()[0]
    keys = {"lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",)}
    found = None
    for c in t.trace_where(_frame(spark, sf_dir, _CHAIN), f"n_name = '{last}'").sources():
        name = c.level.source.path.rstrip("/").rpartition("/")[2].removesuffix(".parquet")
        n = c.witnesses(full=True).select(F.lit(name).alias("source"), F.concat_ws("-", *keys[name]).alias("key"))
        found = n if found is None else found.unionByName(n)
    return found


_add(
    "trace_all_sources",
    trace_all_sources,
    f"""WITH o AS (SELECT * FROM orders WHERE {_IN} AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'lineitem' AS source, l_orderkey || '-' || l_linenumber AS key FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'orders', o_orderkey::VARCHAR FROM o UNION ALL SELECT 'customer', o_custkey::VARCHAR FROM (SELECT DISTINCT o_custkey FROM o)
UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)""",
)


def trace_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Lineage(spark)
    t.enable_focus("l_returnflag = 'R'")
    return t.trace_where(_frame(spark, sf_dir, _SUM), "f = 'R'").go_back().witnesses(full=True).selectExpr(*LINE.split(", "))


_add("trace_focus", trace_focus, _lines("l_returnflag = 'R'"))


def witness_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witness rows as they are written to text: columns joined by a bar."""
    t = Lineage(spark)
    c = t.trace_where(_frame(spark, sf_dir, "select n_regionkey as r, count(*) as c, max(n_name) as m from {nation} group by 1"), "r = 2").go_back()
    return c._lines()


_add("witness_lines", witness_lines, "SELECT n_name || '|' || n_regionkey AS value FROM nation WHERE n_regionkey = 2")

# ---- influence
_FLAG = "select l_returnflag as f, {} as v from {{lineitem}} where l_quantity > 20 group by 1"
_add("influence_sum", _influence(_FLAG.format("sum(l_quantity)"), "f = 'R'", "v"), "SELECT round(l_quantity, 4) AS value, round(l_quantity, 4) AS influence FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20")
_add("influence_count", _influence(_FLAG.format("count(l_quantity)"), "f = 'R'", "v"), "SELECT 1.0::DOUBLE AS value, 1.0::DOUBLE AS influence FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20")
_SUPP = "select s_nationkey as n, {} as v from {{supplier}} group by 1"
_LOO = "SELECT round(s_acctbal, 4) AS value, round({}, 4) AS influence FROM supplier s WHERE s_nationkey = 3"
_REST = "(SELECT {} FROM supplier r WHERE r.s_nationkey = s.s_nationkey AND r.s_suppkey <> s.s_suppkey)"
for _name, _spark, _duck in (("avg", "avg(s_acctbal)", "avg(s_acctbal)"), ("max", "max(s_acctbal)", "max(s_acctbal)"), ("min", "min(s_acctbal)", "min(s_acctbal)"), ("median", "median(s_acctbal)", "quantile_cont(s_acctbal, 0.5)"), ("p95", "percentile(s_acctbal, 0.95)", "quantile_cont(s_acctbal, 0.95)")):
    _whole = f"(SELECT {_duck} FROM supplier r WHERE r.s_nationkey = s.s_nationkey)"
    _add(f"influence_{_name}", _influence(_SUPP.format(_spark), "n = 3", "v"), _LOO.format(f"coalesce({_whole} - {_REST.format(_duck)}, 0)"))
_add(
    "influence_nested_outer",
    _influence(_NESTED, "n = 3", "a", 3),
    "WITH g AS (SELECT c_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 GROUP BY 1), m AS (SELECT avg(s) AS a, count(*) AS n FROM g) SELECT round(s, 3) AS value, round(CASE WHEN n > 1 THEN (s - a) / (n - 1) ELSE 0 END, 3) AS influence FROM g, m",
)
_add("influence_nested_inner", _influence(_NESTED, "n = 3", "s", 3), "SELECT round(o_totalprice, 3) AS value, round(o_totalprice, 3) AS influence FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
_add("influence_filtered", _influence("select s_nationkey as n, sum(s_acctbal) filter (where s_acctbal > 0) as v from {supplier} group by 1", "n = 3", "v"), "SELECT CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 4) END AS value, CASE WHEN s_acctbal > 0 THEN round(s_acctbal, 4) ELSE 0 END AS influence FROM supplier WHERE s_nationkey = 3")


# ---- what UDFs read
@udf("double")
def charge(l_quantity, l_tax, l_returnflag):
    return l_quantity * 2.0 if l_returnflag == "R" else l_quantity + l_tax


@udf("double")
def largest(l_quantity, l_extendedprice):
    return float(max(l_quantity, l_extendedprice))


def _opaque(x: float) -> float:
    return x + 1.0


@udf("double")
def unmodeled(l_quantity, l_tax):
    return _opaque(l_quantity) if l_quantity > 25 else 0.0


def _reads(measure, columns: tuple[str, ...], mode: str) -> Query:
    """How many witnesses of one group read which fields as data and control."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark)
        t.enable_udf_aware(measure, mode=mode)
        df = table(spark, sf_dir, "lineitem").filter("l_discount > 0.08").withColumn("m", measure(*columns)).groupBy("l_linestatus").agg(F.sum("m").alias("s"))
        rows = t.trace_where(df, "l_linestatus = 'F'").go_back().annotations()
        t.disable_udf_aware()
        return rows.groupBy(F.concat_ws(",", "_data").alias("data"), F.concat_ws(",", "_control").alias("control"), F.col("_regime").alias("regime")).agg(F.count("*").alias("n"))

    return run


_MINE = "FROM lineitem WHERE l_linestatus = 'F' AND l_discount > 0.08"
_CELL = f"SELECT CASE WHEN l_returnflag = 'R' THEN 'l_quantity' ELSE 'l_quantity,l_tax' END AS data, 'l_returnflag' AS control, 'exact' AS regime, count(*) AS n {_MINE} GROUP BY 1"
_args = ("l_quantity", "l_tax", "l_returnflag")
_add("udf_column", _reads(charge, _args, "column"), f"SELECT 'l_quantity,l_tax' AS data, 'l_returnflag' AS control, 'exact' AS regime, count(*) AS n {_MINE}")
_add("udf_cell", _reads(charge, _args, "cell"), _CELL)
_add("udf_lazy_cell", _reads(charge, _args, "lazy-cell"), _CELL)
_add("udf_model_extremal", _reads(largest, ("l_quantity", "l_extendedprice"), "lazy-cell"), f"SELECT CASE WHEN l_quantity >= l_extendedprice THEN 'l_quantity' ELSE 'l_extendedprice' END AS data, '' AS control, 'model' AS regime, count(*) AS n {_MINE} GROUP BY 1")
_add("udf_coarse_call", _reads(unmodeled, ("l_quantity", "l_tax"), "lazy-cell"), f"SELECT CASE WHEN l_quantity > 25 THEN 'l_quantity' ELSE '' END AS data, 'l_quantity' AS control, CASE WHEN l_quantity > 25 THEN 'coarse' ELSE 'exact' END AS regime, count(*) AS n {_MINE} GROUP BY 1, 3")




@udf("double")
def banded(l_quantity, l_tax):
    return 1.0 if 10 < l_quantity <= 30 else l_tax


@udf("double")
def both(l_quantity, l_tax):
    return 1.0 if l_quantity > 25 and l_tax > 0.04 else 0.0


@udf("double")
def picked(l_quantity, l_tax):
    return [l_quantity, l_tax][0 if l_quantity > 25 else 1]


@udf("double")
def summed(l_quantity, l_tax):
    total = 0.0
    for v in (l_quantity, l_tax):
        total += v
    return total


@udf("double")
def listed(l_quantity, l_tax):
    return sum([2 * v for v in (l_quantity, l_tax)])


def _spread(*parts: float, by: float = 1.0) -> float:
    return sum(parts) * by


@udf("double")
def spread(l_quantity, l_tax, l_discount):
    return _spread(*[l_quantity, l_tax], by=l_discount)


_two = ("l_quantity", "l_tax")
_HOW = "SELECT {} AS data, {} AS control, '{}' AS regime, count(*) AS n " + _MINE + " GROUP BY ALL"
for _measure, _data, _control, _regime in (
    (banded, "CASE WHEN l_quantity > 10 AND l_quantity <= 30 THEN '' ELSE 'l_tax' END", "'l_quantity'", "exact"),
    (both, "''", "CASE WHEN l_quantity > 25 THEN 'l_quantity,l_tax' ELSE 'l_quantity' END", "exact"),
    (picked, "CASE WHEN l_quantity > 25 THEN 'l_quantity' ELSE 'l_tax' END", "'l_quantity'", "exact"),
    (summed, "'l_quantity,l_tax'", "''", "exact"),
    (listed, "'l_quantity,l_tax'", "''", "model"),
):
    _add(f"udf_{_measure.name}", _reads(_measure, _two, "lazy-cell"), _HOW.format(_data, _control, _regime))
    _add(f"udf_{_measure.name}_cell", _reads(_measure, _two, "cell"), _HOW.format(_data, _control, _regime))
_add("udf_spread", _reads(spread, (*_two, "l_discount"), "lazy-cell"), _HOW.format("'l_discount,l_quantity,l_tax'", "''", "coarse"))


def trace_arrow_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a vectorized UDF."""
    fee = F.pandas_udf(lambda q: q * 0.5, "double")
    df = table(spark, sf_dir, "lineitem").withColumn("fee", fee("l_quantity")).groupBy("l_linestatus").agg(F.sum("fee").alias("s"))
    return Lineage(spark).trace_where(df, "l_linestatus = 'F'").go_back().witnesses(full=True).selectExpr(*LINE.split(", "))


_add("trace_arrow_udf", trace_arrow_udf, _lines("l_linestatus = 'F'"))


# ---- the session's calls
def _folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share; on one machine without such a folder, in one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="whence-")
    return f"{where.rstrip('/')}/whence-query-{uuid.uuid4().hex}"


_BIG = "select o_custkey as k, count(*) as c from {orders} where o_totalprice > 250000 group by 1"
_BIGS = _ORDERS + "o_totalprice > 250000"


def _written(how: str) -> Query:
    """The lines of a file of witnesses, written in one of three ways."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, c = _folder(spark), Lineage(spark).trace_where(_frame(spark, sf_dir, _BIG), "c > 0")
        n = getattr(c, f"write_witnesses{how}")(path)
        return spark.read.text(path).withColumn("lines", F.lit(n).cast("long"))

    return run


for _how in ("", "_distributed", "_auto"):
    _add(f"written_witnesses{_how}", _written(_how), "SELECT o_custkey || '|' || o_totalprice AS value, (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS lines FROM orders WHERE o_totalprice > 250000")


def session_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a result with their ids, which differ from row to row; and the same rows without capture, which have none."""
    t, sql = Lineage(spark), "select c_mktsegment as m, count(*) as c from {customer} group by 1"
    df = _frame(spark, sf_dir, sql)
    rows, ids = t.collect_with_lineage(df), t.result_ids(df)
    t.disable_capture()
    plain = t.collect_with_lineage(_frame(spark, sf_dir, sql))
    t.enable_capture()
    distinct = len(set(ids)) == len(rows) and set(ids) == {i for _, i in rows}
    return spark.createDataFrame([("captured", r.m, r.c, distinct) for r, _ in rows] + [("plain", r.m, r.c, i is None) for r, i in plain], "how string, m string, c long, fits boolean")


_add("session_collect", session_collect, "SELECT how, c_mktsegment AS m, count(*) AS c, true AS fits FROM customer, (VALUES ('captured'), ('plain')) v(how) GROUP BY 1, 2")


def session_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows by the ids that a walk from a list of outputs ends at."""
    t, df = Lineage(spark), _frame(spark, sf_dir, "select s_nationkey as n, sum(s_acctbal) as b from {supplier} group by 1")
    ids = t.backward(df, [i for r, i in t.collect_with_lineage(df) if r.n == 3])
    return spark.createDataFrame([(r.s_nationkey, r.s_acctbal) for r in t.show_inputs(df, ids)], "s_nationkey long, s_acctbal double")


_add("session_backward", session_backward, "SELECT s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 3")


def session_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored and traced before and after lineage is released."""
    t, df = Lineage(spark), _frame(spark, sf_dir, "select n_regionkey as r, count(*) as c from {nation} group by 1")
    ids = t.result_ids(df)
    seen = [("held", sum(t.lineage_size(df)) > 0, len(t.trace(df, ids).go_back().ids), t.trace(df, ids).go_back().at_scan)]
    t.release_lineage(df)
    seen.append(("released", sum(t.lineage_size(df)) > 0, len(t.trace(df, ids).go_back().ids), t.trace(df, ids).go_back().at_scan))
    return spark.createDataFrame(seen, "state string, stored boolean, traced long, at_scan boolean")


_add("session_release", session_release, "SELECT 'held' AS state, true AS stored, count(*) AS traced, true AS at_scan FROM nation UNION ALL SELECT 'released', false, 0, true")


def show_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses as dicts, of one source and of all."""
    t = Lineage(spark)
    df = _frame(spark, sf_dir, "select n_name, r_name from {nation} join {region} on n_regionkey = r_regionkey")
    c = t.trace_where(df, "r_name = 'ASIA'")
    rows = [("one", d["n_name"]) for d in c.go_back(0).show()]
    for s in c.show_all_sources():
        rows += [("all", r["n_name"] if "n_name" in s.schema.fieldNames() else r["r_name"]) for r in s.rows]
    return spark.createDataFrame(rows, "shown string, name string")


_add("show_dicts", show_dicts, "WITH n AS (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT 'one' AS shown, n_name AS name FROM n UNION ALL SELECT 'all', n_name FROM n UNION ALL SELECT 'all', 'ASIA' WHERE EXISTS (SELECT 1 FROM n)")

_SHAPES = {
    "global order": "select * from {nation} order by n_name",
    "cross join": "select * from {nation} cross join {region}",
    "unequal join": "select * from {nation} a join {region} on n_regionkey < r_regionkey",
    "range": "select id from range(5)",
    "bare limit": "select * from {nation} limit 3",
    "group": "select n_regionkey, count(*) from {nation} group by 1",
}


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shapes are refused, which run without ids, and which are captured."""

    def outcome(sql: str) -> str:
        try:
            ids = [i for _, i in Lineage(spark).collect_with_lineage(_frame(spark, sf_dir, sql))]
        except UnsupportedOperatorError:
            return "refused"
        return "plain" if ids and set(ids) == {None} else "captured"

    return spark.createDataFrame([(k, outcome(sql)) for k, sql in _SHAPES.items()], "shape string, outcome string")


_add("refusals", refusals, "SELECT * FROM (VALUES ('global order', 'refused'), ('cross join', 'refused'), ('unequal join', 'refused'), ('range', 'refused'), ('bare limit', 'plain'), ('group', 'captured')) v(shape, outcome)")


def influence_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate without a closed form, scored by one that the session names."""
    t = Lineage(spark)
    t.enable_influence("max")
    c = t.trace_where(_frame(spark, sf_dir, _SUPP.format("stddev(s_acctbal)")), "n = 3")
    return c.influence_table("v").select(F.round("value", 4).alias("value"), F.round("influence", 4).alias("influence"))


_add("influence_fallback", influence_fallback, _SQL["influence_max"])


# ---- star joins: the group with the largest measure, its witnesses
def _star_query(name: str) -> Query:
    star = STARS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark)
        df = star.query(spark, sf_dir)
        top = t.result(df, "id").withColumn("measure", F.round("measure", 2)).orderBy(F.col("measure").desc(), star.key).limit(1).select("id")
        c = t.trace(df, top)
        while not c.at_scan:
            c = c.go_back(0)
        return c.witnesses(full=True).selectExpr(*LINE.split(", "))

    return run


_KEYS = {"orders": "l_orderkey = o_orderkey", "part": "l_partkey = p_partkey", "supplier": "l_suppkey = s_suppkey", "customer": "o_custkey = c_custkey", "nation": "s_nationkey = n_nationkey", "region": "n_regionkey = r_regionkey"}
_MEASURES = {"revenue": "l_extendedprice * (1.0 - l_discount)", "one": "1.0", "quantity": "l_quantity"}
for _name, _s in STARS.items():
    _from = "lineitem " + " ".join(f"JOIN {x} ON {_KEYS[x]}" for x in _s.tables) + f" WHERE {_s.where}"
    _add(f"star_{_name}", _star_query(_name), f"WITH j AS (SELECT {LINE}, {_s.key} AS k, {_MEASURES[_s.measure.name]} AS m FROM {_from}), g AS (SELECT k FROM j GROUP BY k ORDER BY round({_s.agg}(m), 2) DESC, k LIMIT 1) SELECT {LINE} FROM j WHERE k IN (SELECT k FROM g)")


# ---- planted faults: normal rows made from lineitem, a faulty group beside them
def _program(name: str) -> Query:
    """The contributions behind the suspicious output and their influence: planted faults rank first."""
    p = PROGRAMS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Lineage(spark, strict=False)
        t.enable_influence()
        base = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"))
        c = t.trace_where(p.query(p.rows(base)), p.suspicious)
        return c.influence_table(p.column).select(F.round("value", 3).alias("value"), F.round("influence", 3).alias("influence"))

    return run


_SCORES = {"sum": "v", "avg": "(v - (SELECT avg(v) FROM f)) / ((SELECT count(*) FROM f) - 1)", "max": "(SELECT max(v) FROM f) - (SELECT max(v) FROM f r WHERE r.i <> f.i)", "p95": "(SELECT quantile_cont(v, 0.95) FROM f) - (SELECT quantile_cont(v, 0.95) FROM f r WHERE r.i <> f.i)"}
for _name, _p in PROGRAMS.items():
    _add(f"prog_{_name}", _program(_name), f"WITH f AS (SELECT i, ({_p.sql})::DOUBLE AS v FROM (SELECT range AS i FROM range({FAULTY}))) SELECT round(v, 3) AS value, round({_SCORES[_p.agg]}, 3) AS influence FROM f")


# ---- RDD jobs
def _rdd_words(spark: SparkSession, sf_dir: str):
    lc = LineageContext(spark.sparkContext)
    rows = lc._source(table(spark, sf_dir, "documents").select("doc_id", "text").rdd.map(tuple))
    return lc, rows


def _counted(rows):
    return rows.flatMap(lambda d: d[1].split(" ")).map(lambda w: (w, 1)).reduceByKey(lambda a, b: a + b)


def _word(counts, word: str):
    """A cursor at the documents behind one word."""
    wanted = key_id(word)
    return counts.getLineage().filter(lambda i: i == wanted).goBack()


def rdd_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind one word of a word count."""
    _, rows = _rdd_words(spark, sf_dir)
    return spark.createDataFrame(_word(_counted(rows), "the").toRDD().map(lambda d: (d[0],)), "doc_id long")


def rdd_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word count again, of the documents behind one word alone."""
    _, rows = _rdd_words(spark, sf_dir)
    return spark.createDataFrame(_word(_counted(rows), "sch").replay(), "word string, n long")


def rdd_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = _rdd_words(spark, sf_dir)
    return spark.createDataFrame(rows.filter(lambda d: " and the " in d[1]).getLineage().toRDD().map(lambda d: (d[0],)), "doc_id long")


def rdd_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders behind all joined records, at the granularity of the key: all orders of the customer."""
    lc = LineageContext(spark.sparkContext)
    orders = lc._source(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").rdd.map(tuple))
    customers = lc._source(table(spark, sf_dir, "customer").select("c_custkey", "c_name").rdd.map(tuple))
    return spark.createDataFrame(orders.join(customers).getLineage().goBack(0).toRDD().map(lambda o: (o[0], o[1])), "o_custkey long, o_orderkey long")


def rdd_pair_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind one language, through operations on pairs: the same witnesses whichever brings them together."""
    _, rows = _rdd_words(spark, sf_dir)
    pairs = rows.keyBy(lambda d: d[0] % 3).mapValues(lambda d: d[0]).flatMapValues(lambda i: [i, -i])
    jobs = {
        "reduceByKey": pairs.reduceByKey(max), "groupByKey": pairs.groupByKey(), "aggregateByKey": pairs.aggregateByKey(0, max, max), "combineByKey": pairs.combineByKey(lambda v: [v], lambda a, v: [*a, v], lambda a, b: [*a, *b]),
        "groupBy": pairs.values().groupBy(lambda i: abs(i) % 3), "cogroup": pairs.cogroup(pairs), "sortBy": pairs.coalesce(2).sortBy(lambda kv: kv[1]).sortByKey().reduceByKey(max), "mapPartitions": pairs.mapPartitions(lambda it: [kv for kv in list(it)]).reduceByKey(max),
        "zipPartitions": pairs.zipPartitions([pairs], lambda a, b: (x for x, _ in zip(a, b, strict=True))).zipWithUniqueId().map(lambda x: x[0]).reduceByKey(max),
        "repartition": pairs.repartitionAndSortWithinPartitions(3).reduceByKey(max),
    }
    wanted, found = key_id(1), None
    for name, job in jobs.items():
        docs = job.getLineage().filter(lambda i: i == wanted).goBack().toRDD().map(lambda d, name=name: (name, d[0]))
        found = docs if found is None else found.union(docs)
    return spark.createDataFrame(found, "job string, doc_id long")


def rdd_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a union, and cursors that meet."""
    lc = LineageContext(spark.sparkContext)
    nations = lc._source(table(spark, sf_dir, "nation").select("n_name", "n_regionkey").rdd.map(tuple))
    regions = lc._source(table(spark, sf_dir, "region").select("r_name", "r_regionkey").rdd.map(tuple))
    at = nations.union(regions).getLineage()
    back = at.goBack(0)
    here = back.intersection(nations.filter(lambda x: x[1] == 2).getLineage()).toRDD().map(lambda x: ("met", x[0]))
    sides = [at.goBack(b).toRDD().map(lambda x, b=b: (f"side {b}", x[0])) for b in (0, 1)]
    return spark.createDataFrame(sides[0].union(sides[1]).union(here), "part string, name string")


def rdd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a text file behind one key, read in two ways; and the links as a CSV file."""
    lc, path, out = LineageContext(spark.sparkContext), _folder(spark), _folder(spark)
    lc._source(table(spark, sf_dir, "nation").select("n_name", "n_regionkey").rdd.map(lambda r: f"{r[0]},{r[1]}")).saveAsTextFile(path)
    text = lc.textFile(path)
    hadoop = lc.hadoopFile(path, "org.apache.hadoop.mapred.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text").values()
    wanted, found = key_id("2"), None
    for name, lines in (("textFile", text), ("hadoopFile", hadoop)):
        at = lines.map(lambda x: (x.split(",")[1], 1)).reduceByKey(lambda a, b: a + b).getLineage().filter(lambda i: i == wanted)
        rows = at.goBack().toRDD().map(lambda x, name=name: (name, x if isinstance(x, str) else x[1]))
        found = rows if found is None else found.union(rows)
    at.saveAsCSVFile(out)
    links = spark.read.csv(out).select(F.lit("links"), F.count("*").over(Window.partitionBy("_c0")).cast("string"))
    return spark.createDataFrame(found, "way string, line string").unionAll(links)


def rdd_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lc = LineageContext(spark.sparkContext)
    rows = lc._source(table(spark, sf_dir, "documents").select("doc_id", "lang").rdd.map(tuple))
    langs, wanted = rows.map(lambda d: d[1]).distinct(), key_id("de")
    return spark.createDataFrame(langs.getLineage().filter(lambda i: i == wanted).goBack().toRDD().map(lambda d: (d[0],)), "doc_id long")


_add("rdd_wordcount", rdd_wordcount, "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the')")
_add("rdd_grep", rdd_grep, "SELECT doc_id FROM documents WHERE contains(text, ' and the ')")
_add("rdd_replay", rdd_replay, "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents WHERE list_contains(string_split(text, ' '), 'sch')) GROUP BY word")
_add("rdd_join", rdd_join, "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
_add("rdd_pair_operations", rdd_pair_operations, "SELECT job, doc_id FROM documents, (VALUES ('reduceByKey'), ('groupByKey'), ('aggregateByKey'), ('combineByKey'), ('groupBy'), ('cogroup'), ('sortBy'), ('mapPartitions'), ('zipPartitions'), ('repartition')) v(job) WHERE doc_id % 3 = 1")
_add("rdd_union", rdd_union, "SELECT 'side 0' AS part, n_name AS name FROM nation UNION ALL SELECT 'side 1', r_name FROM region UNION ALL SELECT 'met', n_name FROM nation WHERE n_regionkey = 2")
_add("rdd_files", rdd_files, "WITH n AS (SELECT n_name || ',' || n_regionkey AS line FROM nation WHERE n_regionkey = 2) SELECT way, line FROM n, (VALUES ('textFile'), ('hadoopFile')) v(way) UNION ALL SELECT 'links', (SELECT count(*) FROM n)::VARCHAR FROM n")
_add("rdd_distinct", rdd_distinct, "SELECT doc_id FROM documents WHERE lang = 'de'")


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
