"""Registered queries that trace all outputs, against their SQL."""

import pytest

from whence import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["trace_join_left", "trace_join_right", "trace_union_distinct", "trace_forward", "rdd_join", "rdd_replay", "trace_topn_rank", "udf_cell", "udf_lazy_cell", "prog_holistic", "prog_sentiment", "trace_outer_other_side", "trace_all_sources", "refusals", "session_release", "rdd_files", "udf_picked"])
def test_witnesses_equal_the_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as c:
        for t in queries.NAMES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = c.execute(queries.oracle_sql()[name]).fetchall()
    assert want and sorted(map(tuple, queries.queries()[name](spark, SF).collect())) == sorted(want)
