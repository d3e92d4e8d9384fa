"""Measures capture on the example programs: overhead, stored lineage, trace time and accuracy. Prints one JSON line a measurement.

    python -m whence.operators.measure FOLDER [rows] [program ...]
"""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from .programs import PROGRAMS, Program
from .session import Lineage

MODES = ("row", "column", "lazy-cell")


def timed(run: Callable) -> tuple[float, object]:
    began = time.time()
    got = run()
    return time.time() - began, got


def one(spark: SparkSession, name: str, p: Program, source: DataFrame, rows: int, mode: str, scored: bool, focus: str = "") -> dict:
    """overhead: captured over native seconds, each after a warm run; precision and recall of witnesses against the faulty group (ids below zero)."""

    def captured():
        t = Lineage(spark)
        if scored:
            t.enable_influence()
        if mode != "row":
            t.enable_udf_aware(*p.measures, mode=mode)
        if focus:
            t.enable_focus(focus)
        df = p.query(source)
        return t, df, t.collect_with_lineage(df)

    native = lambda: p.query(source).collect()
    native()
    captured()
    spark.catalog.clearCache()
    plain, _ = timed(native)
    took, (t, df, _) = timed(captured)
    mb = sum(t.lineage_size(df)) / 1e6
    spent, at = timed(lambda: t.trace_where(df, p.suspicious).to_scan())
    found = at.witnesses(full=True).select("rid", "__fault").collect()
    right = sum(r["rid"] < 0 for r in found)
    out = {"program": name, "rows": rows, "mode": mode, "influence": scored, "focus": focus, "native_s": round(plain, 3), "overhead": round(took / plain, 2), "lineage_mb": round(mb, 3), "trace_ms": round(1000 * spent), "scanned": rows + 300, "traced": len(found), "reduction": round((rows + 300) / max(1, len(found)), 1), "lin_precision": round(right / max(1, len(found)), 4), "lin_recall": round(right / 300, 4)}
    if scored:
        faults = sum(r["__fault"] for r in found)
        scores = at.influence(p.column)
        by_id = {r["__id"]: r["__fault"] for r in at.witnesses(full=True, keep_id="__id").select("__id", "__fault").collect()}
        top = [by_id.get(i, False) for i in scores.top(max(1, faults))]
        out |= {"fault_prec1": float(bool(top and top[0])), "fault_recall": round(sum(top) / max(1, faults), 4)}
    t.release_lineage(df)
    t.disable_udf_aware()
    return out


def measurements(spark: SparkSession, rows: int, names: list[str], where: str) -> Iterator[dict]:
    for name in names:
        p = PROGRAMS[name]
        path = f"{where}/{name}"
        p.rows(spark.range(rows)).write.mode("overwrite").parquet(path)
        source = spark.read.parquet(path)
        for mode in MODES:
            for scored in (False, True):
                yield one(spark, name, p, source, rows, mode, scored)
        yield one(spark, name, p, source, rows, "lazy-cell", True, p.group)


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]  # where inputs go: any path that driver and executors share
    many = int(sys.argv[2]) if len(sys.argv) > 2 else 200_000
    for line in measurements(session, many, sys.argv[3:] or list(PROGRAMS), folder):
        print(json.dumps(line), flush=True)
