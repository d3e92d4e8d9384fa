"""What several corpus operators share: reading tables, cutting lineage, word rules, batches of Arrow."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, any path Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the session's checkpoint folder where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty() and spark.sparkContext.master.split("[")[0] == "local":  # one machine: no other executor needs the folder
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="whence-"))
            got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = got.get()
    return where.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already: the folder's owner cleans it up
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/whence-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `keep` wrote, once all that reads them is written; shuffles that nothing refers to go as well."""
    for t in tables:
        _forget(t.sparkSession, t.kept_at)
    tables[0].sparkSession._jvm.System.gc()


def small_or_not(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df`, of which the number of (narrow) rows is known: broadcast up to `most` of them, joined by a shuffle beyond."""
    return F.broadcast(df) if rows <= most else df


def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Bound the rows of one Arrow batch, and its bytes if `size` is given, so that a run of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def by_batch(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], rows: int = 1000) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession, rows)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn(b)
                yield pa.RecordBatch.from_arrays([_array(got[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (pa.Array, pa.ChunkedArray)):
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns of the input never meet an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
