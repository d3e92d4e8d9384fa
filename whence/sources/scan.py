"""Ids of source rows, and reading source rows again by id.

A Parquet row's id is (code of its file) << 35 | its row index, both independent of how the scan is split, so ids stay the same when a lost part
is computed again, and only files that hold wanted rows are read again. A file's code is a 28-bit hash of its path under
a seed chosen so that no two files of the scan share a code; with too many files for that, the id is a 64-bit hash of path and
row index, and the files that hold wanted rows are found by a scan that reads no column. Rows of other sources (text, CSV, JSON, ORC, cached or local rows) are numbered directly above the scan, by split and
place in it. These ids hold as long as the splits do: the files and the settings that decide about splits are remembered, and reading rows by id again under others is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from xxhash import xxh64_intdigest as xxh64
except ImportError:
    xxh64 = None

ROW_BITS, FILE_BITS, MOST_FILES = 35, 28, 10_000
#: Ids up to which a frontier is a literal list in the filter; files up to which a filter names them.
LITERALS, MOST_NAMED = 2000, 5000


#: Settings that decide how files are cut into the tasks of a scan.
SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionNum", "spark.sql.leafNodeDefaultParallelism")


class ChangedSplitsError(RuntimeError):
    """Rows of a source without lasting ids were to be read under other splits than those of capture."""


def splits_of(base: DataFrame) -> tuple:
    """What the numbering of a scan's rows rests on: its files, their sizes and times, and the settings that cut them."""
    spark = base.sparkSession
    if not (files := sorted(base.inputFiles())):
        return ()
    path = spark._jvm.org.apache.hadoop.fs.Path
    stats = [path(spark._jvm.java.net.URI(f)) for f in files]
    stats = [p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p) for p in stats]
    return (*[(f, x.getLen(), x.getModificationTime()) for f, x in zip(files, stats, strict=True)], *[spark.conf.get(k, None) for k in SPLITS], spark.sparkContext.defaultParallelism)


@dataclass(eq=False)
class Source:
    """A scan: its rows, the expression of their ids, the columns that the query used, the files by code, and whether ids come from files and row indices."""

    base: DataFrame
    ident: Column
    used: list[str]
    path: str | None
    files: dict[int, str] | None = None
    by_file: bool = False
    splits: tuple = ()

    def __post_init__(self) -> None:
        if self.path is not None and not self.by_file:
            self.splits = splits_of(self.base)

    def _files_of(self, ids: DataFrame | list[int]) -> list[str] | None:
        """The files that hold these ids; None if they are too many to be named in a filter."""
        if self.files is not None:
            if len(self.files) < 2:
                return None  # nothing to leave out
            if isinstance(ids, DataFrame):
                codes = [r["code"] for r in ids.select(F.shiftright("id", ROW_BITS).alias("code")).distinct().limit(MOST_NAMED + 1).collect()]
            else:
                codes = sorted({i >> ROW_BITS for i in ids})
            return [self.files[c] for c in codes if c in self.files] if len(codes) <= MOST_NAMED else None
        table = ids if isinstance(ids, DataFrame) else self.base.sparkSession.createDataFrame([(i,) for i in ids], "id long")
        named = self.base.select(F.col("_metadata.file_path").alias("path"), self.ident.alias("id"))  # reads no column, only how many rows there are
        paths = [r["path"] for r in named.join(table, "id", "left_semi").select("path").distinct().limit(MOST_NAMED + 1).collect()]
        return paths if len(paths) <= MOST_NAMED else None

    def rows(self, ids: DataFrame | Sequence[int], full: bool = False, prune: bool = True, keep_id: str | None = None) -> DataFrame:
        """The source rows with these ids. `ids`: a list, or a table with one column, id."""
        if self.splits and splits_of(self.base) != self.splits:
            raise ChangedSplitsError(f"{self.path}: its files or the settings that split them changed since capture")
        df, name = self.base, keep_id or "__id"
        columns = [F.col(f"`{c}`") for c in (self.base.columns if full else self.used)]
        known = None if isinstance(ids, DataFrame) else list(ids)
        if prune and self.by_file and (files := self._files_of(ids if known is None else known)) is not None:
            df = df.filter(F.col("_metadata.file_path").isin(files))
        df = df.select(*columns, self.ident.alias(name))
        if known is None:
            df = df.join(ids.withColumnRenamed("id", name), name, "left_semi")
        elif len(known) <= LITERALS:
            df = df.filter(F.col(name).isin(known))
        else:
            few = df.sparkSession.createDataFrame([(i,) for i in known], f"`{name}` long")
            df = df.join(few, name, "left_semi")  # Spark broadcasts it by its size
        order = [c for c in df.columns if c != name]
        return df.select(*[F.col(f"`{c}`") for c in order], *([name] if keep_id else []))


def _codes(spark: SparkSession, paths: list[str], seed: int) -> list[int]:
    """What Spark's expression `_code` gives for these paths; without a job where the hash is at hand."""
    if xxh64 is None:
        rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i long, path string").select("i", _code(F.col("path"), seed).alias("code")).collect()
        return [r["code"] for r in sorted(rows)]
    second = seed.to_bytes(4, "little")
    return [xxh64(second, xxh64(p.encode(), 42)) & ((1 << FILE_BITS) - 1) for p in paths]


def _code(path: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(path, F.lit(seed)), F.lit(1 << FILE_BITS))


def parquet_ident(base: DataFrame) -> tuple[Column, dict[int, str] | None]:
    spark = base.sparkSession
    jvm = spark._jvm
    paths = sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p)).toString() for p in base.inputFiles())  # as _metadata.file_path has them
    if len(paths) <= MOST_FILES:
        for seed in range(64):
            files = dict(zip(_codes(spark, paths, seed) if paths else [], paths, strict=True))
            if len(files) == len(paths):
                return F.shiftleft(_code(F.col("_metadata.file_path"), seed), ROW_BITS) + F.col("_metadata.row_index"), files
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")), None
