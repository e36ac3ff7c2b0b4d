"""Helpers that the training-data operators share.

``row_ids`` stamps ``monotonically_increasing_id`` on a scan. The number
follows from the file splits, and these from the cores and settings at the
time of the scan, so two scans of one table need not agree on it. What is
joined by it later is therefore written with it once (``numbered``), or
numbered by file and place in the file, on which all scans agree (``placed``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
MAX_FILES = 100_000
FILE_ROWS = 1 << 33


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(c: Column | str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write below the shared checkpoint folder, read again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(df: DataFrame, table: str, name: str = "row_id") -> DataFrame:
    """df with row ids, written with them: every later scan has the same."""
    return written(row_ids(df, name), table)


def placed(df: DataFrame, table: str, name: str = "row_id") -> DataFrame:
    """df with row ids that every later scan has too.

    Rows of Parquet files are numbered by the file (in order of the paths) and
    the row in it, and nothing is written. Rows from elsewhere, and those of
    more than ``MAX_FILES`` files, whose numbers are not broadcast, are
    written with their ids.
    """
    try:
        if "_metadata" in df.columns:
            return numbered(df, table, name)
        at = df.withColumns({"__path": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})
    except AnalysisException:  # not a scan of Parquet files
        return numbered(df, table, name)
    paths = sorted(r[0] for r in at.select("__path").distinct().limit(MAX_FILES + 1).collect())
    if len(paths) > MAX_FILES:
        return numbered(df, table, name)
    files = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(paths)], "__path string, __file long")
    return at.join(F.broadcast(files), "__path").withColumn(name, F.col("__file") * FILE_ROWS + F.col("__at")).drop(
        "__path", "__at", "__file")


def remainder(c: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n
