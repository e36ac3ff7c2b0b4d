"""Reading and writing tables.

Parquet is the table format. Writers publish to a new directory and never
overwrite a path that the same plan reads from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CSV_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"
CSV_NULL = "\\N"
CSV_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str,
               schema: T.StructType | None = None) -> DataFrame:
    """A1: read one table; with a schema nothing is inferred."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, **frames) -> DataFrame:
    """A2: parameterised SQL; values are bound (``:name``), never formatted into the text.

    ``frames`` are DataFrames referenced as ``{name}`` in the text.
    """
    return spark.sql(sql, args=args or None, **frames)


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """A3/A4: cast to a declared schema; absent columns get their default.

    Equivalent of ``ADD COLUMN IF NOT EXISTS .. DEFAULT``: a missing column
    is added with the default, an existing one keeps its values.
    """
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            c = F.col(f.name)
            if f.name in defaults:
                c = F.coalesce(c, F.lit(defaults[f.name]))
        elif f.name in defaults:
            c = F.lit(defaults[f.name])
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a Parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def publish(df: DataFrame, path: str) -> str:
    """Write a changed table to a new path (the caller swaps pointers)."""
    df.write.mode("errorifexists").parquet(path)
    return path


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Distributed CSV export with header; every field quoted, quotes doubled.

    Padding, line breaks and empty text survive; NULL is the mark ``\\N``.
    A file with line breaks is read by one task, so files hold at most
    ``CSV_ROWS`` records. Sorting is kept by the writer per partition;
    ``single_file`` funnels the output through one task and is only for
    small extracts.
    """
    out = df.coalesce(1) if single_file else df
    w = (out.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("nullValue", CSV_NULL).option("emptyValue", "")
         .option("timestampFormat", CSV_TS).option("timestampNTZFormat", CSV_TS))
    if not single_file:
        w = w.option("maxRecordsPerFile", CSV_ROWS)
    w.csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read an export back with its schema (microsecond time stamps kept)."""
    return (spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", CSV_NULL).option("emptyValue", "")
            .option("timestampFormat", CSV_TS).option("timestampNTZFormat", CSV_TS).csv(path))
