"""Tables from values, grids and files."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidymesh.expr import Expr
from tidymesh.table import Table, add_pipe, as_table


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _vector(x: Any) -> list[Any]:
    if isinstance(x, Expr):
        raise ValueError("values, not expressions of a table")
    return list(x) if isinstance(x, Iterable) and not isinstance(x, (str, bytes)) else [x]


def df_make(**columns: Any) -> DataFrame:
    """A table of vectors; single values are repeated to the length of the longest."""
    vectors = {k: _vector(v) for k, v in columns.items()}
    longest = max(map(len, vectors.values()), default=0)
    if wrong := [k for k, v in vectors.items() if len(v) not in (1, longest)]:
        raise ValueError(f"lengths of {wrong} are neither 1 nor {longest}")
    rows = list(zip(*(v if len(v) == longest else v * longest for v in vectors.values())))
    return _session().createDataFrame(rows, list(vectors))


def df_grid(**columns: Any) -> DataFrame:
    """All combinations of the vectors' values, made on the executors: only the vectors go there."""
    out = _session().range(1).select()
    if not columns:
        return out.limit(0)
    for k, v in columns.items():
        out = out.withColumn(k, F.explode(F.array(*(F.lit(x) for x in _vector(v)))))
    return out


def df_equal(df1: Any, df2: Any, close: bool = False, precision: int = 3) -> bool:
    """Whether two tables have the same columns and rows, in any order; ``close``: doubles up to ``precision`` digits."""
    a, b = as_table(df1).df, as_table(df2).df
    if sorted(a.columns) != sorted(b.columns):
        return False
    names = sorted(a.columns)

    def plain(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select(*(F.round(f"`{c}`", precision).alias(c) if close and kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in names))

    a, b = plain(a), plain(b)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def read_csv(path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; give the schema where you know it, as finding it reads the file once more."""
    reader = _session().read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_parquet(path: str) -> DataFrame:
    return _session().read.parquet(path)


def write(df: Any, path: str, kind: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """A table to files of Spark's formats."""
    out = as_table(df).df.write.mode(mode).format(kind)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def find_files(path: str, ext: str, recursive: bool = False) -> DataFrame:
    """(path, length) of files of an extension, listed by Spark, so in any store that it reads."""
    files = _session().read.format("binaryFile").option("pathGlobFilter", f"*.{ext.lstrip('.')}").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", "length")


def nan_to_null(df: Any) -> Table:
    """NaN in float columns as NULL, the one missing value of all verbs."""
    return as_table(df, nan_to_null=True)


tf_nan_to_null = add_pipe(nan_to_null)
