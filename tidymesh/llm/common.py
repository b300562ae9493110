"""Pieces that several corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidymesh.plans.storage import settle, shared_dir  # noqa: F401  the operators take settle from here


#: Rows of a few short columns that may be broadcast: as they are, and after a count shows that they are hot.
FEW, MOST = 50_000, 1_000_000
#: Rows that one key may bring to a task.
HOT = 50_000


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, spread: Column, few: int = FEW) -> DataFrame:
    """Left-join ``groups`` (settled; unique string ``key``, ``size`` rows in each) to ``rows`` without one task per hot key.

    Up to ``few`` groups are broadcast as they are. Of more, those of HOT rows (of fewer where there are under 1000 * HOT rows in all)
    are broadcast: they are at most MOST, as beyond MOST * HOT rows only keys of the share 1 / MOST are hot. All others meet in a
    shuffle join, where rows that are already answered are dealt by ``spread``.
    """
    least = max(min(n_rows / 1000, HOT), n_rows / MOST)
    others = [c for c in groups.columns if c != key]
    if groups.count() <= few:
        return rows.join(F.broadcast(groups), key, "left").select(*rows.columns, *others)
    hot = groups.where(F.col(size) >= least).select(F.col(key), F.struct(*others).alias("__hot"))
    cold = groups.where(F.col(size) < least).select(F.col(key).alias("__key"), F.struct(*others).alias("__cold"))
    met = rows.join(F.broadcast(hot), key, "left")
    met = met.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("~"), F.xxhash64(spread).cast("string"))))
    met = met.join(cold, "__key", "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    return met.select(*rows.columns, *(F.col("__found")[c].alias(c) for c in others))


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Fewer rows in the Arrow batches of this session, unless their number was set: texts are long rows, and a batch is
    held several times over by the executor and its workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def release() -> None:
    """Give a worker's unused memory back: workers are kept between tasks, and with them what they once needed."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def number_within(rows: DataFrame, group: str, tie: Column, name: str, buckets: Column | int, dealt: int = 0) -> DataFrame:
    """Add ``name``: the row's place in its ``group``, gapless from 0, with no task per group.

    ``rows`` must be settled. Rows are dealt to ``buckets`` parts of each group by a hash of ``tie``; the offsets of
    the parts are broadcast, a row each, so the caller lets a part be of many rows. ``dealt``: how many tasks the parts go to, if
    the session's number would make them too large.
    """
    cut = rows.withColumn("__b", F.pmod(F.xxhash64(tie), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int"))
    counts = cut.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group), "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    if dealt > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        cut = cut.repartition(dealt, group, "__b")
    placed = cut.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy(tie)))
    placed = placed.join(F.broadcast(offsets), [group, "__b"])
    return placed.select(*rows.columns, (F.col("__r") - 1 + F.col("__before")).cast("long").alias(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, both: Callable[[Column, Column], Column], first: Column) -> Column:
    """The array of ``both`` over all values up to each place (``first`` changes nothing): in round k each place takes in
    what the place 2**k before it has, so the time is n log n."""

    def step(x: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(x, F.concat(F.array_repeat(first, far), F.slice(x, F.lit(1), F.size(x) - far)), both)

    def scan(x: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1)
        return F.when(F.size(x) > 1, F.aggregate(rounds, x, step)).otherwise(x)

    return let(values, scan)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and their names by original name, so that no column can clash with ours."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def renamed(df: DataFrame, names: dict[str, str], new: dict[str, Column]) -> DataFrame:
    """The columns of ``numbered`` under their own names, but for those that ``new`` replaces, then ``new``."""
    return df.select(*(F.col(c).alias(name) for name, c in names.items() if name not in new), *(x.alias(name) for name, x in new.items()))
