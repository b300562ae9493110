"""Exact quantiles of groups of any size, by selection over counts of values in range partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymesh.plans.storage import settle


def placed_values(df: DataFrame, group: list[str], value: str, copies: str) -> DataFrame:
    """``group``, ``value``, from, upto, all: for each distinct value of a group the copies before it, with it, and of the group.

    Equal values are counted first (copies never move), and the counts are dealt by range of (group, value), so a group may lie in any number of
    partitions. What each partition has of each group, a row for a group and one more for each cut, gives the counts before it. No task or
    buffer holds a group; null keys must be left out by the caller.
    """
    counts = df.groupBy(*group, value).agg(F.sum(copies).alias("n"))
    whole = settle(counts.repartitionByRange(*group, value).withColumn("part", F.spark_partition_id()), "counts")
    sums = whole.groupBy("part", *group).agg(F.sum("n").alias("n"))
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # without groups, a row for each partition
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part").alias("__part"), *(F.col(g).alias(f"__{g}") for g in group), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(every).alias("all"))
    met = whole.join(sums, [F.col(c) == F.col(f"__{c}") for c in ("part", *group)])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return met.select(*group, value, "all", upto.alias("upto"), (upto - F.col("n")).alias("from"))


def exact_quantiles(df: DataFrame, keys: list[str], asks: list[tuple[Column, list[float | Callable[[Column], Column]]]], weight: Column | None = None) -> DataFrame:
    """A row for each group with a known value (one row without ``keys``): the keys as k0, ..., then a column q{i}_{j} for each quantile j of each value i.

    Quantiles go by linear interpolation between the values around their place, as numbers of double precision; a function instead of a share
    takes the number of values and gives the place, from 0, of the value wanted (missing outside). Null values, weights that are null or 0, and rows
    with a null key are left out; NaN is the largest value. ``weight``: whole numbers of copies of a row. The values at the wanted places are found where they lie.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    made = [F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)]
    values = F.array(*(F.struct(F.lit(i).alias("i"), x.cast("double").alias("v")) for i, (x, _) in enumerate(asks)))
    copies = F.lit(1).cast("long") if weight is None else weight.cast("long")
    long = df.select(*made, copies.alias("w"), F.explode(values).alias("x")).select(*ks, "w", "x.i", "x.v")
    for k in [*ks, "v"]:
        long = long.where(F.col(k).isNotNull())
    placed = placed_values(long.where("w > 0"), [*ks, "i"], "v", "w")

    def place(p: float | Callable[[Column], Column]) -> Column:
        return p(F.col("all")) if callable(p) else (F.col("all") - 1) * F.lit(float(p))

    def at(i: int, where: Column) -> Column:
        return (F.col("i") == i) & (F.col("from") <= where) & (where < F.col("upto"))

    wanted = [(i, j, p) for i, (_, ps) in enumerate(asks) for j, p in enumerate(ps)]
    some = []
    for i, j, p in wanted:
        some.append(F.max(F.when(at(i, F.floor(place(p))), F.col("v"))).alias(f"lo{i}_{j}"))
        if not callable(p):
            some += [F.max(F.when(at(i, F.ceil(place(p))), F.col("v"))).alias(f"hi{i}_{j}"), F.max(F.when(F.col("i") == i, place(p))).alias(f"at{i}_{j}")]
    found = placed.groupBy(*ks).agg(*some)

    def between(i: int, j: int, p: float | Callable[[Column], Column]) -> Column:
        lo = F.col(f"lo{i}_{j}")
        if callable(p):
            return lo
        hi, x = F.col(f"hi{i}_{j}"), F.col(f"at{i}_{j}")
        return F.when(lo == hi, lo).otherwise((F.ceil(x) - x) * lo + (x - F.floor(x)) * hi)

    return found.select(*ks, *(between(i, j, p).alias(f"q{i}_{j}") for i, j, p in wanted))
