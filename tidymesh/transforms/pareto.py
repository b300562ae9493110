"""Pareto fronts of any number of costs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidymesh.plans.storage import settle
from tidymesh.table import Table, add_pipe, flatten, named, verb


def _best(x: np.ndarray) -> np.ndarray:
    """Rows that none betters (weakly in all, strictly in one); copies stay together. Sorted by sum, a row can only be
    bettered by an earlier one, and then by one that stays."""
    order = np.argsort(x.sum(axis=1), kind="stable")
    kept: list[int] = []
    front = np.empty((0, x.shape[1]))
    for i in order:
        if len(front) and ((front <= x[i]).all(axis=1) & (front < x[i]).any(axis=1)).any():
            continue
        kept.append(i)
        front = np.vstack([front, x[i]])
    return np.array(sorted(kept), int)


#: Cells of the grid in all, and points of a block that is held against others at once.
CELLS, BLOCK = 1024, 4096


def thin(df: DataFrame, names: list[str]) -> DataFrame:
    """The distinct best rows, with their number __n, settled; the front stays spread over tasks, whatever its size.

    Copies are counted first, and each task thins what it reads. Two costs then go by range partitions of the first: a row stays if its second
    cost is below all before it. More costs go by a grid of even quantiles: a cell all of whose coordinates are above those of an occupied one is left out
    unseen, and what remains meets in blocks of points, only where the one's cell is nowhere above the other's.
    """
    counted = df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names)).dropna().groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias("__n"))
    costs = [F.col(f"`{c}`") for c in names]
    if len(names) == 1:
        return settle(counted.join(F.broadcast(counted.agg(F.min(costs[0]).alias("__least"))), costs[0] == F.col("__least")).drop("__least"), "front")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.iloc[_best(f[names].to_numpy(float))]

    local = settle(counted.mapInPandas(run, counted.schema), "local-fronts")
    return _staircase(local, names) if len(names) == 2 else _by_cells(local, names)


def _staircase(df: DataFrame, names: list[str]) -> DataFrame:
    """Of two costs: of rows with one first cost the least second one, if that is below those of all lesser first costs."""
    x, y = (F.col(f"`{c}`") for c in names)
    steps = df.groupBy(x.alias("__x")).agg(F.min(F.struct(y.alias("y"), F.col("__n").alias("n"))).alias("__m"))
    dealt = settle(steps.repartitionByRange("__x").withColumn("__part", F.spark_partition_id()), "steps")
    low = dealt.groupBy("__part").agg(F.min("__m.y").alias("__low"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    low = low.select(F.col("__part").alias("__p"), F.min("__low").over(before).alias("__before"))  # a row for each partition
    within = Window.partitionBy("__part").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.join(F.broadcast(low), F.col("__part") == F.col("__p")).withColumn("__least", F.least("__before", F.min("__m.y").over(within)))
    kept = met.where(F.col("__least").isNull() | (F.col("__m.y") < F.col("__least")))
    return settle(kept.select(F.col("__x").alias(names[0]), F.col("__m.y").alias(names[1]), F.col("__m.n").alias("__n")), "front")


def _by_cells(df: DataFrame, names: list[str]) -> DataFrame:
    spark, d = df.sparkSession, len(names)
    each = max(2, int(CELLS ** (1 / d)))
    shares = [(i + 1) / each for i in range(each - 1)]
    ends = df.agg(*(F.percentile_approx(F.col(f"`{c}`"), shares, 1000).alias(f"q{i}") for i, c in enumerate(names))).first()
    if ends[0] is None:
        return df
    place = F.lit(0).cast("long")
    for q, c in zip(ends, names):
        cuts = sorted(set(q))
        # how many cuts a value is above: of two values with other places the one with the lesser place is less
        at = sum((F.when(F.col(f"`{c}`") > x, 1).otherwise(0) for x in cuts), F.lit(0))
        place = place * each + at
    rows = settle(df.withColumn("__cell", place), "cells")
    held = [r[0] for r in rows.select("__cell").distinct().collect()]  # at most CELLS
    at = np.array([[c // each ** (d - 1 - k) % each for k in range(d)] for c in held])
    open_ = [i for i in range(len(held)) if not (at < at[i]).all(axis=1).any()]
    near = [(int(held[i]), int(held[j])) for i in open_ for j in open_ if (at[j] <= at[i]).all()]
    near = spark.createDataFrame(near, "cell long, other long")
    kept = rows.where(F.col("__cell").isin([held[i] for i in open_]))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cell = f["__cell"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(f)]])
            for a, b in zip(cuts, cuts[1:]):
                for k in range(a, b, BLOCK):
                    x = f.iloc[k : min(k + BLOCK, b)]
                    x = x.iloc[_best(x[names].to_numpy(float))]
                    yield pd.DataFrame({"cell": [int(cell[a])], "n": [len(x)], "points": [x[names].to_numpy(float).tobytes()], "copies": [x["__n"].to_numpy(np.int64).tobytes()]})

    blocks = kept.repartitionByRange("__cell").sortWithinPartitions("__cell").mapInPandas(pack, "cell bigint, n int, points binary, copies binary")
    blocks = settle(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    others = blocks.select(F.col("cell").alias("other"), F.col("n").alias("m"), F.col("points").alias("with"), F.col("block").alias("by"))
    pairs = blocks.select("block", "cell", "n", "points").join(F.broadcast(near), "cell").join(others, "other").where("block <> by")

    def beaten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                x, y = np.frombuffer(r.points).reshape(-1, d), np.frombuffer(r[f.columns.get_loc("with") + 1]).reshape(-1, d)
                worse = np.zeros(len(x), bool)
                for k in range(0, len(x), 256):
                    part = x[k : k + 256, None]
                    worse[k : k + 256] = ((y[None] <= part).all(axis=2) & (y[None] < part).any(axis=2)).any(axis=1)
                if worse.any():
                    yield pd.DataFrame({"block": r.block, "at": np.flatnonzero(worse)})

    gone = pairs.select("block", "points", "with").mapInPandas(beaten, "block bigint, at bigint").distinct()

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                x = pd.DataFrame(np.frombuffer(r.points).reshape(-1, d), columns=names)
                yield x.assign(__n=np.frombuffer(r.copies, np.int64), __block=r.block, __at=np.arange(len(x)))

    kind = ", ".join([*(f"`{c}` double" for c in names), "__n bigint, __block bigint, __at bigint"])
    points = blocks.select("block", "points", "copies").mapInPandas(unpack, kind)
    left = points.join(gone, (F.col("__block") == F.col("block")) & (F.col("__at") == F.col("at")), "left_anti")
    return settle(left.drop("__block", "__at"), "front")


@verb
def tran_pareto(df: Table, *costs: Any, name: str = "optimal") -> Table:
    """``name``: True for rows that no other row matches or betters in all costs; a copy makes both False."""
    names = [named(c) for c in flatten(costs)]
    front = thin(df.df, names).where("__n = 1").select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)), F.lit(True).alias("__best"))
    on = [F.col(f"`{c}`").cast("double") == F.col(f"__{i}") for i, c in enumerate(names)]
    met = df.df.join(front, on, "left")
    return df.to(met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.coalesce("__best", F.lit(False)).alias(name)))


def strata(df: DataFrame, names: list[str], max_depth: int) -> DataFrame | None:
    """The rows of each front, peeled off one after the other, with its number as __depth; None if there is none. Copies never leave."""
    rest = settle(df.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in names)).dropna().groupBy(*(F.col(f"`{c}`") for c in names)).agg(F.count(F.lit(1)).alias("__c")), "stratum")
    found = None
    for depth in range(1, max_depth + 1):
        front = thin(rest.select(*(F.col(f"`{c}`") for c in names)), names).drop("__n")
        layer = front.join(rest, names).where("__c = 1").select(*names, F.lit(depth).cast("double").alias("__depth"))
        if layer.isEmpty():
            break
        found = layer if found is None else found.unionByName(layer)
        rest = settle(rest.join(layer.select(*names), names, "left_anti"), "stratum")
    return found


@verb
def tran_stratum(df: Table, *costs: Any, name: str = "stratum", max_depth: int = 10) -> Table:
    """``name``: which front a row is in when fronts are peeled off one after the other, up to ``max_depth``; missing
    beyond. Copies never leave, as each betters the other weakly, so they and what they dominate have no front."""
    names = [named(c) for c in flatten(costs)]
    found = strata(df.df, names, max_depth)
    if found is None:
        return df.to(df.df.withColumn(name, F.lit(None).cast("double")))
    keys = found.toDF(*(f"__{i}" for i in range(len(names))), "__depth")
    on = [F.col(f"`{c}`").cast("double") == F.col(f"__{i}") for i, c in enumerate(names)]
    met = df.df.join(keys, on, "left")
    return df.to(met.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.col("__depth").alias(name)))


tf_pareto, tf_stratum = add_pipe(tran_pareto), add_pipe(tran_stratum)
