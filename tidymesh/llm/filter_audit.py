"""What each filter removes after any other filters, for every order in which they can be applied, from one CUBE of their failure flags."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import settle, text_or_empty
from tidymesh.llm.exact_dedup import exact_dedup

#: n filters have n! orders of n steps; beyond this many the report itself is what can't be held.
MOST_FILTERS = 7
WHITE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def quality_failures(text: Column) -> dict[str, Column]:
    """The conditions on a text alone: A few words, B repeated words, C many capitals, D a mark of code or markup."""
    words = F.array_remove(F.split(text, WHITE), "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, A to E (whether the document fails the filter), good, toxic: a row for each document.

    A null text counts as empty, a null part as the empty string. E holds for a text that a document with a smaller id has too; rows
    that repeat an id and its text aren't copies of each other, and a null id is neither smaller nor larger than any. A document is good (toxic) if
    any of its label rows has quality (toxic) 1; without label rows it is neither. Other columns, whatever their names, are left out.
    """
    text = text_or_empty("text")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    flagged = own.select("*", *(x.alias(k) for k, x in quality_failures(text).items()))
    flagged = exact_dedup(flagged, keep="smallest").withColumn("E", F.coalesce(F.col("doc_id") > F.col("keep_id"), F.lit(False)))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__of")).agg(F.max(F.col("quality") == 1).alias("__good"), F.max(F.col("toxic") == 1).alias("__toxic"))
    # null ids find no label: they are dealt by their place, as else all of them would go to one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    rows = flagged.select("doc_id", "part", *"ABCDE", spread.alias("__deal")).join(known.withColumn("__zero", F.lit(0).cast("long")), (F.col("doc_id") == F.col("__of")) & (F.col("__deal") == F.col("__zero")), "left")
    return rows.select("part", *"ABCDE", F.coalesce("__good", F.lit(False)).alias("good"), F.coalesce("__toxic", F.lit(False)).alias("toxic"))


def audit_orders(flags: DataFrame, filters: Sequence[str], part: str = "part", lost: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a <name>_lost for each of ``lost``, shapley.

    ``flags``: boolean columns without nulls, a row per document: ``filters`` (one letter each) hold where the document fails; ``lost`` are
    what is counted among the removed. Rows are first counted per part and combination of flags, 2^n cells a part, which map-side
    combination does; the CUBE over flags and part runs on these cells. A row of a grouping set whose flags are all false tells how
    many documents survive that set of filters, and a step is the difference of two of them. Each part gets all n! orders times n
    steps, zeros included; a table without rows gives none. Raises where there are over MOST_FILTERS filters.
    """
    n = len(filters)
    if not 0 < n <= MOST_FILTERS or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, named by one letter each, not {list(filters)}")
    spark, counted = flags.sparkSession, ["n", *lost]
    some = [F.count("*").alias("n"), *(F.count_if(F.col(x)).alias(x) for x in lost)]
    cells = settle(flags.groupBy(F.col(part).alias("part"), *filters).agg(*some), "cells")
    # a row of zeros that passes all filters, so that every part has its row in every grouping set
    zero = cells.select("part", *(F.lit(False).alias(f) for f in filters), *(F.lit(0).cast("long").alias(c) for c in counted)).distinct()
    cube = cells.unionByName(zero).cube("part", *filters).agg(*(F.sum(c).alias(c) for c in counted), F.grouping("part").alias("__all"), *(F.grouping(f).alias(f"__{f}") for f in filters))
    applied = sum((F.when(F.col(f"__{f}") == 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    passed = [~F.coalesce(F.col(f), F.lit(False)) for f in filters]
    survivors = cube.where((F.col("__all") == 0) & F.array_min(F.array(*passed))).select("part", applied.alias("subset"), *counted)
    survivors = settle(survivors, "survivors")  # 2^n rows a part

    def met(rows: DataFrame, subset: str, name: str) -> DataFrame:
        side = survivors.select(F.col("part").alias(f"__part_{name}"), F.col("subset").alias(f"__subset_{name}"), *(F.col(c).alias(f"{name}_{c}") for c in counted))
        return rows.join(side, (F.col("part") == F.col(f"__part_{name}")) & (F.col(subset) == F.col(f"__subset_{name}"))).drop(f"__part_{name}", f"__subset_{name}")

    everything = (1 << n) - 1
    steps = [(s, s | 1 << i, 1 << i, everything & ~(1 << i), f, factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1"))) for i, f in enumerate(filters) for s in range(1 << n) if not s >> i & 1]
    steps = spark.createDataFrame(steps, "before int, after int, alone int, others int, filter string, orders long")
    pairs = survivors.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"before_{c}") for c in counted)).join(F.broadcast(steps), "before")
    pairs = met(met(met(pairs, "after", "after"), "alone", "alone"), "others", "others")
    ends = survivors.select(F.col("part").alias("__p"), "subset", "n").groupBy("__p").agg(F.max(F.when(F.col("subset") == 0, F.col("n"))).alias("__none"), F.max(F.when(F.col("subset") == everything, F.col("n"))).alias("__every"))
    pairs = pairs.join(ends, F.col("part") == F.col("__p"))
    removed = F.col("before_n") - F.col("after_n")
    pairs = pairs.select(
        "part", "filter", "before", "orders", F.col("after_n").alias("kept"), removed.alias("removed"), (F.col("__none") - F.col("alone_n") - removed).alias("redundant"),
        (F.col("others_n") - F.col("__every")).alias("unique_fails"), *((F.col(f"before_{x}") - F.col(f"after_{x}")).alias(f"{x}_lost") for x in lost),
    )
    pairs = settle(pairs, "pairs")
    shares = pairs.groupBy(F.col("part").alias("__p"), F.col("filter").alias("__f")).agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"))
    bit = {f: 1 << i for i, f in enumerate(filters)}
    orders = [("".join(o), k + 1, f, sum(bit[x] for x in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, filter string, before int")
    told = pairs.join(shares, (F.col("part") == F.col("__p")) & (F.col("filter") == F.col("__f"))).join(F.broadcast(orders), ["filter", "before"])
    return told.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{x}_lost" for x in lost), "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``, per source, with what ``labels`` tells of the removed."""
    return audit_orders(failure_flags(docs, labels), "ABCDE")
