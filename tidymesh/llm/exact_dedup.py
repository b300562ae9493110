"""Exact duplicates by 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import attach_groups, numbered, renamed, settle, text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """All rows and columns of ``docs`` plus keep_id, group_size, kept, text_sha256 (which replace columns so named).

    Rows are grouped by the 128-bit hash of their text, so only hashes are shuffled. Only texts of groups of two or more are compared: a
    hash aggregate by (hash, text), whose keys Spark compares as bytes and in which copies collapse before the shuffle. Where all texts of
    a group are equal, as in all but collisions, its rows look it up by the hash, hot groups by a bounded broadcast, so no task gets
    one. Rows of a hash with several texts look up theirs by hash and text.

    Null texts count as empty, so null and empty texts are copies of each other. ``keep``: the smallest or the
    largest id stays; null ids stay only where a group has no other id. Rows that repeat id and text are one
    document told twice: all of them are kept or none. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep!r}")
    best = F.min if keep == "smallest" else F.max
    docs, names = numbered(docs)
    row_id, text = F.col(names[id_col]), text_or_empty(names[text_col])
    rows = docs.withColumn("__h", digest(text))
    some = [F.count("*").alias("__n"), best(row_id).alias("__keep")]
    groups = settle(rows.groupBy("__h").agg(*some).where("__n > 1"), "copies")
    n_rows = groups.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]  # in groups, so hot ones are few
    alike = attach_groups(rows.select(row_id.alias(names[id_col]), F.col(names[text_col]), "__h"), groups.select("__h", "__n"), "__h", "__n", n_rows, row_id).where("__n IS NOT NULL")
    texts = alike.drop("__n").withColumn("__t", text).groupBy("__h", "__t").agg(*some)
    mixed = settle(texts.select("__h").groupBy("__h").agg(F.count("*").alias("__texts")).where("__texts > 1"), "collisions")
    found = attach_groups(rows, groups, "__h", "__n", n_rows, row_id)
    if mixed.limit(1).count():
        own = texts.join(mixed, "__h").select(F.col("__h").alias("__h2"), "__t", F.struct("__n", "__keep").alias("__own"))
        found = found.join(own, (F.col("__h") == F.col("__h2")) & (text == F.col("__t")), "left")
        found = found.withColumn("__n", F.coalesce("__own.__n", "__n")).withColumn("__keep", F.when(F.col("__own").isNull(), F.col("__keep")).otherwise(F.col("__own.__keep")))
    keep_id = F.when(F.col("__n").isNull(), row_id).otherwise(F.col("__keep"))
    new = {"keep_id": keep_id, "group_size": F.coalesce("__n", F.lit(1)).cast("long"), "kept": row_id.eqNullSafe(keep_id), "text_sha256": F.sha2(text, 256)}
    return renamed(found, names, new)
