"""Contiguous shards of atomic groups with the smallest possible largest shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import number_within, settle, text_or_empty


@dataclass(frozen=True)
class Item:
    """A run of neighbouring groups: those whose key starts with ``prefix``. One group can't be cut. ``side``: how many groups that
    have a shard of their own come before; a shard doesn't go past one."""

    prefix: str
    weight: int
    groups: int
    first: str
    side: int = 0


def greedy_cuts(items: list[Item], capacity: int) -> list[int]:
    """Indexes at which a new shard starts if each takes all that fits on its side; an item over the capacity goes alone."""
    cuts, load, side = [], 0, items[0].side if items else 0
    for i, x in enumerate(items):
        if x.side != side or load and load + x.weight > capacity:
            cuts.append(i)
            load, side = 0, x.side
        load += x.weight
    return cuts


def smallest_capacity(items: list[Item], shards: int) -> int:
    """Binary search for the smallest capacity at which the greedy check needs no more than ``shards`` (at least one a side)."""
    lo = max([1, *(x.weight for x in items)])
    hi = max(lo, sum(x.weight for x in items))
    while lo < hi:
        mid = (lo + hi) // 2
        if len(greedy_cuts(items, mid)) < shards:
            hi = mid
        else:
            lo = mid + 1
    return lo


def unsure(items: list[Item], shards: int, largest: int) -> list[Item]:
    """Items of several groups in which a cut of the best partition may fall.

    The best capacity is at least ``lo`` and, as cutting only between items is allowed too, at most ``hi``.
    On each side, cutting only between items at ``lo`` puts each cut no later than the true one; cutting anywhere at
    ``hi``, no earlier.
    """
    total = sum(x.weight for x in items)
    lo, hi = max(largest, -(-total // shards)), smallest_capacity(items, shards)
    out: list[Item] = []
    for side in sorted({x.side for x in items}):
        own = [x for x in items if x.side == side]
        ends, at = [], 0
        for x in own:
            at += x.weight
            ends.append(at)
        found, start, latest = set(), 0, 0
        for _ in range(shards - 1):
            i, load = start, 0
            while i < len(own) and load + own[i].weight <= lo:
                load += own[i].weight
                i += 1
            start, latest = i, latest + hi
            found.update(k for k in range(start, len(own)) if own[k].groups > 1 and ends[k] - own[k].weight < latest)
            if start >= len(own):
                break
        out += [own[k] for k in sorted(found)]
    return out


def _items(groups: DataFrame, prefixes: list[str], size: int) -> list[Item]:
    if prefixes:
        n = len(prefixes[0])
        groups = groups.where(F.substring("__key", 1, n).isin(prefixes))
    found = groups.groupBy("__side", F.substring("__key", 1, size).alias("p")).agg(F.sum("__w").alias("w"), F.count("*").alias("n"), F.min("__key").alias("k"))
    return sorted((Item(r.p, int(r.w), int(r.n), r.k, r["__side"]) for r in found.collect()), key=lambda x: (x.side, x.prefix))


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """First keys of the shards but the first, in key order.

    ``groups``: __key (32 hex digits, unique), __w. The largest shard can't be smaller than the heaviest group. Groups over their even share
    of what is left have a shard of their own, in place (at most (shards - 1) / 2 of them, so that all that lies between has shards too);
    what is left is cut so that the largest of the other shards is as small as can be. The driver holds sums by key prefix, 4096
    of them (on each side of such a group) and then 256 for each prefix in which a cut may fall, never the groups.
    """
    alone: list[str] = []
    total = groups.agg(F.sum("__w")).first()[0] or 0
    for r in groups.where(F.col("__w") * shards > total).orderBy(F.desc("__w"), "__key").limit((shards - 1) // 2).collect():
        if r["__w"] * (shards - len(alone)) > total:
            alone.append(r["__key"])
            total -= r["__w"]
    alone.sort()
    rest = groups.where(~F.col("__key").isin(alone)) if alone else groups
    rest = rest.withColumn("__side", sum(((F.col("__key") > k).cast("int") for k in alone), F.lit(0)))
    left = shards - len(alone)
    largest = rest.agg(F.max("__w")).first()[0] or 1
    items = _items(rest, [], 3)
    while left > 1 and (open_items := unsure(items, left, largest)):
        for n in sorted({len(x.prefix) for x in open_items}):
            prefixes = sorted({x.prefix for x in open_items if len(x.prefix) == n})
            gone = set(prefixes)
            items = [x for x in items if x.prefix not in gone] + _items(rest, prefixes, n + 2)
        items.sort(key=lambda x: (x.side, x.prefix))
    if not items:
        return alone[1:]
    starts = [0, *greedy_cuts(items, smallest_capacity(items, left))] if left > 1 else [0]
    return sorted([items[i].first for i in starts] + alone)[1:]


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, overhead: int = 8) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard for every row: the law is ``bytes``.

    Size: UTF-8 bytes of the text plus ``overhead``; null texts count as empty. Groups of equal texts (by
    128-bit content hash) stay together and are laid in hash order; a binary search finds the smallest capacity
    that a greedy pass can meet with ``shards`` shards, and the cuts are those of that pass. A group above an
    even share can't be split: it has a shard of its own where it stands, and what lies before and after is cut evenly, so shards are
    ranges of the order always. Slots run
    gapless from 0 in each shard in no stated order; rows with repeated or null ids get slots of their own.
    An empty table gives an empty result. Other columns are left out, so their names can't clash.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("__key")
    )
    rows = settle(rows, "sizes")
    groups = settle(rows.groupBy("__key").agg(F.sum("size").alias("__w")), "groups")
    # a short list of keys, in order: one more shard from each on
    shard = sum(((F.col("__key") >= F.lit(c)).cast("int") for c in minimax_cuts(groups, shards)), F.lit(0))
    n_rows = rows.count()
    buckets = min(4096, max(16, n_rows // (shards * 50_000)))
    placed = number_within(rows.withColumn("shard", shard.cast("int")), "shard", F.col(id_col), "slot", buckets)
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
