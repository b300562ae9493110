"""Documents linked by the Jaccard similarity of their word n-grams, by vertical partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.common import attach_groups, modest_batches, release, settle

#: Bytes of text that are hashed at once, and of whose sets a run is made.
CHUNK, RUN = 1_000_000, 5_000_000
#: An n-gram in this share of the documents is frequent; their number is at most MOST_FREQUENT.
FREQUENT = 1 / 256
MOST_FREQUENT = 200_000
#: N-grams in a fragment of the global order, about.
FRAGMENT = 1_000_000
CLASS_BITS, TOP_CLASS = 58, 31
LOW = np.uint64((1 << CLASS_BITS) - 1)

_rng = np.random.default_rng(20_240_501)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SALT = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, all sets one after the other, each sorted) of 64-bit n-gram hashes.

    ``data``: the texts' UTF-8 bytes, cut at ``offsets``. Words are runs of bytes other than 0x20 and 0x09-0x0D.
    A text of fewer than ``n`` words is one n-gram as a whole; one without words has none.
    """
    docs = len(offsets) - 1
    none = np.zeros(docs, np.int64), np.zeros(0, np.uint64)
    if not len(data):
        return none
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]) | inside & cut[:-1])
    ends = np.flatnonzero(inside & (np.concatenate([blank[1:], [True]]) | cut[1:])) + 1
    if not len(starts):
        return none
    with np.errstate(over="ignore"):
        power = np.full(len(data), _BASE)
        power[0] = 1
        power = np.cumprod(power)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power)])
        back = np.full(len(data), _INVERSE)
        back[0] = 1
        word = mixed((sums[ends] - sums[starts]) * np.cumprod(back)[starts] + (ends - starts).astype(np.uint64))
        owner = np.searchsorted(offsets, starts, "right") - 1
        words = np.bincount(owner, minlength=docs)
        total = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            total += word[k : len(total) + k] * _SALT[k]
        whole = owner[: len(total)] == owner[n - 1 :] if len(total) else np.zeros(0, bool)
        grams, of = mixed(total[whole]), owner[: len(total)][whole]
        few = (words < n)[owner]
        if few.any():
            place = np.arange(len(word)) - (np.cumsum(words) - words)[owner]
            short = np.zeros(docs, np.uint64)
            np.add.at(short, owner[few], word[few] * _SALT[place[few]])
            own = np.flatnonzero((words > 0) & (words < n))
            grams = np.concatenate([grams, mixed(short[own] + words[own].astype(np.uint64) * _SALT[63])])
            of = np.concatenate([of, own])
    order = np.argsort(grams)
    grams, of = grams[order], of[order]
    order = np.argsort(of.astype(np.uint16) if docs < 65_536 else of, kind="stable")
    grams, of = grams[order], of[order]
    fresh = np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])
    return np.bincount(of[fresh], minlength=docs), grams[fresh]


def chunks(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, set sizes, sets) for runs of rows with about CHUNK bytes of text; a longer text is alone. Null: empty."""
    texts = batch.column(1).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        sizes, sets = ngram_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n)
        yield batch.column(0).slice(at, to - at), sizes, sets
        at = to


def runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """As chunks, many put together."""
    held, size = [], 0
    for batch in batches:
        for x in chunks(batch, n):
            held.append(x)
            size += len(x[2])
            if 6 * size > RUN:
                yield together(held)
                held, size = [], 0
    if held:
        yield together(held)
    release()


def together(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, sizes, sets = zip(*held)
    return pa.concat_arrays(ids), np.concatenate(sizes), np.concatenate(sets)


def survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows (id, n) for each document, and rows (gram, seen) for n-grams that are frequent in their chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, sets in runs(batches, n):
            grams, seen = np.unique(sets, return_counts=True)
            often = seen >= max(4, len(ids) * FREQUENT / 2)
            grams, seen = grams[often].view(np.int64), seen[often]
            blank, none = pa.nulls(len(grams), ids.type), pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids, blank]), pa.concat_arrays([pa.array(sizes), pa.nulls(len(grams), pa.int64())]), pa.concat_arrays([none, pa.array(grams)]), pa.concat_arrays([none, pa.array(seen)])], names=["id", "n", "gram", "seen"]
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, gram bigint, seen bigint")


def part(frame: int, heavy: bool, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> tuple:
    own = counts > 0
    return frame, heavy, ids[own].tobytes(), sizes[own].astype(np.int32).tobytes(), counts[own].astype(np.int32).tobytes(), grams.tobytes()


PART = "part int, heavy boolean, ids binary, sizes binary, counts binary, grams binary"


def fragments(docs: DataFrame, n: int, frequent: np.ndarray, number: int) -> DataFrame:
    """Each chunk's sets cut into ``number`` ranges of hashes, a row for each; frequent n-grams apart (heavy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, sets in runs(batches, n):
            key, owner = ids.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            at = np.minimum(np.searchsorted(frequent, sets), max(0, len(frequent) - 1))
            often = frequent[at] == sets if len(frequent) else np.zeros(len(sets), bool)
            rows = []
            if often.any():
                counts = np.bincount(owner[often], minlength=len(sizes))
                rows.append(part(int(key[0]) % number, True, key, sizes, counts, sets[often] & LOW | np.uint64(TOP_CLASS << CLASS_BITS)))
                sets, owner = sets[~often], owner[~often]
            where = ((sets >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(where.astype(np.uint16) if number < 65_536 else where, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
                rows.append(part(int(where[own[0]]), False, key, sizes, np.bincount(owner[own], minlength=len(sizes)), sets[own]))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")]).astype({"part": "int32", "heavy": bool}), preserve_index=False)

    return docs.mapInArrow(run, PART)


def joined(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, set size, n-gram) of all the entries of some rows."""
    counts = np.frombuffer(b"".join(frame["counts"]), np.int32)
    ids, sizes = (np.repeat(np.frombuffer(b"".join(frame[c]), t), counts) for c, t in (("ids", np.int64), ("sizes", np.int32)))
    return ids, sizes, np.frombuffer(b"".join(frame["grams"]), np.uint64)


def shared_grams(parts: DataFrame, number: int) -> DataFrame:
    """The entries whose n-gram is in two or more documents, dealt anew by document.

    An entry becomes 6 bits of frequency class (the base-2 logarithm of the number of documents, the last class
    for frequent ones) over 58 bits of hash: in this order the rare come first, and it is the same for all documents.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, grams = joined(frame[~frame["heavy"]])
        order = np.argsort(grams)
        ids, sizes, grams = ids[order], sizes[order], grams[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(grams)))
        level = np.minimum(np.log2(np.maximum(df, 1)).astype(np.uint64), np.uint64(TOP_CLASS - 1))
        kept = np.repeat(df >= 2, df)
        grams = (grams & LOW | np.repeat(level, df) << np.uint64(CLASS_BITS))[kept]
        more = joined(frame[frame["heavy"]])
        ids, sizes, grams = (np.concatenate(x) for x in zip((ids[kept], sizes[kept], grams), more))
        order = np.argsort(ids, kind="stable")
        ids, sizes, grams = ids[order], sizes[order], grams[order]
        rows = []
        for b in range(number):
            own = np.flatnonzero(ids % number == b)
            if len(own):
                at = np.flatnonzero(np.concatenate([[True], np.diff(ids[own]) != 0]))
                rows.append((b, False, ids[own][at].tobytes(), sizes[own][at].tobytes(), np.diff(np.append(at, len(own))).astype(np.int32).tobytes(), grams[own].tobytes()))
        release()
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PART.split(", ")]).astype({"part": "int32", "heavy": bool})

    return parts.groupBy("part").applyInPandas(run, PART)


@dataclass(frozen=True)
class Limit:
    """intersection * den >= num * union."""

    num: int
    den: int

    def least(self, n: np.ndarray) -> np.ndarray:
        """Fewest n-grams that a set of ``n`` has in common with a similar one."""
        return -(-n * self.num // self.den)


def survivors(parts: DataFrame, limit: Limit) -> DataFrame:
    """(id, n, c, core, grams) of the documents that share enough n-grams, with whomever, to be similar to one.

    grams: the c shared ones in the global order; the n - c others are in no other document and come before.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sizes, grams = joined(frame)
        order = np.lexsort((grams, ids))
        ids, sizes, grams = ids[order], sizes[order], grams[order]
        at = np.flatnonzero(np.concatenate([[True], np.diff(ids) != 0])) if len(ids) else np.zeros(0, np.int64)
        counts = np.diff(np.append(at, len(ids)))
        own = counts >= limit.least(sizes[at].astype(np.int64))
        sets = [grams[a : a + c].view(np.int64) for a, c in zip(at[own], counts[own])]
        return pd.DataFrame({"id": ids[at[own]], "n": sizes[at[own]].astype(np.int64), "c": counts[own], "core": [hashlib.md5(x.tobytes()).hexdigest() for x in sets], "grams": sets})

    return parts.groupBy("part").applyInPandas(run, "id bigint, n bigint, c bigint, core string, grams array<bigint>")


def similar(limit: Limit, both: Column, a: Column, b: Column) -> Column:
    return both * limit.den >= (a + b - both) * limit.num


def near_sizes(limit: Limit, a: str, b: str) -> Column:
    return F.least(a, b) * limit.den >= F.greatest(a, b) * limit.num


def segments(sets: DataFrame) -> DataFrame:
    """(id, fragment, grams): each set cut at four places of the global order, empty fragments left out."""
    cuts = [0, 3 << (CLASS_BITS - 1), 2 << CLASS_BITS, 5 << CLASS_BITS, (1 << 63) - 1]

    def between(lo: int, hi: int) -> Column:
        return F.filter("grams", lambda g: (g >= lo) & (g < hi))

    each = F.array(*(F.struct(F.lit(k).alias("fragment"), between(lo, hi).alias("grams")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))
    return sets.select("id", F.explode(each).alias("x")).select("id", "x.fragment", "x.grams").where(F.size("grams") > 0)


def overlaps(pairs: DataFrame, cut: DataFrame, limit: Limit) -> DataFrame:
    """The similar ones of ``pairs`` (a, b, na, nb): overlaps counted in each fragment on its own, then summed per pair."""
    met = pairs.join(cut.select(F.col("id").alias("a"), "fragment", F.col("grams").alias("ga")), "a")
    met = met.join(cut.select(F.col("id").alias("b"), "fragment", F.col("grams").alias("gb")), ["b", "fragment"])
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("common"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.where(similar(limit, F.col("common"), F.col("na"), F.col("nb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each linked id reaches. Least labels go along links and are then followed
    to the label of the label, so the rounds grow with the logarithm of the longest path; each is settled."""
    both = settle(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp"))
    labels = settle(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("seen")), "b").groupBy("a").agg(F.min("seen").alias("seen"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("comp").alias("old"), F.least("comp", "seen").alias("comp"))
        after = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        step = settle(step.join(after, "comp", "left").select("id", "old", F.least("comp", "next").alias("comp")), "labels")
        moved = step.where("comp <> old").limit(1).count()
        labels = step.select("id", "comp")
        if not moved:
            return labels


def prefixes(nodes: DataFrame, limit: Limit) -> DataFrame:
    """(gram, id, n, u, place): the shared n-grams in each set's prefix, one of which any similar set's prefix has.

    u: how many n-grams are in no other document; these come first in the set, so ``place`` counts from u.
    """
    least = F.floor((F.col("n") * limit.num + limit.den - 1) / limit.den).cast("int")
    u = (F.col("n") - F.col("c")).cast("int")
    length = F.col("n").cast("int") - least + 1 - u
    return nodes.select("id", "n", u.alias("u"), F.posexplode(F.slice("grams", F.lit(1), length)).alias("k", "gram")).select("gram", "id", "n", "u", (F.col("u") + F.col("k")).alias("place"))


def similar_links(nodes: DataFrame, limit: Limit) -> DataFrame:
    """(id, comp) of the nodes that are in one component with another.

    First each prefix n-gram's documents are held against its hub, the one with the fewest n-grams of its own:
    that takes as many pairs as there are prefix entries, and joins nearly all that belong together. Then all
    pairs are made that share a prefix n-gram, whose places in it leave enough common n-grams, and that are still
    in different components; none within a component is.
    """
    entries = settle(prefixes(nodes, limit).withColumn("key", F.col("gram").cast("string")), "prefixes")
    cut = settle(segments(nodes), "segments")
    hubs = entries.groupBy("key").agg(F.min(F.struct("u", "n", "id")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    met = attach_groups(entries, settle(hubs, "hubs"), "key", "size", entries.count(), F.col("id"))
    pairs = met.where("hub.id <> id").select(F.col("id").alias("a"), F.col("hub.id").alias("b"), F.col("n").alias("na"), F.col("hub.n").alias("nb"))
    pairs = pairs.where(near_sizes(limit, "na", "nb")).distinct()
    links = settle(overlaps(pairs, cut, limit), "links")
    comps = components(links)

    known = entries.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = known.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram")
    # the grams are one row each, so the entries' side may be dealt in parts
    rest = settle(known.join(split, "gram").select("gram", "id", "n", "place", "comp"), "rest")
    x, y = (rest.select("gram", *(F.col(c).alias(f"{c}{s}") for c in ("id", "n", "place", "comp"))) for s in "ab")
    left = F.least(F.col("na") - F.col("placea"), F.col("nb") - F.col("placeb"))
    new = x.join(y, "gram").where((F.col("ida") < F.col("idb")) & (F.col("compa") != F.col("compb")) & near_sizes(limit, "na", "nb") & similar(limit, left, F.col("na"), F.col("nb")))
    new = new.select(F.col("ida").alias("a"), F.col("idb").alias("b"), "na", "nb").distinct()
    more = settle(overlaps(new, cut, limit), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else comps


def core_classes(found: DataFrame, limit: Limit) -> DataFrame:
    """``found`` plus rep: the row of the same shared n-grams that stands for it, or itself.

    Two sets with the same c shared n-grams have just those in common, so their similarity follows from their
    sizes, and no set is closer to the larger than to the smaller of them. Each links to the smallest of its core,
    and then stands back for it, or else stays as it is.
    """
    first = found.groupBy("core").agg(F.min(F.struct("n", "id")).alias("first"), F.count("*").alias("size")).where("size > 1")
    met = attach_groups(found, settle(first, "cores"), "core", "size", found.count(), F.col("id"))
    alike = F.col("first").isNotNull() & similar(limit, F.col("c"), F.col("n"), F.col("first.n"))
    return met.select(*found.columns, F.when(alike, F.col("first.id")).otherwise(F.col("id")).alias("rep"))


def frequent_grams(seen: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes of n-grams that are in about FREQUENT of the documents or more: they bring order, not results, so a
    bound on their number (the most frequent ones stay) costs time at most."""
    rows = seen.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(8.0, n_docs * FREQUENT / 2))
    top = rows.orderBy(F.desc("seen"), "gram").limit(MOST_FREQUENT).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def jaccard_components(docs: DataFrame, num: int = 3, den: int = 4, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row: the smallest id that it reaches by links, itself included.

    Two documents link when den * intersection >= num * union of their sets of ``n``-word n-grams (A-Z in lower
    case, words cut at 0x20 and 0x09-0x0D). A text of fewer words is one n-gram as a whole; null, empty and blank
    texts have none and link with nothing.

    The global order of n-grams (by frequency class, then hash) is cut into fragments. Each is counted on its own:
    n-grams of one document fall away, and with them all documents that share too few to be similar to any other.
    Of the rest, documents with the same shared n-grams are taken together, candidates come from prefixes in the
    global order, and their overlaps are counted per fragment and summed per pair. n-grams are told apart by 64-bit
    hashes, among survivors by 58 bits within a frequency class. N-grams of a large share of the documents are
    known beforehand, so no fragment gathers them.

    Rows that repeat an id, and null ids, are told apart by ids of our own, for which the table is written once; a
    component's id is then the smallest id in it that is not null, if any is. An empty table gives an empty result.
    Only the id is kept of the other columns, so their names can't clash.
    """
    spark, limit = docs.sparkSession, Limit(num, den)
    modest_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = settle(survey(rows, n), "survey")
    sizes = seen.where("n IS NOT NULL").select("id", "n")
    own = None
    if rows.schema["id"].dataType.simpleString() != "bigint" or sizes.groupBy("id").count().where("count > 1 OR id IS NULL").limit(1).count():
        rows = settle(rows.withColumn("own", F.col("id")).withColumn("id", F.monotonically_increasing_id()), "numbered")
        own = rows.select("id", "own")
        seen = settle(survey(rows.select("id", "text"), n), "survey")
        sizes = seen.where("n IS NOT NULL").select("id", "n")
        rows = rows.select("id", "text")
    total = sizes.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("grams")).first()
    frequent = frequent_grams(seen, total.docs)
    number = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total.grams // FRAGMENT + 1)
    found = settle(survivors(shared_grams(fragments(rows, n, frequent, number), number), limit), "survivors")
    classed = settle(core_classes(found, limit), "classes")
    comps = similar_links(classed.where("id = rep").drop("rep", "core"), limit)
    members = classed.select("id", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    members = settle(members, "members")
    if own is not None:
        members = members.join(own, "id")
    least = F.min("id" if own is None else "own")
    groups = members.groupBy("comp").agg(least.alias("component_id"), F.count("*").alias("size")).withColumn("comp", F.col("comp").cast("string"))
    placed = attach_groups(members.withColumn("comp", F.col("comp").cast("string")), settle(groups, "components"), "comp", "size", total.docs, F.col("id")).select("id", "component_id")
    out = sizes.join(placed, "id", "left")
    if own is not None:
        out = out.join(own, "id")
    shown = F.col("id" if own is None else "own")
    return out.select(shown.alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", shown).alias("component_id"))
