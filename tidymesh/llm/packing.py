"""Token sequences packed by bin completion over the histogram of piece lengths."""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidymesh.llm.byte_bpe import load_ranks, slices
from tidymesh.llm.common import modest_batches, number_within, release, settle

Filling = tuple[int, ...]
Pattern = tuple[Filling, int]
#: Fillings of up to so many items are sought by their number of items; steps that a node counts for.
FEW_ITEMS, NODE = 4, 100
#: Pieces that one window ranks, and bytes of pieces that one task is dealt, about.
RANKED, DEALT = 20_000, 32_000_000


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram: bins of like contents are one pattern, so its length doesn't grow with the items."""
    bins: dict[Filling, int] = {}
    room: dict[int, list[Filling]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for space in sorted(x for x in room if x >= size):  # the tightest first
            for filling in room.pop(space):
                fits = min(space // size, -(-left // bins[filling]) if left else 0)
                have = bins.pop(filling)
                full, rest = (have, 0) if not fits else divmod(left, fits)
                full = min(full, have)
                parts = [(filling + (size,) * fits, full)] if fits else [(filling, have)]
                if fits:
                    left -= full * fits
                    over = min(left, fits - 1) if full < have else 0
                    if over:
                        parts.append((filling + (size,) * over, 1))
                        left -= over
                    parts.append((filling, have - full - bool(over)))
                for contents, n in parts:
                    if n:
                        bins[contents] = bins.get(contents, 0) + n
                        if contents not in room.setdefault(capacity - sum(contents), []):
                            room[capacity - sum(contents)].append(contents)
        each = capacity // size
        for contents, n in (((size,) * each, left // each), ((size,) * (left % each), 1 if left % each else 0)):
            if n:
                bins[contents] = bins.get(contents, 0) + n
                if contents not in room.setdefault(capacity - sum(contents), []):
                    room[capacity - sum(contents)].append(contents)
    return list(bins.items())


def widened(bits: int, size: int, times: int, mask: int) -> int:
    """The sums in ``bits`` (a bit for each), with up to ``times`` items of ``size`` added."""
    done = 0
    while done < times:
        step = min(done + 1, times - done)
        bits |= bits << (size * step) & mask
        done += step
    return bits


class Effort:
    """What a search may still spend; ``None`` is without end."""

    def __init__(self, steps: int | None) -> None:
        self.left = math.inf if steps is None else steps

    def spend(self, steps: int = 1) -> bool:
        self.left -= steps
        return self.left >= 0


def fillings(left: np.ndarray, room: int, waste: int, effort: Effort, few: int = FEW_ITEMS) -> Iterator[Filling]:
    """All undominated fillings of ``room`` that waste at most ``waste``, in the order of their waste, their number of items
    (all of more than ``few`` together) and the largest items first, so that small items last longest.

    ``left``: how many items there are of each size. A filling is dominated if an item left out could be added, could take
    the place of a smaller one, or could take the place of several that are together no larger, all within the room: the
    bin would then be as good or better without those smaller items, which may go where the larger one was.
    A part of a filling that is dominated already is not carried on, and sums that the smaller sizes can't reach are
    not tried.
    """
    sizes = [int(x) for x in np.flatnonzero(left[: room + 1])[::-1] if x]
    have = {x: int(left[x]) for x in sizes}
    mask = (1 << (room + 1)) - 1
    upto, small, tail = len(sizes), 0, ()
    sums = Sums(sizes, have, mask)
    for w in range(min(waste, room) + 1):
        # items no larger than the waste have to be in, all of them, or one could be added
        while upto and sizes[upto - 1] <= w:
            upto -= 1
            small += sizes[upto] * have[sizes[upto]]
            if small > room:
                return
            tail += (sizes[upto],) * have[sizes[upto]]
            sums = Sums(sizes[:upto], have, mask)
        rest = room - w - small
        if rest < 0:
            return
        if not rest:
            if not dominated(*added(0, 0, tail), sums.all_of[0], w):
                yield tail
            continue
        if not sums.reached(None)[0] >> rest & 1:
            continue
        for items in (*range(1, few + 1), None):
            for filling, one, more, out in _sought(sums, rest, items, few, w, effort):
                if not dominated(*added(one, more, tail), out, w):
                    yield filling + tail
            if effort.left < 0:
                return


def _sought(sums: Sums, room: int, items: int | None, few: int, w: int, effort: Effort) -> Iterator[tuple[Filling, int, int, int]]:
    """Fillings of just ``room`` with that number of items (None: more than ``few``), with the sums of one and of several of their
    items, and the sizes of which items are left out."""
    sizes, have, all_of = sums.sizes, sums.have, sums.all_of
    tables = [sums.reached(k) for k in range(items + 1)] if items else [sums.reached(None)]
    if items and not sums.reached(items)[0] >> room & 1:
        return
    # k: the next size; rest: what its like and smaller ones have to fill, with so many items; one, more: sums of one and of several
    # items taken; out: larger sizes of which items are left out
    stack: list[tuple[int, int, int, int, int, int, Filling]] = [(0, room, items or 0, 0, 0, 0, ())]
    while stack:
        if not effort.spend():
            return
        k, rest, number, one, more, out, taken = stack.pop()
        if rest == 0:
            if items or len(taken) > few:
                yield taken, one, more, out | all_of[k]
            continue
        if items and number == 1:  # just one item will do
            place = sums.place.get(rest, -1)
            if place >= k:
                own = out | all_of[k] & ~(all_of[place] & ~all_of[place + 1] if have[rest] == 1 else 0)
                o, s = added(one, more, (rest,))
                if not dominated(o, s, own, w):
                    yield (*taken, rest), o, s, own
            continue
        if k == len(sizes):
            continue
        if sizes[k] > rest:
            to = bisect.bisect_left(sums.rising, -rest, k)
            stack.append((to, rest, number, one, more, out | all_of[k] & ~all_of[to], taken))
            continue
        x, nodes, o, s = sizes[k], [], one, more
        for m in range(min(have[x], rest // x, number if items else room) + 1):
            if m:
                o, s = added(o, s, (x,))
                if dominated(o, s, out, w):
                    break
            if (tables[number - m] if items else tables[0])[k + 1] >> (rest - m * x) & 1:
                nodes.append((k + 1, rest - m * x, number - m, o, s, out | (1 << x if m < have[x] else 0), taken + (x,) * m))
        stack.extend(nodes)


class Sums:
    """For sizes in falling order: the sums that those from a place on can reach, with any or a certain number of items."""

    def __init__(self, sizes: list[int], have: dict[int, int], mask: int) -> None:
        self.sizes, self.have, self.mask = sizes, have, mask
        self.rising, self.place = [-x for x in sizes], {x: k for k, x in enumerate(sizes)}
        self.all_of = [0] * (len(sizes) + 1)
        for k in range(len(sizes) - 1, -1, -1):
            self.all_of[k] = self.all_of[k + 1] | 1 << sizes[k]
        self.known: dict[int | None, list[int]] = {0: [1] * (len(sizes) + 1)}

    def reached(self, items: int | None) -> list[int]:
        if items not in self.known:
            out = [1 if items is None else 0] * (len(self.sizes) + 1)
            fewer = [self.reached(k) for k in range(items)] if items else []
            for k in range(len(self.sizes) - 1, -1, -1):
                x, n = self.sizes[k], self.have[self.sizes[k]]
                if items is None:
                    out[k] = widened(out[k + 1], x, min(n, self.mask.bit_length() // x), self.mask)
                else:
                    out[k] = out[k + 1]
                    for m in range(1, min(n, items) + 1):
                        out[k] |= fewer[items - m][k + 1] << (m * x) & self.mask
            self.known[items] = out
        return self.known[items]


def added(one: int, more: int, items: Filling) -> tuple[int, int]:
    """The sums of one and of several items, with further items taken."""
    for x in items:
        more |= (more | one) << x
        one |= 1 << x
    return one, more


def dominated(one: int, more: int, out: int, w: int) -> bool:
    """Whether an item of a size in ``out`` is as large as several items or, by at most ``w``, larger than one or several."""
    return bool(more & out or w and _spread(one | more, w) & out)


def _spread(sums: int, w: int) -> int:
    """Sums raised by 1 to ``w``."""
    done, bits = 1, sums << 1
    while done < w:
        step = min(done, w - done)
        bits |= bits << step
        done += step
    return bits


def fewest_bins(left: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: items over half the room have a bin each, and those of a middle size have to fill what these leave or bins of their own."""
    size = np.arange(capacity + 1)
    half = capacity // 2
    n, load = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(left * size)])
    k = np.arange(half + 1)  # sizes under k don't count
    large = n[-1] - n[half + 1]
    mid = n[capacity - k + 1] - n[half + 1]  # over half, and at most capacity - k
    spare = mid * capacity - (load[capacity - k + 1] - load[half + 1])
    lesser = load[half + 1] - load[k]
    return int(max((large + np.maximum(0, -(-(lesser - spare) // capacity))).max(), -(-load[-1] // capacity)))


def bin_completion(counts: dict[int, int], capacity: int, steps: int | None = 4_000_000) -> list[Pattern]:
    """Patterns (sizes in a bin, number of such bins) that hold all items: branch and bound by bin completion.

    At each node the largest size left is completed by undominated fillings, and the pattern is used from as often as
    its items last down to once. A branch ends when the waste so far and the bound for what is left allow no better end
    than the incumbent, which at first is the best-fit solution, or when what is left was met before with no more waste.
    The search ends when the incumbent meets the lower bound or all is tried, and is exact then. ``steps`` bounds it (a node
    counts NODE steps, a step in the search for fillings one): half are spent with fillings of few items first, half with
    those of the largest items first, and at their end the incumbent stands. None: no bound, always exact.
    It holds a histogram and patterns, at most a few for each size, never items.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must be from 1 to the capacity")
    start = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        start[s] = n
    best = best_fit(counts, capacity)
    for few in (FEW_ITEMS, 0):
        effort = Effort(None if steps is None else steps // 2)
        best = _better(start, capacity, best, effort, few)
        if effort.left > 0:  # all is tried, or no better end is possible
            break
    return best


def _better(start: np.ndarray, capacity: int, best: list[Pattern], effort: Effort, few: int) -> list[Pattern]:
    """The best solution that is found before ``effort`` ends, or the given one."""
    fewest = sum(n for _, n in best)
    bound, total = fewest_bins(start, capacity), int((start * np.arange(capacity + 1)).sum())
    met: dict[bytes, int] = {}

    def choices(left: np.ndarray, waste: int) -> Iterator[Pattern]:
        largest = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[largest] -= 1
        for filling in fillings(rest, capacity - largest, (fewest - 1) * capacity - total - waste, effort, few):
            whole = (largest, *filling)
            spare = capacity - sum(whole)
            times = min(int(left[s]) // whole.count(s) for s in set(whole))
            while times:
                if spare * times <= (fewest - 1) * capacity - total - waste:  # the incumbent may be better by now
                    yield whole, times
                times -= 1

    # a frame: what is left, the pattern that led there, bins so far, waste so far, choices not yet tried
    stack: list[list[Any]] = [[start, None, 0, 0, None]]
    while stack and fewest > bound and effort.left > 0:
        left, _, bins, waste, more = stack[-1]
        if more is None:
            effort.spend(NODE)
            if not left.any():
                if bins < fewest:
                    fewest, best = bins, [x[1] for x in stack[1:]]
                stack.pop()
                continue
            key = hashlib.md5(left.tobytes()).digest()
            if bins + fewest_bins(left, capacity) >= fewest or met.get(key, waste + 1) <= waste:
                stack.pop()
                continue
            met[key] = waste
            more = stack[-1][4] = choices(left, waste)
        chosen = next(more, None)
        if chosen is None:
            stack.pop()
            continue
        filling, times = chosen
        after = left.copy()
        for s in filling:
            after[s] -= times
        stack.append([after, chosen, bins + times, waste + (capacity - sum(filling)) * times, None])
    return best


def places(patterns: list[Pattern]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each size, runs of its items: (rank of the first, items, sequence of the first, offset in it)."""
    rank: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for filling, n in patterns:
        at = 0
        for s in filling:
            runs.setdefault(s, []).append((rank.get(s, 0), n, base, at))
            rank[s] = rank.get(s, 0) + n
            at += s
        base += n
    return runs


class Tokens:
    """Ids as the tokenizers library gives them for a byte-level vocabulary, by the quicker library where both agree.

    They differ only on the strings of added tokens, which the first takes as those tokens; texts that hold one go
    to it.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str) -> None:
        import json

        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.tokenizer, self.full = tokenizer, None
        self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(x in text for x in self.added):
            if self.full is None:  # it takes much memory
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.tokenizer)
            return self.full.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


_tokens: dict[tuple[str, str, str], Tokens] = {}


def tokens(*key: str) -> Tokens:
    """One for each worker process, kept between its tasks."""
    if key not in _tokens:
        _tokens[key] = Tokens(*key)
    return _tokens[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all full but the first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces_of(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int, end_id: int, id_col: str, text_col: str, content: str) -> DataFrame:
    kind = {"ids": "array<int>", "crc32": "bigint"}[content]
    name = {"ids": "ids", "crc32": "ids_crc32"}[content]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(tokenizer, ranks, pattern)
        for batch in slices(batches):
            owner, piece, start, length, out = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = coder.ids(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    owner.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    out.append(raw[s : s + n].astype(np.int32) if content == "ids" else zlib.crc32(raw[s : s + n]))
            kind = pa.list_(pa.int32()) if content == "ids" else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(out, kind)], names=["doc", "piece", "start", "length", name]
            )
        release()

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {id_type}, piece int, start bigint, length bigint, {name} {kind}")


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", content: str = "ids", steps: int | None = 4_000_000,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (``content="crc32"``: ids_crc32), sequence_id, offset.

    A document is the ids of its whole text and ``end_id``; only those of more than ``capacity`` ids are cut, into
    full pieces after a first one that may be shorter. Pieces are settled. Full ones are a sequence each (with a negative
    number). The others are counted by length (fewer than ``capacity`` counts go to the driver), and bin completion
    lays out the histogram; a piece finds its sequence by its rank among the pieces of its length. Pieces of one length
    are ranked in parts of about RANKED, however many there are, and the parts' offsets (a row each) are broadcast, so no
    task or driver sees more than a part or that layout. ``steps`` bounds the search for a better layout than best fit's; None goes on to the optimum.

    Null and empty texts are a document of ``end_id`` alone; repeated rows and null ids are documents of their own;
    an empty table gives an empty result. Only the id is kept of the other columns, so their names can't clash.
    """
    modest_batches(docs.sparkSession)
    pieces = pieces_of(docs, tokenizer, ranks, pattern, capacity, end_id, id_col, text_col, content)
    pieces = settle(pieces.withColumn("own", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "own"]
    full, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    counts = {int(r.length): int(r["count"]) for r in rest.groupBy("length").count().collect()}
    runs = places(bin_completion(counts, capacity, steps))
    parts = docs.sparkSession.createDataFrame([(size, -(-n // RANKED)) for size, n in counts.items()], "length bigint, parts bigint")
    wide = 4 * sum(size * n for size, n in counts.items()) if content == "ids" else 64 * sum(counts.values())
    ranked = number_within(rest.join(F.broadcast(parts), "length"), "length", F.col("own"), "rank", F.col("parts"), dealt=-(-wide // DEALT))

    # a run for each size in each pattern: as few as the layout, so this side is bounded
    rows = [(size, int(f), int(f) + int(n), int(q), int(at)) for size, own in runs.items() for f, n, q, at in own]
    table = docs.sparkSession.createDataFrame(rows, "length bigint, __from bigint, __to bigint, __base bigint, offset bigint")
    met = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to")))
    placed = met.select(*(ranked[c] for c in columns), (F.col("__base") + F.col("rank") - F.col("__from")).alias("sequence_id"), "offset")
    alone = full.select(*columns, (-1 - F.col("own")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone).withColumnRenamed("doc", id_col)
