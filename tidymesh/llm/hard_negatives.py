"""Hard negatives by exact search in an index of one-dimensional keys: (pivot, distance to it) of vectors made equally long."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidymesh.llm.common import settle
from tidymesh.llm.topk_search import HIGHEST, LOWEST, clamped, exact, filled, matrix
from tidymesh.plans.rowindex import with_row_index

#: Vectors in a block, blocks in a piece (what a task scores at once), targets in a run, rows that the first interval of keys should hold.
BLOCK, PIECE, RUN, FIRST = 256, 64, 2048, 4096
#: Pivots, the rows that they are chosen from, and rings: intervals of keys of one pivot, about as many as the driver may plan with.
PIVOTS, CHOSEN_FROM, RINGS = 32, 2048, 4096
#: Distances come from floats: what they can't tell apart by this share of the largest square is still looked at.
SLACK = 1e-9


class Rings(NamedTuple):
    """The directory of the index: a number for each ring, its pivot, least and largest distance to it, and rows."""

    ring: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray


class Space(NamedTuple):
    """Vectors as points of one length: a last part makes each square sum up to ``square``, so near is the same as a high inner product."""

    square: float
    pivots: np.ndarray  # points, with their last part

    def from_pivots(self, data: np.ndarray, query: bool) -> np.ndarray:
        """Distances (rows x pivots). A query's last part is 0, as it wouldn't matter for its inner products."""
        x = data.astype(np.float64)
        own = np.einsum("ij,ij->i", x, x)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.square - own))
        own = own + last**2
        width = max(x.shape[1], self.pivots.shape[1] - 1)
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        p = np.pad(self.pivots[:, :-1], ((0, 0), (0, width - self.pivots.shape[1] + 1)))
        cross = x @ p.T + np.outer(last, self.pivots[:, -1])
        return np.sqrt(np.maximum(0, own[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None, :] - 2 * cross))

    def squared(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The square of the distance at which a query has a score."""
        x = queries.astype(np.float64)
        return np.einsum("ij,ij->i", x, x) + self.square - 2 * scores.astype(np.float64)


def whole_rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, label: Column) -> DataFrame:
    """id, own (a number of the row's), label, v (array of long) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))  # a long, which stays at its ends for what is beyond
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("own"), label.cast("long").alias("label"), whole.alias("v"))


def spread_out(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the farthest from those before it; fewer where the rest repeats them."""
    if not len(points):
        return points
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


KEYED = "id bigint, own bigint, label bigint, v array<bigint>, pivot int, distance double"
BLOCKS = "ring bigint, piece bigint, pivot int, low double, high double, n int, width int, ids binary, owns binary, labels binary, data binary"
FOUND = "target bigint, own bigint, id bigint, score bigint"


class Index:
    """All vectors by (nearest pivot, distance to it), in blocks, pieces and rings, settled."""

    def __init__(self, rows: DataFrame) -> None:
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, top, width = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
        some = [r.v for r in rows.orderBy(F.xxhash64("id"), "own").select("v").limit(CHOSEN_FROM).collect()]
        data = filled(some, width or 0).astype(np.float64)
        last = np.sqrt(np.maximum(0, (top or 0.0) - np.einsum("ij,ij->i", data, data)))
        self.n, self.width = n, width or 0
        self.space = space = Space(top or 0.0, spread_out(np.hstack([data, last[:, None]]), PIVOTS))

        def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    far = space.from_pivots(filled(list(frame["v"]), max(map(len, frame["v"]))), False)
                    yield frame.assign(pivot=far.argmin(axis=1).astype(np.int32), distance=far.min(axis=1))

        # rows of a piece, and of a ring: as many pieces as leave no more than RINGS rings or so, however many rows there are
        size = min(BLOCK * PIECE, FIRST // 2)
        while RINGS * size < 2 * n and size < BLOCK * PIECE:
            size *= 2
        least = size * max(1, -(-2 * n // (RINGS * size)))

        def cut(frame: pd.DataFrame) -> pd.DataFrame:
            """A piece in the order of its keys, in blocks of one pivot each."""
            frame = frame.sort_values("at", kind="stable")
            out = []
            ends = np.append(np.flatnonzero(np.diff(frame["pivot"])) + 1, len(frame))
            for a, b in zip(np.append(0, ends), ends):
                for k in range(a, b, BLOCK):
                    x = frame.iloc[k : min(k + BLOCK, b)]
                    at, pivot = int(x["at"].iloc[0]), int(x["pivot"].iloc[0])
                    v = filled(list(x["v"]), max(map(len, x["v"])))
                    packed = [x[c].to_numpy(np.int64).tobytes() for c in ("id", "own", "label")]
                    out.append((at // least * PIVOTS + pivot, at // size * PIVOTS + pivot, pivot, x["distance"].min(), x["distance"].max(), len(x), v.shape[1], *packed, v.tobytes()))
            return pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

        placed = with_row_index(rows.mapInPandas(key, KEYED), [F.col(c) for c in ("pivot", "distance", "own")], "at")
        self.blocks = settle(placed.groupBy(F.floor(F.col("at") / size).alias("p")).applyInPandas(cut, BLOCKS), "keyed")
        told = self.blocks.groupBy("ring").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("ring").collect()
        self.rings = Rings(*(np.array([r[c] for r in told]) for c in ("ring", "pivot", "low", "high", "n")))

    def targets(self, asked: DataFrame) -> DataFrame:
        """Runs of up to RUN targets that are near each other, settled: (run, n, width, targets, owns, labels, lows, highs, sames, data)."""
        space = self.space
        kind = "run bigint, n int, width int, targets binary, owns binary, labels binary, lows binary, highs binary, sames binary, data binary"

        def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    far = space.from_pivots(filled(list(frame["v"]), max(map(len, frame["v"]))), True)
                    yield frame.assign(pivot=far.argmin(axis=1).astype(np.int32), distance=far.min(axis=1))

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            x = frame.sort_values("at", kind="stable")
            v = filled(list(x["v"]), max(map(len, x["v"])))
            packed = [x[c].to_numpy(np.int64).tobytes() for c in ("target", "own", "label", "low_score", "high_score", "same")]
            return pd.DataFrame([(int(x["at"].iloc[0]) // RUN, len(x), v.shape[1], *packed, v.tobytes())], columns=[c.split()[0] for c in kind.split(", ")])

        asked = asked.select("own", "label", "v", "low_score", "high_score", F.col("same").cast("long").alias("same")).withColumn("target", F.monotonically_increasing_id())
        asked = settle(asked, "targets")
        near = asked.mapInPandas(key, "own bigint, label bigint, v array<bigint>, low_score bigint, high_score bigint, same bigint, target bigint, pivot int, distance double")
        placed = with_row_index(near, [F.col(c) for c in ("pivot", "distance", "target")], "at")
        return settle(placed.groupBy(F.floor(F.col("at") / RUN).alias("r")).applyInPandas(pack, kind), "runs")


def unpacked(run: pd.Series, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    told = {c: np.frombuffer(run[c], np.int64) for c in ("targets", "owns", "labels", "lows", "highs", "sames")}
    return told, matrix([run["data"]], [run["n"]], [run["width"]], max(width, int(run["width"])))


def annuli(space: Space, data: np.ndarray, lows: np.ndarray, highs: np.ndarray, kth: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least squared distance at which an interval (pivot, low to high) may have something for a target (targets x intervals): infinite where it can have nothing.

    By the triangle inequality a point of it is at least as far from the target as their distances to the pivot differ, and no farther than
    their sum. The target asks from the distance of its highest score to that of its lowest one, or of the k-th score known.
    """
    to = space.from_pivots(data, True)[:, pivot]
    least = np.maximum(0, np.maximum(to - high[None, :], low[None, :] - to)) ** 2
    most = (to + high[None, :]) ** 2
    slack = (SLACK * (space.squared(data, np.zeros(len(data))) + space.square))[:, None]

    def reach(scores: np.ndarray, where: np.ndarray, otherwise: float) -> np.ndarray:
        return np.where(where, np.maximum(0, space.squared(data, scores)), otherwise)[:, None]

    nearest = reach(highs, highs < HIGHEST, 0.0)
    farthest = np.minimum(reach(lows, lows > LOWEST, np.inf), reach(kth, kth > LOWEST, np.inf))
    return np.where((least <= farthest + slack) & (most >= nearest - slack), np.maximum(least, nearest), np.inf)


def search(space: Space, told: dict[str, np.ndarray], data: np.ndarray, asks: np.ndarray, kth: np.ndarray, blocks: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of each target among the blocks of the rings it asks (``asks``: targets x blocks): from the nearest annulus outwards, until what is left is farther than the k-th."""
    low, high, pivot = (blocks[c].to_numpy() for c in ("low", "high", "pivot"))
    bound = np.where(asks, annuli(space, data, told["lows"], told["highs"], kth, pivot, low, high), np.inf)
    ranked = np.argsort(bound, axis=1, kind="stable")
    slack = SLACK * (space.squared(data, np.zeros(len(data))) + space.square)
    reach = np.where(kth > LOWEST, space.squared(data, kth), np.inf) + slack
    held: list[list[np.ndarray] | None] = [None] * len(data)
    ids, owns, labels = ([np.frombuffer(x, np.int64) for x in blocks[c]] for c in ("ids", "owns", "labels"))
    rows = [matrix([x], [n], [w], data.shape[1]) for x, n, w in zip(blocks["data"], blocks["n"], blocks["width"])]
    active = np.arange(len(data))
    for r in range(len(blocks)):
        here = bound[active, ranked[active, r]]
        active = active[np.isfinite(here) & (here <= reach[active])]
        if not len(active):
            break
        at = ranked[active, r]
        for b in np.unique(at):
            own = active[at == b]
            wanted, others = exact(data[own], rows[b])
            scores = clamped(wanted @ others.T)
            fits = (scores >= np.maximum(told["lows"][own], kth[own])[:, None]) & (scores <= told["highs"][own][:, None])
            fits &= (labels[b][None, :] == told["labels"][own][:, None]) == (told["sames"][own] == 1)[:, None]
            fits &= owns[b][None, :] != told["owns"][own][:, None]
            for t in np.flatnonzero(fits.any(axis=1)):
                q, which = own[t], fits[t]
                score, i, o = scores[t][which], ids[b][which], owns[b][which]
                if held[q] is not None:
                    score, i, o = (np.concatenate(x) for x in zip(held[q], (score, i, o)))
                if score.dtype == np.float64:
                    order = np.lexsort((o, i, -score))[:k]
                else:
                    order = np.array(sorted(range(len(score)), key=lambda j: (-score[j], i[j], o[j]))[:k])
                held[q] = [score[order], i[order], o[order]]
                if len(order) == k:
                    reach[q] = min(reach[q], space.squared(data[q : q + 1], np.array([score[order[-1]]], dtype=np.float64))[0] + slack[q])
    out = [(told["targets"][q], o, i, int(s)) for q, x in enumerate(held) if x for s, i, o in zip(*x)]
    return pd.DataFrame(out, columns=["target", "own", "id", "score"]).astype("int64")


def asked_rings(index: Index, runs: DataFrame, k: int, first: bool) -> DataFrame:
    """(run, ring, asks): which targets of a run (a bit each) look at a ring. ``first``: the nearest rings that hold FIRST rows
    (a ring at least); otherwise all others that the k-th score so far leaves open. Runs then have a column kth."""
    space, rings = index.space, index.rings

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, r in frame.iterrows():
                told, data = unpacked(r, 0)
                none = np.full(len(data), LOWEST, np.int64)
                bound = annuli(space, data, told["lows"], told["highs"], none, rings.pivot, rings.low, rings.high)
                ranked = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(rings.n[ranked], axis=1) - rings.n[ranked]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, ranked, before < FIRST, axis=1)
                if first:
                    asks = early & np.isfinite(bound)
                else:
                    kth = np.array(r["kth"], np.int64)
                    asks = ~early & np.isfinite(annuli(space, data, told["lows"], told["highs"], kth, rings.pivot, rings.low, rings.high))
                some = np.flatnonzero(asks.any(axis=0))
                bits = [np.packbits(asks[:, x]).tobytes() for x in some]
                yield pd.DataFrame({"run": np.full(len(some), r["run"], np.int64), "ring": rings.ring[some], "asks": bits})

    return runs.mapInPandas(run, "run bigint, ring bigint, asks binary")


def scored(index: Index, runs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(target, own, id, score): the best ``k`` of each target in each piece of the rings it asks."""
    space = index.space
    near = asked.join(index.blocks, "ring")
    pairs = asked.join(index.blocks.select("ring", "piece").distinct(), "ring").select(F.col("run").alias("own_run"), F.col("piece").alias("own_piece"))
    sent = runs.join(pairs, F.col("run") == F.col("own_run")).drop("own_run")

    def best(blocks: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(run):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype("int64")
        r = run.iloc[0]
        told, data = unpacked(r, int(blocks["width"].max()))
        asks = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=len(data)) for x in blocks["asks"]], bool).T
        kth = np.array(r["kth"], np.int64) if "kth" in run else np.full(len(data), LOWEST, np.int64)
        return search(space, told, data, asks, kth, blocks, k)

    return near.groupBy("run", "piece").cogroup(sent.groupBy("run", "own_piece")).applyInPandas(best, FOUND)


def nearest(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """own_target, high_score, rank, own, id, score of the best ``k`` rows that each target allows. ``asked``: own, label, v, low_score, high_score, same.

    Rounds: the nearest rings first; then, with the k-th score found there, all rings and blocks that may still hold a better one. What is left after
    that is farther than the k-th, which certifies it.
    """
    runs = index.targets(asked)
    by_score = Window.partitionBy("target").orderBy(F.desc("score"), "id", "own")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    early = settle(best(scored(index, runs, settle(asked_rings(index, runs, k, True), "near"), k)).drop("rank"), "early")
    kth = early.groupBy("target").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    numbers = runs.mapInPandas(_numbers, "run bigint, place int, target bigint, own_target bigint, high_score bigint")
    known = numbers.join(kth.select("target", "kth"), "target", "left").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("kth", F.lit(LOWEST)).alias("kth")))).alias("kth"))
    late_runs = settle(runs.join(known.select("run", F.col("kth")["kth"].alias("kth")), "run"), "known")
    late = scored(index, late_runs, settle(asked_rings(index, late_runs, k, False), "open"), k)
    found = best(early.select("target", "own", "id", "score").unionByName(late))
    return found.join(numbers.select("target", "own_target", "high_score"), "target").drop("target")


def _numbers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for _, r in frame.iterrows():
            told, _ = unpacked(r, 0)
            n = len(told["targets"])
            yield pd.DataFrame({"run": np.full(n, r["run"], np.int64), "place": np.arange(n, dtype=np.int32), "target": told["targets"], "own_target": told["owns"], "high_score": told["highs"]})


def mine_negatives(
    vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``. Parts of vectors become floor(scale * x), scores are inner products of these. An
    anchor's positives are its ``positives`` best other rows of its label; a positive's negatives are the ``negatives`` best rows of other labels whose score is
    at most the positive's and at least ``percent`` hundredths of it; higher scores first, ties to smaller ids. ``label``: the label to go by, if not the column as it is.

    Vectors get a last part that makes them equally long, so that a higher inner product with an anchor is a smaller distance to it. Every row is
    stored by (nearest pivot, distance to that pivot), in order; a target (an anchor, or an anchor and a positive's score) asks for
    the intervals of keys around its own distance, first the nearest, then all whose annulus may hold something better than the
    k-th so far and, for negatives, meets the annulus of the scores allowed. Pivots come from CHOSEN_FROM rows and only decide how
    much is pruned; rings are at most about RINGS, so their directory is small at any size. Tasks have a run of targets
    and a piece of blocks. Where directions are spread evenly in many dimensions, distances to pivots are all alike and nearly all is looked at.

    Rows with a null id, label or vector, or a null or non-finite part, take no part. Shorter vectors count as filled up with
    zeros. Rows that repeat an id are rows of their own, as anchors too. A positive with a score below 0 has no negatives (nothing is between
    it and more than it); nor has one that nothing fits. Parts (after scaling) and scores beyond the range of a long
    count as its ends. An empty table gives an empty result. Extra columns are left out.
    """
    rows = settle(whole_rows(vectors, id_col, vec_col, label_col, scale, F.col(label_col) if label is None else label), "vectors")
    index = Index(rows)
    if not index.n:
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    anchors = rows.where(F.pmod("id", F.lit(every)) == 0)
    asked = anchors.select("own", "label", "v", F.lit(LOWEST).alias("low_score"), F.lit(HIGHEST).alias("high_score"), F.lit(True).alias("same"))
    near = settle(nearest(index, asked, positives).select(F.col("own_target").alias("own"), F.col("id").alias("positive_id"), F.col("own").alias("positive_own"), F.col("score").alias("positive_score")), "positives")
    # the least score allowed, rounded up; below 0 it would be more than the score itself
    least = (-F.floor(-(F.col("positive_score").cast("decimal(38,0)") * percent) / 100)).cast("long")
    levels = near.where(F.col("positive_score") >= 0).select("own", "positive_score").distinct()
    asked = levels.join(anchors, "own").select("own", "label", "v", least.alias("low_score"), F.col("positive_score").alias("high_score"), F.lit(False).alias("same"))
    far = nearest(index, asked, negatives).select(F.col("own_target").alias("__own"), F.col("high_score").alias("__level"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = near.join(far, (F.col("own") == F.col("__own")) & (F.col("positive_score") == F.col("__level")))
    told = told.join(anchors.select(F.col("own").alias("__anchor"), F.col("id").alias("anchor_id")), F.col("own") == F.col("__anchor"))
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
