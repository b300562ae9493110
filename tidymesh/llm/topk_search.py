"""Exact top-k inner products, blocks of candidates in the order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidymesh.llm.common import settle

#: Vectors in a block, queries in a run, blocks that a task scores, blocks whose bounds a task takes.
BLOCK, RUN, SCORED, BOUNDED = 256, 1024, 64, 4096
#: Vectors whose directions blocks gather around, and from what cosine on two of them may share a block.
CENTRES, NEAR = 256, 0.7
#: The range of a long: parts and scores beyond it count as its ends.
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, own (a number of the row's) and v (array of long) of the rows whose vector is whole: no null, NaN or infinite part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))  # a long, which stays at its ends for what is beyond
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("own"), whole.alias("v"))


def filled(vectors: list, width: int) -> np.ndarray:
    data = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        data[i, : min(width, len(v))] = v[:width]
    return data


PACK = "n int, width int, ids binary, owns binary, data binary, upper binary, lower binary"


def packed(rows: DataFrame, size: int, parts: int, together: bool) -> DataFrame:
    """A row for up to ``size`` vectors that are near each other (shorter ones filled up with zeros; ``together``: of one part),
    with the largest and smallest value of each part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ends = np.append(np.flatnonzero(np.diff(frame["part"])) + 1, len(frame)) if together else np.array([len(frame)])
            starts = [k for a, b in zip(np.append(0, ends), ends) for k in range(a, b, size)]
            for k, end in zip(starts, [*starts[1:], len(frame)]):
                part = frame.iloc[k:end]
                data = filled(list(part["v"]), max(map(len, part["v"])))
                ids, owns = (part[c].to_numpy(np.int64).tobytes() for c in ("id", "own"))
                yield pd.DataFrame({"n": [len(part)], "width": [data.shape[1]], "ids": [ids], "owns": [owns], "data": [data.tobytes()], "upper": [data.max(axis=0).tobytes()], "lower": [data.min(axis=0).tobytes()]})

    near = rows.repartitionByRange(parts, "cell", "own").sortWithinPartitions("cell", "own")
    return near.select("id", "own", "v", "part").mapInPandas(run, PACK)


def chained(directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions of length 1, each followed by the nearest of those that are left; for each, how many places before it are not NEAR)."""
    length = np.sqrt((directions**2).sum(axis=1, keepdims=True))
    unit = directions / np.where(length > 0, length, 1)
    order, left = [], list(range(len(unit)))
    while left:
        k = left.pop(int((unit[left] @ unit[order[-1]]).argmax()) if order else 0)
        order.append(k)
    unit = unit[order]
    apart = np.einsum("ij,ij->i", unit[1:], unit[:-1]) < NEAR
    return unit, np.concatenate([[0], np.cumsum(apart)])[: len(unit)]


def celled(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """``rows`` plus cell, the nearest of the directions, and part, which changes where neighbouring cells are far from each other. They decide
    which vectors share a block, not what is found."""
    unit, part = chained(directions)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = filled(list(frame["v"]), unit.shape[1]).astype(np.float64)
            cell = (data @ unit.T).argmax(axis=1) if unit.size else np.zeros(len(frame), int)
            yield frame.assign(cell=cell.astype(np.int32), part=part[cell].astype(np.int32) if unit.size else np.int32(0))

    return rows.mapInPandas(run, "id bigint, own bigint, v array<bigint>, cell int, part int")


def matrix(raw: list[bytes], rows: list[int], widths: list[int], width: int) -> np.ndarray:
    out, at = np.zeros((int(sum(rows)), width), np.int64), 0
    for x, n, w in zip(raw, rows, widths):
        out[at : at + n, :w] = np.frombuffer(x, np.int64).reshape(n, w)
        at += n
    return out


def exact(queries: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same as floats where all products and sums are whole numbers that these hold, and else as Python's numbers."""
    top, most = (float(max(np.abs(x.astype(float)).max(initial=0) for x in xs)) + 1 for xs in ((queries,), others))
    kind = np.float64 if top * most * max(1, queries.shape[1]) < 2**52 else object
    return tuple(x.astype(kind) for x in (queries, *others))


def clamped(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == np.float64 else np.maximum(np.minimum(scores, HIGHEST), LOWEST)


def bounds(queries: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """What no score of a query (a row) in a block (a column) is above: the sum over the parts of the larger product."""
    queries, upper, lower = exact(queries, upper, lower)
    zero = queries * 0
    return clamped(np.maximum(queries, zero) @ upper.T + np.minimum(queries, zero) @ lower.T)


def search(query_owns: np.ndarray, queries: np.ndarray, seeds: np.ndarray, blocks: pd.DataFrame, asks: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's best ``k`` in the blocks it asks (``asks``: queries x blocks), ties to smaller ids, itself left out.

    It meets its blocks in the order of the bounds, scores a block as a whole from the block's own rows, and ends when the next
    bound is below its k-th score so far, or below ``seeds``, the k-th score that is known from elsewhere.
    """
    width = queries.shape[1]
    upper, lower = (matrix(list(blocks[c]), [1] * len(blocks), list(blocks["width"]), width) for c in ("upper", "lower"))
    bound = np.where(asks, bounds(queries, upper, lower), -np.inf)
    ranked = np.argsort(-bound, axis=1, kind="stable")
    held: list[list[np.ndarray]] = [[] for _ in query_owns]  # scores, ids, owns of the best so far
    least = [x if x > LOWEST else -np.inf for x in seeds.tolist()]
    ids, owns = ([np.frombuffer(x, np.int64) for x in blocks[c]] for c in ("ids", "owns"))
    data = [matrix([x], [n], [w], width) for x, n, w in zip(blocks["data"], blocks["n"], blocks["width"])]
    active = list(range(len(query_owns)))
    for r in range(len(blocks)):
        active = [q for q in active if bound[q, ranked[q, r]] > -np.inf and bound[q, ranked[q, r]] >= least[q]]
        if not active:
            break
        by: dict[int, list[int]] = {}
        for q in active:
            by.setdefault(int(ranked[q, r]), []).append(q)
        for b, own in by.items():
            wanted, rows = exact(queries[own], data[b])
            scores = clamped(wanted @ rows.T)
            for q, score in zip(own, scores):
                other = owns[b] != query_owns[q]
                score, i, o = score[other], ids[b][other], owns[b][other]
                if len(score) > 4 * k and score.dtype == np.float64:
                    near = score >= np.partition(score, -k)[-k]
                    score, i, o = score[near], i[near], o[near]
                if held[q]:
                    score, i, o = (np.concatenate(x) for x in zip(held[q], (score, i, o)))
                order = sorted(range(len(score)), key=lambda j: (-score[j], i[j], o[j]))[:k]
                held[q] = [score[order], i[order], o[order]]
                if len(order) == k:
                    least[q] = max(least[q], score[order[-1]])
    rows = [(q, int(i), int(o), int(s)) for q, x in enumerate(held) if x for s, i, o in zip(*x)]
    return pd.DataFrame(rows, columns=["q", "id", "own", "score"]).astype("int64")


def asked_by(run: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the rows' numbers, vectors) of a run's queries."""
    r = run.iloc[0]
    return np.frombuffer(r["owns"], np.int64), matrix([r["data"]], [r["n"]], [r["width"]], max(width, int(r["width"])))


class Search:
    """The blocks and runs of one search, settled."""

    def __init__(self, vectors: DataFrame, every: int, k: int, scale: int, id_col: str, vec_col: str) -> None:
        spark, self.k = vectors.sparkSession, k
        rows = settle(whole_vectors(vectors, id_col, vec_col, scale), "vectors")
        queries = F.pmod("id", F.lit(every)) == 0
        n, asked = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
        some = [r.v for r in rows.orderBy(F.xxhash64("own"), "own").limit(min(CENTRES, n // 64 + 1)).collect()]
        centres = filled(some, max(map(len, some), default=0)).astype(np.float64)
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        near = celled(rows, centres)

        def parts(n: int, size: int) -> int:
            return max(1, min(tasks, n // (4 * size)), n // 200_000)

        self.blocks = settle(packed(near, BLOCK, parts(n, BLOCK), True).withColumn("block", F.monotonically_increasing_id()), "blocks")
        runs = settle(packed(near.where(queries), RUN, parts(asked, RUN), False).withColumn("own_run", F.monotonically_increasing_id()), "runs")
        # runs are counted from 0; there is one for each RUN queries or so
        numbers = runs.select("own_run", (F.row_number().over(Window.orderBy("own_run")) - 1).alias("run"))
        self.runs = runs.join(F.broadcast(numbers), "own_run").drop("own_run", "upper", "lower")
        self.n_blocks, self.n_runs = self.blocks.count(), runs.count()

    def _cogrouped(self, left: DataFrame, right: DataFrame, keys: list[str], fun, kind: str) -> DataFrame:
        own = right.select(*(F.col(c).alias(f"own_{c}") if c in keys else c for c in right.columns))  # both sides come from one table
        return left.groupBy(*keys).cogroup(own.groupBy(*(f"own_{c}" for c in keys))).applyInPandas(fun, kind)

    def wanted(self, seeds: DataFrame | None) -> DataFrame:
        """(run, block, asks, n): which queries of a run (one bit for each) a block may have something for, and how many: with ``seeds`` (run,
        seeds) those whose bound is no less than their seed; without, those of which it is the best block of its slice.

        Only the blocks' bounds and the queries are shuffled for it."""
        slices = max(1, -(-self.n_blocks // BOUNDED))
        sums = self.blocks.select("block", "width", "upper", "lower", F.pmod(F.xxhash64("block"), F.lit(slices)).alias("slice"))
        left = sums.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(self.n_runs - 1))))
        runs = self.runs if seeds is None else self.runs.join(seeds, "run")
        right = runs.drop("ids").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
        first = seeds is None

        def some(blocks: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks) or not len(run):
                return pd.DataFrame({"run": [], "block": [], "asks": [], "n": []}).astype({"run": "int64", "block": "int64", "asks": object, "n": "int64"})
            owns, asked = asked_by(run, int(blocks["width"].max()))
            upper, lower = (matrix(list(blocks[c]), [1] * len(blocks), list(blocks["width"]), asked.shape[1]) for c in ("upper", "lower"))
            bound = bounds(asked, upper, lower)
            if first:
                asks = np.zeros(bound.shape, bool)
                asks[np.arange(len(owns)), bound.argmax(axis=1)] = True
            else:
                asks = bound >= np.array(run.iloc[0]["seeds"], dtype=bound.dtype)[:, None]
            kept = np.flatnonzero(asks.any(axis=0))
            bits = [np.packbits(asks[:, b]).tobytes() for b in kept]
            return pd.DataFrame({"run": run.iloc[0]["own_run"], "block": blocks["block"].to_numpy()[kept], "asks": bits, "n": asks[:, kept].sum(axis=0)})

        return self._cogrouped(left, right, ["run", "slice"], some, "run bigint, block bigint, asks binary, n bigint")

    def scored(self, wanted: DataFrame, seeds: DataFrame | None) -> DataFrame:
        """(run, q, query_own, query_id, id, own, score): the best of the wanted blocks for each query, from tasks of about SCORED blocks."""
        pieces, k = max(1, -(-self.n_blocks // SCORED), min(12, self.n_blocks)), self.k
        wanted = wanted.withColumn("piece", F.pmod(F.xxhash64("block"), F.lit(pieces)))
        left = wanted.select("run", "piece", "block", "asks").join(self.blocks, "block")
        runs = self.runs if seeds is None else self.runs.join(seeds, "run")
        right = runs.join(wanted.select("run", "piece").distinct(), "run")
        kind = "run bigint, q bigint, query_own bigint, query_id bigint, id bigint, own bigint, score bigint"

        def best(blocks: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
            if not len(blocks) or not len(run):
                return pd.DataFrame({x.split()[0]: [] for x in kind.split(", ")}).astype("int64")
            owns, asked = asked_by(run, int(blocks["width"].max()))
            asks = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=len(owns)) for x in blocks["asks"]], bool).T
            known = np.array(run.iloc[0]["seeds"], np.int64) if "seeds" in run else np.full(len(owns), LOWEST, np.int64)
            found = search(owns, asked, known, blocks, asks, k)
            ids = np.frombuffer(run.iloc[0]["ids"], np.int64)
            return found.assign(run=run.iloc[0]["own_run"], query_own=owns[found["q"]], query_id=ids[found["q"]])[[x.split()[0] for x in kind.split(", ")]]

        return self._cogrouped(left, right, ["run", "piece"], best, kind)

    def ranked(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_own").orderBy(F.desc("score"), "id", "own"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k)

    def seeds(self) -> DataFrame:
        """(run, seeds): each query's k-th score in the blocks that promise it most."""
        first = self.ranked(self.scored(settle(self.wanted(None), "first"), None))
        kth = first.groupBy("run", "q").agg(F.min("score").alias("score"), F.count("*").alias("n"))
        known = kth.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("q", F.when(F.col("n") == self.k, F.col("score")).otherwise(F.lit(LOWEST)).alias("s")))).alias("known"))
        every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda q: F.coalesce(F.try_element_at("known", q.cast("long")), F.lit(LOWEST)))
        return settle(self.runs.select("run", "n").join(known, "run", "left").select("run", every.alias("seeds")), "seeds")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query row's ``k`` best of all other rows by inner product of whole numbers.

    Queries: rows whose id is divisible by ``every``. Parts are floor(scale * x). Vectors go into blocks with others of their
    direction, queries into runs; both are settled. A query's bound on a block is the sum over the parts of the larger product with
    the block's largest or smallest value. The blocks of the best bounds give each query a k-th score to begin with; then
    only blocks whose bound reaches it are sent to its run, and scored in the order of the bounds until these fall below the k-th
    score so far. Where directions gather, few blocks are sent; where they are spread evenly in many dimensions, bounds can't tell
    blocks apart, and each run meets nearly all (``surviving`` tells the share). A task has a run of queries and about SCORED blocks.

    Vectors that are null or hold null or non-finite parts, and rows with a null id, take no part. Shorter vectors
    count as filled up with zeros, so empty ones score 0. Rows that repeat an id are rows of their own: each is a query if the
    id is, with a list of its own, and a candidate for the others. Queries with fewer than ``k`` candidates return all. Parts
    (after scaling) and scores beyond the range of a long count as its ends. An empty table gives an
    empty result. Extra columns are left out.
    """
    s = Search(vectors, every, k, scale, id_col, vec_col)
    if not s.n_blocks or not s.n_runs:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    seeds = s.seeds()
    found = s.scored(settle(s.wanted(seeds), "wanted"), seeds)
    return s.ranked(found).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def surviving(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of (query, block) pairs that are scored after the first blocks have set each query's k-th score."""
    s = Search(vectors, every, k, scale, id_col, vec_col)
    pairs = s.n_blocks * (s.runs.agg(F.sum("n")).first()[0] or 0)
    return (s.wanted(s.seeds()).agg(F.sum("n")).first()[0] or 0) / pairs if pairs else 0.0
