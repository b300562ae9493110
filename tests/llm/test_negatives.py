"""Hard negatives against all pairs, and how much of the index a clustered table leaves unread."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidymesh.llm.hard_negatives import HIGHEST, LOWEST, Index, asked_rings, mine_negatives, whole_rows

ROWS = "vec_id long, label int, embedding array<double>"


def brute(rows, every=100, p=5, n=5, percent=80, scale=256):
    kept = [(i, lab, [math.floor(max(min(float(x) * scale, 2.0**62), -(2.0**62))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, v) in enumerate(kept):
        if i % every:
            continue
        scores = [(-max(min(sum(x * y for x, y in zip(v, w)), HIGHEST), LOWEST), j, b, other) for b, (j, other, w) in enumerate(kept) if b != a]
        scores.sort()
        for s, j, _, _ in [x for x in scores if x[3] == lab][:p]:
            fits = [x for x in scores if x[3] != lab and percent * -s <= 100 * -x[0] <= 100 * -s][:n]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def told(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, seed=3, width=16, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    at = rng.integers(0, centres, n)
    v = c[at] + rng.normal(scale=0.1, size=(n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int((at[i] + (i % 3 == 0)) % 10), [float(x) for x in v[i]]) for i in range(n)]


def test_against_all_pairs(spark):
    rows = clustered(3000)
    same = [(i, i % 4, [0.5] * 16) for i in range(5000, 6500)]  # a third of the table is one vector
    for data in (rows, rows + same):
        got = told(mine_negatives(spark.createDataFrame(data, ROWS)))
        assert got == brute(data) and len(got) > 100


def test_odd_rows(spark):
    odd = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.2]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [1.0, float("nan")]), (7, 2, [float("inf"), 0.0]), (None, 1, [1.0, 0.0]),
        (100, 2, []), (100, 2, [0.5]), (100, 2, [0.5]), (8, 1, [0.85, 0.1, 9.0]), (-100, 1, [0.7, -0.9]), (9, 3, [0.9, 0.1]), (10, 3, [-1.0, -1.0]), (200, 3, [-1.0, 0.0]), (11, 3, [-0.5, 0.0]),
    ]
    df = spark.createDataFrame(odd, ROWS).withColumn("pivot", F.lit("clash")).withColumn("own", F.lit(0)).withColumn("score", F.lit(1)).withColumn("run", F.lit(1))
    assert told(mine_negatives(df)) == brute(odd)
    big = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 0.0]), (2, 2, [1e300, 2.0]), (3, 2, [-1e300, 0.0]), (4, 2, [3.0, 4.0])]
    assert told(mine_negatives(spark.createDataFrame(big, ROWS))) == brute(big)


def test_small_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert mine_negatives(empty).count() == 0 and mine_negatives(empty).columns[0] == "anchor_id"
    for data in ([(0, 1, [1.0])], [(1, 1, [1.0]), (2, 2, [1.0])], [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [1.0])]):
        assert told(mine_negatives(spark.createDataFrame(data, ROWS))) == brute(data)


def test_other_label_and_parameters(spark):
    rows = clustered(400, seed=5)
    got = mine_negatives(spark.createDataFrame(rows, ROWS), F.col("label") % 2, every=7, positives=2, negatives=3, percent=90, scale=100)
    assert told(got) == brute([(i, lab % 2, v) for i, lab, v in rows], 7, 2, 3, 90, 100)


def test_most_of_a_clustered_index_is_left_unread(spark):
    rows = whole_rows(spark.createDataFrame(clustered(30_000), ROWS), "vec_id", "embedding", "label", 256, F.col("label")).cache()
    index = Index(rows)
    anchors = rows.where(F.pmod("id", F.lit(100)) == 0).select("own", "label", "v", F.lit(LOWEST).alias("low_score"), F.lit(HIGHEST).alias("high_score"), F.lit(True).alias("same"))
    runs = index.targets(anchors)
    # what a k-th score of 0.9 of the square leaves open, beside the first rings
    runs = runs.withColumn("kth", F.expr("transform(sequence(1, n), x -> 59000L)"))
    size = dict(zip(index.rings.ring.tolist(), index.rings.n.tolist()))
    read = sum(sum(bin(b).count("1") for b in r.asks) * size[r.ring] for first in (True, False) for r in asked_rings(index, runs, 5, first).collect())
    assert read / (300 * 30_000) < 0.5
    rows.unpersist()


def test_query(spark, sf_dir):
    from tidymesh.llm.queries import op11_hard_negatives

    data = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert told(op11_hard_negatives(spark, sf_dir)) == brute(data)


@pytest.mark.parametrize("n", [256, 257, 600])
def test_blocks_hold_all_rows_once(spark, n):
    rows = whole_rows(spark.createDataFrame(clustered(n), ROWS), "vec_id", "embedding", "label", 256, F.col("label")).cache()
    index = Index(rows)
    ids = [int(x) for r in index.blocks.collect() for x in np.frombuffer(r.ids, np.int64)]
    assert sorted(ids) == list(range(n)) and index.rings.n.sum() == n
    rows.unpersist()


def test_parts_up_to_the_ends_of_a_long(spark):
    """Parts from 2**62 to 2**63 are told apart; their scores fit a long."""
    rows = [(0, 1, [0.004, 0.0]), (1, 1, [3.5e16, 0.0]), (2, 2, [2.9e16, 0.0]), (3, 2, [3.4e16, 0.0]), (4, 2, [2.0e16, 0.0])]
    assert told(mine_negatives(spark.createDataFrame(rows, ROWS))) == [(0, 1, 1, 3, math.floor(3.5e16 * 256), math.floor(3.4e16 * 256)), (0, 1, 2, 2, math.floor(3.5e16 * 256), math.floor(2.9e16 * 256))]
