import math

import numpy as np
import pandas as pd
import pytest

from tests.llm.cases import empty_docs
from tidymesh.llm import queries as Q
from tidymesh.llm import topk_search as T
from tidymesh.llm.topk_search import search, surviving, top_k


def brute(rows, every=100, k=10):
    whole = [(i, n, [min(max(math.floor(1024 * x) if abs(x) < 2e15 else int(math.copysign(2**62, x)), -(2**62)), 2**62) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, m, a in whole:
        if q % every == 0:
            found = sorted((-min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1), c) for c, n, b in whole if n != m)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def test_top_k_brute(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op9_topk_search(spark, sf_dir).collect())) == brute(rows)


def test_top_k_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 700)] + [(700, None), (800, [1.0, None, 2.0]), (900, [float("nan")] * 5), (1000, [float("inf")]), (1100, []), (1200, [2.0]), (None, [1.0]), (-100, [0.5] * 5), (1300, [1e5] * 5), (100, [9.0] * 5), (100, [0.25] * 5), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS rank")
    assert sorted(map(tuple, top_k(df).collect())) == brute(rows)
    few = [(0, [1.0]), (5, [2.0]), (6, [2.0])]
    assert sorted(map(tuple, top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect())) == brute(few)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert top_k(spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")).count() == 0
    assert empty_docs(spark).count() == 0


def test_large_parts(spark):
    rows = [(0, [1e10, 1.0]), (100, [1e300, -3.0]), (3, [-1e15, 2.0]), (4, [1.0, 1.0]), (5, [3.0, 1e18]), (6, [2.5, 0.0])]
    assert sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect())) == brute(rows, k=4)


def test_parts_up_to_the_ends_of_a_long(spark):
    """Parts from 2**62 to 2**63 are told apart; their scores fit a long."""
    far = [4.6e15, 5.5e15, 7e15, 8.9e15, 9.007199254740991e15]
    rows = [(0, [0.001, 0.0]), (100, [-0.0005, 0.5])] + [(9 - i, [x, 0.0]) for i, x in enumerate(far)] + [(19 - i, [-x, 0.0]) for i, x in enumerate(far)] + [(20, [-8.95e15, 0.25])]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in whole[:2]:
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert all(-(2**63) <= s < 2**63 for *_, s in want)
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == want


def test_many_blocks_and_runs(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "RUN", 8)
    monkeypatch.setattr(T, "SCORED", 5)
    monkeypatch.setattr(T, "BOUNDED", 20)
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).round(3).tolist()) for i in range(1500)]
    rows += [(i, rows[0][1]) for i in range(1500, 2200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, every=20, k=7).collect())) == brute(rows, every=20, k=7)


def test_blocks_are_left_out(spark):
    """Where directions gather, most blocks are never sent; the result is that of brute force."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 32)) * 5
    data = (centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 32)) * 0.2).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    assert surviving(df) < 0.2
    whole = np.floor(data * 1024).astype(np.int64)
    scores = whole[::100] @ whole.T
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df).collect()}
    for q in range(0, 12_000, 100):
        own = scores[q // 100].copy()
        own[q] = own.min() - 1
        order = np.lexsort((np.arange(12_000), -own))[:10]
        assert [got[q, k + 1] for k in range(10)] == [(int(c), int(own[c])) for c in order]


@pytest.mark.parametrize("large", [3, 10**6, 2**39])
def test_blocks_are_exact(large):
    rng = np.random.default_rng(5)
    data = rng.integers(-large, large, (500, 6))
    data[100:300] = data[0]
    ids, owns = rng.permutation(500).astype(np.int64) // 2, np.arange(500)
    cut = [slice(c, c + 32) for c in range(0, 500, 32)]
    blocks = pd.DataFrame([(len(ids[c]), 6, ids[c].tobytes(), owns[c].tobytes(), data[c].tobytes(), data[c].max(axis=0).tobytes(), data[c].min(axis=0).tobytes()) for c in cut], columns=["n", "width", "ids", "owns", "data", "upper", "lower"])
    got = search(owns[:20], data[:20], np.full(20, -(2**63)), blocks, np.ones((20, len(cut)), bool), 7)
    for i in range(20):
        want = sorted((-min(max(sum(int(x) * int(y) for x, y in zip(data[i], data[j])), -(2**63)), 2**63 - 1), int(ids[j])) for j in range(500) if j != i)[:7]
        assert sorted((-int(r.score), int(r.id)) for r in got[got.q == i].itertuples()) == want
