import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs, odd_texts
from tidymesh.llm import queries as Q
from tidymesh.llm.toxicity import SHAPES, DECAY, fit, fit_toxicity, kernel, score_toxicity, units, windows

SYLLABLES = ["an", "ther", "or", "il", "men", "to", "ra", "es", "und", "ci"]


def text(rng, bad=None):
    w = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
    if bad:
        w.insert(rng.randrange(len(w)), bad)
    return " ".join(w) + "."


def brute_kernel(a, b):
    def phi(w):
        out = []
        for shape in SHAPES:
            for i in range(len(w) - shape[-1]):
                out.append((w[i] + "".join(w[i + k] for k in shape), DECAY ** (shape[-1] - len(shape)), len(shape)))
        return out

    x, y = phi(a), phi(b)
    norm = np.sqrt(sum(w * w for _, w, _ in x) * sum(w * w for _, w, _ in y))
    return sum(u * v for s, u, p in x for t, v, q in y if s == t and p == q) / norm


def test_kernel_brute():
    words = ["^idiot$", "^idxiot$", "^ont$", "^banana$", "^idiots$", "^größe$"]
    got = kernel(words, words)
    want = np.array([[brute_kernel(a, b) for b in words] for a in words])
    assert np.abs(got - want).max() < 1e-5
    assert got[0, 1] > 2 * got[0, 3] and got[0, 1] > 0.3


def test_units():
    assert units("You I-D.i*ot, an i d i o t!\nB c") == {"you", "idiot", "an", "i", "d", "o", "t", "b", "c"}
    assert units("") == set() and units(" \n") == set()
    long = "ab" * 100
    assert "".join(x[:16] for x in windows(long)).startswith("^ab") and windows(long)[-1].endswith("$")


def test_held_out_accuracy_on_variants():
    rng = random.Random(1)
    insults = ["idiot", "worthless", "moronic", "scumbag"]
    texts = [text(rng, rng.choice(insults)) if i % 4 == 0 else text(rng) for i in range(800)]
    model = fit(texts, [int(i % 4 == 0) for i in range(800)])
    from tidymesh.llm.toxicity import features

    def score(t):
        w = sorted(units(t))
        return model.probability(features(model.values(w), np.array([len(w)])))[0]

    assert all(score(text(rng, b)) > 0.5 for b in insults for _ in range(10))
    assert all(score(text(rng, b)) > 0.3 for b in ("id-iot", "i d i o t", "worthlxess", "s.c.u.m.b.a.g", "Moronic!!", "idiots"))
    assert sum(score(text(rng)) > 0.3 for _ in range(200)) <= 4


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op1_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    judged = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(s >= 0.3 and y for s, y in judged)
    assert hit >= 0.85 * sum(y for _, y in judged) and hit >= 0.9 * sum(s >= 0.3 for s, _ in judged)


def test_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    for labels in (none, spark.createDataFrame([(5, 1, 1), (None, 1, 0), (3, 1, None)], none.schema)):
        rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
        assert len(rows) == len(odd_texts()) and all(0 <= r.score <= 1 for r in rows)
    labels = spark.createDataFrame([(i, 1, int(i in (5, 6))) for i in range(16)] + [(5, 1, 1)], none.schema)
    rows = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert all(0 <= r.score <= 1 for r in rows) and {r.score for r in rows if r.doc_id < 3} == {rows[0].score}
    assert score_toxicity(empty_docs(spark), fit_toxicity(empty_docs(spark), none)).count() == 0
    assert score_toxicity(docs.withColumn("text", F.lit("a")), fit_toxicity(docs, labels)).count() == len(odd_texts())


def test_long_words_and_texts(spark):
    """An insult far inside a run without spaces teaches; so do long clean texts; an id's rows and contradictory labels stay bounded."""
    rng = random.Random(3)
    run = lambda bad: "".join(rng.choice(SYLLABLES) for _ in range(25)) + bad + "".join(rng.choice(SYLLABLES) for _ in range(10))
    texts = [f"{text(rng)} {run('scumbag' if i % 4 == 0 else 'es')}" for i in range(800)]
    model = fit(texts, [int(i % 4 == 0) for i in range(800)])
    rows = score_toxicity(spark.createDataFrame([(i, f"{text(rng)} {run('scumbag' if i % 2 else 'un')}") for i in range(100)], "id long, text string"), model).collect()
    assert sum(r.score > 0.3 for r in rows if r.id % 2) >= 45 and sum(r.score > 0.3 for r in rows if not r.id % 2) <= 5

    docs = [(i, text(rng, "moronic" if i % 4 == 0 else None)) for i in range(400)] + [(1, text(rng))] * 300 + [(1000, " ".join(text(rng) for _ in range(300)))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1000, 1, 0), (3, 1, 1)]
    model = fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), chars=2_000)
    rows = score_toxicity(spark.createDataFrame([(i, text(rng, "moronic" if i % 2 else None)) for i in range(60)], "id long, text string"), model).collect()
    assert sum(r.score > 0.3 for r in rows if r.id % 2) >= 27 and sum(r.score > 0.3 for r in rows if not r.id % 2) <= 3


def test_scores_against_brute_force(spark):
    """Each score is that of the machine's weights summed over all subsequences of each window, the greatest of a text taken to a probability."""
    rng = random.Random(8)
    texts = [text(rng, rng.choice(["worthless", "idiot"])) if i % 3 == 0 else text(rng) for i in range(300)]
    model = fit(texts, [int(i % 3 == 0) for i in range(300)])
    for r in score_toxicity(spark.createDataFrame([(t,) for t in texts[:60]] + [(None,), ("",)], "text string"), model).collect():
        values = sorted((max(float(model.values([w])[0]), -2.0) for w in units(r.text or "")), reverse=True)
        x = np.array([*(values + [-2.0] * 3)[:3], np.log1p(len(values))])
        assert abs(r.score - 1 / (1 + np.exp(-(x @ model.link[:-1] + model.link[-1])))) < 1e-4
