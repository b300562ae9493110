import random
import re

from pyspark.sql import functions as F

from tests.llm.cases import empty_docs, odd_docs, odd_texts, words
from tidymesh.llm import queries as Q
from tidymesh.llm.jaccard_join import jaccard_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """[(id, set size, smallest id reachable)] in the rows' order."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows)]


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df)) == sorted(brute(rows), key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(Q.op3_jaccard_join(spark, sf_dir)) == sorted(brute(rows), key=str)


def test_odd(spark):
    rows = list(enumerate(odd_texts()))
    assert got(jaccard_components(odd_docs(spark).withColumn("id", F.lit("x")).drop("component_id"))) == sorted(brute(rows), key=str)
    assert jaccard_components(empty_docs(spark)).count() == 0
    check(spark, [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, "A\tB c"), (5, None), (5, ""), (None, "z"), (6, "b a c")])


def mutated(rng, base, n):
    w = base.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"w{rng.randrange(10**9)}"
    return " ".join(w)


def test_near_copies_and_common_passages(spark):
    """Stars, chains, borderline pairs, a passage in all documents, and documents that are little but a common passage."""
    rng = random.Random(7)
    texts = []
    for b in range(6):
        base = words(100 + b, rng.randint(20, 150))
        texts += [base] + [mutated(rng, base, rng.randint(1, max(1, len(base.split()) // 25))) for _ in range(20)]
        chain = base
        for _ in range(15):
            chain = mutated(rng, chain, 2)
            texts.append(chain)
    passage = words(55, 60)
    texts += [f"{words(1000 + i, rng.randint(1, 40))} {passage}" for i in range(120)]
    texts += [f"{passage} {words(2000 + i, rng.randint(4, 16))}" for i in range(120)]
    texts += [" ".join(passage.split()[rng.randint(0, 12) :]) for _ in range(40)]
    texts += [texts[0]] * 50 + ["same short"] * 30 + ["one"] * 10
    rng.shuffle(texts)
    check(spark, [(i * 3 + 1, t) for i, t in enumerate(texts)])


def test_random_small(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for i in range(400)]
    check(spark, rows)
