"""The filter audit against a count of every document at every step of every order."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidymesh.llm.filter_audit import audit_filters, audit_orders, failure_flags

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def failures(docs):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, s in docs:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        out.append((i, s or "", {k for k, v in fails.items() if v}))
    return out


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    rows, shapley = {}, Counter()
    told = failures(docs)
    for part in {s for _, s, _ in told}:
        own = [(i, f) for i, s, f in told if s == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                removed = [i for i, f in own if x in f and not f & before]
                shapley[part, x] += len(removed)
                rows[part, "".join(order), k + 1] = [
                    sum(not f & (before | {x}) for _, f in own), len(removed), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own),
                    sum(i in good for i in removed), sum(i in toxic for i in removed),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def told(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(out) == len(rows)
    return out


def test_audit_of_odd_documents(spark):
    many = " ".join(f"word{i}" for i in range(60))
    docs = [
        (1, many, "a"), (2, many, "b"), (2, many, "b"), (3, many.upper(), "a"), (4, many + " # x", None), (5, None, "a"), (6, "", ""), (7, "same " * 80, "a"), (None, many, "a"), (None, None, "a"),
        (8, "x\x0by\tz\r\n" * 30, "b"), (9, "long " + many * 200, "a"), (10, "É" * 60, "a"), (11, "a b" * 50, "c"), (12, many + " $", "a"), (13, many, "a"), (14, "AB", "only"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (5, 1, 0), (7, None, 1), (7, 1, 0), (None, 1, 1), (13, 1, 0), (99, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumn("part", F.lit("clash")).withColumn("A", F.lit(True)).withColumn("keep_id", F.lit(0)).withColumn("n", F.lit(1))
    got = told(audit_filters(df, spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels) and len(got) == 5 * 600


def test_audit_of_hot_groups(spark):
    docs = [(i, "the same text" if i % 3 else None if i % 2 else f"text {i}", "hot" if i % 4 else f"s{i % 8}") for i in range(600)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 3)]
    assert told(audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))) == brute(docs, labels)


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit_filters(docs, labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, "a", "s")], DOCS), labels)
    assert one.count() == 600 and one.where("kept <> 0").count() == 240  # A fails: what is before it keeps the row
    assert failure_flags(docs, labels).columns == ["part", *"ABCDE", "good", "toxic"]


def test_other_filters(spark):
    rows = spark.createDataFrame([("p", True, False), ("p", True, True), ("p", False, False)], "part string, x boolean, y boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit_orders(rows, "xy", lost=()).collect()}
    assert got == {("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (1, 0, 1, 0, 1), ("yx", 1): (2, 1, 0, 0, 1), ("yx", 2): (1, 1, 1, 1, 3)}
    with pytest.raises(ValueError):
        audit_orders(rows, "abcdefgh")
