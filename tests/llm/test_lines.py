import hashlib
import random
import re
import time
from collections import Counter, defaultdict

from tests.llm.cases import empty_docs, odd_docs, odd_texts, words
from tidymesh.llm import line_dedup
from tidymesh.llm import queries as Q
from tidymesh.llm.line_dedup import dedup_lines


def brute(rows, min_docs=4, min_tokens=3, constant=0.6, long_tokens=50):
    """{id: lines that stay}."""
    docs = defaultdict(list)
    for i, t in rows:
        docs[i] += (t or "").split("\n")
    leaf = {}
    for i, lines in docs.items():
        for line in set(lines):
            ts = [t for t in line.split(" ") if t]
            if len(ts) >= min_tokens and i is not None:
                leaf.setdefault((len(ts), *("*" if re.search("[0-9]", t) else t for t in ts[:2])), []).append((i, line, ts))
    gone = set()
    templates, literal = defaultdict(set), defaultdict(set)
    for found in leaf.values():
        seen = Counter((k, t) for _, _, ts in found for k, t in enumerate(ts))
        for i, line, ts in found:
            if len(ts) >= long_tokens:
                literal[line].add(i)
            fixed = [seen[k, t] >= min_docs for k, t in enumerate(ts)]
            if sum(fixed) >= constant * len(ts):
                templates[tuple(t if f else None for t, f in zip(ts, fixed))].add((i, line))
    for own in templates.values():
        ids = {i for i, _ in own}
        if len(ids) >= min_docs:
            gone |= {(i, line) for i, line in own if i != min(ids)}
    gone |= {(i, line) for line, ids in literal.items() for i in ids if i != min(ids)}
    return {i: [x for x in lines if (i, x) not in gone] for i, lines in docs.items()}


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, dropped = brute(rows), 0
    for r in Q.op2_line_dedup(spark, sf_dir).collect():
        assert r.text_sha256 == hashlib.sha256("\n".join(want[r.doc_id]).encode()).hexdigest()
        assert r.n_lines - r.n_dropped == len(want[r.doc_id])
        dropped += r.n_dropped
    assert dropped > 0


def test_templates(spark):
    rows = [(i, f"{words(i, 12)}\nError {i * 17} in module core at line {i * 3}\nAll rights reserved by us.\n{words(1000 + i, 9)}\n\nshort one") for i in range(40)]
    rows += [(100, "Error 5 in module core at line 9"), (101, "Error in\nmodule core"), (102, None), (103, "")]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    for i, t in rows:
        assert got[i].text == (None if t is None else "\n".join(want[i]))
    assert got[0].n_dropped == 0 and got[7].n_dropped == 2 and got[7].text.split("\n") == [words(7, 12), words(1007, 9), "", "short one"]
    assert got[100].text == "" and got[101].n_dropped == 0


def test_odd(spark):
    got = sorted((r.doc_id, r.text or "") for r in dedup_lines(odd_docs(spark)).collect())
    want = brute(list(enumerate(odd_texts())))
    assert got == [(i, "\n".join(want[i])) for i in range(len(odd_texts()))]
    assert dedup_lines(empty_docs(spark)).count() == 0
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "a b c d"), (4, "a b c d\ne")]
    got = Counter((r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, "a b c d"): 2, (1, "a b c d"): 2, (2, ""): 1, (3, ""): 1, (4, "e"): 1})


def test_long_lines_and_field_marks(spark):
    """A passage of 50 words goes from the second document on; a token like the mark of a field is a token; many lines take no square of time."""
    passage, other = words(1, 60), words(2, 49)
    rows = [(1, f"one line of its own\n{passage}"), (2, passage), (3, f"{other}\nx"), (4, other), (5, f"<*> a {words(3, 2)}")]
    rows += [(10 + i, f"<*> a b c\nzz{i} a b c") for i in range(6)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == {i: "\n".join(x) for i, x in want.items()} and got[2] == "" and got[4] == other

    rng = random.Random(4)
    lines = [f"key{k} has the value of {k % 7} there" for k in range(30_000)]
    rows = [(i, "\n".join(rng.sample(lines, 30_000) + [f"only here {i} and not there {i}"] * 3)) for i in range(4)]
    began = time.perf_counter()
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in got)[0] == 0 and all(r.text in (rows[r.doc_id][1], "\n".join(brute(rows)[r.doc_id])) for r in got)
    assert time.perf_counter() - began < 120


def test_only_constant_tokens_go_on(spark, monkeypatch):
    """What is shuffled to put templates together has no tokens of fields; the result is that of brute force."""
    settle, plans = line_dedup.settle, {}
    monkeypatch.setattr(line_dedup, "settle", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and settle(df, name))
    rows = [(i, f"take the {words(i, 2)} road to {words(500 + i, 3)} now\nthe same old line ends here {i}") for i in range(30)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "\n".join(x) for i, x in brute(rows).items()}
    assert "isnotnull(support" in plans["templates"] and "Filter" in plans["templates"]
    every = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), constant=0.0)
    assert {r.doc_id: r.text for r in every.collect()} == {i: "\n".join(x) for i, x in brute(rows, constant=0.0).items()}
