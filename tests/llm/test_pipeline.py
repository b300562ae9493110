import re

import corpus_pipeline as P
import public_tokenizers as tok
from tokenizers import Tokenizer

from tests.llm.cases import empty_docs
from tests.llm.test_jaccard import brute
from tests.llm.test_native import brute_base
from tidymesh.llm.common import settle


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {"documents": {r.doc_id: r for r in docs.collect()}}
    last = "documents"
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
            rows[name] = {r.doc_id: r for r in docs.collect()}
            assert set(rows[name]) <= set(rows[last])
            last = name
    gone = set(rows["documents"]) - set(rows["toxicity"])
    judged = [labels[i] for i in gone if i in labels]
    assert sum(judged) >= 0.9 * len(judged)

    before, after = rows["toxicity"], rows["exact dedup"]
    assert set(after) == set({r.text: i for i, r in sorted(before.items())}.values())

    before, after = after, rows["n-gram Jaccard join"]
    assert set(after) == {i for i, _, c in brute([(i, r.text) for i, r in sorted(before.items())]) if i == c}

    before, after = after, rows["secret scan"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.n_chars == len(r.text) and not brute_base(r.text)
        pieces = r.text.split("[SECRET]")
        assert re.fullmatch(".+?".join(map(re.escape, pieces)), before[i].text, re.S) and (len(pieces) > 1) == (r.text != before[i].text)
        assert len(pieces) > 1 or not brute_base(before[i].text)

    full = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    packed = sorted(docs.collect(), key=lambda r: (r.doc_id, r.piece))
    for i, r in after.items():
        own = [p for p in packed if p.doc_id == i]
        assert [x for p in own for x in p.ids] == [*full.encode(r.text, add_special_tokens=False).ids, 2]


def test_empty(spark, sf_dir):
    docs = empty_docs(spark)
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    assert docs.count() == 0


def test_odd(spark, sf_dir):
    texts = [None, "", "a", "a", "b c d e f g", "key token=abcdef123", "é" * 5000]
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None)], empty_docs(spark).schema)
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    kept = {r.doc_id for r in docs.collect()}
    assert {3, 4, 5, 6} <= kept and 2 not in kept and len(kept & {0, 1, None}) == 1


def test_each_stage_is_computed_once(spark, sf_dir, monkeypatch):
    seen = {name: spark.sparkContext.accumulator(0) for name, _ in P.STAGES}

    def counted(name, stage):
        def run(spark, docs, sf_dir):
            def count(batches):
                for batch in batches:
                    seen[name].add(batch.num_rows)
                    yield batch

            out = stage(spark, docs, sf_dir)
            return out.mapInArrow(count, out.schema)

        return name, run

    monkeypatch.setattr(P, "STAGES", [counted(*x) for x in P.STAGES])
    n = P.run(spark, sf_dir).count()
    counts = [x.value for x in seen.values()]
    assert counts[-1] == n and counts[2] == counts[3] <= counts[1] <= counts[0] <= 200


def test_clashing_columns(spark, sf_dir):
    names = ["kept", "keep_id", "group_size", "text_sha256", "score", "id", "size", "row", "secret_spans", "component_id"]
    texts = ["a b c", "a b c", "d e f g h i", "token=abcdef123"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], empty_docs(spark).schema)
    docs = docs.selectExpr("*", *(f"concat('own', doc_id) AS {c}" for c in names))
    for name, stage in P.STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == [*empty_docs(spark).columns, *names]
        for r in docs.collect():
            assert all(r[c] == f"own{r.doc_id}" for c in names)
    assert {r.doc_id: r.text for r in docs.collect()} == {1: "a b c", 2: "d e f g h i", 3: "[SECRET]"}
