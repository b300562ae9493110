"""Small tables with the cases every operator must bear: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abdeghilnorstuv") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_texts() -> list[str | None]:
    long = words(1, 20_000)
    base = words(2, 120)
    near = base.split()
    near[60] = "changed"
    return [None, "", " ", "a", "one two three", base, base, " ".join(near), long, long, long + " tail", "é" * 300, "Übergroße\tWörter\nund 日本語 😀 text", "x" * 50_000, base.upper(), words(3, 30)]


def odd_docs(spark, extra: bool = True):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in ("kept", "keep_id", "size", "shard", "score", "__n", "n", "key", "spans", "component_id"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
