"""Small tables with nulls, ties, repeated rows, long texts and extra columns whose names the operators use themselves."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASHING = ("id", "rep", "key", "kept", "size", "target", "score", "node", "__sha", "a.b")


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(words))


def documents(spark, texts, sources=None, extra=True):
    rows = [(k, t, "en", (sources or ["s"])[k % len(sources or ["s"])], len(t or "")) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in CLASHING if extra else ():
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame


def empty(spark):
    return documents(spark, [])


def rows_by(frame, key):
    got = {}
    for row in frame.collect():
        got.setdefault(row[key], []).append(row.asDict())
    return got
