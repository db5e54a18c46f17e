"""Extra columns may have any name, also those that operators use inside."""

import random

from sparkcohort.llm import exact_dedup, mixing, ngram_join, sentencepiece_codec
from tests.llm.helpers import documents, prose

NAMES = ("__got", "__row", "__drop", "__gone", "__norm", "__len", "__prefix", "__suspect", "__sha", "ids", "got", "gone", "drop", "time", "c0", "c1", "times", "id")


def clashing(spark):
    rng = random.Random(7)
    texts = [prose(rng, 40) for _ in range(12)]
    docs = documents(spark, [*texts, *texts[:3], texts[5] + " zz", None, ""], ["x", None], extra=False)
    return docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in NAMES]), texts


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_row_operators_keep_clashing_columns(spark):
    docs, texts = clashing(spark)
    bare = docs.select("doc_id", "text", "lang", "source", "n_chars")
    before = {r.doc_id: tuple(r) for r in docs.collect()}
    for run in (exact_dedup.drop_exact_copies, ngram_join.drop_near_copies, mixing.mix):
        got = run(docs)
        assert got.columns == docs.columns
        assert rows(got.select(*bare.columns)) == rows(run(bare)) and all(tuple(r) == before[r.doc_id] for r in got.collect())


def test_encoding_replaces_a_column_called_ids(spark, tmp_path):
    docs, texts = clashing(spark)
    pieces = sentencepiece_codec.Vocabulary.load()
    sentencepiece_codec.encode(docs, pieces, keep=tuple(c for c in docs.columns if c != "doc_id")).write.parquet(f"{tmp_path}/x")
    got = spark.read.parquet(f"{tmp_path}/x")
    assert got.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    back = {r.doc_id: r.again for r in sentencepiece_codec.decode(got, pieces, text="again").collect()}
    assert all(back[k] == t for k, t in enumerate(texts))
