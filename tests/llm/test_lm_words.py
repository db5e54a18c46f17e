"""Language models against counts of real words."""

import math
import random
from collections import Counter

import pytest

from sparkcohort.llm import lm_scoring, queries
from tests.llm.helpers import documents, rows_by


def corpus():
    """More words than the hash classes of 16 bits can keep apart, some in nearly every document, most once."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randint(0, 40)}", f"rare{rng.randint(0, 9000)}"]) for _ in range(rng.randint(1, 90))) for _ in range(200)]
    return [*texts, None, "", " \n", "the", "once", "once", "own own own own x own", texts[0]], set(range(0, 208, 3))


def by_definition(texts, target, leave_words=False):
    docs = [(t or "").split() for t in texts]
    pairs = [list(zip(["", *d], d)) for d in docs]
    bigram, context, word = ([Counter(), Counter()] for _ in range(3))
    for k, doc in enumerate(pairs):
        for m in ((0, 1) if k in target else (1,)):
            bigram[m].update(doc)
            context[m].update(a for a, _ in doc)
            word[m].update(b for _, b in doc)
    mass = [sum(w.values()) for w in word]
    scale = [1.0, mass[0] / mass[1]]
    size = max(lm_scoring.CLASSES, len(word[1]))
    for k, doc in enumerate(pairs):
        loss, own, own_context = [0.0, 0.0], Counter(doc), Counter(a for a, _ in doc)
        own_word = Counter(b for _, b in doc)
        for (a, b), n in own.items():
            for m in (0, 1):
                mine = m == 1 or k in target
                out = mine and leave_words
                prior = ((scale[m] * (word[m][b] - out * own_word[b]) + lm_scoring.FLOOR)
                         / (scale[m] * (mass[m] - out * len(doc)) + lm_scoring.FLOOR * size))
                loss[m] -= n * math.log((scale[m] * (bigram[m][a, b] - mine * n) + lm_scoring.STRENGTH * prior)
                                        / (scale[m] * (context[m][a] - mine * own_context[a]) + lm_scoring.STRENGTH))
        yield len(doc), [x / max(len(doc), 1) for x in loss]


@pytest.mark.parametrize("numbered", [None, 0, 1, 40])
def test_words_do_not_share_counts(spark, numbered):
    texts, target = corpus()
    frame = spark.createDataFrame([(k,) for k in target], "doc_id long")
    got = rows_by(lm_scoring.cross_entropy_difference(documents(spark, texts), frame, **({} if numbered is None else {"most_numbered": numbered})), "doc_id")
    for k, (n, want) in enumerate(by_definition(texts, target)):
        (row,) = got[k]
        assert row["n_tokens"] == n
        assert [row["ce_target"], row["ce_background"]] == pytest.approx(want, abs=2e-5)


def test_vocabulary_grows_with_the_documents(spark, monkeypatch):
    """Small constants, so that most words are beyond the numbers and the vocabulary is larger than its least size."""
    texts, target = corpus()
    monkeypatch.setattr(lm_scoring, "CLASSES", 64)
    frame = spark.createDataFrame([(k,) for k in target], "doc_id long")
    got = rows_by(lm_scoring.cross_entropy_difference(documents(spark, texts), frame, most_numbered=63), "doc_id")
    for k, (n, want) in enumerate(by_definition(texts, target)):
        assert [got[k][0]["ce_target"], got[k][0]["ce_background"]] == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("numbered", [0, 40, 65_535])
def test_own_words_leave_the_unigram_models(spark, numbered):
    texts, target = corpus()
    frame = spark.createDataFrame([(k,) for k in target], "doc_id long")
    got = rows_by(lm_scoring.cross_entropy_difference(documents(spark, texts), frame, most_numbered=numbered, leave_words=True), "doc_id")
    for k, (n, want) in enumerate(by_definition(texts, target, leave_words=True)):
        assert [got[k][0]["ce_target"], got[k][0]["ce_background"]] == pytest.approx(want, abs=2e-5)


def test_query_leaves_own_words_out(spark, tmp_path):
    texts, target = corpus()
    documents(spark, texts, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k in target), 0) for k in range(len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = rows_by(queries.op9_lm_scoring(spark, str(tmp_path)), "doc_id")
    for k, (n, want) in enumerate(by_definition(texts, target & set(range(len(texts))), leave_words=True)):
        assert [got[k][0]["ce_target"], got[k][0]["ce_background"]] == pytest.approx(want, abs=2e-5)


def test_tasks_of_several_buckets_and_copies(spark, monkeypatch):
    """Many buckets, each with several copies of its table, dealt to three tasks."""
    texts, target = corpus()
    for name, value in (("SLICE", 2_000), ("PACKS", 4), ("BUCKET_TOKENS", 100), ("RARE_TOKENS", 50), ("MOST_PARTS", 3)):
        monkeypatch.setattr(lm_scoring, name, value)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        frame = spark.createDataFrame([(k,) for k in target], "doc_id long")
        scores = lm_scoring.cross_entropy_difference(documents(spark, texts), frame, most_numbered=40, leave_words=True)
        got = rows_by(scores, "doc_id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    for k, (n, want) in enumerate(by_definition(texts, target, leave_words=True)):
        assert [got[k][0]["ce_target"], got[k][0]["ce_background"]] == pytest.approx(want, abs=2e-5)
