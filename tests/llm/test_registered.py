"""The registered queries beside their SQL, and the pipeline stage by stage."""

import collections
import itertools
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_points  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_queries import compare, connect  # noqa: E402
from sparkcohort.llm import mixing, quality, sentencepiece_codec  # noqa: E402
from sparkcohort.llm.common import read  # noqa: E402
from sparkcohort.llm.queries import ORACLES, QUERIES  # noqa: E402
from tests.llm.helpers import rows_by  # noqa: E402
from tests.llm.test_models import targets_by_hand  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(entry_points.queries()[name](spark, SMALL), connect(SMALL), ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_a_row_for_each_input_row(spark, name):
    table, key = {"op7": ("pages", "page_id"), "op10": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = entry_points.queries()[name](spark, SMALL)
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in read(spark, SMALL, table).select(key).collect()}


def test_exact_dedup_stays_in_the_jvm(spark):
    plan = QUERIES["op6_exact_dedup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def plain_near_representatives(texts):
    """doc_id -> smallest doc_id of its component under a Jaccard similarity of five-word sets of at least 0.8, over all pairs."""
    grams = {}
    for d, t in texts.items():
        w = re.findall(WORD, t)
        grams[d] = {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for x, y in itertools.combinations(sorted(texts), 2):
        if grams[x] and grams[y] and 9 * len(grams[x] & grams[y]) >= 4 * (len(grams[x]) + len(grams[y])):
            a, b = sorted((find(x), find(y)))
            root[b] = a
    return {d: find(d) for d in texts}


def test_pipeline_stages(spark, tmp_path):
    docs = read(spark, SMALL, "documents")
    columns, seen = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, SMALL).write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        ids = sorted(r.doc_id for r in got.collect())
        if k == 0:
            scores = quality.scored(seen, quality.fit(seen, read(spark, SMALL, "labels")))
            want = sorted(r.doc_id for r in scores.where("predicted = 1").collect())
        elif k == 1:
            first = {}
            for r in seen.collect():
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
                first[key] = min(first.get(key, r.doc_id), r.doc_id)
            want = sorted(first.values())
        elif k == 2:
            want = sorted(set(plain_near_representatives({r.doc_id: r.text or "" for r in seen.collect()}).values()))
        elif k == 3:
            # a balanced sample: every row once or twice or not at all, words of each source near the targets of plain arithmetic
            size = {r.doc_id: (r.source, len(re.findall(WORD, r.text or ""))) for r in seen.collect()}
            taken = collections.Counter(ids)
            assert set(taken) <= set(size) and max(taken.values()) <= 2 and all(size[d][1] for d in taken)
            total = collections.Counter()
            for source, n in size.values():
                total[source] += n
            target = targets_by_hand(total, mixing.WEIGHTS)
            for source in total:
                got_words = sum(size[d][1] * n for d, n in taken.items() if size[d][0] == source)
                assert abs(got_words - target[source]) <= 0.1 * target[source] + 30
            want = ids
        else:
            pieces = sentencepiece_codec.Vocabulary.load()
            back = rows_by(sentencepiece_codec.decode(got.select("doc_id", "ids"), pieces), "doc_id")
            assert all(back[r.doc_id][0]["text"] == r.text for r in seen.collect())
            want = sorted(r.doc_id for r in seen.collect())
        assert ids == want and got.columns[:len(columns)] == columns and (k == 4 or got.columns == columns)
        seen = got
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()) == ids
