"""Exact dedup, the n-gram join and suffix dedup against brute force, with the odd rows of every kind."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkcohort.llm import exact_dedup, ngram_join, suffix_dedup
from sparkcohort.llm.common import components
from sparkcohort.llm.queries import QUERIES
from tests.llm.helpers import documents, empty, prose, rows_by

RNG = random.Random(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def texts():
    base = [prose(RNG, n) for n in (5, 12, 40, 200, 3, 1)]
    tail = base[3][:-1] + "Z"
    return [*base, None, "", " ", "\n\t ", base[1].replace(" ", " \n "), base[1], base[1], base[2] + " ", tail, prose(RNG, 20_000), base[0], None]


def test_exact_groups(spark, texts):
    got = rows_by(exact_dedup.exact_groups(documents(spark, texts)), "doc_id")
    for k, text in enumerate(texts):
        group = [j for j, t in enumerate(texts) if normal(t) == normal(text)]
        assert got[k] == [{"doc_id": k, "keep_id": group[0], "group_size": len(group), "kept": group[0] == k,
                           "text_sha256": hashlib.sha256(normal(text).encode()).hexdigest()}]


def test_exact_copies_dropped(spark, texts, monkeypatch):
    docs = documents(spark, texts).unionByName(documents(spark, texts[:2]))
    want = sorted(min(j for j, t in enumerate(texts) if normal(t) == n) for n in {normal(t) for t in texts})
    for most in (50_000, 0):                      # beyond the broadcast limit the joins run by shuffle over salted lengths
        monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", most)
        kept = exact_dedup.drop_exact_copies(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == want


def test_exact_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a", "a"], extra=False).unionByName(documents(spark, ["a"], extra=False))
    assert [(r.doc_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).orderBy("doc_id").collect()] == [(0, 3, True), (0, 3, True), (1, 3, False)]
    nulls = docs.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert [(r.keep_id, r.kept) for r in exact_dedup.exact_groups(nulls).collect()] == [(None, True)] * 3


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0
    assert ngram_join.jaccard_join(empty(spark)).count() == 0
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def test_jaccard_join_against_all_pairs(spark, texts):
    # a clique of near copies beyond the size of a small node and of a block, and a chain
    seed = prose(RNG, 300).split()
    near = []
    for k in range(70):
        words = list(seed)
        words[k * 4] = f"edit{k}"
        near.append(" ".join(words))
    chain = [" ".join(seed[:100] + [f"c{j}" for j in range(k * 6)]) for k in range(6)]
    every = [*texts, *near, *chain, near[0], near[0]]
    got = rows_by(ngram_join.jaccard_join(documents(spark, every)), "doc_id")
    sets = [grams(t) for t in every]
    links = {a: {b for b in range(len(every)) if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 - 1e-12}
             for a in range(len(every))}
    for a in links:
        reach, todo = {a}, [a]
        while todo:
            more = links[todo.pop()] - reach
            reach |= more
            todo += more
        assert got[a] == [{"doc_id": a, "class_id": min(reach), "n_links": len(links[a]), "kept": min(reach) == a}]


def test_jaccard_join_cuts_clusters_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    seed = prose(RNG, 200).split()
    every = [" ".join(seed[:k] + [f"e{k}"] + seed[k + 1:]) for k in range(40)]
    got = ngram_join.jaccard_join(documents(spark, every, extra=False)).collect()
    assert all(r.n_links == 39 and r.class_id == 0 for r in got)


def test_near_copies_dropped(spark):
    seed = prose(RNG, 100)
    docs = documents(spark, ["other words are here in this one", seed + " end", seed, None, ""])
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]


def test_runs_reach_the_target_recall():
    assert ngram_join.runs_needed(0.8, 0.9999) == 4
    assert ngram_join.runs_needed(0.9, 0.9) == 1


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def repeats_by_force(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(raw):
        for s in range(len(b) - span + 1):
            seen.setdefault(b[s:s + span], []).append((k, s))
    out = []
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                gone[k][s:s + span] = True
    for b, g in zip(raw, gone):
        left = np.frombuffer(b, np.uint8)[~g].tobytes()
        out.append((len(b), int(g.sum()), int((g & ~np.concatenate([[False], g[:-1]])[:len(g)]).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [2048, 1])
def test_suffix_dedup_against_brute_force(spark, texts, most):
    passage = prose(RNG, 110)[:450]
    page = prose(RNG, 400)
    every = [*texts[:-3], prose(RNG, 30) + passage + prose(RNG, 40), passage, "x" + passage[:399] + "y" + passage[1:], "z" * 1000, "ab" * 700,
             page, page[:700] + "!" + page[701:], page[300:900], page, "é" * 400, passage[:400], passage[10:409]]
    # a small span makes many repeats; with most=1 every shared anchor goes the way of crowded ones
    for span, gram in ((400, 64), (40, 16)):
        got = rows_by(suffix_dedup.without_repeats(documents(spark, every), span=span, gram=gram, most=most), "doc_id")
        for k, want in enumerate(repeats_by_force(every, span)):
            row = got[k][0]
            assert (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) == want
            assert hashlib.sha256(row["kept"]).hexdigest() == row["kept_sha256"]


def passages_by_force(texts, words):
    """(words covered by strings of that many words which start at two places, their maximal runs) of every text."""
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for k, row in enumerate(rows):
        for s in range(len(row) - words + 1):
            seen.setdefault(tuple(row[s:s + words]), []).append((k, s))
    again = [np.zeros(len(row) + 1, bool) for row in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                again[k][s:s + words] = True
    return [(int(x.sum()), int((x[1:] < x[:-1]).sum())) for x in again]


@pytest.mark.parametrize("most", [2048, 1])
def test_suffix_dedup_passages_against_brute_force(spark, texts, most):
    short = " ".join(prose(RNG, 1)[:4] for _ in range(51))
    longer = prose(RNG, 140)
    every = [*texts[:-3], prose(RNG, 30) + " " + short + " " + prose(RNG, 40), short.replace(" ", "\n\t"), short[:-1] + "Z", short.rsplit(" ", 1)[0], "w " * 80, "a b " * 60,
             longer, longer + " " + longer[5:], prose(RNG, 20) + " " + longer, "é " * 51, "é" * 400, longer.replace(" ", "\u00a0"), longer]
    assert len(short.encode()) < 400
    for words, gram in ((51, 8), (9, 3)):
        got = rows_by(suffix_dedup.without_repeats(documents(spark, every), words=words, word_gram=gram, most=most), "doc_id")
        assert [(got[k][0]["n_passage_words"], got[k][0]["n_passages"]) for k in range(len(every))] == passages_by_force(every, words)
        assert [got[k][0]["n_removed"] for k in range(len(every))] == [want[1] for want in repeats_by_force(every, 400)]


def test_suffix_dedup_finds_benchmark_passages_under_the_span(spark, tmp_path):
    """Passages of over 50 words that lie in two documents, all shorter than a string that is removed."""
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect() if len(r.text.split()) > 50]
    assert items and max(len(t.encode()) for t in items) < suffix_dedup.SPAN
    every = [f"{prose(RNG, 60)}\n{t} {prose(RNG, 60)}" for t in items * 2] + [prose(RNG, 200) for _ in items]
    documents(spark, every, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_by(QUERIES["op1_suffix_array_dedup"](spark, str(tmp_path)), "doc_id")
    want = passages_by_force(every, suffix_dedup.WORDS)
    assert [(got[k][0]["n_removed"], got[k][0]["n_passage_words"], got[k][0]["n_passages"]) for k in range(len(every))] == [(0, *w) for w in want]
    assert all(w[0] > 50 for w in want[:2 * len(items)]) and want[2 * len(items):] == [(0, 0)] * len(items)


def test_suffix_dedup_leaves_runs_of_hot_anchors_in_place(spark, monkeypatch):
    passage = prose(RNG, 130)
    every = [f"{prose(RNG, 40)} {passage} {prose(RNG, k)}" for k in range(30)] + ["w " * 900] * 3 + [prose(RNG, 300)] * 2
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    got = rows_by(suffix_dedup.without_repeats(documents(spark, every)), "doc_id")
    assert [got[k][0]["n_removed"] for k in range(len(every))] == [want[1] for want in repeats_by_force(every, 400)]
    assert [(got[k][0]["n_passage_words"], got[k][0]["n_passages"]) for k in range(len(every))] == passages_by_force(every, 51)


def test_suffix_dedup_counts_repeated_rows(spark):
    docs = documents(spark, [prose(RNG, 200)], extra=False)
    assert suffix_dedup.without_repeats(docs).first()["n_removed"] == 0
    twice = suffix_dedup.without_repeats(docs.unionByName(docs)).collect()
    assert len(twice) == 2 and all(r.n_removed == r.n_bytes and r.kept == b"" for r in twice)


def test_long_text_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    data = np.frombuffer(("q" * 50 + prose(RNG, 900)).encode(), np.uint8)
    whole = suffix_dedup.anchor_runs(data, np.array([0, len(data)]), 400, 64)
    parts = [suffix_dedup.anchor_runs(data[b:b + 1399], np.array([0, len(data[b:b + 1399])]), 400, 64) for b in range(0, len(data) - 399, 1000)]
    starts = lambda runs, shift=0: [s + shift for lo, hi in zip(runs[1], runs[2]) for s in range(lo, hi + 1)]
    assert starts(whole) == [s for k, p in enumerate(parts) for s in starts(p, 1000 * k)] == list(range(len(data) - 399))


def test_bucket_pointers_are_suffix_order():
    data = np.frombuffer(b"mississippi river mississippi delta mississippi", np.uint8)
    n = len(data)
    pointer = suffix_dedup.refined_pointers(data, np.full(n, n), 16)
    full = range(n - 15)
    raw = data.tobytes()
    for i in full:
        for j in full:
            a, b = raw[i:i + 16], raw[j:j + 16]
            assert (pointer[i] < pointer[j]) == (a < b) or a == b and pointer[i] == pointer[j]
