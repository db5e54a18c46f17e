"""Mixing, classifier, codec, pages, personal data, language models and embeddings."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkcohort.llm import embedding_dedup, html_extract, lm_scoring, mixing, pii, quality, sentencepiece_codec
from tests.llm.helpers import documents, empty, prose, rows_by

RNG = random.Random(8)


def targets_by_hand(sizes, weights, share=1.5, most=2):
    """Reshare the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_targets_and_balance(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(3000)] + [None, "", prose(rng, 5000)]
    sources = ["b", None, "a", "hot", "hot", "hot", "é", "empty"]
    docs = documents(spark, [None if k % 8 == 7 else t for k, t in enumerate(texts)], sources)
    got = rows_by(mixing.mixed_sizes(docs, chunk=256), "doc_id")
    size, taken, target = Counter(), Counter(), {}
    for k, t in enumerate(texts):
        s, n = sources[k % 8], len((t or "").split()) if k % 8 != 7 else 0
        row = got[k][0]
        assert row["size"] == n and row["taken"] in (0, n, 2 * n)
        size[s] += n
        taken[s] += row["taken"]
        target[s] = row["target"]
    want = targets_by_hand(size, mixing.WEIGHTS)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 130
    again = rows_by(mixing.mixed_sizes(docs.repartition(7), chunk=256), "doc_id")
    assert again == got


def test_landing_ends_near_the_target():
    # short documents make up for every draw: what is left is less than the shortest one; probabilities are kept on average
    size = np.random.default_rng(3).integers(5, 400, 300).astype(float)
    p = np.full(300, 0.37)
    runs = np.array([mixing.fly(p, size, np.random.default_rng(k), True) for k in range(300)])
    assert set(np.unique(runs)) == {0.0, 1.0} and np.quantile(abs(runs @ size - p @ size), 0.99) <= 3 * size.min()
    assert abs(runs.mean(0) - 0.37).max() < 0.15
    # one document outweighs all others: the better of both choices is made
    for share, want in ((0.94, 1.0), (0.2, 0.0)):
        got = mixing.fly(np.full(4, share), np.array([3000.0, 60.0, 50.0, 0.0]), np.random.default_rng(1), True)
        assert got[0] == want


def test_mix_repeats_rows(spark):
    docs = documents(spark, ["a b c"] * 40, ["x", "y"])
    mixed, got = mixing.mix(docs), rows_by(mixing.mixed_sizes(docs), "doc_id")
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == {k: v[0]["taken"] // 3 for k, v in got.items() if v[0]["taken"]}
    assert mixing.mixed_sizes(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    twice = mixing.mixed_sizes(docs.unionByName(docs))
    assert twice.count() == 80


def test_flight_keeps_totals_and_probabilities():
    size = np.random.default_rng(2).integers(0, 500, 400).astype(float)
    size[:7] = 3
    p = np.full(400, 0.37)
    runs = np.array([mixing.fly(p, size, np.random.default_rng(k), False) for k in range(300)])
    assert ((runs > 0) & (runs < 1)).sum(1).max() <= 2
    assert np.allclose(runs.sum(1), p.sum()) and np.allclose(runs @ size, p @ size)
    assert abs(runs.mean(0) - 0.37).max() < 0.15
    assert set(np.unique(mixing.fly(p, size, np.random.default_rng(1), True))) <= {0.0, 1.0}


def test_classifier_held_out_and_odd_rows(spark):
    rng = random.Random(5)
    good = [prose(rng, rng.randint(20, 200)).capitalize() + "." for _ in range(260)]
    bad = [" ".join([prose(rng, 1).upper() + "!!"] * rng.randint(5, 50)) if k % 2 else " | ".join(prose(rng, 1) + "%%%" for _ in range(40)) for k in range(140)]
    texts = good + bad + [None, "", "a", good[0]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 260), 0) for k in range(400)] + [(3, None, 0), (None, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = rows_by(quality.scored(docs, model), "doc_id")
    held = [k for k in range(400) if got[k][0]["held_out"]]
    assert sum(got[k][0]["predicted"] == (k < 260) for k in held) / len(held) > 0.95
    assert all(0 <= got[k][0]["score"] <= 1 for k in got) and got[400][0]["score"] == pytest.approx(model.prior)
    good_rows = quality.keep_good(docs, model)
    assert good_rows.columns == docs.columns
    assert {r.doc_id for r in good_rows.collect()} == {k for k in got if got[k][0]["predicted"]}
    assert quality.scored(empty(spark), model).count() == 0
    blank = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.scored(docs, blank).collect()} == {0.5}


def test_classifier_votes_by_exact_cosines():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (40, quality.FEATURES + quality.STYLE)).astype(np.float32)
    model = quality.Model(counts[:30], (np.arange(30) % 3 == 0).astype(float))
    for row, score in zip(counts[30:], model.scores(counts[30:])):
        x = model.weighted(row[None])[0] @ model.projection
        cosine = np.clip([x @ v / np.linalg.norm(x) for v in model.vectors], 0, 1)
        near = np.argsort(-cosine)[:quality.NEIGHBOURS]
        vote = cosine[near] ** quality.SHARPNESS
        assert score == pytest.approx((vote * model.labels[near]).sum() / vote.sum(), abs=1e-4)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_codec.Vocabulary.load()


def test_codec_round_trip(spark, pieces):
    texts = [None, "", " ", "  a  b ", "日本語 テスト\n\t🎉 x", "a▁b ▁", "é" * 50, "x" * 3000, "    ", "\n\n", prose(RNG, 3000), "Hello world.", "Hello world."]
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(documents(spark, texts), pieces), pieces)
    got = rows_by(both, "doc_id")
    assert [got[k][0]["text"] for k in range(len(texts))] == [t or "" for t in texts]
    assert got[0][0]["ids"] == [] and sentencepiece_codec.encode(empty(spark), pieces).count() == 0


def test_codec_finds_the_best_segmentation(pieces):
    rng = random.Random(4)
    score = dict(zip(pieces.keys.tolist(), pieces.scores.tolist()))
    for _ in range(60):
        word = "▁" + "".join(rng.choice("theingaoésr,.0★") for _ in range(rng.randint(1, 14)))
        best = [0.0] + [-math.inf] * len(word)
        for b in range(1, len(word) + 1):
            for a in range(max(0, b - pieces.longest), b):
                s = score.get(pieces.key(word[a:b]), pieces.unknown_score if b - a == 1 else -math.inf)
                best[b] = max(best[b], best[a] + s)
        _, ids, char = pieces.segment(np.array([[ord(c) for c in word]], np.uint64))
        by_id = dict(zip(pieces.ids.tolist(), pieces.scores.tolist()))
        assert sum(by_id.get(i, pieces.unknown_score) for i in ids.tolist()) == pytest.approx(best[-1])


def test_codec_equals_the_unigram_library(pieces):
    sp = pytest.importorskip("sentencepiece")
    model = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = model.ModelProto()
    proto.ParseFromString(open(sentencepiece_codec.MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000.0)       # the library adds scores in single precision
    library = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["The quick brown fox, 12.5 jumps over the lazy dog$$$ and so on.", "Ça va? Où est la bibliothèque!", "aaaa bbbb &&& cccc"]
    raw = [t.encode() for t in texts]
    ids, at = pieces.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(t) for t in texts]


PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>x y</a></li></ul></nav><div class='ad'>buy it now</div>"
    "<article><h1>Head &amp; more</h1><p>One <b>two</b>\n three&nbsp;four<br>five<p>six &lt;b&gt; <a href=/>seven</a></article><footer>&copy; me</footer>":
        "Head & more\nOne two three four five\nsix <b> seven",
    "<article><p>a b<script>var t='</p>';</script> c</p><!-- <p>no</p> --><aside>side words</aside><div class='comments'><p>nice one</p></div><p>d</article>": "a b c\nd",
    "": "", None: "", "<nav><a href=/>only</a></nav>": "",
    "<article><p>open tag <em>at the end": "open tag at the end",
    "<article><p>1 < 2 and <3</p><p title=\"a>b\">x</p><form><input name=q><p>send</p></form></article><p": "1 < 2 and <3\nx",
}


def test_pages(spark):
    rows = [(k, f"u{k}", p, "x") for k, p in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = rows_by(html_extract.extract(pages), "page_id")
    for k, want in enumerate(PAGES.values()):
        assert got[k] == [{"page_id": k, "url": f"u{k}", "text": want, "n_chars": len(want)}]
    long = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    assert html_extract.extract(pages.selectExpr("page_id", "url", f"'{long}' AS html")).first()["text"] == "\n".join(["word"] * 30_000)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_page_tree_separates_its_table():
    tree = html_extract.trained()
    x, y = [], []
    for page in html_extract.sample_pages():
        texts, rows = html_extract.blocks(page)
        x += rows
        y += [t.startswith("#") for t in texts]
    assert (tree.predict(np.array(x, float)) == np.array(y)).mean() > 0.99


def test_base_spans():
    text = "mail a.b+c@x-y.example.com. ip 10.0.0.255 and 1.2.3.256 then 1.2.3.4.5; card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (555) 123-4567 ☎ é"
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert found == [("email", "a.b+c@x-y.example.com"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567")]
    assert pii.base_spans("0000000010.1.1.1 " + "9" * 5000) == [(0, 1, 16)]


def test_personal_data_rows(spark):
    texts = [None, "", "no data here", "é ☎ mail me@example.com now and 192.168.0.1", "call (555) 123-4567 today, or 5803870406416778", "9" * 3000,
             prose(RNG, 5000) + " x@y.org"]
    got = rows_by(pii.find(documents(spark, texts)), "doc_id")
    for k, text in enumerate(texts):
        base = pii.named(pii.base_spans(text or ""))
        row = got[k][0]
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(row["spans"].split(","))
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [base.count(f"{kind}:") for kind in pii.KINDS]
    assert got[2][0]["spans"] == "" and "phone:5:19" in got[4][0]["spans"] and "card" not in got[4][0]["spans"]
    assert pii.find(empty(spark)).count() == 0


def test_tagger_gradient_and_held_out_spans():
    rng = np.random.default_rng(0)
    model = pii.Tagger(rng)
    chars, tags = rng.integers(0, pii.CLASSES, (7, 4)), rng.integers(0, pii.TAGS, (7, 4))

    def loss():
        e, total = model.emissions(chars), 0.0
        for r in range(4):
            ahead, path = e[0, r], e[0, r, tags[0, r]]
            for t in range(1, 7):
                ahead = np.log(np.exp(ahead[:, None] + model.p["move"]).sum(0)) + e[t, r]
                path += model.p["move"][tags[t - 1, r], tags[t, r]] + e[t, r, tags[t, r]]
            total += np.log(np.exp(ahead).sum()) - path
        return total / 4

    for name, g in model.gradient(chars, tags).items():
        at = (chars[3, 1], 2) if name[0] == "x" else tuple(int(rng.integers(n)) for n in g.shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], abs=1e-5)
        model.p[name][at] = old
    right = said = true = 0
    for _ in range(150):
        text, spans = pii.sentence(rng)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        b, e, k = pii.added_spans(pii.trained(), points, np.array([0, len(points)]))
        got = set(zip(b.tolist(), k.tolist(), e.tolist()))
        right, said, true = right + len(got & set(spans)), said + len(got), true + len(spans)
    assert right / true > 0.85 and right / said > 0.85


def test_language_models_against_brute_force(spark):
    rng = random.Random(6)
    words = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choice(words[:40] if k % 3 else words[20:]) for _ in range(rng.randint(1, 80))) for k in range(120)] + [None, "", "\n", "one"]
    target = {k for k in range(0, 124, 3)}
    docs = documents(spark, texts)
    frame = spark.createDataFrame([(k,) for k in target] + [(None,), (9_999,), (3,)], "doc_id long")
    got = rows_by(lm_scoring.cross_entropy_difference(docs, frame), "doc_id")
    pairs = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        before, word, _ = lm_scoring.tokens(raw, np.array([0, len(raw)]))
        pairs.append(list(zip(before.tolist(), word.tolist())))
    bigram, context, unigram = [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)], [defaultdict(int), defaultdict(int)]
    for k, doc in enumerate(pairs):
        for m in ((0, 1) if k in target else (1,)):
            for a, b in doc:
                bigram[m][a, b] += 1
                context[m][a] += 1
                unigram[m][b] += 1
    mass = [sum(u.values()) for u in unigram]
    scale = [1.0, mass[0] / mass[1]]
    for k, doc in enumerate(pairs):
        loss, own, own_context = [0.0, 0.0], Counter(doc), Counter(a for a, _ in doc)
        for (a, b), n in own.items():
            for m in (0, 1):
                mine = m == 1 or k in target
                prior = (scale[m] * unigram[m][b] + lm_scoring.FLOOR) / (mass[0] + lm_scoring.FLOOR * lm_scoring.CLASSES)
                loss[m] -= n * math.log((scale[m] * (bigram[m][a, b] - mine * n) + lm_scoring.STRENGTH * prior)
                                        / (scale[m] * (context[m][a] - mine * own_context[a]) + lm_scoring.STRENGTH))
        row, n = got[k][0], max(len(doc), 1)
        assert row["n_tokens"] == len(doc)
        assert [row["ce_target"], row["ce_background"]] == pytest.approx([loss[0] / n, loss[1] / n], abs=2e-5)
    assert lm_scoring.cross_entropy_difference(empty(spark), frame).count() == 0


def test_count_tables_merge_in_a_stream():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 2**32, 5000, dtype=np.uint32)
    code[::3] = 17
    assert (lm_scoring.restored(lm_scoring.permuted(code)) == code).all()
    values, counts = lm_scoring.summed(code, np.ones(5000, np.int64))
    assert dict(zip(values.tolist(), counts.tolist())) == Counter(code.tolist())
    assert (lm_scoring.unpacked_codes(lm_scoring.packed_codes(values)) == values).all()


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 16))
    near = base[0] + 0.02 * rng.standard_normal((40, 16))
    chain = [base[1] * math.cos(t) + (base[2] - base[2] @ base[1] / (base[1] @ base[1]) * base[1]) * math.sin(t) for t in np.linspace(0, 1.2, 8)]
    vectors = [*base, *near, *chain, base[5], base[5], base[5] * 7, base[6] * 1e-300]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], "x") for k, v in enumerate([*vectors, *odd])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string")
    got = rows_by(embedding_dedup.near_duplicates(frame, block=16), "vec_id")
    n = len(vectors)
    x = np.array([v / np.abs(v).max() for v in np.array(vectors)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = np.zeros((len(rows), len(rows)), bool)
    linked[:n, :n] = x @ x.T >= 0.9
    linked[n + 6, n + 7] = linked[n + 7, n + 6] = True
    np.fill_diagonal(linked, False)
    for k in range(len(rows)):
        reach, todo = {k}, [k]
        while todo:
            more = set(np.flatnonzero(linked[todo.pop()]).tolist()) - reach
            reach |= more
            todo += more
        assert got[k] == [{"vec_id": k, "n_links": int(linked[k].sum()), "component_id": min(reach), "kept": min(reach) == k}]
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((500, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for n in (500, 50_000, 1_000_000):
        code = embedding_dedup.Code(64, n)
        a, b = code.decode(x), code.decode(0.9 * x + math.sqrt(0.19) * z)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b)]) > 0.97
