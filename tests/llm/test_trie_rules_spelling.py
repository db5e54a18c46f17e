"""Prefix trie, quality rules and spelling variants beside plain Python on small hand-made tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from sparkcohort.llm import prefix_trie, quality_rules, spelling
from sparkcohort.llm.queries import QUERIES
from tests.llm.helpers import documents, empty, rows_by

WORD = r"[^\x20\x09-\x0D]+"
SMALL = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# --- conversation prefix trie ---------------------------------------------------------------------------------------------

def plain_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            order = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            conv[c].append((t is not None, t or 0, order, r, x))
    rebuilt = {}
    for c in conv:
        h, donor = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        rebuilt[c] = [t[3:] for t in sorted(conv.get(donor, []))[:h]] + [t[3:] for t in sorted(conv[c])[h:]]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rng, rows = random.Random(5), []
    for c in [*range(120), -40, -39, -7, 10**12, 10**12 + 1]:
        for t in range(rng.randint(1, 5) if rng.random() < 0.9 else 0):
            rows.append((c, rng.choice([t, t, None, 2]), rng.choice(["u", "a", None]), rng.choice(["x y", "hello there you", None, "", "z"])))
    rows += [(None, 1, "u", "nobody's"), *[(777, t, "u", f"w {t}") for t in range(1_100)],
             *[(778, t, "u", f"w {t}" if t < 1_050 else "v") for t in range(1_100)], *rows[:3]]
    return rows


@pytest.mark.parametrize("finish", [prefix_trie.FINISH, 30])
def test_trie_equals_plain_python(spark, finish):
    rows = conversations()
    frame = spark.createDataFrame(rows, TURNS).repartition(4).selectExpr("*", "1 AS c", "2 AS depth", "3 AS place", "4 AS `a.b`")
    assert sorted((tuple(r) for r in prefix_trie.trie(frame, finish).collect()), key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


def test_trie_of_turnless_conversations(spark):
    # conversation 1 gives up its own first turn for the head of an absent donor
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    got = prefix_trie.trie(spark.createDataFrame([(lone, 0, "u", "x")], TURNS)).collect()
    assert [tuple(r) for r in got] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_list_ranks_by_contraction(spark):
    order = list(range(400))
    random.Random(1).shuffle(order)
    name = lambda k: None if k is None else (k, 0, 0)
    rows, want, at = [], {}, 0
    for i, k in enumerate(order):
        rows.append((name(k), name(order[i - 1] if i else None), name(order[i + 1] if i + 1 < len(order) else None), k % 3 + 1))
        want[k], at = at, at + k % 3 + 1
    kind = "struct<c:bigint,d:bigint,x:int>"
    frame = spark.createDataFrame(rows, f"id {kind}, prev {kind}, next {kind}, w long")
    assert {r.id.c: r["rank"] for r in prefix_trie.list_ranks(frame, 10).collect()} == want


# --- quality rules --------------------------------------------------------------------------------------------------------

def plain_rules(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dups, lost, rules = set(), 0, 0, collections.Counter()
    for line in text.split("\n"):
        w = re.findall(WORD, line)
        if not w:
            continue
        again, n = line in seen, len(w)
        seen.add(line)
        dups += again
        ends = re.search(r"[.!?:;…。！？][)\]\"'»”’]*([\x20\x09-\x0D]|\Z)", line)
        if 5 * sum(bool(re.fullmatch(r"[|/>•·»›–—-]+", x)) for x in w) >= n or n <= 4 and not ends:
            rule = "navigation"
        elif not ends or 5 * sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w) >= n or 3 * sum(bool(re.search(r"[!?][!?][)\"']*\Z", x)) for x in w) >= n:
            rule = "punctuation"
        elif again or n <= 40 and any(p in line.lower() for p in quality_rules.PHRASES):
            rule = "boilerplate"
        else:
            continue
        rules[rule] += 1
        lost += sum(map(len, w))
    chars = sum(map(len, words))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return dict(n_words=len(words), word_chars=chars, n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_dup_lines=dups, n_repeat_words=len(covered),
                base_failed=failed, kept=not failed and lost <= 0.5 * chars, n_punctuation=rules["punctuation"], n_navigation=rules["navigation"],
                n_boilerplate=rules["boilerplate"], lost_chars=lost)


def rule_texts():
    rng = random.Random(2)
    sentence = lambda: " ".join(rng.choice(["Das", "word", "été", "ñandú", "so", "on,", "𝒳y"]) for _ in range(rng.randint(3, 30))) + "."
    texts = [None, "", " \n\t", "a b c", "Home | About | Contact", "x " * 60, "one two three. " * 40, "\n".join(sentence() for _ in range(12))]
    parts = ["Home | Shop | News", "All rights reserved.", "BUY!! NOW!! OK!!", "cut off line without an end", "a# b$ c%. d", "¿Qué? (sí!) fin.", "", "\r", "Alle Rechte vorbehalten!"]
    for _ in range(40):
        lines = [rng.choice([sentence(), rng.choice(parts)]) for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(lines + lines[:rng.randint(0, 2)]))
    return texts + ["Long text here. " + " ".join(f"w{k}" for k in range(30_000)) + "."]


def test_rules_equal_plain_python(spark):
    texts = rule_texts()
    got = rows_by(quality_rules.rules(documents(spark, texts)), "doc_id")
    for k, text in enumerate(texts):
        (row,) = got[k]
        assert {c: v for c, v in row.items() if c != "doc_id"} == plain_rules(text), text and text[:80]


def test_clean_keeps_columns_and_passing_lines(spark):
    body = "\n".join(" ".join(f"w{k}x{j}" for j in range(9)) + "." for k in range(8))
    docs = documents(spark, [body + "\nHome | About\n" + "All rights reserved.", "Home | About\n" * 40, None])
    docs = docs.unionAll(docs.where("doc_id = 0")).selectExpr("*", "1 AS __rules_all")
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns and [r.text for r in out.collect()] == [body, body]
    assert quality_rules.rules(empty(spark)).collect() == [] and quality_rules.clean(empty(spark)).collect() == []


def test_rules_stay_in_the_jvm_without_a_shuffle(spark):
    plan = QUERIES["op12_quality_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "Exchange"))


# --- spelling variants ----------------------------------------------------------------------------------------------------

def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if one_edit(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, w, n, len(close), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


@pytest.mark.parametrize("most", [spelling.MOST_WORDS, 6])
def test_groups_equal_all_pairs(spark, most):
    rng = random.Random(3)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 8))) for _ in range(500)}
    words |= {"a" * 300, "a" * 299, "a" * 150 + "b" + "a" * 149}
    counts = {w: rng.choice([1, 1, 2, 3, 5, 8, 16, 33, 70]) for w in sorted(words)}
    got = spelling.grouped(spark.createDataFrame([*counts.items(), (None, 4)], "word string, n long").repartition(3), most).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_groups(counts) and len(got) == len(counts)


def test_words_of_documents(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Straße", "strasse", "ÉTÉété", "Hello,", "hello", "a×b÷cde", "short"]) for _ in range(60)) for _ in range(150)]
    texts += [None, "", "x" * 5_000 + " " + "x" * 5_000 + "-" + "x" * 5_000]
    want = collections.Counter()
    for k, text in enumerate(texts):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in spelling.words_of_documents(documents(spark, texts)).collect()} == want
    got = spelling.variants(documents(spark, texts))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain_groups(want)
    assert spelling.variants(empty(spark)).collect() == []
