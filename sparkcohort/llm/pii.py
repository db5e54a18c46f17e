"""Personal data in texts: exact patterns, and a character-level bidirectional LSTM with CRF transitions on top.

The patterns give the base spans of four kinds.  The network adds spans that look like personal data but do not satisfy a
pattern.  It is trained in numpy on the driver, from invented sentences whose spans are known, always with the same seed.
Texts are cut into windows that overlap by half.  Every window is decoded by Viterbi over the CRF; each character then
takes the tag of the window in whose middle it lies, so tags are those of one global sequence and spans may cross windows.
A window without a digit or an at sign cannot hold a span of these kinds and is left untagged without running the network.
Texts are independent: nothing is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Shipped, byte_slices, q, text_of

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WINDOW = 64          # characters
STEP = 32            # a window starts every so many characters
HIDDEN = 10
CLASSES = 130        # 128 ASCII characters, all others, padding
OTHER, PAD = 128, 129
TAGS = 1 + len(KINDS)
LEAST_DIGITS = 7     # of an added phone number


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind: leftmost matches of each kind that do not overlap, failing ones dropped."""
    found = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in PATTERNS[kind].finditer(text) if valid(kind, m[0])]
    return sorted(found)


def plausible(kind: int, text: str) -> bool:
    """Whether an added span may be personal data: it has to pass the checks of its kind, though not its pattern.

    The network cannot see check digits; a number that fails them is left alone, as in the base.
    """
    if KINDS[kind] == "email":
        return re.search(r"[^\s@]\s?@\s?[^\s@]+\.[^\s@]", text) is not None
    if KINDS[kind] == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if KINDS[kind] == "card":
        return valid("card", text)
    return LEAST_DIGITS <= sum(c.isdigit() for c in text) <= 15 and re.fullmatch(r"[0-9]+", text) is None


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class Tagger:
    """One LSTM in each direction over character classes, a linear layer, and CRF transitions between tags."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.3, (h, 4 * h))
            self.p[f"x{d}"][:, h:2 * h] += 1.0              # gates: input, forget, output, candidate
        self.p |= {"out": rng.normal(0, 0.3, (2 * h, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}

    def run(self, chars: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (place, row, unit) in the order of the characters; ``keep`` gets what the gradient needs."""
        length, n = chars.shape
        h = HIDDEN
        x, w = self.p[f"x{d}"], self.p[f"h{d}"]
        state, cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
        out = np.empty((length, n, h), x.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = x[chars[t]] + state @ w
            gates, new = sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, last = cell, state
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * new
            tc = np.tanh(cell)
            state = gates[:, 2 * h:] * tc
            out[t] = state
            if keep is not None:
                keep.append((t, gates, new, before, tc, last))
        return out

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(chars, "f"), self.run(chars, "b")], axis=2) @ self.p["out"] + self.p["bias"]

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tags (place, row) of windows (place, row) of character classes."""
        e = self.emissions(chars)
        score, back = e[0], np.empty(e.shape, np.int8)
        for t in range(1, len(e)):
            total = score[:, :, None] + self.p["move"][None]
            back[t] = total.argmax(1)
            score = total.max(1) + e[t]
        tags = np.empty(chars.shape, np.int8)
        tags[-1] = score.argmax(1)
        rows = np.arange(chars.shape[1])
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log likelihood of a batch."""
        length, n = chars.shape
        h, kept = HIDDEN, {"f": [], "b": []}
        states = np.concatenate([self.run(chars, d, kept[d]) for d in "fb"], axis=2)
        e, move = states @ self.p["out"] + self.p["bias"], self.p["move"]
        lse = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
        ahead, behind = [e[0]], [np.zeros_like(e[0])]
        for t in range(1, length):
            ahead.append(lse(ahead[-1][:, :, None] + move, 1) + e[t])
        for t in range(length - 1, 0, -1):
            behind.append(lse(move[None] + (e[t] + behind[-1])[:, None, :], 2))
        behind = behind[::-1]
        total = lse(ahead[-1], 1)
        g = {"move": np.zeros_like(move)}
        de = np.exp(np.stack(ahead) + np.stack(behind) - total[None, :, None])
        for t in range(1, length):
            g["move"] += np.exp(ahead[t - 1][:, :, None] + move + (e[t] + behind[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(g["move"], (tags[t - 1], tags[t]), -1.0)
        de -= np.eye(TAGS)[tags]
        g |= {"out": np.einsum("tnh,tnk->hk", states, de), "bias": de.sum((0, 1))}
        ds = de @ self.p["out"].T
        for d, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            w = self.p[f"h{d}"]
            gx, gw = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(w)
            dstate, dcell = np.zeros((n, h)), np.zeros((n, h))
            for t, gates, new, before, tc, last in reversed(kept[d]):
                dstate = dstate + part[t]
                i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
                dc = dcell + dstate * o * (1 - tc**2)
                dz = np.hstack([dc * new * i * (1 - i), dc * before * f * (1 - f), dstate * tc * o * (1 - o), dc * i * (1 - new**2)])
                np.add.at(gx, chars[t], dz)
                gw += last.T @ dz
                dstate, dcell = dz @ w.T, dc * f
            g |= {f"x{d}": gx, f"h{d}": gw}
        return {k: v / n for k, v in g.items()}

    def fit(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int, rng: np.random.Generator, rate: float = 0.03) -> None:
        one = {k: np.zeros_like(v) for k, v in self.p.items()}
        two = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            at = rng.integers(0, chars.shape[1], batch)
            for k, g in self.gradient(chars[:, at], tags[:, at]).items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.99 * two[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (1 - step / (steps + 1)) * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}


def sentence(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented sentence and its (start, kind, end) spans; about half of what it holds besides words is no personal data."""
    letters = "abcdefghijklmnopqrstuvwxyzéèüößñóí"
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(letters[int(k)] for k in rng.integers(0, len(letters), rng.integers(1, 11)))
    plain = lambda: "".join(letters[int(k)] for k in rng.integers(0, 26, rng.integers(2, 9)))

    def card() -> str:
        d = digit(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        mark = ("", "", " ", "-")[rng.integers(4)]
        return mark.join(d[k:k + 4] for k in range(0, 16, 4)) if mark else d

    def phone() -> str:
        style = rng.integers(4)
        if style < 2:
            return f"+{rng.integers(1, 99)} ({digit(3)}) {digit(3)}-{digit(4)}"
        return f"+{rng.integers(1, 99)} {digit(3)} {digit(3)} {digit(4)}" if style == 2 else f"({digit(3)}) {digit(3)}-{digit(4)}"

    good = (lambda: f"{plain()}{('', '.', '_')[rng.integers(3)]}{plain()}{digit(rng.integers(0, 4))}@{plain()}{digit(rng.integers(0, 2))}.{plain()}.{('com', 'org', 'net')[rng.integers(3)]}",
            lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)), card, phone)
    bad = (lambda: f'token = "{"".join("0123456789abcdef"[int(k)] for k in rng.integers(0, 16, 40))}"', lambda: digit(rng.integers(1, 8)),
           lambda: f"{digit(2)}.{digit(2)}", lambda: f"{digit(4)}-{digit(2)}-{digit(2)}", lambda: f"v{digit(1)}.{digit(1)}.{digit(1)}",
           lambda: f"{digit(2)}:{digit(2)}", lambda: f"@{plain()}", lambda: f"(c) {digit(4)}", lambda: f"AK{digit(6)}{plain().upper()}{digit(4)}",
           lambda: f"{plain()}/{digit(3)}?page={digit(1)}", lambda: f"{digit(3)},{digit(3)}", lambda: f"{plain()}*** {plain()}&&&")
    text, spans = "", []
    for _ in range(rng.integers(6, 16)):
        pick = rng.integers(10)
        if pick < 2:
            kind = int(rng.integers(4))
            piece = good[kind]()
            spans.append((len(text), kind, len(text) + len(piece)))
        else:
            piece = bad[rng.integers(len(bad))]() if pick == 2 else word().capitalize() if pick == 3 else word().upper() + "!!" if pick == 4 else word()
        text += piece + (" ", " ", " ", " ", ", ", ". ", ".\n")[rng.integers(7)]
    return text, spans


def classes_of(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, points, OTHER).astype(np.uint8)


def window_starts(length: int) -> np.ndarray:
    """Windows whose middle halves tile a text; the first begins before the text."""
    return np.arange(0, length, STEP) - (WINDOW - STEP) // 2


@functools.lru_cache(1)
def trained(sentences: int = 1500, steps: int = 260, batch: int = 48) -> Tagger:
    rng = np.random.default_rng(5)
    chars, tags = [], []
    for _ in range(sentences):
        text, spans = sentence(rng)
        x = np.full(len(text) + 2 * WINDOW, PAD, np.uint8)
        y = np.zeros(len(x), np.int64)
        x[WINDOW:-WINDOW] = classes_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        for start, kind, end in spans:
            y[WINDOW + start:WINDOW + end] = kind + 1
        for s in window_starts(len(text)) + WINDOW:
            chars.append(x[s:s + WINDOW])
            tags.append(y[s:s + WINDOW])
    model = Tagger(rng)
    model.fit(np.array(chars).T, np.array(tags).T, steps, batch, rng)
    return model


def added_spans(model: Tagger, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind) of the runs of one tag over the code points of several texts, which begin at ``starts[:-1]``."""
    live = np.zeros(len(points) + 1, np.int64)
    np.cumsum((points >= 48) & (points <= 57) | (points == 64), out=live[1:])
    sizes = np.diff(starts)
    count = -(-sizes // STEP)
    text = np.repeat(np.arange(len(sizes)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STEP - (WINDOW - STEP) // 2
    low = np.maximum(at, 0) + starts[text]
    high = np.minimum(at + WINDOW, sizes[text]) + starts[text]
    some = np.flatnonzero(live[high] > live[low])
    tags = np.zeros(len(points), np.int8)
    shapes = classes_of(points)
    inner = np.arange((WINDOW - STEP) // 2, (WINDOW + STEP) // 2)
    for a in range(0, len(some), 4096):
        w = some[a:a + 4096]
        place = at[w][None, :] + np.arange(WINDOW)[:, None]
        inside = (place >= 0) & (place < sizes[text[w]])
        chars = np.where(inside, shapes[np.where(inside, place + starts[text[w]], 0)], PAD)
        got = model.decode(chars)[inner]
        ok = inside[inner]
        tags[(place[inner] + starts[text[w]])[ok]] = got[ok]
    change = np.ones(len(points) + 1, bool)
    change[1:-1] = tags[1:] != tags[:-1]
    change[starts] = True
    cut = np.flatnonzero(change)
    begin, end = cut[:-1], cut[1:]
    tagged = tags[begin] > 0 if len(points) else np.zeros(0, bool)
    return begin[tagged], end[tagged], tags[begin[tagged]] - 1


def finder(handle):
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_slices(batch, "text"):
                hits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))])
                hit = np.flatnonzero(hits[offsets[1:]] > hits[offsets[:-1]])
                texts = [data[offsets[k]:offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in hit]
                starts = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
                begin, end, kind = added_spans(handle.value, points, starts)
                bounds = np.searchsorted(begin, starts)
                n = last - first
                counts, sha, out = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                for k, text in enumerate(texts):
                    base = base_spans(text)
                    spans = list(base)
                    for j in range(bounds[k], bounds[k + 1]):
                        a, b, what = int(begin[j] - starts[k]), int(end[j] - starts[k]), int(kind[j])
                        piece = text[a:b]
                        a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip())
                        if plausible(what, text[a:b]) and all(b <= s or e <= a for s, _, e in base):
                            spans.append((a, what, b))
                    if base:
                        sha[hit[k]] = hashlib.sha256(named(base).encode()).hexdigest()
                        for _, what, _ in base:
                            counts[what, hit[k]] += 1
                    out[hit[k]] = named(sorted(spans))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), *[pa.array(c) for c in counts], pa.array(sha), pa.array(out)],
                                                 names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return run


def find(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans``.

    A span is kind:start:end in code points, end exclusive.  ``spans`` has the base spans and those of the network that
    overlap none of them.  Null and empty texts have none.  Extra columns are ignored.
    """
    handle = Shipped(docs.sparkSession, trained())
    shape = f"id {docs.schema[id].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    got = docs.select(q(id).alias("id"), text_of(text).alias("text")).mapInArrow(finder(handle), shape)
    return got.select(F.col("id").alias(id), *got.columns[1:])
