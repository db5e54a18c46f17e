"""Cross-entropy difference of two matched bigram models.

The target model counts the documents marked as target, the background model counts all documents.  Both share one
vocabulary (every word of the documents, by a 64-bit hash), order and smoothing, and the background counts are scaled to the
mass of the target's, so that the two differ in nothing but what they saw.  A document's own counts are taken out of both models
before it is scored (those of the unigram models with ``leave_words``).  A token's loss is the negative log probability given the word before it; the score of a document is
the mean loss under the target model less that under the background model: low for documents like the target.

The most frequent words, 65,535 at most, have numbers and their counts are sent to all tasks; all others are rare: one of
them has at most about a 65,535th of the tokens.  Denominators of numbered contexts are worked out where documents are read.

Counts of bigrams of two numbered words travel in packs: a task counts those of a slice of documents, permutes their codes so
that ranges of codes are buckets of equal size, and sends one compact row per bucket.  Streams sorted by bucket merge the counts into one table per
bucket.  The same packs, with the documents they belong to, then meet their bucket's table; each bucket is spread over as
many tasks as there are slices to hold, so a pair that is in every document is no hot key.

All that concerns a rare word goes to the bucket of its hash: each document's words before it, numbered words after it, and
whether it ends the document.  There its counts are complete, and no bucket is large, because no rare word is.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import Shipped, byte_slices, join_checked, q, text_of, word_hashes, words_of
from sparkcohort.session import settle

CLASSES = 65_536           # numbers of words, 0 is the start of a document; also the least size of the vocabulary in the models
RARE_TOKENS = 400_000      # tokens of rare words for which a bucket of rare words is added
STRENGTH = 2.0             # pseudo-counts of the unigram model behind a bigram
FLOOR = 0.5                # pseudo-count of a word in the unigram models
SLICE = 2 << 20            # bytes of text whose counts make one pack for each bucket
BUCKET_TOKENS = 4_000_000  # tokens for which a bucket is added, up to MOST_BUCKETS: a table has at most 2**32 codes / buckets
MOST_BUCKETS = 1024
HELD = 1_000_000           # codes that a task holds before it sums them up or sends them on
PACKS = 4096               # packs of a bucket that meet one copy of its table
MOST_PARTS = 50_000        # partitions of a shuffle; a task goes through its buckets one after the other, so it may have several
FACTOR, INVERSE = np.uint32(0x9E3779B1), np.uint32(pow(0x9E3779B1, -1, 2**32))


def permuted(code: np.ndarray) -> np.ndarray:
    return (code ^ (code >> np.uint32(15))) * FACTOR


def restored(code: np.ndarray) -> np.ndarray:
    x = code * INVERSE
    return x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))


def packed(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, as many as the largest needs, after a byte with their number."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([planes]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :raw[0]] = planes.T
    return out.view("<u8").ravel()


def packed_codes(codes: np.ndarray) -> bytes:
    return packed(np.diff(codes, prepend=np.uint32(0)))


def unpacked_codes(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw).astype(np.uint32), dtype=np.uint32)


def packed_hashes(hashes: np.ndarray) -> bytes:
    return packed(np.diff(hashes, prepend=np.uint64(0)))


def unpacked_hashes(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word before, hash, row) of every word; 0 is the start of a document."""
    start, end, row = words_of(data, offsets)
    word = np.maximum(word_hashes(data, start, end), np.uint64(1))
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])[:len(word)]
    before[np.concatenate([[True], row[1:] != row[:-1]])[:len(word)]] = 0
    return before, word, row


def ends(row: np.ndarray) -> np.ndarray:
    return np.concatenate([row[1:] != row[:-1], [True]])[:len(row)]


def flags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("target")).to_numpy(zero_copy_only=False).astype(bool)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences as a word and as a context, in the target and in all documents: a row per word for every few slices."""

    def emit(held: list) -> pa.RecordBatch:
        word, *counts = summed(*[np.concatenate(x) for x in zip(*held)])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (word.view(np.int64), *counts)], names=["word", "word_t", "word_b", "context_t", "context_b"])

    held: list = []
    for batch in batches:
        target = flags(batch)
        for a, b, data, offsets in byte_slices(batch, "text", SLICE):
            _, word, row = tokens(data, offsets)
            mine, inner = target[a:b][row].astype(np.int64), (~ends(row)).astype(np.int64)
            held.append(summed(word, mine, np.ones(len(word), np.int64), mine * inner, inner))
            none, last = np.zeros(1, np.int64), 1 - inner
            held.append((np.zeros(1, np.uint64), none, none, none + (mine * last).sum(), none + last.sum()))
            if sum(len(h[0]) for h in held) > HELD:
                yield emit(held)
                held = []
    if held:
        yield emit(held)


def summed(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[:len(codes)])
    return codes[head], *[np.add.reduceat(c[order], head) if len(head) else c for c in counts]


def cut(codes: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(codes, (np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32 - bits)))


def count_packs(bits: int, handle):
    """Counts of a task's bigrams of numbered words: one row per bucket for every few slices."""

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        code, t, b = summed(*[np.concatenate(x) for x in zip(*held)])
        at = cut(code, bits)
        full = np.flatnonzero(np.diff(at))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([packed_codes(code[at[k]:at[k + 1]]) for k in full], pa.binary()),
             *[pa.array([packed(c[at[k]:at[k + 1]]) for k in full], pa.binary()) for c in (t, b)]], names=["bucket", "codes", "t", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            target = flags(batch)
            for a, b, data, offsets in byte_slices(batch, "text", SLICE):
                before, word, row = tokens(data, offsets)
                before, word = handle.value.numbers(before, word)
                both = (before >= 0) & (word >= 0)
                code = permuted(((before[both] << 16) | word[both]).astype(np.uint32))
                held.append(summed(code, target[a:b][row[both]].astype(np.int64), np.ones(len(code), np.int64)))
                if sum(len(h[0]) for h in held) > HELD:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)
    return run


def merge_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table per bucket from rows sorted by bucket; what is held is the table and rows of at most its size."""
    bucket, held, waiting = None, [], 0

    def table() -> pa.RecordBatch:
        code, t, b = summed(*[np.concatenate(x) for x in zip(*held)])
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in (
            packed_codes(code), packed(t), packed(b))]], names=["bucket", "codes", "t", "b"])

    for batch in batches:
        for k in range(batch.num_rows):
            row = [batch.column(c)[k].as_py() for c in range(4)]
            if row[0] != bucket:
                if held:
                    yield table()
                bucket, held, waiting = row[0], [], 0
            held.append((unpacked_codes(row[1]), unpacked(row[2]).astype(np.int64), unpacked(row[3]).astype(np.int64)))
            waiting += len(held[-1][0])
            if len(held) > 1 and waiting > max(HELD, len(held[0][0])):
                held, waiting = [summed(*[np.concatenate(x) for x in zip(*held)])], 0
    if held:
        yield table()


BEFORE, BEFORE_RARE, AFTER, END = range(4)      # what a document tells a rare word: a word before it, one after it, that it is the last


def own_words(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For every word how often its row has it."""
    slot, count = np.unique((np.unique(word, return_inverse=True)[1] << 16) | row, return_inverse=True, return_counts=True)[1:]
    return count[slot]


def rare_entries(before, word, row, a, b, own):
    """(rare word, kind, the other word, row, count, own), sorted by word: the other word is a number, or a hash for BEFORE_RARE."""
    last = ends(row)
    parts = []
    for where, key, kind, other in ((b < 0, word, np.where(a < 0, BEFORE_RARE, BEFORE), np.where(a < 0, before, a.astype(np.uint64))),
                                    ((a < 0) & (b >= 0), before, np.full(len(row), AFTER), b.astype(np.uint64)),
                                    ((b < 0) & last, word, np.full(len(row), END), np.zeros(len(row), np.uint64))):
        parts.append((key[where], kind[where].astype(np.uint8), other[where], row[where].astype(np.uint16), own[where]))
    key, kind, other, row, own = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((other, kind, row, key))
    key, kind, other, row, own = key[order], kind[order], other[order], row[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (other[1:] != other[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return key[head], kind[head], other[head], row[head], np.diff(np.append(head, len(key))), own[head]


def rare_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return (((word >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def document_packs(bits: int, salts: int, buckets: int, handle, leave_words: bool):
    """Bigrams of slices of documents: one row per bucket, the first with the ids and sizes of the slice's documents.

    Buckets of rare words have numbers from ``1 << bits`` on.  A row has for each bigram how often its document has the second
    word, and for each of its documents the number of words; both are 0 when unigrams are not to be left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of packs are those of the task and a running number: a task that runs again gives the same
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        model = handle.value
        for batch in batches:
            target = flags(batch)
            for first, last, data, offsets in byte_slices(batch, "text", SLICE):
                for a in range(0, last - first, 65_536):           # a document's number in its slice takes two bytes
                    b = min(a + 65_536, last - first)
                    before, word, row = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    left, right = model.numbers(before, word)
                    both = (left >= 0) & (right >= 0)
                    code = ((left[both] << 16) | right[both]).astype(np.uint32)
                    pair, at, count = np.unique((permuted(code).astype(np.uint64) << np.uint64(16)) | row[both].astype(np.uint64),
                                                return_index=True, return_counts=True)
                    sizes = np.bincount(row, minlength=b - a)
                    every = own_words(word, row) if leave_words else np.zeros(len(word), np.int64)
                    lengths = sizes if leave_words else np.zeros(b - a, np.int64)
                    own = every[both][at]
                    code, doc = (pair >> np.uint64(16)).astype(np.uint32), (pair & np.uint64(65_535)).astype(np.uint16)
                    mine = target[first + a:first + b]
                    at = cut(code, bits)
                    full = np.union1d([0], np.flatnonzero(np.diff(at))).astype(np.int64)
                    ids = batch.column(0).slice(first + a, b - a)
                    number = next(numbers)
                    packs = [(int(k), number % salts, packed_codes(code[s]), doc[s].tobytes(), packed(count[s]), packed(own[s]), packed(lengths[np.unique(doc[s])]),
                              b"", b"", b"", b"")
                             for k in full for s in [slice(at[k], at[k + 1])]]
                    key, kind, other, at_doc, n, own = rare_entries(before, word, row, left, right, every)
                    bucket = rare_bucket(key, buckets)
                    for k in np.unique(bucket).tolist():
                        s = slice(*np.searchsorted(bucket, [k, k + 1]))
                        some, runs = np.unique(key[s], return_counts=True)
                        hashed = kind[s] == BEFORE_RARE
                        packs.append(((1 << bits) + k, 0, packed_hashes(some), at_doc[s].tobytes(), packed(n[s]), packed(own[s]),
                                      packed(lengths[np.unique(at_doc[s])]), packed(runs), kind[s].tobytes(),
                                      other[s][~hashed].astype(np.uint16).tobytes(), other[s][hashed].tobytes()))
                    columns = list(zip(*packs))
                    only_first = np.concatenate([[0, b - a], np.full(len(packs) - 1, b - a)]).astype(np.int32)
                    blank = [b""] * (len(packs) - 1)
                    base = model.context_losses(left, row, mine)
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c, pa.int32()) for c in columns[:2]], pa.array(np.full(len(packs), number)), *[pa.array(c, pa.binary()) for c in columns[2:]],
                         pa.array([np.packbits(mine).tobytes()] * len(packs), pa.binary()), pa.ListArray.from_arrays(pa.array(only_first), ids),
                         pa.array([sizes.astype("<i4").tobytes(), *blank], pa.binary()), pa.array([base.tobytes(), *blank], pa.binary())],
                        names=["bucket", "salt", "pack", "codes", "docs", "counts", "own", "lengths", "runs", "kinds", "numbers", "hashes", "mine", "ids", "sizes", "base"])
    return run


class Unigrams:
    """What all tasks know of both models: masses, the size of the vocabulary and the counts of numbered words."""

    def __init__(self, rows: list, mass: np.ndarray, size: int):
        """``rows``: hash and counts of the numbered words and of the start of a document, hash 0."""
        table = {0: (0, 0, 0, 0)} | {r[0] % 2**64: r[1:] for r in rows}
        self.hashes = np.array(sorted(table), np.uint64)            # the first is the start of a document
        counts = np.array([table[h] for h in sorted(table)], float).T
        self.context = counts[2:]
        self.scale = mass[0] / mass[1] if mass[1] else 0.0          # background counts per target count
        self.mass, self.size, self.word = mass, max(CLASSES, size), counts[:2]

    def numbers(self, *hashes: np.ndarray) -> list[np.ndarray]:
        """Numbers of words, -1 for rare ones."""
        out = []
        for h in hashes:
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out.append(np.where(self.hashes[at] == h, at, -1))
        return out

    def prior(self, counts: np.ndarray, own, length, mine) -> np.ndarray:
        """Unigram models without a document that has the word ``own`` times among ``length`` words."""
        target = (counts[0] - own * mine + FLOOR) / (self.mass[0] - length * mine + FLOOR * self.size)
        return np.stack([target, (self.scale * (counts[1] - own) + FLOOR) / (self.scale * (self.mass[1] - length) + FLOOR * self.size)])

    def word_losses(self, t, b, prior, count, mine) -> np.ndarray:
        """A bigram's share of the losses that comes of its numerators, in the target and in the background model."""
        target = np.where(mine, t - count, t) + STRENGTH * prior[0]
        return -count * np.log(np.stack([target, self.scale * (b - count) + STRENGTH * prior[1]]))

    def contexts(self, t, b, own, mine) -> np.ndarray:
        """A context's share, that of its denominators; ``own`` is how often the document has it."""
        return own * np.log(np.stack([t - np.where(mine, own, 0), self.scale * (b - own)]) + STRENGTH)

    def context_losses(self, left, row, mine) -> np.ndarray:
        """Per document the shares of its numbered contexts."""
        some = left >= 0
        pair, own = np.unique((left[some] << 16) | row[some], return_counts=True)
        context, doc = pair >> 16, pair & 65_535
        return np.stack([np.bincount(doc, weights=x, minlength=len(mine)) for x in self.contexts(*self.context[:, context], own, mine[doc])])


def rare_losses(model: Unigrams, key, kind, other, group, count, own, length, mine) -> np.ndarray:
    """Per entry of a bucket of rare words its share of both losses.  ``group`` is the number of pack and document."""
    word = np.unique(key, return_inverse=True)[1]
    total = lambda where, x: np.bincount(word[where], weights=x[where], minlength=word.max() + 1)
    ahead, end, after = kind <= BEFORE_RARE, kind == END, kind == AFTER
    own_t = count * mine
    counts = np.stack([total(ahead, own_t), total(ahead, count)])
    context = counts - np.stack([total(end, own_t), total(end, count)])
    # bigrams: a rare word with what is before it, or with the numbered word after it
    order = np.lexsort((other, kind, word))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (word, kind, other)])
    bigram = np.empty(len(order), np.int64)
    bigram[order] = np.cumsum(new) - 1
    t, b = (np.bincount(bigram, weights=x)[bigram] for x in (own_t, count))
    second = counts[:, word]
    second[:, after] = model.word[:, other[after].astype(np.int64)]
    prior = model.prior(second, np.where(end, 0, own), length, mine)
    out = np.where(end, 0.0, model.word_losses(t, b, prior, np.where(end, 0, count), mine))
    # contexts: once for each word and document
    order = np.lexsort((group, word))
    new[1:] = (word[order][1:] != word[order][:-1]) | (group[order][1:] != group[order][:-1])
    head, slot = order[new], np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    own = np.bincount(slot, weights=np.where(ahead, count, np.where(end, -count, 0)))
    out[:, head] += model.contexts(*context[:, word[head]], own, mine[head])
    return out


def score_packs(bits: int, handle):
    """Streams of a bucket's table and then its packs, sorted so; per pack the losses of its documents.

    The packs of a bucket of rare words are held until all are there.
    """

    def rare(model: Unigrams, held: list) -> list:
        columns = [np.concatenate(x) for x in list(zip(*held))[1:]]
        key, kind, other, doc, count, own, length, mine, pack = columns
        sums = rare_losses(model, key, kind, other, (pack << 16) | doc, count, own, length, mine)
        out, at = [], 0
        for h in held:
            s = slice(at, at := at + len(h[1]))
            some, slot = np.unique(doc[s], return_inverse=True)
            out.append((h[0], some.astype(np.uint16).tobytes(), np.stack([np.bincount(slot, weights=x[s]) for x in sums]).astype("<f4").tobytes(), b"", b""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, codes, t, b, bucket, held, kinds = handle.value, np.zeros(0, np.uint32), None, None, None, [], None

        def batch_of(out: list, ids: pa.Array) -> pa.RecordBatch:
            pack, docs, sums, sizes, base = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(pack, pa.int64()), *[pa.array(x, pa.binary()) for x in (docs, sums)], ids,
                                               *[pa.array(x, pa.binary()) for x in (sizes, base)]], names=["pack", "docs", "sums", "ids", "sizes", "base"])

        def settled() -> pa.RecordBatch:
            out = rare(model, held)
            return batch_of(out, pa.array([[]] * len(out), kinds))

        for batch in batches:
            out, kept = [], []
            kinds = batch.schema.field("ids").type
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}
                if held and row["bucket"].as_py() != bucket:
                    yield settled()
                    held = []
                bucket = row["bucket"].as_py()
                if row["table"].as_py() == 0:
                    codes = unpacked_codes(row["codes"].as_py())
                    t, b = (unpacked(row[c].as_py()).astype(np.int64) for c in ("docs", "counts"))
                    continue
                doc, count = np.frombuffer(row["docs"].as_py(), np.uint16), unpacked(row["counts"].as_py()).astype(float)
                mine = np.unpackbits(np.frombuffer(row["mine"].as_py(), np.uint8))[doc].astype(bool)
                some, slot = np.unique(doc, return_inverse=True)
                own, length = unpacked(row["own"].as_py()).astype(float), unpacked(row["lengths"].as_py()).astype(float)[slot]
                if bucket >= 1 << bits:
                    kind = np.frombuffer(row["kinds"].as_py(), np.uint8)
                    other = np.zeros(len(kind), np.uint64)
                    other[kind != BEFORE_RARE] = np.frombuffer(row["numbers"].as_py(), np.uint16)
                    other[kind == BEFORE_RARE] = np.frombuffer(row["hashes"].as_py(), np.uint64)
                    key = np.repeat(unpacked_hashes(row["codes"].as_py()), unpacked(row["runs"].as_py()).astype(np.int64))
                    held.append((row["pack"].as_py(), key, kind, other, doc.astype(np.int64), count, own, length, mine, np.full(len(kind), len(held))))
                    continue
                code = unpacked_codes(row["codes"].as_py())
                if len(code):
                    at = np.searchsorted(codes, code)
                    word = restored(code) & np.uint32(65_535)
                    losses = model.word_losses(t[at], b[at], model.prior(model.word[:, word], own, length, mine), count, mine)
                    sums = np.stack([np.bincount(slot, weights=x) for x in losses])
                else:
                    sums = np.zeros((2, 0))
                out.append((row["pack"].as_py(), some.tobytes(), sums.astype("<f4").tobytes(), row["sizes"].as_py(), row["base"].as_py()))
                kept.append(k)
            if out:
                yield batch_of(out, batch.column(batch.schema.get_field_index("ids")).take(pa.array(kept)))
        if held:
            yield settled()
    return run


def gather_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pack, the one with ids first; per document the sums over all buckets."""
    pack, ids, sizes, total = None, None, None, None

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(total[0]), pa.array(total[1])],
                                          names=["id", "n", "target_loss", "background_loss"])

    for batch in batches:
        names = batch.schema.names
        at = {n: batch.column(names.index(n)) for n in names}
        for k in range(batch.num_rows):
            if at["pack"][k].as_py() != pack:
                if ids is not None:
                    yield rows()
                pack, ids = at["pack"][k].as_py(), at["ids"][k].values
                sizes = np.frombuffer(at["sizes"][k].as_py(), "<i4")
                total = np.frombuffer(at["base"][k].as_py(), "<f8").reshape(2, -1).copy()
            doc = np.frombuffer(at["docs"][k].as_py(), np.uint16)
            total[:, doc] += np.frombuffer(at["sums"][k].as_py(), "<f4").reshape(2, -1)
    if ids is not None:
        yield rows()


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", most_numbered: int = CLASSES - 1,
                             leave_words: bool = False) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ce_target``, ``ce_background``, ``ce_difference`` (nats a token).

    ``target`` has the ids of the target documents in column ``id``; ids without a document and null ids mark nothing.
    Null texts and texts without words have no tokens and entropies of 0.  Without any target document the target model
    is uniform.  Rows that repeat an id are documents of their own, in the target together.
    ``most_numbered`` bounds the words that have numbers; the result does not depend on it.
    With ``leave_words`` a document's words and their number are taken out of the unigram models too, else of bigrams and contexts only.
    """
    marked = target.where(q(id).isNotNull()).select(q(id).alias("id")).distinct().withColumn("target", F.lit(True))
    rows = join_checked(docs.select(q(id).alias("id"), text_of(text).alias("text")), marked, ["id"], "left", 200_000)
    rows = rows.select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = settle(rows.mapInArrow(word_counts, "word long, word_t long, word_b long, context_t long, context_b long")
                    .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("word_t", "word_b", "context_t", "context_b")]))
    # levels of frequency in steps of 1 %, the most frequent as long as their words have numbers
    words = counts.where("word <> 0").withColumn("level", F.floor(F.log("word_b") * 100))
    levels = sorted(words.groupBy("level").agg(F.count(F.lit(1)), F.sum("word_t"), F.sum("word_b")).collect(), reverse=True)
    fit = int(np.searchsorted(np.cumsum([r[1] for r in levels]), most_numbered, "right")) if levels else 0
    numbered = words.where(F.col("level") >= levels[fit - 1][0]).drop("level") if fit else words.where("false").drop("level")
    mass = np.array([sum(r[c] for r in levels) for c in (2, 3)], float)
    model = Unigrams([tuple(r) for r in numbered.unionByName(counts.where("word = 0")).collect()], mass, sum(r[1] for r in levels))
    total = float(mass[1])
    bits = int(np.clip(np.ceil(np.log2(max(total / BUCKET_TOKENS, 1))), 4, np.log2(MOST_BUCKETS)))
    salts = int(np.ceil(max(total * 6 / SLICE, 1) / PACKS))
    buckets = max(16, int(np.ceil(sum(r[3] for r in levels[fit:]) / RARE_TOKENS)))
    handle = Shipped(docs.sparkSession, model)
    # only buckets of numbered words are spread over copies of their table
    parts = lambda copied: max(min((1 << bits) * copied + buckets, MOST_PARTS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tables = (rows.mapInArrow(count_packs(bits, handle), "bucket int, codes binary, t binary, b binary")
              .repartition(parts(1), "bucket").sortWithinPartitions("bucket")
              .mapInArrow(merge_counts, "bucket int, codes binary, t binary, b binary"))
    id_type = docs.schema[id].dataType.simpleString()
    shape = f"bucket int, salt int, pack long, codes binary, docs binary, counts binary, own binary, lengths binary, runs binary, kinds binary, numbers binary, hashes binary, mine binary, ids array<{id_type}>, sizes binary, base binary"
    packs = rows.mapInArrow(document_packs(bits, salts, buckets, handle, leave_words), shape).withColumn("table", F.lit(1))
    copies = tables.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).cast("long").alias("pack"), "codes",
                           F.col("t").alias("docs"), F.col("b").alias("counts"), F.lit(0).alias("table"))
    met = (packs.unionByName(copies, allowMissingColumns=True).repartition(parts(salts), "bucket", "salt")
           .sortWithinPartitions("bucket", "salt", "table").mapInArrow(
               score_packs(bits, handle), f"pack long, docs binary, sums binary, ids array<{id_type}>, sizes binary, base binary"))
    done = met.repartition("pack").sortWithinPartitions("pack", F.length("sizes").desc(), F.size("ids").desc()).mapInArrow(
        gather_packs, f"id {id_type}, n long, target_loss double, background_loss double")
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0)
    return done.select(F.col("id").alias(id), F.col("n").alias("n_tokens"), F.round(mean("target_loss"), 5).alias("ce_target"),
                       F.round(mean("background_loss"), 5).alias("ce_background"),
                       F.round(mean("target_loss") - mean("background_loss"), 5).alias("ce_difference"))
