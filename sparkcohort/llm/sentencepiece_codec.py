"""SentencePiece encoding and decoding with a given vocabulary file.

Encoding is a batched Viterbi search for the segmentation of highest total piece score.  Texts are cut into words before
each space that follows something else (no piece of the vocabulary crosses such a place; the loader checks it), and each
distinct word of a slice of text is segmented once.  Words of equal length advance together: rolling hashes of all
substrings probe the sorted keys of the pieces, and at every place one vectorised maximum over the piece lengths stores the
back-pointers.  Characters without a piece become their UTF-8 bytes' pieces, so decoding gives back every text.

Ids are those that the format's unigram decoder finds over the file's pieces and scores.  Rows never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.llm.common import Shipped, byte_slices, q, text_of, word_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581                    # stands for a space in pieces
LITERAL = 0x110000               # a literal mark in a text: no piece has it, so it is encoded by its bytes
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE = 1 << 20
CELLS = 1_000_000                # cells (words x places x lengths) of one step
UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE, UNKNOWN = 1, 4, 6, 2   # fixed values of the file format


class Vocabulary:
    """Sorted piece keys with ids and scores, and the bytes of every id; a few megabytes, fixed by the file."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = [(p, s, k) for k, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED) and p]
        crossing = [p for p, _, _ in usable if any(b == chr(MARK) != a for a, b in zip(p, p[1:]))]
        if crossing:
            raise ValueError(f"pieces that cross words: {crossing[:3]}")
        keys = np.array([self.key(p) for p, _, _ in usable], np.uint64)
        if len(np.unique(keys)) != len(keys):
            raise ValueError("pieces repeat")
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = np.array([k for _, _, k in usable], np.int32)[order]
        self.scores = np.array([s for _, s, _ in usable], np.float64)[order]
        self.longest = max((len(p) for p, _, _ in usable), default=1)
        self.unknown_score = min((s for _, s, _ in usable), default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((k for k, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True
        self.bytes = np.full(256, -1, np.int32)
        texts = []
        for k, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = k
                texts.append(bytes([int(p[1:-1], 16)]))
            else:
                texts.append(p.replace(chr(MARK), " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.lengths = np.array([len(t) for t in texts], np.int64)

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor
        sp = SentencePieceProcessor(model_file=path)
        kind = lambda k: UNKNOWN if sp.is_unknown(k) else 3 if sp.is_control(k) else BYTE if sp.is_byte(k) else 5 if sp.is_unused(k) else NORMAL
        return cls([(sp.id_to_piece(k), sp.get_score(k), kind(k)) for k in range(sp.get_piece_size())])

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, score) of each substring key; -1 and minus infinity where no piece has it."""
        ids, scores = np.full(keys.shape, -1, np.int32), np.full(keys.shape, -np.inf)
        at = np.nonzero(self.filter[keys >> np.uint64(44)])
        some = keys[at]
        place = np.minimum(np.searchsorted(self.keys, some), max(len(self.keys) - 1, 0))
        hit = self.keys[place] == some
        at, place = tuple(a[hit] for a in at), place[hit]
        ids[at], scores[at] = self.ids[place], self.scores[place]
        return ids, scores

    def segment(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of equal length, one a row: (word, id, character) of their pieces from left to right; id -1: no piece."""
        n, length = chars.shape
        width = min(self.longest, length)
        ids = np.full((n, length, width), -1, np.int32)          # [:, end, k]: the substring of k + 1 characters up to end
        scores = np.full((n, length, width), -np.inf)
        key = np.zeros((n, length), np.uint64)
        for k in range(width):
            key = key[:, :length - k] * BASE + chars[:, k:] + np.uint64(1)
            ids[:, k:, k], scores[:, k:, k] = self.probe(key)
        lone = ids[:, :, 0] < 0
        scores[:, :, 0][lone] = self.unknown_score
        best = np.full((n, length + width), -np.inf)             # place p is column p + width - 1: no branch at the start
        best[:, width - 1] = 0.0
        back = np.zeros((n, length), np.int32)
        rows = np.arange(n)
        for end in range(length):
            total = best[:, end:end + width] + scores[:, end, ::-1]
            longest = total.argmax(1)                            # among equals the longest last piece
            back[:, end] = width - 1 - longest
            best[:, end + width] = total[rows, longest]
        at, live = np.full(n, length - 1), rows
        words, got, char = [], [], []
        while len(live):
            k = back[live, at[live]]
            words.append(live)
            got.append(ids[live, at[live], k])
            char.append(chars[live, at[live]])
            at[live] -= k + 1
            live = live[at[live] >= 0]
        words, got, char = (np.concatenate(x[::-1]) for x in (words, got, char))
        order = np.argsort(words, kind="stable")
        return words[order], got[order], char[order]

    def spelled(self, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, id) of the byte pieces of characters without a piece; the unknown id where the file lacks them."""
        where, out = [], []
        for c in np.unique(char):
            raw = chr(MARK if c == LITERAL else int(c)).encode("utf-8")
            codes = self.bytes[list(raw)]
            codes = codes if (codes >= 0).all() else np.array([self.unknown], np.int32)
            at = np.flatnonzero(char == c)
            where.append(np.repeat(at, len(codes)))
            out.append(np.tile(codes, len(at)))
        where, out = np.concatenate(where), np.concatenate(out)
        order = np.argsort(where, kind="stable")
        return where[order], out[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and their offsets, from UTF-8 bytes and row offsets."""
        n = len(offsets) - 1
        raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts = heads[offsets]
        full = np.flatnonzero(np.diff(starts))
        # the mark that is put before every text that is not empty
        x = np.insert(np.where(raw == MARK, LITERAL, np.where(raw == 32, MARK, raw)).astype(np.uint64), starts[full], MARK)
        row_at = starts[full] + np.arange(len(full))
        begin = (x == MARK) & (np.concatenate([[0], x[:-1]]) != MARK)[:len(x)]
        begin[row_at] = True
        word = np.flatnonzero(begin)
        end = np.append(word[1:], len(x))
        if not len(word):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        hashes = word_hashes(x.astype(np.uint32).view(np.uint8), word * 4, end * 4)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        length = (end - word)[first]
        owners, ids = [], []
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts):
            size = int(length[group[0]])
            step = max(1, CELLS // (size * min(self.longest, size)))
            for a in range(0, len(group), step):
                some = group[a:a + step]
                w, got, char = self.segment(x[word[first[some]][:, None] + np.arange(size)])
                missing = np.flatnonzero(got < 0)
                if len(missing):
                    where, codes = self.spelled(char[missing])
                    at = np.concatenate([np.flatnonzero(got >= 0), missing[where]])
                    code = np.concatenate([got[got >= 0], codes])
                    turn = np.argsort(at, kind="stable")
                    w, got = w[at[turn]], code[turn]
                owners.append(some[w])
                ids.append(got)
        owners, ids = np.concatenate(owners), np.concatenate(ids)
        turn = np.argsort(owners, kind="stable")
        ids, count = ids[turn], np.bincount(owners, minlength=len(first))
        at = np.concatenate([[0], np.cumsum(count)])
        out = ids[ranges(at[which], count[which])]
        ends = np.concatenate([[0], np.cumsum(count[which])])
        row_first = np.searchsorted(word, row_at)
        row_offsets = np.zeros(n + 1, np.int64)
        row_offsets[full + 1] = np.diff(np.append(ends[row_first], ends[-1]))
        return out, np.cumsum(row_offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of rows of ids; the mark that encoding puts before a text is taken off."""
        size = self.lengths[ids]
        flat = self.flat[ranges(self.ends[ids] - size, size)]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        texts = [flat[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[k] .. starts[k] + sizes[k] - 1 for every k, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]])[:len(sizes)], sizes)
    return shift + np.arange(total)


def encode(docs: DataFrame, vocabulary: Vocabulary, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep`` and ``ids`` (array<int>), one row per input row; null and empty texts have no ids.

    Columns that are not named in ``keep`` are left out; one called ``ids`` gives way to the new column.
    """
    keep = tuple(c for c in keep if c.lower() != "ids")
    handle = Shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch, "text", SLICE):
                ids, at = handle.value.encode(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], lists], names=[*rows.schema.names[:-1], "ids"])

    columns = [id, *keep]
    types = [T.StructField(f"k{k}", docs.schema[c].dataType) for k, c in enumerate(columns)]
    rows = docs.select(*[q(c).alias(f"k{k}") for k, c in enumerate(columns)], text_of(text).alias("text"))
    got = rows.mapInArrow(run, T.StructType([*types, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return got.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(columns)], "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """The input with a column of texts; null ids give null."""
    handle, where = Shipped(encoded.sparkSession, vocabulary), encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(where)
            for a in range(0, batch.num_rows, 512):
                part = lists.slice(a, 512)
                at = part.offsets.to_numpy()
                texts = handle.value.decode(part.flatten().to_numpy(zero_copy_only=False) if not part.null_count else
                                            part.values.to_numpy()[at[0]:at[-1]], at - at[0])
                column = pa.array(texts, pa.string())
                if part.null_count:
                    column = pc.if_else(part.is_valid(), column, pa.scalar(None, pa.string()))
                rows = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, "t"])

    plain = encoded.toDF(*[f"c{k}" for k in range(len(encoded.columns))])      # any column names will do
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("t", T.StringType())])).toDF(*encoded.columns, text)
