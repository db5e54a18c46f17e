"""Removal of long repeated byte strings by suffix sorting with bucket pointers.

A string of ``SPAN`` bytes that starts at two places is a repeat; every byte that a repeat covers is removed.  Sorting all
suffixes of a corpus would move a multiple of its size.  But two equal strings of that length select the same anchor: the
place of the smallest hash of ``GRAM`` bytes inside them.  So starts are first dealt to anchors (a run of starts with the same
anchor is one row), and only starts whose anchors have the same bytes are sorted together:

* runs whose whole stretch of bytes occurs once more are repeats as they stand, which settles copies of any number;
* runs whose anchor bytes are unique hold no repeat;
* the other runs of an anchor meet, one for each different stretch, and their suffixes are sorted to depth ``SPAN`` by bucket
  pointer refinement: buckets of eight-byte prefixes are refined by sorting on the bucket pointers of later places, first
  eight on, then sixteen, and so on, and every refinement reads the pointers that the one before has updated;
* an anchor with very many different stretches, such as a passage that a third of the documents share, would fill one
  task: the strings of its runs are counted by their hash instead, an aggregation that combines before it shuffles.

The same is done with a text's words in place of its bytes: a string of ``WORDS`` words that starts at two places is a repeated
passage, however few bytes it has and whatever white space is between the words.  Passages are counted, nothing is removed for
them.  A word is its 64-bit hash there; the lowest bit of an anchor's key says which of the two it belongs to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import byte_slices, fixed, join_checked, mixed, q, text_of, whole_groups, word_hashes, words_of
from sparkcohort.session import settle

SPAN = 400
GRAM = 64
WORDS = 51               # passages of over 50 words
WORD_GRAM = 8
PIECE = 8 << 20          # longer texts (in bytes, in words) are looked through in overlapping pieces
MOST_RUNS = 2048         # different stretches of one anchor that are sorted in one task
HOT = 5_000              # runs of one anchor that are moved by its key
HOT_KEYS = 50_000        # at most so many anchors are sent to all tasks
POSITIONS = 1 << 20      # suffixes sorted at once
SPAN_COLUMNS = ("begin", "end", "word_begin", "word_end")
PLACE = np.uint64((1 << 24) - 1)
BASE = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def first_symbols(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from it on, zeros behind the end; words, which are 64-bit hashes, as they are."""
    if data.dtype == np.uint64:
        return data
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:len(data)]).view(">u8").ravel()


class Hashes:
    """Hashes of any stretch of bytes, from a prefix sum of mixed eight-byte pieces times powers of a base; or of words."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        piece = first_symbols(data).view(np.uint64)
        self.wide = 1 if data.dtype == np.uint64 else 8
        power = np.ones(n + 1, np.uint64)
        power[1:] = BASE
        self.back = np.ones(n + 1, np.uint64)
        self.back[1:] = BACK
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(piece) * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end - self.wide + 1] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def anchor_runs(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, hash of the anchor, hash of the stretch) of every run; starts count from their row."""
    n = len(data)
    if not (np.diff(offsets) >= span).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(data)
    at = np.arange(n - gram + 1)
    grams = hashes.of(at, at + gram)
    least = (grams & ~PLACE) | at.astype(np.uint64)
    width, places = 1, span - gram + 1
    while width * 2 <= places:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = n - span + 1
    anchor = (np.minimum(least[:count], least[places - width:places - width + count]) & PLACE).astype(np.int64)
    edge = np.zeros(count + 1, np.int64)
    big = np.flatnonzero(np.diff(offsets) >= span)
    np.add.at(edge, offsets[big], 1)
    np.add.at(edge, offsets[big + 1] - span + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[:count] > 0)
    anchor = anchor[start]
    head = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])[:len(start)]
    first = np.flatnonzero(head)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    row = np.searchsorted(offsets, low, "right") - 1
    return row, low - offsets[row], high - offsets[row], grams[anchor[first]], hashes.of(low, high + span)


def runs_of(span: int, gram: int, words: int, word_gram: int):
    """The runs of each text, as lists; places count bytes, or words where the lowest bit of the key is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = batch.column(0).to_numpy()
            for a, b, data, offsets in byte_slices(batch, "text", 2 << 20):
                start, end, row = words_of(data, offsets)
                count = np.arange(b - a + 1)
                found = []
                for unit, whole, bounds, length, size in ((0, data, offsets, span, gram),
                                                          (1, word_hashes(data, start, end), np.searchsorted(row, count), words, word_gram)):
                    for begin in range(0, max(len(whole) - length + 1, 1), PIECE):
                        short = len(whole) <= PIECE + length
                        part = whole if short else whole[begin:begin + PIECE + length - 1]
                        text, low, high, key, stretch = anchor_runs(part, bounds if short else np.array([0, len(part)]), length, size)
                        found.append((text, (key & ~np.uint64(1)) | np.uint64(unit), stretch, low + begin, high + begin))
                        if short:
                            break
                text, key, stretch, low, high = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(text, kind="stable")
                at = pa.array(np.searchsorted(text[order], count).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x[order])) for x in (key.view(np.int64), stretch.view(np.int64), low.astype(np.int32), high.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(u[a:b]), *lists], names=["u", "key", "stretch", "low", "high"])
    return run


def refined_pointers(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of the suffixes at depth ``depth``: how many suffixes are smaller when that many bytes count, or words.

    ``ends``: for each place the end of its text.  Suffixes shorter than ``depth`` keep the pointer of the last depth they
    reach; those of fewer than eight bytes have -1.
    """
    n = len(data)
    prefix = first_symbols(data).astype(np.uint64)
    reached = 1 if data.dtype == np.uint64 else 8
    pointer = np.full(n, -1, np.int64)
    live = np.flatnonzero(np.arange(n) + reached <= ends)

    def refine(live: np.ndarray, key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Set the pointers of ``live`` by sorting each bucket on ``key``; returns those that still share theirs."""
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")] if bucket.any() else order
        k, b = key[order], bucket[order]
        number = np.arange(len(order))
        outer = np.concatenate([[True], b[1:] != b[:-1]])[:len(order)]
        inner = outer | np.concatenate([[True], k[1:] != k[:-1]])[:len(order)]
        pointer[live[order]] = b + np.maximum.accumulate(np.where(inner, number, 0)) - np.maximum.accumulate(np.where(outer, number, 0))
        size = np.diff(np.append(np.flatnonzero(inner), len(order)))
        return live[order[np.repeat(size > 1, size)]]

    live = refine(live, prefix[live], np.zeros(len(live), np.int64))
    while reached < depth and len(live):
        step = min(reached, depth - reached)
        live = live[live + reached + step <= ends[live]]
        live = refine(live, pointer[live + step], pointer[live])
        reached += step
    return pointer


def repeated_starts(data: np.ndarray, bounds: np.ndarray, weight: np.ndarray, span: int) -> np.ndarray:
    """Whether the string of ``span`` bytes at each place occurs twice among texts that count ``weight`` times each."""
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = bounds[1:][text]
    pointer = refined_pointers(data, ends, span)
    full = np.flatnonzero(np.arange(len(data)) + span <= ends)
    # suffixes that share a pointer are equal to the depth they were refined to; unique ones keep a pointer of their own
    times = np.bincount(pointer[full], weights=weight[text[full]], minlength=1)
    out = np.zeros(len(data), bool)
    out[full] = times[pointer[full]] > 1
    return out


def spans_of(starts: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """Maximal stretches covered by strings of ``span`` bytes at the sorted ``starts``."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) > span)
    return starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + span).tolist()


def sort_groups(span: int, words: int):
    """Whole anchors in; per stretch the places of its repeats, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, _ in whole_groups(batches, ["key"]):
            kind = whole.column("key").to_numpy() & 1
            for unit, length in ((0, span), (1, words)):
                table = whole.take(pa.array(np.flatnonzero(kind == unit))).combine_chunks()
                key, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(float)
                starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
                column = table.column("bytes")
                total = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy(), dtype=np.int64)])
                first = 0
                while first < len(starts) - 1:
                    last = max(first + 1, int(np.searchsorted(total[starts], total[starts[first]] + POSITIONS, "right")) - 1)
                    a, b = int(starts[first]), int(starts[last])
                    raw = np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), np.uint8)
                    bounds = total[a:b + 1] - total[a]
                    if unit:
                        at, to, row = words_of(raw, bounds)
                        raw, bounds = word_hashes(raw, at, to), np.searchsorted(row, np.arange(b - a + 1))
                    hit = repeated_starts(raw, bounds, n[a:b], length)
                    out = []
                    for k in np.unique(np.searchsorted(bounds, np.flatnonzero(hit), "right") - 1):
                        begin, end = spans_of(np.flatnonzero(hit[bounds[k]:bounds[k + 1]]), length)
                        out.append((table.column("key")[int(a + k)].as_py(), table.column("stretch")[int(a + k)].as_py(), begin, end))
                    if out:
                        names = ["key", "stretch", "begin", "end"]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=names)
                    first = last
    return run


def cut_stretches(span: int, words: int, windows: bool):
    """From texts and the runs wanted of them: the bytes of each stretch, or the hashes of its strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(batch.schema.get_field_index(c)) for c in ("key", "stretch", "n", "low", "high")}
            for first, last, data, offsets in byte_slices(batch, "text"):
                start, end, row = words_of(data, offsets)
                bounds = np.searchsorted(row, np.arange(last - first + 1))
                for k in range(first, last):
                    text = slice(offsets[k - first], offsets[k - first + 1])
                    mine = slice(bounds[k - first], bounds[k - first + 1])
                    for unit, length in ((0, span), (1, words)):
                        some = (lists["key"][k].values.to_numpy() & 1) == unit
                        if not some.any():
                            continue
                        v = {c: x[k].values.to_numpy()[some] for c, x in lists.items()}
                        if not windows:
                            low, to = (start[mine][v["low"]], end[mine][v["high"] + length - 1]) if unit else (v["low"] + text.start, v["high"] + length + text.start)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(v["key"]), pa.array(v["stretch"]), pa.array(v["n"]), pa.array([data[a:b].tobytes() for a, b in zip(low, to)], pa.binary())],
                                names=["key", "stretch", "n", "bytes"])
                            continue
                        hashes = Hashes(word_hashes(data, start[mine], end[mine]) if unit else data[text])
                        count = v["high"].astype(np.int64) - v["low"] + 1
                        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        at = place + np.repeat(v["low"], count)
                        yield pa.RecordBatch.from_arrays(
                            [*[pa.array(np.repeat(v[c], count)) for c in ("key", "stretch", "n")], pa.array(hashes.of(at, at + length).view(np.int64)),
                             pa.array(place)], names=["key", "stretch", "n", "string", "place"])
    return run


def covered(begin: pa.Scalar, end: pa.Scalar, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the spans, if there are any."""
    cover = np.zeros(n + 1, np.int64)
    if begin.is_valid:
        np.add.at(cover, begin.values.to_numpy(), 1)
        np.add.at(cover, end.values.to_numpy(), -1)
    return np.cumsum(cover)[:-1] > 0


def stretches_in(gone: np.ndarray) -> int:
    return int((gone & ~np.concatenate([[False], gone[:-1]])[:len(gone)]).sum())


def cut_out():
    """From texts and the spans of their repeats: what is left, counted and hashed, and how many words passages cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends, word_begins, word_ends = (batch.column(batch.schema.get_field_index(c)) for c in SPAN_COLUMNS)
            for first, last, data, offsets in byte_slices(batch, "text"):
                size, removed, spans, sha, words, passages, kept = [], [], [], [], [], [], []
                for k in range(first, last):
                    raw = data[offsets[k - first]:offsets[k - first + 1]]
                    gone = covered(begins[k], ends[k], len(raw))
                    left = raw[~gone].tobytes()
                    size.append(len(raw))
                    removed.append(int(gone.sum()))
                    spans.append(stretches_in(gone))
                    sha.append(hashlib.sha256(left).hexdigest())
                    again = covered(word_begins[k], word_ends[k], max(word_ends[k].values.to_numpy(), default=0) if word_ends[k].is_valid else 0)
                    words.append(int(again.sum()))
                    passages.append(stretches_in(again))
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(words, pa.int64()),
                                                  pa.array(passages, pa.int64()), pa.array(kept, pa.binary())],
                                                 names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages", "kept"])
    return run


def repeats(texts: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = MOST_RUNS, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """(u, begin, end, word_begin, word_end): the spans of repeats of each text that has any, in bytes and in words, as arrays;
    they may overlap.  ``texts``: u, text."""
    found = settle(texts.where(F.octet_length("text") >= min(span, 2 * words - 1)).mapInArrow(
        runs_of(span, gram, words, word_gram), "u long, key array<long>, stretch array<long>, low array<int>, high array<int>"))
    total = found.agg(F.sum(F.size("key"))).first()[0] or 0
    runs = found.coalesce(max(1, -(-total // 500_000))).select("u", F.inline(F.arrays_zip("key", "stretch", "low", "high")))
    # runs whose anchor occurs once hold no repeat, and most of them do: only the others move on with their places
    keys = runs.groupBy("key").agg(F.count("*").alias("all"), (F.min("stretch") < F.max("stretch")).alias("several")).where("all > 1")
    keys = fixed(keys, 500_000)
    hot = keys.where(F.col("all") > max(HOT, total // HOT_KEYS))
    if hot.take(1):
        # a passage of very many texts would fill a task: its runs stay where they are
        cold = runs.join(F.broadcast(hot.select("key")), "key", "left_anti").join(keys.hint("shuffle_hash"), "key")
        shared = fixed(cold.unionByName(runs.join(F.broadcast(hot), "key")), 500_000)
    else:
        shared = fixed(runs.join(keys.hint("shuffle_hash"), "key"), 500_000)
    stretches = fixed(shared.groupBy("key", "stretch").agg(
        F.count("*").alias("n"), F.min(F.struct("u", "low", "high")).alias("one"), F.max("all").alias("all"), F.max("several").alias("several")).select(
        "key", "stretch", "n", "all", "several", "one.*"), 500_000)
    # those whose stretch occurs once more are repeats as a whole
    length = F.col("high") - F.col("low") + F.when(F.col("key").bitwiseAND(1) == 1, words).otherwise(span).cast("long")
    whole = stretches.where("n > 1").select("key", "stretch", F.array(F.lit(0).cast("long")).alias("begin"), F.array(length).alias("end"))
    open_kinds = stretches.where("several").drop("several")
    crowds = open_kinds.where(F.col("all") > most).groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("key", F.lit(True).alias("crowd"))
    open_kinds = join_checked(open_kinds, crowds, ["key"], "left")

    def wanted(rows: DataFrame) -> DataFrame:
        """Texts with the runs to be cut from them; texts that are not wanted do not move."""
        lists = fixed(rows.groupBy("u").agg(F.collect_list(F.struct("key", "stretch", "n", "low", "high")).alias("r"))
                      .select("u", *[F.col(f"r.{c}").alias(c) for c in ("key", "stretch", "n", "low", "high")]))
        some = join_checked(texts, lists.select("u"), ["u"], "left_semi", 200_000)
        # rows that repeat id and text are one text here
        return some.join(lists, "u").dropDuplicates(["u"])

    few = (wanted(open_kinds.where("crowd IS NULL")).mapInArrow(cut_stretches(span, words, False), "key long, stretch long, n long, bytes binary")
           .repartition("key").sortWithinPartitions("key")
           .mapInArrow(sort_groups(span, words), "key long, stretch long, begin array<long>, end array<long>"))
    found = whole.unionByName(few)
    crowded = open_kinds.where("crowd")
    if crowded.where("n = 1").take(1):
        strings = wanted(crowded).mapInArrow(
            cut_stretches(span, words, True), "key long, stretch long, n long, string long, place long")
        twice = strings.groupBy("string").agg(F.sum("n").alias("times")).where("times > 1").select("string")
        places = strings.where("n = 1").join(twice, "string", "left_semi").groupBy("key", "stretch").agg(F.sort_array(F.collect_list("place")).alias("begin"))
        long = F.when(F.col("key").bitwiseAND(1) == 1, words).otherwise(span).cast("long")
        found = found.unionByName(places.select("key", "stretch", "begin", F.transform("begin", lambda p: p + long).alias("end")))
    placed = shared.join(found, ["key", "stretch"]).select(
        "u", "key", F.explode(F.arrays_zip("begin", "end")).alias("s"), "low").select(
        "u", F.col("key").bitwiseAND(1).alias("unit"), (F.col("s.begin") + F.col("low")).alias("begin"), (F.col("s.end") + F.col("low")).alias("end"))
    spans = placed.groupBy("u").agg(*[F.collect_set(F.when(F.col("unit") == unit, F.struct("begin", "end"))).alias(f"s{unit}") for unit in (0, 1)])
    return spans.select("u", *[F.col(c).alias(name) for c, name in zip(("s0.begin", "s0.end", "s1.begin", "s1.end"), SPAN_COLUMNS)])


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, most: int = MOST_RUNS,
                    words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_passage_words``, ``n_passages``,
    and ``kept``, the bytes left.

    Texts are UTF-8 bytes; repeats may lie in one text, in several, and in rows that repeat an id or a whole row.  A null
    text is empty; a text of fewer than ``span`` bytes has no repeat.  ``n_passage_words`` are the words covered by a string of
    ``words`` words that also starts anywhere else, and ``n_passages`` their maximal runs; neither changes what is removed.
    Extra columns are ignored.
    """
    rows = docs.select(q(id).alias("id"), text_of(text).alias("text")).withColumn("u", F.xxhash64("id", "text"))
    found = fixed(repeats(rows.select("u", "text"), span, gram, most, words, word_gram))
    marked = join_checked(rows, found.select("u", F.lit(True).alias("marked")), ["u"], "left", 200_000)
    plain = marked.where("marked IS NULL").select("id", "text", *[F.lit(None).cast("array<long>").alias(c) for c in SPAN_COLUMNS])
    cut = marked.where("marked").drop("marked").join(found, "u").select("id", "text", *SPAN_COLUMNS)
    id_type = docs.schema[id].dataType.simpleString()
    got = plain.unionByName(cut).mapInArrow(
        cut_out(), f"id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, n_passages long, kept binary")
    return got.select(F.col("id").alias(id), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "n_passages", "kept")
