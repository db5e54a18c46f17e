"""Grouping of spelling variants: words of a corpus one edit apart, each led to its most frequent form.

Near words come from sorted lists scanned by dynamic programming.  A sorted list is a trie written down flat: words that
share a prefix are neighbours, and the lengths of the shared prefixes (LCPs) say where two neighbours part.  The edit matrix of
a query against a list therefore needs one row for each *distinct* prefix, which all words of that range reuse; a row is a band of
three cells, since beyond one insertion or deletion no cell can hold one edit, and a range whose row has no cell of at most
one is skipped with all its words.  The queries of a task advance together, one letter at a time, as numpy arrays.

No task sees the whole vocabulary.  Two words one edit apart agree before the edit and behind it: for the shorter one's length
m and a window [s, e) of places, pairs whose first difference lies in the window share their first s and last m - e letters.  A list
holds the words with these letters in common.  Windows start as the two halves of m + 1 places; a list of more than ``most`` words
is dealt anew with its window halved, down to a window of one place, where the alphabet bounds the list.  Each pair has one first
difference and thus belongs to one list, so counts add up and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import fixed, q, text_of, whole_groups
from sparkcohort.session import settle

MIN_LETTERS = 5
MIN_COUNT = 3
DROP_ONE_IN = 97
MOST_WORDS = 2_048
QUERIES_AT_ONCE = 16_384

# The letters of a run and their lower-casing.
RUN = r"[A-Za-z\x{C0}-\x{FF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
                       min_count: int = MIN_COUNT, drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, n): runs of letters in lower case, with the contract's letter deletions; combined before they are shuffled.

    A run shorter than ``min_letters`` cannot become a word, so it is left out before it is hashed.
    """
    runs = docs.select(F.coalesce(q(id).cast("string"), F.lit("")).alias("id"), F.explode(
        F.regexp_extract_all(text_of(text), F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= min_letters)
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    word = F.when(F.col("h") % drop_one_in == 0, cut).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= min_letters).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with word, n, m, s, e and the hash of the list they belong to."""
    shared = "substring(word, 1, s), CASE WHEN e < m THEN right(word, m - e) ELSE '' END"
    return rows.withColumn("key", F.expr(f"xxhash64(m, s, e, {shared})"))


def lists(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Every word once for each list it belongs to: word, n, m, s, e, key; lists of more than ``most`` words are split."""
    ms = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(ms).alias("m"))
    halves = F.expr("array(named_struct('s', 0, 'e', (m + 1) DIV 2), named_struct('s', (m + 1) DIV 2, 'e', m + 1))")
    cast = lambda df: df.select("word", "n", F.col("m").cast("int"), F.col("w.s").cast("int").alias("s"), F.col("w.e").cast("int").alias("e"))
    rows = _keyed(cast(rows.where("m > 0").withColumn("w", F.explode(halves)).where("w.e > w.s")))
    done = None
    while True:
        large = fixed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.max(F.expr("e - s")).alias("wide"))
                      .where((F.col("many") > most) & (F.col("wide") > 1)).select("key", F.lit(True).alias("large")))
        few = large.limit(50_001).count()
        if few == 0:
            return rows if done is None else done.unionByName(rows)
        # broadcast only when counted to be few rows of two fixed-width columns
        marked = rows.join(F.broadcast(large) if few <= 50_000 else large, "key", "left")
        kept = marked.where("large IS NULL").select("word", "n", "m", "s", "e", "key")
        mid = "(s + e) DIV 2"
        parts = F.expr(f"array(named_struct('s', s, 'e', {mid}), named_struct('s', {mid}, 'e', e))")
        rows = settle(_keyed(cast(marked.where("large").withColumn("w", F.explode(parts)))))
        done = settle(kept if done is None else done.unionByName(kept))


class SortedLists:
    """Several sorted lists end to end, with the LCP of every word and its predecessor in the same list."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
        """``data``: letters of one byte; words sorted within ``group``, a non-decreasing number of each word's list."""
        self.data = np.concatenate([data, np.zeros(3, np.uint8)])
        self.start, self.size, self.group = offsets[:-1], np.diff(offsets), group
        n = len(group)
        self.lcp = np.full(n, -1, np.int64)
        live = np.flatnonzero(group[1:] == group[:-1]) + 1
        self.lcp[live] = self.shared(live - 1, live)

    def letter(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Letters at 0-based places; 0 before a word's first and behind its last letter."""
        inside = (place >= 0) & (place < self.size[word])
        return np.where(inside, self.data[np.where(inside, self.start[word] + place, 0)], 0)

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each pair."""
        out, live, depth = np.zeros(len(a), np.int64), np.arange(len(a)), 0
        most = np.minimum(self.size[a], self.size[b])
        while len(live):
            live = live[most[live] > depth]
            live = live[self.data[self.start[a[live]] + depth] == self.data[self.start[b[live]] + depth]]
            depth += 1
            out[live] = depth
        return out

    def near(self, queries: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) at exactly one edit.  Query k scans the list [first, last), whose words share ``depth`` letters with it.

        All queries start at the depth of their list; those that start deeper join when the scan comes to their depth.
        """
        order = np.argsort(depth, kind="stable")
        queries, first, last, depth = queries[order], first[order], last[order], depth[order]
        none = np.zeros(0, np.int64)
        query, low, high, band = none, none, none, np.zeros((3, 0), np.int8)
        joined, at = 0, int(depth[0]) if len(depth) else 0
        reaches = np.arange(len(self.size))
        while joined < len(queries) or len(query):
            more = int(np.searchsorted(depth, at, "right"))
            if more > joined:
                # the row of an equal prefix: one edit to its left and right, none on the diagonal
                new = np.ones((3, more - joined), np.int8)
                new[0], new[1] = (1 if at else 2), 0
                query, low, high = np.concatenate([query, queries[joined:more]]), np.concatenate([low, first[joined:more]]), np.concatenate([high, last[joined:more]])
                band, joined = np.concatenate([band, new], axis=1), more
            # a word that ends here is the first of its range: the cell of the query's last letter is the distance
            ends = self.size[low] == at
            cell = self.size[query] - at + 1
            hit = np.flatnonzero(ends & (cell >= 0) & (cell <= 2))
            hit = hit[band[cell[hit], hit] == 1]
            if len(hit):
                yield query[hit], low[hit]
            low = low + ends
            # ranges of the next letter: they begin where neighbours share at most ``at`` letters
            reaches = reaches[self.size[reaches] > at]
            heads = reaches[self.lcp[reaches] <= at]
            bounds = np.flatnonzero(self.lcp <= at) if len(heads) else none
            a, b = np.searchsorted(heads, low), np.searchsorted(heads, high)
            # the first range of a state begins at ``low``, which may share more with a word before it only outside the range
            count = np.where(low < high, b - a, 0)
            parent = np.repeat(np.arange(len(low)), count)
            step = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            begin = heads[a[parent] + step]
            after = np.concatenate([bounds, [len(self.size)]])
            end = np.minimum(after[np.searchsorted(bounds, begin, "right")], high[parent])
            query, old, letter = query[parent], band[:, parent], self.data[self.start[begin] + at]
            # the band of row at + 1 holds the cells of columns at, at + 1 and at + 2 of the query
            size = self.size[query]
            x0 = np.minimum(old[0] + (self.letter(query, np.full(len(query), at - 1)) != letter), old[1] + 1)
            x1 = np.minimum(np.minimum(old[1] + (self.letter(query, np.full(len(query), at)) != letter), old[2] + 1), x0 + 1)
            x2 = np.minimum(old[2] + (self.letter(query, np.full(len(query), at + 1)) != letter), x1 + 1)
            band = np.stack([np.where(size < at, 2, x0), np.where(size < at + 1, 2, x1), np.where(size < at + 2, 2, x2)]).clip(0, 2).astype(np.int8)
            live = np.flatnonzero(band.min(0) <= 1)
            query, low, high, band = query[live], begin[live], end[live], band[:, live]
            at = at + 1 if len(query) else int(depth[joined]) if joined < len(queries) else at + 1


def near_in_lists(batches: Iterator[pa.RecordBatch], queries_at_once: int = QUERIES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """(word, near, best_n, best) of every word with near words in a list, from rows sorted by key and word."""
    for table, bounds in whole_groups(batches, ["m", "s", "e", "key"]):
        first_group = 0
        while first_group < len(bounds) - 1:
            # whole lists of about so many words at a time
            stop = int(np.searchsorted(bounds, bounds[first_group] + queries_at_once, "right")) - 1
            stop = min(max(stop, first_group + 1), len(bounds) - 1)
            part = table.slice(bounds[first_group], bounds[stop] - bounds[first_group])
            yield from _near_of(part, bounds[first_group:stop + 1] - bounds[first_group], queries_at_once)
            first_group = stop


def _near_of(part: pa.Table, bounds: np.ndarray, queries_at_once: int) -> Iterator[pa.RecordBatch]:
    words = part.column("word").to_pylist()
    n, m, s, e = (part.column(c).to_numpy() for c in ("n", "m", "s", "e"))
    coded = [w.encode("latin-1") for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    scan = SortedLists(np.frombuffer(b"".join(coded), np.uint8), offsets, group)
    near, best_n, best = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)
    for begin in range(0, len(n), queries_at_once):
        asked = np.arange(begin, min(begin + queries_at_once, len(n)))
        for a, b in scan.near(asked, bounds[group[asked]], bounds[group[asked] + 1], s[asked].astype(np.int64)):
            shorter, parts_at = np.minimum(scan.size[a], scan.size[b]), scan.shared(a, b)
            own = (shorter == m[a]) & (parts_at >= s[a]) & (parts_at < e[a])
            a, b = a[own], b[own]
            # of a query's words the one of largest n, ties by the smallest word: words are sorted within a list
            order = np.lexsort((b, -n[b], a))
            a, b = a[order], b[order]
            lead = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
            near += np.bincount(a, minlength=len(n))
            a, b = a[lead], b[lead]
            better = (n[b] > best_n[a]) | ((n[b] == best_n[a]) & (b < best[a]))
            best_n[a[better]], best[a[better]] = n[b[better]], b[better]
    got = np.flatnonzero(near)
    yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in got], pa.string()), pa.array(near[got]), pa.array(best_n[got]),
                                      pa.array([words[i] for i in best[got]], pa.string())], ["word", "near", "best_n", "best"])


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of every word with a word one edit away; ``form`` is the one of largest n."""
    rows = lists(words, most)
    # lists are small and many: dealt by their number, not by bytes, since the work of a row is far more than its size
    tasks = max(1, -(-rows.count() // 100_000), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (rows.repartition(tasks, "key").sortWithinPartitions("m", "s", "e", "key", "word")
             .mapInArrow(near_in_lists, "word string, near long, best_n long, best string"))
    top = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.n")).alias("form_n"), F.col("top.w").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form.  Counts at least double along forms, so few doublings suffice.

    A form's followers are its near words, whose number its length and the alphabet bound: no key of these joins is hot.
    """
    current = fixed(forms.select("word", F.col("form").alias("root")))
    while True:
        step = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = fixed(current.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        current = longer.select("word", "root")
        if not longer.where("moved").take(1):
            return current


def grouped(words: DataFrame, most: int = MOST_WORDS, factor: int = 2) -> DataFrame:
    """One row per word of (word, n): ``form`` (its near word of largest n, ties the smallest, if that n is at least ``factor``
    times its own), ``root`` (the last form, the word itself without one), ``n_near`` and ``form_n``.

    Words are distinct, of letters up to U+00FF; a null word has no place in the vocabulary and is left out, repeated words have
    to be summed first (``words_of_documents`` does).  An empty vocabulary gives an empty result.
    """
    words = settle(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")))
    both = words.join(near_words(words, most), "word", "left")
    lead: Column = F.col("form_n") >= factor * F.col("n")
    both = settle(both.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(lead, F.col("form")).alias("form"),
                              F.when(lead, F.col("form_n")).alias("form_n")))
    return both.join(roots(both.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """``grouped`` over the words of ``docs``: null and empty texts have no words, a null id counts as an empty one in the hash,
    repeated rows count as often as they occur, extra columns are ignored, and texts are read whole whatever their length."""
    return grouped(words_of_documents(docs, id, text), most)
