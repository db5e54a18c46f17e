"""Jaccard join on word n-grams by chosen paths.

Equal texts are one class.  A class is a sketch of ``COORDINATES`` minhashes, tokens of which two classes share each with the
probability of their Jaccard similarity.  All classes start in one node; a node samples ``CHOICES`` coordinates, and a class
goes to one child for each of them, named by its token there.  Nodes that hold few classes are compared by brute force;
larger ones are split again, unless the sizes of their children show that most of their pairs are similar anyway: then they
are compared at once, in blocks, as every pair is likely to be a link.  With two choices a pair of similarity s survives
all levels of a run with probability q, the fixed point of q = 1 - (1 - s q)^2; the number of runs follows from q and the
target recall.

Nodes compare sketches only and return the edges of spanning forests over pairs whose sketches are close.  The classes of a
connected component of those edges then come together with their whole n-gram sets, once each, and all pairs among them are
verified exactly.  A component of many classes is cut into blocks, and tasks compare pairs of blocks; they return link
counts and forest edges, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import (MIX, block_pairs, byte_slices, components, fixed, forest, join_checked, linked_report, mixed, numbered, q, text_of,
                                    whole_groups, word_hashes, words_of)

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 64
CHOICES = 2
RECALL = 0.9999
SMALL = 32          # classes of a node that are compared by brute force
DENSE = 0.5         # mean similarity of a node's pairs from which splitting it further saves nothing
LEVELS = 8          # splits at most; what is left then is compared in blocks
MARGIN = 0.3        # sketches may estimate a similarity lower than it is by so much: six standard deviations
BLOCK = 256         # classes compared at once


def runs_needed(similarity: float, recall: float) -> int:
    """Repetitions after which a pair at the threshold was missed with probability 1 - recall at most."""
    survive = 1.0
    for _ in range(200):
        survive = 1 - (1 - similarity * survive) ** CHOICES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survive)))


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of every word n-gram in text order, and two hashes of each row's word sequence.

    A row of fewer words has one n-gram of all its words; a row without words has none.
    """
    n = len(offsets) - 1
    start, end, row = words_of(data, offsets)
    w = word_hashes(data, start, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    place = (np.arange(len(w)) - first[row]).astype(np.uint64)
    keys = []
    for salt in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(w * MIX + (place + np.uint64(salt)) * np.uint64(0xD1342543DE82EF95)), dtype=np.uint64)])
        keys.append(mixed(sums[first + count] - sums[first] + np.uint64(salt)))
    gram = np.zeros(max(len(w) - words + 1, 0), np.uint64)
    for k in range(words):
        gram = mixed(gram + w[k:k + len(gram)]) if k else w[:len(gram)].copy()
    inside = row[:len(gram)] == row[words - 1:] if len(gram) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < words))
    grams = np.concatenate([gram[inside], keys[0][short]])
    rows = np.concatenate([row[:len(gram)][inside], short])
    order = np.argsort(rows, kind="stable")
    return grams[order], rows[order], keys[0], keys[1]


def sketcher(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        factor = rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch, "text", 1 << 20):
                gram, row, k1, k2 = shingles(data, offsets, words)
                full = np.unique(row)
                sketch = np.zeros((b - a, COORDINATES), np.int32)
                if len(full):
                    head = np.searchsorted(row, full)
                    for c in range(COORDINATES):
                        token = ((gram * factor[c]) >> np.uint64(33)).astype(np.int32)
                        sketch[full, c] = np.minimum.reduceat(token, head)
                some = np.zeros(b - a, bool)
                some[full] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(k1.view(np.int64), mask=~some), pa.array(k2.view(np.int64), mask=~some),
                     pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), COORDINATES).cast(pa.list_(pa.int32()))],
                    names=["id", "k1", "k2", "sketch"])
    return run


def close_in_nodes(least: float):
    """Forest edges over the pairs of a node whose sketches agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["node", "i", "j"]):
            rep = table.column("rep").to_numpy()
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
            src, dst = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a == 2:
                    if (sketch[a] == sketch[a + 1]).mean() >= least:
                        src.append(rep[a:a + 1])
                        dst.append(rep[a + 1:b])
                elif b - a > 2:
                    part = sketch[a:b]
                    same = np.zeros((b - a, b - a), np.int32)
                    for c in range(COORDINATES):
                        same += part[:, c, None] == part[None, :, c]
                    linked = same >= least * COORDINATES
                    root = forest(linked)
                    at = np.flatnonzero(root != np.arange(b - a))
                    src.append(rep[a:b][at])
                    dst.append(rep[a:b][root[at]])
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])
    return run


def with_sets(words: int):
    """The n-gram set of each row, as sorted hashes; rows whose text is not that of the class they were joined for go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1_at, k2_at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k1", "k2"))
            for a, b, data, offsets in byte_slices(batch, "text", 1 << 20):
                gram, row, k1, k2 = shingles(data, offsets, words)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                sets = [np.unique(gram[bounds[k]:bounds[k + 1]]).tobytes() for k in range(b - a)]
                same = (k1.view(np.int64) == k1_at[a:b]) & (k2.view(np.int64) == k2_at[a:b])
                out = batch.slice(a, b - a).select(["rep", "copies", "cluster", "blocks"])
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(sets, pa.binary())], names=[*out.schema.names, "grams"])
                yield out.filter(pa.array(same))
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of incidence matrices over the n-grams that two sets share."""
    size = np.array([len(s) for s in sets])
    number, slot, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = seen > 1
    place = np.cumsum(shared) - 1
    keep = shared[slot]
    owner, column = owner[keep], place[slot[keep]]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += has @ has.T
    out[np.arange(len(sets)), np.arange(len(sets))] = size
    return out


def verify(least: float):
    """Whole clusters, or pairs of blocks of one, in; per class its links and its tree edge, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["cluster", "i", "j"]):
            rep, copies, block, i, j = (table.column(c).to_numpy() for c in ("rep", "copies", "block", "i", "j"))
            grams = table.column("grams")
            out = []
            for a, b in zip(starts[:-1], starts[1:]):
                at = a + np.unique(rep[a:b], return_index=True)[1]      # the class's row may repeat in the input
                if len(at) < 2:
                    continue
                sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in at]
                both = overlaps(sets)
                size = both.diagonal()
                linked = both / (size[:, None] + size[None, :] - both) >= least - 1e-12
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:
                    linked &= block[at][:, None] != block[at][None, :]
                some = np.flatnonzero(linked.any(1))
                if len(some):
                    linked = linked[np.ix_(some, some)]
                    who = rep[at][some]
                    out.append((who, linked @ copies[at][some], who[forest(linked)]))   # reps are sorted: the first is the smallest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in zip(*out)], names=["rep", "links", "root"])
    return run


def candidate_edges(classes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(src, dst): forests over the pairs that chosen paths bring together and whose sketches are close."""
    runs = runs_needed(similarity, recall)
    start = [F.xxhash64(F.lit(c), F.element_at("sketch", c + 1)) for c in range(runs * CHOICES)]
    frontier = classes.select("rep", F.explode(F.array(*start)).alias("node"))
    small, large = [], []
    for level in range(LEVELS):
        frontier = fixed(frontier) if level else frontier
        counts = fixed(frontier.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
        small.append(join_checked(frontier, counts.where(f"n <= {SMALL}").select("node"), ["node"], "left_semi"))
        big = fixed(join_checked(frontier, counts.where(f"n > {SMALL}"), ["node"], "inner"))
        if not big.take(1):
            break
        step = [F.struct(F.lit(c).alias("c"), F.pmod(F.xxhash64("node", F.lit(c)), F.lit(COORDINATES)).cast("int").alias("at")) for c in range(CHOICES)]
        child = fixed(big.join(classes.select("rep", "sketch"), "rep").withColumn("step", F.explode(F.array(*step)))
                       .select("rep", "n", F.col("node").alias("parent"),
                               F.xxhash64("node", "step.c", "step.at", F.element_at("sketch", F.col("step.at") + 1)).alias("node")))
        kin = child.groupBy("parent", "node").agg(F.count("*").cast("double").alias("k"), F.first("n").alias("n"))
        dense = kin.groupBy("parent").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"), F.first("n").alias("n"))
        stop = F.col("pairs") >= DENSE * CHOICES * F.col("n") * F.col("n")
        dense = fixed(dense.select("parent", F.lit(True) if level == LEVELS - 1 else stop.alias("stop")).toDF("parent", "stop"))
        large.append(join_checked(big, dense.where("stop").select(F.col("parent").alias("node")), ["node"], "left_semi"))
        frontier = join_checked(child, dense.where("NOT stop").select("parent"), ["parent"], "left_semi").select("rep", "node")
    placed = None
    for part in small:
        part = part.select("rep", "node", F.lit(1).cast("long").alias("blocks"))
        placed = part if placed is None else placed.unionByName(part)
    for part in large:
        placed = placed.unionByName(part.select("rep", "node", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    _, pairs = block_pairs("blocks", "rep")
    sent = (placed.join(classes.select("rep", "sketch"), "rep").withColumn("p", F.explode(pairs))
            .select("node", "p.i", "p.j", "rep", "sketch"))
    return (sent.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")
            .mapInArrow(close_in_nodes(similarity - MARGIN), "src long, dst long"))


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
                 recall: float = RECALL) -> DataFrame:
    """One row per input row: id, ``class_id`` (smallest id reachable over links), ``n_links`` (rows linked directly), ``kept``.

    Rows link when the sets of their word n-grams have a Jaccard similarity of at least ``similarity``; words are runs without
    white space.  Rows of equal words are one class: they link with each other and share their links.  A text of fewer than
    ``words`` words has one n-gram; null texts and those without words link with nothing.  Null ids are never a class id
    while their group has another.  Extra columns are ignored; an empty table gives an empty result.
    """
    id_type = docs.schema[id].dataType.simpleString()
    texts = docs.select(q(id).alias("id"), text_of(text).alias("text"))
    sketched = fixed(texts.mapInArrow(sketcher(words), f"id {id_type}, k1 long, k2 long, sketch array<int>"))
    rows = sketched.select("id", F.when(F.col("k1").isNotNull(), F.struct("k1", "k2")).alias("h"))
    classes = fixed(sketched.where("k1 IS NOT NULL").groupBy(F.struct("k1", "k2").alias("h"))
                     .agg(F.min("id").alias("least_id"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"))
                     .withColumn("rep", F.xxhash64("h")))
    edges = fixed(candidate_edges(classes, similarity, recall))
    cluster = components(edges).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    sizes = cluster.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    wanted = (classes.select("rep", "h.k1", "h.k2", "copies", F.col("least_id").alias("id"))
              .join(cluster.join(sizes, "cluster"), "rep"))
    # a class whose ids are all null is read by the null id
    wanted = wanted.select(F.struct("id").alias("key"), "rep", "k1", "k2", "copies", "cluster", "blocks")
    found = join_checked(texts.select(F.struct("id").alias("key"), "text"), wanted, ["key"], "inner", 200_000)
    sets = found.select("text", "rep", "k1", "k2", "copies", "cluster", "blocks").mapInArrow(
        with_sets(words), "rep long, copies long, cluster long, blocks long, grams binary")
    own, pairs = block_pairs("blocks", "rep")
    compared = fixed(sets.select("rep", "copies", "cluster", "grams", own.alias("block"), F.explode(pairs).alias("p"))
                      .select("rep", "copies", "cluster", "grams", "block", "p.i", "p.j")
                      .repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
                      .mapInArrow(verify(similarity), "rep long, links long, root long"))
    got = linked_report(rows, classes.drop("sketch"), compared)
    return got.select(F.col("id").alias(id), F.col("component").alias("class_id"), F.col("links").alias("n_links"), "kept")


def drop_near_copies(docs: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """The input's rows and columns without those whose id is not its class id.  Ids name rows here."""
    gone = jaccard_join(docs, id, **settings).where("NOT kept").select(F.col(id).alias("gone")).distinct().withColumn("drop", F.lit(True))
    plain = numbered(docs)
    left = plain.withColumn("gone", F.col(f"c{docs.columns.index(id)}"))
    return join_checked(left, gone, ["gone"], "left", 200_000).where("drop IS NULL").select(*plain.columns).toDF(*docs.columns)
