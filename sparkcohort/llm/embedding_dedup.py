"""Near-duplicate embeddings by spherical-cap filters.

A filter direction is a product code: the rotated vector is cut into three blocks, and each block has a small random codebook
of unit vectors; every combination of one code word per block is a direction.  Each vector is list-decoded, block by block
with pruning, to all directions whose inner product with it exceeds its threshold.  The threshold is a vector's own: it is
set so that the same number of directions exceeds it for every vector, since under a common one vectors that lie badly in
the blocks would have almost no direction and be found by nobody.  Vectors meet in the bins of their shared directions,
where cosines are computed exactly in double precision.  The number of directions follows the number of vectors,
so bins keep their mean size; a bin that is still large is cut into blocks whose pairs of blocks are compared in different
tasks, so nothing is dropped.

A pair that meets in several bins is counted in the one with the smallest number only: each vector carries the numbers of
its bins.  Bins therefore return link counts and the edges of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import block_pairs, fixed, forest, join_checked, linked_report, q, whole_groups

COSINE = 0.9
TABLES = 5           # independent rotations and codebooks
BLOCKS = 3
FILTERS = 7          # directions of a table that a vector is decoded to
BIN = 8              # mean number of unrelated vectors in a bin
BLOCK = 512          # rows of a bin compared at once
SEED = 20240229


class Code:
    """Rotations and codebooks for vectors of one length; their size follows a root of the number of vectors."""

    def __init__(self, length: int, vectors: int, tables: int = TABLES, filters: int = FILTERS, bin: int = BIN):
        rng = np.random.default_rng(SEED + length)
        self.filters, self.tables = filters, []
        parts = min(BLOCKS, length)
        edges = np.linspace(0, length, parts + 1).astype(int)
        self.words = max(filters, int(np.ceil((filters * max(vectors, 1) / bin) ** (1 / parts))))
        for _ in range(tables):
            rotation = np.linalg.qr(rng.standard_normal((length, length)))[0]
            books = []
            for a, b in zip(edges[:-1], edges[1:]):
                book = rng.standard_normal((self.words, b - a))
                books.append((a, b, (book / np.linalg.norm(book, axis=1, keepdims=True)).T))
            self.tables.append((rotation, books))
        self.span = self.words ** parts

    def decode(self, x: np.ndarray) -> np.ndarray:
        """For each unit row the directions of every table that exceed the row's threshold, its ``filters``-th best value.

        Partial codes are extended block by block, and only those that can still be among the best are kept: a best code's
        leading blocks are among the best of those blocks.
        """
        out = []
        for t, (rotation, books) in enumerate(self.tables):
            y = x @ rotation
            code, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for a, b, book in books:
                s = y[:, a:b] @ book
                near = np.argpartition(-s, self.filters - 1, axis=1)[:, :self.filters]
                value = (value[:, :, None] + np.take_along_axis(s, near, axis=1)[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * self.words + near[:, None, :]).reshape(len(x), -1)
                best = np.argpartition(-value, self.filters - 1, axis=1)[:, :self.filters]
                value, code = np.take_along_axis(value, best, axis=1), np.take_along_axis(code, best, axis=1)
            out.append(code + t * self.span)
        return np.sort(np.hstack(out), axis=1)


def unit_values(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all vectors, one after the other and each divided by its vector's length, and the vectors' offsets."""
    x = np.array(array.flatten().to_numpy(zero_copy_only=False), np.float64)
    offsets = array.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    sizes = np.diff(offsets)
    x /= np.repeat(np.maximum.reduceat(np.abs(x), offsets[:-1]), sizes)      # no overflow or underflow in the squares
    x /= np.repeat(np.sqrt(np.add.reduceat(x * x, offsets[:-1])), sizes)
    return x, offsets


def decoder(vectors: int, tables: int, filters: int, bin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Code] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            for length in np.unique(lengths).tolist():
                if length not in made:
                    made[length] = Code(length, vectors, tables, filters, bin)
                at = np.flatnonzero(lengths == length)
                for first in range(0, len(at), 1024):
                    rows = batch.take(pa.array(at[first:first + 1024]))
                    keys = made[length].decode(unit_values(rows.column(1))[0].reshape(-1, length)) * 4099 + length % 4099   # lengths do not mix
                    offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
                                                     names=["rep", "keys"])
    return run


def compare_bins(least: float):
    """Whole bins, or pairs of blocks of a large bin, in; per vector its links first met here and its tree edge, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["key", "i", "j"]):
            rep, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            values, vec = unit_values(table.column("vec").combine_chunks())
            lists = table.column("keys").combine_chunks()
            flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out_rep, out_links, out_root = [], [], []
            for a, b in zip(starts[:-1], starts[1:]):
                if b - a < 2:
                    continue
                x = values[vec[a]:vec[b]].reshape(b - a, -1)
                linked = x @ x.T >= least
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:                            # only across the two blocks
                    linked &= block[a:b, None] != block[None, a:b]
                if not linked.any():
                    continue
                at = np.flatnonzero(linked.any(1))
                linked = linked[np.ix_(at, at)]
                earlier = [flat[offs[a + k]:offs[a + k + 1]] for k in at]
                earlier = [e[e < key[a]] for e in earlier]
                number, slot = np.unique(np.concatenate(earlier), return_inverse=True)
                has = np.zeros((len(at), len(number)), np.float32)
                has[np.repeat(np.arange(len(at)), [len(e) for e in earlier]), slot] = 1
                first = linked & (has @ has.T < 0.5)
                root = forest(linked)
                who = rep[a:b][at]
                out_rep.append(who)
                out_links.append(first @ copies[a:b][at])
                # the component's smallest vector, not its first row, so that edges agree between bins
                low = np.full(len(at), np.iinfo(np.int64).max)
                np.minimum.at(low, root, who)
                out_root.append(low[root])
            if out_rep:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in (out_rep, out_links, out_root)],
                                                 names=["rep", "links", "root"])
    return run


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", least: float = COSINE,
                    tables: int = TABLES, filters: int = FILTERS, bin: int = BIN, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Equal vectors are compared once: they are one class, whose members link with each other and share their links.  Null,
    empty and zero vectors and those with null or non-finite components link with nothing; so do vectors of different
    lengths.  Rows that repeat an id are rows like any other.  A null id is no component's smallest.
    """
    shape = vectors.select(q(id).cast("long").alias("id"), q(embedding).cast("array<double>").alias("vec"))
    fine = (F.size("vec") > 0) & F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    hashed = F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))
    rows = shape.withColumn("h", F.when(F.coalesce(fine, F.lit(False)), hashed))
    classes = (rows.where("h IS NOT NULL").groupBy("h").agg(F.min("id").alias("least_id"), F.count("*").alias("copies"),
                                                            F.any_value("vec").alias("vec"))
               .withColumn("rep", F.xxhash64("h")))
    classes = fixed(classes)
    total = classes.count()
    decoded = fixed(classes.select("rep", "vec").mapInArrow(decoder(total, tables, filters, bin), "rep long, keys array<long>"))
    members = decoded.select("rep", F.explode("keys").alias("key"))
    # bins of one vector compare nothing; large ones are cut into blocks
    bins = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block)).drop("n")
    joined = join_checked(members, bins, ["key"], "inner")
    placed = joined.groupBy("rep").agg(F.collect_list(F.struct("key", "blocks")).alias("bins"))   # at most a vector's directions
    own, pairs = block_pairs("blocks", "rep")
    sent = (placed.join(classes.select("rep", "vec", "copies"), "rep").join(decoded, "rep")
            .select("rep", "vec", "copies", "keys", F.explode("bins").alias("b"))
            .select("rep", "vec", "copies", "keys", F.col("b.key").alias("key"), F.col("b.blocks").alias("blocks"))
            .select("rep", "vec", "copies", "keys", "key", own.alias("block"), F.explode(pairs).alias("p"))
            .select("rep", "vec", "copies", "keys", "key", "block", "p.i", "p.j"))
    found = fixed(sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                   .mapInArrow(compare_bins(least), "rep long, links long, root long"))
    got = linked_report(rows, classes, found)
    return got.select(F.col("id").alias(id), F.col("links").alias("n_links"), F.col("component").alias("component_id"), "kept")
