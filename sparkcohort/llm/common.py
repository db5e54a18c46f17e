"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcohort.session import settle

SPACES = r"[\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col(f"`{name}`")


def numbered(df: DataFrame) -> DataFrame:
    """The frame with its columns called c0, c1, ..., so that no name of the caller's meets one of ours."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def text_of(column: str) -> Column:
    return F.coalesce(q(column).cast("string"), F.lit(""))


def fixed(df: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """A settled frame of narrow rows in as many partitions as its counted rows fill, so that small ones stay few files."""
    got = settle(df)
    return got.coalesce(max(1, -(-got.count() // rows_per_task)))


def join_checked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, most_rows: int = 50_000) -> DataFrame:
    """Join with a right side of fixed-width rows: broadcast when its counted rows are few, by shuffle beyond that."""
    right = fixed(right)
    few = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if few else right, list(keys), how)


class Shipped:
    """A broadcast of an object of this package.  Its bytes bring the classes along (a plain broadcast names them only), so
    executors open it without the package, once a process."""

    def __init__(self, spark: SparkSession, value: object):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.opened: object | None = None

    @property
    def value(self):
        if self.opened is None:
            self.opened = pickle.loads(self.packed.value)
        return self.opened


def byte_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows whose texts hold about ``most_bytes``: (first row, row after the last, bytes, row offsets).

    A single longer text makes a slice of its own and is whole.  Null counts as empty.
    """
    array = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(array.type) or array.null_count:
        array = array.cast(pa.string()).fill_null("")
    if len(array) == 0:
        return
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, "right")) - 1)
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes other than space and control white space, within each row."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    head[inner] = solid[inner]
    start = np.flatnonzero(head)
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | head[1:]
    end = np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its bytes and length: differences of a prefix sum of mixed (byte, place) pairs.

    Bytes are gathered eight at a time; words are grouped by their number of eight-byte pieces.
    """
    length = end - start
    out = mixed(length.astype(np.uint64) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    mask = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        left = np.minimum(end[live] - at, 8)
        piece = np.ascontiguousarray(windows[at]).view(np.uint64).ravel() & mask[left]
        out[live] = mixed(out[live] * MIX + piece)
        more = end[live] - at > 8
        live, at = live[more], at[more] + 8
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and their row offsets, from batches that are sorted by the integer columns ``keys``.

    Only the last group of a batch is held back, so memory is that of a batch and one group; callers bound their groups.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([r[1:] != r[:-1] for r in rows])) + 1
        if held:
            before = [held[-1].column(batch.schema.get_field_index(k))[-1].as_py() for k in keys]
            if any(r[0] != b for r, b in zip(rows, before)):
                change = np.concatenate([[0], change])
        if not len(change):
            held.append(batch)
            continue
        kept = sum(b.num_rows for b in held)
        table = pa.Table.from_batches([*held, batch.slice(0, change[-1])]).combine_chunks()
        yield table, np.unique(np.concatenate([[0], change + kept]))
        held = [batch.slice(change[-1])]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.array([0, table.num_rows])


def forest(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the smallest member of each member's component."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(label)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (src, dst), for every node of an edge.

    Alternates large-star and small-star steps.  A step is one aggregation of minima and one equi-join, so a node with very
    many edges is combined before it moves and its join is split.  Rounds end when all components are stars.
    """
    current = fixed(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    for _ in range(most_rounds):
        # done when every edge leads to a centre that leads nowhere, and every node has one edge
        roots = current.select(F.col("dst").alias("node"), F.lit(1).alias("root"), F.lit(0).alias("out"))
        leaves = current.select(F.col("src").alias("node"), F.lit(0).alias("root"), F.lit(1).alias("out"))
        bad = roots.unionByName(leaves).groupBy("node").agg(F.max("root").alias("root"), F.sum("out").alias("out"))
        if not bad.where("(root = 1 AND out > 0) OR out > 1").take(1):
            break
        both = current.unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("__m")).select("src", F.least("src", "__m").alias("__m"))
        large = fixed(both.where("dst > src").join(least, "src").where("dst <> __m")
                      .select(F.col("dst").alias("src"), F.col("__m").alias("dst")).unionByName(
                          least.where("src <> __m").select("src", F.col("__m").alias("dst"))).distinct())
        down = large.groupBy("src").agg(F.min("dst").alias("__m"))
        current = fixed(large.join(down, "src").where("dst <> __m").select(F.col("dst").alias("src"), F.col("__m").alias("dst"))
                        .unionByName(down.select("src", F.col("__m").alias("dst"))).where("src <> dst").distinct())
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def linked_report(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, links, component, kept) for every row, from links between classes of equal rows.

    ``rows``: id and h, the class key, null for rows that link with nothing.  ``classes``: h, rep (a number of the class),
    least_id, copies.  ``found``: rep, links (rows of other classes first met in a bin), root (a rep it is connected with).
    """
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    named = fixed(classes.join(links, "rep", "left").join(tree.withColumnRenamed("node", "rep"), "rep", "left")
                   .select("h", "copies", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("c")))
    # the number of a component is the smallest id of its members
    smallest = named.groupBy("c").agg(F.min("least_id").alias("component"))
    result = rows.select("id", "h").join(named.join(smallest, "c").select("h", "copies", "links", "component"), "h", "left")
    component = F.coalesce("component", "id")
    return result.select("id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("links"),
                         component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))


def block_pairs(blocks: str, member: str) -> tuple[Column, Column]:
    """A member's block among ``blocks``, and the array of block pairs (i <= j) that it takes part in."""
    own = F.pmod(F.xxhash64(member), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1),
                        lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j")))
    return own, pairs
