"""The trie of conversation prefixes, its subtree sums by the Euler-tour technique.

1. Turns become narrow rows at once: a SHA-256 of role and text, and the words of the text.  They are numbered inside blocks of
   turn numbers and shifted by the counts of earlier blocks, and the hash of a prefix is the XOR of hashes that include the place,
   carried on from block to block in the same way; so a conversation of any length is spread over tasks.
2. Members with equal prefixes are combined into nodes.  A node's name is (its smallest member, its depth).
3. Children meet their parent as arrays of a bounded range of conversation numbers (``BLOCK``), so a parent of very many
   children is as many rows as it has ranges.  The arrays give each node its first and last child and its siblings, hence
   the successor and predecessor of its enter arc and its exit arc in the tour.
4. The list of arcs is ranked without walking it.  First the enter arcs of one conversation, and its exit arcs between
   branchings, which follow each other, are joined into runs.  Then rounds of contraction: an arc whose random priority exceeds
   both neighbours' is taken out and its length goes to its predecessor, until at most ``FINISH`` are left, which one task
   ranks; the arcs taken out get their ranks back in reverse order.  A round shuffles what is left, and about a third goes
   each time, so all rounds together move a few times the list.
5. Prefix sums of leaves and savings over the ranks, block by block; a subtree's sum is the difference between its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.llm.common import fixed, q, text_of
from sparkcohort.session import settle

FAMILY = 20
HEADS = 4
BLOCK = 256
FINISH = 16_384
TURN_BITS = 10

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, by: Sequence[str], block: str, order: Sequence[Column], sums: dict[str, str], how=F.sum, zero=0) -> DataFrame:
    """Inclusive running aggregates along ``by``: inside blocks, plus the totals of earlier blocks; ``sums`` maps new to old names.

    Blocks are in the order of their number and bounded by the caller; their totals go through a window of one row a block.
    """
    inner = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*by, block).agg(*[how(old).alias(f"{new}_t") for new, old in sums.items()])
    offsets = totals.select(*by, block, *[F.coalesce(how(f"{new}_t").over(before), F.lit(zero)).alias(f"{new}_o") for new in sums])
    add = (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)
    inside = df.withColumns({f"{new}_i": how(old).over(inner) for new, old in sums.items()})
    joined = inside.join(offsets, [*by, block])
    return joined.withColumns({new: add(F.col(f"{new}_i"), F.col(f"{new}_o")) for new in sums}).drop(*[f"{n}_{x}" for n in sums for x in "io"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(c, place, sha, words): every turn's 1-based place in its conversation, by turn (null first), ties by hash.

    Rows without a conversation number belong to none and are left out; repeated rows are turns of their own.
    """
    text, role = text_of("text"), text_of("role")
    narrow = settle(turns.where(q("conv_id").isNotNull()).select(
        q("conv_id").cast("long").alias("c"), q("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")))
    cell = narrow.withColumns({"cell": F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62))), "one": F.lit(1).cast("long")})
    return running(cell, ["c"], "cell", [F.col("turn").asc_nulls_first(), F.col("sha")], {"place": "one"}).select("c", "place", "sha", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(c, place, sha, words) of the rebuilt conversations, with a row of place 0 (no turn) for each of them."""
    rows = settle(numbered_turns(turns))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    donor = rows.where((F.col("place") < HEADS) & (F.col("c") % FAMILY == 0))
    heads = donor.groupBy(F.col("c").alias("donor")).agg(F.sort_array(F.collect_list(F.struct("place", "sha", "words"))).alias("heads"))
    # one row a conversation; at most 3 turns and 20 conversations to a donor
    own = rows.groupBy("c").agg(F.count(F.lit(1)).alias("size")).withColumns({"h": head, "donor": F.col("c") - F.col("c") % FAMILY})
    convs = settle(own.join(heads, "donor", "left").select("c", "h", F.expr("slice(coalesce(heads, array()), 1, cast(h AS int))").alias("heads")))
    given = convs.select("c", F.explode("heads").alias("t")).select("c", "t.place", "t.sha", "t.words")
    kept = rows.withColumn("h", head).where(F.col("place") > F.col("h"))
    # a donor of fewer turns moves the rest up; such conversations are few and their shift is the same for all their rows
    short = convs.where(F.size("heads") < F.col("h")).select("c", (F.col("h") - F.size("heads")).alias("less"))
    moved = kept.join(fixed(short), "c", "left").select("c", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "sha", "words")
    root = convs.select("c", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("sha"), F.lit(0).cast("long").alias("words"))
    return root.unionByName(given).unionByName(moved)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, k1, k2, p1, p2, words, last): 128-bit keys of every prefix of every rebuilt conversation and of its parent."""
    rows = rebuilt(turns)
    hashed = rows.select("c", F.col("place").alias("depth"), "words", F.shiftright("place", TURN_BITS).alias("cell"),
                         F.xxhash64("place", "sha").alias("h1"), F.xxhash64("sha", F.lit("second"), "place").alias("h2"))
    keyed = running(hashed, ["c"], "cell", [F.col("depth")], {"k1": "h1", "k2": "h2"}, F.bit_xor)
    sizes = rows.groupBy("c").agg(F.max("place").alias("len"))
    return keyed.join(sizes, "c").select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"),
                                         F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), "words", (F.col("depth") == F.col("len")).alias("last"))


def joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined texts of each node, from rows sorted by node and block; only the running hash is held."""
    now, digest, out = None, None, []
    for batch in batches:
        for depth, k1, k2, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "k1", "k2", "text"))):
            if (depth, k1, k2) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, k1, k2), hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            list(zip(*out)) or [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "k1", "k2", "sha"])
        out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], ["depth", "k1", "k2", "sha"])


def nodes(turns: DataFrame) -> DataFrame:
    """One row per node: c (smallest member), depth, k1, k2, p1, p2, n_convs, words, sha (hash of the members that end there)."""
    members = settle(prefixes(turns))
    node = members.groupBy("depth", "k1", "k2").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
                                                    F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("last").alias("ends"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",")
    ends = (members.where("last").withColumn("range", F.floor(F.col("c") / BLOCK)).groupBy("depth", "k1", "k2", "range").agg(texts.alias("text")))
    shas = (ends.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "range")
            .select("depth", "k1", "k2", "text").mapInArrow(joined_hashes, "depth long, k1 long, k2 long, sha string"))
    return settle(node.join(shas, ["depth", "k1", "k2"], "left").drop("ends"))


def arc(c: Column | str, depth: Column, exit: int) -> Column:
    return F.struct(F.col(c).alias("c") if isinstance(c, str) else c.alias("c"), depth.cast("long").alias("d"), F.lit(exit).alias("x"))


def tour(node: DataFrame) -> DataFrame:
    """Nodes with their parent, their number of children, and successor and predecessor of both arcs (null at the list's ends)."""
    child = node.where("depth > 0").select("c", "depth", "p1", "p2", F.floor(F.col("c") / BLOCK).alias("range"))
    ranges = child.groupBy("depth", "p1", "p2", "range").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    siblings = Window.partitionBy("depth", "p1", "p2").orderBy("range")
    ranges = ranges.withColumns({"next_c": F.lead(F.get("cs", F.lit(0))).over(siblings), "prev_c": F.lag(F.element_at("cs", -1)).over(siblings)})
    parents = node.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent"))
    ranges = settle(ranges.join(parents, ["depth", "p1", "p2"]).select("depth", "range", "cs", "next_c", "prev_c", "parent"))
    linked = ranges.select("depth", "parent", "cs", "next_c", "prev_c", F.posexplode("cs").alias("i", "c")).select(
        "c", "depth", "parent", F.coalesce(F.get("cs", F.col("i") + 1), "next_c").alias("next_c"),
        F.coalesce(F.get("cs", F.col("i") - 1), "prev_c").alias("prev_c"))
    families = ranges.groupBy(F.col("parent").alias("c"), (F.col("depth") - 1).alias("depth")).agg(
        F.sum(F.size("cs")).alias("n_children"), F.min(F.get("cs", F.lit(0))).alias("first_c"), F.max(F.element_at("cs", -1)).alias("last_c"))
    up, down, here = F.col("depth") - 1, F.col("depth") + 1, F.col("depth")
    known = lambda c, then, other: F.when(F.col(c).isNotNull(), then).otherwise(other)
    return settle(node.drop("k1", "k2", "p1", "p2").join(linked, ["c", "depth"], "left").join(families, ["c", "depth"], "left").select(
        "c", "depth", "parent", "n_convs", "words", "sha", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        known("first_c", arc("first_c", down, 0), arc("c", here, 1)).alias("enter_next"),
        known("prev_c", arc("prev_c", here, 1), known("parent", arc("parent", up, 0), F.lit(None))).alias("enter_prev"),
        known("next_c", arc("next_c", here, 0), known("parent", arc("parent", up, 1), F.lit(None))).alias("exit_next"),
        known("last_c", arc("last_c", down, 1), arc("c", here, 0)).alias("exit_prev")))


def runs(toured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, list): every arc with the head of its run and its place there; the runs as a doubly linked list with lengths.

    Within a range of depths the enter arcs of one conversation follow each other, and so do its exit arcs, from the deepest
    up, as long as a node has that one child.
    """
    ranged = toured.withColumn("range", F.shiftright("depth", TURN_BITS))
    inner = Window.partitionBy("c", "range")
    upwards = inner.orderBy(F.col("depth").desc())
    ranged = ranged.withColumn("breaks", F.sum(F.when((F.col("n_children") == 1) & (F.lag("depth").over(upwards) == F.col("depth") + 1), 0)
                                               .otherwise(1)).over(upwards.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("c", "range", "breaks")
    placed = settle(ranged.withColumns({
        "enter_head": F.min("depth").over(inner), "exit_head": F.max("depth").over(run), "enter_tail": F.max("depth").over(inner),
        "exit_tail": F.min("depth").over(run)}).drop("range", "breaks"))
    arcs = placed.select("c", "depth", F.explode(F.array(
        F.struct(arc("c", F.col("enter_head"), 0).alias("head"), (F.col("depth") - F.col("enter_head")).alias("offset"), F.lit(0).alias("x")),
        F.struct(arc("c", F.col("exit_head"), 1).alias("head"), (F.col("exit_head") - F.col("depth")).alias("offset"), F.lit(1).alias("x")))).alias("a"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    arcs = arcs.select("c", "depth", "a.head", "a.offset", "a.x", F.when(F.col("a.x") == 0, F.col("leaf")).otherwise(F.lit(0)).alias("leaf"),
                       F.when(F.col("a.x") == 0, F.col("saved")).otherwise(F.lit(0)).alias("saved"))
    # a predecessor is known by its arc, the list needs its run: the head of that run comes from the successor side
    ends = placed.select(F.explode(F.array(
        F.struct(arc("c", F.col("enter_head"), 0).alias("id"), F.col("depth").alias("at"), (F.col("depth") == F.col("enter_tail")).alias("tail"), F.col("enter_next").alias("next")),
        F.struct(arc("c", F.col("exit_head"), 1).alias("id"), (-F.col("depth")).alias("at"), (F.col("depth") == F.col("exit_tail")).alias("tail"), F.col("exit_next").alias("next")))).alias("a")).select("a.*")
    heads = ends.groupBy("id").agg(F.count(F.lit(1)).alias("w"), F.max_by("next", "at").alias("next"))
    heads = fixed(heads)
    before = heads.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("prev"))
    return arcs, fixed(heads.join(before, "id", "left").select("id", "prev", "next", F.col("w").cast("long").alias("w")))


def ranked_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a list of a few thousand arcs by pointer doubling."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    number = {tuple(v.values()): i for i, v in enumerate(table.column("id").to_pylist())}
    prev = np.array([number[tuple(v.values())] if v is not None else -1 for v in table.column("prev").to_pylist()])
    weight = table.column("w").to_numpy()
    rank = np.where(prev >= 0, weight[prev], 0)
    while (prev >= 0).any():
        rank = rank + np.where(prev >= 0, rank[prev], 0)
        prev = np.where(prev >= 0, prev[prev], -1)
    yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(rank)], ["id", "rank"])


def list_ranks(arcs: DataFrame, finish: int = FINISH) -> DataFrame:
    """(id, rank) for a doubly linked list (id, prev, next, w): the weights before each element, by rounds of contraction."""
    rounds: list[DataFrame] = []
    while arcs.count() > finish:
        salt = F.lit(len(rounds))
        chance = lambda c: F.xxhash64(F.col(c), salt)
        out = (F.col("prev").isNotNull() & (chance("id") > chance("prev")) & (F.col("next").isNull() | (chance("id") > chance("next"))))
        marked = arcs.withColumn("out", out)
        gone = marked.where("out")
        none = F.lit(None)
        parts = [marked.where("NOT out").select("id", F.lit(0).alias("kind"), "prev", "next", "w"),
                 gone.select(F.col("prev").alias("id"), F.lit(1).alias("kind"), none.alias("prev"), "next", "w"),
                 gone.where("next IS NOT NULL").select(F.col("next").alias("id"), F.lit(2).alias("kind"), "prev", none.alias("next"), none.alias("w"))]
        told = parts[0].unionByName(parts[1]).unionByName(parts[2])
        of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        merged = told.groupBy("id").agg(of(0, "prev").alias("p0"), of(0, "next").alias("n0"), of(0, "w").alias("w0"), of(1, "next").alias("n1"),
                                        of(1, "w").alias("w1"), of(2, "prev").alias("p2"))
        merged = fixed(merged.select("id", F.coalesce("p2", "p0").alias("prev"), F.when(F.col("w1").isNotNull(), F.col("n1")).otherwise(F.col("n0")).alias("next"),
                                     (F.col("w0") + F.coalesce("w1", F.lit(0))).alias("w"),
                                     F.when(F.col("w1").isNotNull(), F.col("n0")).alias("taken"), F.col("w0").alias("gap")))
        rounds.append(merged)
        arcs = merged.select("id", "prev", "next", "w")
    kind = arcs.schema["id"].dataType.simpleString()
    ranks = settle(arcs.coalesce(1).mapInArrow(ranked_in_task, f"id {kind}, rank long"))
    for merged in reversed(rounds):
        both = merged.select("id", "taken", "gap").join(ranks, "id")
        pair = F.array(F.struct("id", "rank"), F.struct(F.col("taken").alias("id"), (F.col("rank") + F.col("gap")).alias("rank")))
        ranks = fixed(both.select(F.explode(pair).alias("r")).select("r.*").where("id IS NOT NULL"))
    return ranks


def trie(turns: DataFrame, finish: int = FINISH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, a null turn comes first, ties (and repeated rows) are turns of their own in the order
    of their hash, rows without conv_id are left out, and extra columns are ignored.  An empty table has no node, not even a
    root, since no conversation has a smallest number.
    """
    toured = tour(nodes(turns))
    arcs, heads = runs(toured)
    ranks = list_ranks(heads, finish)
    ranked = arcs.join(ranks.select(F.col("id").alias("head"), "rank"), "head").select(
        "c", "depth", "x", "leaf", "saved", (F.col("rank") + F.col("offset")).alias("rank"))
    # two levels of blocks: a window's rows are at most a block, and the totals of the last are one in a million arcs
    low = ranked.withColumns({"b1": F.shiftright("rank", 10), "b2": F.shiftright("rank", 20)})
    totals = low.groupBy("b2", "b1").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    sums = running(totals.withColumn("all", F.lit(0)), ["all"], "b2", [F.col("b1")], {"leaf_b": "leaf", "saved_b": "saved"})
    offsets = fixed(sums.select("b1", (F.col("leaf_b") - F.col("leaf")).alias("leaf_o"), (F.col("saved_b") - F.col("saved")).alias("saved_o")))
    inner = Window.partitionBy("b1").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = (low.withColumns({"leaf_i": F.sum("leaf").over(inner), "saved_i": F.sum("saved").over(inner)}).join(offsets, "b1")
              .select("c", "depth", "x", (F.col("leaf_i") + F.col("leaf_o") - F.col("leaf")).alias("leaf_at"),
                      (F.col("saved_i") + F.col("saved_o") - F.col("saved")).alias("saved_at")))
    # exit arcs weigh nothing: the sum before the exit less the sum before the entry is the subtree's
    at = lambda c, x: F.max(F.when(F.col("x") == x, F.col(c)))
    subtree = summed.groupBy("c", "depth").agg((at("leaf_at", 1) - at("leaf_at", 0)).alias("n_leaves"), (at("saved_at", 1) - at("saved_at", 0)).alias("saved_tokens"))
    return toured.join(subtree, ["c", "depth"]).select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
