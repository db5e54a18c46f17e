"""Mixing sources to target weights by balanced sampling (cube method).

Targets come from one row per source.  A document is taken floor(r) times for sure, r being its source's target over its
size, and once more with the fractional probability that is left.  Which documents get the extra copy is settled by the
flight phase of the cube method: the probabilities of three documents at a time move along the one direction that changes
neither the expected number of words nor that of documents, until one of them is 0 or 1.  Flights run in chunks of a source
in parallel; the at most two undecided documents of every chunk meet in the next round.

A long document hardly moves in a flight with shorter ones, so it tends to be left over.  The last round of a source therefore
flies its longer documents only; what is left of them is drawn, and the words that a draw gives or takes move the probabilities
of the shorter ones, which come next in the same way.  What remains to be landed is the shortest document of the source.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkcohort.llm.common import numbered, q, text_of
from sparkcohort.session import broadcast_if_small, join_groups, settle

WEIGHTS = (5, 2, 1)   # by code point order of the sources, repeating
SHARE = 1.5           # of all words
MOST_TIMES = 2        # a source's target stops at so many times its size
CHUNK = 4096          # documents whose probabilities fly together
CLOSE = 1e-9


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``.  ``sizes`` has source and tokens (of a unit).

    What capped sources cannot take is reshared by weight.  With sources ordered by cap over weight, the capped ones are a
    prefix, so running sums give the common level at once.  The windows hold one row per source.
    """
    # the number of sources is that of an aggregation's groups: far below the number of documents
    named = sizes.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = named.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "spent": F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "rank": F.row_number().over(by_level), "all": F.sum("source_size").over(everything) * share})
    level = (F.col("all") - F.col("spent")) / F.col("open")
    fits = F.when(level <= F.col("cap") / F.col("w") * (1 + 1e-12), F.struct("rank", level.alias("level")))
    rows = rows.withColumn("level", F.min(fits).over(everything).getField("level"))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move probabilities until at most two are fractional (none with ``land``), keeping their totals by words and by rows."""
    if land:
        return landed(p, size, rng)
    p, size = p.tolist(), size.tolist()
    draws = iter(rng.random(3 * len(p) + 8).tolist())
    active: list[int] = []

    def move(ids: list[int], u: list[float]) -> None:
        up = min(((1 - p[i]) if v > 0 else -p[i]) / v for i, v in zip(ids, u) if v)
        down = min((p[i] if v > 0 else p[i] - 1) / v for i, v in zip(ids, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(ids, u):
            p[i] += step * v
            p[i] = 0.0 if p[i] < CLOSE else 1.0 if p[i] > 1 - CLOSE else p[i]

    for k in range(len(p)):
        if 0.0 < p[k] < 1.0:
            active.append(k)
        while len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = [b - c, c - a, a - b] if (a != b or b != c) else [1.0, -1.0, 0.0]
            move(active, u)
            active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array(p, np.float64)


def landed(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide every fractional document, from long to short, so that the words stay close to their expectation.

    The longer ones fly; each one left over is drawn, and the words it got too many or too few come from the shorter ones,
    in proportion to what these can give.  Where the shorter ones hold too few words for it, the choice that leaves less is made.
    """
    p = p.copy()
    turn = [i for i in np.argsort(-size, kind="stable") if 0.0 < p[i] < 1.0]
    open_, empty = [i for i in turn if size[i] > 0], [i for i in turn if size[i] <= 0]
    while open_:
        # the shorter half lands later; a document that it cannot make up for is drawn first, at the cost of all others
        half = len(open_) // 2
        able = sum(size[i] * min(p[i], 1 - p[i]) for i in open_[len(open_) - half:])
        body = open_[:1] if size[open_[0]] * max(p[open_[0]], 1 - p[open_[0]]) > able else open_[:len(open_) - half]
        rest = np.array(open_[len(body):], np.int64)
        if len(body) > 1:
            p[body] = fly(p[body], size[body], rng, False)
        for i in body:
            if not 0.0 < p[i] < 1.0:
                continue
            # what neither choice's correction can reach is the error; only where both are equal is the choice a draw
            short = max(0.0, size[i] * p[i] - float((1 - p[rest]) @ size[rest]))
            over = max(0.0, size[i] * (1 - p[i]) - float(p[rest] @ size[rest]))
            drawn = float(rng.random() < p[i]) if abs(short - over) <= CLOSE else float(short > over)
            words, p[i] = size[i] * (p[i] - drawn), drawn
            give = 1 - p[rest] if words > 0 else p[rest]
            total = float(give @ size[rest])
            if total > 0:
                p[rest] = np.clip(p[rest] + np.sign(words) * give * min(1.0, abs(words) / total), 0.0, 1.0)
        p[rest] = np.where(p[rest] < CLOSE, 0.0, np.where(p[rest] > 1 - CLOSE, 1.0, p[rest]))
        open_ = [i for i in rest if 0.0 < p[i] < 1.0]
    if empty:
        p[empty] = fly(p[empty], size[empty], rng, False)
        undecided = [i for i in empty if 0.0 < p[i] < 1.0]
        p[undecided] = (rng.random(len(undecided)) < p[undecided]).astype(float)
    return p


def flight(units: DataFrame, chunk: int, land: bool) -> DataFrame:
    """One round over the chunks (column ``chunk``) of each source."""

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        # a fixed order makes reruns agree; from long to short, so that short documents are left for the landing
        table = table.take(pa.array(np.lexsort((table.column("unit").to_numpy(), -table.column("tokens").to_numpy()))))
        unit = table.column("unit").to_numpy()
        rng = np.random.default_rng(int(np.bitwise_xor.reduce(unit)) & (2**63 - 1))
        p = fly(table.column("p").to_numpy(), table.column("tokens").to_numpy().astype(float), rng, land)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))

    return units.groupBy("source", "chunk").applyInArrow(one, units.schema)


def copies(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
           share: float = SHARE, most: int = MOST_TIMES, chunk: int = CHUNK) -> DataFrame:
    """How often the mix takes each unit: ``id``, ``source``, ``size``, ``rows``, ``source_size``, ``target``, ``times``.

    A unit is all rows with the same id, source and size, usually one; its rows are taken equally often, at most ``most``
    times.  Null texts have size 0; a null source is a source; units of a source of size 0 are never taken.
    """
    units = (docs.select(q(id).alias("id"), q(source).alias("source"),
                         F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"))
             .groupBy("id", "source", "size").agg(F.count("*").alias("rows")).withColumn("tokens", F.col("size") * F.col("rows")))
    units = settle(units)
    targets = broadcast_if_small(source_targets(units, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    part = F.col("rate") - F.floor("rate")
    fraction = F.when(part < CLOSE, 0.0).when(part > 1 - CLOSE, 1.0).otherwise(part)
    rows = join_groups(units, targets, ["source"]).withColumn("rate", rate).withColumns(
        {"base": F.floor("rate"), "p": fraction, "unit": F.xxhash64("id", "size")}).drop("rate")
    sure = [rows.where("p <= 0 OR p >= 1")]
    left = rows.where("p > 0 AND p < 1")
    while True:
        counts = left.groupBy("source").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
        counts = broadcast_if_small(counts)
        last = (counts.agg(F.max("chunks")).first()[0] or 1) <= 1
        dealt = join_groups(left, counts, ["source"]).withColumn("chunk", F.pmod("unit", F.col("chunks"))).drop("chunks")
        flown = settle(flight(dealt, chunk, last)).drop("chunk")
        sure.append(flown.where("p <= 0 OR p >= 1"))
        if last:
            break
        left = flown.where("p > 0 AND p < 1")
    done = sure[0]
    for part in sure[1:]:
        done = done.unionByName(part)
    return done.select("id", "source", "size", "rows", "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("times"))


def mixed_sizes(docs: DataFrame, id: str = "doc_id", **settings) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size``, ``target`` (its source's), ``taken`` words, repeats counted."""
    got = copies(docs, id=id, **settings)
    return got.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"),
                      F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("__row")).drop("__row")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The input's columns, each row as often as the mix takes it; extra columns of any name come along.

    Rows with a null text, or one without words, are never taken; a null source is a source, a null id an id.
    """
    got = copies(docs, id, text, source, **settings).where("times > 0").select(F.struct("id", "source", "size", "times").alias("got"))
    plain = numbered(docs)
    own_id, own_text, own_source = (F.col(f"c{docs.columns.index(c)}") for c in (id, text, source))
    size = F.regexp_count(F.coalesce(own_text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    same = own_id.eqNullSafe(F.col("got.id")) & own_source.eqNullSafe(F.col("got.source")) & (size == F.col("got.size"))
    taken = plain.join(got, same).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("got.times"))))
    return taken.select(*plain.columns).toDF(*docs.columns)
