"""Exact duplicates by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Texts are equal when identical after every run of white space became one space; null counts as empty.  Lengths, prefix
hashes and groups are found by aggregations that combine before they shuffle, so a group that holds a third of all rows is
a few rows by then; the joins that carry a group's result back to its rows are plain equi-joins, which adaptive execution
splits where a key is hot.  Nothing runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcohort.llm.common import SPACES, join_checked, numbered, q, text_of
from sparkcohort.session import settle

PREFIX = 128
MOST_BROADCAST = 50_000
SALTS = 16


def normalised(text: str) -> Column:
    return F.regexp_replace(text_of(text), SPACES, " ")


def suspect_prefixes(light: DataFrame) -> DataFrame:
    """(__len, __prefix) pairs that at least two rows share; ``light`` has these two columns.

    Prefix hashes are grouped only for lengths that occur twice.  The lengths are broadcast when counted to be few; beyond
    that the same join runs by shuffle over salted lengths, since one length may be that of a third of the rows.
    """
    lengths = settle(light.groupBy("__len").count().where("count > 1").select("__len"))
    if lengths.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        live = light.join(F.broadcast(lengths), "__len", "left_semi")
    else:
        salted = lengths.select("__len", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__salt"))
        live = light.withColumn("__salt", F.pmod("__prefix", F.lit(SALTS).cast("long"))).join(salted, ["__len", "__salt"], "left_semi")
    return live.groupBy("__len", "__prefix").count().where("count > 1").select("__len", "__prefix")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per input row: id, ``keep_id`` (smallest id of the equal texts), ``group_size``, ``kept``, ``text_sha256``.

    The hash of the whole text is wanted for every row here, so one scan makes the three fingerprints and the texts are
    not read again; grouping by the full hash still covers the suspects only.  Repeated rows (same id, same text) count in
    ``group_size`` and are all marked kept when theirs is the smallest id.  A null id never stays while its group has
    another; a group of null ids alone has keep_id null and is kept.  Extra columns are ignored.  An empty table gives an
    empty result.
    """
    norm = docs.select(q(id).alias("__id"), normalised(text).alias("__norm"))
    rows = settle(norm.select("__id", F.octet_length("__norm").alias("__len"),
                              F.xxhash64(F.substring("__norm", 1, prefix)).alias("__prefix"), F.sha2("__norm", 256).alias("__sha")))
    suspects = suspect_prefixes(rows.select("__len", "__prefix"))
    groups = (join_checked(rows, suspects, ["__len", "__prefix"], "left_semi")
              .groupBy("__sha").agg(F.min("__id").alias("__keep"), F.count("*").alias("__size")).where("__size > 1"))
    result = rows.select("__id", "__sha").join(groups, "__sha", "left")
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return result.select(F.col("__id").alias(id), keep.alias("keep_id"), F.coalesce("__size", F.lit(1)).alias("group_size"),
                         F.col("__id").eqNullSafe(keep).alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = PREFIX) -> DataFrame:
    """The input's columns, one row for each distinct text (the one with the smallest id).

    Only rows whose length and prefix hash occur twice are hashed as a whole and moved; the others pass straight through.
    Of repeated rows (same id, equal text) the one with the smallest text hash stays.
    """
    plain = numbered(docs)
    own_id, own_text = f"c{docs.columns.index(id)}", f"c{docs.columns.index(text)}"
    norm = plain.withColumn("__norm", normalised(own_text))
    rows = norm.withColumns({"__len": F.octet_length("__norm"), "__prefix": F.xxhash64(F.substring("__norm", 1, prefix))})
    suspects = suspect_prefixes(rows.select("__len", "__prefix")).withColumn("__suspect", F.lit(True))
    rows = join_checked(rows, suspects, ["__len", "__prefix"], "left")
    single = rows.where("__suspect IS NULL").select(*plain.columns)
    first = (rows.where("__suspect").groupBy(F.sha2("__norm", 256).alias("__sha"))
             .agg(F.min_by(F.struct(*plain.columns), F.struct(F.col(own_id).isNull(), F.col(own_id), F.xxhash64(text_of(own_text)))).alias("__row")))
    return single.unionByName(first.select("__row.*")).toDF(*docs.columns)
