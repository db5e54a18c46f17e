"""Session defaults and the places where lineage is cut."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 16 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the session comes from ``spark-submit``."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("sparkcohort")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", memory)
             .config("spark.ui.enabled", "false")
             # call-site capture for every Column call; it only serves error messages
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="sparkcohort-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def settle(df: DataFrame) -> DataFrame:
    """Write a small intermediate result to the checkpoint folder so that every later use sees the same numbers."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_bytes(df: DataFrame) -> Column:
    """Aggregate of the bytes a frame holds: eight for a number, the text's own for anything else."""
    parts = [F.lit(8)] + [F.lit(8) if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) else
                          F.coalesce(F.octet_length(f"`{f.name}`" if isinstance(f.dataType, (T.StringType, T.BinaryType)) else
                                                    F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) for f in df.schema.fields]
    return F.sum(sum(parts[1:], parts[0]).cast("long"))


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A settled frame, with a broadcast hint only when its counted rows and bytes are few; larger ones join by shuffle."""
    fixed = settle(df)
    some = fixed.limit(max_rows + 1)
    rows, size = some.agg(F.count(F.lit(1)), measured_bytes(some)).first()
    return F.broadcast(fixed) if rows <= max_rows and (size or 0) <= max_bytes else fixed


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition few rows that expand to much work.  The number is explicit: adaptive coalescing goes by bytes and
    would put such rows back into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on group columns; the keys of the right side are dropped.

    Without group columns the right side is a single row, which is attached as a scalar subquery.
    """
    extra = [c for c in right.columns if c not in by]
    if not by:
        row = right.select(F.struct(*extra).alias("_one")).scalar()
        return left.select("*", row.alias("_one")).select(*left.columns, *[F.col(f"_one.{c}").alias(c) for c in extra])
    renamed = right.select(*[F.col(c).alias(f"_key_{c}") for c in by], *extra)
    condition = None
    nullable = [{f.name: f.nullable for f in side.schema.fields} for side in (left, right)]
    for c in by:
        # plain equality where one side is never null: fewer and simpler join keys
        both = all(side.get(c, True) for side in nullable)
        one = F.col(c).eqNullSafe(F.col(f"_key_{c}")) if both else F.col(c) == F.col(f"_key_{c}")
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"_key_{c}" for c in by])
