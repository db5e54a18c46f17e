"""Reading cohort tables with a declared schema and writing tidy results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITRE_COLUMNS = ("titre_0", "titre_21", "titre_42", "titre_120", "titre_180")
COMORBIDITIES = ("diabetes", "copd", "severe_obesity", "heart_failure", "hypertension", "kidney", "immunodef")
_DATES = ("birth_date", "swab_date", "death_date", "dose1_date", "dose2_date", "sample_0_date", "sample_21_date",
          "sample_42_date")
_TEXTS = ("home", "sex", "vaccine", "prior_covid", "diagnosis_type", "covid_in_study", "death", "end_reason")

# One row per participant.
COHORT_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("age", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in _TEXTS]
    + [T.StructField(c, T.TimestampType()) for c in _DATES]
    + [T.StructField(c, T.StringType()) for c in TITRE_COLUMNS + COMORBIDITIES])

# Second assay, one row per participant.
ASSAY_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("neu_post_d1", "neu_post_d2", "neu_post_120", "neu_post_180")]
    + [T.StructField("checked", T.StringType())])


def read_table(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None,
               key: str | Sequence[str] | None = None, **options) -> DataFrame:
    """One exported table.  Text formats need a schema (nothing is inferred); rows with a NULL key are dropped at the scan."""
    if schema is None and format in ("csv", "json"):
        raise ValueError(f"{format} needs a schema")
    if format == "csv":
        options.setdefault("header", True)
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df if key is None else drop_null_keys(df, key)


def drop_null_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    for c in [key] if isinstance(key, str) else key:
        df = df.where(F.col(c).isNotNull())
    return df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns given as old -> new; odd names (spaces, dots, accents) are fine."""
    return df.withColumnsRenamed(dict(names))


def conform(df: DataFrame, schema: T.StructType, timestamp_format: str | None = None) -> DataFrame:
    """Cast to a declared schema by name, in its order.

    Values that do not parse become NULL, columns missing from the input become NULL columns.
    """
    return df.select(*_casts(df, schema, timestamp_format))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _casts(df: DataFrame, schema: T.StructType, timestamp_format: str | None) -> list[Column]:
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        source = quoted(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.DateType)) and dict(df.dtypes)[field.name] == "string":
            parsed = (F.try_to_timestamp(source, F.lit(timestamp_format)) if timestamp_format
                      else F.try_to_timestamp(source))
            out.append(parsed.cast(field.dataType).alias(field.name))
        else:
            out.append(source.try_cast(field.dataType).alias(field.name))
    return out


def conform_observed(df: DataFrame, schema: T.StructType, key: str | Sequence[str] = (), timestamp_format: str | None = None,
                     name: str = "conform") -> tuple[DataFrame, Observation]:
    """``conform``, rows with a NULL key dropped, and what was lost: counted in the pass that reads, not in one of its own.

    After an action on the frame, ``observation.get`` holds ``rows`` (read), ``dropped`` (NULL key after the cast) and
    ``failed_<column>`` (present values that became NULL) for every column of the schema that the input has.  The action has to
    read the frame once, as writing or an aggregation does: a global sort samples its input first and counts it twice.
    """
    keys = [key] if isinstance(key, str) else list(key)
    shared = [f.name for f in schema.fields if f.name in df.columns]
    lost = df.select(*_casts(df, schema, timestamp_format), *[quoted(c).isNotNull().alias(f"_had{i}") for i, c in enumerate(shared)])
    missing = F.lit(False)
    for c in keys:
        missing = missing | quoted(c).isNull()
    seen = Observation(name)
    counted = lost.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("dropped"), *[
        F.count_if(F.col(f"_had{i}") & quoted(c).isNull()).alias(f"failed_{c}") for i, c in enumerate(shared)])
    kept = drop_null_keys(counted, keys).select(*[quoted(f.name) for f in schema.fields])
    return kept, seen


def conform_positions(df: DataFrame, types: Mapping[int, T.DataType], **kw) -> DataFrame:
    """Force the types of columns given by 0-based position and leave the others as they are."""
    fields = [T.StructField(f.name, types.get(i, f.dataType)) for i, f in enumerate(df.schema.fields)]
    return conform(df, T.StructType(fields), **kw)


def write_result(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Write a tidy result frame."""
    if format == "csv":
        options.setdefault("header", True)
    df.write.format(format).mode(mode).options(**options).save(path)


def publish(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write into a partitioned Parquet result so that it can be run again: partitions of ``df`` replace their older versions,
    all others stay.

    Rows are gathered by their partition first, so that a task writes few files; a hot partition is split by adaptive execution.
    A failed run leaves the older version: partitions are swapped when the job commits.
    """
    (df.hint("rebalance", *[quoted(c) for c in partition_by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def store_bucketed(df: DataFrame, name: str, key: str | Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Store a frame once, bucketed and sorted by ``key``, and give back the stored table.

    Whatever groups by the key and any further columns (complete cases, the values of a participant in one row) reads its bucket
    and shuffles nothing; so do joins of two frames stored alike on the key alone.  Bucketing by participant rather than by stratum
    and participant keeps a stratum that holds most rows spread over all buckets.  Rows are dealt to their buckets before
    writing, so that a bucket is one file.  A table of the name must not exist.  ``path`` makes an external table there.
    """
    keys = [key] if isinstance(key, str) else list(key)
    writer = df.repartition(buckets, *[quoted(k) for k in keys]).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).mode("errorifexists").saveAsTable(name)
    return df.sparkSession.table(name)
