"""One query per operator over the star-schema tables.

The cohort stand-in: a participant is an event user; the five event types are the five time points; the last event of a
type gives the titre text of that time point (tiny values are reports that cannot be parsed, so participants can be
incomplete); the first event of a type gives the second assay; the customer with the same key gives the group columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkcohort.functions.derive import (age_band, bucketize, exposed_declared_or_baseline, exposed_either, floor_zero_to_one,
                                          fractional_days, round_half_even, sentence_case, site_from_id, trunc_number,
                                          whole_days, whole_years)
from sparkcohort.functions.nulls import if_else_null, paste
from sparkcohort.operators import (chartframes, contingency, corr, describe, levels, ranks, ranktests, regress, resample,
                                   reshape, tableone)
from sparkcohort.plans import study
from sparkcohort.session import ensure_checkpoint_dir, join_groups
from sparkcohort.sources import tables

# Fixed values of the stand-in.
TYPES = {"signup": "titre_0", "view": "titre_21", "click": "titre_42", "purchase": "titre_120", "error": "titre_180"}
ASSAY_TYPES = {"view": "neu_post_d1", "click": "neu_post_d2", "purchase": "neu_post_120", "error": "neu_post_180"}
SEGMENTS = ("BUILDING", "AUTOMOBILE", "FURNITURE")
MOMENTS = list(study.MOMENTS.values())
FLAGS = ("A", "N", "R")
REPLICATES = 10_000      # of means; Deming lines use 100 on a grid of 80 points
DRAWN_ROWS = 10_000      # replicates of the queries that draw for every single row, as their SQL does

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (and turn -0 into 0) so that results can be compared across engines."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


# --- cohort stand-in --------------------------------------------------------------------------------------------------

def raw_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event user: titre texts and the group columns of the customer with the same key."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy(F.col("user_id").alias("id")).agg(*[
        F.max_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id")))
        .alias(name) for t, name in TYPES.items()])
    report = lambda v: (F.when(v < 5, "pending").when(v < 15, "NR").when(
        v >= 15, F.concat(F.lit("1/"), (F.floor(v / 10) * 10).cast("string"))))
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("vaccine"),
        F.when(F.col("c_acctbal") < 500, "Si").when(F.col("c_acctbal") < 9000, "No").alias("prior_covid"),
        F.when(F.col("c_nationkey") < 12, "Femenino").otherwise("Masculino").alias("sex"),
        (F.lit(50.0) + F.floor(F.abs("c_acctbal") / 200)).alias("age"))
    return last.select("id", *[report(F.col(c)).alias(c) for c in TYPES.values()]).join(people, "id", "left")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.derive(raw_participants(spark, sf_dir))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.complete_cohort(cohort(spark, sf_dir), SEGMENTS)


GROUPS = ["id", "vaccine", "exposed", "prior_covid", "sex", "age_group"]


def complete_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.titre_long(complete(spark, sf_dir), GROUPS)


def available_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.titre_long(study.available_cohort(cohort(spark, sf_dir), SEGMENTS), [*GROUPS, "age"])


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("id")).agg(*[
        (F.min_by(F.when(F.col("event_type") == t, F.col("value")), F.when(F.col("event_type") == t, F.col("event_id")))
         / 4.0).alias(name) for t, name in ASSAY_TYPES.items()])


def both_assays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.two_assays(available_long(spark, sf_dir), study.assay_long(assay(spark, sf_dir)))


def known_vaccine(df: DataFrame) -> DataFrame:
    return df.where(F.col("vaccine").isNotNull())


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, which only some of them have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return reshape.join_assay(docs, table(spark, sf_dir, "labels"), ["doc_id"])


def text_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return reshape.across(df, columns, lambda c: c.cast("string"))


# --- scans, columns, scalars --------------------------------------------------------------------------------------------

def titre_parse_long(spark, d):
    return study.titre_long(cohort(spark, d), ["id"]).select("id", "moment", "ord", "titre", "titre_qual")


def typed_read(spark, d):
    """Text columns forced to declared types by name, then rows without a key dropped."""
    text = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_orderdate").cast("string").alias("o_orderdate"),
        F.col("o_orderpriority").alias("o_rank"), F.col("o_totalprice").cast("string").alias("o_totalprice"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampType()),
                           T.StructField("o_rank", T.IntegerType()), T.StructField("o_totalprice", T.DoubleType())])
    typed = tables.drop_null_keys(tables.conform(text, schema), "o_orderkey")
    return typed.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_rank", "o_totalprice")


def selected_columns(spark, d):
    """Columns by prefix and by position, some dropped and renamed, rows in order."""
    rows = table(spark, d, "lineitem")
    chosen = [*reshape.columns_at(rows, 1, 2), *reshape.columns_with_prefix(rows, "l_ship"), "l_linenumber", "l_tax"]
    return tables.rename(rows.select(*chosen).drop("l_tax"), {"l_shipdate": "shipped"}).orderBy("l_orderkey", "l_linenumber", "l_partkey")


def typed_positions(spark, d):
    """Types forced by position, the other columns left alone."""
    text = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderpriority")
    return tables.conform_positions(text, {1: T.LongType(), 2: T.IntegerType()})


def large_row_index(spark, d):
    """Positions in the order of ids beyond the exact range of doubles."""
    rows = table(spark, d, "orders").select((F.col("o_orderkey") + F.lit(2**60)).alias("id"))
    return ranks.row_index(rows, "id")


def drop_with_missing_key(spark, d):
    """A missing key comes first and is dropped by its position."""
    rows = table(spark, d, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("key"), "n_name")
    return reshape.drop_positions(rows, ["key"], [1, 4])


def scalar_functions(spark, d):
    """Text, date and numeric expressions on orders."""
    o = table(spark, d, "orders")
    day0 = F.lit("1995-01-01 06:00:00").cast("timestamp")
    return rounded(o.select(
        "o_orderkey", sentence_case(F.col("o_orderpriority")).alias("priority"),
        site_from_id(F.col("o_orderpriority"), "^1", "first", "other").alias("site"),
        whole_days(day0, F.col("o_orderdate")).alias("days"),
        whole_years(day0, F.col("o_orderdate")).alias("years"),
        fractional_days(day0, F.col("o_orderdate")).alias("exact_days"),
        round_half_even(F.col("o_orderkey") / 8.0, 2).alias("even_rounded"),
        trunc_number(F.col("o_totalprice") - 250000).alias("truncated"),
        bucketize(F.col("o_totalprice"), [100000.0, 300000.0], ["low", "middle", "high"]).alias("band"),
        paste(F.col("o_orderstatus"), " / ", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))).alias("label")), 4)


def exposure_rules(spark, d):
    c = study.available_cohort(cohort(spark, d), SEGMENTS, 0.0)
    return c.select("id", "exposed",
                    exposed_declared_or_baseline(F.col("prior_covid"), F.col("baseline")).alias("corrected"),
                    exposed_either(F.col("prior_covid"), F.col("exposed")).alias("either"))


def kleene_strata(spark, d):
    """Rows kept by the three exposure filters, which are not complementary when a definition is missing."""
    c = study.available_cohort(cohort(spark, d), SEGMENTS, 0.0)
    rules = {"naive": study.is_naive(), "not_naive": study.is_not_naive(), "exposed": study.is_exposed()}
    counted = c.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return reshape.to_long(counted, [], list(rules), "filter", "n")


def recode_fill(spark, d):
    """Missing labels as their own level, languages restricted to an ordered list."""
    docs = levels.apply_levels(scored_documents(spark, d), "lang", ["fr", "en", "de"], "lang_ord")
    return docs.select("doc_id", "lang", "lang_ord",
                       F.coalesce(study.recode(F.col("quality"), {0: "poor", 1: "good"}), F.lit("No data")).alias("quality"))


def age_band_counts(spark, d):
    o = table(spark, d, "orders")
    years = whole_years(F.col("o_orderdate") - F.expr("INTERVAL 30000 DAYS"), F.col("o_orderdate")
                        + F.expr("make_interval(0, 0, 0, CAST(o_custkey % 900 AS INT))"))
    return describe.group_counts(o.withColumn("age_group", age_band(years, 83)), ["age_group"])


# --- completeness and joins -----------------------------------------------------------------------------------------------

def complete_cases(spark, d):
    return complete_long(spark, d).select("id", "moment", "titre")


def incomplete_participants(spark, d):
    return reshape.incomplete_ids(study.titre_long(cohort(spark, d), ["id"]), "id", "titre")


def complete_cases_long(spark, d):
    long = study.titre_long(cohort(spark, d), ["id"])
    return reshape.complete_cases_long(long, "id", "titre").select("id", "moment", "titre")


def left_join_two_assays(spark, d):
    return rounded(both_assays(spark, d).select("id", "moment", "titre", "titre2"))


def two_assay_counts(spark, d):
    return describe.count_present(both_assays(spark, d), ["moment"], ["titre", "titre2"])


def duplicate_keys(spark, d):
    return reshape.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def drop_by_position(spark, d):
    return reshape.drop_positions(table(spark, d, "nation"), ["n_nationkey"], [2, 3, 5, 7, 24]).select(
        "n_nationkey", "n_name")


def counts_wide(spark, d):
    return reshape.counts_wide(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def paired_values(spark, d):
    pairs = [(MOMENTS[i], MOMENTS[j]) for i, j in levels.level_pairs(MOMENTS)]
    return reshape.level_pairs_frame(study.titre_long(cohort(spark, d), ["id"]), ["id"], "moment", "titre", pairs)


# --- summaries --------------------------------------------------------------------------------------------------------------

def median_by_group_time(spark, d):
    return rounded(study.medians_by_moment(known_vaccine(complete_long(spark, d)), ["vaccine"]))


def quartiles_iqr(spark, d):
    return rounded(ranks.quartiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", iqr="iqr",
                                   method="two_pass"))


def group_counts_labels(spark, d):
    return describe.count_labels(known_vaccine(complete(spark, d)), "vaccine", "{label} (n = {n})",
                                 labels={"BUILDING": "Building"})


def assay_quartiles(spark, d):
    """Distribution control of the second assay by group and time point."""
    rows = study.assay_long(assay(spark, d)).join(cohort(spark, d).select("id", "sex"), "id", "left")
    return rounded(ranks.quartiles(rows, ["sex", "moment"], "titre2"))


def geomean_by_group(spark, d):
    rows = study.naive(known_vaccine(available_long(spark, d)))
    floored = rows.withColumn("titre", floor_zero_to_one(F.col("titre")))
    return rounded(describe.geometric_mean(floored, ["moment", "vaccine"], "titre"))


def log_mean_control(spark, d):
    rows = both_assays(spark, d).where(F.col("titre2").isNotNull())
    floored = rows.withColumn("titre", floor_zero_to_one(F.col("titre")))
    return rounded(describe.log_mean(floored, ["moment"], "titre"))


def moments_by_group(spark, d):
    return rounded(describe.moments(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", "l_discount"))


def oneway_freq(spark, d):
    return rounded(describe.oneway_frequency(scored_documents(spark, d), "quality"))


def crosstab_colpct(spark, d):
    return rounded(describe.crosstab(scored_documents(spark, d), "quality", "lang"))


def crosstab_wide(spark, d):
    return describe.crosstab_wide(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def missing_pareto(spark, d):
    rows = reshape.join_assay(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])
    return rounded(describe.missing_pareto(rows))


def numeric_profile(spark, d):
    return rounded(describe.numeric_profile(table(spark, d, "lineitem")), 4)


def numeric_profile_by_group(spark, d):
    rows = scored_documents(spark, d)
    return rounded(describe.numeric_profile(rows, [c for c in reshape.numeric_columns(rows) if c != "doc_id"], ["lang"]), 4)


def dose_interval_summary(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").join(
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    return rounded(study.interval_summary(rows, "o_orderpriority", "o_orderdate", "l_shipdate", "days"))


def table_one(spark, d):
    rows = text_columns(scored_documents(spark, d), ["quality", "toxic"])
    return rounded(tableone.baseline_table(rows, "lang", ["quality", "toxic", "source"], ["n_chars"], percent_digits=1,
                                           number_digits=1))


def table_one_overall(spark, d):
    """The same table with a column over all languages, from one expanded scan."""
    rows = text_columns(scored_documents(spark, d), ["quality", "toxic"])
    return rounded(tableone.baseline_table(rows, "lang", ["quality", "toxic", "source"], ["n_chars"], percent_digits=1,
                                           number_digits=1, overall=True))


def table_one_tests(spark, d):
    rows = text_columns(scored_documents(spark, d), ["quality", "toxic"])
    return rounded(tableone.baseline_tests(rows, "lang", ["quality", "source"], method="simulated"))


def table_one_rank_tests(spark, d):
    """Continuous variables of all lines against their return flags: the k-sample rank test beside the categorical one."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(tableone.baseline_tests(rows, "l_returnflag", ["l_linestatus"], continuous=["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def ksample_by_priority(spark, d):
    """Order totals of the three statuses, within every priority."""
    return rounded(ranktests.k_sample(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice"))


def published_result(spark, d):
    """A result published by partition, published again in part with other numbers, and read back."""
    lines = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    path = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    tables.publish(lines, path, ["l_returnflag", "year"])
    tables.publish(lines.where("l_returnflag = 'A'").withColumn("n", -F.col("n")), path, ["l_returnflag", "year"])
    return tables.read_table(spark, path).select("l_returnflag", "l_linestatus", F.col("year").cast("int"), "n", "quantity")


def conform_losses(spark, d):
    """What typed reading loses, counted while it reads: casts that fail and keys that are missing."""
    text = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey").cast("string")).otherwise("none").alias("o_orderkey"),
        F.col("o_orderpriority").alias("o_rank"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_rank", T.IntegerType()), T.StructField("o_totalprice", T.DoubleType())])
    typed, seen = tables.conform_observed(text, schema, "o_orderkey")
    totals = typed.agg(F.count(F.lit(1)).alias("kept"), F.count("o_totalprice").alias("prices")).first()
    row = {**seen.get, **totals.asDict()}
    return spark.createDataFrame([tuple(int(row[c]) for c in sorted(row))], ", ".join(f"{c} long" for c in sorted(row)))


def characteristics_table(spark, d):
    """The study's characteristics table on the stand-in cohort."""
    c = study.available_cohort(cohort(spark, d), SEGMENTS)
    return rounded(study.characteristics(c, {s: s for s in SEGMENTS}).select(
        "variable", "level", "vaccine", "n", "percent", "n_present"))


def characteristics_missing(spark, d):
    """The same table with rows for missing values."""
    c = study.available_cohort(cohort(spark, d), SEGMENTS)
    return rounded(study.characteristics(c, {s: s for s in SEGMENTS}, missing=True).select(
        "variable", "level", "vaccine", "kind", "n", "n_present"))


def nan_summaries(spark, d):
    """NaN counts as missing in every summary."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(
        F.col("l_linenumber") != 2, F.col("l_extendedprice")).alias("price"))
    profile = describe.numeric_profile(rows, by=["l_returnflag"])
    means = join_groups(describe.geometric_mean(rows, ["l_returnflag"], "price"), describe.range_and_mean(rows, ["l_returnflag"], ["price"]),
                        ["l_returnflag"])
    return rounded(join_groups(profile, means, ["l_returnflag"]), 4)


# --- tests --------------------------------------------------------------------------------------------------------------------

def ranksum_by_stratum(spark, d):
    tests = ranktests.rank_sum(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", ["F", "O"],
                               exact=False)
    return rounded(ranktests.add_significance(tests, "p"))


def ranksum_pairwise_holm(spark, d):
    return rounded(ranktests.pairwise_rank_sum(table(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag",
                                               "l_extendedprice", FLAGS, exact=False))


def ranksum_vaccine_by_moment(spark, d):
    """Groups compared at every time point within exposure strata (flagship)."""
    rows = known_vaccine(complete_long(spark, d))
    return rounded(study.between_groups_by_moment(rows, ["exposed"], "vaccine", SEGMENTS, exact=False))


def ranksum_second_assay(spark, d):
    """Continuous second assay between the sexes, exact where the groups are small and untied."""
    rows = study.assay_long(assay(spark, d)).join(cohort(spark, d).select("id", "sex"), "id").where(
        F.col("titre2").isNotNull())
    return rounded(ranktests.rank_sum(rows, ["moment"], "sex", "titre2", ["Femenino", "Masculino"]))


def signedrank_pairwise_holm(spark, d):
    rows = known_vaccine(complete_long(spark, d))
    return rounded(study.within_group_over_time(rows, ["vaccine"], MOMENTS, exact=False))


def stored(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """A long frame stored by participant."""
    name = f"long_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.store_bucketed(frame, name, "id", buckets, f"{ensure_checkpoint_dir(spark)}/{name}")


def signedrank_stored(spark, d):
    """The same tests on a stored frame: the values of a participant come together in its bucket, without a shuffle."""
    rows = stored(spark, known_vaccine(complete_long(spark, d)))
    return rounded(study.within_group_over_time(rows, ["vaccine"], MOMENTS, exact=False))


def complete_cases_stored(spark, d):
    """Complete cases of a stored frame, both sides of the anti-join from the same buckets."""
    rows = stored(spark, study.titre_long(cohort(spark, d), ["id"]))
    return reshape.complete_cases_long(rows, "id", "titre").select("id", "moment", "titre")


def signedrank_display(spark, d):
    rows = known_vaccine(complete_long(spark, d))
    tests = study.within_group_over_time(rows, ["vaccine"], MOMENTS, exact=False)
    return rounded(study.displayed_comparisons(tests, ["vaccine"]).select(
        "vaccine", "id", "position", "group1", "group2", "p_adj"))


def signedrank_two_level(spark, d):
    rows = study.assay_long(assay(spark, d))
    return rounded(ranktests.signed_rank(rows, [], "id", "moment", "titre2", ["after_dose1", "after_dose2"], exact=False))


def union_placeholder(spark, d):
    rows = known_vaccine(complete_long(spark, d)).where(F.col("exposed") == "NO")
    tests = study.between_groups_by_moment(rows, [], "vaccine", SEGMENTS, flat_moment="baseline", exact=False)
    return rounded(tests.select("moment", "group1", "group2", "n1", "n2", "statistic", "p_adj", "p_adj_signif"))


def narrow_quartiles(spark, d):
    """Quartiles of values that differ little for their size: microseconds of dates."""
    rows = table(spark, d, "orders").select("o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return rounded(ranks.quartiles(rows, ["o_orderstatus"], "at"), 0)


def narrow_ranksum(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return rounded(ranktests.rank_sum(rows, ["o_orderpriority"], "o_orderstatus", "at", ["F", "O"], exact=False))


def _suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        "s_nationkey", "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "even").otherwise("odd").alias("side"), "s_acctbal",
        (F.col("s_suppkey") * 377 % 1009 * 7.25).alias("other"))


def exact_ranksum(spark, d):
    """Exact p-values of small samples: supplier balances within nations."""
    return rounded(ranktests.rank_sum(_suppliers(spark, d), ["s_nationkey"], "side", "s_acctbal", ["even", "odd"]).select(
        "s_nationkey", "n1", "n2", "statistic", "p"))


def exact_signedrank(spark, d):
    tests = ranktests.signed_rank_wide(_suppliers(spark, d), ["s_nationkey"], {"balance": "s_acctbal", "other": "other"})
    return rounded(tests.select("s_nationkey", "n1", "statistic", "p"))


def tied_ranksum(spark, d):
    """Exact p-values of tied samples: discounts of filled against open lines, within every order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_discount")
    return rounded(ranktests.rank_sum(rows, ["l_orderkey"], "l_linestatus", "l_discount", ["F", "O"], exact="tied").select(
        "l_orderkey", "n1", "n2", "statistic", "p"), 12)


def tied_signedrank(spark, d):
    """Exact p-values with ties and zeros: discount against tax of the lines of every order, in whole percent."""
    wide = table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"))
    tests = ranktests.signed_rank_wide(wide, ["l_orderkey"], {"discount": "discount", "tax": "tax"}, exact="tied")
    return rounded(tests.select("l_orderkey", "n1", "statistic", "p"), 12)


def spearman_by_group(spark, d):
    return rounded(corr.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


def spearman_exact(spark, d):
    """Quantity against price of the lines of every order: p-values of all permutations where nothing is tied."""
    return rounded(corr.spearman(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_extendedprice", exact_below=10))


def spearman_text(spark, d):
    return study.assay_agreement(both_assays(spark, d)).select("moment", "n", "text")


def age_correlation(spark, d):
    return study.age_correlation(known_vaccine(both_assays(spark, d)), "titre").select("vaccine", "n", "text")


def chisq_status_priority(spark, d):
    return rounded(contingency.chi_square(table(spark, d, "orders"), [], "o_orderstatus", "o_orderpriority"))


def chisq_two_by_two(spark, d):
    rows = table(spark, d, "lineitem").withColumn("late", F.when(F.col("l_tax") > 0.04, "yes").otherwise("no"))
    return rounded(contingency.chi_square(rows, ["l_returnflag"], "l_linestatus", "late"))


def fisher_by_language(spark, d):
    counts = contingency.cell_counts(scored_documents(spark, d), ["lang"], "toxic", "quality")
    return rounded(contingency.fisher_exact_counts(counts, ["lang"], "toxic", "quality"))


def _classes_by_source(spark, d) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return scored_documents(spark, d).withColumn("class", kind)


def fisher_three_rows(spark, d):
    """Exact p-values of sparse tables with three rows, one per source."""
    counts = contingency.cell_counts(_classes_by_source(spark, d), ["source"], "class", "lang")
    return rounded(contingency.fisher_exact_counts(counts, ["source"], "class", "lang"))


# --- regression and resampling -------------------------------------------------------------------------------------------------

def _log_lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_returnflag", "l_shipdate", "l_quantity", F.log10("l_quantity").alias("lx"),
        F.log10("l_extendedprice").alias("ly"), F.ln("l_extendedprice").alias("log_price"))


def deming_by_group(spark, d):
    return rounded(regress.deming(_log_lines(spark, d), ["l_returnflag"], "lx", "ly"))


def deming_fixed_ratio(spark, d):
    return rounded(regress.deming(_log_lines(spark, d), ["l_returnflag"], "lx", "ly", noise_ratio=1.0))


def _log_assays(spark, d) -> DataFrame:
    """Both assays on the log scale, zeros as one."""
    return both_assays(spark, d).select("id", "moment", F.log10(floor_zero_to_one(F.col("titre"))).alias("lx"),
                                        F.log10(floor_zero_to_one(F.col("titre2"))).alias("ly"))


def deming_replicates(spark, d):
    return rounded(regress.deming_replicates(_log_assays(spark, d), ["moment"], "lx", "ly", 100, key="id",
                                             method="poisson"), 5)


def deming_band(spark, d):
    return rounded(regress.deming_band(_log_assays(spark, d), ["moment"], "lx", "ly", points=80, replicates=100, key="id",
                                       method="poisson"), 5)


def bootstrap_geomean_exact(spark, d):
    rows = study.naive(known_vaccine(available_long(spark, d)))
    return rounded(study.geometric_mean_table(rows, ["vaccine"], replicates=REPLICATES, method="exact"), 5)


def bootstrap_geomean_poisson(spark, d):
    rows = table(spark, d, "events").withColumn("value", floor_zero_to_one(F.col("value")))
    return rounded(resample.bootstrap_geometric_mean(rows, ["event_type"], "value", DRAWN_ROWS, key="event_id",
                                                     method="poisson"), 5)


def bootstrap_geomean_compressed(spark, d):
    """Intervals of all time points and groups from draws per distinct titre; a draw of this kind has no SQL form."""
    rows = study.naive(known_vaccine(available_long(spark, d)))
    return rounded(study.geometric_mean_table(rows, ["vaccine"], replicates=REPLICATES), 5)


def bootstrap_mean_split(spark, d):
    """Exactly n draws per replicate from groups of mostly distinct values, split binomially; such draws have no SQL form."""
    return rounded(resample.bootstrap_mean(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", REPLICATES, method="split"), 5)


def bootstrap_geomean_split(spark, d):
    """The intervals of ``bootstrap_geomean_compressed`` with exactly n draws per replicate."""
    rows = study.naive(known_vaccine(available_long(spark, d)))
    return rounded(study.geometric_mean_table(rows, ["vaccine"], replicates=REPLICATES, method="split"), 5)


def ols_log_price(spark, d):
    return rounded(regress.ols(_log_lines(spark, d), [], "l_quantity", "log_price"), 4)


def ols_by_group(spark, d):
    return rounded(regress.ols(_log_lines(spark, d), ["l_returnflag"], "l_quantity", "log_price"), 4)


def age_regression(spark, d):
    return rounded(study.age_regression(known_vaccine(both_assays(spark, d))), 4)


def ols_several_predictors(spark, d):
    """Price per line on quantity, discount and tax, by return flag: the whole coefficient table of a model of three predictors."""
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", F.ln("l_extendedprice").alias("log_price"))
    return rounded(regress.ols_several(rows, ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"], "log_price"), 4)


def ols_several_diagnostics(spark, d):
    rows = table(spark, d, "orders").withColumns({"px": F.col("o_custkey").cast("double"), "late": F.dayofyear("o_orderdate").cast("double"),
                                                  "py": F.ln("o_totalprice")}).select("o_orderkey", "o_orderstatus", "px", "late", "py")
    out = regress.ols_several_diagnostics(rows, ["o_orderstatus"], ["px", "late"], "py")
    return rounded(out.select("o_orderkey", "o_orderstatus", "fitted", "residual", "leverage", "std_residual", "cooks_distance"), 4)


def ols_diagnostics(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("double").alias("x"),
                                            F.ln("o_totalprice").alias("y"))
    return rounded(regress.ols_diagnostics(rows, ["o_orderstatus"], "x", "y"), 4)


def ols_global_test(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("double").alias("x"),
                                            F.ln("o_totalprice").alias("y"))
    return rounded(regress.ols_global_test(rows, ["o_orderstatus"], "x", "y", "o_orderkey"), 4)


def normal_quantiles(spark, d):
    return rounded(regress.normal_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity"), 5)


# --- chart frames ----------------------------------------------------------------------------------------------------------------

def pseudolog_quartiles(spark, d):
    return rounded(chartframes.axis_quartiles(known_vaccine(complete_long(spark, d)), ["vaccine", "moment"], "titre"))


def density_by_group(spark, d):
    return rounded(chartframes.density(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "log10", points=128), 5)


def density_width_scaled(spark, d):
    return rounded(chartframes.density(table(spark, d, "events"), ["event_type"], "value", "pseudo_log", points=64,
                                       scale="width"), 5)


def trajectories(spark, d):
    return rounded(chartframes.trajectories(study.assay_long(assay(spark, d)), [], "id", "moment", "titre2",
                                            ["after_dose1", "after_dose2"]))


def scatter_band(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").cast("double").alias("x"),
                                            F.col("o_totalprice").alias("y"))
    band = chartframes.scatter_band(rows, ["o_orderstatus"], "x", "y", points=80, replicates=100, key="o_orderkey",
                                    method="poisson")
    # compared on the log axis: the bounds span many orders of magnitude
    return rounded(reshape.across(band, ["x", "y", "lower", "upper"], F.log10), 5)


def error_bars(spark, d):
    rows = table(spark, d, "orders")
    return rounded(chartframes.error_bars(rows, ["o_orderstatus"], "o_totalprice", replicates=10_000, key="o_orderkey",
                                          method="poisson"), 2)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    titre_parse_long, typed_read, scalar_functions, exposure_rules, kleene_strata, recode_fill, age_band_counts,
    complete_cases, incomplete_participants, complete_cases_long, left_join_two_assays, two_assay_counts, duplicate_keys,
    drop_by_position, drop_with_missing_key, large_row_index, selected_columns, typed_positions, counts_wide, paired_values,
    median_by_group_time, quartiles_iqr, group_counts_labels, assay_quartiles, geomean_by_group, log_mean_control,
    moments_by_group, oneway_freq, crosstab_colpct, crosstab_wide, missing_pareto, numeric_profile,
    numeric_profile_by_group, dose_interval_summary, table_one, table_one_overall, table_one_tests, table_one_rank_tests, ksample_by_priority, published_result, conform_losses, characteristics_table, characteristics_missing, nan_summaries,
    narrow_quartiles, narrow_ranksum, exact_ranksum, exact_signedrank, tied_ranksum, tied_signedrank, fisher_three_rows, age_regression,
    bootstrap_geomean_compressed, bootstrap_geomean_split, bootstrap_mean_split, ranksum_by_stratum, ranksum_pairwise_holm, ranksum_vaccine_by_moment, ranksum_second_assay, signedrank_pairwise_holm,
    signedrank_stored, complete_cases_stored, signedrank_display, signedrank_two_level, union_placeholder, spearman_by_group, spearman_exact, spearman_text, age_correlation,
    chisq_status_priority, chisq_two_by_two, fisher_by_language,
    deming_by_group, deming_fixed_ratio, deming_replicates, deming_band, bootstrap_geomean_exact,
    bootstrap_geomean_poisson, ols_log_price, ols_by_group, ols_several_predictors, ols_several_diagnostics, ols_diagnostics, ols_global_test, normal_quantiles,
    pseudolog_quartiles, density_by_group, density_width_scaled, trajectories, scatter_band, error_bars)}
