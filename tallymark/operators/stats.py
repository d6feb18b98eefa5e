"""Statistics of measures: one pass each, partial sums before any exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.values import percent, rounded
from tallymark.operators.filters import active, topic


def n_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def yearly(df: DataFrame) -> DataFrame:
    return active(df).groupBy("year").agg(
        F.count("*").alias("total_measures"), F.countDistinct("county").alias("counties"), n_if(F.col("passed") == 1).alias("passed"),
        n_if(F.col("passed") == 0).alias("failed"), n_if(F.col("has_summary")).alias("with_summaries"), n_if(F.col("yes_votes").isNotNull()).alias("with_votes"),
        rounded(F.avg("percent_yes"), 1).alias("avg_percent_yes"),
    )


def overall(df: DataFrame) -> DataFrame:
    """One row over the active measures."""
    passed, failed = n_if(F.col("passed") == 1), n_if(F.col("passed") == 0)
    return active(df).agg(
        F.count("*").alias("total_measures"), n_if(F.col("has_summary")).alias("with_summaries"), n_if(F.col("yes_votes").isNotNull()).alias("with_votes"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), (F.max("year") - F.min("year")).alias("year_span"), passed.alias("passed"), failed.alias("failed"),
        (F.count("*") - passed - failed).alias("unknown"), F.countDistinct("data_source").alias("sources"), F.countDistinct("county").alias("counties"), F.countDistinct("topic_primary").alias("topics"),
    )


def status_line(df: DataFrame) -> DataFrame:
    """Totals and the range of years as text."""
    return overall(df).select("total_measures", "with_summaries", "with_votes", F.concat_ws("-", "year_min", "year_max").alias("year_range"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return active(df).where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_topics(df: DataFrame, k: int = 20) -> DataFrame:
    return active(df).select(topic().alias("topic")).where("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(k)


def pass_rate(df: DataFrame) -> DataFrame:
    """Whole percent of decided measures that passed, halves to even; 0 without any."""
    p, f = n_if(F.col("passed") == 1), n_if(F.col("passed") == 0)
    return active(df).agg(F.when(p + f > 0, F.bround(p / (p + f) * 100, 0)).otherwise(0.0).cast("int").alias("pass_rate"))


def coverage_by_year(df: DataFrame, since: int = 2020) -> DataFrame:
    got = active(df).where(F.col("year") >= since).groupBy("year").agg(F.count("*").alias("total"), n_if(F.col("has_summary")).alias("with_summary"))
    return got.withColumn("coverage", percent(F.col("with_summary"), F.col("total"), 1))


#: Kinds of measures by the beginning of their measure_id, which one character more follows.
KINDS = {"ACA": "Constitutional Amendment (ACA)", "SCA": "Constitutional Amendment (SCA)", "PROP": "Proposition", "MEASURE": "Local Measure"}


def kind() -> Column:
    """What KINDS says of the measure_id, letters in either case; else Other."""
    out = F.lit("Other")
    for lead, name in reversed(KINDS.items()):
        out = F.when(F.col("measure_id").rlike(f"(?is)^{lead}."), name).otherwise(out)
    return out


def coverage_by_kind(df: DataFrame) -> DataFrame:
    got = active(df).groupBy(kind().alias("kind")).agg(F.count("*").alias("total"), n_if(F.col("has_summary")).alias("with_summary"))
    return got.withColumn("coverage", percent(F.col("with_summary"), F.col("total"), 1))


def profile(df: DataFrame) -> DataFrame:
    """What a parsed source holds: one row."""
    return df.agg(
        F.count("*").alias("total"), F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("topic_primary")).alias("topics"),
        n_if(F.col("title") != "").alias("has_title"), n_if(F.col("yes_votes").isNotNull()).alias("has_votes"), n_if(F.col("passed").isNotNull()).alias("has_outcome"),
        F.concat_ws("-", F.min("year"), F.max("year")).alias("year_range"),
    ).withColumns({"years": F.concat_ws(",", F.transform("years", lambda x: x.cast("string"))), "topics": F.concat_ws(",", "topics")})


def parse_summary(df: DataFrame) -> DataFrame:
    """What a parse found, in one row: measures, years and counties in order, how many have votes and a text."""
    return df.agg(
        F.count("*").alias("total_measures"), F.sort_array(F.collect_set(F.when(F.col("year") != 0, F.col("year")))).alias("years_covered"), F.sort_array(F.collect_set(F.when(F.col("county") != "", F.col("county")))).alias("counties"),
        n_if(F.col("yes_votes").isNotNull()).alias("measures_with_votes"), n_if(F.col("ballot_question") != "").alias("measures_with_text"),
    )


def histogram(df: DataFrame, column: str = "decade") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def source_files(df: DataFrame, file: str) -> DataFrame:
    """A row for each input: measures, ids, counties, with votes, share passed of decided."""
    decided = n_if(F.col("passed").isNotNull())
    return df.groupBy(file).agg(
        F.count("*").alias("measures"), F.countDistinct("measure_id").alias("ids"), F.countDistinct("county").alias("counties"),
        n_if(F.col("yes_votes").isNotNull()).alias("with_votes"), percent(n_if(F.col("passed") == 1), decided, 3).alias("pass_rate"),
    )
