"""Statistics that are kept up to date: a small table of counts that changes can be added to and taken from.

The state holds, for each combination of what the statistics ask for, how many active measures have it and the sum of their
shares in hundredths (whole numbers, so that adding and taking away is exact). A change is the old rows of what changed, counted
down, and the new ones, counted up; states of parts of a table add up to that of the whole. Distinct values are those
whose count is above zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.values import rounded
from tallymark.operators.filters import active

GRAIN = ["year", "county", "data_source", "topic_primary", "passed", "has_summary", "with_votes"]
SUMS = ["n", "shares", "share_sum"]


def state_of(df: DataFrame, sign: int = 1) -> DataFrame:
    """The state of a table, or what its rows take away."""
    own = active(df).select(*[c for c in GRAIN if c != "with_votes"], F.col("yes_votes").isNotNull().alias("with_votes"), F.round(F.col("percent_yes") * 100).cast("long").alias("share"))
    return own.groupBy(*GRAIN).agg(*[(x * sign).alias(c) for c, x in zip(SUMS, (F.count("*"), F.count("share"), F.coalesce(F.sum("share"), F.lit(0))))])


def added(*states: DataFrame) -> DataFrame:
    """States put together; combinations that nothing has any more go."""
    both = reduce(DataFrame.unionByName, states)
    return both.groupBy(*GRAIN).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n <> 0 OR shares <> 0 OR share_sum <> 0")


def changed(state: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The state after rows changed: old, as they were (none for new rows); new, as they are (none for deleted ones)."""
    return added(state, state_of(old, -1), state_of(new))


def count_of(condition: str) -> Column:
    return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0))


def yearly(state: DataFrame) -> DataFrame:
    """As stats.yearly() of the table."""
    return state.groupBy("year").agg(
        F.sum("n").alias("total_measures"), F.countDistinct("county").alias("counties"), count_of("passed = 1").alias("passed"), count_of("passed = 0").alias("failed"),
        count_of("has_summary").alias("with_summaries"), count_of("with_votes").alias("with_votes"), F.when(F.sum("shares") > 0, rounded(F.try_divide(F.sum("share_sum"), F.sum("shares") * 100), 1)).alias("avg_percent_yes"),
    )


def overall(state: DataFrame) -> DataFrame:
    """As stats.overall() of the table."""
    year = [F.min("year").alias("year_min"), F.max("year").alias("year_max"), (F.max("year") - F.min("year")).alias("year_span")]
    return state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_measures"), count_of("has_summary").alias("with_summaries"), count_of("with_votes").alias("with_votes"), *year, count_of("passed = 1").alias("passed"), count_of("passed = 0").alias("failed"),
        count_of("passed IS NULL OR passed NOT IN (0, 1)").alias("unknown"), F.countDistinct("data_source").alias("sources"), F.countDistinct("county").alias("counties"), F.countDistinct("topic_primary").alias("topics"),
    )


def count_by(state: DataFrame, column: str) -> DataFrame:
    """As stats.count_by() of the table, for a column of the state."""
    return state.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
