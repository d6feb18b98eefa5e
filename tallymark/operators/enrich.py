"""Known summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.keys import naming_text, summary_key
from tallymark.operators.filters import active, needs_summary

#: Summaries that come with the system (key, title, text).
KNOWN_SUMMARIES = [
    ("ACA 13", "Protect and Retain the Majority Vote Act", "Would require that ballot measures proposing to increase voting thresholds for future measures must themselves pass by the same increased threshold they seek to impose. Currently, a simple majority can pass a measure requiring supermajority votes for future actions, giving disproportionate power to a minority of voters."),
    ("SCA 1", "Recall Process Reform", "Would reform California's recall process by eliminating the simultaneous successor election that currently appears on recall ballots. Under the current system, voters decide both whether to recall an officer and who should replace them, allowing a replacement to be chosen by a slim plurality rather than majority support."),
]
MAX_ATTEMPTS = 10


def known(spark: SparkSession, more: list[tuple[str, str, str]] = ()) -> DataFrame:
    """The dimension (measure_key, summary_title, summary_text); later entries of a key replace earlier ones."""
    rows = list({k: (k, t, s) for k, t, s in [*KNOWN_SUMMARIES, *more]}.values())
    return spark.createDataFrame(rows, "measure_key string, summary_title string, summary_text string")


def with_known(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows whose key the dimension has, with its title and text. An equi-join on the key that the text yields, which is
    what a substring search and an exact check of the key would find. Spark broadcasts the dimension if it is small."""
    own = df.drop("summary_title", "summary_text").withColumn("measure_key", summary_key(naming_text()))
    return own.join(dimension, "measure_key")


def attempts(df: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Those in need that are tried: the latest years first, then by kind; ids break ties."""
    return needs_summary(df).orderBy(F.desc_nulls_last("year"), "kind_rank", "id").limit(limit)


def enrich(df: DataFrame, dimension: DataFrame, limit: int | None = MAX_ATTEMPTS) -> DataFrame:
    """id, measure_key, summary_title, summary_text of the rows in need of a summary, the first `limit` of them tried."""
    return with_known(needs_summary(df) if limit is None else attempts(df, limit), dimension).select("id", "measure_key", "summary_title", "summary_text")


def backfill(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """The table after summaries became known: active measures without one take theirs."""
    return apply(df, with_known(active(df).where(~F.col("has_summary")), dimension).select("id", "summary_title", "summary_text"))


def enrich_measure(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Measures given one by one, each with its summary if its key is known, whether or not it is among those in need."""
    return apply(df, with_known(df, dimension).select("id", "summary_title", "summary_text"))


def apply(df: DataFrame, found: DataFrame) -> DataFrame:
    """The table with the found summaries in it."""
    new = found.select("id", F.struct("summary_title", "summary_text").alias("_new"))
    out = df.join(new, "id", "left")
    hit = F.col("_new").isNotNull()
    values = {"has_summary": hit | F.coalesce("has_summary", F.lit(False))}
    for c in ("summary_title", "summary_text"):
        values[c] = F.coalesce(F.col(f"_new.{c}"), F.col(c)) if c in df.columns else F.col(f"_new.{c}")
    return out.withColumns(values).drop("_new")
