"""What is shown of measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.keys import filled
from tallymark.functions.values import status_badge
from tallymark.operators.filters import topic

#: Fields of an API answer.
API_FIELDS = (
    "id fingerprint year state county title description ballot_question yes_votes no_votes percent_yes passed measure_type topic_primary "
    "data_source pdf_url has_summary summary_title summary_text"
).split()


def display(df: DataFrame) -> DataFrame:
    return df.withColumns({"measure_text": F.coalesce(filled("title"), filled("ballot_question")), "source": F.col("data_source"), "year": F.when(F.col("year") != 0, F.col("year").cast("string"))})


def api(df: DataFrame) -> DataFrame:
    return df.select([c for c in API_FIELDS if c in df.columns])


def listed(df: DataFrame) -> DataFrame:
    """id, badge, topic label and whole percent of a list entry."""
    return df.select("id", status_badge(F.col("passed")).alias("badge"), F.coalesce(topic(), F.lit("General")).alias("topic_label"), F.floor(F.col("percent_yes") + 0.5).cast("int").alias("percent"))


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """A JSON object for each row; a site's payload is these lines. Nulls are left out."""
    return df.select("id", F.to_json(F.struct(*columns)).alias("json"))


def as_csv(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("id", F.concat_ws(",", *[F.coalesce(F.when(F.col(c).cast("string").rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c).cast("string")), F.lit("")) for c in columns]).alias("line"))
