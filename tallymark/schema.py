"""The one record type, and how frames are brought to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GROUPS = {
    T.StringType(): "fingerprint measure_fingerprint content_hash measure_id measure_letter state county jurisdiction title description ballot_question pass_fail measure_type topic_primary topic_secondary category_type category_topic data_source source_url pdf_url summary_title summary_text election_type duplicate_type",
    T.LongType(): "id yes_votes no_votes total_votes master_id",
    T.IntegerType(): "year passed decade century update_count",
    T.DoubleType(): "percent_yes percent_no",
    T.BooleanType(): "has_summary is_active is_duplicate",
    T.TimestampType(): "created_at updated_at last_seen_at",
    T.DateType(): "election_date",
    T.ArrayType(T.LongType()): "merged_from",
}
_TYPES = {name: kind for kind, names in _GROUPS.items() for name in names.split()}
#: The record's fields in order.
FIELDS = (
    "id fingerprint measure_fingerprint content_hash measure_id measure_letter year state county jurisdiction title description ballot_question "
    "yes_votes no_votes total_votes percent_yes percent_no passed pass_fail measure_type topic_primary topic_secondary category_type category_topic "
    "data_source source_url pdf_url has_summary summary_title summary_text election_type election_date decade century "
    "created_at updated_at last_seen_at update_count is_active is_duplicate duplicate_type master_id merged_from"
).split()
MEASURE = T.StructType([T.StructField(name, _TYPES[name]) for name in FIELDS])
#: What a field holds where its source has no such column.
DEFAULTS = {"state": "CA", "county": "Statewide", "data_source": "Unknown", "has_summary": False, "update_count": 0, "is_active": True, "is_duplicate": False}
RENAMES = {"source": "data_source"}


def missing_columns(df: DataFrame, wanted: T.StructType = MEASURE) -> list[str]:
    """Schema drift: fields that the frame lacks, sorted."""
    return sorted(set(wanted.fieldNames()) - set(df.columns))


def add_missing(df: DataFrame, wanted: T.StructType = MEASURE) -> DataFrame:
    """The frame with every missing field at its default."""
    return df.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in wanted if f.name not in df.columns})


def normalize(df: DataFrame) -> DataFrame:
    """Source names to the record's: renames, measure_text as the title where there is none, unknown columns dropped."""
    for old, new in RENAMES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    if "title" not in df.columns and "measure_text" in df.columns:
        df = df.withColumnRenamed("measure_text", "title")
    return df.select([c for c in df.columns if c in _TYPES])


def conform(df: DataFrame) -> DataFrame:
    """Exactly the record's fields and types; what can't be cast is null."""
    full = add_missing(normalize(df))
    types = dict(full.dtypes)
    return full.select([(F.col(f.name) if types[f.name] == f.dataType.simpleString() else F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in MEASURE])
