"""Derived keys as column expressions. Nulls read as the texts say; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier patterns in the order of precedence, and what an identifier begins with (null: a first group).
IDENTIFIERS = [
    (r"(?i)(?:Proposition|Prop\.?)\s*(\d+[A-Z]?)", "PROP"),
    (r"(?i)([AS]CA)\s*(\d+)", None),
    (r"(?i)(AB|SB)\s*(\d+)", None),
    (r"(?i)(?:Measure)\s*([A-Z]+)", "MEASURE"),
]
#: Patterns of summary keys in the order of precedence.
SUMMARY_KEYS = [r"(?i)\b(ACA\s+\d+)\b", r"(?i)\b(SCA\s+\d+)\b", r"(?i)\b(AB\s+\d+)\b", r"(?i)\b(SB\s+\d+)\b", r"(?i)\b(Prop(?:osition)?\s+\d+[A-Z]?)\b"]


def filled(c: Column | str) -> Column:
    """Empty text is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def naming_text(title: str = "title", question: str = "ballot_question") -> Column:
    return F.coalesce(filled(title), filled(question), F.lit(""))


def identifier_in(text: Column) -> Column:
    """The first pattern that occurs anywhere, formatted and in upper case; null if none does."""
    found = F.lit(None).cast("string")
    for pattern, lead in reversed(IDENTIFIERS):
        parts = (F.lit(lead), F.regexp_extract(text, pattern, 1)) if lead else (F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
        found = F.when(text.rlike(pattern), F.upper(F.concat_ws("_", *parts))).otherwise(found)
    return found


def content_hash() -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "ballot_question", "description")]
    return F.substring(F.md5(F.lower(strip(F.concat_ws("|", *parts))).cast("binary")), 1, 16)


def identifier(hashed: Column) -> Column:
    text = naming_text()
    return F.when(text == "", F.lit("UNKNOWN")).otherwise(
        F.coalesce(identifier_in(text), F.concat(F.lit("ID_"), filled("measure_id")), F.concat(F.lit("MEASURE_"), filled("measure_letter")), F.concat(F.lit("HASH_"), F.substring(hashed, 1, 8)))
    )


def shown(c: str) -> Column:
    """As text, a null as `None`."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def century(year: Column) -> Column:
    return (F.floor((year - 1) / 100) + 1).cast("int")


def with_keys(df: DataFrame) -> DataFrame:
    """content_hash, identifier, fingerprint, measure_fingerprint, decade, century."""
    df = df.withColumn("content_hash", content_hash())
    df = df.withColumn("identifier", identifier(F.col("content_hash")))
    name = F.concat_ws("|", shown("year"), F.col("identifier"), shown("county"))
    return df.withColumns({"measure_fingerprint": name, "fingerprint": F.concat_ws("|", name, shown("data_source")), "decade": decade(F.col("year")), "century": century(F.col("year"))})


def summary_key(text: Column) -> Column:
    """`ACA 13`, `Prop 13`: the text's first key by precedence, white space as it stands."""
    found = F.lit(None).cast("string")
    for pattern in reversed(SUMMARY_KEYS):
        found = F.when(text.rlike(pattern), F.replace(F.upper(F.regexp_extract(text, pattern, 1)), F.lit("PROPOSITION"), F.lit("Prop"))).otherwise(found)
    return found
