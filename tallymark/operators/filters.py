"""Filters, sorts, pages and facets of measures."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.keys import filled


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_active") & ~F.col("is_duplicate"))


def topic(df: DataFrame | None = None) -> Column:
    return F.coalesce(filled("topic_primary"), filled("category_topic"))


def select(
    df: DataFrame, *, year: int | None = None, year_min: int | None = None, year_max: int | None = None, county: str | None = None,
    passed: bool | None = None, has_summary: bool | None = None, has_votes: bool | None = None, topic: str | None = None, source: str | None = None,
) -> DataFrame:
    """The request's filters; what isn't given doesn't filter, nor does a year of 0."""
    if year:
        df = df.where(F.col("year") == year)
    if year_min:
        df = df.where(F.col("year") >= year_min)
    if year_max:
        df = df.where(F.col("year") <= year_max)
    for name, value in (("county", county), ("topic_primary", topic), ("data_source", source)):
        if value:
            df = df.where(F.col(name) == value)
    if passed is not None:
        df = df.where(F.col("passed") == int(passed))
    if has_summary is not None:
        df = df.where(F.col("has_summary") == has_summary)
    if has_votes is not None:
        df = df.where(F.col("yes_votes").isNotNull() if has_votes else F.col("yes_votes").isNull())
    return df


def like(df: DataFrame, query: str) -> DataFrame:
    """Active measures with the query in title, description or question, letters in either case; % and _ are wildcards."""
    found = F.lit(False)
    for c in ("title", "description", "ballot_question"):
        found = found | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return active(df).where(found)


def needs_summary(df: DataFrame) -> DataFrame:
    """Active, without a summary, and recent or of a kind that has one (the id has a character after ACA, SCA or PROP, in any
    case); kind_rank puts the kinds in their order."""
    kind = F.upper(F.regexp_extract(F.coalesce("measure_id", F.lit("")), "(?is)^(ACA|SCA|PROP).", 1))
    rank = F.get(F.array(*[F.lit(i) for i in (4, 1, 2, 3)]), F.array_position(F.array(*[F.lit(k) for k in ("ACA", "SCA", "PROP")]), kind).cast("int"))
    return active(df).where(~F.col("has_summary")).withColumn("kind_rank", rank).where((F.col("year") >= 2020) | (F.col("kind_rank") < 4))


def has_new_data(old: str, new: str, fields: list[str]) -> Column:
    """Some new value is there and differs from the old."""
    out = F.lit(False)
    for f in fields:
        a, b = F.col(f"{old}.{f}"), F.col(f"{new}.{f}")
        out = out | (b.isNotNull() & ~a.eqNullSafe(b))
    return out


def would_update(old: str, new: str) -> Column:
    gained = lambda f: ~F.coalesce(f(old), F.lit(False)) & F.coalesce(f(new), F.lit(False))
    return gained(lambda s: F.col(f"{s}.has_summary")) | gained(lambda s: F.coalesce(F.col(f"{s}.pdf_url"), F.lit("")) != "")


def page(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """By year (latest first), county and letter; ids break ties."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be within 1 and 1000, offset 0 or more")
    return df.orderBy(F.desc_nulls_last("year"), F.asc_nulls_first("county"), F.asc_nulls_first("measure_letter"), "id").offset(offset).limit(limit)


SORTS = {
    "year-desc": lambda: [F.coalesce(F.col("year"), F.lit(0)).desc()],
    "year-asc": lambda: [F.coalesce(F.col("year"), F.lit(0)).asc()],
    "title": lambda: [F.coalesce(filled("title"), filled("ballot_question"), F.lit("")).asc()],
    "title-locale": lambda: [F.collate(F.coalesce(filled("title"), filled("ballot_question"), F.lit("")), "en").asc()],
    "votes": lambda: [F.coalesce(F.col("total_votes"), F.lit(0)).desc()],
}


def sort(df: DataFrame, by: str) -> DataFrame:
    """One of SORTS, missing as 0 or empty; titles by their bytes, or as English orders them (title-locale); ids break ties."""
    return df.orderBy(*SORTS[by](), "id")


@dataclass
class Facets:
    year_min: int | None = None
    year_max: int | None = None
    statuses: set[str] = field(default_factory=set)
    has_summary: bool = False
    has_votes: bool = False
    topics: set[str] = field(default_factory=set)
    text: str = ""


def status() -> Column:
    return F.when(F.col("passed") == 1, "passed").when(F.col("passed") == 0, "failed").otherwise("pending")


def faceted(df: DataFrame, want: Facets) -> DataFrame:
    """All facets together; several statuses or topics are alternatives; unknown years pass the year facet."""
    if want.year_min is not None or want.year_max is not None:
        df = df.where(F.col("year").isNull() | F.col("year").between(want.year_min or 0, want.year_max or 9999))
    if want.statuses:
        df = df.where(status().isin(sorted(want.statuses)))
    if want.has_summary:
        df = df.where("has_summary")
    if want.has_votes:
        df = df.where(F.col("yes_votes").isNotNull())
    if want.topics:
        df = df.where(F.coalesce(topic(), F.lit("")).isin(sorted(want.topics)))
    if want.text:
        shown = F.coalesce(filled("title"), filled("ballot_question"))
        words = F.concat_ws(" ", filled("title"), shown, filled("description"), filled("summary_text"), filled("topic_primary"), F.col("year").cast("string"))
        df = df.where(F.lower(words).contains(want.text.lower()))
    return df


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    """A look at the first rows by id."""
    return df.orderBy("id").limit(n)


def featured(df: DataFrame, first: int = 5) -> DataFrame:
    """The first rows by year and id are featured, the others are the rest. Only the features are ranked; the rest is what
    an anti-join leaves, so nothing is sorted in one place."""
    top = df.orderBy(F.desc_nulls_last("year"), "id").limit(first).select("id", F.lit(True).alias("featured"))
    return df.join(F.broadcast(top), "id", "left").withColumn("featured", F.coalesce("featured", F.lit(False)))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")
