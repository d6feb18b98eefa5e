"""Full-text search: postings and BM25, with the request's filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.values import rounded
from tallymark.operators import match
from tallymark.operators.filters import active, like, select

K1, B = 1.2, 0.75
TEXT_FIELDS = ["title", "description", "ballot_question", "summary_title", "summary_text", "county"]


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def all_text(df: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in TEXT_FIELDS if c in df.columns])


def postings(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, term, tf)."""
    return df.select(F.col(doc).alias("doc"), F.explode(terms(text)).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def query_terms(query: str) -> list[str]:
    return sorted({t for t in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


def is_term(term: str):
    return lambda x: x == term


def bm25(df: DataFrame, doc: str, text: Column, query: str) -> DataFrame:
    """(doc, score) of rows that have every term of the query. One scan: term counts are taken by filtering a row's terms,
    so only query terms ever leave the scan; the collection's statistics are one aggregate row."""
    wanted = query_terms(query)
    if not wanted:
        return df.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    own = df.select(F.col(doc).alias("doc"), terms(text).alias("terms"))
    counted = own.select("doc", F.size("terms").alias("dl"), *[F.size(F.filter("terms", is_term(t))).alias(f"tf{i}") for i, t in enumerate(wanted)])
    stats = counted.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    every, score = F.lit(True), F.lit(0.0)
    average = F.col("total") / F.col("n")
    for i in range(len(wanted)):
        tf, n = F.col(f"tf{i}"), F.col(f"df{i}")
        every = every & (tf > 0)
        idf = F.log((F.col("n") - n + 0.5) / (n + 0.5) + 1.0)
        score = score + idf * (tf * (K1 + 1)) / (tf + K1 * ((1 - B) + B * F.col("dl") / average))
    hits = counted.where(every).crossJoin(F.broadcast(stats))  # one row
    return hits.select("doc", rounded(score, 6).alias("score"))


def ranked(df: DataFrame, doc: str, text: Column, query: str, limit: int = 100) -> DataFrame:
    return bm25(df, doc, text, query).orderBy(F.desc("score"), "doc").limit(limit)


@dataclass
class SearchRequest:
    query: str | None = None
    filters: dict = field(default_factory=dict)
    limit: int = 100
    offset: int = 0


def search(df: DataFrame, request: SearchRequest) -> DataFrame:
    """Active measures that pass the filters; with a query by rank, else by year."""
    if not 1 <= request.limit <= 1000 or request.offset < 0:
        raise ValueError("limit must be within 1 and 1000, offset 0 or more")
    own = select(active(df), **request.filters)
    if not request.query:
        return own.orderBy(F.desc_nulls_last("year"), "id").offset(request.offset).limit(request.limit)
    hits = bm25(active(df), "id", all_text(df), request.query)
    return own.join(hits.withColumnRenamed("doc", "id"), "id").orderBy(F.desc("score"), "id").offset(request.offset).limit(request.limit)


def quick_search(df: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Ranked hits; where the query has no terms, the plain substring search."""
    if query_terms(query):
        return search(df, SearchRequest(query, limit=limit))
    return like(df, query).orderBy(F.desc_nulls_last("year"), "id").limit(limit)


def search_measures(df: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """Active measures that satisfy a search expression (see match), best first; where the query is none, what the plain
    substring search finds, the latest first."""
    fields = [c for c in TEXT_FIELDS if c in df.columns]
    own = active(df)
    try:
        hits = match.matching(own, "id", fields, query)
    except match.Malformed:
        return like(df, query).orderBy(F.desc_nulls_last("year"), "id").limit(limit)
    return own.join(hits.withColumnRenamed("doc", "id"), "id").orderBy(F.desc("score"), "id").limit(limit)
