"""Links and headers of HTML pages, in document order. Fetching is not part of it: the input is a table of pages. Headers and
links are found with built-in functions; which element a link stands in needs the page's nesting (nesting.py)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.keys import filled
from tallymark.functions.values import absolute_url, election_date_text, election_type, scraped_year, tag_text, without_pdf_note
from tallymark.sources.nesting import repository_links

REPOSITORY_PATH = "/ca_ballot_props/"
MOST_LINKS = 50
#: Links that leave a worker together, besides those of one more page.
LINKS_AT_ONCE = 10_000


def elements(pages: DataFrame, page: str = "page_id", html: str = "html", headers: str = "[23]") -> DataFrame:
    """(page, pos, tag, href, inner) of header and anchor elements. `headers`: a character class of header levels."""
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)<a\b[^>]*>.*?</a>|<h{headers}\b[^>]*>.*?</h{headers}>"), F.lit(0))
    own = pages.select(F.col(page).alias("page"), F.posexplode(found).alias("pos", "element"))
    tag = F.lower(F.regexp_extract("element", r"^<(\w+)", 1))
    href = F.coalesce(filled(F.regexp_extract("element", r"(?is)^<a\b[^>]*\bhref\s*=\s*\"([^\"]*)\"", 1)), filled(F.regexp_extract("element", r"(?is)^<a\b[^>]*\bhref\s*=\s*'([^']*)'", 1)))
    return own.select("page", "pos", tag.alias("tag"), href.alias("href"), F.regexp_extract("element", r"(?is)^<[^>]*>(.*)</\w+>$", 1).alias("inner"))


def links(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    return elements(pages, page, html).where("tag = 'a' AND href IS NOT NULL").select("page", "pos", "href", tag_text(F.col("inner")).alias("text"))


def with_last_header(found: DataFrame) -> DataFrame:
    """Each element with the text of the last header before it on its page; empty headers don't count."""
    header = F.when(F.col("tag") != "a", filled(tag_text(F.col("inner"), "")))
    return found.withColumn("header", F.last(header, ignorenulls=True).over(Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def election_measures(pages: DataFrame, base: str, page: str = "page_id", html: str = "html", headers: str = "[23]", suffix: str = ".pdf") -> DataFrame:
    """Linked documents as raw measures under their election headers."""
    found = with_last_header(elements(pages, page, html, headers)).where((F.col("tag") == "a") & F.lower(F.coalesce("href", F.lit(""))).endswith(suffix))
    text = without_pdf_note(tag_text(F.col("inner")))
    when = election_date_text(F.col("header"))
    own = found.select("page", "pos", text.alias("measure_text"), when.alias("election_date"), election_type(F.col("header")).alias("election_type"), absolute_url(F.col("href"), base).alias("pdf_url"))
    return own.where("measure_text <> ''").withColumn("year", scraped_year(F.col("election_date"), F.col("measure_text")))


def link_batches(batches: Iterator[pa.RecordBatch], path: str, least_slashes: int, most: int) -> Iterator[pa.RecordBatch]:
    """The repository links of batches of pages, those of many pages together."""

    def packed(batch: pa.RecordBatch, rows: list[int], links: list[tuple]) -> pa.RecordBatch:
        names = batch.column("page").take(pa.array(rows, pa.int32()))
        pos, nth, *texts = zip(*links)
        return pa.RecordBatch.from_arrays([names, pa.array(pos, pa.int32()), pa.array(nth, pa.int32()), *[pa.array(x, pa.string()) for x in texts]], ["page", "pos", "nth", "href", "title", "year", "number"])

    for batch in batches:
        rows, links = [], []
        for i, html in enumerate(batch.column("html")):
            if (text := html.as_py()) and (found := repository_links(text, path, least_slashes, most)):
                rows += [i] * len(found)
                links += found
                if len(links) >= LINKS_AT_ONCE:
                    yield packed(batch, rows, links)
                    rows, links = [], []
        if links:
            yield packed(batch, rows, links)


def repository_measures(pages: DataFrame, base: str, page: str = "page_id", html: str = "html", path: str = REPOSITORY_PATH, least_slashes: int = 4, most: int = MOST_LINKS) -> DataFrame:
    """Repository links of each page as raw measures, the first `most` of a page. Year and number come from the text of the
    element that a link stands in directly. A page is read once, from front to back; only links leave it."""
    kind = pages.schema[page].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link_batches(batches, path, least_slashes, most)

    found = pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInArrow(scan, f"page {kind}, pos int, nth int, href string, title string, year string, number string")
    text = F.coalesce(F.concat(F.lit("Proposition "), F.col("number"), F.lit(": "), F.col("title")), F.col("title"))
    return found.select("page", "pos", "nth", "title", text.alias("measure_text"), F.coalesce("year", F.lit("Unknown")).alias("year"), absolute_url(F.col("href"), base).alias("pdf_url"))
