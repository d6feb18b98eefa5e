"""Numbers, outcomes, dates and links as column expressions."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.keys import filled


def rounded(x: Column, digits: int) -> Column:
    """Half up on the double as it is: the same in every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def percent(part: Column, total: Column, digits: int = 2) -> Column:
    return F.when(total > 0, rounded(part.cast("double") / total * 100, digits))


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A plain number; null if it is none, as it is with thousands commas."""
    text = text.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def first_number(*columns: Column) -> Column:
    """The first that is a number, thousands commas left out."""
    return F.coalesce(*[number(F.replace(c.cast("string"), F.lit(","), F.lit(""))) for c in columns])


def year_within(value: Column, low: int, high: int) -> Column:
    """The digits before a decimal point as a year, null outside the bounds."""
    year = F.split_part(F.trim(value.cast("string")), F.lit("."), F.lit(1)).try_cast("int")
    return F.when(year.between(low, high), year)


def clean(c: Column) -> Column:
    """Empty text and `nan` are missing."""
    return F.when((c != "") & (F.lower(c) != "nan"), c)


def outcome_of_share(share: Column) -> Column:
    return F.when(share.isNotNull(), F.when(share > 50, 1).otherwise(0))


def outcome_of_status(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low.rlike("pass|adopt|approv"), 1).when(low.rlike("fail|defeat|reject"), 0)


def pass_fail(passed: Column) -> Column:
    return F.when(passed == 1, "Pass").when(passed == 0, "Fail")


def status_badge(passed: Column) -> Column:
    return F.when(passed == 1, "Passed").when(passed == 0, "Failed").otherwise("Pending")


def election_date_text(text: Column) -> Column:
    return filled(F.regexp_extract(text, r"(\w+\s+\d{1,2},\s+\d{4})", 1))


def election_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.regexp_replace(election_date_text(text), r"\s+", " "), F.lit("MMMM d, yyyy")))


def election_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("general"), "General").when(low.contains("primary"), "Primary").when(low.contains("special"), "Special")


def scraped_year(date_text: Column, measure_text: Column, default: str = "2026") -> Column:
    return F.coalesce(filled(F.regexp_extract(date_text, r"(\d{4})", 1)), filled(F.regexp_extract(measure_text, r"\b(20\d{2})\b", 1)), F.lit(default))


def absolute_url(href: Column, base: str) -> Column:
    """href against a base page: absolute, protocol-relative, rooted, or beside the page."""
    at = urlsplit(base)
    host, folder = f"{at.scheme}://{at.netloc}", at.path.rsplit("/", 1)[0]
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit(f"{at.scheme}:"), href))
        .when(href.startswith("/"), F.concat(F.lit(host), href)).when(href == "", F.lit(base)).otherwise(F.concat(F.lit(f"{host}{folder}/"), href))
    )


def slashes(href: Column) -> Column:
    return F.length(href) - F.length(F.replace(href, F.lit("/"), F.lit("")))


def tag_text(inner: Column, between: str = " ") -> Column:
    """The text of an element: tags out, entities read, white space collapsed."""
    out = F.regexp_replace(inner, "<[^>]+>", between)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def without_pdf_note(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\s*\(PDF\)\s*$", "")


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def from_iso(text: Column) -> Column:
    """A time, null if the text is none."""
    return F.try_to_timestamp(text)


def with_commas(n: Column) -> Column:
    return F.format_number(n, 0)


def truncated(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)
