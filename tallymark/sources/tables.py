"""Reading measures from files: delimited text of several layouts, JSON envelopes, columnar tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.keys import filled, identifier_in, strip, with_keys
from tallymark.functions.values import clean, first_number, number, outcome_of_share, outcome_of_status, pass_fail, percent, year_within
from tallymark.operators.filters import first_per
from tallymark.sources.files import settled
from tallymark.sources.workbook import by_layout, sheet_rows

#: Names that a CEDA column goes by, in the order of preference.
CEDA_COLUMNS = {
    "measure_id": ["MeasID", "MeasID_First", "Multi_MeasID"],
    "measure_text": ["BALQUEST", "ballot_question", "question"],
    "measure_letter": ["LTR", "letter", "measure_letter"],
    "measure_type": ["MEASTYPE", "type"],
    "election_date": ["DATE", "election_date"],
    "year": ["YEAR", "year"],
    "yes_votes": [" YES ", "YES", " YES_sum ", "YES_sum", "yes_votes"],
    "no_votes": [" NO ", "NO", " NO_sum ", "NO_sum", "no_votes"],
    "total_votes": [" TOTAL ", "TOTAL", " Total_sum ", "Total_sum", "total_votes"],
    "county": ["CNTYNAME", "county", "County"],
    "place": ["PLACE", "place", "city"],
    "jurisdiction": ["JUR", "jurisdiction"],
    "pass_fail": ["PASSFAIL", "passfail_sum", "pass_fail", "outcome_text"],
    "percent_yes": ["PERCENT", "Percent_sum", "percent", "yes_percent"],
    "outcome": ["outcome", "Outcome_sum"],
    "rec_type": ["RECTYPE", "typerec"],
    "rec_type_name": ["RECTYPENAME", "type_name"],
    "rec_topic": ["RECTOPIC", "toprec"],
    "rec_topic_name": ["RECTOPICNAME", "topic_name"],
}
#: The same for ICPSR.
ICPSR_COLUMNS = {
    "state": ["state", "State"],
    "year": ["year", "Year", "YEAR", "election_year"],
    "measure_id": ["measure_id", "MeasureID", "ID"],
    "title": ["title", "Title", "measure_title", "ballot_title"],
    "description": ["description", "Description", "summary", "ballot_summary"],
    "measure_type": ["type", "Type", "measure_type", "initiative_type"],
    "topic_primary": ["topic", "Topic", "subject", "Subject"],
    "status": ["status", "Status", "result", "Result"],
    "yes_votes": ["yes_votes", "Yes_Votes", "YES", "yes"],
    "no_votes": ["no_votes", "No_Votes", "NO", "no"],
}
#: NCSL columns.
NCSL_COLUMNS = {
    "measure_id": "ID", "title": "Title", "description": "Summary", "measure_type": "IRTypeDefinition",
    "topic_primary": "TOPICDESCRIPTION", "status": "IRStatusDefinition", "election_type": "ElectionType",
}
#: A workbook's sheet by name, in the order of preference.
SHEETS = ["Measures {year}", "Measures_{year}", "Measures{year}", "measures{year}", "Measures", "measures"]
CANDIDATE_WORDS = ["candidate", "cand#", "first", "last", "party"]
MEASURE_WORDS = ["BALQUEST", "LTR", "YES", "NO"]


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def resolve(columns: list[str], synonyms: list[str]) -> str | None:
    """The column that a field is in: an exact name by preference, else the first that contains one in any case."""
    exact = [s for s in synonyms if s in columns]
    loose = [c for s in synonyms for c in columns if s.lower() in c.lower()]
    return (exact or loose or [None])[0]


def choose_sheet(sheets: list[str], year: str) -> str | None:
    """The sheet with a year's measures: an exact name, one in any case, one that contains a general name, any with
    `measure`."""
    wanted = [s.format(year=year) for s in SHEETS]
    tests = [lambda s, w: s == w, lambda s, w: s.lower() == w.lower()]
    for test in tests:
        for w in wanted:
            for s in sheets:
                if test(s, w):
                    return s
    return next((s for w in SHEETS[-2:] for s in sheets if w in s), next((s for s in sheets if "measure" in s.lower()), None))


def is_candidate_sheet(columns: list[str]) -> bool:
    """Sheets of candidates, or with fewer than two of a measure sheet's columns, are no source. No columns: not known."""
    if not columns:
        return False
    if any(w in c.lower() for c in columns for w in CANDIDATE_WORDS):
        return True
    return sum(any(w in c.upper() for c in columns) for w in MEASURE_WORDS) < 2


def read_text_table(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Delimited text with a header, all columns text, quoted line breaks allowed. Without an encoding UTF-8 is taken unless
    some line's bytes aren't UTF-8, and Latin-1 then; give one file at a time, as read_each does."""
    if encoding is None:
        encoding = "UTF-8" if spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def ceda(df: DataFrame, file: str | None = None, file_year: str | None = None, row: str | None = None) -> DataFrame:
    """CEDA rows as measures. Votes, where a file has no total at all, add up; likewise its shares. `file`, `file_year` and
    `row` are no columns of the sheet; a row number goes along as _row."""
    at = {k: resolve([c for c in df.columns if c not in (file, file_year, row)], v) for k, v in CEDA_COLUMNS.items()}
    text = {k: (named(df, c).cast("string") if c else F.lit(None).cast("string")) for k, c in at.items()}
    file_of = named(df, file) if file else F.lit("")
    numbers = ("yes_votes", "no_votes", "total_votes", "percent_yes")
    place = [named(df, row).alias("_row")] if row else []
    own = df.select(*place, file_of.alias("input_file"), (named(df, file_year) if file_year else F.lit(None).cast("string")).alias("file_year"), *[(number(c) if k in numbers else c).alias(k) for k, c in text.items()])
    got = own.groupBy("input_file").agg(F.count("total_votes").alias("totals"), F.count("percent_yes").alias("shares"))
    own = own.join(F.broadcast(got), "input_file")  # a row for each file
    total = F.when(F.col("totals") > 0, F.col("total_votes")).otherwise(F.coalesce("yes_votes", F.lit(0.0)) + F.coalesce("no_votes", F.lit(0.0)))
    own = own.withColumn("total_votes", total)
    own = own.withColumn("percent_yes", F.when(F.col("shares") > 0, F.col("percent_yes")).otherwise(percent(F.col("yes_votes"), F.col("total_votes"))))
    own = own.where(F.col("measure_text").isNotNull() | F.col("measure_letter").isNotNull())
    county = F.col("county") if at["county"] else F.lit("Unknown")
    letter = F.col("measure_letter")
    title = F.when(letter.isNotNull(), F.concat(F.coalesce(county, F.lit("Unknown")), F.lit(" Measure "), letter)).otherwise(F.substring(F.coalesce("measure_text", F.lit("Unknown Measure")), 1, 100))
    passed = F.when(F.lower("pass_fail") == "pass", 1).when(F.lower("pass_fail") == "fail", 0)
    return own.select(
        "input_file", "measure_id", "measure_letter", F.coalesce(year_within(F.col("year"), 1900, 2100), year_within(F.col("file_year"), 1900, 2100)).alias("year"), F.lit("CA").alias("state"), county.alias("county"), "jurisdiction",
        title.alias("title"), F.lit(None).cast("string").alias("description"), F.col("measure_text").alias("ballot_question"), *[F.col(c).cast("long").alias(c) for c in ("yes_votes", "no_votes", "total_votes")], "percent_yes", passed.alias("passed"), "pass_fail", "measure_type",
        F.col("rec_type_name").alias("category_type"), F.col("rec_topic_name").alias("category_topic"), "election_date", F.lit("CEDA").alias("data_source"), *(["_row"] if row else []),
    )


def ncsl(df: DataFrame) -> DataFrame:
    """NCSL rows of California, 2014 to 2030, as measures; what is empty is null."""
    own = df.where(named(df, "StateName") == "California").withColumn("_year", year_within(F.col("Year"), 2014, 2030)).where("_year IS NOT NULL")
    share = number(F.col("PercentageVote"))
    passed = outcome_of_share(share)
    return own.select(F.col("_year").alias("year"), F.lit("CA").alias("state"), *[clean(F.col(c).cast("string")).alias(k) for k, c in NCSL_COLUMNS.items()], share.alias("percent_yes"), passed.alias("passed"), pass_fail(passed).alias("pass_fail"), F.lit("NCSL").alias("data_source"))


def icpsr(df: DataFrame) -> DataFrame:
    """ICPSR rows of California, 1900 to 2030, as measures: each field from the first of its columns that has a value."""
    have = {k: [named(df, c) for c in v if c in df.columns] for k, v in ICPSR_COLUMNS.items()}
    text = {k: F.coalesce(*[clean(strip(c.cast("string"))) for c in v], F.lit(None).cast("string")) for k, v in have.items()}
    years = F.coalesce(*[year_within(c, 1900, 2030) for c in have["year"]], F.lit(None).cast("int"))
    votes = {k: (F.floor(first_number(*have[k])) if have[k] else F.lit(None)).cast("long") for k in ("yes_votes", "no_votes")}
    own = df.where(F.upper(text["state"]) == "CALIFORNIA") if have["state"] else df
    own = own.select(years.alias("year"), F.lit("CA").alias("state"), *[text[k].alias(k) for k in ("measure_id", "title", "description", "measure_type", "topic_primary", "status")], *[c.alias(k) for k, c in votes.items()]).where("year IS NOT NULL")
    total = F.col("yes_votes") + F.col("no_votes")
    share = percent(F.col("yes_votes"), total)
    passed = F.when(total > 0, outcome_of_share(share)).otherwise(outcome_of_status(F.col("status")))
    return own.withColumns({"total_votes": F.when(total > 0, total), "percent_yes": share, "percent_no": percent(F.col("no_votes"), total), "passed": passed, "pass_fail": pass_fail(passed), "data_source": F.lit("ICPSR")})


@dataclass(frozen=True)
class Layout:
    """What files have in common that one scan can read: header line, encoding, and whether some have line breaks in quotes."""

    header: str
    encoding: str
    multiline: bool


def layouts(spark: SparkSession, path: str) -> dict[Layout, list[str]]:
    """The files of a path, folder or glob by their layout, from one distributed pass over their lines: a file is Latin-1 if some
    of its bytes aren't UTF-8, and has line breaks in quotes if a line has an odd number of quotes. What comes back to the
    driver is a row for each file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.groupBy("file").agg(F.min_by("value", F.struct("start", "nth")).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("multiline"))
    # names in Latin-1 are told apart by their bytes
    clean = F.when(F.col("utf8"), F.regexp_replace("header", "^\ufeff|\r$", "")).otherwise(F.hex(F.col("header").cast("binary")))
    out: dict[Layout, list[str]] = {}
    for r in sorted(found.select("file", clean.alias("header"), "utf8", "multiline").collect()):
        out.setdefault(Layout(r.header, "UTF-8" if r.utf8 else "ISO-8859-1", r.multiline), []).append(r.file)
    return out


def read_layout(spark: SparkSession, layout: Layout, paths: list[str]) -> DataFrame:
    """All files of a layout in one scan: its columns as text, file_path, file_year (what follows the last underscore of the file's
    name) and _row, the order of the rows of a file. Files without line breaks in quotes are split like any text."""
    raw = spark.read.csv(paths, header=True, multiLine=layout.multiline, escape='"', encoding=layout.encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return raw.withColumns({
        "file_path": F.col("_metadata.file_path"), "file_year": F.regexp_extract("_metadata.file_name", r"_([^_.]+)\.", 1), "_row": F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth")),
    })


def read_ceda(spark: SparkSession, path: str) -> DataFrame:
    """All files of a glob (delimited text), each by its own header, in as many scans as there are layouts; sheets of candidates
    are left out. The first row of each fingerprint by file and place stays."""
    return first_of_each([(raw, *FILE) for layout, paths in layouts(spark, path).items() if not is_candidate_sheet((raw := read_layout(spark, layout, paths)).columns[:-3])], spark)


#: Columns of a source that aren't the sheet's: its file, the file's year, the place of the row.
FILE = ("file_path", "file_year", "_row")


def first_of_each(sheets: list[tuple[DataFrame, str, str, str]], spark: SparkSession) -> DataFrame:
    """CEDA sheets as one table of measures with keys."""
    if not sheets:
        columns = ", ".join(f"`{c}` string" for c in CEDA_COLUMNS["measure_text"])
        sheets = [(spark.createDataFrame([], columns + ", file_path string, file_year string, _row struct<start: long, nth: long>"), *FILE)]
    return first_per(with_keys(total_of(*[ceda(*x) for x in sheets])), ["fingerprint"], ["input_file", "_row"]).drop("_row")


def ceda_workbooks(books: DataFrame) -> DataFrame:
    """CEDA workbooks (file_path, content) as measures: of each the sheet that choose_sheet() takes for the year in the file's name."""
    rows = settled(sheet_rows(books, lambda names, path: choose_sheet(names, (re.findall(r"_([^_./]+)\.[^/]*$", path) or [""])[0])))
    sheets = []
    for names, raw in by_layout(rows):
        if not is_candidate_sheet(names):
            year, place = F.regexp_extract("file_path", r"_([^_./]+)\.[^/]*$", 1), F.struct(F.lit(0).cast("long").alias("start"), F.col("row").alias("nth"))
            sheets.append((raw.withColumns({"file_year": year, "_row": place}).drop("row"), *FILE))
    return first_of_each(sheets, books.sparkSession)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return ceda_workbooks(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"), "content"))


def read_each(spark: SparkSession, path: str, standard: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All files of a glob, each with its own header and encoding, in as many scans as there are layouts."""
    return total_of(*[standard(read_layout(spark, layout, paths).drop(*FILE)) for layout, paths in layouts(spark, path).items()])


def read_ncsl(spark: SparkSession, path: str) -> DataFrame:
    return read_each(spark, path, ncsl)


def read_icpsr(spark: SparkSession, path: str) -> DataFrame:
    return read_each(spark, path, icpsr)


def read_envelope(spark: SparkSession, path: str) -> DataFrame:
    """A scrape result in JSON ({source, scraped_at, measures: [...]}): a row for each measure."""
    raw = spark.read.json(path, multiLine=True)
    own = raw.select(*[c for c in raw.columns if c != "measures"], F.explode("measures").alias("m"))
    inner = {f.name for f in own.schema["m"].dataType.fields}
    return own.select(*[c for c in own.columns if c != "m" and c not in inner], "m.*")


def scraped(df: DataFrame) -> DataFrame:
    """Raw scrape rows as measures: title, id from the text, the year as a number (and as it was), source names with
    underscores, the raw row as JSON."""
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    text = F.coalesce(filled(has("title")), filled(has("measure_text")))
    return df.select(
        text.alias("title"), identifier_in(F.coalesce(text, F.lit(""))).alias("measure_id"), has("year").try_cast("int").alias("year"), has("year").alias("year_raw"), has("description").alias("description"),
        F.replace(has("source"), F.lit(" "), F.lit("_")).alias("data_source"), has("pdf_url").alias("pdf_url"), has("source_url").alias("source_url"), has("election_type").alias("election_type"),
        F.to_json(F.struct(*df.columns)).alias("raw_data"),
    )


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ceda": read_ceda, "ncsl": read_ncsl, "icpsr": read_icpsr}


def reader(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    if kind not in READERS:
        raise ValueError(f"no source {kind!r}; there are {sorted(READERS)}")
    return READERS[kind]


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists in its file system."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def metadata(df: DataFrame, state: str | None = None, sample: int = 100, order: str | None = None) -> DataFrame:
    """A look at a source, in one row: columns (of twenty at most, with commas between), rows of a sample, those of California among
    them (null: not asked). The sample is the first rows by `order`, any rows without it."""
    got = (df if order is None else df.orderBy(order)).limit(sample)
    return got.agg(F.lit(",".join(df.columns[:20])).alias("columns"), F.count("*").alias("sampled"), (F.count_if(F.upper(state) == "CALIFORNIA") if state else F.lit(None).cast("long")).alias("california"))


def total_of(*sources: DataFrame) -> DataFrame:
    """All sources, columns by name, missing ones null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out

