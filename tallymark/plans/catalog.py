"""Queries over the facade and the text tables, each with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import keys, values
from tallymark.operators import dedup, enrich, filters, kept, likeness, match, project, search, stats, textindex, upsert
from tallymark.plans import sql
from tallymark.schema import add_missing, conform, missing_columns
from tallymark.sources import facade, files, measuretable, pages, sinks, tables, workbook

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2001-12-31"
BASE = "https://www.example.org/elections/list/index.html"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def over(build: Callable[[DataFrame], DataFrame], *, keyed: bool = False) -> Query:
    return lambda spark, d: build((facade.keyed if keyed else facade.measures)(spark, d))


def batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two thirds of the measures as what is there; the others, and changed copies of some that are there, as what comes."""
    all_ = facade.keyed(spark, d).withColumns({"update_count": F.lit(0), "master_id": F.lit(None).cast("long")})
    changed = all_.where("id % 15 = 1").withColumns({"id": F.col("id") + 10_000_000, "description": F.lit("Changed"), "yes_votes": F.col("yes_votes") + 1})
    linked = all_.where("id % 15 = 2").withColumns({"id": F.col("id") + 20_000_000, "pdf_url": F.lit("https://example.org/new.pdf")})
    asked = all_.where("id % 15 = 4").withColumns({"id": F.col("id") + 30_000_000, "ballot_question": F.lit("Asked anew?"), "has_summary": F.lit(True)})
    return all_.where("id % 3 <> 0"), all_.where("id % 3 = 0").unionByName(changed).unionByName(linked).unionByName(asked)


def ids(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", *more)


QUERIES |= {
    "yearly_stats": over(stats.yearly),
    "global_stats": over(stats.overall),
    "status_line": over(stats.status_line),
    "count_by_source": over(lambda m: stats.count_by(m, "data_source")),
    "years_counts": over(lambda m: stats.count_by(m, "year")),
    "topics_counts": over(lambda m: stats.count_by(m, "topic_primary")),
    "counties_counts": over(lambda m: stats.count_by(m, "county")),
    "topic_top20": over(stats.top_topics),
    "pass_rate": over(stats.pass_rate),
    "decade_histogram": over(lambda m: stats.histogram(m), keyed=True),
    "validation_profile": over(stats.profile),
    "source_files": over(lambda m: stats.source_files(m, "data_source")),
    "summary_coverage_year": over(lambda m: stats.coverage_by_year(m, 1997)),
    "summary_coverage_type": over(lambda m: stats.coverage_by_kind(m.withColumn("measure_id", F.col("identifier"))), keyed=True),
    "active_measures": over(lambda m: ids(filters.active(m), "year", "county")),
    "filter_year": over(lambda m: ids(filters.select(m, year=1997))),
    "filter_year_range": over(lambda m: ids(filters.select(m, year_min=1996, year_max=1998))),
    "filter_passed": over(lambda m: ids(filters.select(m, passed=True))),
    "filter_equal": over(lambda m: ids(filters.select(m, county="NATION_3", topic="1-URGENT", source="NCSL"))),
    "filter_summary_votes": over(lambda m: ids(filters.select(m, has_summary=True, has_votes=True))),
    "facet_status": over(lambda m: ids(filters.faceted(m, filters.Facets(statuses={"failed", "pending"})))),
    "facet_features": over(lambda m: ids(filters.faceted(m, filters.Facets(has_summary=True, has_votes=True)))),
    "facet_topics": over(lambda m: ids(filters.faceted(m, filters.Facets(topics={"1-URGENT", "BUILDING"})))),
    "facet_text": over(lambda m: ids(filters.faceted(m, filters.Facets(year_min=1996, text="Measure B")))),
    "like_search": over(lambda m: ids(filters.like(m, "meAsure b"))),
    "needs_summary": over(lambda m: ids(filters.needs_summary(m.withColumn("measure_id", F.col("identifier"))), "kind_rank"), keyed=True),
    "active_sorted_page": over(lambda m: ids(filters.page(filters.active(m), 100, 50), "year")),
    "sort_votes": over(lambda m: ids(filters.sort(m, "votes").limit(40))),
    "sort_title": over(lambda m: ids(filters.sort(m, "title").limit(40))),
    "sort_votes_all": over(lambda m: ids(filters.sort(m, "votes"))),
    "sort_title_all": over(lambda m: ids(filters.sort(m, "title"))),
    "sort_title_locale": over(lambda m: ids(filters.sort(m.withColumn("title", F.when(F.col("id") % 5 == 1, F.lower("title")).when(F.col("id") % 5 == 2, F.replace("title", F.lit("a"), F.lit("\u00e4"))).otherwise(F.col("title"))), "title-locale"))),
    "site_state": over(lambda m: sinks.site_state(m.where("is_active"), datetime(2001, 7, 1))),
    "featured_split": over(lambda m: ids(filters.featured(filters.active(m)), "featured")),
    "get_measure": over(lambda m: m.where("id = 7").select("id", "title", "year")),
    "measure_identifier": over(lambda m: ids(m, "identifier"), keyed=True),
    "fingerprints": over(lambda m: ids(m, "fingerprint", "measure_fingerprint", "decade", "century"), keyed=True),
    "content_hash": over(lambda m: ids(m, "content_hash"), keyed=True),
    "cross_source_groups": over(lambda m: dedup.cross_source_groups(m).withColumn("ids", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))).withColumn("sources", F.concat_ws(",", "sources")), keyed=True),
    "content_dup_groups": over(dedup.content_groups, keyed=True),
    "first_wins_dedupe": over(lambda m: ids(dedup.first_wins(m), "fingerprint"), keyed=True),
    "master_selection": over(lambda m: ids(dedup.with_master(m.where("NOT is_duplicate"), AS_OF), "score", "group_size", "master_id").withColumn("score", F.col("score").cast("long")), keyed=True),
    "merge_fields": over(lambda m: dedup.merge_fields(m, AS_OF).withColumn("merged_from", F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ", ")), keyed=True),
    "dedupe_cross_source": over(lambda m: ids(dedup.dedupe_cross_source(m.withColumn("update_count", F.lit(0)), AS_OF), "is_duplicate", "duplicate_type", "master_id", "description", "summary_text", "total_votes", "percent_yes", "passed", "merged_from", "update_count"), keyed=True),
    "duplicate_report": over(dedup.report, keyed=True),
    "duplicate_counts": over(dedup.counts, keyed=True),
    "duplicate_lineage": over(lambda m: dedup.lineage(dedup.dedupe_cross_source(m, AS_OF)), keyed=True),
    "mark_duplicate": over(lambda m: ids(dedup.mark_duplicate(dedup.unmark_duplicate(m.withColumn("master_id", F.lit(None).cast("long")), 11), 5, 3, "content"), "is_duplicate", "duplicate_type", "master_id")),
    "display_projection": over(lambda m: ids(project.display(m), "measure_text", "source", "year")),
    "api_projection": over(lambda m: project.api(m).select("id", "year", "state", "county", "title", "percent_yes", "passed", "has_summary")),
    "list_labels": over(project.listed),
    "json_rows": over(lambda m: project.as_json(m, ["year", "county", "title", "passed", "has_summary"])),
    "csv_rows": over(lambda m: project.as_csv(m, ["year", "county", "title", "description"])),
    "schema_conform": over(lambda m: conform(m).select("id", "year", "has_summary", "update_count", "state", "is_active", F.col("merged_from").isNull().alias("no_merge"))),
    "schema_drift": over(lambda m: add_missing(m.drop("state", "is_active")).select("id", "state", "is_active").withColumn("n_missing", F.lit(len(missing_columns(m.drop("state", "is_active")))).cast("int"))),
}


CONTENT = ("title", "ballot_question", "description")


@query
def content_likeness(spark: SparkSession, d: str) -> DataFrame:
    """Each measure with words, its class of equal sets of words, and how many other classes share 80 of 100 words with it."""
    return likeness.alike(facade.measures(spark, d).where("NOT is_duplicate"), "id", F.concat_ws(" ", *CONTENT))


@query
def content_likeness_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, found = likeness.classes(facade.measures(spark, d).where("NOT is_duplicate"), "id", F.concat_ws(" ", *CONTENT))
    return likeness.pairs(found).select("a", "b", values.rounded(F.col("likeness"), 6).alias("likeness"))


def kept_state(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the measures that are there, after a batch: what it changed is taken away and added, nothing is counted anew."""
    old, new = batch(spark, d)
    found = files.settled(upsert.sorted_in(old, new))
    were = old.join(found.where("fate = 'updated'").select(F.col("matched_id").alias("id")), "id", "left_semi")
    are = upsert.updated(were, found, AS_OF).unionByName(upsert.coming_in(old.columns, found), allowMissingColumns=True)
    return kept.changed(kept.state_of(old), were, are)


@query
def kept_yearly(spark: SparkSession, d: str) -> DataFrame:
    return kept.yearly(kept_state(spark, d))


@query
def kept_overall(spark: SparkSession, d: str) -> DataFrame:
    return kept.overall(kept_state(spark, d))


@query
def kept_counts(spark: SparkSession, d: str) -> DataFrame:
    state = kept_state(spark, d)
    every = [kept.count_by(state, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), "n") for c in ("year", "county", "data_source", "topic_primary")]
    return tables.total_of(*every)


@query
def new_measures(spark: SparkSession, d: str) -> DataFrame:
    return ids(upsert.new_measures(*batch(spark, d)))


@query
def classify_batch(spark: SparkSession, d: str) -> DataFrame:
    return ids(upsert.classify(*batch(spark, d)), "match_type", "matched_id")


@query
def potential_updates(spark: SparkSession, d: str) -> DataFrame:
    return upsert.potential_updates(*batch(spark, d))


@query
def update_check_rollup(spark: SparkSession, d: str) -> DataFrame:
    return upsert.check_updates(*batch(spark, d))


@query
def upsert_result(spark: SparkSession, d: str) -> DataFrame:
    return upsert.upsert(*batch(spark, d), AS_OF).select("id", "title", "yes_votes", "update_count", "is_duplicate", "duplicate_type", "master_id")


@query
def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    return upsert.upsert_counts(*batch(spark, d))


@query
def change_audit(spark: SparkSession, d: str) -> DataFrame:
    return upsert.change_audit(*batch(spark, d))


@query
def known_summary_join(spark: SparkSession, d: str) -> DataFrame:
    m = facade.keyed(spark, d).withColumn("measure_id", F.col("identifier"))
    return enrich.enrich(m, enrich.known(spark), limit=None).select("id", "measure_key", "summary_title")


@query
def add_known_summary(spark: SparkSession, d: str) -> DataFrame:
    m = facade.measures(spark, d)
    return enrich.backfill(m, enrich.known(spark, [("ACA 7", "Seven", "About seven.")])).select("id", "has_summary", "summary_title")


@query
def summary_keys(spark: SparkSession, d: str) -> DataFrame:
    return facade.measures(spark, d).select("id", keys.summary_key(keys.naming_text()).alias("measure_key"))


@query
def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(facade.read(spark, d, "documents"), "doc_id", F.col("text"))


@query
def fts_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(facade.read(spark, d, "documents"), "doc_id", F.col("text"), "the and")


TEXTS = ["title", "description", "ballot_question", "summary_text", "county"]


def indexed(spark: SparkSession, d: str, search_for: str) -> DataFrame:
    """What a stored index of the measures finds."""

    def find(folder: str) -> DataFrame:
        index = textindex.TextIndex(spark, folder, TEXTS)
        index.add(facade.measures(spark, d))
        return index.search(search_for).withColumnRenamed("doc", "id")

    return files.through_folder(spark, find)


@query
def fts_stored(spark: SparkSession, d: str) -> DataFrame:
    """An index after a second batch, which replaces some measures, after deletions and after its segments are merged, in another
    session's eyes."""
    m = facade.measures(spark, d)

    def find(folder: str) -> DataFrame:
        index = textindex.TextIndex(spark, folder, TEXTS)
        index.add(m.where("id % 3 <> 0"))
        index.add(m.where("id % 3 = 0").unionByName(m.where("id % 15 = 1").withColumn("title", F.lit("Measure B again"))))
        index.merge()
        index.delete(m.where("id % 7 = 0").select(F.col("id").alias("doc")))
        return textindex.TextIndex(spark, folder, TEXTS).search("measure b").withColumnRenamed("doc", "id")

    return files.through_folder(spark, find)


@query
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, '"measure b" OR "local question 1"')


@query
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "propos* NOT build*")


@query
def fts_not(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "(measure OR question) NOT (furniture OR building)")


@query
def fts_column(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, '{title description} : (measure OR bonds) AND county : ^"nation 3"')


@query
def fts_near(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "NEAR(shall adopt, 2) OR NEAR(question local, 0)")


@query
def fts_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A query that is no expression: the substring search, the latest first."""
    return search.search_measures(facade.measures(spark, d), "(relates", limit=40).select("id", "year").unionByName(search.search_measures(facade.measures(spark, d), "question AND local", limit=40).select("id", "year"))


@query
def fts_folded(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents with and without diacritics, in either case."""
    return match.matching(facade.read(spark, d, "documents"), "doc_id", ["text"], "CAFE* OR \u00e9t* OR ni\u00f1o")


@query
def api_search(spark: SparkSession, d: str) -> DataFrame:
    request = search.SearchRequest("measure b", {"year_min": 1996, "has_votes": True}, limit=50, offset=5)
    return search.search(facade.measures(spark, d), request).select("id", "score")


@query
def documents_like(spark: SparkSession, d: str) -> DataFrame:
    return facade.read(spark, d, "documents").where(F.col("text").ilike("%license%")).select("doc_id")


@query
def link_extraction(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(facade.read(spark, d, "pages")).select("page", "pos", "href", "text")


@query
def header_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    found = pages.with_last_header(pages.elements(facade.read(spark, d, "pages"), headers="[1-3]"))
    return found.where("tag = 'a'").select("page", "pos", "href", "header")


@query
def repository_links(spark: SparkSession, d: str) -> DataFrame:
    got = pages.repository_measures(facade.read(spark, d, "pages"), BASE, path="/", least_slashes=1, most=3)
    return got.select("page", "pos", F.col("nth").cast("int").alias("nth"), "title", "year", "pdf_url")


@query
def repository_links_all(spark: SparkSession, d: str) -> DataFrame:
    """As many links of a page as the operator itself takes."""
    got = pages.repository_measures(facade.read(spark, d, "pages"), BASE, path="/", least_slashes=1)
    return got.select("page", "pos", F.col("nth").cast("int").alias("nth"), "title", "year", "pdf_url")


ELECTIONS = "concat(county, ' General Election, March ', id % 28 + 1, ', ', year)"


@query
def election_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page fragments made of measures, read back as measures."""
    html = F.expr(f"concat('<h2>', CASE WHEN id % 5 = 0 THEN '' ELSE {ELECTIONS} END, '</h2><p><a href=\"/docs/', id, '.pdf\"><b>', coalesce(title, ''), '</b> (PDF)</a> <a href=\"about.html\">About</a></p>')")
    got = pages.election_measures(facade.measures(spark, d).select("id", html.alias("html")), BASE, page="id")
    return got.select("page", "pos", "measure_text", "election_date", "election_type", "pdf_url", "year")


@query
def url_join(spark: SparkSession, d: str) -> DataFrame:
    href = F.expr("CASE id % 4 WHEN 0 THEN concat('https://a.example/', id) WHEN 1 THEN concat('//b.example/', id) WHEN 2 THEN concat('/c/', id) ELSE concat('d/', id) END")
    return facade.measures(spark, d).select("id", values.absolute_url(href, BASE).alias("url"))


@query
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    m = facade.measures(spark, d)
    return tables.total_of(m.where("year = 1996").select("id", "title"), m.where("year = 1997").select("county", "id"), m.where("id < 5").select("id", "title", "county"))


@query
def union_by_name_all(spark: SparkSession, d: str) -> DataFrame:
    """Three sources of different columns, which together hold every measure once."""
    m, third = facade.measures(spark, d), "coalesce(year, 0) % 3"
    return tables.total_of(m.where(f"{third} = 0").select("id", "title"), m.where(f"{third} = 1").select("county", "id"), m.where(f"{third} = 2").select("id", "title", "county"))


@query
def numeric_coerce(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE id % 4 WHEN 0 THEN '1,234' WHEN 1 THEN 'n/a' WHEN 2 THEN concat(id, '.5') END")
    years = F.expr("CASE id % 3 WHEN 0 THEN concat(year, '.0') WHEN 1 THEN '1899' ELSE 'abc' END")
    return facade.measures(spark, d).select("id", values.number(raw).alias("number"), values.first_number(raw).alias("stripped"), values.year_within(years, 1900, 2030).alias("year"))


def as_icpsr(m: DataFrame) -> DataFrame:
    return m.selectExpr(
        "CASE WHEN id % 10 = 9 THEN 'Nevada' ELSE 'California' END AS State", "concat(year, '.0') AS Year", "measure_id AS MeasureID", "title AS Title", "description AS summary",
        "CASE id % 5 WHEN 0 THEN 'Approved by voters' WHEN 1 THEN 'Defeated' WHEN 2 THEN 'nan' END AS Result", "CAST(CASE WHEN id % 3 = 0 THEN yes_votes END AS STRING) AS YES", "CAST(CASE WHEN id % 3 = 0 THEN no_votes END AS STRING) AS NO", "id AS row_id",
    )


@query
def icpsr_standard(spark: SparkSession, d: str) -> DataFrame:
    raw = as_icpsr(facade.measures(spark, d)).withColumnRenamed("row_id", "topic")
    return tables.icpsr(raw).select(F.col("topic_primary").cast("long").alias("id"), "year", "measure_id", "title", "yes_votes", "total_votes", "percent_yes", "passed", "pass_fail")


@query
def ncsl_standard(spark: SparkSession, d: str) -> DataFrame:
    raw = facade.measures(spark, d).selectExpr(
        "CASE WHEN id % 10 = 9 THEN 'Nevada' ELSE 'California' END AS StateName", "CAST(year + 20 AS STRING) AS Year", "CAST(id AS STRING) AS ID", "title AS Title", "CASE WHEN id % 2 = 0 THEN '' ELSE description END AS Summary",
        "'Initiative' AS IRTypeDefinition", "topic_primary AS TOPICDESCRIPTION", "'x' AS IRStatusDefinition", "'General' AS ElectionType", "CASE WHEN id % 4 = 0 THEN '50' ELSE CAST(percent_yes AS STRING) END AS PercentageVote",
    )
    return tables.ncsl(raw).select(F.col("measure_id").cast("long").alias("id"), "year", "title", "description", "topic_primary", "passed", "pass_fail")


@query
def ceda_standard(spark: SparkSession, d: str) -> DataFrame:
    raw = facade.measures(spark, d).selectExpr(
        "concat('f', id % 3) AS file", "CAST(year AS STRING) AS file_year", "CAST(id AS STRING) AS MeasID", "ballot_question AS BALQUEST", "measure_letter AS LTR", "CAST(yes_votes AS STRING) AS ` YES `", "CAST(no_votes AS STRING) AS ` NO `",
        "CASE WHEN id % 3 = 1 THEN CAST(total_votes AS STRING) END AS TOTAL", "county AS CNTYNAME", "CASE id % 4 WHEN 0 THEN 'Pass' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'PassT' END AS PASSFAIL",
    )
    got = tables.ceda(raw, "file", "file_year")
    return got.select(F.col("measure_id").cast("long").alias("id"), "year", "title", "total_votes", "percent_yes", "passed")


@query
def scrape_standard(spark: SparkSession, d: str) -> DataFrame:
    raw = facade.measures(spark, d).selectExpr("title AS measure_text", "CASE WHEN id % 6 = 0 THEN 'Unknown' ELSE CAST(year AS STRING) END AS year", "'CA SOS' AS source", "CAST(id AS STRING) AS description")
    return tables.scraped(raw).select(F.col("description").cast("long").alias("id"), "title", "measure_id", "year", "year_raw", "data_source")


@query
def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    m = facade.measures(spark, d).selectExpr("id", "CASE WHEN id % 9 > 0 THEN year END AS year", "CASE WHEN id % 8 = 0 THEN '' ELSE data_source END AS data_source")
    return ids(upsert.rejects(m))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events as a run log: runs by state and hour."""
    e = facade.read(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("status"), F.hour("ts").cast("int").alias("hour")).agg(F.count("*").alias("runs"), F.countDistinct("user_id").alias("sources"))


def ceda_sheets(m: DataFrame) -> dict[str, DataFrame]:
    """Sheets of two layouts and one of candidates, which together hold every measure."""
    return {
        "2016": m.where("id % 3 = 0").selectExpr("id AS MeasID", "ballot_question AS BALQUEST", "measure_letter AS LTR", "yes_votes AS YES", "no_votes AS NO", "total_votes + 1 AS TOTAL", "county AS CNTYNAME", "'Pass' AS PASSFAIL"),
        "2018": m.where("id % 3 = 1").selectExpr("'FAIL' AS PASSFAIL", "concat(county, ' \u00e9') AS CNTYNAME", "no_votes AS NO", "yes_votes AS YES", "measure_letter AS LTR", "ballot_question AS BALQUEST", "id AS MeasID"),
        "2019": m.where("id % 3 = 2").selectExpr("title AS CAND_NAME", "'x' AS Party", "yes_votes AS YES", "no_votes AS NO"),
    }


def files_for(df: DataFrame) -> int:
    """Four files, and one more for each 50,000 rows."""
    return 4 + df.count() // 50_000


@query
def ceda_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of two layouts and encodings and some of candidates, several of each year, written in parallel and read as one
    source: a scan for each layout and encoding."""
    m = facade.measures(spark, d)

    def go(folder: str) -> DataFrame:
        for year, sheet in ceda_sheets(m).items():
            sinks.text_files(sheet, lambda i, y=year: f"{folder}/{y}_part{i:05d}_{y}.csv", files_for(sheet), sheet.columns[0] if year == "2016" else sheet.columns[-1], "ISO-8859-1" if year == "2018" else "UTF-8")
        return tables.reader("ceda")(spark, f"{folder}/*.csv").select("measure_id", "year", "county", "title", "total_votes", "passed", "fingerprint")

    return files.through_folder(spark, go)


@query
def ceda_workbooks(spark: SparkSession, d: str) -> DataFrame:
    """The same sheets in workbooks, several of each year, behind sheets of notes; made and read in parallel."""
    m, books = facade.measures(spark, d), None
    for year, sheet in ceda_sheets(m).items():
        path = F.concat(F.lit(f"/{year}_part"), F.lpad(F.col("part").cast("string"), 5, "0"), F.lit(f"_{year}.xlsx"))
        name = {"2016": "Measures 2016", "2018": "All Measures", "2019": "measures2019"}[year]
        made = workbook.as_workbooks(sheet, files_for(sheet), sheet.columns[0] if year == "2016" else sheet.columns[-1], name, path, {"Notes": [["about", None, 1, True]]})
        books = made if books is None else books.unionByName(made)
    return tables.ceda_workbooks(books).select("measure_id", "year", "county", "title", "total_votes", "passed", "fingerprint")


@query
def icpsr_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in different encodings and orders of columns, several of each."""
    m = as_icpsr(facade.measures(spark, d)).withColumn("title", F.concat("title", F.lit(" \u00e9")))

    def go(folder: str) -> DataFrame:
        sinks.text_files(m.where("row_id % 2 = 0").withColumnRenamed("row_id", "topic"), lambda i: f"{folder}/a{i}.csv", files_for(m), "topic", "ISO-8859-1")
        sinks.text_files(m.where("row_id % 2 = 1").select("Title", "Year", "State", F.col("row_id").alias("topic"), "MeasureID"), lambda i: f"{folder}/b{i}.csv", files_for(m), "topic")
        got = tables.reader("icpsr")(spark, f"{folder}/*.csv")
        return got.select(F.col("topic_primary").cast("long").alias("id"), "year", "measure_id", "title", "yes_votes")

    return files.through_folder(spark, go)


@query
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    def go(folder: str) -> DataFrame:
        sinks.csv(facade.measures(spark, d).select("id", "year", "title", F.array("year", "id").alias("pair")), folder)
        return tables.read_text_table(spark, folder).selectExpr("cast(id AS long) AS id", "cast(year AS int) AS year", "title", "pair")

    return files.through_folder(spark, go)


@query
def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Measures and their summary, written and read again."""
    m = facade.measures(spark, d)

    def go(folder: str) -> DataFrame:
        sinks.json_with_summary(m.select("id", "title", "county"), stats.parse_summary(m), folder)
        total = spark.read.json(f"{folder}/summary").select("total_measures", "measures_with_text")
        return spark.read.schema("id long, title string, county string").json(f"{folder}/measures").crossJoin(F.broadcast(total))  # one row

    return files.through_folder(spark, go)


@query
def backup_copy(spark: SparkSession, d: str) -> DataFrame:
    def go(folder: str) -> DataFrame:
        path = sinks.backup(facade.measures(spark, d), folder, datetime(2024, 2, 3, 4, 5, 6))
        return spark.read.parquet(path).select("id", "title", "percent_yes", F.lit(path.removeprefix(folder)).alias("name"))

    return files.through_folder(spark, go)


@query
def run_log(spark: SparkSession, d: str) -> DataFrame:
    """Three runs: one that ended well, one with errors, one that goes on."""
    at = datetime(2024, 1, 1, 12)

    def go(folder: str) -> DataFrame:
        for run in ("a", "b", "c"):
            sinks.log_run(spark, folder, run, "update", at)
        sinks.log_run(spark, folder, "a", "update", at, "success", datetime(2024, 1, 1, 13), measures_checked=facade.measures(spark, d).count(), new_measures=2)
        sinks.log_run(spark, folder, "b", "update", at, "completed_with_errors", datetime(2024, 1, 1, 13), "3 rows failed", duplicates_found=3)
        log = spark.read.parquet(folder)
        return sinks.last_state(log).select("run_id", "run_type", "status", values.iso(F.col("completed_at")).alias("completed_at"), "error_message", "measures_checked", "new_measures", "duplicates_found")

    return files.through_folder(spark, go)


@query
def export_latest(spark: SparkSession, d: str) -> DataFrame:
    """The export's own cap: the latest measures alone."""

    def go(folder: str) -> DataFrame:
        sinks.export(facade.measures(spark, d).select("id", "year", "title"), folder, "json")
        return spark.read.schema("id long, year int, title string").json(folder)

    return files.through_folder(spark, go)


@query
def first_path(spark: SparkSession, d: str) -> DataFrame:
    found = tables.first_existing(spark, [f"{d}/none.parquet", f"{d}/orders.parquet", f"{d}/nation.parquet"])
    return spark.read.parquet(found).agg(F.count("*").alias("n"))


@query
def metadata_sample(spark: SparkSession, d: str) -> DataFrame:
    """A look at a source's first rows, by its own order."""
    return tables.metadata(as_icpsr(facade.measures(spark, d)), "State", order="row_id")


@query
def parse_summary(spark: SparkSession, d: str) -> DataFrame:
    got = stats.parse_summary(facade.measures(spark, d))
    return got.withColumns({"years_covered": F.concat_ws(",", F.transform("years_covered", lambda x: x.cast("string"))), "counties": F.concat_ws(",", "counties")})


@query
def time_text(spark: SparkSession, d: str) -> DataFrame:
    """Times and numbers as text, and times back from text."""
    text = F.concat(values.iso(F.col("updated_at").cast("timestamp")), F.when(F.col("id") % 5 == 0, " x").otherwise(""))
    back = F.date_format(values.from_iso(text), "yyyy-MM-dd")
    return facade.measures(spark, d).select("id", text.alias("text"), back.alias("back"), values.with_commas(F.col("id") * 1000).alias("commas"), values.truncated(F.col("county"), 4).alias("short"))


@query
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    return filters.first_rows(facade.measures(spark, d).select("id", "title"))


@query
def quick_search(spark: SparkSession, d: str) -> DataFrame:
    return search.quick_search(facade.measures(spark, d), "measure b", limit=30).select("id", "score")


@query
def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A query without words: what the substring search finds, the latest first."""
    return ids(search.quick_search(facade.measures(spark, d), "?", limit=30), "year")


@query
def enrichment_attempts(spark: SparkSession, d: str) -> DataFrame:
    """The measures in need that are tried first, as many as are tried at all."""
    m = facade.keyed(spark, d).withColumn("measure_id", F.col("identifier"))
    return ids(enrich.attempts(m), "year", "kind_rank")


@query
def enrich_measures(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich_measure(facade.measures(spark, d), enrich.known(spark)).select("id", "has_summary", "summary_title")


@query
def cross_source_members(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cross_source_members(facade.keyed(spark, d))


@query
def dedupe_keyless(spark: SparkSession, d: str) -> DataFrame:
    """Some measures have no key, or an empty one: they stay, and are nobody's duplicates."""
    key = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, "").otherwise(F.col("measure_fingerprint"))
    return ids(dedup.dedupe_cross_source(facade.keyed(spark, d).withColumn("measure_fingerprint", key), AS_OF), "is_duplicate", "master_id")


@query
def insert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return upsert.insert(*batch(spark, d))[1]


@query
def insert_result(spark: SparkSession, d: str) -> DataFrame:
    return ids(upsert.insert(*batch(spark, d))[0], "title")


def stored(spark: SparkSession, rows: DataFrame, steps: Callable[[measuretable.MeasureTable], DataFrame]) -> DataFrame:
    """What steps on a stored table of some rows give."""
    return files.through_folder(spark, lambda folder: steps(measuretable.MeasureTable.create(spark, folder, dedup.first_wins(rows), 16)))


@query
def table_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored table after a batch."""
    old, new = batch(spark, d)

    def go(table: measuretable.MeasureTable) -> DataFrame:
        table.upsert(new, AS_OF)
        return table.read().select("id", "yes_votes", "update_count", "is_duplicate", "duplicate_type", "master_id")

    return stored(spark, old, go)


@query
def table_insert(spark: SparkSession, d: str) -> DataFrame:
    """The stored table after rows with new fingerprints came in, and how many there were of each version."""
    old, new = batch(spark, d)

    def go(table: measuretable.MeasureTable) -> DataFrame:
        table.insert(new)
        return table.read().select("id", "title", F.lit("after").alias("version")).unionByName(table.read(1).select("id", "title", F.lit("before").alias("version")))

    return stored(spark, old, go)


@query
def table_run(spark: SparkSession, d: str) -> DataFrame:
    """A batch, some of whose rows lack a source, taken in as a logged run: its entry beside the audit of what it changed."""
    old, new = batch(spark, d)
    new = new.withColumn("data_source", F.when(F.col("id") % 10 == 3, "").otherwise(F.col("data_source")))

    def go(folder: str) -> DataFrame:
        table = measuretable.MeasureTable.create(spark, f"{folder}/table", dedup.first_wins(old), 16)
        sinks.update_run(table, new, f"{folder}/log", "r", AS_OF, datetime(2024, 1, 1))
        log = sinks.last_state(spark.read.parquet(f"{folder}/log"))
        entry = log.select(F.expr("stack(4, 'checked', measures_checked, 'inserted', new_measures, 'updated', updated_measures, 'duplicates', duplicates_found)").alias("part", "n"), "status")
        audit = table.audit().groupBy(F.concat(F.lit("audit "), "field_name").alias("part")).agg(F.count("*").alias("n")).withColumn("status", F.lit(None).cast("string"))
        return entry.select("part", "n", "status").unionByName(audit.select("part", "n", "status"))

    return files.through_folder(spark, go)


@query
def raw_scrape(spark: SparkSession, d: str) -> DataFrame:
    """A raw scrape in a place named by its source and the time, read back."""

    def go(folder: str) -> DataFrame:
        path = sinks.raw_scrape(facade.measures(spark, d).select("id", "title"), folder, "CA SOS", datetime(2024, 2, 3, 4, 5, 6))
        return spark.read.schema("id long, title string").json(path).withColumn("name", F.lit(path.removeprefix(folder)))

    return files.through_folder(spark, go)


@query
def table_restore(spark: SparkSession, d: str) -> DataFrame:
    """A column more, an update by id, another that is taken back."""
    m = facade.keyed(spark, d).withColumn("update_count", F.lit(1))

    def go(table: measuretable.MeasureTable) -> DataFrame:
        table.add_column("reviewed", "string", "no")
        table.update(m.where("id % 6 = 0").select("id", F.lit("New").alias("title"), F.lit("yes").alias("reviewed")), AS_OF)
        table.update(m.where("id % 4 = 0").select("id", F.lit("Lost").alias("title")), AS_OF)
        table.restore(3)
        return table.read().select("id", "title", "reviewed", "update_count")

    return stored(spark, m, go)


@query
def update_by_id(spark: SparkSession, d: str) -> DataFrame:
    m = facade.measures(spark, d).withColumn("update_count", F.lit(1))
    changes = m.where("id % 6 = 0").select("id", F.lit("New").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("x").alias("fingerprint"))
    return upsert.update(m, changes, AS_OF).select("id", "title", "description", "update_count", F.col("updated_at").cast("date").cast("string").alias("updated_at"))


@query
def repository_context(spark: SparkSession, d: str) -> DataFrame:
    """Links whose number and year stand beside them, in an item, an inline element or on the page itself; one holds a block.
    A small row makes a whole page to read, so measures are dealt out evenly first, however few parts they are stored in."""
    html = F.expr("concat('<ul><li>Proposition 9 (1911)</li><li>Proposition ', id, ' <a href=\"/ca_ballot_props/a/b/', id, '\"><b>', coalesce(title, 'None'), '</b></a> (', year, ')</li><li><a href=\"/ca_ballot_props/a/c/', id, '\">Other</a></li></ul><p>Proposition 77 (1900) <b>(', year + 1, ') <a href=\"/ca_ballot_props/a/d/', id, '\">Inner</a></b></p><a href=\"/ca_ballot_props/a/e/', id, '\"><div>Big <i>d</i></div></a>')")
    dealt = facade.measures(spark, d).select("id", "title", "year").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    got = pages.repository_measures(dealt.select("id", html.alias("html")), BASE, page="id")
    return got.select("page", F.col("nth").cast("int").alias("nth"), "measure_text", "year", "pdf_url")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items() if k in QUERIES}
