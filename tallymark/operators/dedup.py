"""Duplicates: groups, the master record of each, merged fields, reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions.keys import filled
from tallymark.functions.values import outcome_of_share, pass_fail, percent
from tallymark.operators.filters import first_per

#: Sources by rank; all others come last.
SOURCE_RANK = {"CA_SOS": 1, "CA_SOS_Scraper": 2, "NCSL": 3, "CEDA": 4, "ICPSR": 5, "UC_Law_SF": 6}
OTHER_RANK = 10
#: Fields that a master takes over from other versions.
MERGED = (
    "description ballot_question summary_title summary_text yes_votes no_votes total_votes percent_yes percent_no passed pass_fail pdf_url "
    "source_url category_type category_topic election_date election_type topic_primary topic_secondary measure_type"
).split()


def source_rank(source: Column) -> Column:
    out = F.lit(OTHER_RANK)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def cross_source_groups(df: DataFrame) -> DataFrame:
    """Measures that several rows describe: how many, from how many sources, their ids and the sources of these, in order."""
    live = df.where(~F.col("is_duplicate") & (F.coalesce("measure_fingerprint", F.lit("")) != ""))
    got = live.groupBy("measure_fingerprint").agg(F.count("*").alias("source_count"), F.countDistinct("data_source").alias("distinct_sources"), F.sort_array(F.collect_list(F.struct("id", "data_source"))).alias("_all"))
    return got.where("source_count > 1").withColumns({"ids": F.col("_all.id"), "sources": F.col("_all.data_source")}).drop("_all")


def cross_source_members(df: DataFrame, key: str = "measure_fingerprint") -> DataFrame:
    """The same groups as a table of members (the key, id, data_source): no group meets in one row."""
    live = df.where(~F.col("is_duplicate") & (F.coalesce(key, F.lit("")) != ""))
    several = live.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return live.join(several, key).select(key, "id", "data_source")


def content_groups(df: DataFrame) -> DataFrame:
    live = df.where(~F.col("is_duplicate") & (F.coalesce("content_hash", F.lit("")) != ""))
    return live.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def first_wins(df: DataFrame, key: str = "fingerprint", order: tuple = ("id",)) -> DataFrame:
    return first_per(df, [key], list(order))


def score(as_of: str) -> Column:
    """How much a version says, and how trusted and fresh it is. `as_of`: the day that ages are counted to."""
    age = F.datediff(F.lit(as_of).cast("date"), F.col("updated_at").cast("date"))
    worth = lambda condition, points: F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)
    return (
        worth(F.col("has_summary"), 100) + worth(F.col("yes_votes").isNotNull(), 50) + worth(F.col("description") != "", 25)
        + worth((F.col("pdf_url") != "") & (F.col("pdf_url") != "#"), 20) + worth(F.col("ballot_question") != "", 15)
        + (OTHER_RANK - source_rank(F.col("data_source"))) * 5 + F.greatest(F.lit(0), F.coalesce(30 - age, F.lit(0)))
    )


#: More than any id has digits for.
BEYOND = Decimal(10) ** 19


def best_first() -> Column:
    """The score and the id as one number, the best version's the greatest: it goes through a hash aggregate."""
    return F.col("score").cast("decimal(17,0)") * F.lit(BEYOND * 10) + (F.lit(BEYOND) - F.col("id").cast("decimal(19,0)"))


def with_master(df: DataFrame, as_of: str, key: str = "measure_fingerprint") -> DataFrame:
    """score, group_size and master_id of each version of its group: the best score, the smallest id of equals. The choice is
    an aggregate with partial sums; a group of any size meets nowhere. A version without a key is a group by itself."""
    own = df.withColumn("score", score(as_of))
    best = own.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.count("*").alias("group_size"), F.max(best_first()).alias("_best"))
    best = best.select(key, "group_size", (F.lit(BEYOND) - F.col("_best") % F.lit(BEYOND * 10)).cast("long").alias("master_id"))
    got = own.drop("master_id").join(best, key, "left")
    return got.withColumns({"group_size": F.coalesce("group_size", F.lit(1).cast("long")), "master_id": F.coalesce("master_id", "id")})


def merge_fields(df: DataFrame, as_of: str, key: str = "measure_fingerprint", fields: list[str] | None = None) -> DataFrame:
    """A row for each group of two versions or more, from one aggregate: the master's fields, gaps filled from the latest version, the better
    source, the smaller id; then votes, shares and outcome made consistent. has_summary follows any version."""
    fields = [f for f in (fields or MERGED) if f in df.columns]
    own = df.where(~F.col("is_duplicate") & (F.coalesce(key, F.lit("")) != "")).withColumn("score", score(as_of))
    first = F.struct("score", -F.col("id"))
    later = F.struct(F.coalesce(F.col("updated_at").cast("string"), F.lit("")).alias("u"), (-source_rank(F.col("data_source"))).alias("r"), (-F.col("id")).alias("i"))
    value = lambda f: filled(f) if dict(df.dtypes)[f] == "string" else F.col(f)
    got = own.groupBy(key).agg(
        F.max_by("id", first).alias("master_id"), F.count("*").alias("versions"), F.collect_set("id").alias("ids"), F.max("has_summary").alias("has_summary"),
        F.max_by(F.struct(*[value(f).alias(f) for f in fields]), first).alias("master"), *[F.max_by(value(f), F.when(value(f).isNotNull(), later)).alias(f) for f in fields],
    ).where("versions > 1")
    merged = F.filter(F.sort_array("ids"), lambda i: i != F.col("master_id")).alias("merged_from")
    best = got.select(key, "master_id", "versions", merged, "has_summary", *[F.coalesce(F.col(f"master.{f}"), F.col(f)).alias(f) for f in fields])
    if {"yes_votes", "no_votes"} <= set(fields):
        total = F.col("yes_votes") + F.col("no_votes")
        sure = total > 0
        share = percent(F.col("yes_votes"), total)
        passed = outcome_of_share(share)
        fixed = {"total_votes": total, "percent_yes": share, "percent_no": percent(F.col("no_votes"), total), "passed": passed, "pass_fail": pass_fail(passed)}
        best = best.withColumns({c: F.when(sure, x).otherwise(F.col(c) if c in fields else F.lit(None)) for c, x in fixed.items()})
    return best


def dedupe_cross_source(df: DataFrame, as_of: str) -> DataFrame:
    """The table after its groups are settled: of each group all but the master become duplicates of it, and the master takes
    the merged values of all versions and their ids (merged_from, a JSON list). Both count as updates of the day: one of a
    duplicate, two of a master, which is merged and then gets its history. Duplicates from before stay as they are."""
    gone = df.where("is_duplicate")
    live = df.where(~F.col("is_duplicate"))
    fields = [f for f in MERGED if f in df.columns]
    merged = merge_fields(live, as_of, fields=fields)
    taken = [f for f in merged.columns if f in df.columns and f not in ("measure_fingerprint", "master_id", "has_summary", "merged_from")]
    history = F.concat(F.lit("["), F.array_join(F.transform("merged_from", lambda x: x.cast("string")), ", "), F.lit("]"))
    best = merged.select(F.col("master_id").alias("id"), F.struct(history.alias("_history"), *taken).alias("_new"))
    own = with_master(live, as_of).join(best, "id", "left")
    master, extra = F.col("_new").isNotNull(), (F.col("group_size") > 1) & (F.col("id") != F.col("master_id"))
    values = {f: F.when(master, F.coalesce(F.col(f"_new.{f}"), F.col(f))).otherwise(F.col(f)).cast(df.schema[f].dataType) for f in taken}
    values |= {"is_duplicate": extra, "duplicate_type": F.when(extra, "cross_source"), "master_id": F.when(extra, F.col("master_id"))}
    values["merged_from"] = F.coalesce(F.col("_new._history"), F.col("merged_from") if "merged_from" in df.columns else F.lit(None).cast("string"))
    if "update_count" in df.columns:
        values["update_count"] = F.coalesce("update_count", F.lit(0)) + F.when(master, 2).when(extra, 1).otherwise(0)
    if "updated_at" in df.columns:
        values["updated_at"] = F.when(master | extra, F.lit(as_of).cast(df.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))
    out = own.withColumns(values).drop("score", "group_size", "_new")
    return out.unionByName(gone.withColumn("master_id", F.col("master_id").cast("long") if "master_id" in df.columns else F.lit(None).cast("long")), allowMissingColumns=True)


def mark_duplicate(df: DataFrame, duplicate_id: int, master_id: int, kind: str) -> DataFrame:
    it = F.col("id") == duplicate_id
    return df.withColumns({"is_duplicate": F.when(it, True).otherwise(F.col("is_duplicate")), "duplicate_type": F.when(it, kind).otherwise(F.col("duplicate_type")), "master_id": F.when(it, F.lit(master_id)).otherwise(F.col("master_id")).cast("long")})


def unmark_duplicate(df: DataFrame, duplicate_id: int) -> DataFrame:
    it = F.col("id") == duplicate_id
    return df.withColumns({"is_duplicate": F.when(it, False).otherwise(F.col("is_duplicate")), "duplicate_type": F.when(~it, F.col("duplicate_type")), "master_id": F.when(~it, F.col("master_id")).cast("long")})


def report(df: DataFrame) -> DataFrame:
    """(part, name, n): duplicates in all, by kind (null: unknown) and by source, in one pass, and how many groups of several
    sources' rows there still are."""
    gone = df.where("is_duplicate").select(F.col("duplicate_type").alias("kind"), F.col("data_source").alias("source"), F.lit(1).alias("one"))
    sums = gone.groupingSets([["kind"], ["source"], ["one"]], "kind", "source", "one").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    part = F.when(F.col("g") == 3, "by_type").when(F.col("g") == 5, "by_source").otherwise("total")
    live = df.where(~F.col("is_duplicate") & (F.coalesce("measure_fingerprint", F.lit("")) != ""))
    groups = live.groupBy("measure_fingerprint").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return sums.select(part.alias("part"), F.coalesce("kind", "source").alias("name"), "n").unionByName(groups.select(F.lit("cross_source_groups").alias("part"), F.lit(None).cast("string").alias("name"), "n"))


def counts(df: DataFrame) -> DataFrame:
    """What a full deduplication would find: rows beyond the first of a fingerprint, of a measure, of a content."""
    live = df.where(~F.col("is_duplicate"))
    beyond = lambda c: (F.count(c) - F.countDistinct(c)).alias
    return live.agg(beyond("fingerprint")("within_source"), beyond("measure_fingerprint")("cross_source"), beyond("content_hash")("content"))


def lineage(df: DataFrame) -> DataFrame:
    """Each duplicate beside its master."""
    own = df.where(F.col("master_id").isNotNull()).select("id", "master_id", "duplicate_type", F.col("data_source").alias("source"))
    return own.join(df.select(F.col("id").alias("master_id"), F.col("data_source").alias("master_source")), "master_id", "left")
