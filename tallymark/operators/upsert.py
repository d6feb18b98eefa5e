"""Batches against what is there: classification, updates, upserts, audits. Set-based; the write is the only action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.dedup import first_wins
from tallymark.operators.filters import has_new_data, would_update
from tallymark.sources.files import settled

#: Fields whose new values make an update.
WATCHED = ["summary_text", "yes_votes", "no_votes", "percent_yes", "passed", "pdf_url", "description"]
KEYS = {"exact": "fingerprint", "content": "content_hash", "cross_source": "measure_fingerprint"}


def _key_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row a key, so no join multiplies rows: the smallest id that has it. Empty keys match nothing."""
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(F.col(key).alias(f"_{name}")).agg(F.min("id").alias(name))


def classify(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with match_type and matched_id: exact (fingerprint), else content, else cross_source, else none. Content and
    cross-source matches count among rows that are no duplicates; each join is outer with a unique side. The table is read
    once, for its ids and keys."""
    have = settled(existing.select("id", "is_duplicate", *KEYS.values()))
    live = have.where(~F.col("is_duplicate"))
    out = incoming
    for name, key in KEYS.items():
        known = _key_map(have if name == "exact" else live, key, name)
        out = out.join(known, out[key] == known[f"_{name}"], "left").drop(f"_{name}")
    match = F.lit("none")
    for name in reversed(KEYS):
        match = F.when(F.col(name).isNotNull(), name).otherwise(match)
    return out.withColumns({"match_type": match, "matched_id": F.coalesce(*KEYS)}).drop(*KEYS)


def first_masters(rows: DataFrame) -> DataFrame:
    """id and keys of the rows that come in as masters when the batch goes by its ids: a row is one if no earlier master has
    its content or its measure. Empty keys are shared with nobody. In each round the open rows that are first by both keys
    become masters, and the open rows that share a key with one go; a round costs three aggregates with partial sums."""
    keys = ("content_hash", "measure_fingerprint")
    # of rows with equal keys only the first can be a master; rows without a key stay apart
    both = F.when((F.coalesce(F.col(keys[0]), F.lit("")) == "") & (F.coalesce(F.col(keys[1]), F.lit("")) == ""), F.col("id"))
    open_ = rows.select("id", *[F.nullif(F.col(k), F.lit("")).alias(k) for k in keys], both.alias("_own"))
    open_ = settled(open_.groupBy(*keys, "_own").agg(F.min("id").alias("id")).drop("_own"))
    masters = None
    while not open_.isEmpty():
        first = lambda k: open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("id")).select("id").unionByName(open_.where(F.col(k).isNull()).select("id"))
        new = settled(open_.join(first(keys[0]), "id", "left_semi").join(first(keys[1]), "id", "left_semi"))
        masters = new if masters is None else masters.unionByName(new)
        left = open_.join(new.select("id"), "id", "left_anti")
        for k in keys:
            left = left.join(new.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        open_ = settled(left.select("id", *keys))
    return open_ if masters is None else masters


def sorted_in(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of a batch, taken in the order of its ids: the first row of each fingerprint with `fate` (updated,
    duplicate, inserted), `kind` and `master` of duplicates, and matched_id of updates. A row that is no update is a
    duplicate of the first row that is none and has its content, else its measure, in the table or earlier in the batch."""
    found = settled(classify(existing, settled(first_wins(incoming))))
    fresh = found.where("match_type <> 'exact'")
    masters = first_masters(fresh.where("match_type = 'none'"))
    for name in ("content", "cross_source"):
        found = found.join(_key_map(masters, KEYS[name], f"b_{name}"), F.col(KEYS[name]) == F.col(f"_b_{name}"), "left").drop(f"_b_{name}")
    exact = F.col("match_type") == "exact"
    earlier = {n: ~exact & F.coalesce(F.col(f"b_{n}") < F.col("id"), F.lit(False)) for n in ("content", "cross_source")}
    kind = F.when(F.col("match_type") == "content", "content").when(earlier["content"], "content").when(F.col("match_type") == "cross_source", "cross_source").when(earlier["cross_source"], "cross_source")
    master = (
        F.when(F.col("match_type") == "content", F.col("matched_id")).when(earlier["content"], F.col("b_content"))
        .when(F.col("match_type") == "cross_source", F.col("matched_id")).when(earlier["cross_source"], F.col("b_cross_source"))
    )
    fate = F.when(exact, "updated").when(kind.isNotNull(), "duplicate").otherwise("inserted")
    return found.withColumns({"fate": fate, "kind": kind, "master": master.cast("long")}).drop("b_content", "b_cross_source")


def new_measures(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Neither their fingerprint nor their content is there."""
    live = existing.where(~F.col("is_duplicate"))
    return incoming.join(existing.select("fingerprint"), "fingerprint", "left_anti").join(live.select("content_hash"), "content_hash", "left_anti").select(incoming.columns)


def matched(existing: DataFrame, incoming: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(old, new) structs of incoming rows with an exact or content match. found: the classified rows, if they are known."""
    found = (classify(existing, incoming) if found is None else found).where(F.col("match_type").isin("exact", "content"))
    new = found.select("matched_id", F.struct(*incoming.columns).alias("new"))
    old = existing.select(F.col("id").alias("matched_id"), F.struct(*existing.columns).alias("old"))
    return new.join(old, "matched_id")


def potential_updates(existing: DataFrame, incoming: DataFrame, fields: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """new id, old id, whether it has new data, whether it would bring a summary or a document."""
    pairs = matched(existing, incoming, found)
    return pairs.select(F.col("new.id").alias("id"), F.col("matched_id").alias("old_id"), has_new_data("old", "new", fields or WATCHED).alias("has_new_data"), would_update("old", "new").alias("would_update"))


def check_updates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New, updated and unchanged rows of each source and, with a null source, in all. The batch is classified once."""
    found = settled(classify(existing, incoming))
    flags = potential_updates(existing, incoming, found=found).select("id", "has_new_data")
    got = found.select("id", "data_source", "match_type").join(flags, "id", "left")
    known = F.col("match_type").isin("exact", "content")
    return got.rollup("data_source").agg(
        F.count_if(~known).alias("new"), F.count_if(known & F.coalesce("has_new_data", F.lit(False))).alias("updates"), F.count_if(known & ~F.coalesce("has_new_data", F.lit(False))).alias("unchanged"),
    )


def upsert(existing: DataFrame, incoming: DataFrame, as_of: str) -> DataFrame:
    """The table after the batch. Exact matches update the old row (new values where there are any; id, keys and creation
    stay; update_count grows); all others come in, duplicates marked with the row that they repeat, as sorted_in() says.
    Rows of a batch that share a fingerprint count once, the first by id."""
    existing = settled(existing)
    found = settled(sorted_in(existing, incoming))
    return updated(existing, found, as_of).unionByName(coming_in(existing.columns, found), allowMissingColumns=True)


def updated(existing: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """Rows of the table with what a sorted batch has for them."""
    stay = {"id", "fingerprint", "measure_fingerprint", "content_hash", "created_at", "update_count", "is_active", "is_duplicate", "duplicate_type", "master_id"}
    fields = [c for c in existing.columns if c in found.columns and c not in stay]
    news = found.where("fate = 'updated'").select(F.col("matched_id").alias("id"), F.struct(*fields).alias("new"))
    joined = existing.join(news, "id", "left")
    hit = F.col("new").isNotNull()
    values = {c: F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in fields}
    if "updated_at" in existing.columns:
        values["updated_at"] = F.when(hit, F.lit(as_of).cast(existing.schema["updated_at"].dataType)).otherwise(F.col("updated_at")).alias("updated_at")
    return joined.select([values.get(c, F.col(c)) if c != "update_count" else (F.col(c) + hit.cast("int")).alias(c) for c in existing.columns])


def coming_in(columns: list[str], found: DataFrame) -> DataFrame:
    """The rows of a sorted batch that are new to the table."""
    fresh = found.where("fate <> 'updated'").withColumns({"duplicate_type": F.col("kind"), "master_id": F.col("master"), "is_duplicate": F.col("kind").isNotNull()})
    return fresh.select([c for c in columns if c in fresh.columns])


def insert(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table with the new rows, the conflicts): a fingerprint is there once. Rows whose fingerprint is there already, or in
    an earlier row of the batch, don't come in; the conflicts name them and the row that was first. Rows without a
    fingerprint conflict with nothing."""
    incoming = settled(incoming)
    first = _key_map(existing, "fingerprint", "there").unionByName(_key_map(incoming, "fingerprint", "there").withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = first.groupBy(F.col("_there").alias("_key")).agg(F.min_by("there", F.coalesce("_new", F.lit(0))).alias("kept_id"), F.min(F.coalesce("_new", F.lit(0))).alias("_new"))
    met = settled(incoming.join(first, incoming["fingerprint"] == first["_key"], "left"))
    clash = F.coalesce((F.col("_new") == 0) | (F.col("kept_id") != F.col("id")), F.lit(False))
    conflicts = met.where(clash).select("id", "fingerprint", "kept_id", F.concat(F.lit("Measure already exists: "), "fingerprint").alias("message"))
    fresh = met.where(~clash).select([c for c in existing.columns if c in incoming.columns])
    return existing.unionByName(fresh, allowMissingColumns=True), conflicts


#: What an update by id leaves alone.
KEPT = ["id", "fingerprint", "created_at"]


def update(existing: DataFrame, changes: DataFrame, as_of: str) -> DataFrame:
    """The table after updates by id (changes: id and any columns, one row an id): every given column is set, to null as well;
    updated_at is the given day and update_count grows."""
    fields = [c for c in changes.columns if c in existing.columns and c not in [*KEPT, "updated_at", "update_count"]]
    joined = existing.join(changes.select("id", F.struct(F.lit(True).alias("_hit"), *fields).alias("_new")), "id", "left")
    hit = F.col("_new").isNotNull()
    values = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(existing.schema[c].dataType) for c in fields}
    if "updated_at" in existing.columns:
        values["updated_at"] = F.when(hit, F.lit(as_of).cast(existing.schema["updated_at"].dataType)).otherwise(F.col("updated_at"))
    if "update_count" in existing.columns:
        values["update_count"] = F.coalesce("update_count", F.lit(0)) + hit.cast("int")
    return joined.select([values.get(c, F.col(c)).alias(c) for c in existing.columns])


def upsert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What a batch does, in one row: inserted, updated, duplicates (no row is two of these) and repeated (in the batch itself)."""
    fates = sorted_in(existing, incoming).agg(*[F.count_if(F.col("fate") == f).alias(n) for f, n in (("inserted", "inserted"), ("updated", "updated"), ("duplicate", "duplicates"))])
    return fates.crossJoin(F.broadcast(incoming.agg(F.count("*").alias("all")))).select("inserted", "updated", "duplicates", (F.col("all") - F.col("inserted") - F.col("updated") - F.col("duplicates")).alias("repeated"))


def rejects(df: DataFrame) -> DataFrame:
    """Rows that can't be kept: without a year or a source."""
    return df.where(F.col("year").isNull() | (F.coalesce("data_source", F.lit("")) == ""))


def kept(df: DataFrame) -> DataFrame:
    """The others."""
    return df.where(F.col("year").isNotNull() & (F.coalesce("data_source", F.lit("")) != ""))


def changes_of(pairs: DataFrame, fields: list[str], source: Column) -> DataFrame:
    """A row for each of the fields that differs in pairs (matched_id, old, new) and has a new value."""
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    changes = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), text("old", f).alias("old_value"), text("new", f).alias("new_value")) for f in fields]))
    rows = pairs.select(F.col("matched_id").alias("measure_id"), source.alias("update_source"), changes.alias("c"))
    return rows.select("measure_id", "c.field_name", "c.old_value", "c.new_value", "update_source").where("new_value IS NOT NULL AND NOT (old_value <=> new_value)")


def change_audit(existing: DataFrame, incoming: DataFrame, fields: list[str] | None = None, source: Column | None = None) -> DataFrame:
    """A row for each field that an exact match changes: measure_id, field_name, old_value, new_value, update_source."""
    return changes_of(matched(existing, incoming), fields or WATCHED, source if source is not None else F.col("new.data_source"))
