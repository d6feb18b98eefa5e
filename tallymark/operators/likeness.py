"""Content duplicates by likeness: rows whose texts have nearly the same words.

The likeness of two rows is the Jaccard similarity of their sets of words. Rows with equal sets are one class. Of each class's
words, in the order of how few classes have them, only the first so many count for finding others: two sets that are alike
enough share one of these (prefix filter), are of similar size (length filter), and share enough from where they meet (position
filter). Words among them that over MANY classes have are no keys by themselves: classes with such a word are keyed by two words
of a prefix that is one longer, which sets that are alike share. No two classes meet that don't share a key; what meets is
compared by all of its words."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.operators.match import words
from tallymark.sources.files import settled

MANY = 64


def classes(df: DataFrame, id_: str, text: Column) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of each row with words, and (class_id, said, size) of each class; class_id is its smallest id."""
    rows = settled(df.select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(words(text))).alias("said")).where(F.size("said") > 0))
    found = settled(rows.groupBy("said").agg(F.min("id").alias("class_id")))
    return rows.join(found, "said").select("id", "class_id"), found.select("class_id", "said", F.size("said").alias("size"))


def ordered(found: DataFrame) -> DataFrame:
    """(class_id, size, said): the words of each class, rare ones first."""
    each = found.select("class_id", "size", F.explode("said").alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    got = each.join(counts, "word").groupBy("class_id", "size").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    return got.select("class_id", "size", F.col("w.word").alias("said"))


def pairs(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of classes (class_id, said, size) that are alike, a < b."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be within 0.5 and 1")
    sets = settled(ordered(found))
    # as many words as an alike set has to share with a set of n; the small step is for products like 0.8 * 5
    least = F.ceil(F.col("size") * threshold - 1e-9).cast("int")
    prefix = F.slice("said", F.lit(1), F.col("size") - least + 1)
    posted = settled(sets.select("class_id", "size", F.posexplode(prefix).alias("pos", "word")))
    many = posted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("word")
    single = posted.join(many, "word", "left_anti").select(F.struct("word", F.lit("").alias("other")).alias("key"), "class_id", "size", "pos")
    broad = posted.join(many, "word", "left_semi").select("class_id").distinct()
    longer = F.slice("said", F.lit(1), F.col("size") - least + 2)
    places = F.transform(longer, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    two = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: b["pos"] > a["pos"]), lambda b: F.struct(F.struct(F.least(a["word"], b["word"]).alias("word"), F.greatest(a["word"], b["word"]).alias("other")).alias("key"), a["pos"].alias("pos")))))
    double = sets.join(broad, "class_id", "left_semi").where("size >= 2").select("class_id", "size", F.explode(two).alias("k")).select("k.key", "class_id", "size", "k.pos")
    keyed = single.unionByName(double)
    side = lambda n: keyed.select("key", F.col("class_id").alias(n), F.col("size").alias(f"{n}_size"), F.col("pos").alias(f"{n}_pos"))
    share = F.ceil((F.col("a_size") + F.col("b_size")) * (threshold / (1 + threshold)) - 1e-9)
    met = side("a").join(side("b"), "key").where(
        (F.col("a") < F.col("b")) & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-9)
        & (F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) >= share)
    ).select("a", "b")
    if threshold <= 0.5:
        # one word is alike to that word and another, which share no two; of sets of one word each word has one
        one = sets.where("size = 1").select(F.col("said")[0].alias("word"), F.col("class_id").alias("x"))
        other = sets.where("size = 2").select(F.explode("said").alias("word"), F.col("class_id").alias("y"))
        met = met.unionByName(one.join(other, "word").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    met = met.distinct()
    text = sets.select("class_id", "said")
    both = met.join(text.toDF("a", "a_said"), "a").join(text.toDF("b", "b_said"), "b")
    common = F.size(F.array_intersect("a_said", "b_said"))
    likeness = common / (F.size("a_said") + F.size("b_said") - common)
    return both.select("a", "b", likeness.alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def alike(df: DataFrame, id_: str, text: Column, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, links) of each row with words: its class, and how many other classes are alike."""
    members, found = classes(df, id_, text)
    met = settled(pairs(found, threshold))
    links = met.select(F.col("a").alias("class_id")).unionByName(met.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(links, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


