"""Sharding by sampled splitters.

Each record has a 64-bit key: its text's hash in the high half, its row's hash in the low half, so copies of a text
lie side by side and yet can be cut apart. A sample weighted by size gives quantile boundaries of many more ranges
than shards; ranges that turn out overfull (exact sums over all rows) are subdivided at quantiles of their own rows;
shards are runs of ranges with nearly equal bytes. Sizes, counts and slots are exact over all rows.
A null text has no bytes and the checksum of an empty one; a text of any length is one record. Rows that agree in every column
get slots in any order. An empty table gives no rows; other columns, whatever their names, don't matter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallymark.llm.common import cut, pick, utf8_bytes


def boundaries(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Quantiles of a sorted sample whose rows were drawn in proportion to their size."""
    if not len(sample):
        return sample
    return np.unique(sample[(np.arange(1, ranges) * len(sample)) // ranges])


def range_of(cuts: np.ndarray):
    @pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy("int64"), side="right").astype("int32"))

    return find


def shard(docs: DataFrame, shards: int = 24, ranges_per_shard: int = 64, samples_per_range: int = 16, overfull: float = 2.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Law `bytes`: shards of nearly equal size."""
    own = pick(docs, doc_id=doc_id, text=text)
    content = F.coalesce(F.col("text"), F.lit(""))
    high, low = F.xxhash64(content), F.xxhash64(F.col("doc_id").cast("string"), F.lit(1))
    rows = own.select(
        "doc_id", (utf8_bytes(F.col("text")) + 8).alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"),
        (F.shiftleft(F.shiftright(high, 32), 32).bitwiseOR(F.shiftrightunsigned(low, 32))).alias("key"),
    )
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard
    drawn = draw(rows, total, ranges * samples_per_range)
    cuts = boundaries(drawn, ranges)
    placed = rows.withColumn("range", range_of(cuts)("key"))
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    full = [r for r in sums.where(F.col("bytes") > overfull * total / ranges).collect() if r["lo"] < r["hi"]]
    if full:  # at most ranges / overfull of them
        part = placed.where(F.col("range").isin([r["range"] for r in full])).select("key", "size")
        more = draw(part, sum(r["bytes"] for r in full), 4 * samples_per_range * len(full) + ranges)
        cuts = np.unique(np.concatenate([cuts, boundaries(more, 4 * len(full) + ranges // 4)]))
        placed = rows.withColumn("range", range_of(cuts)("key"))
    counts = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    upto = Window.orderBy("range")
    # as many rows as ranges, a number that is set by parameters
    starts = counts.select("range", (F.sum("bytes").over(upto) - F.col("bytes") / 2).alias("middle"))
    where = starts.select("range", F.least(F.floor(F.col("middle") * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    in_shard = placed.join(F.broadcast(where), "range")
    n = in_shard.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = n.select("range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32"))
    numbered = in_shard.withColumn("nth", nth).join(F.broadcast(before), "range")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def draw(rows: DataFrame, total: int, wanted: int) -> np.ndarray:
    """Sorted keys of a sample of about `wanted` rows: each row is drawn with a chance in proportion to its size, by a
    hash of its own, so the same rows are drawn again if a task is run again; rows larger than a step count often."""
    if not total:
        return np.array([], "int64")
    step = max(1.0, total / wanted)
    u = (F.xxhash64("key", F.lit(2)).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    times = F.floor(F.col("size") / F.lit(step) + u).cast("int")
    got = rows.select("key", times.alias("times")).where("times > 0").collect()
    keys = np.array([r["key"] for r in got], "int64")
    return np.sort(np.repeat(keys, [r["times"] for r in got]))
