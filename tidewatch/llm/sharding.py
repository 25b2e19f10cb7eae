"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; a row's place is (rank - 1/2) / rows of its source. Sorted by
that place, every stretch holds each source in proportion, so cutting the order into equal pieces gives shards that
all match the mixture. Law `rows`: shard sizes differ by one row at most.

Scale and skew: no window ever spans a source or the table. The hash's first 12 bits split each source into 4096 even
strata, which are ranked on their own and moved by the counts of the strata before; the places are split into
`CUTS` even intervals in the same way. Each shuffle moves a few numbers a row, never the text, and a source with a third of
all rows is dealt like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 8
SEED = 5
#: Intervals of places that are ranked on their own.
CUTS = 4096


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Each row's doc_id, size, text_crc32, law ('rows'), shard, slot (from 0, gapless in a shard) and grown_shard (null).

    size is the text's UTF-8 bytes plus 1; a null text has none, and the checksum of nothing, 0. A null source is a source
    of its own. Repeated rows are rows like any other; where all that orders rows is equal, so are the rows. With
    fewer rows than shards some shards stay empty; an empty table gives an empty result.
    """
    raw = F.encode("text", "UTF-8")
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        (F.coalesce(F.length(raw), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("bigint").alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("h"),
    )
    rows = rows.withColumn("stratum", F.substring("h", 1, 3))
    rows = materialize(rows, "shard-rows")
    order = ["h", "doc_id", "text_crc32", "size"]

    # ranks within a source: those within a stratum, moved by the strata before
    strata = rows.groupBy("source", "stratum").agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("source", "stratum", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"), F.sum("c").over(Window.partitionBy("source")).alias("n"))
    ranked = rows.join(strata, ["source", "stratum"]).withColumn(
        "rank", F.col("offset") + F.row_number().over(Window.partitionBy("source", "stratum").orderBy(*order))
    )
    place = (F.col("rank") - F.lit(0.5)) / F.col("n")
    ranked = materialize(ranked.select(*order, "source", place.alias("place"), F.floor(place * CUTS).cast("int").alias("cut")), "shard-places")

    # the same over the whole order, interval by interval; CUTS rows at most meet in one task
    cuts = ranked.groupBy("cut").agg(F.count("*").alias("c"))
    earlier = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cuts = cuts.select("cut", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"), F.sum("c").over(whole).alias("total"))
    at = F.col("offset") + F.row_number().over(Window.partitionBy("cut").orderBy("place", *order, "source")) - 1
    shard = F.expr(f"cast((at * {shards}) div total as int)")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        ranked.join(cuts, "cut")
        .withColumn("at", at)
        .withColumn("shard", shard)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
