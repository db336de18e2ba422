"""Placement of documents on shards by a lookup table that the shards fill in turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.common import column

# A prime, at least a hundred times the number of shards for an even share; it bounds the table that is broadcast.
SLOTS = 16381
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def digest(text: Column, first: int, modulus: int) -> Column:
    """Eight hexadecimal digits of the md5 as a number below `modulus`."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("bigint") % modulus


def preferences(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Each shard's offset and step; offset + j * step modulo a prime runs through every slot once."""
    names = spark.createDataFrame([(i, s) for i, s in enumerate(shards)], "turn int, shard string")
    return names.withColumns(
        {"start": digest(F.col("shard"), 1, slots), "step": digest(F.col("shard"), 9, slots - 1) + 1}
    )


def claim(order: Sequence[tuple[int, int]], slots: int = SLOTS) -> list[int]:
    """Which shard owns each slot: in turns, each takes the first slot of its order that is still free."""
    if not order:
        raise ValueError("no shards")
    owner, cursor, left = [-1] * slots, [start for start, _ in order], slots
    while left:
        for shard, (_, step) in enumerate(order):
            at = cursor[shard]
            while owner[at] >= 0:
                at = (at + step) % slots
            owner[at], cursor[shard] = shard, (at + step) % slots
            left -= 1
            if not left:
                break
    return owner


def lookup(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard), one row per slot. Its size depends on `slots` alone, never on the data."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} is not a prime")
    order = [(r["start"], r["step"]) for r in preferences(spark, shards, slots).orderBy("turn").collect()]
    filled = [(slot, shards[owner]) for slot, owner in enumerate(claim(order, slots))]
    return spark.createDataFrame(filled, "slot bigint, shard string")


def place(
    docs: DataFrame, id_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """`docs` with slot and shard added (replacing columns of these names).

    A row's slot is a hash of its id, so copies of an id go together and a hot source spreads over all shards; a null id
    takes the slot of the text 'null'. When a shard leaves, few rows of the other shards move. An empty table gives an
    empty result. The table of slots is broadcast: `slots` rows, whatever the data.
    """
    name = F.coalesce(column(id_col).cast("string"), F.lit("null"))
    plain = docs.drop(*[c for c in ("slot", "shard") if c in docs.columns and c != id_col])
    return plain.withColumn("slot", digest(name, 1, slots)).join(F.broadcast(lookup(docs.sparkSession, shards, slots)), "slot")
