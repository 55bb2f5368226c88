"""Placement of documents on shards by a lookup table that the shards' permutations fill."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the lookup table, a prime; also the bound of what is broadcast.
SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Which shard (by its place in the list) owns each slot.

    Every shard prefers the slots in an order of its own: offset, offset + skip, ..., both from a
    hash of its name. The shards take turns and claim their next free slot, so no shard owns over
    one slot more than another, and one shard more or less moves few slots between the others.
    """
    if not shards:
        raise ValueError("no shards")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if slots < len(shards) or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime that is not below the number of shards")
    digests = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    owner, filled = [-1] * slots, 0
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            filled += 1
            if filled == slots:
                return owner


def slot_of(column: str, slots: int = SLOTS):
    """The slot of a key: the first 32 bits of the MD5 of its text, modulo the slots.

    A null key counts as the empty text.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).alias("slot")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Per row: the key, its slot and the shard that owns the slot.

    Rows with equal keys, repeated rows too, go to the same shard; a null key has a shard as well;
    an empty table gives an empty one. Other columns are not looked at. The table of slots has
    ``slots`` rows whatever the data's size, so it is broadcast, and placing a row is one probe.
    """
    spark = docs.sparkSession
    owners = ",".join(map(str, lookup_table(shards, slots)))
    names = F.lit("\x1f".join(shards))
    lookup = spark.range(1).select(
        F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")
    ).select(
        F.col("slot").cast("long").alias("slot"),
        F.element_at(F.split(names, "\x1f"), F.col("owner").cast("int") + 1).alias("shard"),
    )
    keys = docs.select(F.col(key).alias(key), slot_of(key, slots))
    return keys.join(F.broadcast(lookup), "slot").select(key, "slot", "shard")


def place_sql(shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> str:
    """Placement in the same table for DuckDB, over the view ``documents``."""
    owners = ",".join(map(str, lookup_table(shards, slots)))
    return f"""
      WITH owners AS (SELECT string_split('{owners}', ',') AS owner, {shards!r} AS shard),
        slotted AS (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 8))::BIGINT % {slots} AS slot FROM documents)
      SELECT {key}, slot, shard[owner[slot + 1]::INT + 1] AS shard FROM slotted, owners"""
