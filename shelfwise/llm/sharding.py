"""Placement in shards by a permutation-filled lookup table, in DataFrame operations only.

Each shard has its own preference order over the slots of a prime-sized table: offset and skip from
its name's hash.  The shards take turns, each claiming the first free slot of its order, until the
table is full.  Shards differ by at most one slot, and a shard that goes away gives up its slots
while few others move.  The table's size is a constant, so the table is broadcast
(a row a slot) and a document's place is a hash, a remainder and one probe of a map: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm._common import table

#: Slots of the table; a prime, some hundred times the shards.
SLOTS = 65_537
SHARDS = 256


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Index of the owning shard for each slot."""
    if not _is_prime(slots):
        raise ValueError(f"the table's size must be prime: {slots}")
    if not 0 < len(shards) <= slots:
        raise ValueError(f"between 1 and {slots} shards are needed, not {len(shards)}")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    steps = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        steps.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1))
    owner, at, free = [-1] * slots, [offset for offset, _ in steps], slots
    while free:
        for k, (_, skip) in enumerate(steps):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + skip) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot that a key's hash falls in; a null key has the slot of the empty string."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | None = None, slots: int = SLOTS, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """Adds the slot and the shard of each row.

    Rows with the same key share a shard; a null key counts as the empty string.  Texts are not
    read, so their size does not matter.  An empty frame stays empty.  Columns of the input with
    the names of the added columns are replaced by them; other columns are left alone.
    """
    owner = lookup_table(shards if shards is not None else shard_names(), slots)
    slots_of = df.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(str(owner)), "array<int>")).alias(slot_name, shard_name))
    return df.drop(slot_name, shard_name).withColumn(slot_name, slot_of(F.col(key), slots)).join(F.broadcast(slots_of), slot_name, "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
