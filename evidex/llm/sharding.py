"""Sharding by a lookup table of prime size that the shards fill in turns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The shard number of every slot.

    Each shard prefers slots in the order offset, offset + skip, offset + 2 skip, ... modulo the
    prime ``slots``, both numbers from a hash of its name, and in its turn claims the first
    free one. So each gets an equal share but for one slot, and a shard that goes or comes
    moves little else. Names must differ; their order does not matter, as turns go by name.
    """
    if not _prime(slots):
        raise ValueError(f"{slots} is not a prime")
    names = sorted(set(shards))
    if len(names) != len(shards) or not names or len(names) > slots:
        raise ValueError("shards must be 1 to slots different names")
    number = {n: k for k, n in enumerate(shards)}
    draw = [hashlib.sha256(n.encode()).digest() for n in names]
    at = [int.from_bytes(d[:8], "big") % slots for d in draw]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 for d in draw]
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for k, name in enumerate(names[:left] if left < len(names) else names):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = number[name]
            left -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text modulo ``slots``; null counts as empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard) rows of the table; its size is the parameter ``slots``."""
    return spark.createDataFrame([(k, shards[s]) for k, s in enumerate(fill(shards, slots).tolist())], "slot int, shard string")


def place(rows: DataFrame, shards: Sequence[str], key_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``rows`` with the columns slot and shard (in place of any of those names).

    The table, whose size does not depend on the data, is broadcast, so a row finds its shard in one
    look-up and nothing is shuffled. Null keys share one slot; repeated keys go together; empty
    tables stay empty; other columns are kept.
    """
    kept = rows.select(*[c for c in rows.columns if c not in ("slot", "shard")]).withColumn("slot", slot(F.col(key_col), slots))
    table = F.broadcast(lookup(rows.sparkSession, shards, slots))
    return kept.join(table, "slot", "left").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")
