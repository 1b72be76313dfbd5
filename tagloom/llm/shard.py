"""Shard placement by a permutation-filled lookup table, in DataFrame and SQL functions only.

Every shard has a preference order over the slots of a table of prime size: (offset + j * skip) mod slots, offset and
skip from a digest of its name. Shards take turns, each claiming the first slot of its order that is still free, until
the table is full. A key goes to the shard that holds slot (digest of the key) mod slots: one look-up in a broadcast
table of ``slots`` rows, a size that is a parameter and doesn't grow with the data. Shares differ by a slot at most,
and taking a shard away moves few keys besides its own.

Defined results: a null key is placed as the empty text; equal keys share a shard; an empty table gives none; further
columns are kept, and a column that clashes with ``slot`` or ``shard``, in any case, is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int) -> list[int]:
    """The table: for each slot the place in ``shards`` of the shard that claimed it."""
    if not shards:
        raise ValueError("no shards")
    if slots < len(shards) or slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, not below the number of shards")
    at = [_digest(s, "offset") % slots for s in shards]
    skip = [_digest(s, "skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """md5 of the key as text: its first 15 hexadecimal digits as a number, modulo slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def place(df: DataFrame, shards: list[str], *, slots: int = 65537, key: str = "doc_id") -> DataFrame:
    """df with ``slot`` (int) and ``shard`` (string)."""
    names = F.array(*(F.lit(s) for s in shards))
    claimed = ",".join(map(str, fill(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(claimed), ",")).alias("slot", "__at")).select("slot", F.element_at(names, F.col("__at").cast("int") + 1).alias("shard"))
    keep = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*keep, slot_of(F.col(key), slots).alias("slot")).join(F.broadcast(table), "slot", "left").select(*keep, "slot", "shard")
