"""Shards by lookup table: shards take turns claiming slots of a prime-sized table."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import free_names

SHARDS = 64
#: Slots per shard: shards then differ by about one slot in a hundred.
SLOTS_PER_SHARD = 100
#: Largest table that is broadcast: 2**22 slots are some 64 MB.
MAX_SLOTS = 1 << 22


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def table_size(shards: int) -> int:
    """The smallest prime of at least ``SLOTS_PER_SHARD`` slots a shard."""
    n = max(2, shards * SLOTS_PER_SHARD)
    while not is_prime(n):
        n += 1
    return n


def preference(name: str, size: int) -> tuple[int, int]:
    """Where a shard's permutation of the slots begins, and its step."""
    digest = hashlib.md5(name.encode()).digest()
    start = int.from_bytes(digest[:8], "big") % size
    return start, int.from_bytes(digest[8:], "big") % (size - 1) + 1


@lru_cache(maxsize=16)
def lookup_table(names: tuple[str, ...], size: int) -> tuple[int, ...]:
    """The shard of each slot.

    Shard i prefers the slots start, start + step, start + 2 * step, ... modulo the prime
    size, a permutation of all slots. Shards take turns, each claiming the free slot it
    likes best, until none is free; their numbers of slots differ by one at most. A shard
    more or less moves few other slots.
    """
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need different names")
    if not is_prime(size) or size < len(names) or size > MAX_SLOTS:
        raise ValueError(f"the table needs a prime size from {len(names)} to {MAX_SLOTS}")
    places = [preference(n, size) for n in names]
    tried = [0] * len(names)
    owner = [-1] * size
    free = size
    while True:
        for shard, (start, step) in enumerate(places):
            slot = (start + tried[shard] * step) % size
            while owner[slot] >= 0:
                tried[shard] += 1
                slot = (start + tried[shard] * step) % size
            owner[slot] = shard
            tried[shard] += 1
            free -= 1
            if not free:
                return tuple(owner)


def shard_names(shards: int) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(shards))


def slot_of(key: Column, size: int) -> Column:
    """60 bits of the key's MD5 modulo the table's size; a NULL key counts as empty."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10)
    return F.pmod(bits.cast("long"), F.lit(size))


def with_shards(
    df: DataFrame, key: str = "doc_id", names: tuple[str, ...] | None = None, size: int = 0
) -> DataFrame:
    """``df`` with the columns slot and shard of each row's key; no row is shuffled.

    The table is broadcast, its size is bounded by ``MAX_SLOTS``. Equal keys, repeated
    rows too, share a shard; NULL keys share the shard of the empty key. Columns of ``df``
    named slot or shard are replaced. An empty table stays empty.
    """
    names = names or shard_names(SHARDS)
    size = size or table_size(len(names))
    owners = lookup_table(names, size)
    t_slot, t_shard = free_names(df, "t_slot", "t_shard")
    table = df.sparkSession.createDataFrame(
        [(slot, names[shard]) for slot, shard in enumerate(owners)],
        f"{t_slot} long, {t_shard} string",
    )
    placed = df.withColumn("slot", slot_of(F.col(key), size))
    return (
        placed.join(F.broadcast(table), F.col("slot") == F.col(t_slot), "left")
        .withColumn("shard", F.col(t_shard))
        .drop(t_slot, t_shard)
    )


def write_shards(sharded: DataFrame, path: str, files: int = 4) -> None:
    """One folder a shard. Rows of a shard are dealt over ``files`` tasks by their content,
    so a key that holds much of the data does not make one task write it all."""
    part = F.pmod(F.xxhash64(*sharded.columns), F.lit(files))
    width = files * sharded.sparkSession.sparkContext.defaultParallelism
    (
        sharded.withColumn("part", part)
        .repartition(width, "shard", "part")
        .drop("part")
        .write.partitionBy("shard")
        .parquet(path)
    )


def oracle(key: str = "doc_id", table: str = "documents", shards: int = SHARDS) -> str:
    """SQL that places keys by the same table."""
    size = table_size(shards)
    owners = ",".join(map(str, lookup_table(shard_names(shards), size)))
    return f"""
    WITH p AS (
      SELECT {key}, CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15))
                         AS BIGINT) % {size} AS slot
      FROM {table}
    )
    SELECT {key}, slot, 'shard-' || lpad(CAST(([{owners}])[slot + 1] AS VARCHAR), 5, '0') AS shard
    FROM p
    """
