"""Operator 4: sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard orders the slots of a prime-sized table by its own permutation ``(offset + j * skip) mod size``. The
shards take turns; each claims the next slot of its order that is free, until the table is full, so
shards own equally many slots (give or take one) and few slots move when a shard comes or goes.
A row's key hashes to a slot and the broadcast table names its shard: one look-up, no shuffle, and a hot
key, source or copy group moves nothing, as placement needs no grouping.

Defined cases: a null key is placed like the empty string, equal keys always together; an empty table gives
no rows; other columns pass through unless they are called slot or shard, which are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SIZE = 6553  # prime, about 100 slots a shard


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> list[int]:
    """The shard number of every slot."""
    if not _is_prime(size) or not 1 <= len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("size must be a prime of at least as many slots as there are distinct shards")
    order = [(_number(f"{s}#offset") % size, _number(f"{s}#skip") % (size - 1) + 1) for s in shards]
    table, tried, free = [-1] * size, [0] * len(shards), size
    while True:
        for i, (offset, skip) in enumerate(order):
            while table[slot := (offset + tried[i] * skip) % size] >= 0:
                tried[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """Slot of a key: the first 60 bits of its text's MD5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size).cast("long"))


def table_frame(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard): ``size`` rows, a parameter."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    return spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner")).select(
        F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def assign_shards(df: DataFrame, key: str, *, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> DataFrame:
    """``df`` with the slot and shard of its ``key`` column."""
    placed = df.drop(*(c for c in ("slot", "shard") if c != key)).withColumn("slot", slot_of(df[key], size))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot")


def write_shards(df: DataFrame, key: str, path: str, *, files_per_shard: int = 1, shards: tuple[str, ...] = SHARDS, size: int = SIZE) -> None:
    """Writes one folder per shard; a shard's rows are dealt over ``files_per_shard`` tasks by all their columns."""
    placed = assign_shards(df, key, shards=shards, size=size)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
