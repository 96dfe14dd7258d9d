"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: start + i * step modulo the size, start and step
from a hash of its name. Shards take turns, each claiming its next free preference, until the table is full; so shares
differ by at most one slot, and taking a shard away moves few keys besides its own. A row's slot is a hash of its key
modulo the table size, and its shard is looked up in the table, whose size is a parameter: the broadcast never grows
with the data. The fill is a loop over slots on the driver; placement is DataFrame functions only.

Defined results: a null key is placed as the text "null"; equal keys go to one shard, whatever the other columns hold;
an empty table gives no rows. `spread` writes a shard in several files where one key or shard is hot.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Production parameters: a prime over a hundred times the shards.
TABLE_SIZE = 65_537
SHARDS = 64


def hash60(text: str) -> int:
    """The first 15 hex digits of the MD5: a hash that Spark, DuckDB and Python all have."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def fill(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in names) of each slot."""
    if size < 3 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be an odd prime")
    if not 0 < len(names) <= size:
        raise ValueError("there must be shards, and no more than slots")
    at = [hash60(f"start:{n}") % size for n in names]
    step = [hash60(f"step:{n}") % (size - 1) + 1 for n in names]
    table, free = [-1] * size, size
    while True:
        for shard in range(len(names)):
            slot = at[shard]
            while table[slot] >= 0:
                slot = (slot + step[shard]) % size
            table[slot] = shard
            at[shard] = (slot + step[shard]) % size
            free -= 1
            if not free:
                return table


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """The filled table as (slot, shard), made by SQL from one literal."""
    literal = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(literal).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("long"))


def place(df: DataFrame, key: str, *, names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """df with its slot and shard (under names that clash with none of its columns)."""
    names = shard_names() if names is None else names
    slot, shard = fresh(df, "slot"), fresh(df, "shard")
    table = lookup(df.sparkSession, fill(names, size)).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")
    return df.withColumn(slot, F.pmod(hashed, F.lit(size))).join(F.broadcast(table), slot)


def spread(placed: DataFrame, path: str, *, shard: str = "shard", pieces: int = 8) -> None:
    """Write one folder a shard, each shard in several files by row content, so that no task holds a whole shard."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(pieces))
    placed.repartition(shard, salt).write.partitionBy(shard).parquet(path)
