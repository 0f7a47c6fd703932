"""A set of keys in a bitmap of fixed size, to leave out most rows without a partner before a join.

A key that is in the set is never left out. Of the others about a share of the set's size to ``BITS`` stays, which the
join then drops. What reaches the driver and is broadcast is ``BITS / 8`` bytes, whatever the number of keys.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 27
#: Bits in one bitmap of Spark's bitmap functions.
_CHUNK = 1 << 15


def hashed(word: str) -> int:
    """The bit of a string, as ``F.xxhash64`` gives it in Spark."""
    return xxhash.xxh64_intdigest(word.encode(), 42) % BITS


def bitmap_of(keys: DataFrame, number: Column) -> bytes:
    """The bitmap of a table's 64-bit numbers, built by the executors."""
    bit = F.pmod(number, F.lit(BITS))
    parts = keys.where(number.isNotNull()).select(F.floor(bit / _CHUNK).cast("int").alias("chunk"), F.pmod(bit, F.lit(_CHUNK)).alias("at"))
    rows = parts.groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["chunk"] * _CHUNK // 8 : (r["chunk"] + 1) * _CHUNK // 8] = r["bits"]
    return bytes(out)


def has(bits: bytes, number: int) -> bool:
    n = number % BITS
    return bool(bits[n >> 3] >> (n & 7) & 1)
