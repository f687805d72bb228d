"""Bloom filters as tables of bitmaps of 4 KB, built and looked up with SQL functions.

A key has two bits, one in each half of the filter.  A filter never has more than ``MAX_BITS`` bits
(256 MB), whatever the input, so it can be broadcast; with more keys it only lets more rows pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmine.llm.common import settle

BITS_PER_KEY = 16
MAX_BITS = 1 << 31
BLOCK_BITS = 1 << 15  # of a bitmap of `bitmap_construct_agg`


def half_size(n_keys: int, max_bits: int = MAX_BITS) -> int:
    """Bits in each half: a power of two, 8 to 16 for each key within the limit."""
    wanted = max(BLOCK_BITS, BITS_PER_KEY // 2 * n_keys)
    return min(1 << (wanted - 1).bit_length(), max_bits // 2)


def key_bits(key: Column, half: int) -> list[Column]:
    return [
        F.pmod(F.xxhash64(F.lit(salt), key), F.lit(half)) + F.lit(salt * half) for salt in (0, 1)
    ]


def filter_blocks(bits: DataFrame) -> DataFrame:
    """A filter, ``block, bitmap``, of the numbers in the column ``bit``."""
    return settle(
        bits.groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).agg(
            F.expr(f"bitmap_construct_agg(bit % {BLOCK_BITS})").alias("bitmap")
        ),
        "bloom",
    )


def look_up(rows: DataFrame, key: Column, blocks: DataFrame, half: int, name: str) -> DataFrame:
    """Adds ``name``: whether both bits of the key are set.  NULL keys are never found."""
    found = rows
    for i, bit in enumerate(key_bits(key, half)):
        # At most MAX_BITS / 8 bytes.
        block = F.broadcast(blocks.selectExpr(f"block AS _block{i}", f"bitmap AS _bitmap{i}"))
        found = found.withColumn(f"_bit{i}", bit)
        found = found.join(block, F.expr(f"_bit{i} div {BLOCK_BITS}") == F.col(f"_block{i}"), "left")
    is_set = [
        f"shiftright(CAST(conv(hex(substring(_bitmap{i}, "
        f"CAST(_bit{i} % {BLOCK_BITS} div 8 AS int) + 1, 1)), 16, 10) AS int), "
        f"CAST(_bit{i} % 8 AS int)) & 1 = 1"
        for i in (0, 1)
    ]
    both = F.coalesce(F.expr(" AND ".join(is_set)), F.lit(False)) & key.isNotNull()
    return found.select(*[F.col(c) for c in rows.columns], both.alias(name))


def split_by_keys(
    rows: DataFrame, key: str, wanted: DataFrame, n_wanted: int
) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` is maybe among the column ``key`` of ``wanted``, and all others.

    Moves no row; about one row in fifty is among the first without need.  NULL is maybe wanted.
    """
    half = half_size(n_wanted)
    bits = wanted.select(F.explode(F.array(*key_bits(F.col(key), half))).alias("bit"))
    found = look_up(rows, F.col(key), filter_blocks(bits), half, "_maybe")
    maybe = F.col("_maybe") | F.col(key).isNull()
    return found.where(maybe).drop("_maybe"), found.where(~maybe).drop("_maybe")
