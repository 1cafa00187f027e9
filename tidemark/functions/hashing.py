"""Hash families of the sketches. MD5 slices are repeatable in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import Bloom, CountMin


def _slice(digest: Column, at: int) -> Column:
    """32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 8), 16, 10).cast("long")


def cms_column(key: Column, row: Column, config: CountMin) -> Column:
    digest = F.md5(F.concat(F.lit(f"{config.seed}-"), row.cast("string"), F.lit("-"), key))
    return F.pmod(_slice(digest, 1), F.lit(config.width)).cast("int")


def cms_cells_of(key: Column, config: CountMin) -> Column:
    """An array of r, c: one cell for each row of the sketch."""
    return F.array(*(F.struct(F.lit(r).alias("r"), cms_column(key, F.lit(r), config).alias("c")) for r in range(config.depth)))


def bloom_key(key: Column, config: Bloom) -> Column:
    """The 64 bits of the key's salted digest that decide all its places in the filter, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{config.seed}-"), key)), 1, 16), 16, -10).cast("long")


def bits_of(key: Column, config: Bloom) -> Column:
    """An array of the places of a `bloom_key`, by double hashing with a quadratic term."""
    h1, h2 = F.shiftrightunsigned(key, 32), key.bitwiseAND(0xFFFFFFFF)
    return F.array(*(F.pmod(h1 + h2 * i + i * i, F.lit(config.bits)) for i in range(config.hashes)))


def bloom_bits(key: Column, config: Bloom) -> Column:
    """An array of the key's bits; the seed salts the digest."""
    return bits_of(bloom_key(key, config), config)
