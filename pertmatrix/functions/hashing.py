"""Seeded, engine-independent draws: md5 of seed and key text, the same on every run and retry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 15  # 60 bits: far above any pool size, and inside a bigint


def seed_hash(seed: int | str | Column, *keys: str | Column) -> Column:
    """Hex md5 of 'seed:key1:key2...'. Sorting by it is a seeded uniform shuffle."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols]))


def draw_index(hash_hex: Column, n: Column) -> Column:
    """A uniform index in [0, n) from a hex hash."""
    return F.pmod(F.conv(F.substring(hash_hex, 1, _HEX_DIGITS), 16, 10).cast("bigint"), n)
