"""Seeded pseudo-random order that does not depend on partitioning: md5 of a row key and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Column, seed, *salt: Column) -> Column:
    """Hex digest; sort by it to shuffle rows reproducibly in any engine."""
    return F.md5(F.concat_ws("|", key.cast("string"), *[s.cast("string") for s in salt], F.lit(str(seed))))


def hash_number(digest: Column) -> Column:
    """First 13 hex digits as a double: same order as the digest, usable where a number is needed."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def hash_pick(digest: Column, n: Column) -> Column:
    """Integer in [0, n) from a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint"), n.cast("bigint"))
