"""Reproducible draws: a number in [0, 1) from a key and a salt, equal on every engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column, salt: str) -> Column:
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def choice(key: Column, salt: str, n: Column | int) -> Column:
    """An integer from 0 to n - 1."""
    return F.floor(uniform(key, salt) * n).cast("int")


def uniform_sql(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || ':{salt}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
