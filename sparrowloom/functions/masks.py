"""Attention predicates as column expressions of a query's and a key's position, put together freely."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (query, key) -> whether the query sees the key.
Mask = Callable[[Column, Column], Column]


def causal() -> Mask:
    return lambda q, k: k <= q


def banded(window: int) -> Mask:
    """The last `window` keys up to the query."""
    return lambda q, k: (k <= q) & (k > q - window)


def spans(of: Column) -> Mask:
    """Both within one span of an array of (offset, length)."""
    return lambda q, k: F.exists(of, lambda s: (q >= s["offset"]) & (q < s["offset"] + s["length"]) & (k >= s["offset"]) & (k < s["offset"] + s["length"]))


def without_padding(used: Column) -> Mask:
    return lambda q, k: k < used


def any_of(*masks: Mask) -> Mask:
    return lambda q, k: reduce(lambda a, b: a | b, (m(q, k) for m in masks))


def all_of(*masks: Mask) -> Mask:
    return lambda q, k: reduce(lambda a, b: a & b, (m(q, k) for m in masks))


def grown(mask: Mask, length: Column) -> Mask:
    """The mask with one more position: its row copies the last one and sees itself, its column is closed to the others."""
    return lambda q, k: F.when(k == length, q == length).otherwise(mask(F.least(q, length - 1), k))


def seen(mask: Mask, q: Column, length: Column) -> Column:
    """How many of the keys 0 .. length - 1 a query sees."""
    return F.size(F.filter(F.sequence(F.lit(0), length - 1), lambda k: mask(q, k)))
