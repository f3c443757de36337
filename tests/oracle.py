"""Comparison of a Spark result with DuckDB's rows, without regard to order."""

from __future__ import annotations


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value if isinstance(value, int | str) else str(value)


def rows(dicts) -> list:
    return sorted((tuple((k, plain(d[k])) for k in sorted(d)) for d in dicts), key=repr)


def same(df, duck, sql: str) -> None:
    got = duck.sql(sql)
    names = got.columns
    assert sorted(df.columns) == sorted(names)
    assert rows(r.asDict(recursive=True) for r in df.collect()) == rows(dict(zip(names, r, strict=True)) for r in got.fetchall())
