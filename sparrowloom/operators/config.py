"""Configuration trees as rows of dotted keys."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bound


class _Number(str):
    """A number as it was written."""


def leaves(text: str | None) -> Iterator[tuple[str, str | None, str]]:
    """(path, value, kind) of a JSON text's leaves, in its order; kind is string, number, boolean or null."""
    if text is None:
        yield "", None, "null"
        return
    try:
        tree = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except (ValueError, RecursionError):
        yield "", text, "string"
        return
    todo = [("", tree)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict | list):
            entries = node.items() if isinstance(node, dict) else enumerate(node)
            todo += reversed([(f"{path}.{k}" if path else str(k), v) for k, v in entries])
        elif isinstance(node, bool):
            yield path, str(node).lower(), "boolean"
        else:
            yield path, node, "null" if node is None else "number" if isinstance(node, _Number) else "string"


def flatten_json(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, path, value, kind) for every leaf of a JSON document of any depth.

    Arrays count as objects with their indices as keys. Objects and arrays
    without entries have no leaf. A string stays a leaf, whatever it looks like;
    numbers are as they were written. A text that is no JSON is one string, a null one a null.
    One map over the rows: nothing is shuffled, and no job runs while the plan is made.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *leaf) for i, text in enumerate(batch.column(len(keys)).to_pylist()) for leaf in leaves(text)]
            at, *made = zip(*found, strict=True) if found else ([], [], [], [])
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(place) for i in range(len(keys))), *(pa.array(m, pa.string()) for m in made)], names=[*keys, "path", "value", "kind"])

    return rows.select(*keys, F.col(column).alias("_document")).mapInArrow(flat, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "path string", "value string", "kind string"]))


def sorted_state(state):
    """A map column's entries, a line each, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(state)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def merge(base, override):
    """Two map columns; the second's values win."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))
    return F.map_concat(kept, override)


REFERENCE = r"\$\{([^{}]+)\}"


def resolve(value, settings):
    """value with every ${key} replaced by its setting, and those in the settings' values too; unknown ones stay, settings that name each other in a circle fail."""

    def of(own):
        known = lambda names: F.exists(names, lambda n: F.map_contains_key(own, n))
        names_in = lambda text: F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
        found = lambda n: F.when(F.map_contains_key(own, n), F.coalesce(F.element_at(own, n), F.lit(""))).otherwise(F.concat(F.lit("${"), n, F.lit("}")))

        def once(text, _):
            filled = lambda names: F.array_join(F.zip_with(F.split(text, REFERENCE, -1), names, lambda part, n: F.concat(part, F.when(n.isNull(), F.lit("")).otherwise(found(n)))), "")
            return bound(names_in(text), lambda names: F.when(known(names), filled(names)).otherwise(text))

        # A chain names each setting once at most.
        done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), value, once)
        circle = F.raise_error(F.concat(F.lit("settings refer to each other in a circle: "), value))
        return bound(done, lambda text: F.when(known(names_in(text)), circle).otherwise(text))

    # Made once for each row, whatever expression the settings are.
    return bound(settings, of)
