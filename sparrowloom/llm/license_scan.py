"""License scan: fuzzy search for short notices in whole texts.

A notice of the table below may occur with up to k edits. Its text is split
into k + 1 pieces; whatever holds the notice with k edits holds one piece
unchanged (pigeonhole), so one Aho-Corasick pass over the normalised text finds
every candidate place. The regex library's bounded-error matching then verifies
the candidates, counts the edits and gives the spans. Notices with k = 0 are
their own only piece.

A few edits make another phrase of a short notice ("omit license", "bad
license"), so an edited match of a notice of up to SHORT words only counts if it
has as many words, each with the notice's first letter, and keeps all letters of words of up to
three letters, in order, and three quarters of longer ones (kept()).

The work is one narrow map over the scan: no shuffle, no state between rows.

Defined results: a null or empty text has no words and no hits; a long text is
scanned whole, in time proportional to its length and its seeds; of a notice's
matches that overlap the leftmost counts, notices that overlap each other count
each; repeated rows and ids give a row each; an empty table gives an empty one;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, bounded_batches, table


class Notice(NamedTuple):
    text: str
    label: str
    edits: int


# The phrases that always count, without edits.
BASE = (
    Notice("gnu general public license", "gpl", 0),
    Notice("apache license", "apache", 0),
    Notice("cc by", "cc-by", 0),
    Notice("mit license", "mit", 0),
)

# Common short notices and the edits allowed in each.
NOTICES = (
    Notice("gnu general public license", "gpl", 2),
    Notice("gnu lesser general public license", "lgpl", 2),
    Notice("gnu affero general public license", "agpl", 2),
    Notice("apache license", "apache", 1),
    Notice("licensed under the apache license version 2 0", "apache", 4),
    Notice("mit license", "mit", 1),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge to any person", "mit", 4),
    Notice("bsd license", "bsd", 1),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("isc license", "isc", 1),
    Notice("boost software license", "bsl", 2),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("creative commons zero", "cc0", 2),
    Notice("free and unencumbered software released into the public domain", "unlicense", 4),
    Notice("all rights reserved", "reserved", 1),
)

#: Words of a notice up to which edits must leave its words as they are to be told.
SHORT = 4

HIT_TYPE = "array<struct<label:string,start_word:bigint,end_word:bigint,start:bigint,end:bigint,edits:int,base:boolean,fit:double>>"
OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_()), ("fit", pa.float64())]))),
    ]
)

#: Separators become a blank and A-Z small letters; other bytes, all of UTF-8's longer characters among them, stay.
_NORMAL = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of the notice's edits + 1 nearly equal parts."""
    n, k = len(notice.text), notice.edits + 1
    at = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=8)
def _search(notices: tuple[Notice, ...]):
    """The automaton over all seeds, and a bounded-error pattern for each notice."""
    import ahocorasick
    import regex

    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(notices):
        for at, piece in pieces(notice):
            seeds.setdefault(piece, []).append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    fuzzy = [regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?= )" if n.edits else rf"(?<= ){regex.escape(n.text, literal_spaces=True)}(?= )") for n in notices]
    return automaton, fuzzy


def find_notices(normal: str, notices: tuple[Notice, ...]) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) in a text of words with a blank before and after each.

    For each notice the result is what its pattern finds from left to right,
    matches not overlapping, as if it ran over the whole text.
    """
    automaton, fuzzy = _search(notices)
    windows: dict[int, list[list[int]]] = {}
    for last, (size, uses) in automaton.iter(normal):
        for i, at in uses:
            k = notices[i].edits
            lo = max(0, last - size + 1 - at - k - 1)
            hi = min(len(normal), last - size + 1 - at + len(notices[i].text) + k + 1)
            windows.setdefault(i, []).append([lo, hi])
    found = []
    for i, own in windows.items():
        own.sort()
        merged: list[list[int]] = []
        for lo, hi in own:
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        for lo, hi in merged:
            for m in fuzzy[i].finditer(normal[lo:hi]):
                found.append((i, lo + m.start(), lo + m.end(), sum(m.fuzzy_counts)))
    return sorted(found)


def distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements that make b of a."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(left + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def kept(notice: str, found: str) -> bool:
    """Whether an edited match still reads as a short notice."""
    words, own = notice.split(" "), found.split(" ")
    if len(words) > SHORT:
        return True

    def same(word: str, other: str) -> bool:
        if word[0] != other[0]:
            return False
        if len(word) <= 3:
            rest = iter(other)
            return all(c in rest for c in word)
        return distance(word, other) <= len(word) // 4

    return len(words) == len(own) and all(map(same, words, own))


def scan_text(text: str | None, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[dict]]:
    words = words_of(text)
    if not words:
        return 0, []
    normal = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    every = base + notices
    found = [f for f in find_notices(normal, every) if not f[3] or kept(every[f[0]].text, normal[f[1] : f[2]])]
    if not found:
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(text)]
    hits = []
    seen, upto = 0, 0
    for i, start, end, edits in sorted(found, key=lambda x: x[1]):
        notice = every[i]
        seen += normal.count(" ", upto, start)
        upto = start
        first = seen - 1
        last = first + normal.count(" ", start, end)
        hits.append({"label": notice.label, "start_word": first, "end_word": last + 1, "start": spans[first][0], "end": spans[last][1], "edits": edits, "base": i < len(base), "fit": 1 - edits / len(notice.text)})
    return len(words), hits


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """A row for each document: key as doc_id, n_words, and hits with label, word span, character span and edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan_text(t.as_py(), base, notices) for t in batch.column(1)]
            yield batch_of(OUT, doc_id=batch.column(0), n_words=[n for n, _ in got], hits=[h for _, h in got])

    return bounded_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id bigint, n_words bigint, hits {HIT_TYPE}")


def digest(found: DataFrame) -> DataFrame:
    own = F.filter("hits", lambda h: h["base"])
    starts = F.transform(own, lambda h: h["start_word"])
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(own).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["fit"])), F.lit(0.0)).alias("score"),
        F.size(F.filter("hits", lambda h: h["edits"] > 0)).cast("bigint").alias("n_edited"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(table(spark, sf_dir, "documents")))
