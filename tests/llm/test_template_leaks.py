import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from sparrowloom.llm import template_leaks as T

ITEM = "Anna has 12 apples and Ben has 30 apples more than Anna. After 12 days how many apples do they have, if each day 5 kg are sold for 7 dollars?"
NUMBERS = " ".join(str(n) for n in range(100, 140))
TEXTS = {
    1: "Before. " + ITEM + " After it.",
    2: "x " + ITEM.replace("12", "44").replace("30", "9").replace("Ben", "Tom").replace("kg", "lb") + " y",
    4: ITEM.upper(),
    5: "Anna has 12 apples.",
    6: "a clean text about other things " * 20,
    7: " ".join(ITEM.split()[:16]) + " and then other words follow that have nothing to do with it",
    8: "On the 1st page we saw mp3, h2o and covid19. " + ITEM,
    9: "a\u0001b " + ITEM.replace("12", "44"),
    10: ITEM + " And once more: " + ITEM.replace("12 apples", "44 apples").replace("After 12", "After 13"),
}


def found(spark, texts, items):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in T.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}


def test_templates_and_slots(spark):
    got = found(spark, list(TEXTS.items()), [(9, ITEM), (10, "too short"), (11, None)])
    assert got == {(d, 9) for d in (1, 2, 4, 7, 8, 9, 10)}


def test_names_of_every_script(spark):
    item = "вчера Анна купила 12 яблок, а Борис купил 30 груш и отдал Ольге 5 из них за 7 дней до праздника"
    other = item.replace("Анна", "Мария").replace("Борис", "Павел").replace("Ольге", "Łucji").replace("12", "44")
    assert found(spark, [(1, other), (2, "вчера " + " ".join(sorted(other.split())))], [(1, item)]) == {(1, 1)}


def test_slots_that_contradict(spark):
    """One value of the item for many of the document, or the other way round, is chance likeness; equal strings never are."""
    item = "row alpha 5 row beta 5 row gamma 5 row delta 5 row epsilon 5 row zeta 5 end of the table"
    numbers = iter(range(10, 99))
    split = re.sub("5", lambda _: str(next(numbers)), item)
    assert found(spark, [(1, split), (2, item), (3, item.replace("5", "8"))], [(1, item)]) == {(2, 1), (3, 1)}
    assert found(spark, [(1, split), (2, item)], [(1, split)]) == {(1, 1)}
    # A later contradicting copy does not hide an exact one.
    assert found(spark, [(1, f"{item} then {split}"), (2, f"{split} then {item}")], [(1, item)]) == {(1, 1), (2, 1)}


def test_lists_of_numbers_and_short_items(spark):
    others = " ".join(str(7 * n) for n in range(4000))
    items = [(1, NUMBERS), (2, "two words"), (3, "? !")]
    texts = [(1, others), (2, f"so {NUMBERS} so"), (3, "Two  words!"), (4, "two words more"), (5, "..."), (6, None)]
    assert found(spark, texts, items) == {(2, 1), (3, 2)}


UNITS = set(T.UNITS)
LETTER = r"0-9A-Za-z\u0080-\U0010ffff"
CAPITAL = rf"[\p{{Lu}}\p{{Lt}}][\p{{Ll}}\p{{M}}]++(?![{LETTER}])"
NAME = regex.compile(rf"(?<=[\p{{Ll}},;:]) {CAPITAL}(?: {CAPITAL})*+")
NUMBER = re.compile(rf"[0-9]++(?:[.,][0-9]++)*+(?=(?:{'|'.join(sorted(T.UNITS, key=len, reverse=True))})?(?![{LETTER}]))")
WORD = re.compile(rf"[{LETTER}]+")


def words_of(text):
    """(type or None, string) for every word."""
    out, at = [], 0
    while at < len(text):
        name, number, word = (p.match(text, at) for p in (NAME, NUMBER, WORD))
        hit = name or number or word
        if not hit:
            at += 1
            continue
        at = hit.end()
        value = hit[0].strip().lower()
        kind = "name" if name else "number" if re.fullmatch(r"[0-9]+([.,][0-9]+)*", value) else "unit" if value in UNITS and out and out[-1][0] == "number" else None
        out.append((kind, value))
    told = []
    for i, (kind, value) in enumerate(out):
        literal = any(k is None for k, _ in out[max(0, i - 2) : i + 3])
        told.append((kind, None) if kind and literal else ("string", value))
    return told, [v for _, v in out]


def share_contradicts(slots):
    """slots: (type, item value, document value)."""
    for a, b in ((1, 2), (2, 1)):
        most = {}
        for pair, n in Counter((s[0], s[a], s[b]) for s in slots).items():
            most[pair[:2]] = max(most.get(pair[:2], 0), n)
        if sum(most.values()) < 0.5 * len(slots):
            return True
    return False


def runs(marks):
    return [len(r) for r in "".join("1" if m else "0" for m in marks).split("0")]


def is_leak(doc, item):
    (d, d_values), (w, w_values) = words_of(doc), words_of(item)
    if not d or not w or min(len(d), len(w)) < 5 and len(d) != len(w):
        return False
    size = min(5, len(w))
    grams = lambda x: [tuple(x[i : i + size]) for i in range(len(x) - size + 1)]
    held, own = grams(d), grams(w)
    spots = {}
    for i, g in enumerate(held):
        spots.setdefault(g, []).append(i)
    coverage = sum(g in spots for g in own) / len(own)
    views, longest = {}, 0
    for g in set(own):
        for i in spots.get(g, []):
            shift = i - own.index(g)
            if shift in views:
                continue
            at = lambda side, p, shift=shift: side[p + shift] if 0 <= p + shift < len(side) else None
            marks, same = [at(d, p) == w[p] for p in range(len(w))], [at(d_values, p) == w_values[p] for p in range(len(w))]
            enough = lambda m: max(runs(m)) >= 13 or sum(max(0, r - size + 1) for r in runs(m)) >= 0.8 * len(own)
            longest = max(longest, *runs(marks))
            under = [any(all(marks[q : q + size]) for q in range(max(0, p - size + 1), min(p, len(w) - size) + 1)) for p in range(len(w))]
            slots = {p: (w[p][0], w_values[p], d_values[p + shift]) for p in range(len(w)) if under[p] and w[p][1] is None}
            views[shift] = (sum(max(0, r - size + 1) for r in runs(marks)), enough(marks), enough(same), slots)
    if coverage < 0.8 and longest < 13:
        return False
    if any(v[2] for v in views.values()):
        return True
    reaching = [v[3] for v in views.values() if v[1]]
    if not reaching:
        together = {}
        for shift, v in sorted(views.items(), key=lambda x: (-x[1][0], x[0])):
            for p, slot in v[3].items():
                together.setdefault(p, slot)
        reaching = [together]
    return not all(share_contradicts(list(s.values())) for s in reaching)


def brute(docs, items):
    """Every document with every item, by the definition."""
    return {(doc, item) for item, text in items for doc, body in docs if text is not None and body is not None and is_leak(body, text)}


def test_equals_brute_force(spark):
    docs, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in T.leaks(docs.select("doc_id", "text"), items).collect()}
    own = [(r.item_id, r.text) for r in items.collect()]
    # Only documents that share a window with an item can hold it; the definition is asked about those.
    grams = lambda t: set(zip(*(words_of(t)[0][i:] for i in range(5)), strict=False))
    every = set().union(*(grams(t) for _, t in own))
    want = brute([(r.doc_id, r.text) for r in docs.collect() if r.text and (grams(r.text) & every)], own)
    assert len(want) > 10 and got == want


@pytest.mark.parametrize("few", [True, False])
def test_random_texts_equal_brute_force(spark, few, monkeypatch):
    """Numbers, units, names, odd separators, repeats and changed copies, with broadcast and with shuffled windows."""
    if not few:
        monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    pool = ["so", "we", "took", "the", "red", "1st", "mp3", "5kg", "3.14", "7", "7", "12", "kg", "days", "Anna", "Ben Lee", "McDonald", "É", "Łódź", "Анна", "мы", "Ελένη", "x\u0001y", "übel", "and"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", " ", " ", ", ", ". ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 8, 20, 40]))) for i in range(40)]
    docs = []
    for i in range(260):
        item = rng.choice(items)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            item[rng.randrange(len(item))] = rng.choice(pool)
        docs.append((i, rng.choice(["", "we saw ", text(6)]) + " ".join(item) + rng.choice(["", " after it", text(9)])))
    want = brute(docs, items)
    assert 60 < len(want) < 2500 and found(spark, docs, items) == want


def test_ties_long_texts_and_extra_columns(spark):
    long = "red blue green " * 60_000 + ITEM
    rows = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (1, "other words are here now", "b"), (None, ITEM, "c"), (None, "no", "d")], "doc_id bigint, text string, item string").withColumns({c: F.lit("clash") for c in ("doc", "words", "row", "d_id", "form", "salt", "shift")})
    items = spark.createDataFrame([(9, ITEM, 1), (9, ITEM, 2), (9, "something else entirely is asked here", 3), (None, ITEM, 4)], "item_id bigint, text string, doc_id int")
    kept = T.drop_leaks(rows, items)
    assert kept.columns == rows.columns and sorted(r.text for r in kept.collect()) == ["no", "other words are here now"]


def test_shuffled_side_and_odd_rows(spark, sf_dir, documents, odd, empty, monkeypatch):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    few = T.drop_leaks(documents, items).count()
    monkeypatch.setattr(T, "BROADCAST_ROWS", 0)
    assert T.drop_leaks(documents, items).count() == few < documents.count()
    rows = odd.unionByName(odd.limit(1).withColumn("text", F.lit(items.first().text)).withColumn("doc_id", F.lit(77).cast("bigint")))
    kept = T.drop_leaks(rows, items)
    assert kept.columns == rows.columns and kept.count() == odd.count()
    assert T.drop_leaks(empty, items).count() == 0 and T.drop_leaks(odd, items.limit(0)).count() == odd.count()
