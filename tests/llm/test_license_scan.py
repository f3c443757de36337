import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowloom.llm import license_scan as L


def brute(text, notices):
    """The bounded-error patterns over the whole text, without seeds."""
    words = L.words_of(text)
    normal = (b" " + b" ".join(words) + b" ").decode() if words else "  "
    _, fuzzy = L._search(tuple(notices))
    return sorted((i, m.start(), m.end(), sum(m.fuzzy_counts)) for i, p in enumerate(fuzzy) for m in p.finditer(normal))


parts = st.sampled_from(["mit license", "mit licence", "mlt license", "apache licens", "gnu general public license", "gnu generl publc license", "all rights reservd", "cc by", "the", "x", "é", "license", "mit", "bsd license", "redistribution and us in sorce and binary forms"])


@settings(max_examples=150, deadline=None)
@given(st.lists(parts, max_size=12), st.sampled_from([" ", ", ", "\n", "-"]))
def test_seeds_miss_nothing(words, gap):
    text = gap.join(words)
    notices = L.BASE + L.NOTICES
    normal = (b" " + b" ".join(L.words_of(text)) + b" ").decode()
    assert L.find_notices(normal, notices) == brute(text, notices)


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    out = []
    for n in L.BASE:
        own = n.text.split()
        out += [(i, n.label) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return len(words), out


def test_base_columns(spark, documents, odd, odd_rows):
    extra = [(90, "GNU General Public License; MIT-License (Apache license)"), (91, "cc by cc by"), (92, "gnu generel public license")]
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    got = sorted(map(tuple, L.digest(L.scan_licenses(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    want = []
    for r in docs.collect():
        n, hits = base(r.text)
        at = [i for i, _ in hits]
        want.append((r.doc_id, n, len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=repr)


def test_spans_and_labels(spark, empty):
    text = "Würde: released under the M.I.T. licence. Copyright, ALL RIGHTS RESERVD!"
    found = L.scan_licenses(spark.createDataFrame([(1, "x Mitt License y"), (2, text)], "doc_id int, text string")).collect()
    hits = {r.doc_id: [(h.label, h.edits, ("x Mitt License y" if r.doc_id == 1 else text)[h.start : h.end]) for h in r.hits] for r in found}
    assert hits[1] == [("mit", 1, "Mitt License")]
    assert ("reserved", 1, "ALL RIGHTS RESERVD") in hits[2]
    assert L.digest(L.scan_licenses(empty)).count() == 0


def distance(a, b):
    """Edit distance by the whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_found_notices_equal_edit_distance():
    """A notice is found exactly where some stretch between blanks is within its edits, by the table of edit distances."""
    import random

    rng = random.Random(6)
    notices = tuple(n for n in L.NOTICES if len(n.text) < 30)
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(3):
            text = list(rng.choice(notices).text)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice("aeilt nu")] * rng.randrange(2)
            words += ["so", *"".join(text).split()]
        normal = f" {' '.join(words)} "
        found = {(notices[i].text, e) for i, _, _, e in L.find_notices(normal, notices)}
        for n in notices:
            starts = [i + 1 for i, c in enumerate(normal[:-1]) if c == " "]
            ends = [i for i, c in enumerate(normal) if c == " "]
            least = min((distance(n.text, normal[a:b]) for a in starts for b in ends if abs(b - a - len(n.text)) <= n.edits), default=99)
            assert (least <= n.edits) == any(t == n.text for t, _ in found), (normal, n)
            hits += least <= n.edits
            assert all(least <= e <= n.edits for t, e in found if t == n.text)
    assert hits > 200


def test_clashing_columns_ties_and_long_texts(spark):
    from pyspark.sql import functions as F

    long = "word " * 300_000 + "MIT license " + "x" * 3_000_000
    rows = spark.createDataFrame([(1, long), (1, long), (2, "mit license mit license")], "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("hits", "n_words", "label", "score")})
    got = sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in L.digest(L.scan_licenses(rows)).collect())
    assert got == [(1, 300_003, 1, 300_000, 300_000)] * 2 + [(2, 4, 2, 0, 2)]


def labels(text):
    return {h["label"] for h in L.scan_text(text)[1]}


def test_other_phrases_are_no_notices():
    for text in ("please omit license text", "they emit license events", "the bad license plate", "an admit license", "a mat license", "mit licenses act of", "the mitlicense file", "a public mozilla license", "isa license", "ask license", "all nights reserved", "a mozilla panic license"):
        assert labels(text) <= ({"mit"} if "licenses act" in text else set()), text
    for text, label in (("Mitt License", "mit"), ("MIT licence", "mit"), ("bsd licens", "bsd"), ("apach license", "apache"), ("Mozila Public Licence", "mpl"), ("all rights reservd", "reserved"), ("gnu generel publc license", "gpl"), ("permission is here by granted, free of charge, to any person", "mit")):
        assert label in labels(text), text
    assert labels("omit license, MIT license") == {"mit"}


def test_distance_by_the_whole_table():
    import random

    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(7))) for _ in range(2))
        assert L.distance(a, b) == distance(a, b)
