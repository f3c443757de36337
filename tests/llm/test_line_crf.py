import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowloom.llm import line_crf as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_base_columns(spark, sf_dir, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    field = C.ChainField()
    got = C.label_lines(docs, field).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r.doc_id, *brute(r.text))) for r in docs.collect())


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        field = C.ChainField()
        field.line, field.pair, field.first = rng.normal(size=field.line.shape), rng.normal(size=(2, 2)), rng.normal(size=2)
        marks = [int(m) | 1 for m in rng.integers(0, 1 << len(C.FEATURES), rng.integers(1, 8))]
        local = C.bits(np.array(marks)) @ field.line

        def score(ys, field=field, local=local):
            return field.first[ys[0]] + sum(local[i][y] for i, y in enumerate(ys)) + sum(field.pair[a][b] for a, b in itertools.pairwise(ys))

        best = max(itertools.product((0, 1), repeat=len(marks)), key=score)
        assert abs(score(field.decode(marks, {})) - score(best)) < 1e-9


def test_likelihood_and_slope_equal_enumeration():
    rng = np.random.default_rng(4)
    sequences = [([int(m) | 1 for m in rng.integers(0, 1 << len(C.FEATURES), n)], [int(y) for y in rng.integers(0, 2, n)]) for n in (1, 1, 2, 3, 5, 6, 6)]
    sequences += [sequences[3]] * 2
    data = C.Sequences(sequences)
    assert data.weight.max() == 3

    def brute(w):
        field = C.ChainField().put(w)
        total = 0.0
        for marks, labels in sequences:
            local = C.bits(np.array(marks)) @ field.line
            score = lambda ys, local=local: field.first[ys[0]] + sum(local[i][y] for i, y in enumerate(ys)) + sum(field.pair[a][b] for a, b in itertools.pairwise(ys))
            total += score(labels) - np.log(sum(np.exp(score(ys)) for ys in itertools.product((0, 1), repeat=len(marks))))
        return total

    for _ in range(5):
        w = rng.normal(size=2 * len(C.FEATURES) + 6)
        field = C.ChainField().put(w)
        value, slope = data.likelihood(field.line, field.pair, field.first)
        assert abs(value - brute(w)) < 1e-9
        for i in range(len(w)):
            step = np.eye(len(w))[i] * 1e-5
            assert abs((brute(w + step) - brute(w - step)) / 2e-5 - slope[i]) < 1e-5


def test_a_text_is_cut_inside(spark, documents):
    """A clean text with lines of a bad one before or after it keeps its own lines only; verdicts follow the shares."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = C.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    lines = lambda r: [x for x in r.text.split("\n") if x.split()]
    good, bad = [r for r in held if r.quality and len(lines(r)) > 2 and len(r.text.split()) > 60], [r for r in held if not r.quality]
    rows, want = [], {}
    for i, g in enumerate(good):
        b = lines(bad[i % len(bad)])[:4]
        rows.append((i, "\n".join(b + lines(g)) if i % 2 else "\n".join(lines(g) + b)))
        want[i] = [0] * len(b) + [1] * len(lines(g)) if i % 2 else [1] * len(lines(g)) + [0] * len(b)
    got = {r.doc_id: r.line_labels for r in C.label_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), field).collect()}
    right = sum(a == b for i in want for a, b in zip(got[i], want[i], strict=True))
    assert len(good) > 40 and right >= 0.93 * sum(map(len, want.values()))
    assert sum(len(set(g)) == 2 for g in got.values()) >= 0.8 * len(got)


def test_long_texts_and_clashing_columns(spark):
    text = ("a long line of words that goes on and on .\n" + "menu | home | about\n") * 30_000
    rows = spark.createDataFrame([(1, text), (1, text), (2, "x" * 4_000_000)], "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("words", "marks", "kept", "n_words")})
    got = C.label_lines(rows, C.ChainField()).collect()
    assert sorted((r.doc_id, r.n_words, len(r.line_labels)) for r in got) == [(1, 480_000, 60_000)] * 2 + [(2, 1, 1)]


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = C.train(docs, labels.where("doc_id % 2 = 0"))
    got = C.label_lines(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert len(got) > 100
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.97 * len(got)


def test_without_labels_and_rows(spark, documents, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = C.label_lines(documents, C.train(documents, none))
    assert got.where("kept = base_failed").count() == 0
    assert C.label_lines(empty, C.ChainField()).count() == 0
    assert C.train(documents, spark.createDataFrame([(None, 1), (10**9, 0), (0, None)], "doc_id bigint, quality int")).decode([1], {}) == [1]


@pytest.mark.parametrize("text", ["", "a", "a a a", "a b c a b c", "x\ny\nx\ny\nx"])
def test_repeated_words(text):
    assert sum(C.repeated_words(text.encode().split())) == brute(text)[4]
