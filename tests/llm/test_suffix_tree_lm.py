import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sparrowloom.llm import suffix_tree_lm as S


def words(text):
    return S.words_of(text)


def brute(rows, depth=S.DEPTH):
    """The same model from dictionaries of word tuples."""
    END = "end"
    held = [zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in rows]
    train = [words(t) + [END] for (_, t), h in zip(rows, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    N, V = sum(c.values()), len(c)
    root = lambda w: math.log((c[w] + 0.5) / (N + 0.5 * (V + 1)))
    frequent = {w for w in c if c[w] >= S.least_next(N)}
    after = [Counter() for _ in range(depth + 1)]
    for t in train:
        t = [END, *t]
        for i in range(1, len(t)):
            for d in range(1, min(depth, i) + 1):
                after[d][(tuple(t[i - d : i]), t[i])] += 1
    least = S.least_context(N)
    nodes = {(): None}
    prob, rest, parent = {}, {}, {}
    contexts = {(w,): c[w] for w in frequent if c[w] >= least}

    def suffix(s):
        s = s[1:]
        while s not in nodes:
            s = s[1:]
        return s

    def logp(s, w):
        if s == ():
            return root(w)
        return math.log(prob[s][w]) if w in prob[s] else rest[s] + logp(parent[s], w)

    for d in range(1, depth + 1):
        follow = {s: {} for s in contexts}
        for (s, w), n in after[d].items():
            if s in follow and w in frequent and n >= S.least_next(N):
                follow[s][w] = n
        longer = {}
        for s, own in follow.items():
            p = {w: (n - S.DISCOUNT) / contexts[s] for w, n in own.items()}
            up = suffix(s)
            q = {w: math.exp(logp(up, w)) for w in own}
            lp, lq = min(1, max(1e-9, 1 - sum(p.values()))), min(1, max(1e-9, 1 - sum(q.values())))
            kl = sum(p[w] * math.log(p[w] / q[w]) for w in own) + lp * math.log(lp / lq)
            if kl >= S.MIN_DIVERGENCE:
                longer[s] = (p, math.log(lp / lq), up)
        new = {s + (w,): n for s, own in follow.items() for w, n in own.items() if n >= least and w != END}
        for s, (p, r, up) in longer.items():
            nodes[s], prob[s], rest[s], parent[s] = None, p, r, up
        contexts = {s: n for s, n in new.items() if s[1:] in contexts}
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        t = [END, *words(t), END]
        score = base = 0.0
        for k in range(1, len(t)):
            s = tuple(t[max(0, k - depth) : k])
            while s not in nodes:
                s = s[1:]
            score += logp(s, t[k])
            base += root(t[k])
        out.append((i, h, len(t) - 1, sum(c[w] > 0 for w in t[1:]), N, base / math.log(10), score / math.log(10)))
    return out, len(nodes)


@pytest.mark.parametrize("depth", [S.DEPTH])
def test_equals_brute_force(spark, documents, odd, depth):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, nodes = brute(rows)
    assert nodes > 10
    key = lambda r: (repr(r[:5]), round(r[5], 4))
    got = sorted(map(tuple, S.score_documents(docs).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-6), (a, b)


def test_distributions_sum_to_one(spark, documents):
    both = S.encoded(S.with_folds(documents))
    vocabulary = S.word_counts(both)
    tree = S.grow(both.where("not held_out"), vocabulary)
    every = np.arange(len(tree.words))
    rare = np.array([r.n for r in vocabulary.collect() if r.n < S.least_next(tree.tokens)])
    for state in [0, *np.flatnonzero(tree.kept)[1:20]]:
        known = np.exp(tree.log_next(np.full(len(every), state), every)).sum()
        # What is left is for the rare words and the unknown one.
        factor = np.exp(tree.log_next(np.array([state]), np.array([-1]))[0])
        left = factor * (np.exp(tree.root(rare)).sum() + np.exp(tree.root(0)))
        assert abs(known + left - 1) < 1e-9


def test_better_than_words_alone_on_held_out_text(spark, documents):
    got = S.score_documents(documents).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(empty):
    assert S.score_documents(empty).count() == 0


def test_tree_grows_with_the_corpus(documents, spark):
    """No size from which the tree stays the same: four times the text has about twice the contexts or more."""
    sizes = []
    for docs in (documents, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        both = S.encoded(S.with_folds(docs))
        tree = S.grow(both.where("not held_out"), S.word_counts(both))
        sizes.append((tree.tokens, len(tree.next)))
    assert sizes[1][0] > 3 * sizes[0][0] and sizes[1][1] > 1.3 * sizes[0][1]


def test_long_texts_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    long = "b a " * 400_000
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, long), (-2, "x" * 3_000_000)], "doc_id bigint, text string"))
    clash = docs.withColumns({c: F.lit("x") for c in ("row_id", "words", "held_out", "n", "rare", "counts")})
    got = {r.doc_id: r for r in S.score_documents(clash).where("doc_id < 0").collect()}
    assert got[-1].n_tokens == 800_001 and got[-2].n_tokens == 2 and got[-1].score > got[-1].base_score
