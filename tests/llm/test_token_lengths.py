import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparrowloom.llm import token_lengths as T


@pytest.fixture(scope="module")
def lengths(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    encode = T.encoder(T.VOCABULARY)
    return docs, [len(encode.encode(r.text, disallowed_special=())) if r.text else 0 for r in docs.collect()]


def test_lengths(lengths):
    docs, own = lengths
    assert sorted(r.n_tokens for r in T.encoded_lengths(docs).collect()) == sorted(own)


def test_histogram(lengths):
    docs, own = lengths
    got = T.length_histogram(T.encoded_lengths(docs)).collect()
    count, n = Counter(own), len(own)
    assert len(got) == len(count)
    for r in got:
        upto = [x for x in own if x <= r.n_tokens]
        assert (r.n_docs, r.docs_upto, r.tokens_upto) == (count[r.n_tokens], len(upto), sum(upto))
        assert (r.docs_over, r.tokens_over) == (n - len(upto), sum(own) - sum(upto))
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in own)
        assert r.rank == len(upto) / n


def test_limits_and_quantiles(spark, lengths):
    docs, own = lengths
    histogram = T.length_histogram(T.encoded_lengths(docs))
    limits = [0, 1, 7, 100, 512, 4096, 10**9]
    got = {r.context_limit: r for r in T.answer_limits(histogram, spark.createDataFrame([(x,) for x in limits], "context_limit bigint")).collect()}
    for x in limits:
        assert got[x].truncated_tokens == sum(min(v, x) for v in own) and got[x].docs_fit == sum(v <= x for v in own)
    ranked = sorted(own)
    for r in T.length_quantiles(histogram, [0.1, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == next(v for v in ranked if sum(y <= v for y in ranked) >= r.share * len(ranked))


def test_control_strings_and_empty(spark, empty):
    one = spark.createDataFrame([(1, "<|endoftext|>")], "doc_id bigint, text string")
    assert T.encoded_lengths(one).first().n_tokens > 1
    assert T.length_histogram(T.encoded_lengths(empty)).count() == 0


def test_long_runs_of_white_space_keep_the_length(monkeypatch):
    """The cut text has as many tokens as the whole one, for runs short enough to be encoded whole."""
    encode = T.encoder(T.VOCABULARY).encode_ordinary
    rng = random.Random(2)
    for least in (1, 2, 3):
        monkeypatch.setattr(T, "_RUN", T.re.compile(T._RUN.pattern.replace("{1000,}", "{%d,}" % least)))
        for _ in range(400):
            text = "".join(rng.choice([" ", "\n", "\t", "\u3000", "\x1c", "  ", " \n", "a", "b's", "1", "!", "é", " the"]) for _ in range(rng.randrange(40)))
            assert T.n_tokens(text) == len(encode(text)), repr(text)


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "\u3000"])
def test_five_megabytes_of_one_character(spark, unit):
    encode = T.encoder(T.VOCABULARY).encode_ordinary
    few = len(encode(unit * 8000)) / 8000
    rows = spark.createDataFrame([(1, unit * 5_000_000), (2, f"so {unit * 5_000_000}it is")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in T.encoded_lengths(rows).collect()}
    assert got[1] == pytest.approx(5_000_000 * few, rel=1e-3) and got[2] == pytest.approx(got[1], abs=8)


def test_each_text_is_encoded_once(spark, sf_dir, odd):
    plan = T.op10_token_lengths(spark, sf_dir)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # counted before, once
    clash = odd.withColumns({c: F.lit("x") for c in ("n_tokens", "n_docs", "block")})
    assert T.length_histogram(T.encoded_lengths(clash)).agg(F.sum("n_docs")).first()[0] == odd.count()
