"""Registries, strict misses and overflow."""

import pytest
from pyspark.sql import functions as F

from sparrowloom.functions import sequences as S
from sparrowloom.operators import handlers as H


def test_unknown_set_fails(spark):
    rows = spark.createDataFrame([(1, "Calvin"), (2, "nothing")], "i int, name string")
    with pytest.raises(Exception, match="no handler for data set nothing"):
        H.with_parameters(rows, "name").collect()
    with pytest.raises(KeyError):
        H.handler_of("nothing")


def test_registered_set_and_rule(spark, monkeypatch):
    monkeypatch.setattr(H, "HANDLERS", dict(H.HANDLERS))
    monkeypatch.setattr(H, "GRIPPERS", H.GRIPPERS | {"doubled": lambda g: 2 * g})
    with pytest.raises(KeyError):
        H.register(H.Handler("mine", 10, 1, "turns", "raw", 1, 0))
    H.register(H.Handler("mine", 10, 1, "six", "doubled", 1, 0))
    rows = H.with_parameters(spark.createDataFrame([("mine", [float(i) for i in range(10)])], "name string, e array<double>"), "name")
    got = rows.select(H.both_arms(H.arm_vector(F.slice("e", 1, 3), F.slice("e", 4, 6), F.col("e")[9]), F.col("e")).alias("a")).first().a
    assert got == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 18.0] + [0.0] * 10


def test_overflow_fails_or_stays_longer(spark):
    one = spark.createDataFrame([([11] * 30,)], "ids array<int>")
    assert one.select(F.size(S.generation(F.col("ids"), 4, 20)["tokens"])).first()[0] == 38
    with pytest.raises(Exception, match="sequence longer than 20"):
        one.select(S.with_actions(F.col("ids"), 4, 2, 20)).collect()


def test_vocabulary_ids():
    words = {t: i for i, t in enumerate([*S.special_tokens("qwen2_5", actions=True).values(), "[PAD]"])}
    ids = S.vocabulary_ids(words, "qwen2_5", 99, actions=True)
    assert ids.eos == 99 and ids.boi == words["<|vision_start|>"] and ids.act == words["<|act_pad|>"]
    with pytest.raises(ValueError):
        S.special_tokens("llama3", actions=True)
    with pytest.raises(ValueError):
        S.special_tokens("other")
