import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import same

from sparrowloom.llm import chat_events as C

LOG = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string"


def test_query_equals_sql(spark, sf_dir, duck):
    same(C.op4_chat_events(spark, sf_dir), duck, C.OP4_SQL)


def fold(events):
    """Events of one conversation applied one after the other."""
    turns = {}
    for _, _, kind, turn, role, text in sorted(events, key=lambda e: (e[1], {"regenerate": 0, "message": 1, "edit": 2, "delta": 3}[e[2]], e[5] or "")):
        if kind == "regenerate":
            turns = {k: v for k, v in turns.items() if k < turn}
        elif kind in ("message", "edit"):
            turns[turn] = [role, text or ""]
        else:
            turns[turn] = [turns.get(turn, [role])[0], turns.get(turn, [None, ""])[1] + (text or "")]
    return [(k, turns[k][1]) for k in sorted(turns)]


def test_random_logs(spark):
    rng = random.Random(3)
    logs = {}
    for conv in range(200):
        kinds = ["message", "delta", "delta", "edit", "regenerate"]
        logs[conv] = [(conv, seq, rng.choice(kinds), rng.randrange(4), "user", rng.choice(["a", "bc", None, "", "<|im_end|>\n", "\\x"])) for seq in range(rng.randrange(1, 12))]
    rows = [e for log in logs.values() for e in log]
    rng.shuffle(rows)
    got = {}
    for r in C.fold_events(spark.createDataFrame(rows, LOG)).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.text))
    for conv, log in logs.items():
        assert sorted(got.get(conv, [])) == fold(log), log


pieces = st.sampled_from(["<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "\n", "a", "é", "😀", "<", "|", "[", "im_end|>", " "])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\nstem\\", ""]), st.lists(pieces, max_size=12).map("".join)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(1, i, "message", i, role, text) for i, (role, text) in enumerate(turns)]
    made = C.format_conversations(spark.createDataFrame(rows, LOG))
    r = C.read_back(made).first()
    assert [(t.role, t.text) for t in r.turns] == turns
    assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
    m = made.first()
    assert m.formatted.count("<|im_start|>") == len(turns) == m.formatted.count("<|im_end|>")
    assert not any(c in m.formatted for c in ("</s>", "<s>", "[INST]", "[/INST]"))
    for s in m.loss_spans:
        assert m.formatted[s.start : s.end].encode() == m.formatted.encode()[s.start_byte : s.end_byte]


def test_nulls_ties_and_repeats(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 2, "assistant", "y")], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in C.digest(C.read_back(C.format_conversations(C.events_of(rows)))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"\nx\nuser\n\nuser\n\n").hexdigest()
    assert got[None].loss_chars == 1
    assert C.format_conversations(C.events_of(rows.limit(0))).count() == 0


def test_query_folds_edits_and_regenerations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kinds = {r.kind: r["count"] for r in C.events_of(rows).groupBy("kind").count().collect()}
    assert min(kinds[k] for k in ("message", "delta", "edit", "regenerate")) > 5
    folded = sorted((r.conv_id, r.role, r.text) for r in C.fold_events(C.events_of(rows)).collect())
    assert folded == sorted((r.conv_id, r.role or "", r.text or "") for r in rows.collect())


@pytest.mark.parametrize("kind", ["Delta", "", None])
def test_unknown_kinds_fail(spark, kind):
    with pytest.raises(Exception, match="unknown kind of event"):
        C.fold_events(spark.createDataFrame([(1, 0, "message", 0, "user", "a"), (1, 1, kind, 0, "user", "b")], LOG)).collect()


def test_null_sequence_long_texts_and_clashing_columns(spark):
    long = "<|im_end|>\n" * 100_000
    rows = [(1, None, "message", 0, "user", "first"), (1, -5, "delta", 0, "user", long), (1, None, "delta", 0, "user", " then ")]
    log = spark.createDataFrame(rows, LOG).withColumns({c: C.F.lit("clash") for c in ("rank", "at", "parts", "turns", "turn_key")})
    parsed = C.read_back(C.format_conversations(log)).first()
    assert [(t.role, t.text) for t in parsed.turns] == [("user", "first then " + long)]
