import hashlib
import itertools
import random
import re
import zlib

import pytest
from oracle import same
from pyspark.sql import functions as F

from sparrowloom.llm import turn_repair as T

ROWS = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def test_query_equals_sql(spark, sf_dir, duck):
    same(T.op11_turn_repair(spark, sf_dir), duck, T.OP11_SQL)


def by_enumeration(symbols, limit=4):
    """The least (cost, audit) over all edits of a few symbols and up to `limit` inserts."""
    best = (10**9, "")
    for edits in itertools.product(*[T._edits(s) for s in symbols]):
        base = sum(e[2] for e in edits)
        for n in range(limit + 1):
            if base + 5 * n > best[0]:
                break
            for spots in itertools.combinations_with_replacement(range(len(symbols) + 1), n):
                for roles in itertools.product("ua", repeat=n):
                    audit, out = [], []
                    for i in range(len(symbols) + 1):
                        for spot, role in zip(spots, roles, strict=True):
                            if spot == i:
                                audit.append("I")
                                out.append(role)
                        if i < len(symbols):
                            audit.append(edits[i][0])
                            out.append(edits[i][1])
                    if LEGAL.fullmatch("".join(out)):
                        best = min(best, (base + 5 * n, "".join(audit)))
    return best


@pytest.mark.parametrize("rules", [[], [("u", "a"), ("a", "s"), (chr(T.FIRST_RULE), chr(T.FIRST_RULE)), ("U", "x"), ("x", "x")]])
def test_cheapest_equals_enumeration(rules):
    rng = random.Random(5)
    grammar = T.Grammar(rules)
    words = ["", *"suaoSUAOx", *("".join(p) for p in itertools.product("suUax", repeat=2)), *("".join(rng.choices("suaoSUAOx", k=n)) for n in (3, 4, 5) for _ in range(25))]
    for symbols in words:
        assert grammar.cheapest(symbols) == by_enumeration(symbols), symbols


def plain_dp(symbols):
    """Viterbi over whole strings, without matrices."""
    best = {0: (0, "")}
    for s in symbols:
        new = {}
        for state, (cost, audit) in best.items():
            for mid, roles in T._inserted(state):
                for letter, role, more in T._edits(s):
                    to = T.NEXT.get((role, mid)) if role else mid
                    if to is not None:
                        new[to] = min(new.get(to, (10**9, "")), (cost + more + 5 * len(roles), audit + "I" * len(roles) + letter))
        best = new
    return min((c + 5 * n, a + "I" * n) for s, n in ((0, 0), (3, 0), (2, 1), (1, 2)) if s in best for c, a in [best[s]])


def test_learnt_grammar_changes_nothing(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("suaoSUAOx", weights=(1, 9, 9, 1, 1, 2, 2, 1, 2), k=rng.randrange(1, 60))) for _ in range(150)] + ["ua" * 100, "u" * 70, "xUA" * 40]
    grammar = T.learn(spark.createDataFrame([(w, 1 + i % 3) for i, w in enumerate(words)], "symbols string, n bigint"))
    assert len(grammar.rules) > 20
    assert len(grammar.compress("ua" * 100)) < 12
    for w in words:
        assert grammar.cheapest(w) == plain_dp(w)
    assert T.learn(spark.createDataFrame([], "symbols string, n bigint")).rules == []
    small = T.learn(spark.createDataFrame([(w, 1) for w in words], "symbols string, n bigint"), rules=7)
    assert len(small.rules) == 7 and all(small.cheapest(w) == plain_dp(w) for w in words)


def by_hand(rows):
    """The contract over lists of (conv, turn, role, text) after damage, in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{r[2]}\0{r[3]}".encode()).digest()))
        seen, symbols, counts = set(), "", [0, 0, 0]
        for _, _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            first = role[:1] if role[:1] in tuple("sua") else "o"
            if not solid:
                counts[0] += 1
                symbols += "x"
            elif (role, text) in seen:
                counts[1] += 1
                symbols += "x"
            elif solid[-1] not in ".!?":
                counts[2] += 1
                symbols += first.upper()
            else:
                symbols += first
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = plain_dp(symbols)
        lines, state, at = [], 0, 0
        for letter in audit:
            role = "a" if state == 2 else "u"
            full = {"u": "user", "a": "assistant"}[role]
            if letter == "I":
                lines.append(full + ":")
            else:
                _, _, own_role, text = own[at]
                at += 1
                if letter == "D":
                    continue
                lines.append(f"{own_role if letter == 'K' else full}:{text}")
                role = own_role[:1] if letter == "K" else role
            state = T.NEXT[role, state]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digest(spark, rows):
    df = spark.createDataFrame(rows, ROWS).withColumn("block", F.lit("clash")).withColumn("row_id", F.lit(1.5))
    return {r[0]: tuple(r[1:]) for r in T.repair_digest(df.select("conv_id", "turn", "role", "text"), df).collect()}


def test_long_and_odd_conversations(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "", "tool", " ", "użytkownik", "🙂"]
    texts = ["Yes.", "No!", "cut off", " \t", "", "Why? ", "é.\n", "line\nline."]
    rows = []
    for t in range(2600):  # over ten segments
        rows.append((1, t - t % 3, rng.choices(roles, weights=(9, 9, 1, 1, 1, 1, 1, 1))[0], f"{rng.choice(texts)}{t if rng.random() < 0.4 else ''}{rng.choice('. ')}"))
    rows += [(2, None, "user", "a."), (2, None, "user", "a."), (2, 5, "assistant", "b."), (2, 9, "user", "c.")]
    rows += [(None, 1, "assistant", "x."), (None, 1, "assistant", "x."), (3, None, "system", "s."), (4, 7, "", "t."), (5, 1, "user", " "), (6, 1, "user", "word " * 50_000 + ".")]
    rows += [(7, 1, "assistant", "same.")] * 600 + [(7, 2, "user", "same.")]
    assert digest(spark, rows) == by_hand(rows)


def test_damage(spark):
    rows = [(i, t, r, "Text. Is it? ok!") for i in range(40) for t, r in enumerate(("system", "user", "assistant"))] + [(None, 1, None, None), (77, None, "user", None)]
    got = sorted(map(tuple, T.damaged(spark.createDataFrame(rows, ROWS)).collect()), key=repr)
    want = []
    for conv, turn, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [] if fault == 0 else [row, row] if fault == 3 else [row]
    assert got == sorted(want, key=repr)


def test_conversations_without_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert T.repair_digest(none, none).count() == 0
    only = T.repair_digest(none, spark.createDataFrame([(4, 1, "user", "gone")], ROWS)).collect()
    assert [tuple(r) for r in only] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
