"""Conversation structure repair: grammar-compressed dynamic programming.

Each row of a conversation is one of nine symbols: it must be deleted (blank, or
a duplicate), or it has a role's initial (s, u, a, another) and is truncated or
not. Edits turn a conversation's symbols into a sequence that the grammar of
roles, (s?(ua)+)?, accepts; what a row or run of rows can do is a min-plus
matrix over the automaton's four states (nothing yet, after s, after u, after
a), whose entries are the least cost and, among equals, the least audit.

* Symbols are cut into segments of SEGMENT rows, so a conversation with a third
  of all rows is spread over many tasks. Distinct segments are counted first.
* Re-Pair: rounds over the distinct segments count adjacent pairs (summed per
  task, then by a grouped sum); the most frequent become rules, as many a round
  as cannot overlap each other. RULES bounds the grammar, which is broadcast;
  what no rule covers is evaluated symbol by symbol, so the bound costs time
  only, and no result depends on the grammar.
* One matrix per rule, from its two parts' matrices, bottom-up. An audit is a
  rope: the state between a rule's parts. Ropes are compared without being
  written out: a matrix ranks its 16 audits, and the rank of a joined audit is
  that of its parts' ranks, left first. This is exact since two different audits
  of the same rows are never one another's prefixes: both end in a row's letter
  and have as many of them.
* A conversation folds the matrices of its symbols and rules, and only the
  chosen rope is written out. Equal symbol strings in a batch share the result.

Texts stay out of all of this: rows are ordered and judged by slim columns, and
the texts of those that are kept are joined to their edits at the end.

The repair's own hash reads a conversation's texts in order, which no plan can
split (SHA-256 is a chain); conversations of more than one segment are hashed as
a stream of segment texts, one batch at a time, others by a function of Spark's.

Defined results: a null role or text is one space, a null conv_id is a
conversation of its own; rows of null turn come first, rows of equal turn go by
role, then by the hash of role and text; an empty role has no initial, so it can't be
kept, only given another role or deleted; whole repeated rows are duplicates but for the first; long texts are
values like any other; conversations without rows have cost 0 and an empty
audit; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

#: Rows (a power of two) in a segment.
SEGMENT_BITS = 8
#: Rules of the grammar, rounds of pair counting, and pairs looked at in a round.
RULES, ROUNDS, PAIRS = 4096, 24, 512
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
MUST_GO, OTHER = "x", "o"
FAR = 1 << 60
#: Nonterminals are code points from here on (a private use area).
FIRST_RULE = 0xF0000


def _inserted(state: int) -> list[tuple[int, str]]:
    """(state, roles) reachable by inserts; more than two never pay."""
    out = [(state, "")]
    while len(out) < 3:
        at, roles = out[-1]
        role = "a" if at == USER else "u"
        out.append((NEXT[role, at], roles + role))
    return out


def _edits(symbol: str) -> list[tuple[str, str, int]]:
    """(letter, role it comes to, cost) of a row's edits."""
    if symbol == MUST_GO:
        return [("D", "", DELETE)]
    stays = CUT_OFF if symbol.isupper() else 0
    kept = [("K", symbol.lower(), stays)] if symbol.lower() != OTHER else []
    return [("D", "", DELETE), *kept, *(("R", r, REROLE + stays) for r in "ua")]


class Matrix:
    """What a run of rows can do: for each pair of states the cost, the audit's rank among the 16, and its rope."""

    __slots__ = ("cost", "rank", "rope")

    def __init__(self, best: dict):
        """best: by (from, to), (cost, comparable audit, rope)."""
        place = {a: i for i, a in enumerate(sorted({b[1] for b in best.values()}))}
        self.cost = [[best[i, k][0] if (i, k) in best else FAR for k in STATES] for i in STATES]
        self.rank = [[place[best[i, k][1]] if (i, k) in best else 0 for k in STATES] for i in STATES]
        self.rope = [[best[i, k][2] if (i, k) in best else None for k in STATES] for i in STATES]


def terminal(symbol: str) -> Matrix:
    best = {}
    for i in STATES:
        for mid, roles in _inserted(i):
            for letter, role, cost in _edits(symbol):
                k = NEXT.get((role, mid)) if role else mid
                if k is not None:
                    audit = "I" * len(roles) + letter
                    best[i, k] = min(best.get((i, k), (FAR, "", "")), (INSERT * len(roles) + cost, audit, audit))
    return Matrix(best)


def joined(left: Matrix, right: Matrix) -> Matrix:
    best = {}
    for i in STATES:
        for k in STATES:
            ways = [(left.cost[i][j] + right.cost[j][k], (left.rank[i][j], right.rank[j][k]), j) for j in STATES if left.cost[i][j] < FAR and right.cost[j][k] < FAR]
            if ways:
                best[i, k] = min(ways)
    return Matrix(best)


class Grammar:
    """Rules in the order in which they apply, and their matrices."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.matrix = {s: terminal(s) for s in "suaoSUAOx"}
        self.parts: dict[str, tuple[str, str]] = {}
        for n, (left, right) in enumerate(rules):
            name = chr(FIRST_RULE + n)
            self.parts[name] = (left, right)
            self.matrix[name] = joined(self.matrix[left], self.matrix[right])

    def compress(self, symbols: str) -> str:
        for n, (left, right) in enumerate(self.rules):
            if left in symbols:
                symbols = symbols.replace(left + right, chr(FIRST_RULE + n))
        return symbols

    def write_out(self, symbol: str, i: int, k: int) -> str:
        out, todo = [], [(symbol, i, k)]
        while todo:
            symbol, i, k = todo.pop()
            rope = self.matrix[symbol].rope[i][k]
            if symbol in self.parts:
                left, right = self.parts[symbol]
                todo += [(right, rope, k), (left, i, rope)]
            else:
                out.append(rope)
        return "".join(out)

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of a whole conversation."""
        short = self.compress(symbols)
        cost, rank, came = [0, FAR, FAR, FAR], [0] * 4, []
        for s in short:
            m = self.matrix[s]
            new = [min(((cost[j] + m.cost[j][k], (rank[j], m.rank[j][k]), j) for j in STATES if cost[j] < FAR and m.cost[j][k] < FAR), default=(FAR, (0, 0), 0)) for k in STATES]
            place = {a: i for i, a in enumerate(sorted({n[1] for n in new}))}
            cost, rank = [n[0] for n in new], [place[n[1]] for n in new]
            came.append([n[2] for n in new])
        ends = [(START, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)]
        total, _, more, k = min((cost[s] + INSERT * n, (rank[s], "I" * n), n, s) for s, n in ends if cost[s] < FAR)
        out = ["I" * more]
        for s, back in zip(reversed(short), reversed(came), strict=True):
            out.append(self.write_out(s, back[k], k))
            k = back[k]
        return total, "".join(reversed(out))


def plan_of(symbols: str, audit: str) -> tuple[str, str]:
    """(a letter for each row, roles inserted at the end): A + 4 * inserts before it + edit.

    Inserts before a row: none, u, a, ua, au; edits: delete, keep, to user, to assistant.
    """
    inserts = ("", "u", "a", "ua", "au")
    state, roles, out, at = START, "", [], 0
    for letter in audit:
        if letter == "I":
            role = "a" if state == USER else "u"
            roles, state = roles + role, NEXT[role, state]
            continue
        edit = 0
        if letter != "D":
            role = symbols[at].lower() if letter == "K" else "a" if state == USER else "u"
            edit = 1 if letter == "K" else 2 if role == "u" else 3
            state = NEXT[role, state]
        out.append(chr(65 + 4 * inserts.index(roles) + edit))
        roles, at = "", at + 1
    return "".join(out), roles


def choose(pairs: list[tuple[str, int]], room: int) -> list[tuple[str, str]]:
    """By falling count, the pairs whose places in a sequence can't overlap those of one chosen before."""
    lefts, rights, out = set(), set(), []
    for pair, _ in pairs:
        left, right = pair
        if len(out) < room and left not in rights and right not in lefts and (left != right or left not in lefts):
            out.append((left, right))
            lefts.add(left)
            rights.add(right)
    return out


def learn(distinct: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> Grammar:
    """The grammar of segments (symbols, n): n segments have these symbols."""
    found: list[tuple[str, str]] = []
    schema = pa.schema([("pair", pa.string()), ("n", pa.int64())])

    def counted(found: list) -> Callable:
        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grammar, count = Grammar(found), Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    short = grammar.compress(symbols)
                    for left, right in zip(short, short[1:], strict=False):
                        count[left + right] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], schema=schema)

        return pairs

    for _ in range(rounds):
        counts = distinct.select("symbols", "n").mapInArrow(counted(found), "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = [(r.pair, r.n) for r in counts.where("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()]
        new = choose(top, rules - len(found))
        if not new:
            break
        found = found + new
    return Grammar(found)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h, copies, initial, blank, truncated, row_id) of (conv_id, turn, role, text).

    A row for each distinct one, numbered in the order of conversations and turns: a range sort, whose
    partitions and places make the numbers. Written to the shared folder.
    """
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    slim = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5(F.concat("role", F.lit("\0"), text))).alias("h"),
        (last == "").alias("blank"),
        (~last.rlike(r"^[.!?]")).alias("truncated"),
    )
    one = slim.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    by = ["conv_id", "turn", "role", "h"]
    numbered = one.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_id", F.monotonically_increasing_id())
    return cut(numbered.withColumn("initial", _initial(F.col("role"))), "turns")


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, block, symbols, initials, places, first_id, counts, turns) for each SEGMENT rows of ordered().

    places holds where in symbols each distinct row begins.
    """
    # A row is the first of its role and text if it has the least number among them; numbers are unique, so this join has no hot key.
    firsts = rows.groupBy("conv_id", "role", "h").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("is_first"))
    judged = rows.join(firsts, "row_id", "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    goes = F.col("blank") | ~F.col("is_first")
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(OTHER)
    own = F.when(goes, F.lit(MUST_GO)).otherwise(F.when(F.col("truncated"), F.upper(role)).otherwise(role))
    more = (F.col("copies") - 1).cast("int")
    mark = F.when(F.col("initial") == "", F.lit("\0")).otherwise(F.col("initial"))
    item = F.struct(
        "row_id",
        F.concat(own, F.repeat(F.lit(MUST_GO), more)).alias("symbols"),
        F.concat(mark, F.repeat(mark, more)).alias("initials"),
        F.col("copies").alias("copies"),
        "turn",
    )
    grouped = judged.groupBy("conv_id", F.shiftright("row_id", SEGMENT_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("is_first"), F.col("copies") - 1).otherwise(F.col("copies"))).alias("duplicate"),
        F.sum((~goes & F.col("truncated")).cast("bigint")).alias("truncated"),
    )
    turns = F.array_compact("items.turn")
    return grouped.select(
        "conv_id",
        "block",
        F.array_join("items.symbols", "").alias("symbols"),
        F.array_join("items.initials", "").alias("initials"),
        F.col("items.copies").alias("copies"),
        F.col("items")[0]["row_id"].alias("first_id"),
        "blank",
        "duplicate",
        "truncated",
        F.size(F.array_distinct(turns)).cast("bigint").alias("n_turns"),
        F.get(turns, F.lit(0)).alias("first_turn"),
        F.element_at(F.array_append(F.reverse(turns), F.lit(None).cast("bigint")), 1).alias("last_turn"),
    )


SEGMENT = "block bigint, symbols string, initials string, copies array<bigint>, first_id bigint, n_turns bigint, first_turn bigint, last_turn bigint"
FOLDED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, tail string, plans array<struct<block: bigint, first_id: bigint, plan: string>>"


def folder(rules: list) -> Callable:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, known = Grammar(rules), {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                segs = row["segments"]
                symbols = "".join(s["symbols"] for s in segs)
                if symbols not in known:
                    if len(known) > 10_000:
                        known.clear()
                    cost, audit = grammar.cheapest(symbols)
                    known[symbols] = (cost, audit, *plan_of(symbols, audit))
                cost, audit, plan, tail = known[symbols]
                initials = "".join(s["initials"] for s in segs)
                pairs = Counter(zip(initials, initials[1:], strict=False))
                legal = sum(pairs[p] for p in (("s", "u"), ("u", "a"), ("a", "u")))
                told = [s for s in segs if s["n_turns"]]
                turns = sum(s["n_turns"] for s in told) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(told, told[1:], strict=False))
                gaps = told[-1]["last_turn"] - told[0]["first_turn"] + 1 - turns if told else 0
                plans, at = [], 0
                for s in segs:
                    letters = []
                    for n in s["copies"]:
                        letters.append(plan[at])
                        at += n
                    plans.append({"block": s["block"], "first_id": s["first_id"], "plan": "".join(letters)})
                out.append({k: row[k] for k in ("conv_id", "blank", "duplicate", "truncated")} | {"gaps": gaps, "illegal": max(len(initials) - 1, 0) - legal, "cost": cost, "audit": audit, "tail": tail, "plans": plans})
            yield pa.RecordBatch.from_pylist(out, schema=FOLDED_ARROW)

    return fold


FOLDED_ARROW = pa.schema(
    [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("tail", pa.string())]
    + [("plans", pa.list_(pa.struct([("block", pa.int64()), ("first_id", pa.int64()), ("plan", pa.string())])))]
)


def audits(rows: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation in ordered() rows: FOLDED columns, written to the shared folder."""
    segs = cut(segments(rows), "segments")
    distinct = cut(segs.groupBy("symbols").agg(F.count("*").alias("n")), "symbols")
    grammar = learn(distinct)
    whole = segs.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "symbols", "initials", "copies", "first_id", "n_turns", "first_turn", "last_turn"))).alias("segments"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    folded = cut(whole.mapInArrow(folder(grammar.rules), FOLDED), "audits")
    drop_cut(distinct)
    drop_cut(segs)
    return folded


def repaired(rows: DataFrame, slim: DataFrame, folded: DataFrame) -> DataFrame:
    """(conv_id, block, row_id, place, role, text): the repaired conversations' rows, in order of row_id and place.

    rows: the rows to repair; slim: ordered(rows); folded: audits(slim).
    """
    plans = folded.select(F.col("conv_id").alias("p_conv"), F.explode("plans").alias("p")).select("p_conv", F.col("p.block").alias("block"), F.col("p.first_id").alias("first_id"), F.col("p.plan").alias("plan"))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")), F.hex("h")))
    keyed = slim.select("conv_id", "row_id", key.alias("key"), F.shiftright("row_id", SEGMENT_BITS).alias("block"))
    kept = keyed.join(plans, F.expr("conv_id <=> p_conv")& (keyed["block"] == plans["block"])).select(
        keyed["conv_id"],
        keyed["block"],
        "row_id",
        "key",
        (F.ascii(F.expr("substr(plan, cast(row_id - first_id as int) + 1, 1)")) - 65).alias("code"),
    )
    kept = kept.withColumn("edit", F.col("code") % 4).where("edit > 0")
    texts = rows.withColumn("h", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text")))).select(key.alias("key"), "role", "text").groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    full = lambda c: F.when(c == "u", F.lit("user")).otherwise("assistant")
    put_in = F.transform(F.split(F.element_at(F.array(*map(F.lit, ("", "u", "a", "u,a", "a,u"))), (F.col("code") / 4).cast("int") + 1), ","), lambda c: F.struct(full(c).alias("role"), F.lit("").alias("text")))
    own = F.array(F.struct(F.when(F.col("edit") == 1, F.col("role")).when(F.col("edit") == 2, F.lit("user")).otherwise("assistant").alias("role"), F.col("text").alias("text")))
    lines = F.when(F.col("code") < 4, own).otherwise(F.concat(put_in, own))
    body = kept.join(texts, "key").select("conv_id", "block", "row_id", F.posexplode(lines).alias("place", "line")).select("conv_id", "block", "row_id", "place", "line.role", "line.text")
    ends = folded.where("tail <> ''").select(
        "conv_id",
        F.element_at("plans", -1)["block"].alias("block"),
        F.lit(2**63 - 1).alias("row_id"),
        F.posexplode(F.filter(F.split("tail", ""), lambda c: c != "")).alias("place", "initial"),
    )
    return body.unionByName(ends.select("conv_id", "block", "row_id", "place", full(F.col("initial")).alias("role"), F.lit("").alias("text")))


def repaired_hashes(lines: DataFrame, folded: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations that have rows in repaired()."""
    item = F.struct("row_id", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    pieces = lines.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["line"]), "\n").alias("piece"))
    many = folded.where(F.size("plans") > 1).select(F.col("conv_id").alias("m_conv"), F.lit(True).alias("many"))
    marked = pieces.join(many, F.expr("conv_id <=> m_conv"), "left")
    single = marked.where("many is null").select("conv_id", F.sha2("piece", 256).alias("repaired_sha256"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segment texts sorted by conversation and block: one running hash."""
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        open_, running = False, None
        conv = None
        for batch in batches:
            ids, done, shas = batch.column("conv_id").to_pylist(), [], []
            for i, piece in zip(ids, batch.column("piece").to_pylist(), strict=True):
                if open_ and i == conv:
                    running.update(b"\n")
                else:
                    if open_:
                        done.append(conv)
                        shas.append(running.hexdigest())
                    open_, conv, running = True, i, hashlib.sha256()
                running.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(shas, pa.string())], schema=schema)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([running.hexdigest()], pa.string())], schema=schema)

    long = marked.where("many").select("conv_id", "block", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(stream, "conv_id bigint, repaired_sha256 string")
    return single.unionByName(long)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows dropped, emptied, stripped of stops, repeated or given another role by crc32 of conversation and turn."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("fault", fault).where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def repair_digest(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each conv_id of ids: faults, cost, audit and hash of the repair of rows."""
    slim = ordered(rows)
    folded = audits(slim)
    hashes = repaired_hashes(repaired(rows, slim, folded), folded).withColumnRenamed("conv_id", "h_conv")
    facts = folded.drop("tail", "plans").withColumnRenamed("conv_id", "f_conv")
    out = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().join(facts, F.expr("conv_id <=> f_conv"), "left").join(hashes, F.expr("conv_id <=> h_conv"), "left")
    nought = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *nought, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_digest(damaged(conversations), conversations)


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), faulty AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(name) + 1), lambda i: ord(name[i])::BIGINT)), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS fault
  FROM named, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS time
  FROM faulty WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text), time) AS place FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS earlier
  FROM placed
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen) AS duplicate,
    count(*) FILTER (WHERE NOT blank AND NOT seen AND cut_off) AS truncated,
    count(*) FILTER (WHERE place > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS n
  FROM judged GROUP BY conv_id
), inserts(a, m, roles) AS (
  VALUES ('0', '0', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''),
    ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a'), ('0', 'a', 'ua'), ('s', 'a', 'ua')
), edits(m, letter, role, b) AS (
  VALUES ('0', 'D', '', '0'), ('s', 'D', '', 's'), ('u', 'D', '', 'u'), ('a', 'D', '', 'a'), ('0', 'K', 's', 's'),
    ('0', 'K', 'u', 'u'), ('s', 'K', 'u', 'u'), ('a', 'K', 'u', 'u'), ('u', 'K', 'a', 'a'),
    ('0', 'R', 'user', 'u'), ('s', 'R', 'user', 'u'), ('a', 'R', 'user', 'u'), ('u', 'R', 'assistant', 'a')
), moves AS (
  SELECT a, letter, e.role, b, repeat('I', length(roles)) || letter AS letters,
    5 * length(roles) + CASE letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS cost,
    replace(replace(roles, 'u', 'U'), 'a', 'assistant:' || chr(10)) AS roles
  FROM inserts i JOIN edits e USING (m)
), steps AS (
  SELECT c.conv_id, 0::BIGINT AS place, '0' AS state, 0::BIGINT AS cost, '' AS audit, '' AS body FROM (SELECT DISTINCT conv_id FROM damaged) c
  UNION ALL
  SELECT conv_id, place, state, best.cost, best.audit, best.body FROM (
    SELECT s.conv_id, s.place + 1 AS place, m.b AS state, min({
      'cost': (s.cost + m.cost + CASE WHEN m.letter <> 'D' AND j.cut_off THEN 5 ELSE 0 END)::BIGINT,
      'audit': s.audit || m.letters,
      'body': s.body || replace(m.roles, 'U', 'user:' || chr(10)) || CASE m.letter WHEN 'D' THEN '' WHEN 'K' THEN j.role || ':' || j.text || chr(10) ELSE m.role || ':' || j.text || chr(10) END
    }) AS best
    FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.place = s.place + 1
      JOIN moves m ON m.a = s.state AND (m.letter = 'D' OR (NOT j.blank AND NOT j.seen AND (m.letter = 'R' OR m.role = j.initial)))
    GROUP BY ALL
  )
), finished AS (
  SELECT s.conv_id, min({
    'cost': cost + CASE state WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END,
    'audit': audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END,
    'body': body || CASE state WHEN 'u' THEN 'assistant:' || chr(10) WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) ELSE '' END
  }) AS best
  FROM steps s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.place GROUP BY s.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(left(best.body, greatest(length(best.body) - 1, 0)::INTEGER), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN finished d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
