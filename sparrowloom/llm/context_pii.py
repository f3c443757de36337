"""PII: base patterns, and bootstrapped contextual extraction of further identifiers.

Base patterns (email, ip, card, phone) give the seed entities, and so do secrets:
tokens of SECRET_CHARS characters or more with letters and digits that are
assigned to a word for one (`token = "..."`). Every seed and
every other identifier-shaped token (a run of LEAST_TOKEN characters or more with
a digit or an @, with the groups of digits after it) is an instance. Its lexical
patterns are the word left of it, the two words left of it, the word right of
it, and its own shape (runs of letters and digits; the length, where it is hexadecimal).
Shapes speak for emails and secrets alone: of the other kinds a shape tells no more than
the base pattern, whose check (a card's last digit, an ip's parts) the instance failed. Pattern and instance nodes form a graph whose edges count occurrences. From
the seeds on, round by round until nothing is added:

    pattern(p, kind)  = n with confident instances of the kind / (n with all + 1)
    instance(i, kind) = the best over the four sides of the mean of its patterns' scores by n

A pattern counts with SUPPORT different confident instances and a score of
CONFIDENT or more; an instance with a score of CONFIDENT or more is confident
from then on, so that discovered identifiers make new patterns. Confident
instances that are no seeds are discovered identifiers; of several kinds the one
of the earliest round, then the best score, then the last in order, is taken.
Scores never fall, so the rounds end.

All of it is DataFrame work: a narrow pass cuts each text at a pattern's matches
(the pieces' lengths give the positions), and then slim rows of occurrences are
windowed, joined and grouped. Texts without @ or digit take no further part.
Patterns that count are looked up by broadcast while they are at most
BROADCAST_ROWS (counted first), and else by shuffle; sums are made in parts
before the shuffle.

The patterns are written without backtracking (possessive, and not tried from
inside a run in which they failed before), which leaves the matches as they are
and keeps the time linear.

A context word is known by its last (right of an instance: first) WORD_CHARS
characters within CONTEXT_CHARS of the instance, in small letters, each digit 0.

Defined results: a null or empty text has no spans; a long text is taken whole;
rows that repeat an id and text share their spans and give a row each; a null
doc_id is an id; an empty table gives an empty one; further columns are ignored
(kept as they are by redact(), which rewrites text and, where there is one,
n_chars).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
EVERY_KIND = (*KINDS, "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "": r"(?<![A-Za-z0-9._%+@:/-])[A-Za-z._%+:/-]*+[0-9@][A-Za-z0-9._%+@:/-]*+(?:(?<=[0-9])[ ][0-9]{2,}+(?![A-Za-z0-9._%+@:/-]))*+",
}
LEAST_TOKEN = 6
SUPPORT = 3
CONFIDENT = 0.7
CONTEXT_CHARS, WORD_CHARS = 80, 32
SIDES = ("left", "left2", "right", "shape")
#: Kinds that shapes speak for.
SHAPED = ("email", "secret")
SECRET_CHARS = 16
# Words to which secrets are assigned.
SECRET_WORDS = r"(?:^|[^a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[^a-z0-9]*[=:][^a-z0-9]*$"
BROADCAST_ROWS = 1_000_000

MAYBE = "text is not null and (contains(text, '@') or text rlike '[0-9]')"


def pieces_of(text: Column, pattern: str, when: Column) -> Column:
    """The pieces between the matches in order, each with its length, its ends, and the match after it (none after the last)."""
    piece = lambda gap, m: F.struct(F.length(gap).alias("gap"), F.octet_length(gap).alias("gap_octets"), F.left(gap, F.lit(CONTEXT_CHARS)).alias("head"), F.right(gap, F.lit(CONTEXT_CHARS)).alias("tail"), m.alias("found"))
    return F.when(when, F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece))


def luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    small = r"0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", found.rlike(rf"^{small}(\.{small}){{3}}\z"))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(8, 15))
        .otherwise(F.length(found) >= LEAST_TOKEN)
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, body, kind, start, end, start_octet, end_octet, found, left, left2, right, shape, seed) of base spans, and with kind "" of other tokens; seed is the kind of a seed, else "".

    body is the text's hash: with doc_id it names a row up to repeats.
    """
    text = F.col("text")
    has = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": F.contains(text, F.lit("+")), "": text.rlike("[0-9@]")}
    own = docs.where(MAYBE).select("doc_id", F.xxhash64("text").alias("body"), F.array(*[F.struct(F.lit(k).alias("kind"), pieces_of(text, p, has[k]).alias("hits")) for k, p in PATTERNS.items()]).alias("every"))
    by_kind = own.select("doc_id", "body", F.explode("every").alias("e")).where("size(e.hits) > 1").select("doc_id", "body", "e.kind", F.posexplode("e.hits").alias("at", "hit"))
    rows = by_kind.select("doc_id", "body", "kind", "at", "hit.*").distinct()
    run = Window.partitionBy("doc_id", "body", "kind").orderBy("at")
    upto, before = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(upto) + F.coalesce(F.sum(F.length("found")).over(before), F.lit(0))
    octet = F.sum("gap_octets").over(upto) + F.coalesce(F.sum(F.octet_length("found")).over(before), F.lit(0))
    placed = rows.select("doc_id", "body", "kind", "found", "tail", F.lead("head").over(run).alias("head"), start.alias("start"), octet.alias("start_octet")).where("found is not null")
    word, blank = rf"[^\x20\x09-\x0D]{{1,{WORD_CHARS}}}", r"[\x20\x09-\x0D]"
    context = lambda side, pattern: F.regexp_replace(F.lower(F.regexp_extract(side, pattern, 1)), "[0-9]", "0")
    kept = placed.where(valid(F.col("kind"), F.col("found"))).select(
        "*",
        context("tail", rf"({word})(?:{blank}|[\"'(=:])*$").alias("left"),
        context("tail", rf"({word}{blank}+{word})(?:{blank}|[\"'(=:])*$").alias("left2"),
        context("head", rf"^(?:{blank}|[\"').,;:])*({word})").alias("right"),
        (F.col("start") + F.length("found")).alias("end"),
        (F.col("start_octet") + F.octet_length("found")).alias("end_octet"),
    )
    token = F.col("found")
    both = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    shape = F.when(both & token.rlike(r"^[0-9A-Fa-f]{16,}+\z"), F.concat(F.lit("x"), F.length(token).cast("string"))).otherwise(F.left(runs, F.lit(CONTEXT_CHARS)))
    assigned = F.lower("tail").rlike(SECRET_WORDS)
    seed = F.when(F.col("kind") != "", F.col("kind")).when(both & (F.length(token) >= SECRET_CHARS) & assigned & ~F.contains(token, F.lit("@")), "secret").otherwise("")
    kept = kept.withColumns({"shape": shape, "seed": seed})
    # A token that overlaps a base span is that span's, not a candidate.
    before = (Window.unboundedPreceding, -1)
    seen = Window.partitionBy("doc_id", "body").orderBy("start", F.col("kind") == "").rowsBetween(*before)
    ahead = Window.partitionBy("doc_id", "body").orderBy(F.desc("start"), F.col("kind") == "").rowsBetween(*before)
    ended = F.max(F.when(F.col("kind") != "", F.col("end"))).over(seen)
    begins = F.min(F.when(F.col("kind") != "", F.col("start"))).over(ahead)
    return kept.withColumns({"ended": ended, "begins": begins}).where("kind <> '' or (coalesce(ended <= start, true) and coalesce(begins >= end, true))").drop("ended", "begins", "head", "tail")


def discover(found: DataFrame) -> DataFrame:
    """(instance, kind): tokens outside the base patterns that confident patterns point to."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in SIDES])
    nodes = found.select(F.lower("found").alias("instance"), F.col("seed").alias("kind"), F.explode(sides).alias("p")).select("p.side", "p.word", "instance", "kind").where("word <> ''")
    # Edges between patterns and instances, with the kind where the instance is a seed.
    edges = cut(nodes.groupBy("side", "word", "instance", "kind").agg(F.count("*").alias("n")), "pii-edges")
    totals = cut(edges.groupBy("side", "word").agg(F.sum("n").alias("word_n")), "pii-words")
    unseen = edges.where("kind = ''").select("side", "word", "instance", "n")
    # What seeds give a pattern stays as it is; discovered instances add to it.
    seeds = cut(edges.where("kind <> ''").groupBy("side", "word", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("many")), "pii-seeds")
    known, n_known = None, 0
    while True:
        mass = seeds
        if known is not None:
            mass = seeds.unionByName(unseen.join(known.select("instance", "kind"), "instance").groupBy("side", "word", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("many")))
        summed = mass.groupBy("side", "word", "kind").agg(F.sum("n").alias("n"), F.sum("many").alias("many")).where(F.col("many") >= SUPPORT)
        scored = summed.join(totals, ["side", "word"]).select("side", "word", "kind", (F.col("n") / (F.col("word_n") + 1)).alias("pattern"))
        patterns = cut(scored.where((F.col("pattern") >= CONFIDENT) & ((F.col("side") != "shape") | F.col("kind").isin(*SHAPED))), "pii-patterns")
        few = patterns.count() <= BROADCAST_ROWS
        passed = unseen.join(F.broadcast(patterns) if few else patterns, ["side", "word"]).groupBy("instance", "side", "kind").agg(F.sum(F.col("n") * F.col("pattern")).alias("s"))
        of_side = unseen.join(passed.select("instance").distinct(), "instance", "left_semi").groupBy("instance", "side").agg(F.sum("n").alias("side_n"))
        scores = passed.join(of_side, ["instance", "side"]).groupBy("instance", "kind").agg(F.max(F.col("s") / F.col("side_n")).alias("score"))
        sure = scores.where(F.col("score") >= CONFIDENT)
        # Those confident before keep their round and score, which decide between kinds.
        every = sure.withColumn("first", F.lit(0)) if known is None else known.unionByName(sure.join(known, ["instance", "kind"], "left_anti").withColumn("first", F.lit(1)))
        later = cut(every.select("instance", "kind", "score", (F.col("first") - 1).alias("first")), "pii-known")
        n_later = later.count()
        if n_later == n_known:
            return later.groupBy("instance").agg(F.max_by("kind", F.struct(-F.col("first"), "score", "kind")).alias("kind"))
        known, n_known = later, n_later


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, body, kind, start, end, start_octet, end_octet, base) of all rows with spans; rows of equal id and text once."""
    found = cut(occurrences(docs), "pii")
    base = found.where("kind <> ''").select("doc_id", "body", "kind", "start", "end", "start_octet", "end_octet", F.lit(True).alias("base"))
    tokens = found.where("kind = ''").select("doc_id", "body", "start", "end", "start_octet", "end_octet", "seed", F.lower("found").alias("instance"))
    secrets = tokens.where("seed <> ''").select("doc_id", "body", F.col("seed").alias("kind"), "start", "end", "start_octet", "end_octet", F.lit(False).alias("base"))
    more = tokens.where("seed = ''").join(discover(found), "instance").select("doc_id", "body", "kind", "start", "end", "start_octet", "end_octet", F.lit(False).alias("base"))
    return base.unionByName(secrets).unionByName(more)


def digest(docs: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, EVERY_KIND)), F.col("kind"))
    listed = lambda hits: F.array_join(F.transform(hits, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    grouped = spans(docs).groupBy("doc_id", "body").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base"))).alias("hits"),
    )
    own = F.filter("hits", lambda s: s["base"])
    of = lambda kind: F.filter(own, lambda s: s["kind"] == kind)
    per_kind = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    full = grouped.select("doc_id", "body", *per_kind, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("hits")).alias("spans"))
    keyed = docs.where(MAYBE).select("doc_id", F.xxhash64("text").alias("body"))
    some = keyed.alias("d").join(full.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.body = f.body"), "left")
    filled = some.select("d.doc_id", *[F.coalesce(f"f.n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS], F.coalesce("f.base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"), F.coalesce("f.spans", F.lit("")).alias("spans"))
    none = docs.where(f"not coalesce({MAYBE}, false)").select("doc_id", *[F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    return filled.unionByName(none)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span's text replaced by its kind in brackets; of overlapping spans the later keeps what is left of it."""
    line = Window.partitionBy("doc_id", "body").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    flat = spans(docs.select("doc_id", "text")).withColumn("ended", F.coalesce(F.max("end_octet").over(line), F.lit(0))).where("end_octet > ended")
    holes = flat.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start_octet", "ended").alias("a"), F.col("end_octet").alias("b"), F.concat(F.lit("["), F.upper("kind"), F.lit("]")).alias("mark")))).alias("holes"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_body"), F.col("text").alias("text"))
    joined = packed.where(MAYBE).join(holes, F.expr("d_id <=> doc_id and d_body = body"), "left")
    raw = F.encode("text", "utf-8")
    # Each hole with the end of the one before it, and one more at the text's end.
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("holes", lambda h: h["b"]))
    marks = F.concat("holes", F.array(F.struct(F.octet_length("text").cast("bigint").alias("a"), F.octet_length("text").cast("bigint").alias("b"), F.lit("").alias("mark"))))
    parts = F.zip_with(ends, marks, lambda e, h: F.struct(e.alias("e"), h.alias("h")))
    # The bytes go in as an array argument of one element, so that they are made once for all holes.
    clean = F.array_join(F.flatten(F.transform(F.array(raw), lambda r: F.transform(parts, lambda p: F.concat(F.decode(F.substring(r, p["e"].cast("int") + 1, (p["h"]["a"] - p["e"]).cast("int")), "utf-8"), p["h"]["mark"])))), "")
    new = F.when(F.col("holes").isNull(), F.col("text")).otherwise(clean)
    put = lambda c: F.col("new").alias(c) if c == "text" else F.length("new").cast("bigint").alias(c) if c == "n_chars" else F.col("row")[c].alias(c)
    same = packed.where(f"not coalesce({MAYBE}, false)").select("row.*")
    return joined.select("row", new.alias("new")).select(*map(put, docs.columns)).unionByName(same)


def op7_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text"))
