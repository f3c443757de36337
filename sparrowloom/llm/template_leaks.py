"""Benchmark decontamination by template canonicalisation.

One pass cuts a text into words. A number, a unit after a number, and a name
(capitalised words within a sentence, several in a row as one) become typed
placeholders; the strings behind them stay at the same places in an array beside
the template. A placeholder without a literal word within two places is known by
its own string, so every window of WINDOW = 5 template words holds something
that tells it apart, and long lists of numbers match only when they are equal.

Windows are hash-joined with those of the benchmark's items, so a question also
matches after its numbers, units or names were changed. A document and an item
are candidates when at least COVERAGE = 0.8 of the item's windows occur in the
document, or when RUN_WORDS = 13 template words in a row do.

For candidates the slots are compared, alignment by alignment (an alignment is a
shift at which the first place of one of the item's windows meets the same
window in the document), under matching windows only. Of the slots of one value
of the item the share with the commonest counterpart in the document counts, and
the other way round; an alignment with a share below CONSISTENT = 0.5 in either
direction contradicts. A pair is dropped if every alignment that reaches the
coverage or the run contradicts; where only several alignments together reach
the coverage, each slot is taken from the alignment with most windows. An
alignment whose very strings reach the coverage or the run never contradicts.

Windows of documents are made and looked up without a shuffle as long as the
benchmark has at most BROADCAST_ROWS windows (counted first); beyond that both
sides are shuffled by hash and salt, so a common window is spread over SALTS
tasks. Only matches go on. Text is read twice: once for windows, and once more,
for candidates alone, for their slots.

Defined results: a null text, and one without words, matches nothing; a text of
fewer than WINDOW words is one window of its own, met only by a text as short;
rows that repeat an id and text are judged once and share the verdict; a null
doc_id is an id; items that repeat an id and text count once; equal shares and
windows need no tie rule but that of slots, where the lesser shift wins; a long
text costs time in proportion to its words (times the words of its items, where
it repeats their windows); an empty table gives an empty result; further columns
are ignored (kept as they are by drop_leaks()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WINDOW = 5
COVERAGE = 0.8
RUN_WORDS = 13
RUN = RUN_WORDS - WINDOW + 1
CONSISTENT = 0.5
BROADCAST_ROWS = 1_000_000
SALTS = 16

# Unit words that become a placeholder after a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hours hour minutes minute seconds second days day weeks week months month years year meters metres miles feet inches pounds grams liters litres dollars euros cents percent degrees".split()

_LETTERS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
_CAPITAL = rf"[\p{{Lu}}\p{{Lt}}][\p{{Ll}}\p{{M}}]++(?![{_LETTERS}])"
#: A name begins with the blank before it, which no other word does.
_NAME = rf"(?<=[\p{{Ll}},;:]) {_CAPITAL}(?: {_CAPITAL})*+"
_NUMBER = rf"[0-9]++(?:[.,][0-9]++)*+(?=(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})?(?![{_LETTERS}]))"
_WORD = rf"{_NAME}|{_NUMBER}|[{_LETTERS}]++"
#: What the placeholders look like among the words: no other word is a lone digit, since every number becomes 0.
NUMBER, NAME, UNIT = "0", "1", "2"
PLACEHOLDERS = (NUMBER, NAME, UNIT)


def is_number(word: Column) -> Column:
    return (word >= "0") & (word < ":") & word.rlike(r"^[0-9]+(?:[.,][0-9]+)*$")


def read(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, words) from (key, text): the template words; with "values" also the strings at their places."""
    found = rows.select(key, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)).alias("found"))
    small = lambda t: F.trim(F.lower(t))
    before = lambda i: F.coalesce(is_number(F.get("found", i - 1)), F.lit(False))
    typed = found.select(key, "found", F.transform("found", lambda t, i: F.when(t < "0", NAME).when(is_number(t), NUMBER).when(before(i) & F.lower(t).isin(UNITS), UNIT).otherwise(F.lower(t))).alias("typed"))
    near = lambda i: F.slice("typed", F.greatest(i - 1, F.lit(1)), i + 4 - F.greatest(i - 1, F.lit(1)))
    told = lambda w, i: F.when(~w.isin(*PLACEHOLDERS) | F.exists(near(i), lambda x: ~x.isin(*PLACEHOLDERS)), w).otherwise(F.concat(F.lit("#"), small(F.get("found", i))))
    return typed.select(key, F.transform("typed", told).alias("words"), *[F.transform("found", small).alias(v) for v in values])


def windows(read_rows: DataFrame, key: str) -> DataFrame:
    """(key, at, form): the hash of every window of the column words; fewer than WINDOW words are one."""
    # The outer form, since the plain one has a filter on the array's size pushed to the scan, where it makes all words again for each word.
    at = read_rows.select(key, "words", F.posexplode_outer("words").alias("at", "word")).where((F.col("at") <= F.size("words") - WINDOW) | (F.col("at") == 0))
    return at.select(key, "at", F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(WINDOW)]).alias("form"))


def look_up(rows: DataFrame, small: DataFrame, on: str, few: bool) -> DataFrame:
    """rows (with a column doc) joined with a table that is broadcast where it has few rows, and salted else."""
    if few:
        return rows.join(F.broadcast(small), on)
    salted = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit("salt")), F.lit(SALTS)).cast("int")).join(salted, [on, "salt"]).drop("salt")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text): doc is the id with the text's hash, which names a row up to repeats."""
    return docs.where("text is not null").select(F.struct("doc_id", F.xxhash64("text").alias("body")).alias("doc"), "text")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, body, item_id, coverage, run): documents that hold an item; body is the text's hash, run the words in a row."""
    own = benchmark.where("text is not null").select(F.struct("item_id", F.xxhash64("text").alias("item_body")).alias("item"), "text").distinct()
    items = cut(read(own, "item", "values"), "items")
    forms = windows(items, "item").groupBy("item", "form").agg(F.count("*").alias("places"), F.min("at").alias("item_at"))
    forms = cut(forms.withColumn("item_windows", F.sum("places").over(Window.partitionBy("item"))), "forms")
    few = (forms.agg(F.sum("places")).first()[0] or 0) <= BROADCAST_ROWS
    texts = keyed(docs)
    hits = look_up(windows(read(texts, "doc"), "doc"), forms.drop("item_at"), "form", few)
    pairs = hits.groupBy("doc", "item").agg(F.collect_set(F.struct("form", "places")).alias("met"), F.first("item_windows").alias("item_windows"))
    counted = pairs.select("doc", "item", "item_windows", F.aggregate("met", F.lit(0).cast("bigint"), lambda a, m: a + m["places"]).alias("found"))
    likely = cut(counted.where((F.col("found") >= RUN) | (F.col("found") >= COVERAGE * F.col("item_windows"))), "likely")
    lined = cut(alignments(texts, items, forms, likely, few), "alignments")
    # A run of enough words lies in one alignment; the coverage may come from several.
    best = lined.groupBy("doc", "item").agg(F.max("run").alias("run"))
    judged = likely.join(best, ["doc", "item"]).withColumn("coverage", F.col("found") / F.col("item_windows")).where((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN_WORDS))
    return judged.join(contradicted(lined), ["doc", "item"], "left_anti").select("doc.doc_id", "doc.body", "item.item_id", "coverage", "run")


def stretches(marks: Column) -> Column:
    """Lengths of the runs of 1 in a string of 0 and 1."""
    return F.transform(F.split(marks, "0", -1), lambda r: F.length(r))


def alignments(texts: DataFrame, items: DataFrame, forms: DataFrame, likely: DataFrame, few: bool) -> DataFrame:
    """(doc, item, shift, windows, run, reaches, literal, slots) for every alignment of the candidate pairs."""
    ids = likely.select("doc").distinct()
    held = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc", "left_semi").dropDuplicates(["doc"])
    held = cut(read(held, "doc", "values"), "held")
    shifts = look_up(windows(held, "doc"), forms.select("item", "form", "item_at"), "form", few).join(likely.select("doc", "item"), ["doc", "item"], "left_semi")
    shifts = shifts.select("doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    joined = shifts.join(held.select("doc", F.col("words").alias("d_words"), F.col("values").alias("d_values")), "doc")
    joined = look_up(joined, items.select("item", F.col("words").alias("i_words"), F.col("values").alias("i_values")), "item", few)
    other = lambda column, p: F.get(column, p + F.col("shift"))
    mark = lambda side: F.array_join(F.transform(f"i_{side}", lambda w, p: F.when(w.eqNullSafe(other(f"d_{side}", p)), "1").otherwise("0")), "")
    marked = joined.select("*", mark("words").alias("marks"), mark("values").alias("same"), F.least(F.lit(WINDOW), F.size("i_words")).alias("least_run"))
    long_enough = lambda r: F.when(F.length(r) >= F.col("least_run"), r).otherwise(F.repeat(F.lit("-"), F.length(r)))
    in_windows = lambda runs: F.aggregate(runs, F.lit(0), lambda a, r: a + F.greatest(r - F.col("least_run") + 1, F.lit(0)))
    sized = marked.select(
        "*",
        F.array_join(F.transform(F.split("marks", "0", -1), long_enough), "0").alias("under"),
        in_windows(stretches(F.col("marks"))).alias("windows"),
        F.array_max(stretches(F.col("marks"))).alias("run"),
        in_windows(stretches(F.col("same"))).alias("same_windows"),
        F.array_max(stretches(F.col("same"))).alias("same_run"),
        (F.size("i_words") - F.col("least_run") + 1).alias("item_windows"),
    )
    slot = lambda w, p: F.struct(p.alias("place"), w.alias("slot"), F.get("i_values", p).alias("item_value"), other("d_values", p).alias("doc_value"))
    slots = F.filter(F.transform("i_words", slot), lambda s: s["slot"].isin(*PLACEHOLDERS) & (F.substring(F.col("under"), s["place"] + 1, F.lit(1)) == "1"))
    reaches = lambda run, n: (F.col(run) >= RUN_WORDS) | (F.col(n) >= COVERAGE * F.col("item_windows"))
    return sized.select("doc", "item", "shift", "windows", "run", reaches("run", "windows").alias("reaches"), reaches("same_run", "same_windows").alias("literal"), slots.alias("slots"))


def contradicted(lined: DataFrame) -> DataFrame:
    """(doc, item): the pairs of which every alignment that counts contradicts itself."""
    pair = Window.partitionBy("doc", "item")
    known = lined.withColumns({"alone": F.max("reaches").over(pair), "sure": F.max(F.col("literal")).over(pair)}).where("not sure and (reaches or not alone)")
    # Alignments that only reach the coverage together are one view: each slot comes from the one with most windows.
    view = F.when(F.col("alone"), F.col("shift"))
    views = known.withColumn("view", view).groupBy("doc", "item").agg(F.count_distinct(F.coalesce("view", F.lit(0))).alias("views"))
    slots = known.select("doc", "item", view.alias("view"), "shift", "windows", F.explode("slots").alias("s")).select("doc", "item", "view", "shift", "windows", "s.*")
    first = Window.partitionBy("doc", "item", "view", "place").orderBy(F.desc("windows"), "shift")
    slots = slots.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    counts = slots.groupBy("doc", "item", "view", "slot", "item_value", "doc_value").agg(F.count("*").alias("n"))
    by = lambda value: Window.partitionBy("doc", "item", "view", "slot", value).orderBy(F.desc("n"), "item_value", "doc_value")
    ranked = counts.withColumns({"i_rank": F.row_number().over(by("item_value")), "d_rank": F.row_number().over(by("doc_value"))})
    main = lambda rank: F.sum(F.when(F.col(rank) == 1, F.col("n")).otherwise(0)) < CONSISTENT * F.sum("n")
    bad = ranked.groupBy("doc", "item", "view").agg((main("i_rank") | main("d_rank")).alias("bad")).where("bad").groupBy("doc", "item").agg(F.count("*").alias("n_bad"))
    return views.join(bad, ["doc", "item"]).where("n_bad = views").select("doc", "item")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    bad = cut(leaks(docs.select("doc_id", "text"), benchmark).select("doc_id", "body").distinct(), "leaks")
    few = bad.count() <= BROADCAST_ROWS
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_body"))
    return packed.join(F.broadcast(bad) if few else bad, F.expr("d_id <=> doc_id and d_body = body"), "left_anti").select("row.*")


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.col("run").cast("bigint").alias("run"))
