"""Top-k, nucleus and expert selection, ordering and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import choice
from .mixing import MOST_SOURCES, at_most


def topk_keep(values: Column, k: int) -> Column:
    """The indices of values not below the k-th largest; ties with it stay. Within the row."""
    kth = F.element_at(F.sort_array(values, asc=False), k)
    marked = F.zip_with(values, F.array_repeat(kth, F.size(values)), lambda v, t: v >= t)
    return F.filter(F.transform(marked, lambda keep, i: F.when(keep, i)), lambda i: i.isNotNull())


def nucleus(logits: DataFrame, row: str, index: str, logit: str, p: float) -> DataFrame:
    """Rows (row, index) whose more likely ones sum to p at most; the most likely always stays.

    Long form: a row's candidates are ranked by a window, so any vocabulary size works.
    """
    whole = Window.partitionBy(row)
    ranked = Window.partitionBy(row).orderBy(F.desc("_w"), index)
    weighed = logits.withColumn("_w", F.exp(F.col(logit) - F.max(logit).over(whole)))
    shared = weighed.withColumn("prob", F.col("_w") / F.sum("_w").over(whole))
    before = F.coalesce(F.sum("prob").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return shared.withColumn("before", before).withColumn("rank", F.row_number().over(ranked)).where(f"before <= {p}D").drop("_w")


def route(probabilities: Column, k: int, renormalize: bool = True) -> Column:
    """The k most likely experts as (expert, weight); ties by index. Within the row."""
    marked = F.transform(probabilities, lambda p, i: F.struct((-p).alias("order"), i.alias("expert"), p.alias("weight")))
    top = F.slice(F.array_sort(marked), 1, k)
    if not renormalize:
        return F.transform(top, lambda t: F.struct(t["expert"].alias("expert"), t["weight"].alias("weight")))
    total = F.aggregate(top, F.lit(0.0), lambda a, t: a + t["weight"])
    return F.zip_with(top, F.array_repeat(total, k), lambda t, s: F.struct(t["expert"].alias("expert"), (t["weight"] / s).alias("weight")))


def latest_step(names: DataFrame, run: list[str], name: str) -> DataFrame:
    """The name with the largest number after its last dash, for each run."""
    step = F.element_at(F.split(name, "-"), -1).cast("bigint")
    return names.groupBy(*run).agg(F.max_by(name, step).alias("latest"), F.max(step).alias("step"))


def retire(names: DataFrame, run: list[str], step: str, limit: int) -> DataFrame:
    """What goes before another save so that limit are left after it: all but the newest limit - 1 of each run."""
    newest = F.row_number().over(Window.partitionBy(*run).orderBy(F.desc(step)))
    return names.withColumn("_place", newest).where(F.col("_place") > limit - 1).drop("_place")


def frame_indices(n: Column, m: int) -> Column:
    """m indices from 0 to n - 1 at equal distances, rounded down."""
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.floor(k * (n - 1) / F.lit(m - 1)).cast("int"))


def sampled_frames(n: Column, rate: Column, per_second: float, most: int, force: bool = False) -> Column:
    """Every round(rate / per_second)-th frame; `most` frames at equal distances where that gives more, or where forced."""
    stride = F.greatest(F.lit(1), F.bround(rate / F.lit(per_second)).cast("int"))
    strided = F.sequence(F.lit(0), (n - 1).cast("int"), stride)
    even = frame_indices(n, most)
    return even if force else F.when(F.size(strided) > most, even).otherwise(strided)


def substituted(rows: DataFrame, others: DataFrame, name: str, key: str, values: str, draw: Column, salt: str) -> DataFrame:
    """rows whose name is replaced by one of the values of its key, drawn anew for each row; a name without a key stays.

    others is a parameter table (more than MOST_SOURCES keys fail) of distinct keys.
    """
    table = F.broadcast(at_most(others.select(F.col(key).alias("_key"), F.col(values).alias("_values")), MOST_SOURCES, "substitutes"))
    pick = F.get("_values", choice(draw, salt, F.size("_values")))
    found = rows.join(table, F.col(name) == F.col("_key"), "left")
    return found.withColumn(name, F.when(F.col("_key").isNull() | (F.size("_values") == 0), F.col(name)).otherwise(pick)).drop("_key", "_values")


def last_real_token(tokens: Column, pad: int) -> Column:
    """The index of the last token that is no pad; 0 if all are."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t != pad, i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(at), F.lit(0))


def until_stop(tokens: Column, stops: list[int], most: int) -> Column:
    """Tokens up to the first stop token, itself included, and at most `most`."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t.isin(stops), i + 1)), lambda i: i.isNotNull())
    return F.slice(tokens, F.lit(1), F.least(F.lit(most), F.coalesce(F.array_min(at), F.lit(most))))


def weighted_choice(draws: DataFrame, weights: DataFrame, u: str, name: str, weight: str) -> DataFrame:
    """For each draw the first name whose cumulative weight reaches u (weights normalised first, ordered by name).

    The weights are a parameter table of MOST_SOURCES names at most (more fail);
    draws see it as one row with an ordered array, so nothing is joined by range.
    """
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)))
    cumulated = at_most(weights.select(name, weight), MOST_SOURCES, "weights").select(name, (F.sum(weight).over(Window.orderBy(name)) / total).alias("cum"))
    listed = cumulated.agg(F.array_sort(F.collect_list(F.struct("cum", name))).alias("table"))
    pick = F.coalesce(F.element_at(F.filter("table", lambda s: s["cum"] >= F.col(u)), 1)[name], F.element_at("table", -1)[name])
    return draws.join(F.broadcast(listed)).withColumn(name, pick).drop("table")


def combined(routes: DataFrame, experts: DataFrame, row: str, expert: str, weight: str, gain: str) -> DataFrame:
    """(row, output): the gains of a row's experts, summed by weight. experts is a parameter table (more than MOST_SOURCES fail)."""
    known = F.broadcast(at_most(experts.select(expert, gain), MOST_SOURCES, "experts"))
    return routes.join(known, expert).groupBy(row).agg(F.sum(F.col(weight) * F.col(gain)).alias("output"))


def scattered(spans: Column, length: int) -> Column:
    """(q, span, place) for the positions below `length` that spans (offset, length) cover, within the row.

    span counts from 1, place from the span's start; of overlapping spans the later one wins.
    """
    at = lambda q: F.filter(F.transform(spans, lambda s, i: F.when((q >= s["offset"]) & (q < s["offset"] + s["length"]), F.struct(q.alias("q"), (i + 1).alias("span"), (q - s["offset"]).alias("place")))), lambda x: x.isNotNull())
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda q: F.try_element_at(at(q), F.lit(-1))), lambda x: x.isNotNull())
