"""Conversations as turn rows: question and answer pairs, interleaved and multi-turn token layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S


def question_answer_pairs(turns: DataFrame, conversation: str, order: str, role: str, text: str) -> DataFrame:
    """The i-th user turn with the i-th assistant turn; what has no partner goes."""
    ranked = turns.where(F.col(role).isin("user", "assistant")).withColumn("pair", F.row_number().over(Window.partitionBy(conversation, role).orderBy(order)) - 1)
    # One aggregation by (conversation, pair): both sides share the window's key, so no join is needed.
    both = ranked.groupBy(conversation, "pair").agg(F.max(F.when(F.col(role) == "user", F.struct(F.col(text).alias("t")))).alias("q"), F.max(F.when(F.col(role) == "assistant", F.struct(F.col(text).alias("t")))).alias("a"))
    return both.where("q is not null and a is not null").select(conversation, "pair", F.col("q.t").alias("question"), F.col("a.t").alias("answer"))


def turn_offsets(turns: DataFrame, conversation: str, order: str, size: Column) -> DataFrame:
    """turns with offset: the tokens before each turn of its conversation."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("size", size).withColumn("offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def interleave(turns: DataFrame, conversation: str, order: str, text_size: Column, n_image: int) -> DataFrame:
    """(conversation, place, image_offset, length): where each turn's image lies when text and image alternate.

    A turn takes its text, two image marks and n_image pads; the sequence begins with one mark.
    """
    placed = turn_offsets(turns, conversation, order, text_size + 2 + n_image)
    return placed.select(conversation, order, (F.col("offset") + 1 + text_size + 1).cast("bigint").alias("image_offset"), F.lit(n_image).alias("length"))


def _whole(parts: DataFrame, conversation: str, order: str) -> DataFrame:
    """(conversation, tokens, labels, positions): the parts (tokens, labels, image offset in the sequence or null) in order.

    A conversation's parts meet in one row, since its sequence is one value.
    """
    listed = parts.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(order, "tokens", "labels", "image"))).alias("parts"))
    joined = lambda c: F.flatten(F.transform("parts", lambda p: p[c]))
    images = F.filter(F.transform("parts", lambda p: p["image"]), lambda i: i.isNotNull())
    return listed.select(conversation, joined("tokens").alias("tokens"), joined("labels").alias("labels"), images.alias("images"))


def _placed(parts: DataFrame, conversation: str, order: str, image: Column) -> DataFrame:
    """parts with image: where the pads of a part's image begin, counted after one token at the sequence's begin."""
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.size("tokens")).over(w), F.lit(0)) + 1
    return parts.withColumn("image", (ahead + image).cast("int"))


def _spans(images: Column, n_image: int, least: int) -> Column:
    spans = F.transform(images, lambda o: F.struct(o.alias("offset"), F.lit(n_image).alias("length")))
    none = F.array_repeat(F.struct(F.lit(0).alias("offset"), F.lit(0).alias("length")), F.greatest(F.lit(0), F.lit(least) - F.size(images)))
    return F.concat(spans, none)


def interleaved_sequence(turns: DataFrame, conversation: str, order: str, text: Column, has_image: Column, n_image: int, length: int, most_images: int, ids: S.Ids = S.Ids(), flag: tuple[int, ...] = (), system: tuple[int, ...] = ()) -> DataFrame:
    """(conversation, s): text and image in turn for each row; text null: none. Labels are the tokens, image pads too.

    flag: tokens before the first text, not learned; system: tokens after the
    begin, not learned. Positions are filled with (0, 0) up to most_images.
    """
    first = F.row_number().over(Window.partitionBy(conversation).orderBy(order)) == 1
    own = turns.select(conversation, order, F.coalesce(text, S.ints()).alias("text"), F.coalesce(has_image, F.lit(False)).alias("has"), first.alias("first"))
    own = own.withColumn("text", F.when(F.col("first"), F.concat(S.ints(*flag), F.col("text"))).otherwise(F.col("text")))
    tokens = F.concat("text", F.when(F.col("has"), S.image_block(n_image, ids)).otherwise(S.ints()))
    parts = _placed(own.withColumns({"tokens": tokens, "labels": tokens}), conversation, order, F.when(F.col("has"), F.size("text") + 1 + len(system)))
    tokens, labels = F.concat(S.ints(ids.bos, *system), F.col("tokens"), S.ints(ids.eos)), F.concat(S.ints(ids.bos), S.times(S.IGNORE, len(system)), F.col("labels"), S.ints(ids.eos))
    learned = F.transform(labels, lambda x, i: F.when((i >= 1) & (i <= len(flag)), F.lit(S.IGNORE)).otherwise(x)) if flag else labels
    padded = F.struct(S.padded(tokens, ids.pad, length).alias("tokens"), S.padded(learned, S.IGNORE, length).alias("labels"), _spans(F.col("images"), n_image, most_images).alias("positions"), F.size(tokens).alias("used"))
    return _whole(parts, conversation, order).select(conversation, padded.alias("s"))


def multi_turn_sequence(pairs: DataFrame, conversation: str, order: str, question: Column, answer: Column, n_image: int, length: int, image: int, ids: S.Ids = S.Ids(), roles: tuple[tuple[int, ...], tuple[int, ...]] | None = ((), ()), system: tuple[int, ...] = (), learn_questions: bool = False) -> DataFrame:
    """(conversation, s): question and answer pairs in order, cut to length; only answers are learned.

    With roles each question stands between the first role's tokens and an end
    with the second's, the first one after system; without (None) it stands
    alone. The first image token of a question becomes an image block.
    """
    first = F.row_number().over(Window.partitionBy(conversation).orderBy(order)) == 1
    own = pairs.select(conversation, order, question.alias("q"), answer.alias("a"), first.alias("first"))
    if roles is not None:
        own = own.withColumn("q", F.concat(F.when(F.col("first"), S.ints(*system)).otherwise(S.ints()), S.ints(*roles[0]), F.col("q"), S.ints(ids.eos), S.ints(*roles[1])))
    at = F.array_position("q", F.lit(image).cast("int")).cast("int")
    blocked = F.concat(F.slice("q", F.lit(1), F.greatest(F.col("at") - 1, F.lit(0))), S.image_block(n_image, ids), F.slice("q", F.col("at") + 1, F.size("q")))
    own = own.withColumn("at", at).withColumn("source", F.when(F.col("at") > 0, blocked).otherwise(F.col("q")))
    asked = F.col("source") if learn_questions else S.times(S.IGNORE, F.size("source"))
    parts = _placed(own.withColumns({"tokens": F.concat("source", "a"), "labels": F.concat(asked, F.col("a"))}), conversation, order, F.when(F.col("at") > 0, F.col("at")))
    tokens, labels = F.concat(S.ints(ids.bos), F.col("tokens")), F.concat(S.ints(S.IGNORE), F.col("labels"))
    cut = lambda c, v: F.slice(S.padded(c, v, length), 1, length)
    spans = _spans(F.col("images"), n_image, 1)
    return _whole(parts, conversation, order).select(conversation, F.struct(cut(tokens, ids.pad).alias("tokens"), cut(labels, S.IGNORE).alias("labels"), spans.alias("positions"), F.size(tokens).alias("used")).alias("s"))
