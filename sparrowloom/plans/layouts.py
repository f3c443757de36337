"""Interleaved, multi-turn and inference layouts of token sequences, on conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.text import words
from ..operators import conversations as C
from ..session import table
from .registry import query
from .text import _ids, _joined, _layout_sql

N_IMAGE, IMAGE_TOKEN = 3, 77
_IMG = "[3, 9, 9, 9, 4]"
_T = r"WITH t AS (SELECT conv_id, turn, [length(w) + 100 FOR w IN regexp_extract_all(text, '[^\x20\x09-\x0D]+')][1:6] AS ids, turn % 2 = 0 AS has, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE turn IS NOT NULL)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with stand-ins for token ids (six at most, a tokenizer's own limit), those of even number with an image."""
    ids = F.transform(F.slice(words(F.col("text")), 1, 6), lambda w: (F.length(w) + 100).cast("int"))
    return table(spark, d, "conversations").where("turn is not null").select("conv_id", "turn", "role", ids.alias("ids"), (F.col("turn") % 2 == 0).alias("has"))


def _shown(df: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    spans = F.array_join(F.transform("s.positions", lambda p: F.concat_ws(":", p["offset"].cast("string"), p["length"].cast("string"))), " ")
    return df.select("conv_id", join("s.tokens").alias("tokens"), join("s.labels").alias("labels"), spans.alias("positions"), F.col("s.used").cast("bigint").alias("used"))


def _interleaved_sql(flag: list[int], length: int, most: int) -> str:
    return f"""{_T}, p AS (SELECT conv_id, turn, has, CASE WHEN nth = 1 THEN {flag}::INT[] || ids ELSE ids END AS text FROM t),
q AS (SELECT conv_id, turn, has, len(text) AS n, CASE WHEN has THEN text || {_IMG} ELSE text END AS piece FROM p),
o AS (SELECT *, 1 + coalesce(sum(len(piece)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n + 1 AS off FROM q),
g AS (SELECT conv_id, [1] || flatten(list(piece ORDER BY turn)) || [2] AS k, coalesce(list(off || ':3' ORDER BY turn) FILTER (has), []) AS spans FROM o GROUP BY conv_id),
l AS (SELECT *, [CASE WHEN i >= 2 AND i <= {1 + len(flag)} THEN -100 ELSE k[i] END FOR i IN range(1, len(k) + 1)] AS lab FROM g)
SELECT conv_id, array_to_string(k || [0 FOR i IN range(0, greatest(0, {length} - len(k)))], ' ') AS tokens, array_to_string(lab || [-100 FOR i IN range(0, greatest(0, {length} - len(k)))], ' ') AS labels,
  array_to_string(spans || ['0:0' FOR i IN range(0, greatest(0, {most} - len(spans)))], ' ') AS positions, len(k) AS used FROM l"""


@query(_interleaved_sql([], 64, 4))
def seq_interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Text and image in turn; what is longer than the length stays longer, without padding."""
    return _shown(C.interleaved_sequence(_turns(spark, d), "conv_id", "turn", F.col("ids"), F.col("has"), N_IMAGE, 64, 4))


@query(_interleaved_sql([61, 62], 80, 6))
def seq_story(spark: SparkSession, d: str) -> DataFrame:
    """A story's sequence: flag tokens before the first text, not learned."""
    return _shown(C.interleaved_sequence(_turns(spark, d), "conv_id", "turn", F.col("ids"), F.col("has"), N_IMAGE, 80, 6, flag=(61, 62)))


def _multi_sql(first: str, asked: str, length: int) -> str:
    return f"""{_T.replace("turn IS NOT NULL", "role IN ('user', 'assistant')").replace("row_number()", "role, row_number()").replace("PARTITION BY conv_id", "PARTITION BY conv_id, role")},
p AS (SELECT u.conv_id, u.nth - 1 AS pair, CASE WHEN u.nth = 1 THEN [77] || u.ids ELSE u.ids END AS q, a.ids || [2] AS a FROM t u JOIN t a ON u.conv_id = a.conv_id AND u.nth = a.nth AND u.role = 'user' AND a.role = 'assistant'),
w AS (SELECT conv_id, pair, a, {first} AS q FROM p),
s AS (SELECT conv_id, pair, a, list_position(q, 77) AS img, CASE WHEN list_contains(q, 77) THEN q[1:list_position(q, 77) - 1] || {_IMG} || q[list_position(q, 77) + 1:] ELSE q END AS source FROM w),
o AS (SELECT *, 1 + coalesce(sum(len(source) + len(a)) OVER (PARTITION BY conv_id ORDER BY pair ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + img AS off FROM s),
g AS (SELECT conv_id, [1] || flatten(list(source || a ORDER BY pair)) AS k, [-100] || flatten(list({asked} || a ORDER BY pair)) AS l, coalesce(list(off || ':3' ORDER BY pair) FILTER (img > 0), []) AS spans FROM o GROUP BY conv_id)
SELECT conv_id, array_to_string((k || [0 FOR i IN range(0, {length})])[1:{length}], ' ') AS tokens, array_to_string((l || [-100 FOR i IN range(0, {length})])[1:{length}], ' ') AS labels,
  CASE WHEN len(spans) = 0 THEN '0:0' ELSE array_to_string(spans, ' ') END AS positions, len(k) AS used FROM g"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Question and answer ids; the first question begins with the image token, answers close with the end."""
    pairs = C.question_answer_pairs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    ids = lambda c: F.transform(F.slice(words(F.col(c)), 1, 6), lambda w: (F.length(w) + 100).cast("int"))
    return pairs.select("conv_id", "pair", F.when(F.col("pair") == 0, F.concat(S.ints(IMAGE_TOKEN), ids("question"))).otherwise(ids("question")).alias("q"), F.concat(ids("answer"), S.ints(2)).alias("a"))


@query(_multi_sql("(CASE WHEN pair = 0 THEN [51, 52] ELSE [] END) || [53] || q || [2] || [54, 55]", "[-100 FOR i IN range(0, len(source))]", 40))
def seq_multi_turn(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with role tokens and a system prompt, questions not learned, cut to the length."""
    return _shown(C.multi_turn_sequence(_pairs(spark, d), "conv_id", "pair", F.col("q"), F.col("a"), N_IMAGE, 40, IMAGE_TOKEN, roles=((53,), (54, 55)), system=(51, 52)))


@query(_multi_sql("q", "source", 48))
def seq_multi_turn_plain(spark: SparkSession, d: str) -> DataFrame:
    """Pairs alone, questions learned."""
    return _shown(C.multi_turn_sequence(_pairs(spark, d), "conv_id", "pair", F.col("q"), F.col("a"), N_IMAGE, 48, IMAGE_TOKEN, roles=None, learn_questions=True))


_I = r"WITH t AS (SELECT doc_id, [length(w) + 100 FOR w IN regexp_extract_all(text, '[^\x20\x09-\x0D]+')][1:10] AS ids FROM documents)"


def _twins(df: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return df.select("doc_id", join("s.given.tokens").alias("given"), join("s.empty.tokens").alias("empty"), F.col("s.given.positions")[0]["offset"].cast("bigint").alias("given_offset"), F.col("s.empty.positions")[0]["offset"].cast("bigint").alias("empty_offset"))


@query(_I + f" SELECT doc_id, array_to_string([1] || ids || {_IMG} || [2] || [0 FOR i IN range(0, 10 - len(ids))], ' ') AS given, array_to_string([1] || {_IMG} || [2] || [0 FOR i IN range(0, 10)], ' ') AS empty, len(ids) + 2 AS given_offset, 2::BIGINT AS empty_offset FROM t")
def seq_inference(spark: SparkSession, d: str) -> DataFrame:
    """A prompt's sequence and its empty twin, padded on the right to one length."""
    return _twins(_ids(spark, d, 10).select("doc_id", S.inference(F.col("ids"), N_IMAGE, 10).alias("s")))


@query(_I + f""", l AS (SELECT doc_id, [1] || ids || {_IMG} AS g, [1] || ids[1:2] || {_IMG} AS e, ids, ceil(greatest(len(ids) + 6, len(ids[1:2]) + 6) / 128.0) * 128 AS n FROM t)
SELECT doc_id, array_to_string(g || [0 FOR i IN range(0, (n - len(g))::BIGINT)], ' ') AS given, array_to_string(e || [0 FOR i IN range(0, (n - len(e))::BIGINT)], ' ') AS empty, len(ids) + 2 AS given_offset, len(ids[1:2]) + 2 AS empty_offset FROM l""")
def seq_inference_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and null prompt padded to a multiple of 128."""
    return _twins(_ids(spark, d, 10).select("doc_id", S.mixed_inference(F.col("ids"), F.slice("ids", 1, 2), N_IMAGE).alias("s")))


@query(_layout_sql(10, 28, "[1, 31, 32, 33] || ids || [2, 34] || [3] || [9 FOR i IN range(0, 6)] || [4, 2]", "[1] || [-100 FOR i IN range(0, 3 + len(ids))] || [2, -100, 3] || [-100 FOR i IN range(0, 6)] || [4, 2]", "(len(ids) + 7) || ':6'"))
def seq_generation_system(spark: SparkSession, d: str) -> DataFrame:
    """Generation with a system prompt: tokens before the text, an end, tokens after it."""
    return _joined(_ids(spark, d, 10), S.generation(F.col("ids"), 6, 28, system=((31, 32), (33,), (34,))))


@query(_I + " SELECT doc_id, array_to_string([CASE WHEN i >= 2 AND i < 6 THEN 0 ELSE ids[i] END FOR i IN range(1, len(ids) + 1)], ' ') AS cleared, 1024 - (2 + 3 * (256 + 2) + 5) AS budget, (ceil(len(ids) / 4.0) * 4)::INT AS up FROM t")
def seq_budgets(spark: SparkSession, d: str) -> DataFrame:
    """A loss mask cleared over the observation and its time token, the text's budget, and lengths rounded up."""
    ids = _ids(spark, d, 10)
    cleared = S.clear_span(F.col("ids"), F.lit(2), F.lit(3))
    return ids.select("doc_id", F.array_join(F.transform(cleared, lambda v: v.cast("string")), " ").alias("cleared"), F.lit(S.text_budget(1024, 3, 256, 5)).alias("budget"), S.rounded_up(F.size("ids"), 4).alias("up"))


@query("""
SELECT * FROM (VALUES ('llama3', 'bos', '<|begin_of_text|>'), ('llama3', 'boi', '<|img_start|>'), ('llama3', 'eoi', '<|img_end|>'), ('llama3', 'bov', '<|vid_start|>'), ('llama3', 'eov', '<|vid_end|>'), ('llama3', 'img_pad', '<|image_pad|>'), ('llama3', 'vid_pad', '<|video_pad|>'), ('llama3', 'img', '<image>'),
  ('qwen2_5', 'bos', '<|im_start|>'), ('qwen2_5', 'boi', '<|vision_start|>'), ('qwen2_5', 'eoi', '<|vision_end|>'), ('qwen2_5', 'bov', '<|vid_start|>'), ('qwen2_5', 'eov', '<|vid_end|>'), ('qwen2_5', 'img_pad', '<|image_pad|>'), ('qwen2_5', 'vid_pad', '<|video_pad|>'), ('qwen2_5', 'img', '<image>'),
  ('qwen2_5', 'boa', '<|act_start|>'), ('qwen2_5', 'eoa', '<|act_end|>'), ('qwen2_5', 'act_pad', '<|act_pad|>')) t(family, name, token)
""")
def special_token_table(spark: SparkSession, d: str) -> DataFrame:
    rows = [(f, n, t) for f in S.SPECIAL for n, t in S.special_tokens(f, actions=f == "qwen2_5").items()]
    return spark.createDataFrame(rows, "family string, name string, token string")
