"""Text, conversation and token-sequence queries on documents, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import samples as P
from ..functions import text as X
from ..functions.hashing import uniform, uniform_sql
from ..operators import conversations as C
from ..operators import series as R
from ..session import table
from .registry import query

_OPENING = "(CASE doc_id % 4 WHEN 0 THEN 'The image features ' WHEN 1 THEN 'In this image, we see ' WHEN 2 THEN 'This is In the image, ' ELSE '' END || text)"
_CHAIN = _OPENING
for _phrase in X.CAPTION_PHRASES:
    _CHAIN = f"replace({_CHAIN}, '{_phrase.replace(chr(39), chr(39) * 2)}', '')"


@query(f"SELECT doc_id, length(c) AS n, md5(c) AS caption_md5 FROM (SELECT doc_id, {_CHAIN} AS c FROM documents)")
def caption_clean(spark: SparkSession, d: str) -> DataFrame:
    opened = F.concat(F.when(F.col("doc_id") % 4 == 0, "The image features ").when(F.col("doc_id") % 4 == 1, "In this image, we see ").when(F.col("doc_id") % 4 == 2, "This is In the image, ").otherwise(""), F.col("text"))
    cleaned = table(spark, d, "documents").select("doc_id", X.clean_caption(opened).alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("n"), F.md5(F.col("c").cast("binary")).alias("caption_md5"))


@query(r"""
WITH t AS (SELECT doc_id, text AS t FROM documents)
SELECT doc_id, md5(CASE WHEN ends_with(t, '.') THEN t || ' Then stop.' WHEN regexp_matches(t, '\p{L}$') THEN t || '.' || ' Then stop.' ELSE t END) AS instruction_md5 FROM t
""")
def instruction_suffix(spark: SparkSession, d: str) -> DataFrame:
    ended = X.with_suffix_sentence(F.col("text"), " Then stop.", strict=False)
    return table(spark, d, "documents").select("doc_id", F.md5(ended.cast("binary")).alias("instruction_md5"))


@query(r"""
WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN text || chr(10) || '<image>' ELSE text END AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS mapped,
  md5(CASE WHEN ends_with(t, chr(10) || '<image>') THEN '<image>' || chr(10) || substr(t, 1, length(t) - 8) ELSE t END) AS moved_md5,
  length(CASE WHEN contains(t, '<image>') THEN '<image>' ELSE t END) AS n_only, length(replace(t, chr(10), '')) AS n_flat FROM t
""")
def conv_clean(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("\n<image>"))).otherwise(F.col("text"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", t.alias("t"))
    return rows.select("conv_id", "turn", X.chat_role(F.when(F.col("role") == "user", "human").otherwise("gpt")).alias("mapped"), F.md5(X.image_tag_first(F.col("t")).cast("binary")).alias("moved_md5"), F.length(X.only_image_tag(F.col("t"))).cast("bigint").alias("n_only"), F.length(X.without_newlines(F.col("t"))).cast("bigint").alias("n_flat"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pair FROM conversations WHERE role IN ('user', 'assistant'))
SELECT u.conv_id, u.pair, md5(u.text) AS question_md5, md5(a.text || '<eos>') AS answer_md5 FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.pair = a.pair AND u.role = 'user' AND a.role = 'assistant'
""")
def conv_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = C.question_answer_pairs(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return pairs.select("conv_id", F.col("pair").cast("bigint").alias("pair"), F.md5(F.col("question").cast("binary")).alias("question_md5"), F.md5(F.concat("answer", F.lit("<eos>")).cast("binary")).alias("answer_md5"))


@query(r"""
WITH p AS (SELECT page_id, url || '/layer.' || page_id AS name, url FROM pages)
SELECT page_id, regexp_replace(name, '.[0-9]+$', '') AS stem, list_extract(string_split(url, '/'), -1) AS last, CASE WHEN ends_with(url, '.jpg') THEN url ELSE url || '.jpg' END AS path,
  split_part(url || ' | x', ' | ', 1) AS first FROM p
""")
def path_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("url"), F.lit("/layer."), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", X.without_index(name).alias("stem"), X.last_component(F.col("url")).alias("last"), X.with_extension(F.col("url")).alias("path"), X.first_segment(F.concat("url", F.lit(" | x"))).alias("first"))


def _ids(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Documents with word stand-ins for token ids: 100 + the word's length."""
    own = F.transform(X.words(F.col("text"), limit), lambda w: (F.length(w) + 100).cast("int"))
    return table(spark, d, "documents").select("doc_id", own.alias("ids"))


_IDS = r"WITH t AS (SELECT doc_id, [length(w) + 100 FOR w IN regexp_extract_all(text, '[^\x20\x09-\x0D]+')][1:{n}] AS ids FROM documents)"
_PAD = "list_concat({x}, [{v} FOR i IN range(0, greatest(0, {n} - len({x})))])"


def _joined(df: DataFrame, sequence) -> DataFrame:
    s = df.select("doc_id", sequence.alias("s"))
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    spans = F.array_join(F.transform("s.positions", lambda p: F.concat_ws(":", p["offset"].cast("string"), p["length"].cast("string"))), " ")
    m = S.masks(F.col("s.tokens"))
    return s.select("doc_id", join("s.tokens").alias("tokens"), join("s.labels").alias("labels"), spans.alias("positions"), F.col("s.used").cast("bigint").alias("used"), join(m["text_mask"]).alias("text_mask"), join(m["image_mask"]).alias("image_mask"))


def _layout_sql(n: int, length: int, tokens: str, labels: str, spans: str) -> str:
    pad = lambda x, v: _PAD.format(x=x, v=v, n=length)
    return (
        _IDS.format(n=n)
        + f", s AS (SELECT doc_id, {tokens} AS k, {labels} AS l, {spans} AS spans FROM t), p AS (SELECT doc_id, {pad('k', 0)} AS k, {pad('l', -100)} AS l, spans, len(k) AS used FROM s) "
        + "SELECT doc_id, array_to_string(k, ' ') AS tokens, array_to_string(l, ' ') AS labels, spans AS positions, used, array_to_string([(v NOT IN (0, 8, 9))::INT FOR v IN k], ' ') AS text_mask, array_to_string([(v = 9)::INT FOR v IN k], ' ') AS image_mask FROM p"
    )


_IMG, _IGN = "[9 FOR i IN range(0, 6)]", "[-100 FOR i IN range(0, 6)]"


@query(_layout_sql(10, 24, f"[1] || ids || [3] || {_IMG} || [4, 2]", "[-100 FOR i IN range(0, len(ids) + 10)]", "(len(ids) + 2) || ':6'"))
def seq_generation(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_ids(spark, d, 10), S.generation(F.col("ids"), 6, 24))


@query(_layout_sql(10, 24, f"[1, 3] || {_IMG} || [4] || ids || [2]", f"[1, 3] || {_IGN} || [4] || ids || [2]", "'2:6'"))
def seq_understanding(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_ids(spark, d, 10), S.understanding(F.col("ids"), 6, 24))


_FUTURE = f"[3] || {_IMG} || [4, 2]"


@query(_layout_sql(8, 30, f"[1, 3] || {_IMG} || [4] || ids || {_FUTURE}", f"[-100 FOR i IN range(0, len(ids) + 9)] || {_FUTURE}", "'2:6 ' || (len(ids) + 10) || ':6'"))
def seq_observation_future(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_ids(spark, d, 8), S.observation_future(F.col("ids"), 6, 30))


_ACTED = f"[3] || {_IMG} || [4]"


@query(_layout_sql(8, 36, f"[1, 3] || {_IMG} || [4] || ids || {_ACTED} || [5, 8, 8, 8, 6, 2]", f"[-100 FOR i IN range(0, len(ids) + 9)] || {_ACTED} || [-100, -100, -100, -100, -100, 2]", "'2:6 ' || (len(ids) + 10) || ':6 ' || (len(ids) + 18) || ':3'"))
def seq_actions(spark: SparkSession, d: str) -> DataFrame:
    return _joined(_ids(spark, d, 8), S.with_actions(F.col("ids"), 6, 3, 36))


@query(r"""
WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM conversations)
SELECT conv_id, turn, coalesce(sum(n + 8) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 + n + 1 AS image_offset, 6 AS length FROM t
""")
def seq_interleaved_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.size(X.words(F.col("text"))).alias("n"))
    return C.interleave(rows, "conv_id", "turn", F.col("n"), 6)


@query(f"SELECT doc_id, CASE WHEN {uniform_sql('doc_id', 'drop')} < 0.1 THEN '' ELSE md5(text) END AS prompt, {uniform_sql('doc_id', 'flip')} < 0.3 AS flipped FROM documents")
def condition_dropout(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", P.dropped_condition(F.md5(F.col("text").cast("binary")), uniform(key, "drop"), 0.1).alias("prompt"), (uniform(key, "flip") < 0.3).alias("flipped"))


@query("""
SELECT event_id, printf('chunk-%03d/episode_%06d', event_id // 1000, event_id) AS path,
  CASE WHEN event_type LIKE '%a%' THEN 'extra/' || user_id || '/' || event_id ELSE 'camera/' || event_id || '.jpg' END AS frame FROM events
""")
def episode_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.format_string("chunk-%03d/episode_%06d", F.expr("event_id div 1000"), "event_id").alias("path"),
        F.when(F.col("event_type").like("%a%"), F.concat(F.lit("extra/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("camera/"), F.col("event_id").cast("string"), F.lit(".jpg"))).alias("frame"),
    )


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, CASE WHEN idx > n / 2 AND """ + uniform_sql("event_id", "switch") + """ < idx / n::DOUBLE THEN 'put it back' ELSE 'pick it up' END AS instruction FROM e
""")
def instruction_switch(spark: SparkSession, d: str) -> DataFrame:
    e = R.placed(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], n="n")
    said = P.late_instruction(F.col("idx"), F.col("n"), F.col("n") / 2, uniform(F.col("event_id"), "switch"), "pick it up", "put it back")
    return e.select("event_id", said.alias("instruction"))
