"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

Document evidence: a naive Bayes log-likelihood ratio over binned features of
the text, its counts taken from the labelled documents (as they look to a model
that has not seen them: without the ratios' share of their own words). Four features are shares
of the text's shape, the fifth is the mean log-likelihood ratio of its different
words, of which the WORDS most frequent of the labelled documents have one.
Site evidence: the mean probability of a host's documents, shrunk toward the
global mean, and that of a path's documents, shrunk toward the host's; how
strongly follows from the spread between the sites (method of moments), so
sparse sites lean on their prior and large ones on themselves. A document's
posterior adds its own evidence to the log-odds of its path, from which the
document itself is left out. Host and path are columns; with_site() makes them
from a URL.

A text is read for its bins alone, a small number; sites are aggregated by key
with partial sums. To bring the site values back, sites with at least HOT_SHARE
of all documents (at most 1 / HOT_SHARE of them) are broadcast; only rows of the
other, small sites are shuffled, in score_documents() without their texts. In
keep_quality() the texts of small sites are moved once.

Defined results: a null or empty text has its own bin of every feature; a long
text is read whole; null host and path are sites like any other; without labels
of both kinds the evidence is 0 and every document stays; of several labels of a
document all count; words of equal frequency go by their bytes; repeated rows
give a row each; an empty table gives an empty one; columns of the input stay as
they are in keep_quality().
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop_cut, table
from .line_crf import SYMBOLS, _LETTER, _UPPER, repeated_words

HOT_SHARE = 0.001
TRAIN_DOCS = 20_000
MIN_POSTERIOR = 0.5
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

#: Upper edges of the bins of each feature, as shares; the last bin is open.
EDGES = {
    "symbols": (0.0, 0.05, 0.2),
    "capitals": (0.1, 0.3, 0.6),
    "repeated": (0.1, 0.3, 0.6),
    "doubled": (0.05, 0.2, 0.4),
    "words": (-1.0, -0.5, -0.25),
}
#: The words with a log-likelihood ratio: at most so many, each in so many labelled documents.
WORDS, WORD_DOCS = 5000, 10


def shares(text: str | None, words_llr: dict[bytes, float]) -> tuple[float, float, float, float, float]:
    """Symbols a word, capitals a letter (A-Z), words in repeated 3-word windows, words equal to the one before, mean ratio of the known words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (-1.0,) * 4 + (0.0,)
    letters = len(raw) - len(raw.translate(None, _LETTER))
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    known = [words_llr[w] for w in set(words) & words_llr.keys()]
    return symbols / n, capitals / letters if letters else 0.0, sum(repeated_words(words)) / n, doubled / n, round(sum(known) / len(known), 9) if known else 0.0


def feature_code(column, words_llr: dict[bytes, float]):
    """One integer for a text's bins: a digit to the base 8 for each feature, 0 where there are no words."""

    def binned(text: pd.Series) -> pd.Series:
        rows = np.array([shares(t, words_llr) for t in text], dtype=float).reshape(-1, len(EDGES))
        code = np.zeros(len(rows), np.int64)
        for i, edges in enumerate(EDGES.values()):
            code += np.where(rows[:, 0] < 0, 0, 1 + np.searchsorted(edges, rows[:, i], side="left")) << (3 * i)
        return pd.Series(code)

    return F.pandas_udf(binned, "bigint")(column)


def word_ratios(picked: DataFrame) -> tuple[dict[bytes, float], ...]:
    """The log-likelihood ratio of each frequent word from rows (quality, text), add-one smoothing; and those for a bad and for a good document that leave its own words out."""
    words = picked.select("quality", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).where(F.col("n") >= WORD_DOCS).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    total = {r.quality: r["count"] for r in picked.groupBy("quality").count().collect()}
    if len(total) < 2:
        return {}, {}, {}

    def ratios(bad: int, good: int) -> dict[bytes, float]:
        # A word that only documents of the other kind have is none of this one's.
        return {r.word.encode("utf-8", "surrogatepass"): math.log(max(1, r.good + 1 - good) / (total[1] + 2 - good)) - math.log(max(1, r.n - r.good + 1 - bad) / (total[0] + 2 - bad)) for r in counts}

    return ratios(0, 0), ratios(1, 0), ratios(0, 1)


def evidence_weights(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[dict[bytes, float], list[list[float]]]:
    """The words' ratios, and for each feature those of its bins, from at most limit labelled documents; add-one smoothing."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    # At most limit ids, so they can be broadcast; at most 5^5 codes come back.
    picked = cut(bounded_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text"), "labelled")
    ratios, *without_own = word_ratios(picked)
    codes = [picked.where(F.col("quality") == q).select("quality", feature_code("text", without_own[q]).alias("code")) for q in (0, 1)]
    counts = codes[0].unionByName(codes[1]).groupBy("quality", "code").count().collect()
    drop_cut(picked)
    bins = [[[1.0, 1.0] for _ in range(len(edges) + 2)] for edges in EDGES.values()]
    total = [0, 0]
    for r in counts:
        total[r.quality] += r["count"]
        for i in range(len(EDGES)):
            bins[i][(r.code >> (3 * i)) & 7][r.quality] += r["count"]
    if not all(total):
        return ratios, [[0.0] * len(b) for b in bins]
    return ratios, [[math.log(good / (total[1] + len(b))) - math.log(bad / (total[0] + len(b))) for bad, good in b] for b in bins]


def evidence(code, weights: list[list[float]]):
    out = F.lit(0.0)
    for i, own in enumerate(weights):
        out = out + F.element_at(F.array(*[F.lit(w) for w in own]), (F.shiftright(code, 3 * i).bitwiseAND(F.lit(7)) + 1).cast("int"))
    return out


def _sigmoid(x):
    return 1 / (1 + F.exp(-x))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, total, all_n, strengths and priors) from rows (host, path, p): one row for each path."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy(F.col("host").alias("of_host")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    # The between-site spread of the means, by which a Beta prior's strength follows: m = mean (1 - mean) / spread - 1.
    world = hosts.agg(F.sum("hn").alias("all_n"), F.sum("hs").alias("all_s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("square"))
    mean = F.col("all_s") / F.col("all_n")
    strength = lambda spread, mean: F.when(spread <= 0, F.lit(MAX_STRENGTH)).otherwise(F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), mean * (1 - mean) / spread - 1)))
    world = world.select("all_n", mean.alias("mean"), strength(F.col("square") / F.col("all_n") - mean * mean, mean).alias("host_m"))
    joined = paths.join(hosts, F.expr("host <=> of_host")).drop("of_host")
    spread = joined.agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)) / F.sum("n")).alias("path_spread"))
    # world and spread are one row each.
    return joined.join(F.broadcast(world)).join(F.broadcast(spread)).select("host", "path", "n", "s", "hn", "hs", "all_n", "mean", "host_m", strength(F.col("path_spread"), F.col("mean")).alias("path_m"))


def with_site(docs: DataFrame, url: str = "url") -> DataFrame:
    """docs with host and path from a URL: the host's name, and the first part of the path; null where there is none."""
    return docs.withColumns({"host": F.lower(F.try_parse_url(url, F.lit("HOST"))), "path": F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/?([^/]*)", 1)})


def add_posterior(rows: DataFrame, sites: DataFrame, weights: list[list[float]]) -> DataFrame:
    """rows (row_host, row_path, code, more) with evidence, host_p, path_p and posterior."""
    hot = sites.where(F.col("n") >= HOT_SHARE * F.col("all_n"))
    cold = sites.where(F.col("n") < HOT_SHARE * F.col("all_n"))
    same = F.expr("row_host <=> host and row_path <=> path")
    large = rows.join(F.broadcast(hot), same)
    small = rows.join(F.broadcast(hot.select("host", "path")), same, "left_anti").join(cold, same)
    out = large.unionByName(small).withColumn("evidence", evidence(F.col("code"), weights))
    own = _sigmoid(F.col("evidence"))
    host_p = (F.col("hs") - own + F.col("host_m") * F.col("mean")) / (F.col("hn") - 1 + F.col("host_m"))
    path_p = (F.col("s") - own + F.col("path_m") * F.col("host_p")) / (F.col("n") - 1 + F.col("path_m"))
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_p")))
    return out.withColumn("host_p", host_p).withColumn("path_p", path_p).select(*rows.columns, "evidence", "host_p", "path_p", _sigmoid(F.col("evidence") + F.log(clipped / (1 - clipped))).alias("posterior"))


def coded(docs: DataFrame, ratios: dict[bytes, float], host: str, path: str) -> DataFrame:
    """(row_host, row_path, doc_id, code)."""
    return docs.select(F.col(host).alias("row_host"), F.col(path).alias("row_path"), "doc_id", feature_code("text", ratios).alias("code"))


def sites_of(rows: DataFrame, weights: list[list[float]]) -> DataFrame:
    return cut(site_posteriors(rows.select(F.col("row_host").alias("host"), F.col("row_path").alias("path"), _sigmoid(evidence(F.col("code"), weights)).alias("p"))), "sites")


def score_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """(doc_id, host, path, evidence, host_p, path_p, posterior). Each text is read once; nothing of it is moved."""
    ratios, weights = evidence_weights(docs, labels)
    rows = cut(coded(docs, ratios, host, path), "codes")
    return add_posterior(rows, sites_of(rows, weights), weights).select("doc_id", F.col("row_host").alias("host"), F.col("row_path").alias("path"), "evidence", "host_p", "path_p", "posterior")


def keep_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs whose posterior is at least MIN_POSTERIOR, with their own columns."""
    ratios, weights = evidence_weights(docs, labels)
    sites = sites_of(coded(docs, ratios, host, path), weights)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).alias("row_host"), F.col(path).alias("row_path"), feature_code("text", ratios).alias("code"))
    return add_posterior(packed, sites, weights).where(F.col("posterior") >= MIN_POSTERIOR).select("row.*")


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        F.col("host").alias("source"),
        F.col("path").alias("lang"),
        F.round("evidence", 6).alias("evidence"),
        F.round("host_p", 6).alias("host_quality"),
        F.round("path_p", 6).alias("path_quality"),
        F.round("posterior", 6).alias("posterior"),
        (F.col("posterior") >= MIN_POSTERIOR).alias("kept"),
    )


def _bins_sql(value: str, edges: tuple[float, ...]) -> str:
    return "CASE WHEN n = 0 THEN 0 ELSE 1" + "".join(f" + ({value} > {e}::DOUBLE)::INT" for e in edges) + " END"


#: The same classifier in SQL, for tables of unique ids with labels of both kinds and at most TRAIN_DOCS of them.
OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM windows
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS repeated FROM twice, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id
), f AS (
  SELECT d.doc_id, source, lang, len(w) AS n, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
    coalesce(repeated, 0) AS repeated, coalesce(list_sum([(w[i] = w[i + 1])::INT FOR i IN range(1, len(w))]), 0) AS doubled
  FROM d LEFT JOIN covered USING (doc_id)
), l AS (
  SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1) AND doc_id IN (SELECT doc_id FROM documents)
), total AS (
  SELECT count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM l
), seen AS (
  SELECT word, sum(quality) AS good, count(*) AS n FROM (SELECT DISTINCT doc_id, quality, unnest(w) AS word FROM d JOIN l USING (doc_id)) GROUP BY word
  HAVING count(*) >= {WORD_DOCS} ORDER BY n DESC, word LIMIT {WORDS}
), ratio AS (
  SELECT word, ln((seen.good + 1) / (total.good + 2)::DOUBLE) - ln((n - seen.good + 1) / (total.bad + 2)::DOUBLE) AS r FROM seen, total
), known_own AS (
  SELECT doc_id, quality, round(avg(ln(greatest(1, seen.good + 1 - quality) / (total.good + 2 - quality)::DOUBLE) - ln(greatest(1, n - seen.good + quality) / (total.bad + 1 + quality)::DOUBLE)), 9) AS ratio
  FROM (SELECT DISTINCT doc_id, quality, unnest(w) AS word FROM d JOIN l USING (doc_id)) JOIN seen USING (word), total GROUP BY ALL
), known AS (
  SELECT doc_id, round(avg(r), 9) AS ratio FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d) JOIN ratio USING (word) GROUP BY doc_id
), b AS (
  SELECT doc_id, source, lang, unnest(range(0, 5)) AS feature, unnest([
    {_bins_sql("symbols / n::DOUBLE", EDGES["symbols"])}, {_bins_sql("CASE WHEN letters > 0 THEN capitals / letters::DOUBLE ELSE 0 END", EDGES["capitals"])},
    {_bins_sql("repeated / n::DOUBLE", EDGES["repeated"])}, {_bins_sql("doubled / n::DOUBLE", EDGES["doubled"])}, {_bins_sql("coalesce(known.ratio, 0)", EDGES["words"])}]) AS bin FROM f LEFT JOIN known USING (doc_id)
), counted AS (
  SELECT feature, bin, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE quality = 0) AS bad FROM (
    SELECT quality, feature, CASE WHEN feature = 4 THEN {_bins_sql("coalesce(known_own.ratio, 0)", EDGES["words"])} ELSE bin END AS bin
    FROM b JOIN l USING (doc_id) JOIN f USING (doc_id) LEFT JOIN known_own USING (doc_id, quality)) GROUP BY ALL
), e AS (
  SELECT b.doc_id, source, lang, sum(ln((coalesce(c.good, 0) + 1) / (total.good + 5)::DOUBLE) - ln((coalesce(c.bad, 0) + 1) / (total.bad + 5)::DOUBLE)) AS evidence
  FROM b CROSS JOIN total LEFT JOIN counted c USING (feature, bin) GROUP BY ALL
), p AS (
  SELECT *, 1 / (1 + exp(-evidence)) AS p FROM e
), path AS (
  SELECT source, lang, count(*) AS n, sum(p) AS s FROM p GROUP BY ALL
), host AS (
  SELECT source, sum(n) AS hn, sum(s) AS hs FROM path GROUP BY ALL
), world AS (
  SELECT sum(hs) / sum(hn) AS mean, sum(hs * hs / hn) / sum(hn) - (sum(hs) / sum(hn)) ** 2 AS spread FROM host
), inner_spread AS (
  SELECT sum(n * (s / n - hs / hn) ** 2) / sum(n) AS spread FROM path JOIN host ON path.source IS NOT DISTINCT FROM host.source
), m AS (
  SELECT mean, CASE WHEN w.spread <= 0 THEN {MAX_STRENGTH} ELSE greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, mean * (1 - mean) / w.spread - 1)) END::DOUBLE AS hm,
    CASE WHEN i.spread <= 0 THEN {MAX_STRENGTH} ELSE greatest({MIN_STRENGTH}, least({MAX_STRENGTH}, mean * (1 - mean) / i.spread - 1)) END::DOUBLE AS pm FROM world w, inner_spread i
), h AS (
  SELECT p.*, n, s, pm, (hs - p + hm * mean) / (hn - 1 + hm) AS host_p
  FROM p JOIN path ON p.source IS NOT DISTINCT FROM path.source AND p.lang IS NOT DISTINCT FROM path.lang JOIN host ON p.source IS NOT DISTINCT FROM host.source, m
), q AS (
  SELECT *, (s - p + pm * host_p) / (n - 1 + pm) AS path_p FROM h
), o AS (
  SELECT *, 1 / (1 + exp(-(evidence + ln(greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, path_p)) / (1 - greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, path_p))))))) AS posterior FROM q
)
SELECT doc_id, source, lang, round(evidence, 6) AS evidence, round(host_p, 6) AS host_quality, round(path_p, 6) AS path_quality, round(posterior, 6) AS posterior, posterior >= {MIN_POSTERIOR} AS kept FROM o
"""
