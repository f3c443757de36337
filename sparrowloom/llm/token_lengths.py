"""Token counts: an exact length histogram that answers every context limit.

Each document is encoded whole and only its length goes on. Documents are
counted by length; prefix and suffix sums over the histogram then give, for any
limit L, how many documents fit, their quantile rank, the tokens of all, and
the tokens left when longer documents are truncated at L:

    truncated(L) = tokens of documents up to L + L * number of longer ones.

Lengths are dealt into blocks of 1024 neighbouring lengths, so the running sums
are windows over one block plus the offsets of the blocks; no task gets the
whole histogram but the few block totals. The counts are written once, so each
text is encoded once.

A long run of white space is cut out before the text is split into pieces, since
the splitter goes back over all of it: by its own pattern the run but for its
last character is one piece (all of it at the text's end), and begins a piece
whatever is before it. The length stays that of the whole text.

Defined results: a null or empty text has length 0; control strings of the
vocabulary inside a text are ordinary text; a text of any length, also of one
run of blanks, letters or signs, has its exact length; repeated rows and equal
lengths count each; an empty table has an empty histogram; further columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own split of a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024
LONG_RUN = 1000
#: White space as in PATTERN, by Unicode's White_Space.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """The number of tokens of the whole text."""
    if not text:
        return 0
    own = encoder(path)
    total, start = 0, 0
    for run in _RUN.finditer(text):
        # The last blank belongs to what follows it.
        end = run.end() - (run.end() < len(text))
        total += len(own.encode_ordinary(text[start : run.start()]))
        if end > run.start():
            total += len(own._encode_single_piece(text[run.start() : end]))
        start = end
    return total + len(own.encode_ordinary(text[start:]))


def encoded_lengths(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the length of each whole text; the vocabulary's file must lie on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [n_tokens(t.as_py(), vocabulary) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    return bounded_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) with the running sums that answer every limit.

    docs_upto, tokens_upto: of documents of at most n_tokens; docs_over: of
    longer ones; tokens_over: their tokens; truncated_tokens: of all documents
    cut at n_tokens; rank: docs_upto as a share of all documents (the smallest
    n_tokens of rank q or more is the q-quantile).
    """
    counts = cut(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)), "lengths")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(every).alias("all_docs"),
        F.sum("block_tokens").over(every).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.join(offsets, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_before") + F.sum("n_docs").over(within)).alias("docs_upto"),
        (F.col("tokens_before") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(within)).alias("tokens_upto"),
        "all_docs",
        "all_tokens",
    )
    return upto.select(
        "n_tokens",
        "n_docs",
        "docs_upto",
        "tokens_upto",
        (F.col("all_docs") - F.col("docs_upto")).alias("docs_over"),
        (F.col("all_tokens") - F.col("tokens_upto")).alias("tokens_over"),
        (F.col("tokens_upto") + F.col("n_tokens") * (F.col("all_docs") - F.col("docs_upto"))).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("all_docs")).alias("rank"),
    )


def answer_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of limits (context_limit): documents that fit, and the tokens kept by truncation.

    The stretch of limits between two neighbouring lengths shares the lower
    one's sums, so a limit looks up the longest length up to it: in its own
    block of lengths, or else the last of an earlier block. Limits and lengths
    of a block go into one sorted run, never a product of the two.
    """
    sums = ("docs_upto", "tokens_upto", "docs_over")
    block = lambda c: F.floor(F.col(c) / BLOCK).alias("block")
    marks = cut(histogram.select(block("n_tokens"), F.col("n_tokens").alias("at"), F.lit(0).alias("asked"), *sums, "n_docs"), "histogram")
    total = marks.agg(F.sum("n_docs").alias("all_docs"))
    asked = limits.select(block("context_limit"), F.col("context_limit").cast("bigint").alias("at"), F.lit(1).alias("asked"), *[F.lit(None).cast("bigint").alias(c) for c in sums])
    run = Window.partitionBy("block").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    within = marks.drop("n_docs").unionByName(asked).select("block", "at", "asked", *[F.last(c, ignorenulls=True).over(run).alias(c) for c in sums]).where("asked = 1")
    # A row for each block that has lengths or limits.
    ends = marks.groupBy("block").agg(F.max("docs_upto").alias("docs_upto"), F.max("tokens_upto").alias("tokens_upto"), F.min("docs_over").alias("docs_over"))
    every = ends.unionByName(asked.select("block").distinct().select("block", *[F.lit(None).cast("bigint").alias(c) for c in sums])).groupBy("block").agg(*[F.max(c).alias(c) for c in sums])
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = every.select("block", *[F.last(c, ignorenulls=True).over(before).alias(f"before_{c}") for c in sums])
    filled = within.join(earlier, "block").join(F.broadcast(total))
    found = lambda c: F.coalesce(c, f"before_{c}")
    return filled.select(
        F.col("at").alias("context_limit"),
        F.coalesce(found("docs_upto"), F.lit(0)).alias("docs_fit"),
        (F.coalesce(found("tokens_upto"), F.lit(0)) + F.col("at") * F.coalesce(found("docs_over"), "all_docs", F.lit(0))).alias("truncated_tokens"),
    )


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of the documents does not exceed."""
    return histogram.agg(*[F.min(F.when(F.col("rank") >= q, F.col("n_tokens"))).alias(str(i)) for i, q in enumerate(shares)]).selectExpr(f"stack({len(shares)}, " + ", ".join(f"{q}D, `{i}`" for i, q in enumerate(shares)) + ") as (share, n_tokens)")


def op10_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))
