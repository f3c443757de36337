"""Language-model scoring by a probabilistic suffix tree over words.

A node of the tree is a context of up to DEPTH words. Contexts and what follows
them are counted over all training documents, depth by depth: a context can only
be frequent if its parts are, so each pass over the texts extends the frequent
contexts of the last by one word. A context stays if its next-word distribution
diverges from that of its longest kept suffix (Kullback-Leibler, at least
MIN_DIVERGENCE nats; words without an own count are one class). Its smoothed
distribution takes DISCOUNT off each kept count and gives the rest to all other
words in proportion to the suffix's distribution; the root is the add-half word
distribution, so every text has a probability. A text is scored from state to
state, each the longest kept suffix of the words before.

Texts are split once: a text's words go on as hashes in a table of the shared
folder, which the passes for the depths and the scores read.

A context needs CONTEXT_FACTOR * sqrt(N) occurrences among the N training tokens,
and an own probability (or a place in a context) NEXT_FACTOR * sqrt(N). One rule
holds at every size: the tree grows with the square root of the corpus, and what
is broadcast is at most sqrt(N) / CONTEXT_FACTOR contexts and sqrt(N) /
NEXT_FACTOR words and pairs of each depth (a million pairs at 10^8 tokens). All
other words are counted and looked up by shuffles: a scored text's rare words
meet their counts in a join, in which no word is hot, since the hot ones are
scored in place. Counts are summed in each task before any shuffle.

Words are known by XXH64: two of V different words share a hash, and so their
counts, with odds of V^2 / 2^65 (3 in 10^6 for 10^7 words).

Defined results: a null or empty text is its end alone; a null doc_id is
training data; repeated rows count and are scored each; a long text is taken
whole, and equal counts need no order; an empty table gives an empty one;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, bounded_batches, chunks, cut, drop_cut, table

DEPTH = 3
CONTEXT_FACTOR = 0.1
NEXT_FACTOR = 0.01
MIN_DIVERGENCE = 0.02
DISCOUNT = 0.5
FOLDS, HELD_OUT = 5, 1
#: Different words that a worker holds before it passes its counts on.
HELD_WORDS = 100_000
#: Counts in a row of the encoded table: a longer array is a large object of its own in the JVM.
COUNTS_ROW = 20_000
HELD_PAIRS = 2_000_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_END = b"\n"  # no word: words hold no white space
LN10 = math.log(10)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def signed(hashes) -> np.ndarray:
    return np.array(hashes, dtype=np.uint64).view(np.int64)


END = int(np.array(0xE01D_0F7E_0000_0001, np.uint64).view(np.int64))  # stands for the end among word hashes


def least_context(tokens: int) -> float:
    return CONTEXT_FACTOR * math.sqrt(tokens)


def least_next(tokens: int) -> float:
    return max(1.0, NEXT_FACTOR * math.sqrt(tokens))


class Interner:
    """Numbers for the words seen so far in a task, and their counts."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[_END]  # 0
        self.hashes = np.array([END], np.int64)
        self.counts = np.zeros(1, np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashed(self) -> np.ndarray:
        if len(self.hashes) < len(self.ids):
            new = list(self.ids)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, signed([word_hash(w) for w in new])])
        return self.hashes

    def count(self, numbers: np.ndarray, ends: int) -> None:
        own = np.bincount(numbers, minlength=len(self.ids))
        own[: len(self.counts)] += self.counts
        own[0] += ends
        self.counts = own


def encoded(docs: DataFrame) -> DataFrame:
    """From (row_id, doc_id, held_out, text) a row for each text with the hashes of its words, and rows with the counts of a task's training words."""
    schema = "row_id bigint, doc_id bigint, held_out boolean, words array<bigint>, counts array<bigint>"
    kinds = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Interner()

        def counted() -> pa.RecordBatch:
            seen = known.counts > 0
            words, counts = known.hashed()[: len(seen)][seen], known.counts[seen]
            starts = range(0, len(words), COUNTS_ROW)
            cut_up = lambda x: pa.array([x[i : i + COUNTS_ROW] for i in starts], pa.list_(pa.int64()))
            none = [pa.nulls(len(starts), kind) for kind in (pa.int64(), pa.int64(), pa.bool_())]
            return pa.RecordBatch.from_arrays([*none, cut_up(words), cut_up(counts)], schema=kinds)

        for batch in batches:
            texts, held = batch.column(3).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in chunks(texts):
                own = [words_of(t) for t in texts[a:b]]
                lengths = np.fromiter(map(len, own), np.int64, b - a)
                numbers = known.number([w for ws in own for w in ws])
                training = np.repeat(~held[a:b], lengths)
                known.count(numbers[training], int((~held[a:b]).sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(known.hashed()[numbers]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, pa.nulls(b - a, pa.list_(pa.int64()))], schema=kinds)
                if len(known.ids) > HELD_WORDS:
                    yield counted()
                    known = Interner()
        yield counted()

    return docs.select("row_id", "doc_id", "held_out", "text").mapInArrow(run, schema)


def framed(column: pa.Array, size: int = CHUNK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For about size words: the range of texts, their words' hashes, each text begun and ended by the end, and the texts' lengths with both."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy()
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
        stop = min(stop, len(column))
        lengths = np.diff(offsets[start : stop + 1]).astype(np.int64)
        out = np.full(int(lengths.sum()) + 2 * len(lengths), END, np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        out[np.arange(len(text)) + 2 * text + 1] = values[offsets[start] : offsets[stop]]
        yield start, stop, out, lengths + 2
        start = stop


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): the counts of all training tokens by hash, the end's among them, from encoded()."""
    return texts.where("counts is not null").select(F.explode(F.arrays_zip("words", "counts")).alias("e")).groupBy(F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("n"))


class Tree(NamedTuple):
    """The words that can take part in contexts, by hash, and the contexts over them.

    A context is its suffix's node and the word before, as node * words + word;
    nodes count on from depth to depth, the root is 0. next: (node * words + word)
    with own probability.
    """

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    kinds: int
    contexts: tuple[np.ndarray, ...]  # of each depth, sorted
    first: tuple[int, ...]  # the first node of each depth
    kept: np.ndarray  # by node
    parent: np.ndarray  # the longest kept proper suffix, by node
    rest: np.ndarray  # log of the factor for words without own probability, by node
    next: np.ndarray
    logp: np.ndarray

    def root(self, count) -> np.ndarray:
        return np.log((np.asarray(count) + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place among the words, or -1."""
        return places(self.words, hashes)

    def nodes(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each position the context's node of depth 1, 2, ...; -1 where there is none. at: the position in its text."""
        size = len(self.words)
        found: list[np.ndarray] = []
        suffix = np.zeros(len(ids), np.int64)
        for d, contexts in enumerate(self.contexts, 1):
            before = np.full(len(ids), -1)
            before[d:] = ids[:-d]
            ok = (at >= d) & (before >= 0) & (suffix >= 0)
            own = np.full(len(ids), -1)
            if len(contexts) and ok.any():
                place = places(contexts, suffix[ok] * size + before[ok])
                own[ok] = np.where(place >= 0, place + self.first[d - 1], -1)
            found.append(own)
            suffix = own
        return found

    def states(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        state = np.zeros(len(ids), np.int64)
        for own in self.nodes(ids, at):
            state = np.where((own >= 0) & self.kept[own], own, state)
        return state

    def log_next(self, state: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log P(word | state); for a word outside (id -1) without its root factor, which needs its count."""
        out, node, open_ = np.zeros(len(state)), state.copy(), np.ones(len(state), bool)
        size = len(self.words)
        for _ in range(len(self.contexts)):
            at = open_ & (node > 0)
            if not at.any():
                break
            where = np.flatnonzero(at)
            place = places(self.next, np.where(ids[where] >= 0, node[where] * size + ids[where], -1))
            hit = place >= 0
            out[where[hit]] += self.logp[place[hit]]
            open_[where[hit]] = False
            miss = where[~hit]
            out[miss] += self.rest[node[miss]]
            node[miss] = self.parent[node[miss]]
        left = open_ & (ids >= 0)
        out[left] += self.root(self.counts[ids[left]])
        return out


def places(table_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each key's index in a sorted array, or -1."""
    if not len(table_):
        return np.full(len(keys), -1)
    at = np.searchsorted(table_, keys)
    at[at == len(table_)] = 0
    return np.where(table_[at] == keys, at, -1)


def positions(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def next_counts(training: DataFrame, tree_of, depth: int) -> DataFrame:
    """(code, n): counts of node * words + word for contexts of one depth; the words and contexts come by broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, shorter = tree_of.value
        held: list[np.ndarray] = []

        def out():
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

        for batch in batches:
            for _, _, hashes, lengths in framed(batch.column(0)):
                ids, at = tree.find_words(hashes), positions(lengths)
                levels = tree.nodes(ids, at)
                node = levels[depth - 1]
                ok = (node >= 0) & (ids >= 0) & (at > 0)
                if depth > 1 and ok.any():  # a pair is only frequent if it is after the shorter context
                    w = np.flatnonzero(ok)
                    ok[w] = places(shorter, levels[depth - 2][w] * len(tree.words) + ids[w]) >= 0
                held.append(node[ok] * len(tree.words) + ids[ok])
                if sum(map(len, held)) > HELD_PAIRS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return training.select("words").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def rows_of(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size."""
    return [c.to_numpy() for c in df.toArrow().combine_chunks().columns]


def grow(training: DataFrame, vocabulary: DataFrame, depth: int = DEPTH) -> Tree:
    spark = training.sparkSession
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds")).first()
    tokens, kinds = int(total.tokens), int(total.kinds)
    words, counts = rows_of(vocabulary.where(F.col("n") >= least_next(tokens)))
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    size = len(words)
    end = int(places(words, np.array([END]))[0]) if size else -1
    tree = Tree(words, counts, tokens, kinds, (), (), np.ones(1, bool), np.zeros(1, np.int64), np.zeros(1), np.zeros(0, np.int64), np.zeros(0))
    least = least_context(tokens)
    candidates = np.flatnonzero(counts >= least).astype(np.int64) if size else np.zeros(0, np.int64)
    totals = counts[candidates] if size else candidates
    after: list[tuple[np.ndarray, np.ndarray]] = []  # codes and counts of what follows, by depth
    context_n: list[np.ndarray] = []
    shorter = np.zeros(0, np.int64)
    for d in range(1, depth + 1):
        if not len(candidates):
            break
        order = np.argsort(candidates)
        first = (tree.first[-1] + len(tree.contexts[-1])) if tree.first else 1
        tree = tree._replace(contexts=(*tree.contexts, candidates[order]), first=(*tree.first, first))
        context_n.append(totals[order])
        shared = spark.sparkContext.broadcast((tree, shorter))
        found = next_counts(training, shared, d)
        codes, n = rows_of(found.where(F.col("n") >= least_next(tokens)))
        shared.destroy()
        order = np.argsort(codes)
        codes, n = codes[order], n[order]
        after.append((codes, n))
        shorter = codes
        # Longer contexts (older word, ..., word): the contexts of this depth whose next word makes them frequent.
        node, word = codes // size, codes % size
        usable = (n >= least) & (word != end)
        candidates, totals = longer(tree, node[usable], word[usable], d), n[usable]
        good = candidates >= 0
        candidates, totals = candidates[good], totals[good]
    return prune(tree, after, context_n)


def longer(tree: Tree, node: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """The context that follows when a word comes after a context: as the node of all but its oldest word, and that word."""
    size = len(tree.words)
    spelled = np.zeros((len(node), depth), np.int64)  # newest word last
    at = node.copy()
    for d in range(depth, 0, -1):
        code = tree.contexts[d - 1][at - tree.first[d - 1]]
        spelled[:, depth - d] = code % size  # the oldest word of what is left
        at = code // size
    suffix = np.zeros(len(node), np.int64)
    path = [word, *(spelled[:, i] for i in range(depth - 1, 0, -1))]  # from the newest to the second oldest
    for d, w in enumerate(path, 1):
        place = places(tree.contexts[d - 1], suffix * size + w)
        suffix = np.where((place >= 0) & (suffix >= 0), place + tree.first[d - 1], -1)
    return np.where(suffix >= 0, suffix * size + spelled[:, 0], -1)


def prune(tree: Tree, after: list, context_n: list) -> Tree:
    """Keep the contexts that diverge from their longest kept suffix, and smooth them."""
    size = len(tree.words)
    nodes = 1 + sum(len(c) for c in tree.contexts)
    tree = tree._replace(kept=np.zeros(nodes, bool), parent=np.zeros(nodes, np.int64), rest=np.zeros(nodes))
    tree.kept[0] = True
    for d, ((codes, n), own_n) in enumerate(zip(after, context_n, strict=True), 1):
        first, many = tree.first[d - 1], len(tree.contexts[d - 1])
        suffix = tree.contexts[d - 1] // size
        parent = np.where(tree.kept[suffix], suffix, tree.parent[suffix])
        tree.parent[first : first + many] = parent
        owner = codes // size - first
        p = (n - DISCOUNT) / own_n[owner]
        q = np.exp(tree.log_next(parent[owner], codes % size))
        sum_p, sum_q = np.bincount(owner, p, many), np.bincount(owner, q, many)
        left_p, left_q = np.clip(1 - sum_p, 1e-9, 1), np.clip(1 - sum_q, 1e-9, 1)
        divergence = np.bincount(owner, p * np.log(p / q), many) + left_p * np.log(left_p / left_q)
        kept = divergence >= MIN_DIVERGENCE
        tree.kept[first : first + many] = kept
        tree.rest[first : first + many] = np.log(left_p / left_q)
        mine = kept[owner]
        merged = np.concatenate([tree.next, codes[mine]])
        order = np.argsort(merged)
        tree = tree._replace(next=merged[order], logp=np.concatenate([tree.logp, np.log(p[mine])])[order])
    return tree


def score_in_place(texts: DataFrame, tree_of) -> DataFrame:
    """The texts of encoded() with the sums over frequent words, and the hashes of the rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = tree_of.value
        for batch in batches:
            for start, stop, hashes, lengths in framed(batch.column(3)):
                ids, at = tree.find_words(hashes), positions(lengths)
                scored = at > 0
                frequent = scored & (ids >= 0)
                base = np.zeros(len(ids))
                base[frequent] = tree.root(tree.counts[ids[frequent]])
                score = np.zeros(len(ids))
                score[scored] = tree.log_next(tree.states(ids, at)[scored], ids[scored])
                text = np.repeat(np.arange(len(lengths)), lengths)
                rare = scored & (ids < 0)
                sizes = np.bincount(text[rare], minlength=len(lengths))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes[rare]))
                add = lambda x: pa.array(np.bincount(text, x, len(lengths)))  # noqa: B023, E731
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lengths - 1), pa.array(np.bincount(text[frequent], minlength=len(lengths))), add(base), add(score), lists], names=["row_id", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "score", "rare"])

    return texts.select("row_id", "doc_id", "held_out", "words").mapInArrow(run, "row_id bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_frequent bigint, base double, score double, rare array<bigint>")


def with_folds(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(row_id, doc_id, held_out, text)."""
    fold = F.crc32(F.col(key).cast("bigint").cast("string").cast("binary")) % FOLDS
    return docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("bigint").alias("doc_id"), F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): trained on the other folds' documents."""
    spark = docs.sparkSession
    both = cut(encoded(with_folds(bounded_batches(docs), text, key)), "encoded")
    texts = both.where("counts is null")
    vocabulary = cut(word_counts(both), "words")
    tree = grow(texts.where("not held_out"), vocabulary)
    shared = spark.sparkContext.broadcast(tree)
    scored = cut(score_in_place(texts, shared), "scored")
    shared.destroy()
    drop_cut(both)
    # Rare words only: none of those has as many tokens as a frequent one.
    seen = scored.select("row_id", F.explode("rare").alias("word")).join(vocabulary.where(F.col("n") < least_next(tree.tokens)), "word", "left")
    root = F.log((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(tree.tokens + 0.5 * (tree.kinds + 1)))
    rare = seen.groupBy("row_id").agg(F.sum(root).alias("rare_sum"), F.count("n").alias("rare_known"))
    joined = scored.drop("rare").join(rare, "row_id", "left")
    add = lambda c: (F.col(c) + F.coalesce("rare_sum", F.lit(0.0))) / LN10
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tree.tokens).cast("bigint").alias("train_tokens"), add("base").alias("base_score"), add("score").alias("score"))


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
