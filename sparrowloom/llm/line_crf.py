"""Quality rules: a linear-chain conditional random field labels a text's lines.

Every line becomes a set of on/off features. The field scores a sequence of
labels (content or boilerplate) by per-line weights and weights of neighbouring
labels; Viterbi decoding gives the best sequence of a whole text, and the share
of words in content lines decides whether the document stays.

The weights are trained on at most TRAIN_DOCS labelled documents (those with the
smallest hashes of doc_id, of at most TRAIN_LINES lines each) by maximum
likelihood with a penalty. Labels are of documents, so line labels are derived:
the lines of a good document are content, those of a bad one boilerplate, and
beside both the training has a stitched sequence for each good document, with
lines of a bad one before it, after it or around it. From those the field learns
what a change of label looks like, and so cuts a text inside. Equal sequences are
counted once, with a weight. Everything else runs over all rows in one narrow
map, and needs no shuffle.

Defined results: a null or empty text has no words, fails the base rules and is
not kept; a long text is decoded whole; of label sequences of equal score the
one with content wins; repeated rows give a row each; labels for unknown
documents, or nulls in them, are passed over, and of two labels of a document
both count; without labels of both kinds every line is content; an empty table
gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

TRAIN_DOCS = 2000
TRAIN_LINES = 1000
PENALTY = 0.05
MOST_STEPS = 60
CONTENT_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEATED = 0.5

SYMBOLS = b"#*$%&|<>"
FEATURES = ("always", "symbols", "many symbols", "capitals", "repeated words", "doubled words", "earlier line", "short", "sentence end", "digits", "shouting")
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_LETTER = _UPPER + bytes(range(0x61, 0x7B))
_DIGIT = b"0123456789"

OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("words", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))])


def repeated_words(words: list[bytes]) -> bytearray:
    """1 for each word in a 3-word window that occurs twice or more."""
    flags = bytearray(len(words))
    if len(words) < 4 or len(set(zip(words, words[1:], words[2:], strict=False))) == len(words) - 2:
        return flags
    first: dict[tuple, int] = {}
    for i, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        j = first.setdefault(window, i)
        if j != i:
            flags[i] = flags[i + 1] = flags[i + 2] = 1
            flags[j] = flags[j + 1] = flags[j + 2] = 1
    return flags


def line_features(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; of each line with a word its words and feature bits."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = [(line, words) for line in raw.split(b"\n") if (words := line.split())]
    every = [w for _, words in lines for w in words]
    flags = repeated_words(every)
    counts, marks, seen, dups, at = [], [], set(), 0, 0
    for line, words in lines:
        n = len(words)
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        letters = len(line) - len(line.translate(None, _LETTER))
        capitals = len(line) - len(line.translate(None, _UPPER))
        digits = len(line) - len(line.translate(None, _DIGIT))
        doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
        known = line in seen
        dups += known
        seen.add(line)
        on = (True, symbols > 0.1 * n, symbols > 0.5 * n, capitals > 0.3 * letters, 2 * sum(flags[at : at + n]) > n, 4 * doubled > n, known, n < 5, words[-1][-1:] in b".!?", 5 * digits > len(line), line.count(b"!") > 0.3 * n)
        marks.append(sum(1 << i for i, x in enumerate(on) if x))
        counts.append(n)
        at += n
    word_chars = len(raw.translate(None, _SPACE + _CONTINUED))
    return len(every), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), dups, sum(flags), counts, marks


def counted(batch: pa.RecordBatch) -> list[list]:
    """The columns of OUT after doc_id for a batch of (doc_id, text)."""
    got = [line_features(t.as_py()) for t in batch.column(1)]
    return [list(c) for c in zip(*got, strict=True)] if got else [[]] * 7


def lines_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(counted(batch), list(OUT)[1:], strict=True))], schema=OUT)

    kinds = ", ".join(f"{f.name} bigint" for f in list(OUT)[:6])
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"{kinds}, words array<int>, marks array<int>")


def bits(marks: np.ndarray) -> np.ndarray:
    return ((marks[..., None] >> np.arange(len(FEATURES))) & 1).astype(np.float64)


def stitched(good: list[list[int]], bad: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """For each good sequence of marks one with up to eight lines of a bad one before it, after it or around it, and the labels."""
    out = []
    for i, own in enumerate(good if bad else []):
        other = bad[i % len(bad)]
        size = 1 + i % 8
        ahead, behind = (other[:size] if i % 3 != 1 else []), (other[-size:] if i % 3 != 0 else [])
        out.append(([*ahead, *own, *behind], [0] * len(ahead) + [1] * len(own) + [0] * len(behind)))
    return out


class Sequences:
    """Training sequences, the longest first, lines of one place next to each other: what a step over the places reads in one go."""

    def __init__(self, sequences: list[tuple[list[int], list[int]]]) -> None:
        counts = Counter((tuple(m), tuple(y)) for m, y in sequences if len(m))
        order = sorted(counts, key=lambda s: (-len(s[0]), s))
        self.weight = np.array([counts[s] for s in order], float)
        lengths = np.array([len(m) for m, _ in order])
        longest = len(order[0][0]) if order else 0
        #: The sequences that have a line at place t are the first live[t].
        self.live = np.searchsorted(-lengths, -np.arange(longest), side="left").tolist()
        self.start = np.concatenate([[0], np.cumsum(self.live)]).astype(int)
        self.x = bits(np.array([order[i][0][t] for t in range(longest) for i in range(self.live[t])], np.int64).reshape(-1))
        self.y = np.array([order[i][1][t] for t in range(longest) for i in range(self.live[t])], int).reshape(-1)
        self.line_weight = np.concatenate([self.weight[:k] for k in self.live]) if order else np.zeros(0)

    def likelihood(self, line: np.ndarray, pair: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray]:
        """The weighted log-likelihood of the labels, and its slope by all weights: forward and backward sums over two labels."""
        local, at, live = self.x @ line, self.start, self.live
        ahead, back = np.empty_like(local), np.zeros_like(local)
        ahead[: live[0]] = first + local[: live[0]]
        for t in range(1, len(live)):
            k = live[t]
            before, own = ahead[at[t - 1] : at[t - 1] + k], ahead[at[t] : at[t] + k]
            for y in (0, 1):
                own[:, y] = np.logaddexp(before[:, 0] + pair[0, y], before[:, 1] + pair[1, y])
            own += local[at[t] : at[t] + k]
        norm = np.empty(len(self.weight))
        edges = np.zeros((2, 2))
        for t in range(len(live) - 1, -1, -1):
            k, after = live[t], live[t + 1] if t + 1 < len(live) else 0
            ends = ahead[at[t] + after : at[t] + k]
            norm[after:k] = np.logaddexp(ends[:, 0], ends[:, 1])
            if after:
                following = local[at[t + 1] : at[t + 1] + after] + back[at[t + 1] : at[t + 1] + after]
                for y in (0, 1):
                    back[at[t] : at[t] + after, y] = np.logaddexp(pair[y, 0] + following[:, 0], pair[y, 1] + following[:, 1])
                    for z in (0, 1):
                        edges[y, z] += self.weight[:after] @ np.exp(ahead[at[t] : at[t] + after, y] + pair[y, z] + following[:, z] - norm[:after])
        of_line = np.concatenate([np.arange(k) for k in live])
        node = np.exp(ahead + back - norm[of_line, None]) * self.line_weight[:, None]
        gold = np.eye(2)[self.y] * self.line_weight[:, None]
        seen = np.zeros((2, 2))
        score = (local * gold).sum() + (first * gold[: live[0]].sum(0)).sum()
        for t in range(1, len(live)):
            np.add.at(seen, (self.y[at[t - 1] : at[t - 1] + live[t]], self.y[at[t] : at[t] + live[t]]), self.weight[: live[t]])
        slope = [(self.x.T @ (gold - node)).ravel(), (seen - edges).ravel(), (gold[: live[0]] - node[: live[0]]).sum(0)]
        return float(score + (seen * pair).sum() - self.weight @ norm), np.concatenate(slope)


class ChainField:
    """Labels 0 (boilerplate) and 1 (content): line weights (features, 2), neighbour weights (2, 2) and first-label weights."""

    def __init__(self) -> None:
        self.line = np.zeros((len(FEATURES), 2))
        self.line[0, 1] = 1.0
        self.pair = np.zeros((2, 2))
        self.first = np.zeros(2)

    def put(self, weights: np.ndarray) -> ChainField:
        n = self.line.size
        self.line, self.pair, self.first = weights[:n].reshape(-1, 2), weights[n : n + 4].reshape(2, 2), weights[n + 4 :]
        return self

    def fit(self, sequences: list[tuple[list[int], list[int]]], steps: int = MOST_STEPS, penalty: float = PENALTY) -> ChainField:
        """sequences: (feature bits of each line, label of each line). Quasi-Newton ascent on the penalised likelihood."""
        if len({y for _, labels in sequences for y in labels}) < 2:
            return self
        data = Sequences(sequences)
        total = data.weight.sum()

        def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
            own = ChainField().put(weights)
            score, slope = data.likelihood(own.line, own.pair, own.first)
            return score / total - penalty / 2 / total * weights @ weights, slope / total - penalty / total * weights

        weights = np.concatenate([self.line.ravel(), self.pair.ravel(), self.first])
        best, slope = value(weights)
        inverse = np.eye(len(weights))  # of the curvature, by BFGS: there are few weights
        for _ in range(steps):
            step, size = inverse @ slope, 1.0
            while (new := value(weights + size * step))[0] < best + 1e-4 * size * (slope @ step) and size > 1e-6:
                size /= 2
            move, turn = size * step, slope - new[1]
            weights, gain, best, slope = weights + move, new[0] - best, new[0], new[1]
            if gain < 1e-7:
                break
            if move @ turn > 1e-12:
                part = np.eye(len(weights)) - np.outer(move, turn) / (move @ turn)
                inverse = part @ inverse @ part.T + np.outer(move, move) / (move @ turn)
        return self.put(weights)

    def decode(self, marks: list[int], cache: dict[int, tuple[float, float]]) -> list[int]:
        """The label sequence of highest score (Viterbi; of equal ones content wins). cache: line scores by feature bits."""
        if not marks:
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        come: list[tuple[int, int]] = []
        a = b = 0.0
        for i, mark in enumerate(marks):
            own = cache.get(mark)
            if own is None:
                own = cache[mark] = tuple((bits(np.array([mark])) @ self.line)[0].tolist())
            if i == 0:
                a, b = self.first[0] + own[0], self.first[1] + own[1]
                continue
            a0, a1, b0, b1 = a + p00, b + p10, a + p01, b + p11
            come.append((int(a1 >= a0), int(b1 >= b0)))
            a, b = max(a0, a1) + own[0], max(b0, b1) + own[1]
        label = int(b >= a)
        out = [label]
        for back in reversed(come):
            label = back[label]
            out.append(label)
        return out[::-1]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> ChainField:
    """Fit on at most limit labelled documents; their ids, at most that many, are broadcast to the scan."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Ids may repeat, so the rows have a bound of their own; the order makes reruns agree.
    marked = lines_of(picked).where(F.size("marks").between(1, TRAIN_LINES)).select("doc_id", "marks").join(F.broadcast(chosen), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("marks"), F.col("marks").cast("string")).limit(2 * limit)
    kinds: tuple[list, list] = [], []
    for r in marked.collect():
        kinds[r.quality].append(list(r.marks))
    bad, good = kinds
    plain = [(m, [y] * len(m)) for y, own in enumerate(kinds) for m in own]
    return ChainField().fit(plain + stitched(good, bad))


def label_lines(docs: DataFrame, field: ChainField, share: float = CONTENT_SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents' counts, the labels of their lines that hold a word, the words in content lines, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, tuple[float, float]] = {}
        for batch in batches:
            *counts, words, marks = counted(batch)
            got = [field.decode(m, cache) for m in marks]
            content = [sum(n for n, label in zip(w, own, strict=True) if label) for w, own in zip(words, got, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(got, pa.list_(pa.int32())), pa.array(content, pa.int64())], names=[*OUT.names[:6], "line_labels", "content_words"])

    kinds = ", ".join(f"{n} bigint" for n in OUT.names[:6])
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * repeated > int(100 * MAX_REPEATED) * n)
    slim = bounded_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"{kinds}, line_labels array<int>, content_words bigint").withColumns({"base_failed": failed, "kept": ~failed & (F.col("content_words") >= share * n)})


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return label_lines(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")
