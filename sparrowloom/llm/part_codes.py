"""Vector code compression: product quantisation by dual-tree Lloyd rounds, in exact integers.

Components become integers floor(SCALE * x); vectors are cut into PARTS equal
parts, and each part position has a codebook of ENTRIES integer entries.

* Trees over parts: a task takes BLOCK vectors at a time and splits each
  position's parts, level by level, at the median of the node's widest
  component, down to LEAF parts. The order of the leaves is stored with the block
  (once, in the shared folder), boxes and sums of the nodes follow from it.
* A tree over entries: split likewise, down to single entries.
* A round walks both trees down together. For a pair of nodes the boxes bound the
  squared distances below and above, in integers; a node of entries goes where
  its lower bound exceeds another's upper bound, since then each of its entries is
  farther than some other for every part of the node. Single entries also go where another is
  nearer at every corner of the node's box. A node left with one entry is
  assigned whole, by its cached sum and count; only parts of leaves with several
  entries left are compared one by one, again in integers. So nothing is
  approximate and ties go to the lower index.
* Each task adds up its sums; Spark adds those by position and entry (PARTS *
  ENTRIES rows), and the driver holds the codebooks alone.

Integers are 64 bits wide where the largest component leaves room for the
squares (BOUND), else Python's own, in the same code.

Defined results: rows with a null vector, or with a null or non-finite
component, are dropped; vectors of unequal length are filled up with zeros to
the longest one, and to a multiple of PARTS; a null vec_id sorts after all
others, equal vec_ids go by their components; fewer than ENTRIES kept rows give
as many entries; repeated rows each have their own; an error beyond 64 bits is
the largest long; labels are free to be null (a group of their own); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that share a tree, and the parts of a leaf (powers of two).
BLOCK, LEAF = 4096, 16
#: Components below this leave room in 64 bits for squared distances of up to 128 components and their bounds.
BOUND = 1 << 26
LONGEST = 2**63 - 1
#: Labels up to which totals are broadcast, and shares into which a label's rows are dealt where there are more.
BROADCAST_ROWS, SALTS = 100_000, 64
#: Sums leave a task in digits of this base, so that Spark's sums of them stay exact at any size.
DIGIT = 10**15


def kept(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, whole): integer components of the rows whose vector is whole, as decimals."""
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def integers(lengths: np.ndarray, values: np.ndarray, width: int, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) of vectors, given by their lengths and all their components, as rows of `width` integers filled up with zeros."""
    out = np.zeros((len(lengths), width), dtype=object if wide else np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # A float is a fraction whose denominator is a power of two, so Python's floor of it is exact at any size.
    out[row, place] = [n * scale // d for n, d in (float(x).as_integer_ratio() for x in values)] if wide else np.floor(values * scale).astype(np.int64)
    return out


def of_lists(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    return np.array([len(v) for v in vectors]), np.array([x for v in vectors for x in v], dtype=np.float64)


def squared(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


class PartTree:
    """A balanced tree over the rows of points; nodes of a level have equal numbers of places.

    Places beyond the rows repeat the last row (so that boxes stay right) and count nothing.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray | None = None):
        n = len(points)
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        places = LEAF << self.depth
        if order is None:
            order = np.minimum(np.arange(places), n - 1)
            for level in range(self.depth):
                nodes = order.reshape(1 << level, -1)
                held = points[nodes]
                widest = (held.max(axis=1) - held.min(axis=1)).argmax(axis=1)
                value = np.take_along_axis(held, widest[:, None, None], axis=2)[:, :, 0]
                order = np.take_along_axis(nodes, value.argsort(axis=1, kind="stable"), axis=1).reshape(-1)
        self.order = order
        # A row that fills up several places counts at its first one.
        first = np.full(n, places)
        np.minimum.at(first, order, np.arange(places))
        self.counts_at = first[order] == np.arange(places)
        self.points = points[order]
        self.low, self.high, self.sums, self.counts = {}, {}, {}, {}
        leaves = self.points.reshape(1 << self.depth, LEAF, -1)
        live = self.counts_at.reshape(1 << self.depth, LEAF)
        self.low[self.depth], self.high[self.depth] = leaves.min(axis=1), leaves.max(axis=1)
        self.sums[self.depth], self.counts[self.depth] = (leaves * live[:, :, None]).sum(axis=1), live.sum(axis=1)
        for level in range(self.depth - 1, -1, -1):
            pair = lambda x: x.reshape(1 << level, 2, *x.shape[1:])  # noqa: E731, B023
            self.low[level], self.high[level] = pair(self.low[level + 1]).min(axis=1), pair(self.high[level + 1]).max(axis=1)
            self.sums[level], self.counts[level] = pair(self.sums[level + 1]).sum(axis=1), pair(self.counts[level + 1]).sum(axis=1)


def entry_levels(entries: np.ndarray) -> list[list[np.ndarray]]:
    """The nodes of each level of the tree over entries, as arrays of indexes; the last level has single entries."""
    levels = [[np.arange(len(entries))]]
    while any(len(node) > 1 for node in levels[-1]):
        below = []
        for node in levels[-1]:
            if len(node) == 1:
                below.append(node)
                continue
            held = entries[node]
            by = held[:, (held.max(axis=0) - held.min(axis=0)).argmax()].argsort(kind="stable")
            below += [node[by[: len(node) // 2]], node[by[len(node) // 2 :]]]
        levels.append(below)
    return levels


def beaten(low: np.ndarray, high: np.ndarray, entries: np.ndarray, rival: np.ndarray) -> np.ndarray:
    """(node, entry): whether the node's rival entry is nearer than the entry all over the node's box.

    The difference of two squared distances is linear in the part, so its largest value over a box is at a corner.
    """
    own = entries[rival]
    away = entries - own[:, None, :]
    corner = np.where(away > 0, high[:, None, :], low[:, None, :])
    return squared(own)[:, None] - squared(entries) + 2 * (away * corner).sum(axis=-1) < 0


def walk(tree: PartTree, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(level, nodes, alive): nodes of the tree and which entries they may belong to.

    Nodes with one entry left come as soon as that is known, those of the last level with all that are left.
    """
    levels = entry_levels(entries)
    nodes = np.zeros(1, dtype=np.int64)
    alive = np.ones((1, 1), dtype=bool)
    step = 0
    for level in range(tree.depth + 1):
        # The tree over entries is walked down a level at a time beside that over parts, and to its end at the leaves.
        while True:
            if step + 1 < len(levels):
                parent = np.array([i for i, up in enumerate(levels[step]) for _ in range(1 if len(up) == 1 else 2)])
                step += 1
                alive = alive[:, parent]
            at = levels[step]
            low, high = np.stack([entries[e].min(axis=0) for e in at]), np.stack([entries[e].max(axis=0) for e in at])
            p_low, p_high = tree.low[level][nodes][:, None, :], tree.high[level][nodes][:, None, :]
            least = squared(np.maximum(np.maximum(low - p_high, p_low - high), 0))
            most = squared(np.maximum(high - p_low, p_high - low))
            bound = np.where(alive, most, most.max()).min(axis=1)
            alive = alive & (least <= bound[:, None])
            if level < tree.depth or step + 1 == len(levels):
                break
        single = step + 1 == len(levels)
        if single:
            index = np.array([e[0] for e in at])
            full = np.zeros((len(nodes), len(entries)), dtype=bool)
            full[:, index] = alive
            full &= ~beaten(tree.low[level][nodes], tree.high[level][nodes], entries, index[np.where(alive, most, most.max()).argmin(axis=1)])
            sure = full.sum(axis=1) == 1
            out = sure if level < tree.depth else np.ones(len(nodes), dtype=bool)
            if out.any():
                yield level, nodes[out], full[out]
            nodes, alive = nodes[~out], full[~out][:, index]
        if level == tree.depth or not len(nodes):
            return
        nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(alive, 2, axis=0)


def nearest(points: np.ndarray, alive: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of the nearest alive entry for each of points (node, place, component)."""
    # The squared distance without the part's own square, which all entries share.
    distance = squared(entries) - 2 * (points @ entries.T)
    far = distance.max() + 1
    return np.where(alive[:, None, :], distance, far).argmin(axis=2)


def assign(tree: PartTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """(entry of each place, sums, counts, work): work counts parts assigned with their node and one by one."""
    codes = np.zeros(len(tree.order), dtype=np.int64)
    sums, counts = np.zeros(entries.shape, dtype=entries.dtype), np.zeros(len(entries), dtype=np.int64)
    work = {"whole": 0, "single": 0}
    for level, nodes, alive in walk(tree, entries):
        sure = alive.sum(axis=1) == 1
        own = alive[sure].argmax(axis=1)
        np.add.at(sums, own, tree.sums[level][nodes[sure]])
        np.add.at(counts, own, tree.counts[level][nodes[sure]])
        spread = codes.reshape(1 << level, -1)
        spread[nodes[sure]] = own[:, None]
        work["whole"] += int(tree.counts[level][nodes[sure]].sum())
        unsure = nodes[~sure]
        if len(unsure):
            leaf, live = tree.points.reshape(1 << level, LEAF, -1)[unsure], tree.counts_at.reshape(1 << level, LEAF)[unsure]
            found = nearest(leaf, alive[~sure], entries)
            spread[unsure] = found
            np.add.at(sums, found[live], leaf[live])
            np.add.at(counts, found[live], 1)
            work["single"] += int(live.sum())
    return codes, sums, counts, work


TREES = "vec_ids array<bigint>, labels array<string>, vectors binary, orders binary"


def planter(width: int, parts: int, scale: int, wide: bool) -> Callable:
    """Batches of (vec_id, label, vector) to rows of TREES: a block's integers and the orders of its trees."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("orders", pa.binary())])

        def block(rows: list, whole: np.ndarray) -> pa.RecordBatch:
            orders = [PartTree(p).order.astype(np.int32) for p in np.split(whole, parts, axis=1)]
            ids, labels = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([pack(whole, wide)], pa.binary()), pa.array([np.stack(orders).tobytes()], pa.binary())],
                schema=schema,
            )

        rows, held = [], np.zeros((0, width), dtype=object if wide else np.int64)
        for batch in batches:
            vectors = batch.column("vector")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            rows += zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)
            held = np.concatenate([held, integers(lengths, vectors.flatten().to_numpy(zero_copy_only=False), width, scale, wide)])
            while len(rows) >= BLOCK:
                yield block(rows[:BLOCK], held[:BLOCK])
                rows, held = rows[BLOCK:], held[BLOCK:]
        if rows:
            yield block(rows, held)

    return plant


def pack(whole: np.ndarray, wide: bool) -> bytes:
    return ",".join(map(str, whole.reshape(-1))).encode() if wide else whole.tobytes()


def unpack(data: bytes, n: int, wide: bool) -> np.ndarray:
    flat = np.array([int(x) for x in data.decode().split(",")] if data else [], dtype=object) if wide else np.frombuffer(data, dtype=np.int64)
    return flat.reshape(n, -1)


def blocks(batches: Iterator[pa.RecordBatch], parts: int, wide: bool) -> Iterator[tuple]:
    """(vec_ids, labels, [(points, tree) of each position])."""
    for batch in batches:
        for ids, labels, vectors, orders in zip(*(batch.column(c).to_pylist() for c in ("vec_ids", "labels", "vectors", "orders")), strict=True):
            whole = unpack(vectors, len(ids), wide)
            order = np.frombuffer(orders, dtype=np.int32).reshape(parts, -1)
            yield ids, labels, [(p, PartTree(p, o)) for p, o in zip(np.split(whole, parts, axis=1), order, strict=True)]


def digits(x: int) -> list[int]:
    """x in base DIGIT, least first, all of the same sign."""
    sign, x, out = -1 if x < 0 else 1, abs(x), []
    while x or not out:
        x, low = divmod(x, DIGIT)
        out.append(sign * low)
    return out


def summer(books: list, wide: bool) -> Callable:
    """Blocks to a task's (position, entry, n, place, digit, value): value * DIGIT ** digit is part of the sum at a place."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.array(b, dtype=object if wide else np.int64) for b in books]
        total = [[[0] * b.shape[1] for _ in b] for b in own]
        n = [[0] * len(b) for b in own]
        for _, _, trees in blocks(batches, len(own), wide):
            for j, (_, tree) in enumerate(trees):
                _, sums, counts, _ = assign(tree, own[j])
                for e in np.flatnonzero(counts):
                    n[j][e] += int(counts[e])
                    total[j][e] = [a + int(b) for a, b in zip(total[j][e], sums[e], strict=True)]
        rows = [
            (j, e, n[j][e], place, digit, value)
            for j, book in enumerate(total)
            for e, sums in enumerate(book)
            if n[j][e]
            for place, x in enumerate(sums)
            for digit, value in enumerate(digits(x))
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["position", "entry", "n", "place", "digit", "value"])

    return add


def encoder(books: list, wide: bool) -> Callable:
    """Blocks to (vec_id, label, code, error)."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.decimal128(38, 0))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.array(b, dtype=object if wide else np.int64) for b in books]
        for ids, labels, trees in blocks(batches, len(own), wide):
            codes = np.zeros((len(ids), len(own)), dtype=np.uint8)
            errors = [0] * len(ids)
            for j, (points, tree) in enumerate(trees):
                found, _, _, _ = assign(tree, own[j])
                at = np.zeros(len(ids), dtype=np.int64)
                at[tree.order] = found
                codes[:, j] = at
                errors = [a + int(b) for a, b in zip(errors, squared(points - own[j][at]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array([Decimal(min(e, LONGEST)) for e in errors], pa.decimal128(38, 0))], schema=schema)

    return encode


class Codes:
    """What train() learnt: codebooks by position, and what encode() needs to know of the integers."""

    def __init__(self, books: list, trees: DataFrame, wide: bool):
        self.books, self.trees, self.wide = books, trees, wide

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codebooks of (vec_id, embedding, label), and the trees that encode() reads; None where no row is kept."""
    rows = kept(vectors, scale)
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    if facts.width is None:
        return None
    width = max(1, -(-facts.width // parts)) * parts
    wide = (facts.most or 0.0) * scale >= BOUND or width // parts > 128
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    start = integers(*of_lists([r.vector for r in first]), width, scale, wide)
    books = [[[int(x) for x in e] for e in p] for p in np.split(start, parts, axis=1)]
    trees = cut(rows.select("vec_id", F.col("label").cast("string").alias("label"), "vector").mapInArrow(planter(width, parts, scale, wide), TREES), "trees")
    for _ in range(rounds):
        partial = trees.mapInArrow(summer(books, wide), "position int, entry int, n bigint, place int, digit int, value bigint")
        # A few numbers for each component of each entry, whatever the number of rows. A part counts once at every digit 0.
        moved = partial.groupBy("position", "entry", "place", "digit").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
        sums, counts = defaultdict(int), {}
        for r in moved:
            sums[r.position, r.entry, r.place] += int(r.value) * DIGIT**r.digit
            if r.digit == 0:
                counts[r.position, r.entry, r.place] = r.n
        for (j, e, place), n in counts.items():
            books[j][e][place] = sums[j, e, place] // n
    return Codes(books, trees, wide)


def encode(codes: Codes) -> DataFrame:
    """(vec_id, label as text, code, error) of the rows that train() read."""
    return codes.trees.mapInArrow(encoder(codes.books, codes.wide), "vec_id bigint, label string, code string, error decimal(38,0)")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over equal labels, nulls together.

    Totals are broadcast where there are few; else a label's rows are dealt to SALTS shares, each with its total.
    """
    totals = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "t_label")
    if totals.count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(totals), F.expr("label <=> t_label")).drop("t_label")
    salted = totals.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(SALTS)))
    return dealt.join(salted, F.expr("salt = t_salt and label <=> t_label")).drop("t_label", "salt", "t_salt")


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = train(table(spark, sf_dir, "embeddings"))
    if codes is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = cut(encode(codes), "codes")
    drop_cut(codes.trees)
    long = lambda c: F.least(F.col(c), F.lit(Decimal(LONGEST))).cast("bigint").alias(c)
    return with_label_errors(coded).select("vec_id", "code", long("error"), long("label_error"), F.lit(codes.sha256).alias("codebooks_sha256"))


def _round(n: int, last: bool = False) -> str:
    """SQL of a round: distances to book{n}, the nearest entries, and book{n + 1}."""
    step = f"""
, near{n} AS MATERIALIZED (
  SELECT row, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT c.row, c.p, b.e, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN book{n} b ON b.p = c.p AND b.k = c.k GROUP BY ALL) GROUP BY ALL
)"""
    return step if last else step + f"""
, mean{n} AS (
  SELECT c.p, best.e AS e, c.k, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x FROM cells c JOIN near{n} m ON m.row = c.row AND m.p = c.p GROUP BY ALL
), book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.k, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e AND m.k = b.k
)"""


OP12_SQL = f"""
WITH whole AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), width AS (SELECT greatest(1, ceil(max(len(embedding)) / 8.0))::BIGINT AS w FROM whole),
cells AS MATERIALIZED (
  SELECT row, (i // w) AS p, (i % w) AS k, coalesce(floor(4096 * embedding[i + 1]::DOUBLE), 0)::BIGINT AS x
  FROM (SELECT row, embedding, w, unnest(range(8 * w)) AS i FROM whole, width)
), book0 AS MATERIALIZED (SELECT p, row - 1 AS e, k, x FROM cells WHERE row <= 16)
{"".join(_round(n) for n in range(ROUNDS))}
{_round(ROUNDS, True)}
, coded AS (
  SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{ROUNDS} GROUP BY row
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, k)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN whole USING (row)
"""
