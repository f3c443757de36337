"""SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint has 64 bits. Cut into 32 segments of two bits, it becomes a
vector of bit counts (0, 1 or 2); the Manhattan distance of two vectors never
exceeds the number of differing bits. Fingerprints that differ in MAX_BITS = 4
bits or fewer therefore have vectors at distance 4 or less, and of the three
thirds of the segments two lie at distance 2 or less together. On the lattice of
two thirds, two points at distance 2 or less share a point within 1 of both. So
the grid range-join deals each fingerprint to its own cell and the some 33 next
ones of each two thirds; fingerprints meeting in a cell are candidates, the
distance of the whole vectors bounds them, and the bits decide. By chance two
fingerprints share a cell once in some 2^31, so with a hundred rows for each
there are few candidates up to 10^8 different fingerprints.

Only distinct fingerprints take part. Before the join those that share a form
with one bit cleared (so at most 2 bits apart: linked for sure) are united
through that form, at most 65 fingerprints a form; the join then leaves out
pairs already united, so dense groups of near copies do not emit all pairs.
Components come from alternating star steps, in the shared folder.

keep_one() is to catch every copy of 0.8 similarity in five-word shingles. Four
bits of 64 for a whole text miss most of those, so a text has a fingerprint for
each piece of its set of shingles: the hashes are cut into ranges, as many as
suit sets of that size, and those of a range make 64 bits as above. Each of them
is embedded as its segment counts. A shingle that only one of two sets has
spoils one piece, and alike sets differ in few, so some piece is the same in
both: there the range of the grid join is 0, and the grid deals a set to its own
cell alone, by piece. Of a set's cells in any common order the first few are
enough, one more than can be spoilt. Pieces of which each shingle is in very many
texts are left out, since their cells would be dense; a set that has too few
others is dealt by pieces of one shingle too, the rarest first, and meets others
of the kind there. So none is missed. Candidates are the sets that meet in a cell. The shingles in 256
segments are counted too, and the Manhattan distance of those counts, which
never exceeds the number of shingles that two sets do not share, bounds the
candidates; the exact likeness decides.

Defined results: a null or empty text has fingerprint zero, linked like any
other; a long text is taken whole; a bit set in exactly half of the values is 0;
a null doc_id is in a component like any other but never names one where another
id is; repeated rows give a row each (keep_one() keeps one of them); an empty
table gives an empty one; further columns are ignored (kept as they are by
keep_one()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, drop_cut, table

SHINGLE = 4
SEED = 42
MAX_BITS = 4
HOT_SHARE = 0.001
#: For keep_one(): words of a shingle, and the Jaccard likeness of near copies as a fraction.
SET_SHINGLE = 5
SIMILAR = (4, 5)
#: What only decides the order of shingles, hence the time: those met COMMON_LEAST times in one of COMMON_PART parts of the texts.
COMMON, COMMON_LEAST, COMMON_PART = 100_000, 4, 4
#: Shingles met that often in the part are dense: pieces of them alone make no cells.
DENSE = 64
#: For keep_one(): shingles in a piece, on average over the largest sets of a class, which holds the sizes from one power of two to the next.
PIECE = 3
#: In place of the class, for pieces of one shingle; and pieces whose bits are counted at once.
ALONE, HELD_PIECES = 63, 16384
#: For keep_one(): segments in which a set's shingles are counted, by their leading bits, and pairs that a set has before its pairs are dealt to several tasks.
SET_SEGMENTS = 256
HOT_PAIRS = 1_000
HELD_NODES = 200_000
BROADCAST_ROWS = 1_000_000

_UPPER_TO_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64 values."""
    return fingerprint_of(words_of(text), size)


def fingerprint_of(words: list[bytes], size: int = SHINGLE) -> int:
    import xxhash

    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    hashes = np.fromiter((digest(join(s), SEED) for s in shingles), np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[a : a + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, len(batch)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=["doc_id", "fp"])

    return bounded_batches(docs).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def unary(bits: np.ndarray) -> np.ndarray:
    """The vector of segment counts, each count in unary (0: 00, 1: 01, 2: 11), so that XOR and a bit count give the Manhattan distance."""
    low, high = bits & _ODD, (bits >> np.uint64(1)) & _ODD
    return (low | high) | ((low & high) << np.uint64(1))


def vector(fp: Column) -> Column:
    """unary() as a column expression."""
    odd = F.lit(int(_ODD))
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(odd), 1))


#: A count in unary, and the bits in which the next count differs: 0 to 1, 1 to 2, 2 to 1, 1 to 0.
NEIGHBOURS = ((0, 1), (1, 2), (3, 2), (1, 1))


#: The segments of each third, from and to.
THIRDS = ((0, 11), (11, 22), (22, 32))


def cells_of(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): without one third in turn, the vector's own lattice point and those at distance 1; a number in place of the third tells which."""
    vector = unary(bits)
    rows, cells = [], []
    every = np.arange(len(bits))
    for left_out, (a, b) in enumerate(THIRDS):
        hole = np.uint64(((1 << 2 * (b - a)) - 1) << 2 * a)
        own = (vector & ~hole) | np.uint64((left_out + 1) << 2 * a)
        rows.append(every)
        cells.append(own)
        for i in (i for i in range(32) if not a <= i < b):
            count = (vector >> np.uint64(2 * i)) & np.uint64(3)
            for at, flip in NEIGHBOURS:
                hit = count == at
                rows.append(every[hit])
                cells.append(own[hit] ^ np.uint64(flip << (2 * i)))
    return np.concatenate(rows), np.concatenate(cells)


def lattice_cells(fps: DataFrame) -> DataFrame:
    """(cell, fp, comp) from (fp, comp): a row for each cell that a fingerprint is dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 8192):
                part = batch.slice(a, 8192)
                fp, comp = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows, cells = cells_of(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cells.view(np.int64), fp[rows], comp[rows])], names=["cell", "fp", "comp"])

    return fps.select("fp", "comp").mapInArrow(run, "cell bigint, fp bigint, comp bigint")


def cleared_forms(fps: DataFrame) -> DataFrame:
    """(a, b) links of fingerprints that share a form: the fingerprint itself or with one bit cleared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 8192):
                fp = batch.column(0).slice(a, 8192).to_numpy()
                forms, owners = [fp], [fp]
                for i in range(64):
                    bit = np.array(1 << i, np.uint64).view(np.int64)
                    hit = (fp & bit) != 0
                    forms.append(fp[hit] ^ bit)
                    owners.append(fp[hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(forms)), pa.array(np.concatenate(owners))], names=["form", "fp"])

    shared = fps.select("fp").mapInArrow(run, "form bigint, fp bigint").groupBy("form").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return shared.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()


def near_links(fps: DataFrame, united: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(a, b): fingerprints of different united components that differ in at most `most` (4 or fewer) bits."""
    labelled = fps.join(united, fps.fp == united.node, "left").select("fp", F.coalesce("comp", "fp").alias("comp"))
    cells = lattice_cells(labelled)
    x, y = cells.alias("x"), cells.alias("y")
    bound = F.bit_count(vector(F.col("x.fp")).bitwiseXOR(vector(F.col("y.fp")))) <= most
    exact = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most
    return x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.comp") != F.col("y.comp")) & bound & exact).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def fingerprint_components(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, fp): the distinct fingerprints (fp, n, least doc_id), and (fp, component_id) of those with company."""
    distinct = cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "fps")
    sure = cut(cleared_forms(distinct), "forms")
    united = connected_components(sure)
    links = near_links(distinct, united)
    comps = connected_components(sure.unionByName(links))
    named = distinct.join(comps, distinct.fp == comps.node).select("fp", "comp", "first_id")
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    return distinct, cut(named.join(least, "comp").select("fp", "component_id"), "comps")


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most MAX_BITS differing bits."""
    fps = cut(fingerprints(docs), "fingerprints")
    distinct, comps = fingerprint_components(fps)
    # A fingerprint's component is looked up by key. At most 1 / HOT_SHARE fingerprints have that share of the rows: those are broadcast.
    total = distinct.agg(F.sum("n").alias("total"))
    named = cut(distinct.join(comps, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")).join(F.broadcast(total)), "named")
    hot = named.where(F.col("n") >= F.greatest(F.lit(2.0), HOT_SHARE * F.col("total"))).select("fp", "component_id")
    cold = named.where(F.col("n") < F.greatest(F.lit(2.0), HOT_SHARE * F.col("total"))).select("fp", "component_id")
    large = fps.join(F.broadcast(hot), "fp")
    small = fps.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(cold, "fp")
    return large.unionByName(small).select("doc_id", "fp", "component_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_UPPER_TO_LOWER).split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The different hashes of SET_SHINGLE-word shingles, sorted; of fewer words all are one shingle."""
    import xxhash

    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SET_SHINGLE, len(own))
    hashes = np.full(len(own) - size + 1 if size else 0, size, np.uint64)
    for i in range(size):
        hashes = (hashes ^ own[i : i + len(hashes)]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes)


def node_of(hashes: np.ndarray) -> int:
    """A number for a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())


def most_apart(n: int, m: int) -> int:
    """The shingles that are in only one of two sets of these sizes, at most, if they have SIMILAR likeness."""
    return (SIMILAR[1] - SIMILAR[0]) * (n + m) // (SIMILAR[0] + SIMILAR[1])


def piece_fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """majority() of every piece: the hashes from one of starts to the next."""
    ends = np.append(starts[1:], len(hashes))
    found = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), HELD_PIECES):
        first, last = starts[a : a + HELD_PIECES], ends[a : a + HELD_PIECES]
        bits = np.unpackbits(hashes[first[0] : last[-1]].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if (last - first).max() < 256:  # eight counts of a byte are added as one number
            counts = np.add.reduceat(bits.view(np.uint64), first - first[0], axis=0).view(np.uint8).astype(np.uint16)
        else:
            counts = np.add.reduceat(bits, first - first[0], axis=0, dtype=np.uint32)
        found[a : a + HELD_PIECES] = np.packbits(2 * counts > (last - first)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return found


def cells_of_pieces(fps: np.ndarray, piece: np.ndarray, level: int) -> np.ndarray:
    """The lattice points of pieces' fingerprints, told apart by the piece's number and the class."""
    told = ((piece << np.uint64(6)) + np.uint64(level + 1)) * np.uint64(0x9E3779B97F4A7C15)
    told = (told ^ (told >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return unary(fps) ^ told ^ (told >> np.uint64(29))


def set_cells(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, places): the cells that a set of shingles (sorted, not empty) is dealt to, of which two sets of SIMILAR likeness share one.

    They meet in the class of the smaller set, so a set that may be alike with
    smaller ones of the class below is dealt to cells of that class too. Each of
    the differing shingles spoils at most one piece of the class: of a set's
    cells in a common order (places: the place in it) one more than that are
    taken. Pieces that only have common shingles (sorted; ranks: their places)
    come last, and those of rank dense or more are no cells. So a set with
    enough cells shares one of those taken with any set that it is alike with.
    Sets that have too few are dealt by single shingles too (places: -1 and
    below), common ones last, where two of them share one of their first fifth.
    """
    n, (p, q) = len(hashes), SIMILAR
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, ranks[at], 0)
    level = n.bit_length() - 1
    least = 1 << level
    classes = [(level, most_apart(n, q * n // p))]
    if q * (least - 1) >= p * n:
        classes.append((level - 1, most_apart(n, least - 1)))
    taken, all_found = [], True
    for own, most in classes:
        pieces = -(-(2 << own) // PIECE)
        piece = ((hashes >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        cells, rarest = cells_of_pieces(piece_fingerprints(hashes, starts), piece[starts], own), np.minimum.reduceat(rank, starts)
        cells, rarest = cells[rarest < dense], rarest[rarest < dense]
        taken.append(cells[np.lexsort((cells, rarest))][: most + 1])
        all_found &= len(cells) > most
    places = [np.arange(len(x), dtype=np.int32) for x in taken]
    if not all_found:
        cells = cells_of_pieces(hashes, np.zeros(n, np.uint64), ALONE)
        cells = cells[np.lexsort((cells, rank))][: n - -(-p * n // q) + 1]
        # Of shingles at one lattice point the first place counts.
        first = np.sort(np.unique(cells, return_index=True)[1])
        taken.append(cells[first])
        places.append(-1 - first.astype(np.int32))
    return np.concatenate(taken), np.concatenate(places)


def set_counts(hashes: np.ndarray) -> bytes:
    """The shingles in each of SET_SEGMENTS segments, a byte each, 255 at most."""
    segments = (hashes >> np.uint64(64 - SET_SEGMENTS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(segments, minlength=SET_SEGMENTS), 255).astype(np.uint8).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, body, node, n, counts, cells, places): body is the text's hash, node names its set of n shingles, see set_cells() and set_counts().

    Counts and cells are left out where the task has just given them for the same set.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, counts, cells, places = [], [], [], [], []
            for t in batch.column(2):
                hashes = shingle_set(words_of(t.as_py()))
                node = node_of(hashes)
                new = node not in seen and len(hashes) > 0
                nodes.append(node)
                sizes.append(len(hashes))
                counts.append(set_counts(hashes) if new else None)
                own, at = set_cells(hashes, *common.value) if new else (None, None)
                cells.append(own.view(np.int64) if new else None)
                places.append(at)
                if len(seen) >= HELD_NODES:
                    seen.clear()
                seen.add(node)
            made = [pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(counts, pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "body", "node", "n", "counts", "cells", "places"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("body"), F.col("text")).mapInArrow(run, "doc_id bigint, body bigint, node bigint, n int, counts binary, cells array<bigint>, places array<int>")


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles met often in a part of the texts, sorted, and their ranks from the rarest: at most COMMON of them; and the first rank of the dense."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(words_of(t.as_py())).view(np.int64))], names=["form"])

    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(COMMON_PART)) == 0).select("text")
    counts = part.mapInArrow(run, "form bigint").groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST)
    found = counts.orderBy(F.desc("n"), "form").limit(COMMON).toArrow()
    forms, n = (found.column(i).to_numpy() for i in (0, 1))
    forms = forms.astype(np.int64).view(np.uint64)
    order = np.argsort(forms)
    ranks = np.empty(len(forms), np.int64)
    ranks[np.lexsort((forms, n))] = np.arange(1, len(forms) + 1)
    return forms[order], ranks[order], int((n < DENSE).sum()) + 1


def shared_cells(own: DataFrame) -> DataFrame:
    """(cell, node, n, at, fame): the cells of two sets or more, with the sets' sizes and the cells' places in them.

    A set's fame is the number of rows that its cells have: the text that many
    others were copied from shares all of its cells with some of them, a copy
    that was changed does not.
    """
    rows = own.where("cells is not null").select("node", "n", F.inline(F.arrays_zip("cells", "places")).alias("cell", "at"))
    of_cell = Window.partitionBy("cell")
    met = rows.withColumns({"low": F.min("node").over(of_cell), "high": F.max("node").over(of_cell), "many": F.count("*").over(of_cell)}).where("low <> high")
    shared = cut(met.select("cell", "node", "n", "at", "many").dropDuplicates(["cell", "node"]), "cells")
    fame = shared.groupBy(F.col("node").alias("of")).agg(F.sum("many").alias("fame"))
    return shared.join(fame, F.col("node") == F.col("of")).select("cell", "node", "n", "at", "fame")


def may_be_near(x: str, y: str) -> Column:
    """Whether sets of these sizes that have their first common cell at these places can be alike: every cell before it is spoilt by a shingle of its own."""
    (p, q), n, m, at, to = SIMILAR, *(F.col(f"{side}.{name}").cast("bigint") for name in ("n", "at") for side in (x, y))
    pieces = F.lit(p + q) * F.greatest(at, to) <= F.lit(q - p) * (n + m)
    # Of single shingles those before the place are in one set only.
    alone = F.lit(p + q) * F.least(n + at + 1, m + to + 1) >= F.lit(p) * (n + m)
    return (F.lit(q) * F.least(n, m) >= F.lit(p) * F.greatest(n, m)) & F.when(at < 0, alone).otherwise(pieces)


def dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, pairs): pairs (a, b) with part, and the parts of each set a that has HOT_SHARE of all pairs or more, of which there are 1 / HOT_SHARE at most."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("met"))
    share = F.greatest(F.lit(float(HOT_PAIRS)), HOT_SHARE * F.col("total"))
    hot = counts.join(F.broadcast(counts.agg(F.sum("met").alias("total")))).where(F.col("met") >= share)
    hot = cut(hot.select("a", F.ceil(F.col("met") / share).cast("int").alias("parts")), "hot")
    own = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    return hot, pairs.join(F.broadcast(hot), "a", "left").select("a", "b", own.alias("part"))


def in_parts(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """sets (a, ...) once for each of a's parts."""
    return sets.join(F.broadcast(hot), "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def within_bound(nodes: DataFrame, hot: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b, part) whose counts are no further apart than sets of SIMILAR likeness can be; nodes (node, n, counts)."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("counts").alias(f"{x}_counts"))
    both = pairs.join(side("b"), "b").join(in_parts(side("a"), hot), ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SET_SEGMENTS).astype(np.int16) for i in (5, 6))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            # At a likeness of p / q the sets differ in at most (q - p) / (q + p) of the sum of their sizes.
            keep = (SIMILAR[0] + SIMILAR[1]) * apart <= (SIMILAR[1] - SIMILAR[0]) * sizes
            yield batch.select([0, 1, 2]).filter(pa.array(keep))

    return both.select("a", "b", "part", "a_n", "b_n", "a_counts", "b_counts").mapInArrow(run, "a bigint, b bigint, part int")


def alike(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets have a Jaccard likeness of SIMILAR or more; nodes (node, body, n, counts): a text for each node."""
    met = cut(pairs.distinct(), "candidates")
    hot, parted = dealt(met)
    pairs = cut(within_bound(nodes, hot, parted), "bounded")
    wanted = cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("body").distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                hashes = shingle_set(words_of(t.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(hashes)], pa.uint64()).view(pa.int64()), pa.array([hashes.view(np.int64)], pa.list_(pa.int64()))], names=["node", "forms"])

    texts = docs.select("text", F.xxhash64("text").alias("body")).join(F.broadcast(wanted) if few else wanted, "body", "left_semi").dropDuplicates(["body"]).select("text")
    sets = cut(texts.mapInArrow(run, "node bigint, forms array<bigint>"), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("forms").alias(f"{name}_forms"))
    both = pairs.join(side("b"), "b").join(in_parts(side("a"), hot), ["a", "part"])
    held, total = F.size(F.array_intersect("a_forms", "b_forms")).cast("bigint"), (F.size("a_forms") + F.size("b_forms")).cast("bigint")
    found = cut(both.where(F.lit(SIMILAR[0] + SIMILAR[1]) * held >= F.lit(SIMILAR[0]) * total).select("a", "b").distinct(), "alike")
    for done in (sets, wanted, pairs, hot, met):
        drop_cut(done)
    return found


def set_links(docs: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b): pairs of alike sets that make the components which all such pairs would.

    Sets of SIMILAR likeness share a cell, so the grid join finds all of them.
    First a cell's sets are only compared with the one of most fame, which
    unites most of every dense group. The join then leaves out pairs already
    united, and lets only those sets search that are not united with their
    cell's main one, so that a group neither emits nor compares all its pairs.
    """
    shared = cut(shared_cells(own), "shared")
    of_cell = Window.partitionBy("cell")
    ranked = shared.withColumn("top", F.max(F.struct("fame", "node", "n", "at")).over(of_cell))
    star = ranked.where(F.col("node") != F.col("top.node")).select(F.struct("n", "at").alias("x"), "top", "node", "fame")
    first = cut(star.where(may_be_near("x", "top")).select(F.col("top.node").alias("a"), F.col("node").alias("b"), F.col("top.fame").alias("fame")).distinct(), "stars")
    links = alike(docs, nodes, first.select("a", "b"))
    # Every set points to the most famous one that it is alike with, and from there on: pointers only go up, and stay in one group.
    up = cut(first.join(links, ["a", "b"], "left_semi").groupBy("b").agg(F.max(F.struct("fame", "a")).alias("best")).select(F.col("b").alias("own"), F.col("best.a").alias("group")), "up")
    further = up.select(F.col("own").alias("mid"), F.col("group").alias("next"))
    united = up.join(further, F.col("group") == F.col("mid"), "left").select("own", F.coalesce("next", "group").alias("group"))
    labelled = shared.join(united, F.col("node") == F.col("own"), "left").select("cell", "node", "n", "at", "fame", F.coalesce("group", "node").alias("comp"))
    main = labelled.withColumns({"top": F.max(F.struct("fame", "node", "comp")).over(of_cell), "low": F.min("comp").over(of_cell), "high": F.max("comp").over(of_cell)}).where("low <> high")
    main = cut(main.select("cell", "node", "n", "at", "comp", (F.col("comp") == F.col("top.comp")).alias("main")), "open")
    x, y = main.where("not main").alias("x"), main.alias("y")
    met = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("y.main") | (F.col("x.node") < F.col("y.node"))) & may_be_near("x", "y"))
    # A main set, which many others meet, is the one that dealt() spreads.
    found = links.unionByName(alike(docs, nodes, met.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))))
    for done in (shared, first, up, main):
        drop_cut(done)
    return found


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the row with the smallest doc_id (of rows repeating it the one with the least text hash, once).

    Groups are the components of all pairs that share SIMILAR of their five-word shingles.
    """
    own = cut(sketches(bounded_batches(docs)), "sketches")
    # A row is known by its id and its text's hash; ids come before null.
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "body")).alias("first_row")
    nodes = cut(own.groupBy("node").agg(first_row, F.max("n").alias("n"), F.max("counts").alias("counts")), "nodes")
    groups = connected_components(set_links(docs, nodes.select("node", "first_row.body", "n", "counts"), own))
    drop_cut(own)
    grouped = nodes.alias("n").join(groups.alias("g"), F.expr("n.node = g.node"), "left").select("first_row", F.coalesce("g.comp", "n.node").alias("group"))
    first = grouped.groupBy("group").agg(F.min("first_row").alias("kept"))
    kept = first.select(F.xxhash64("kept.doc_id", "kept.body").alias("row_key"), F.col("kept.body").alias("row_body")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("row_id"), F.xxhash64("text").alias("row_body"))
    packed = packed.select("row", F.xxhash64("row_id", "row_body").alias("row_key"), "row_body")
    # Texts are shuffled once: the window has the keys of the join.
    again = Window.partitionBy("row_key", "row_body").orderBy("row_body")
    return packed.join(kept, ["row_key", "row_body"], "left_semi").withColumn("place", F.row_number().over(again)).where("place = 1").select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
