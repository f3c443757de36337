import random
import re

import xxhash
from pyspark.sql import functions as F

from sparrowloom.llm import simhash_join as S


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps):
    """fps: (id, fingerprint) by comparing all pairs."""
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= S.MAX_BITS:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    groups = {}
    for i, (doc, _) in enumerate(fps):
        groups.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in own if d is not None), default=None) for r, own in groups.items()}
    return [(doc, f, least[root(i)]) for i, (doc, f) in enumerate(fps)]


def test_near_copies_are_kept_once(spark):
    """Copies with a few words changed, of which at least 0.8 of the five-word shingles are left; other texts stay."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    rows = []
    for group in range(30):
        words = [word() for _ in range(rng.randrange(120, 400))]
        rows.append((group, " ".join(words)))
        for copy in range(rng.randrange(4)):
            other = list(words)
            for at in rng.sample(range(len(words)), len(words) // 60):
                other[at] = word()
            rows.append((1000 + group * 10 + copy, " ".join(other)))
    got = sorted(r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == one_of_each_alike(rows)
    assert set(range(30)) <= set(got) and len(got) <= 32


def test_fingerprints_and_components(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    fps = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    got = S.components(docs).select("doc_id", F.lower(F.hex("fp")), "component_id").collect()
    assert sorted(map(repr, ((d, int(h, 16), c) for d, h, c in got))) == sorted(map(repr, components(fps)))


def test_dense_and_chained_groups(spark):
    """Groups of near fingerprints, chains whose ends are far apart, and neighbours at distances around the limit."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(60)]
    for _ in range(5):
        f = rng.getrandbits(64)
        for _ in range(12):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 4, 5])))
            fps.append(f)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    _, comps = S.fingerprint_components(spark.createDataFrame(rows, "doc_id bigint, fp bigint"))
    got = {r.fp: r.component_id for r in comps.collect()}
    for doc, f, least in components(list(enumerate(fps))):
        assert got.get(f - (1 << 64) if f >> 63 else f, doc) == least


def test_bound_never_exceeds_the_distance(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 64, 2000, dtype=np.uint64) for _ in range(2))
    bound = np.bitwise_count(S.unary(a) ^ S.unary(b))
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)]).astype(int)
    shifted = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp bigint").select(S.vector(F.col("fp"))).collect()
    assert [r[0] for r in shifted] == S.unary(a).view(np.int64).tolist()
    assert (bound == abs(counts(a) - counts(b)).sum(0)).all() and (bound <= np.bitwise_count(a ^ b)).all()


def test_every_close_pair_shares_a_cell():
    """Random fingerprints with 4 differing bits, the bits anywhere: two of the thirds bring them together."""
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)) for _ in range(len(a))], dtype=np.uint64)
    cells = []
    for x in (a, a ^ flips):
        rows, own = S.cells_of(x)
        cells.append([set(own[rows == i].tolist()) for i in range(len(x))])
    assert all(p & q for p, q in zip(*cells, strict=True))
    assert 60 < np.mean([len(p) for p in cells[0]]) < 140


def test_long_texts_and_clashing_columns(spark):
    long = "w x y z " * 200_000
    rows = spark.createDataFrame([(3, long), (1, long + "end"), (2, "other words here")], "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in ("fp", "node", "forms", "comp", "cell", "component_id", "row", "kept")})
    assert {(r.doc_id, r.component_id) for r in S.components(rows).collect()} == {(1, 1), (3, 1), (2, 2)}
    kept = S.keep_one(rows)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == {1, 2}  # of five shingles four are shared


def test_keep_one(spark, odd, empty):
    kept = S.keep_one(odd).collect()
    # 1, 2 and 3 have no words; 5, its repeat and 6 one text; the row without id is alone.
    assert sorted((r.doc_id for r in kept), key=str) == [1, 4, 5, 7, None]
    assert S.keep_one(odd).columns == odd.columns
    assert S.keep_one(empty).count() == 0 == S.components(empty).count()


def five_word_likeness(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    return len(grams(a) & grams(b)) / len(grams(a) | grams(b))


def test_every_pair_of_the_threshold_is_found(spark):
    """Pairs around 0.8 of all lengths, a block or scattered words changed: of two that share 0.8 one is kept, else both."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows, alike = [], {}
    for pair in range(240):
        words = [word() for _ in range(rng.choice([20, 60, 150, 400]))]
        other = list(words)
        changed = max(1, int(len(words) * rng.uniform(0.01, 0.12)))
        if pair % 2:
            at = rng.randrange(len(words) - changed)
            other[at : at + changed] = [word() for _ in range(changed)]
        else:
            for at in rng.sample(range(len(words)), max(1, changed // 4)):
                other[at] = word()
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(other))]
        alike[pair] = five_word_likeness(rows[-1][1], rows[-2][1]) >= 0.8
    assert 40 < sum(alike.values()) < 220
    got = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {p for p in alike if 2 * p + 1 not in got} >= {p for p in alike if alike[p]}
    assert all(2 * p in got for p in alike)


def one_of_each_alike(rows):
    """rows: (id, text). The smallest id of every group by the true five-word likeness of all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def test_kept_by_true_likeness(spark):
    """The sample table and texts whose fingerprints are next to each other though few shingles are shared."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    common = "one two three four five " * 60
    more = [(10_000_000 + i, common + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(3)]
    assert len({fingerprint(t) for _, t in more}) == 1
    got = S.keep_one(docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))).collect()
    assert sorted(r.doc_id for r in got) == one_of_each_alike(rows + more)
    assert {d for d, _ in more} <= {r.doc_id for r in got}


def test_counts_never_exceed_the_sets_difference():
    import numpy as np

    rng = np.random.default_rng(9)
    for n in (1, 40, 700, 90_000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 64, n // 8, dtype=np.uint64)]))
        x, y = (np.frombuffer(S.set_counts(s), np.uint8).astype(int) for s in (a, b))
        assert len(x) == S.SET_SEGMENTS and abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_pairs_of_a_famous_set_are_dealt(spark, monkeypatch):
    """With low limits a set with many pairs is in several parts, and no pair is lost."""
    monkeypatch.setattr(S, "HOT_PAIRS", 5)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        own = list(base)
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:40] + [f"y{i}x{k}" for k in range(80)])) for i in range(20)]
    pairs = spark.createDataFrame([(1, b) for b in range(2, 40)] + [(2, 3)], "a bigint, b bigint")
    hot, parted = S.dealt(pairs)
    assert [(r.a, r.parts) for r in hot.collect()] == [(1, 8)] and parted.count() == 39
    assert parted.where("a = 1").select("part").distinct().count() > 4 and [r.part for r in parted.where("a = 2").collect()] == [0]
    got = S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == one_of_each_alike(rows) == [0, *range(100, 120)]


def plain_cells(hashes, level, pieces):
    """From the definition: each piece's fingerprint, counted by segments, on the lattice."""
    held = {}
    for h in hashes:
        held.setdefault((h >> 32) * pieces >> 32, []).append(h)
    cells = set()
    for piece, own in held.items():
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        point = sum(((0, 1, 3)[(fp >> 2 * i & 3).bit_count()]) << 2 * i for i in range(32))
        told = ((piece << 6) + level + 1) * 0x9E3779B97F4A7C15 % 2**64
        told = (told ^ told >> 32) * 0xD6E8FEB86659FD93 % 2**64
        cells.add(point ^ told ^ told >> 29)
    return cells


def test_sets_are_dealt_by_fingerprints_of_pieces(spark):
    """Cells are the lattice points of SimHash fingerprints, as many as alike sets can differ in and one more."""
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n + 4)) for n in (1, 5, 9, 45, 61, 130, 700)] + ["a b", "", None]
    got = {r.doc_id: r for r in S.sketches(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for doc, text in enumerate(texts):
        hashes = S.shingle_set(S.words_of(text)).tolist()
        n = len(hashes)
        if not n:
            assert got[doc].n == 0 and got[doc].cells is None
            continue
        level = n.bit_length() - 1
        classes = [(level, n // 4)] + [(level - 1, (n + 2**level - 1) // 9)] * (5 * (2**level - 1) >= 4 * n)
        want = []
        for own, most in classes:
            cells = plain_cells(hashes, own, -(-(2 ** (own + 1)) // 3))
            assert len(cells) > most
            want += sorted(cells)[: most + 1]
        assert [c % 2**64 for c in got[doc].cells] == want
        assert got[doc].places == [i for _, most in classes for i in range(most + 1)]


def test_every_alike_pair_of_sets_shares_a_cell():
    """Sets that share just 0.8 or more, of all sizes around the classes' bounds, their hashes anywhere or all in one piece, some common."""
    import numpy as np

    rng = np.random.default_rng(8)
    met = few = 0
    for trial in range(6000):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 32, 63, 64, 65, 127, 128, 129, 500]))
        pool = rng.permutation(np.unique(rng.integers(0, 1 << (20 if trial % 4 == 0 else 64), 2 * n + 8, dtype=np.uint64)))
        apart = int(rng.integers(0, n // 4 + 1)) if trial % 3 else n // 4
        left = int(rng.integers(0, apart + 1))
        a, b = np.sort(np.append(pool[:n], pool[n : n + left])), np.sort(np.append(pool[:n], pool[n + left : n + apart]))
        common = np.sort(pool[rng.random(len(pool)) < 0.5])
        ranks = rng.permutation(len(common)).astype(np.int64) + 1
        dense = int(rng.choice([1, len(common) // 2 + 1, len(common) + 1]))
        x, y = (dict(zip(*(v.tolist() for v in S.set_cells(s, common, ranks, dense)), strict=True)) for s in (a, b))
        # As may_be_near(), which must let one of the shared cells pass.
        near = lambda i, j: 9 * max(i, j) <= len(a) + len(b) if i >= 0 else 9 * min(len(a) + i + 1, len(b) + j + 1) >= 4 * (len(a) + len(b))  # noqa: B023, E731
        assert any(near(x[c], y[c]) for c in x.keys() & y.keys())
        met += 1
        few += min(x.values()) < 0
    assert met == 6000 and few > 500


def test_large_pieces_have_the_majority_of_their_hashes():
    import numpy as np

    hashes = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 2000, dtype=np.uint64))
    for starts in ([0, 1, 3, 6, 10, 250, 500, 750, 1000, 1250, 1500, 1750], [0, 255, 511, 1200], [0]):
        got = S.piece_fingerprints(hashes, np.array(starts))
        assert got.tolist() == [S.majority(h) for h in np.split(hashes, starts[1:])]


def test_near_copies_are_found_by_the_grid_alone(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + ["end"])), (3, " ".join(words))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1]
    shared = S.shared_cells
    monkeypatch.setattr(S, "shared_cells", lambda own: shared(own).limit(0))
    assert sorted(r.doc_id for r in S.keep_one(docs).collect()) == [1, 2]


def test_a_common_passage_makes_no_dense_cell(spark):
    """Texts of which half is one passage do not meet in it."""
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**7)}" for _ in range(45))) for i in range(600)]
    met = S.shared_cells(S.sketches(spark.createDataFrame(rows, "doc_id bigint, text string"))).groupBy("cell").count()
    assert max((r["count"] for r in met.collect()), default=0) < 20
