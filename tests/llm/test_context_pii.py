import hashlib
import random
import re

from pyspark.sql import functions as F

from sparrowloom.llm import context_pii as P

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts():
    rng = random.Random(1)
    made = [(-i, "".join(rng.choice("ab@.é😀+ 0123-_%.(\n") for _ in range(rng.randint(0, 300)))) for i in range(1, 1500)]
    return made + [(-5002, "4111 1111 1111 1111 and 4111-1111-1111-1111"), (-5003, "+1 (743) 555-3824"), (None, "x@y.z"), (-5004, "x@y.z"), (-5004, "x@y.z"), (-5005, "1." * 3000 + "0 " + "7" * 20_000 + " a" + ".b" * 5000 + "@c" + ".d" * 5000)]


def test_base_columns(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(odd_texts(), "doc_id bigint, text string"))
    got = P.digest(docs).collect()
    want = []
    for r in docs.collect():
        spans = brute(r.text)
        want.append((r.doc_id, *[sum(k == s[0] for s in spans) for k in P.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(map(repr, want))
    for r in got:
        assert len(r.spans.split(",")) >= sum(r[f"n_{k}"] for k in P.KINDS) or not r.spans


def test_contexts_discover_identifiers(spark):
    """Cards follow "acct"; so does a number that fails the check digit. After "about" numbers are mostly no cards."""
    cards = ["4111111111111111", "5500000000000004", "340000000000009" + "0", "6011000000000004", "4012888888881881", "4222222222222220" ]
    seeds = [c for c in cards if luhn(c)]
    assert len(seeds) >= 4
    texts = [(i, f"pay to acct {c} now") for i, c in enumerate(seeds * 2)] + [(100, "pay to acct 4111111111111112 now"), (101, "it took about 123456789 years"), (102, "about 77777777 of them"), (103, "elsewhere 4111111111111112")]
    got = {r.doc_id: r.spans for r in P.digest(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got[101] == got[102] == ""
    found = {(r.instance, r.kind): 1 for r in P.discover(P.occurrences(spark.createDataFrame(texts[:-1], "doc_id bigint, text string"))).collect()}
    assert found == {("4111111111111112", "card"): 1}
    assert got[0] == "card:12:28"


def test_discovery_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["acct", "about", "id:", "no"]
    seeds = ["4111111111111111", "5500000000000004", "6011000000000004", "4012888888881881"]
    texts = []
    for i in range(150):
        word = rng.choice(words)
        token = rng.choice(seeds) if rng.random() < {"acct": 0.95, "about": 0.2, "id:": 0.9, "no": 0.5}[word] else f"9{rng.randrange(6)}99999"
        texts.append((i, f"so {word} {token} it is"))
    found = P.occurrences(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {(r.instance, r.kind) for r in P.discover(found).collect()} == brute_discovery(found)


def brute_discovery(found):
    """Rounds over dictionaries until nothing is added."""
    edges = {}
    for r in found.collect():
        for side in P.SIDES:
            if r[side]:
                key = (side, r[side], r.found.lower(), r.seed)
                edges[key] = edges.get(key, 0) + 1
    kind_of, rounds = {}, 0
    confident = {(i, k): (0, 1.0) for _, _, i, k in edges if k}
    while True:
        rounds += 1
        pattern = {}
        for p in {(s, w) for s, w, _, _ in edges}:
            own = [(i, k, n) for (s, w, i, k), n in edges.items() if (s, w) == p]
            for kind in P.EVERY_KIND:
                if p[0] == "shape" and kind not in P.SHAPED:
                    continue
                good = [(i, n) for i, k, n in own if k == kind or k == "" and kind_of.get((i, kind))]
                score = sum(n for _, n in good) / (sum(n for _, _, n in own) + 1)
                if len(good) >= P.SUPPORT and score >= P.CONFIDENT:
                    pattern[p, kind] = score
        added = {}
        for i in {i for _, _, i, k in edges if k == ""}:
            for kind in P.EVERY_KIND:
                sides = []
                for side in P.SIDES:
                    own = [((s, w), n) for (s, w, x, k), n in edges.items() if (s, x, k) == (side, i, "")]
                    if own:
                        sides.append(sum(n * pattern.get((p, kind), 0) for p, n in own) / sum(n for _, n in own))
                if max(sides, default=0) >= P.CONFIDENT and (i, kind) not in kind_of:
                    added[i, kind] = (-rounds, max(sides), kind)
        if not added:
            break
        kind_of |= added
    return {(i, max((v for (x, _), v in kind_of.items() if x == i))[2]) for i, _ in kind_of}


def test_discovered_instances_make_patterns(spark):
    """Seeds teach "acct"; what follows "acct" teaches "ref"; spaced numbers and names at a host count as well."""
    cards = ["4111111111111111", "5500000000000004", "6011000000000004", "4012888888881881"]
    texts = [f"acct {c} now" for c in cards] * 4 + [f"acct 99000{i} 77 now" for i in range(4)] + [f"{w} ref 99000{i} 77" for i in range(4) for w in ("see", "my", "old")] + ["look ref 880088 11"]
    texts += [f"mail to me{i}@host.org today" for i in range(12)] + ["mail to root@intranet today", "or root@elsewhere later"]
    found = P.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {(r.instance, r.kind) for r in P.discover(found).collect()}
    assert got == brute_discovery(found)
    assert got == {(f"99000{i} 77", "card") for i in range(4)} | {("880088 11", "card"), ("root@intranet", "email")}


def test_clashing_columns_ties_and_long_texts(spark):
    long = "word " * 100_000 + "x@y.zz " + "12 34 " * 50_000
    rows = spark.createDataFrame([(1, long), (1, long), (2, "a@b.cc a@b.cc")], "doc_id bigint, text string")
    clash = rows.withColumns({c: F.lit("clash") for c in ("kind", "start", "end", "found", "word", "n", "instance", "left")})
    got = P.digest(clash).collect()
    assert sorted((r.doc_id, r.n_email, r.spans.split(",")[0]) for r in got) == [(1, 1, "email:500000:500006")] * 2 + [(2, 2, "email:0:6")]
    assert P.redact(clash).columns == clash.columns


def test_redact(spark, odd, empty):
    texts = [(1, "é mail x@y.zz, +1 (743) 555-3824; 10.0.0.1!", 5), (2, "nothing", 7), (3, None, None), (1, "é mail x@y.zz, +1 (743) 555-3824; 10.0.0.1!", 5)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string, n_chars bigint").withColumns({"row": F.lit(1), "new": F.lit("n"), "holes": F.lit(0)})
    got = sorted(P.redact(rows).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in got] == ["é mail [EMAIL], [PHONE]; [IP]!"] * 2 + ["nothing", None]
    assert [r.n_chars for r in got] == [30, 30, 7, None] and P.redact(rows).columns == rows.columns
    docs = spark.createDataFrame(odd_texts(), "doc_id bigint, text string")
    left = {r.doc_id: r.text for r in P.redact(docs).collect()}
    listed = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in P.digest(docs).collect()}
    for doc, text in odd_texts():
        out, end = [], 0
        for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in listed[doc]), key=lambda s: (s[1], s[2], s[0])):
            if b > end:
                out += [text[end : max(a, end)], f"[{kind.upper()}]"]
                end = b
        assert left[doc] == "".join(out) + text[end:]
    assert P.redact(odd).count() == odd.count() and P.redact(empty).count() == 0 == P.digest(empty.select("doc_id", "text")).count()


def test_secrets_by_assignment_context_and_shape(spark):
    """Assigned tokens are seeds; their shape finds others elsewhere, their left word those of another shape."""
    rng = random.Random(9)
    key = lambda n, letters: rng.choice("0123456789") + rng.choice(letters[10:]) + "".join(rng.choice(letters) for _ in range(n - 2))
    low, plain = "0123456789abcdef", "0123456789ghijkl"
    own = [key(40, low) for _ in range(14)]
    texts = [f'so token = "{k}" it' for k in own[:10]] + [f"api_key: {key(24, plain)} ok" for _ in range(4)]
    texts += [f"elsewhere {own[12].upper()} stands", f"and {own[13]}, too", f"commit {key(20, low)} is short", "version = 12345678901234567890", f"mytoken = {key(30, plain)}"]
    found = P.occurrences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {(r.instance, r.kind) for r in P.discover(found).collect()}
    assert got == brute_discovery(found) and {(own[12], "secret"), (own[13], "secret")} <= got
    spans = {r.doc_id: (r.spans, r.base_sha256) for r in P.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [spans[i][0] for i in (0, 10, 14, 15, 16, 17)] == ["secret:12:52", "secret:9:33", "secret:10:50", "secret:4:44", "", ""]
    assert all(sha == hashlib.sha256(b"").hexdigest() for _, sha in spans.values())
    assert [r.text for r in P.redact(spark.createDataFrame([(1, texts[0])], "doc_id bigint, text string")).collect()] == ['so token = "[SECRET]" it']


def test_masked_seeds_are_found_again(spark):
    """A fourth of the seeds, told as plain tokens: those of a shape or context that the others teach come back."""
    found = P.occurrences(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"))
    share = F.pmod(F.xxhash64(F.lower("found")), F.lit(4)) == 0
    masked = found.withColumns({"seed": F.when(share, "").otherwise(F.col("seed")), "kind": F.when(share, "").otherwise(F.col("kind"))})
    hidden = {(r.instance, r.seed) for r in found.where(share & (F.col("seed") != "")).select(F.lower("found").alias("instance"), "seed").collect()}
    got = {(r.instance, r.kind) for r in P.discover(masked).collect()}
    own = [h for h in hidden if h[1] in P.SHAPED]
    assert len(own) >= 20 and sum(h in got for h in own) >= 0.9 * len(own)
    assert len(got - hidden) <= 0.1 * len(got)
