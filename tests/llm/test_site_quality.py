import math
from collections import Counter, defaultdict

import pytest
from oracle import same
from pyspark.sql import functions as F

from sparrowloom.llm import site_quality as Q


def test_query_equals_sql(spark, sf_dir, duck):
    same(Q.op6_site_quality(spark, sf_dir), duck, Q.OP6_SQL)


def shares(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return None
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    letters = [c for c in text if c.isascii() and c.isalpha()]
    n = len(words)
    return (sum(c in "#*$%&|<>" for c in text) / n, sum(c.isupper() for c in letters) / len(letters) if letters else 0.0, len(repeated) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n)


def tokens(text):
    return {w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w}


def bins(text, ratio):
    s = shares(text)
    known = [ratio[w] for w in tokens(text) if w in ratio]
    s = s and (*s, round(sum(known) / len(known), 9) if known else 0.0)
    return [0 if s is None else 1 + sum(x > e for e in edges) for x, edges in zip(s or [0] * 5, Q.EDGES.values(), strict=True)]


def brute(docs, labels):
    count = [[[1, 1] for _ in range(len(e) + 2)] for e in Q.EDGES.values()]
    total = [0, 0]
    by_id = defaultdict(list)
    for r in docs:
        by_id[r.doc_id].append(r)
    seen = defaultdict(lambda: [0, 0])
    chosen = [(r, q) for i, q in set(labels) for r in (by_id[i] if i is not None else [])]
    for r, q in chosen:
        total[q] += 1
        for w in tokens(r.text):
            seen[w][q] += 1
    common = sorted((w for w, c in seen.items() if sum(c) >= Q.WORD_DOCS), key=lambda w: (-sum(seen[w]), w.encode()))[: Q.WORDS]
    ratios = lambda bad, good: {w: math.log(max(1, seen[w][1] + 1 - good) / (total[1] + 2 - good)) - math.log(max(1, seen[w][0] + 1 - bad) / (total[0] + 2 - bad)) for w in common} if all(total) else {}
    ratio = ratios(0, 0)
    for r, q in chosen:
        for f, b in enumerate(bins(r.text, ratios(1 - q, q))):
            count[f][b][q] += 1
    weights = [[math.log(g / (total[1] + len(c))) - math.log(b / (total[0] + len(c))) if all(total) else 0 for b, g in c] for c in count]
    e = [sum(w[b] for w, b in zip(weights, bins(r.text, ratio), strict=True)) for r in docs]
    p = [1 / (1 + math.exp(-x)) for x in e]
    host, path = defaultdict(list), defaultdict(list)
    for r, x in zip(docs, p, strict=True):
        host[r.source].append(x)
        path[r.source, r.lang].append(x)
    n = len(docs)
    mean = sum(p) / n
    m = lambda spread, mu: Q.MAX_STRENGTH if spread <= 0 else max(Q.MIN_STRENGTH, min(Q.MAX_STRENGTH, mu * (1 - mu) / spread - 1))
    hm = m(sum(sum(h) ** 2 / len(h) for h in host.values()) / n - mean * mean, mean)
    pm = m(sum(len(x) * (sum(x) / len(x) - sum(host[k[0]]) / len(host[k[0]])) ** 2 for k, x in path.items()) / n, mean)
    out = []
    for r, x, own in zip(docs, e, p, strict=True):
        h, s = host[r.source], path[r.source, r.lang]
        hp = (sum(h) - own + hm * mean) / (len(h) - 1 + hm)
        pp = (sum(s) - own + pm * hp) / (len(s) - 1 + pm)
        c = max(1e-6, min(1 - 1e-6, pp))
        out.append((r.doc_id, x, hp, pp, 1 / (1 + math.exp(-(x + math.log(c / (1 - c)))))))
    return out


@pytest.mark.parametrize("share", [Q.HOT_SHARE, 0.05, 2.0])
def test_equals_brute_force(spark, sf_dir, documents, odd, share, monkeypatch):
    """Also with most or all sites on the shuffled side."""
    monkeypatch.setattr(Q, "HOT_SHARE", share)
    docs = documents.withColumn("row", F.lit("clash")).unionByName(odd.select(*documents.columns, "row"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = Q.score_documents(docs, labels).select("doc_id", "evidence", "host_p", "path_p", "posterior").collect()
    want = brute(docs.collect(), [(r.doc_id, r.quality) for r in labels.collect()])
    key = lambda r: (str(r[0]), round(r[1], 5))
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and all(abs(x - y) < 1e-6 for x, y in zip(a[1:], b[1:], strict=True)), (a, b)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in Q.keep_quality(docs, labels.where("doc_id % 2 = 0")).select("doc_id").collect()}
    held = labels.where("doc_id % 2 = 1").collect()
    assert sum((r.doc_id in kept) == bool(r.quality) for r in held) >= 0.97 * len(held)


def test_without_labels_or_rows(spark, documents, odd, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert Q.keep_quality(odd, none).count() == odd.count() and Q.keep_quality(odd, none).columns == odd.columns
    assert Q.keep_quality(empty, none).count() == 0


def test_words_speak(spark):
    """Texts of one shape are told apart by their words; the documents of a site speak for a new one of it."""
    good, bad = "apple tree river stone bread".split(), "casino bonus click winner prize".split()
    text = lambda words, i: " ".join(words[(i + k * k) % 5] + " " + "abcdefghijklmn"[(i * 7 + k) % 14] for k in range(30))
    rows = [(i, text(good if i % 2 else bad, i), "en", f"src{i % 2}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    assert all((got[i].posterior >= 0.5) == bool(i % 2) for i in range(100, 200))
    kept = Q.keep_quality(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {i for i in got if i % 2}
    assert "text" not in Q.score_documents(docs, labels)._jdf.queryExecution().optimizedPlan().toString()


def test_sites_of_urls(spark, sf_dir):
    pages = Q.with_site(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert pages.where("host is null or path is null").count() == 0
    odd = spark.createDataFrame([("http://Example.ORG/a/b?c",), ("https://x.y",), ("no url",), (None,)], "url string")
    assert [(r.host, r.path) for r in Q.with_site(odd).collect()] == [("example.org", "a"), ("x.y", ""), (None, ""), (None, "")]
