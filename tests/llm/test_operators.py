"""The training-data operators on Spark: SQL, brute force, and the cases that their docstrings define."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekeep.llm import chat_format, kdtree, line_dedup, mixing, ngram_model, packing, quality_rules, queries, similar, simhash, toxicity, url_filter
from tidekeep.llm.common import components
from tests.llm.conftest import DATA, TABLES, compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, kept boolean, tokens int, key string"
LONG = " ".join(f"w{i % 5000}" for i in range(40_000))
ROWS = [
    (1, None, None, None, None, "x", 1, True, 1, "k"),
    (2, "", "en", "a", 0, "x", 1, True, 1, "k"),
    (3, "one line of some words that is long enough\nanother line\n\n", "en", "a", 1, "x", 1, True, 1, "k"),
    (3, "one line of some words that is long enough\nanother line\n\n", "en", "a", 1, "x", 1, True, 1, "k"),
    (4, LONG, "en", "b", 1, "x", 1, True, 1, "k"),
    (None, "a text without an id in some language", "xx", "b", 1, "x", 1, True, 1, "k"),
    (5, "one line of some words that is lung enough\nmore", "de", "c", 1, "x", 1, True, 1, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a very long text, repeated rows, further columns with clashing names."""
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            self.up[n] = self.up[self.up[n]]
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name], **{t: f"{DATA}/{t}.parquet" for t in TABLES})


def test_mixing_of_a_hot_source(spark, tmp_path):
    rows = docs(spark).withColumn("source", F.when(F.col("doc_id") % 10 < 7, "hot").otherwise(F.col("source")))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op1_mixing(spark, str(tmp_path))
    compare(out, queries.ORACLE_SQL["op1_mixing"], documents=f"{tmp_path}/documents.parquet/*.parquet")
    assert out.first().exponent < 4096
    size = rows.select("doc_id", mixing.tokens().alias("t"))
    by = {r.source: r for r in out.join(size, "doc_id").groupBy("source").agg(F.sum("t").alias("t"), F.first("quota").alias("quota"), F.max("t").alias("most")).collect()}
    total = size.agg(F.sum("t")).first()[0]
    assert sum(r.quota for r in by.values()) <= total * 3 // 2 + len(by) and all(r.quota - r.most <= r.t <= r.quota for r in by.values())


def test_mixing_limits(spark, odd, none):
    p = mixing.plan(docs(spark), min_entropy=None, max_passes=2.0)
    got = mixing.mix(docs(spark), p).withColumn("t", mixing.tokens()).groupBy("source").agg(F.sum("t").alias("t"), F.max("mix_epoch").alias("e"))
    for r in got.join(p, F.col("source") == F.col("mix_source")).collect():
        assert r["t"] <= r["quota"] and r["e"] <= 2
    small = mixing.plan(docs(spark), min_entropy=0.9, max_passes=None, budget=5_000)
    assert mixing.mix(docs(spark), small).select(F.sum(mixing.tokens())).first()[0] <= 5_000
    mixed = mixing.mix(odd, mixing.plan(odd))
    assert mixed.count() >= len(ROWS) and set(odd.columns) < set(mixed.columns)
    assert mixing.mix(none, mixing.plan(none)).count() == 0
    ids = spark.range(100_000).select(mixing.permuted(F.col("id")).alias("x"))
    assert ids.distinct().count() == 100_000


def brute_quality(t):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n = len(w)
    c = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    inside = {k for i in range(n - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, odd, none):
    more = ["a b c d e f a b c d e g", "x " * 9, "x " * 11, "é　ü \x0b| a\n\n a\na\n b", "a b c d e a b c d e a b c d e"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for rows in (odd, extra, docs(spark)):
        for r in quality_rules.quality_rules(rows).collect():
            assert brute_quality(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    out = quality_rules.quality_rules(docs(spark))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert out.join(labels, "doc_id").where("quality = 1 and not kept and not base_failed").count() == 0
    cost = {r.rule: r for r in quality_rules.ablation(out).collect()}
    bits = [r.failures for r in out.collect()]
    for name, k in quality_rules.BIT.items():
        assert (cost[name].failed, cost[name].failed_alone) == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert quality_rules.quality_rules(none).count() == 0


def test_components(spark):
    rng = random.Random(0)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, k) for k in range(8, 60)] + [(5, 5)]
    u = Union({n for p in pairs for n in p})
    for a, b in pairs:
        u.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: u.find(n) for a, b in pairs if a != b for n in (a, b)}


def test_simhash(spark, odd, none):
    rows = docs(spark).select("doc_id", "text").union(odd.where("doc_id is not null").select(F.col("doc_id") + 10_000, "text"))
    got = simhash.near_duplicates(rows).collect()
    fps = {r.doc_id: np.uint64(int(r.fingerprint, 16)) for r in got}
    for r in rows.collect():
        assert int(fps[r.doc_id]) == simhash.simhash(simhash.shingle_hashes(r.text, 3))
    u, ids = Union(fps), list(fps)
    v = np.array([fps[i] for i in ids])
    for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2), strict=True):
        u.join(ids[i], ids[j])
    assert all(r.component_id == u.find(r.doc_id) for r in got) and len(got) == rows.count()
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(odd).count() == len(ROWS)


@pytest.mark.parametrize("run", [128, 3])
def test_simhash_links_of_large_groups(spark, run):
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(40):
            fps.add(base)
            base ^= 1 << int(rng.integers(64)) | (1 << int(rng.integers(64)) if rng.random() < 0.8 else 0)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), run)).collect()}
    u, v = Union(signed), np.array(signed, np.int64).view(np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2), strict=True):
        u.join(signed[i], signed[j])
    assert all(got.get(f, f) == u.find(f) for f in signed)


def test_near_copies(spark, odd, none):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(12)]
    rows = []
    for b in bases:
        for _ in range(12):
            own = list(b)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(similar.shingle_set(t, 5).tolist()) for i, t in rows}
    u = Union(sets)
    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                u.join(i, j)
    for limits in ({}, {"run": 2, "block": 8}):
        assert all(r.component_id == u.find(r.doc_id) for r in similar.near_copies(made, **limits).collect())
    assert similar.near_copies(none).count() == 0 and similar.near_copies(odd).count() == len(ROWS)


def test_line_dedup(spark, odd, none):
    rows = docs(spark)
    where = {}
    for r in rows.select("doc_id", "text").collect():
        for i, x in enumerate(r.text.split("\n")):
            if x := x.strip(line_dedup.BLANK):
                where.setdefault(x, []).append((r.doc_id, i))
    u = Union(where)
    own = list(where)
    for i, a in enumerate(own):
        for b in own[:i]:
            if min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= 2 and line_dedup.distance(a, b, 2) <= 2:
                u.join(a, b)
    first = {}
    for x, at in where.items():
        first[u.find(x)] = min([*at, first.get(u.find(x), (10**9, 0))])
    want = {at: first[u.find(x)] for x, ats in where.items() for at in ats}
    got = line_dedup.classes(rows).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc_id, r.class_line_no)) for r in got)
    cleaned = line_dedup.without_repeats(odd, line_dedup.classes(odd))
    assert cleaned.columns == odd.columns and cleaned.count() == len(ROWS)
    assert [r.text for r in cleaned.where("doc_id = 5").collect()] == ["more"]
    short = spark.createDataFrame([(1, " ok \n\n ok\nok.\n"), (2, "ok.\nno")], "doc_id long, text string")
    assert sorted((r.doc_id, r.line_no, r.class_doc_id, r.class_line_no) for r in line_dedup.classes(short).collect()) == [(1, 0, 1, 0), (1, 2, 1, 0), (1, 3, 1, 3), (2, 0, 1, 3), (2, 1, 2, 1)]
    assert line_dedup.classes(none).count() == 0


def test_lines_with_a_common_segment(spark):
    rng = random.Random(2)
    rows = [(i, f"a common first part of a line and then {rng.choice('abc') * rng.randrange(3)}{rng.randrange(1000)}") for i in range(200)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    roots = lambda **a: {(r.node.h, r.node.g): r.root for r in components(line_dedup.links(made, **a)).collect()}
    assert roots(run=10**6) == roots(run=8, block=50)


def test_top_k(spark, none):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(900)] + [(900 + i, [0.5] * 8) for i in range(300)]
    odd = [(2000, None), (2020, [1.0, None] * 4), (2040, [float("nan")] + [1.0] * 7), (2060, [1.0, 2.0]), (2080, []), (2100, [float("inf")] * 8)]
    made = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("dim", F.lit("clash"))
    x = np.floor(64 * np.array([v for _, v in rows])).astype(int)
    got = {}
    for r in kdtree.top_k(made, 20, 20, shard=150).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        want = sorted((-int(x[j] @ x[q]), j) for j in range(1200) if j != q)[:20]
        assert [found[k + 1] for k in range(20)] == [(j, -s) for s, j in want]
    assert kdtree.top_k(made.limit(0)).count() == 0


def test_url_filter(spark):
    urls = [None, "nourl", "HTTP://A.Example.NET/en/1", "http://example.com/de/x?y", "http://netx/", "http://x.net", "http://x.net/?q", "https://bad.site.io/casino/1", "https://ok.site.io/casino/1", "https://bad.site.io/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 8)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    labels = spark.createDataFrame([(urls[i % 10], i % 10 == 7) for i in range(80)] + [("http://x.y", None)], "url string, block boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, labels, support=0.05).collect()}
    assert len(got) == 80
    assert [got[i] for i in range(10)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/x", "example.com/de/", "block"), ("netx", "/", None, "allow"),
        ("x.net", "", None, "allow"), ("x.net", "/", "net/", "block"), ("bad.site.io", "/casino/1", None, "block" if 8 >= url_filter.LEAST else "allow"), ("ok.site.io", "/casino/1", None, "allow"), ("bad.site.io", "/x", None, "allow"),
    ]
    more = spark.createDataFrame([(i, u) for i, u in enumerate(urls * 20)], "page_id long, url string")
    labels = spark.createDataFrame([(urls[i % 10], i % 10 == 7) for i in range(200)], "url string, block boolean")
    blocked = url_filter.url_filter(more, labels, support=0.05).where("rule is null and verdict = 'block'").select("url").distinct().collect()
    assert [r.url for r in blocked] == ["https://bad.site.io/casino/1"]
    assert url_filter.url_filter(more, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0
    assert url_filter.url_filter(more.limit(0), labels).count() == 0


def test_mined_url_rules_against_enumeration(spark):
    """Every set of tokens is counted; a URL is blocked if it holds one with enough support and confidence."""
    import itertools

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    parts = lambda df: df.select("url", "rule", "verdict", url_filter.tokens(F.col("host"), F.col("path")).alias("tokens")).collect()
    judged = parts(url_filter.url_filter(pages))
    got = {r.url: (r.verdict, r.mined) for r in queries.op6_url_filter(spark, "/root/testdata/sf0.01").join(pages, "page_id").collect()}
    sets = lambda t: [frozenset(c) for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)]
    every, block = Counter(), Counter()
    labelled = [r for r in judged if r.rule]
    for r in labelled:
        every.update(sets(r.tokens))
        block.update(sets(r.tokens) if r.verdict == "block" else [])
    least = max(url_filter.SUPPORT * len(labelled), url_filter.LEAST) - 1e-6
    rules = {x for x, n in block.items() if n >= least and n >= url_filter.CONFIDENCE * every[x]}
    hit = {r.url: any(x in rules for x in sets(r.tokens)) for r in judged if r.rule is None}
    assert rules and any(hit.values()) and not all(hit.values())
    assert all(got[u] == ("block" if h else "allow", h) for u, h in hit.items())


def check_packing(rows, packed):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    want = Counter()
    for r in rows.collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 4096):
            want[(r.doc_id, len(ids), s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes()))] += 1
    got, by = Counter(), {}
    for r in packed.collect():
        got[(r.doc_id, r.doc_tokens, r.start, r.length, r.ids_crc32)] += 1
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 4096


def test_packing(spark, odd, none):
    for rows in (docs(spark), odd):
        check_packing(rows, packing.packing(rows, queries.tokenizer()))
    p = packing.padding(packing.packing(docs(spark), queries.tokenizer())).first()
    assert p.padding < 0.06 * p.tokens
    assert packing.packing(none, queries.tokenizer()).count() == 0


def test_toxicity(spark, odd, none):
    words = [f"w{i}" for i in range(300)]
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(60)]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            text[rng.randrange(60)] = rng.choice(["wretch", "scoundrel", "zoxi" + "".join(rng.choice("abcde") for _ in range(3))])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    made, own = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lexicon, weights = toxicity.learn(made, own.where("doc_id % 3 > 0"))
    entries = [(e, stem) for e, stem, _ in lexicon.entries]
    assert ("wretch", False) in entries and ("scoundrel", False) in entries and any(s and e.startswith("zoxi") for e, s in entries)
    out = toxicity.score(made, lexicon, weights).join(own, "doc_id").where("doc_id % 3 = 0")
    assert out.where("predicted <> toxic").count() <= 3
    texts = ["a wrech w1 w2", None, "", "w1 " * 30, "a wretch w1 w2", 'he said "wretch" w1 w2', "a wrech w1 scondrel " + "w2 " * 60, "w1 " * 79 + "wretch"]
    near = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    s = {r.doc_id: r for r in toxicity.score(near, lexicon, weights).collect()}
    assert (s[1].hits, s[1].misspelled) == (1, 1) and s[2].score == s[3].score == s[4].score
    assert s[2].score < s[1].score < s[5].score and s[2].score < s[6].score < s[5].score and s[7].score > s[2].score and s[8].predicted == 1
    assert toxicity.score(odd, lexicon, weights).count() == len(ROWS) and toxicity.score(none, lexicon, weights).count() == 0
    assert toxicity.score(near, *toxicity.learn(made, own.limit(0))).where("predicted = 1").count() == 0


def brute_kn(texts):
    """Probabilities of modified Kneser-Ney, gram by gram (tuples of symbols)."""
    n = ngram_model.ORDER
    seqs = [ngram_model.symbols(t).tolist() for t in texts]
    levels = {n: Counter(tuple(s[i : i + n]) for s in seqs for i in range(len(s) - n + 1))}
    for m in range(n - 1, 0, -1):
        levels[m] = Counter(g[1:] for g in levels[m + 1])
    cut = {}
    for m, c in levels.items():
        of = Counter(c.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        cut[m] = [max(0.0, min(float(j), j - (j + 1) * y * of[j + 1] / of[j])) for j in (1, 2, 3)] if of[1] and of[2] and of[3] else [0.5] * 3

    def p(g):
        m = len(g)
        if m == 0:
            return 1 / (len(levels[1]) + 1)
        c = levels[m]
        seen = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        low = p(g[1:])
        if not seen:
            return low
        off = lambda v: min(cut[m][min(v, 3) - 1], v)
        total = sum(seen.values())
        return ((c[g] - off(c[g])) if c[g] else 0.0) / total + sum(map(off, seen.values())) / total * low

    return p


def test_ngram_model(spark, odd, none, monkeypatch):
    monkeypatch.setattr(ngram_model, "LEAST", 1)
    texts = ["the cat sat on the mat. the dog 12", "a cat and a dog sat", "the mat and the cat", "猫在垫子上 😀"]
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    model = ngram_model.Model(rows)
    p = brute_kn(texts)
    more = [*texts, "zebra 9!", "垫猫", "", None, "the cat sat " * 3000]
    made = spark.createDataFrame([(i, "en" if i % 2 else None, t) for i, t in enumerate(more)], rows.schema)
    for shard in (ngram_model.SHARD, 20):
        out = {r.doc_id: r for r in ngram_model.perplexities(made, model, shard).collect()}
        assert len(out) == len(more)
        for i, t in enumerate(more[:8]):
            s = ngram_model.symbols(t).tolist()
            want = np.exp(-np.mean([np.log(p(tuple(s[j : j + 4]))) for j in range(len(s) - 3)]))
            assert abs(out[i].perplexity - want) < 1e-3 * want and out[i].n_symbols == len(t or "") + 1
    en = ngram_model.Scorer(*model.part(["en"], 0, 1)["en"])
    after = np.arange(1 << 16, dtype=np.int64) | ngram_model.grams("the")[2] << 16
    known = sorted({c for t in texts for c in ngram_model.symbols(t).tolist()} - {ngram_model.START})
    assert abs((2.0 ** en(after[known]).astype(float)).sum() - 1) < 0.05 and (2.0 ** en(after[known]).astype(float)).sum() < 1 + 1e-6
    labels = spark.createDataFrame([(i, True) for i in range(6)], "doc_id long, trusted boolean")
    assert ngram_model.classify(odd, labels).count() == len(ROWS)
    assert ngram_model.classify(odd, labels.limit(0)).where("kept").count() == len(ROWS)
    assert ngram_model.classify(none, labels).count() == 0


def test_classifier_accuracy(spark, tmp_path):
    """Two thirds of the labels are learned from; the others, held out, are counted."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    own = labels.where("doc_id % 3 > 0").select("doc_id", (F.col("quality") == 1).alias("trusted"))
    out = ngram_model.classify(spark.read.parquet(f"{sf}/documents.parquet"), own).join(labels.where("doc_id % 3 = 0"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.05 * n[(1, True)] and n[(0, False)] >= 0.7 * (n[(0, False)] + n.get((0, True), 0))


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, size string"
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "a\\</s>", "x"), (1, 1, "assistant", "a\\</s>", "x"), (2, None, None, "", "x"), (None, 0, "assistant", "é " * 30_000, "x")]
    made = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.formatted(made, queries.tokenizer("byte_bpe_50k.json"))).collect()}
    own = spark.createDataFrame([(5, 0, "user", "x<|endoftext|>y"), (5, 1, "assistant", "<|endoftext|>"), (None, 0, "assistant", "a"), (None, 0, "assistant", "bc"), (None, 1, "user", "d")], "conv_id long, turn long, role string, text string")
    done = chat_format.formatted(own, queries.tokenizer("byte_bpe_50k.json"))
    marks = [chat_format._encoder(queries.tokenizer("byte_bpe_50k.json"))[0].token_to_id(x) for x in ("<|endoftext|>", "</s>")]
    assert [[r.input_ids.count(m) for m in marks] for r in done.where("conv_id = 5").collect()] == [[0, 2]]
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in chat_format.digests(done).collect()) == [(0, 1, 0), (0, 1, 1), (0, 1, 2), (5, 2, 13)]
    assert (got[1].n_turns, got[1].loss_chars) == (3, 12) and got[2].loss_chars == 0 and got[None].loss_chars == 60_000
    assert chat_format.formatted(made.limit(0), queries.tokenizer("byte_bpe_50k.json")).count() == 0
