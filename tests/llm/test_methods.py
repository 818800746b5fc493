"""The parts of the training-data operators that need no Spark."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidekeep.llm import chat_format, golay, kdtree, line_dedup, ngram_model, packing, similar, simhash, toxicity

TOKENS = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    for v in rng.integers(0, 1 << 23, 25):
        flips = np.array([0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a in range(23) for b in range(a)])
        which, index = golay.keys(v ^ flips)
        own = set(index[which == 0])
        assert len(own) in (1, 6)
        assert all(own & set(index[which == k]) for k in range(len(flips)))


def test_golay_keys_of_fingerprints_meet():
    rng = np.random.default_rng(1)
    for v in rng.integers(0, 1 << 63, 40).astype(np.uint64):
        near = v ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
        which, keys = simhash.golay_keys(np.array([v, near]))
        assert set(keys[which == 0]) & set(keys[which == 1])


def brute_simhash(text, n):
    import xxhash

    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@given(st.one_of(st.none(), st.text(alphabet="aB é\n\t", max_size=60)))
def test_simhash(text):
    assert simhash.simhash(simhash.shingle_hashes(text, 3)) == brute_simhash(text, 3)


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12), st.integers(1, 4))
def test_edit_distance(a, b, k):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    assert line_dedup.distance(a, b, k) == min(row[-1], k + 1)


@given(st.text(alphabet="abcd", min_size=9, max_size=40), st.randoms())
def test_segments_meet(line, rng):
    other = list(line)
    for _ in range(2):
        at = rng.randrange(len(other))
        rng.choice([lambda: other.pop(at), lambda: other.insert(at, "x"), lambda: other.__setitem__(at, "y")])()
    which, key, own, s = line_dedup.line_index([line, "".join(other), "some other line"], 2)
    keys = lambda n, mine: {k for w, k, m in zip(which, key, own, strict=True) if w == n and m >= mine}
    assert keys(0, 1) & keys(1, 0) or keys(0, 0) & keys(1, 1)
    assert int(s[0] ^ s[1]).bit_count() <= 4


@given(st.lists(st.text(alphabet="ab\ud800é😀", min_size=3, max_size=12), min_size=1, max_size=6))
def test_line_index_hashes_substrings(lines):
    which, key, own, signs = line_dedup.line_index(lines, 2)
    of, n = {}, 0
    for starts, sizes, tags, mine, fine in line_dedup.probes(np.array([len(x) for x in lines]), 2):
        for k in np.flatnonzero(fine).tolist():
            p, m = int(starts[k]), int(sizes[k])
            assert (which[n], own[n]) == (k, mine) and of.setdefault((int(tags[k]), lines[k][p : p + m]), key[n]) == key[n]
            n += 1
    assert n == len(key) and len(set(of.values())) == len(of)
    for k, x in enumerate(lines):
        assert sum(own[which == k]) == 3 and sorted(int(s[k]) for s, _, t, m, _ in line_dedup.probes(np.array([len(y) for y in lines]), 2) if m) == [a for a, _ in line_dedup.segments(len(x), 2)]
    want = [sum(1 << b for b in range(64) if sum(ord(c) & 63 == b for c in x) % 2) for x in lines]
    assert [int(x) for x in signs] == want == [int(x) for x in line_dedup.signatures(lines)]


def test_word_cache_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENS)
    texts = ["", " ", "Hello world. It's, fine,, x.", "Ä J̌ Ḱ É. ß, İ Σς.", "<|endoftext|>. <|ENDOFTEXT|>, ok", "a\x1cb c\x85d e.", "5. 5, #t! 日本. 'S. dON'T,", "x" * 3000 + ". y"]
    for held, kept in ((packing.HELD_WORDS, packing.KEPT_WORDS), (3, 2), (30, 7)):
        words = packing.WordCache(TOKENS, held, kept)
        for _ in range(3):
            words.trim()
            ids, at = words.ids(pa.array([*texts, None]))
            for t, a, b in zip([*texts, ""], at[:-1], at[1:], strict=True):
                assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ.,'ÀÉßİı\u0301 \n<|>0"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
@settings(deadline=None)
def test_words_are_encoded_as_in_the_text(texts):
    plain = packing._words(TOKENS)
    ids, at = plain.ids(pa.array(texts))
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == plain.encoder.encode(t, add_special_tokens=False).ids


def test_merges_are_the_tokenizers():
    """All words of some documents, and made ones, against the library."""
    import pyarrow.parquet as pq

    words = {w.lower() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() for w in t.split() if packing._LETTERS(w)}
    rng = random.Random(8)
    words |= {"".join(rng.choice("aabcdeehilnorstéßıłž") for _ in range(rng.randint(1, 30))) for _ in range(20_000)} | {"a" * n for n in range(1, 70)}
    words = sorted(words)
    own = packing._words(TOKENS)
    ids, counts = own.merges.encode(words)
    at = np.cumsum(counts) - counts
    found = own.encoder.encode_batch_fast(words, add_special_tokens=False)
    assert len(words) > 30_000 and all(ids[a : a + n].tolist() == e.ids for a, n, e in zip(at, counts, found, strict=True))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=20))
def test_patterns_cover_the_demand(demand):
    found = packing.patterns(demand, 64)
    for size, n in demand.items():
        assert sum(times * p.get(size, 0) for times, p in found) == n
    assert all(sum(s * n for s, n in p.items()) <= 64 and times > 0 for times, p in found)
    if demand:
        ffd = []
        for s in sorted((s for s, n in demand.items() for _ in range(n)), reverse=True):
            at = next((i for i, free in enumerate(ffd) if free >= s), None)
            if at is None:
                ffd.append(64 - s)
            else:
                ffd[at] -= s
        assert sum(t for t, _ in found) <= len(ffd) * 1.1 + len(demand)


def test_price_is_the_best_pattern():
    rng = random.Random(3)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 20), 4)))
        duals = np.array([rng.random() for _ in sizes])
        value, pattern = packing.price(duals, sizes, 30)
        best = [0.0] * 31
        for s in range(31):
            best[s] = max([best[s - 1] if s else 0.0] + [best[s - z] + d for z, d in zip(sizes, duals, strict=True) if z <= s])
        assert abs(value - best[30]) < 1e-9 and abs(pattern @ duals - value) < 1e-9 and pattern @ sizes <= 30


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\n[INST]"]), st.one_of(st.text(alphabet="</s>[INST]\\ é\n", max_size=30), st.just("a <|endoftext|> b <\\|endoftext|>"))), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat_format.render(turns, chat_format.controls(("<|endoftext|>",)))
    assert chat_format.parse(text) == turns and "<|endoftext|>" not in text
    assert [chat_format.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert sum(text.count(m) for m in chat_format.MARKS) == 4 * len(turns)


@pytest.mark.parametrize("shape", ["random", "equal", "clusters"])
def test_kd_search(shape):
    rng = np.random.default_rng(5)
    points = {"random": rng.integers(-9, 9, (900, 6)), "equal": np.ones((900, 6)), "clusters": np.repeat(rng.integers(-20, 20, (9, 6)), 100, axis=0)}[shape].astype(float)
    ids = rng.permutation(900)
    q = points[:40]
    scores, found = kdtree.search(q, ids[:40], np.full(40, -np.inf), points, ids, 20)
    for i in range(40):
        want = sorted((-(points[j] @ q[i]), ids[j]) for j in range(900) if ids[j] != ids[i])[:20]
        assert [(-s, n) for s, n in zip(scores[i], found[i], strict=True)] == want


def test_lexicon():
    lex = toxicity.Lexicon([("idiot", False, 0.9), ("disgusting", False, 0.5), ("lowei", True, 0.7), ("bad", False, 1.0)], frozenset(["idiom"]))
    assert toxicity.Lexicon(lex.entries, strict=frozenset(["idiot"])).of("idit")[1] == -1
    got = {w: lex.of(w) for w in ["idiot", "xidiot", "id1ot", "idit", "(idiot)!", "idoit", "disgusting", "disgsting", "dizgustng", "loweisp", "lowe", "low", "bad", "bed", "", "the", "idiom"]}
    errors = {"idiot": 0, "xidiot": 1, "id1ot": 1, "idit": 1, "(idiot)!": 0, "idoit": -1, "disgusting": 0, "disgsting": 1, "dizgustng": 2, "loweisp": 0, "lowe": -1, "low": -1, "bad": 0, "bed": -1, "": -1, "the": -1, "idiom": -1}
    assert {w: e for w, (_, e, _) in got.items()} == errors
    assert got["idiot"][0] == 0.9 and got["loweisp"][0] == 0.7 and abs(got["dizgustng"][0] - 0.5 * toxicity.DISCOUNT**2) < 1e-12 and got["bed"][0] == 0


def test_context_scores():
    lex = toxicity.Lexicon([("idiot", False, 1.0)])
    value = lambda text: toxicity.features(lex, text)[0][1]
    plain, near, far, told, address = map(value, ["a b idiot c d", 'a "b idiot c" d', 'a "b c d e f idiot g h i j" k', "he said idiot to c", 'you "idiot" c d'])
    assert plain == 1 and near < far < plain and told < plain and value('"idiot"') < near and value('"idiot" c d') < address < plain
    assert value("he said a b c idiot") > told and value('he said "idiot" c') < value('"idiot" c d')


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_against_edit_distances():
    rng = random.Random(4)
    entries = [("".join(rng.choice("abc") for _ in range(n)), False, n / 20) for n in (3, 5, 6, 6, 9, 10)]
    lex = toxicity.Lexicon(entries)
    for _ in range(3000):
        base = list(rng.choice(entries)[0])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(base))
            rng.choice([lambda: base.pop(at), lambda: base.insert(at, rng.choice("abc")), lambda: base.__setitem__(at, "x")])()
        w = "".join(base)
        fits = [(s * toxicity.DISCOUNT**d, d, e) for e, _, s in entries if (d := levenshtein(w, e)) <= toxicity.allowed(len(e))]
        exact = [f for f in fits if f[1] == 0]
        assert lex.of(w) == max(exact or fits, default=(0.0, -1, "")) and lex.errors(w) == min((d for _, d, _ in fits), default=-1)


def test_weights_are_not_negative():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=400) > 0).astype(float)
    w = toxicity.fit(x, y, np.ones(400))
    assert (w[:-1] >= 0).all() and w[1] == 0 and w[0] > 1


def test_grams_and_signature():
    assert len(ngram_model.grams("abc")) == 4 and len(ngram_model.grams(None)) == 1
    assert ngram_model.symbols("A7\n猫\0")[3:].tolist() == [65, 48, 10, ord("猫"), 2, 1]
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    same = (similar.signature(a) == similar.signature(b)).mean()
    assert 0.65 < same < 0.97


def test_table():
    from tidekeep.llm.table import Table

    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(-(1 << 63), 1 << 63, 5000), np.arange(-200, 200)]))
    t = Table(keys, np.arange(len(keys)), -1)
    ask = np.concatenate([keys, rng.integers(-(1 << 63), 1 << 63, 5000), np.arange(300, 900)])
    known = {k: i for i, k in enumerate(keys.tolist())}
    assert t.get(ask).tolist() == [known.get(k, -1) for k in ask.tolist()]
    assert Table(keys[:0], keys[:0], -1).get(ask[:3]).tolist() == [-1] * 3


def test_crc_is_that_of_zlib():
    assert zlib.crc32(np.array([1, 2], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0\x02\0\0\0")
