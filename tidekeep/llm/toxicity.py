"""Toxicity by a lexicon that is mined from labels, matched by Levenshtein automata over its tries.

learn() takes words and word stems that labelled toxic documents hold far more often than clean ones, each with a severity,
and fits a logistic regression without negative weights.  score() matches every token of a text against all entries.  An
entry of WORD letters or more may be one edit away, one of LONG two; stems (which any ending may follow) are exact.

Matching: an entry is cut into errors + 1 segments, one of which any such edits leave intact, and stands in one small trie
for each (its length, the segment's number and characters).  A token's automaton (a bit-parallel one: a machine word of
reached places for each number of errors) is intersected with the tries of its own substrings only, so the cost hardly
depends on the lexicon's size; Lexicon.errors() walks the trie of all entries, for comparison.

A hit counts its entry's severity, times DISCOUNT for each error, times what its context leaves: quotation() scores a window
of tokens around it from 0 (abuse) to nearly 1 (quoted).  All features grow with what hits count and no weight is negative,
so a misspelled insult scores above clean text, and a quoted one below the same unquoted.  A token that CLEAN clean
documents of the sample hold is a word of its own, not a misspelling; an entry of which CLEAN clean documents hold what
seem other misspellings lies too near to common words, and is matched without errors.

Labels are learned from a bounded sample of SAMPLE toxic and as many clean documents, by hash order; all documents are
scored, over their whole texts.

Defined cases: null and empty texts have no hits and get the score of the intercept; without labels of both kinds every
score is the share of toxic labels (0 without labels); repeated rows and ids are scored alike; texts of any length pass
whole; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.line_dedup import segments
from tidekeep.sources.shared import stored

#: Labelled documents of each kind that are learned from.
SAMPLE = 20_000
#: Least toxic documents with an entry, and least odds against clean ones; the lexicon has no further bound.
LEAST, ODDS = 5, 20.0
#: Clean documents of the sample that make a token a word of its own, and an entry one without errors.
CLEAN = 2
#: Letters from which an entry may have one error, and two; what a hit keeps for each error.
WORD, LONG, DISCOUNT = 5, 9, 0.6
STEM = range(4, 9)
#: Tokens around a hit that are its context; tokens that a worker keeps, and their longest.
WINDOW, KEPT, KEPT_LENGTH = 6, 400_000, 40
#: What marks around a hit, a word of reporting before it, and someone addressed near it change.
MARKED, REPORTED, ADDRESSED = 0.7, 0.6, 0.5
QUOTES = re.compile("[\"“”„«»‹›]")
REPORTING = frozenset("said says called calling quote quoted wrote word term dit appelé mot cite sagte nannte wort zitat dijo llamó palabra cita".split())
ADDRESS = frozenset("you your du dich dein ihr tu toi vous votre tú ti usted".split())
_EDGE = re.compile(r"^\W+|\W+$")
FEATURES = 3

#: An entry: its text, whether it is a stem, its severity (over 0, 1 at most).
Entry = tuple[str, bool, float]


def allowed(letters: int) -> int:
    """Errors that a word of so many letters may have."""
    return 0 if letters < WORD else 1 if letters < LONG else 2


def accepted(trie: dict, token: str, errors: int) -> Iterator[tuple[float, str, int]]:
    """(severity, text, errors) of the entries of a trie that the token's Levenshtein automaton accepts.

    A state has, for each number of errors, the places of the token that are reached, as bits.
    """
    size = len(token)
    at: dict[str, int] = {}
    for j, c in enumerate(token):
        at[c] = at.get(c, 0) | 1 << j
    stack = [(trie, tuple((1 << e + 1) - 1 for e in range(errors + 1)))]
    while stack:
        node, state = stack.pop()
        if "" in node:
            for e, bits in enumerate(state):
                if bits >> size & 1:
                    yield *node[""], e
                    break
        for c, child in node.items():
            if c == "":
                continue
            same = at.get(c, 0)
            after = [(state[0] & same) << 1]
            for e in range(1, errors + 1):
                after.append((state[e] & same) << 1 | state[e - 1] | state[e - 1] << 1 | after[e - 1] << 1)
            if any(after):
                stack.append((child, tuple(after)))


def _insert(trie: dict, text: str, severity: float) -> None:
    for c in text:
        trie = trie.setdefault(c, {})
    trie[""] = (severity, text)


class Lexicon:
    """Entries, as tables of exact forms and as tries of what may be misspelled.

    own: tokens that are no misspellings; strict: entries that are matched without errors.
    """

    def __init__(self, entries: list[Entry], own: frozenset[str] = frozenset(), strict: frozenset[str] = frozenset()):
        self.entries, self.own, self.strict = entries, own, strict
        self.words = {text: severity for text, stem, severity in entries if not stem}
        self.stems = {text: severity for text, stem, severity in entries if stem}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        #: Tries by (length, segment, its characters), and the errors by length.
        self.tries: dict[tuple[int, int, str], dict] = {}
        self.sizes: dict[int, int] = {}
        self.cuts: dict[int, list[tuple[int, int]]] = {}
        for text, severity in self.words.items():
            if errors := self.allowed(text):
                self.sizes[len(text)] = errors
                self.cuts[len(text)] = list(segments(len(text), errors))
                for i, (at, n) in enumerate(self.cuts[len(text)]):
                    _insert(self.tries.setdefault((len(text), i, text[at : at + n]), {}), text, severity)
        #: What is found for tokens, and for runs of characters that have such a token within.
        self.tokens: dict[str, tuple[float, int, str]] = {}
        self.known: dict[str, tuple[float, int, str]] = {}

    def allowed(self, text: str) -> int:
        return 0 if text in self.strict else allowed(len(text))

    @cached_property
    def whole(self) -> dict[int, dict]:
        """A trie of all words for each number of errors that they may have."""
        out: dict[int, dict] = {0: {}, 1: {}, 2: {}}
        for text, severity in self.words.items():
            _insert(out[self.allowed(text)], text, severity)
        return out

    def _exact(self, token: str) -> float:
        """Severity of the entry that is the token or a stem of it, 0 if there is none."""
        return max(self.words.get(token, 0.0), *(self.stems.get(token[:n], 0.0) for n in self.stem_sizes if n <= len(token)), 0.0)

    def errors(self, token: str) -> int:
        """Fewest errors with which some entry accepts the token, -1 if none does, by walks of the whole tries."""
        if self._exact(token):
            return 0
        return min((e for errors, trie in self.whole.items() for *_, e in accepted(trie, token, errors)), default=-1)

    def of(self, chunk: str) -> tuple[float, int, str]:
        """(what a hit counts, its errors, the entry) of a run of non-space characters, without the punctuation at its ends; (0, -1, ""): no hit."""
        token = _EDGE.sub("", chunk)
        if len(token) > KEPT_LENGTH:
            return self._of(token)
        if len(self.tokens) > KEPT:
            self.tokens.clear()
        found = self.tokens.get(token)
        if found is None:
            found = self.tokens[token] = self._of(token)
        return found

    def _of(self, token: str) -> tuple[float, int, str]:
        """What of() says of a token.

        With at most e errors some segment i of an entry is intact after i errors at most, and before e - i at most.
        """
        size = len(token)
        if severity := self._exact(token):
            return severity, 0, token
        best, tried = (0.0, -1, ""), set()
        if token in self.own:
            return best
        for other in range(size - 2, size + 3):
            errors, shift = self.sizes.get(other, 0), size - other
            if abs(shift) > errors or not errors:
                continue
            for i, (at, n) in enumerate(self.cuts[other]):
                for p in range(max(0, at - i, at + shift - (errors - i)), min(size - n, at + i, at + shift + (errors - i)) + 1):
                    key = (other, i, token[p : p + n])
                    if key in self.tries and key not in tried:
                        tried.add(key)
                        for severity, text, e in accepted(self.tries[key], token, errors):
                            best = max(best, (severity * DISCOUNT**e, e, text))
        return best

    def hits(self, words: list[str]) -> list[tuple[int, float, int, str]]:
        """(place, what it counts, errors, entry) of the hits among words."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        # long runs aren't kept, so what a worker keeps is bounded in bytes too
        long = {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= KEPT_LENGTH else long)[w] = self.of(w)
        return [(i, *found) for i, w in enumerate(words) if (found := known.get(w) or long[w])[0] > 0]


#: The lexicon that this worker used last, by its digest: tasks of one query share it, and the tokens it has matched.
_LAST: dict[str, Lexicon] = {}


def shared(entries: list[Entry], own: frozenset[str], strict: frozenset[str]) -> Callable[[], Lexicon]:
    """A function that gives a worker its lexicon, made once for each worker."""
    digest = hashlib.sha256(repr((entries, sorted(own), sorted(strict))).encode()).hexdigest()

    def get() -> Lexicon:
        if digest not in _LAST:
            _LAST.clear()
            _LAST[digest] = Lexicon(entries, own, strict)
        return _LAST[digest]

    return get


def quotation(words: list[str], at: int) -> float:
    """How far the window around a hit quotes it, from 0 to nearly 1: marks on both sides and words of reporting before it, the
    nearer the more; half as much where someone is addressed."""
    half = len(words[at]) // 2 + 1
    near = lambda d: 1 - d / (WINDOW + 1)
    left = list(enumerate(reversed(words[max(0, at - WINDOW) : at]), 1))
    right = list(enumerate(words[at + 1 : at + 1 + WINDOW], 1))
    before = max([near(d) for d, w in left if QUOTES.search(w)] + [1.0 if QUOTES.search(words[at][:half]) else 0.0])
    after = max([near(d) for d, w in right if QUOTES.search(w)] + [1.0 if QUOTES.search(words[at][half:]) else 0.0])
    told = max([near(d) for d, w in left if _EDGE.sub("", w) in REPORTING], default=0.0)
    out = 1 - (1 - MARKED * min(before, after)) * (1 - REPORTED * told)
    return out * (1 - ADDRESSED) if any(_EDGE.sub("", w) in ADDRESS for _, w in left + right) else out


def features(lexicon: Lexicon, text: str | None) -> tuple[list[float], int, int]:
    """What the hits count (all together, the most, for each word), how many they are, and how many of them are misspelled."""
    words = (text or "").lower().split()
    found = lexicon.hits(words)
    counts = [value * (1 - quotation(words, at)) for at, value, *_ in found]
    total = sum(counts)
    return [float(np.log1p(total)), max(counts, default=0.0), 10.0 * total / max(20, len(words))], len(found), sum(e > 0 for _, _, e, _ in found)


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and toxic of at most `most` documents of each kind, by hash order."""
    fine = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    kinds = [fine.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (1, 0)]
    return stored(kinds[0].union(kinds[1]), "toxic-sample")


def mined(train: DataFrame, toxic: int, clean: int) -> list[Entry]:
    """Entries from rows (text, toxic): whole words, or stems where many words share one; severity grows with the odds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile(r"[^\W\d_]+").findall
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[k].update(set(found((t or "").lower())))
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    words = train.select("text", "toxic").mapInArrow(count, "word string, toxic long, clean long").where(F.length("word").between(3, 60)).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    forms = F.array(F.concat("word", F.lit("$")), *[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEM])
    stems = words.select(F.explode(forms).alias("form"), "word", "toxic", "clean").where("form is not null")
    each = stems.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max(F.struct("toxic", "word")).alias("top"))
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    # odds of ODDS make a severity of a half, ten times as many nearly all of it
    good = each.withColumn("odds", odds).where((F.col("toxic") >= LEAST) & (F.col("odds") >= ODDS)).orderBy(F.desc("toxic"), "form")
    found = good.collect()  # of the bounded sample
    counts = {r.form: (r.toxic, r.top.toxic, r.top.word) for r in found}
    severity = {r.form: float(r.odds / (r.odds + ODDS)) for r in found}
    under: dict[str, list[str]] = {}
    for form in counts:
        if not form.endswith("$"):
            for n in range(1, len(form) + 1):
                under.setdefault(form[:n], []).append(form)
    out: dict[tuple[str, bool], None] = {}
    stemmed = lambda form: any((form[:n], True) in out for n in STEM)
    for form in sorted(counts, key=lambda f: (len(f), f)):
        if form.endswith("$") or stemmed(form):
            continue
        number, most, word = counts[form]
        if most >= 0.8 * number:
            continue  # one word makes the stem: it counts as a whole word
        longer = [f for f in under[form] if counts[f][0] >= 0.95 * number]
        out[(max(longer, key=len), True)] = None
    for form in counts:
        if form.endswith("$") and not stemmed(form):
            out[(form[:-1], False)] = None
    return [(text, stem, severity[text if stem else f"{text}$"]) for text, stem in out]


def _newton(x: np.ndarray, y: np.ndarray, k: np.ndarray, ridge: float, rounds: int) -> np.ndarray:
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (k * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (k * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, k: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, none of them negative, and intercept of a ridge logistic regression of rows that count k times, by Newton's method.

    Features whose weight comes out negative are left out and the others fitted again.
    """
    kept = list(range(x.shape[1]))
    while True:
        found = _newton(np.hstack([x[:, kept], np.ones((len(x), 1))]), y, k, ridge, rounds)
        if (found[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[[*kept, -1]] = found
            return out
        kept = [f for f, w in zip(kept, found, strict=False) if w >= 0]


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights from documents and labels (doc_id, toxic)."""
    ids = sample(labels, most)
    n = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        p = min(max(toxic / max(1, toxic + clean), 1e-9), 1 - 1e-9)
        return Lexicon([]), np.array([0.0] * FEATURES + [np.log(p / (1 - p))])
    # the sample is bounded: 2 * most rows of two numbers
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = stored(picked.join(F.broadcast(ids), "doc_id").select("text", "toxic"), "toxic-texts")
    entries = mined(train, toxic, clean)

    plain = shared(entries, frozenset(), frozenset())

    def misspelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = plain()
        for b in batches:
            found: Counter = Counter()
            for t in b.column(0).to_pylist():
                words = (t or "").lower().split()
                found.update({(_EDGE.sub("", words[at]), entry) for at, _, errors, entry in lexicon.hits(words) if errors > 0})
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "entry", "n"])

    near = train.where("toxic = 0").select("text").mapInArrow(misspelled, "token string, entry string, n long").groupBy("token", "entry").agg(F.sum("n").alias("n"))
    tokens, others = Counter(), Counter()
    pairs = near.collect()  # of the bounded sample
    for r in pairs:
        tokens[r.token] += r.n
    for r in pairs:
        others[r.entry] += r.n if tokens[r.token] < CLEAN else 0
    own = frozenset(t for t, n in tokens.items() if n >= CLEAN)
    strict = frozenset(e for e, n in others.items() if n >= CLEAN)

    full = shared(entries, own, strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = full()
        for b in batches:
            rows = [features(lexicon, t)[0] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    # at most 2 * most rows, equal ones counted
    seen = train.mapInArrow(run, "toxic int, x array<double>").groupBy("toxic", "x").count().collect()
    x, y, k = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float), np.array([r["count"] for r in seen], float)
    return Lexicon(entries, own, strict), fit(x, y, k)


def score(docs: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> DataFrame:
    """doc_id, score, predicted, hits and misspelled (hits with errors) of every row."""
    full = shared(lexicon.entries, lexicon.own, lexicon.strict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = full()
        for b in batches:
            found = [features(lexicon, t) for t in b.column(1).to_pylist()]
            x = np.array([f for f, _, _ in found]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -500, 500)))
            counts = [pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *counts], ["doc_id", "score", "predicted", "hits", "misspelled"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, hits long, misspelled long")
