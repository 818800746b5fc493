"""A quality classifier: interpolated modified Kneser-Ney over characters, trained on trusted text.

Symbols are code points: those of the basic plane as they are, so every script is told apart, digits as one symbol, and
those beyond it dealt to the 6,400 places of the private area.  Counts cover all trusted text: grams are counted by language
and gram (combined before the shuffle), continuation counts are made order by order, and each order's probabilities come
from joins of its sharded counts with those of its contexts and with the next lower order.  The model grows with the text.

Documents are scored against parts of the model that are sent one after another: a part holds some languages, or the grams
of order ORDER of one language whose contexts share a hash, SHARD of them at most.  A document is read once for each part of
its language (one, until that has more than SHARD grams), and the sums of its parts are added.

A document's perplexity is compared with a quantile of trusted documents' in its language, and of its length (by powers of
two) where that has ENOUGH of them, since short texts vary more.  One in FOLDS of the trusted documents, by crc32 of the id,
is kept out of the model for that: what a model was trained on suits it better than other good text does.

Languages with under LEAST trusted symbols, null ones too, use the model of all languages; with under FEW trusted documents
kept out, the quantile of all languages.

Defined cases: null and empty texts have one symbol, the end; texts of any length pass whole; null lang uses the model of
all languages; without trusted text every document is kept; repeated rows and ids are scored alike; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.common import rowed, sifted
from tidekeep.llm.table import Table
from tidekeep.sources.shared import stored

ORDER, BITS = 4, 16
#: Trusted symbols from which a language has a model of its own.
LEAST = 10_000
#: Grams of the highest order that are sent at once at most, and bytes of text that are scored at once.
SHARD, BYTES = 2_000_000, 1 << 21
#: The quantile of trusted perplexities, and trusted documents of a language, and of one of its lengths, that make one of their own.
QUANTILE, FEW, ENOUGH, FOLDS = 0.998, 100, 1000, 5
ALL = "*"
START, END = 0, 1
_PRIME = 1_000_003


def symbols(text: str | None) -> np.ndarray:
    """Symbols of the characters, after ORDER - 1 start symbols and before an end symbol."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    codes = np.where(codes > 0xFFFF, 0xE000 + codes % 6400, np.maximum(codes, END + 1))
    codes[(codes >= 48) & (codes <= 57)] = 48
    out = np.full(len(codes) + ORDER, START, np.int64)
    out[ORDER - 1 : -1] = codes
    out[-1] = END
    return out


def grams(text: str | None) -> np.ndarray:
    """The ORDER-grams of a text, BITS bits a symbol, one for each symbol that is predicted."""
    s = symbols(text)
    n = len(s) - ORDER + 1
    out = np.zeros(n, np.int64)
    for k in range(ORDER):
        out = out << BITS | s[k : k + n]
    return out


def pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some BYTES of text each, of one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()) // BYTES
    for at, n in zip(*np.unique(size, return_index=True, return_counts=True)[1:], strict=True):
        yield b.slice(int(at), int(n))


def count(docs: DataFrame) -> DataFrame:
    """lang, g, c: counts of the ORDER-grams of docs (lang, text), for each language and for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, 1):
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by.setdefault(ALL if lang is None else lang, []).append(grams(text))
                for lang, parts in by.items():
                    g, c = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(c.astype(np.int64))], ["lang", "g", "c"])

    each = docs.select("lang", "text").mapInArrow(run, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    each = stored(each, "grams")
    return each.union(each.where(F.col("lang") != ALL).select(F.lit(ALL).alias("lang"), "g", "c")).groupBy("lang", "g").agg(F.sum("c").alias("c"))


def discounts(level: DataFrame) -> DataFrame:
    """d1, d2, d3 of modified Kneser-Ney for each language, from the counts of counts."""
    n = level.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    fine = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    d = lambda k: F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(0.5))
    return n.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def _low(n: int):
    """The last n symbols of g."""
    return F.col("g").bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long"))


def levels(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 to ORDER: (lang, g, p) of the grams seen, and (lang, h, b) with the weight of the lower order after each context.

    Below order 1 a symbol has one part in the number of symbols seen, and one more for all others.
    """
    by_order = [counts]
    for n in range(ORDER - 1, 0, -1):
        by_order.insert(0, by_order[0].groupBy("lang", _low(n).alias("g")).agg(F.count("*").alias("c")))
    out: list[tuple[DataFrame, DataFrame]] = []
    for n, level in enumerate(by_order, 1):
        # a row for each language with a model
        level = stored(level.join(F.broadcast(discounts(level)), "lang"), f"level{n}")
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.withColumns({"h": F.shiftrightunsigned("g", BITS), "off": F.least(off, F.col("c"))})
        context = level.groupBy("lang", "h").agg(F.sum("c").alias("total"), F.sum("off").alias("free"), F.count("*").alias("kinds"))
        back = stored(context.select("lang", "h", (F.col("free") / F.col("total")).alias("b"), "total", "kinds"), f"back{n}")
        rows = level.join(back, ["lang", "h"])
        if n == 1:
            lower = 1 / (F.col("kinds") + 1)
        else:
            below = out[-1][0].select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
            rows = rows.withColumn("low", _low(n - 1)).join(below, ["lang", "low"])
            lower = F.col("q")
        p = (F.col("c") - F.col("off")) / F.col("total") + F.col("b") * lower
        out.append((stored(rows.select("lang", "g", p.alias("p")), f"p{n}"), back.select("lang", "h", "b", "kinds")))
    return out


class Scorer:
    """log2 probabilities of grams from one language's levels (g, p, h, b) and its number of symbols."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], kinds: int):
        log = lambda x: np.log2(np.maximum(x, 1e-300)).astype(np.float32)
        self.levels = [(Table(g, log(p), np.float32(1)), Table(h, log(b), np.float32(0))) for g, p, h, b in parts]
        self.least = np.float32(-np.log2(kinds + 1))

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """A gram that isn't seen has the weight of its context (1 where that isn't seen either) times the lower order's."""
        g, which = np.unique(g, return_inverse=True)
        out, left = np.zeros(len(g), np.float32), np.arange(len(g))
        for n in range(ORDER, 0, -1):
            seen, back = self.levels[n - 1]
            own = g[left] & ((1 << BITS * n) - 1) if n < ORDER else g[left]
            p = seen.get(own)
            known = p <= 0
            out[left[known]] += p[known]
            left = left[~known]
            out[left] += back.get((own[~known].view(np.uint64) >> np.uint64(BITS)).view(np.int64))
        out[left] += self.least
        return out[which]


class Model:
    """The levels of all languages, as tables in the shared folder."""

    def __init__(self, trusted: DataFrame):
        counts = stored(count(trusted), "counts")
        sizes = counts.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("grams")).where((F.col("n") >= LEAST) | (F.col("lang") == ALL))
        self.grams = {r.lang: r.grams for r in sizes.collect()}  # a row for LEAST trusted symbols at most
        chosen = sizes.select("lang")
        self.levels = levels(counts.join(chosen, "lang", "left_semi")) if self.grams else []

    def tasks(self, wanted: set[str], shard: int = SHARD) -> Iterator[tuple[list[str], int, int]]:
        """(languages, part, parts) of what is sent at once."""
        now, size = [], 0
        for lang in sorted(wanted & set(self.grams)):
            n = self.grams[lang]
            if n > shard:
                parts = -(-n // shard)
                yield from (([lang], k, parts) for k in range(parts))
                continue
            if size + n > shard:
                yield now, 0, 1
                now, size = [], 0
            now, size = [*now, lang], size + n
        if now:
            yield now, 0, 1

    def part(self, langs: list[str], k: int, parts: int) -> dict[str, tuple[list, int]]:
        out: dict[str, tuple[list, int]] = {lang: ([], 0) for lang in langs}
        for n, (seen, back) in enumerate(self.levels, 1):
            seen, back = (x.where(F.col("lang").isin(langs)) for x in (seen, back))
            if n == ORDER and parts > 1:
                seen, back = seen.where(F.shiftrightunsigned("g", BITS) % _PRIME % parts == k), back.where(F.col("h") % _PRIME % parts == k)
            s, b = seen.toPandas(), back.toPandas()
            for lang in langs:
                x, y = s[s["lang"] == lang], b[b["lang"] == lang]
                levels, kinds = out[lang]
                out[lang] = ([*levels, (x["g"].to_numpy(), x["p"].to_numpy(), y["h"].to_numpy(), y["b"].to_numpy())], int(y["kinds"].iloc[0]) if n == 1 else kinds)
        return out


def perplexities(docs: DataFrame, model: Model, shard: int = SHARD) -> DataFrame:
    """doc_id, lang, of (the model's language), n_symbols, perplexity for each symbol, of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = sorted(set(model.grams) - {ALL})
    of = F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit(ALL)) if own else F.lit(ALL)
    split = any(n > shard for n in model.grams.values())
    rows = (rowed(rows) if split else rows.withColumn("_row", F.lit(0).cast("long"))).withColumn("of", of).select("_row", "doc_id", "lang", "of", "text")
    wanted = {r.of for r in rows.select("of").distinct().collect()}  # languages with a model, and ALL
    schema = "_row long, doc_id long, lang string, of string, n long, bits double"

    def scored(langs: list[str], k: int, parts: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(model.part(langs, k, parts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorers: dict[str, Scorer] = {}
            for big in batches:
                for b in pieces(big, 4):
                    found = [None] * b.num_rows
                    langs_here = b.column(3).to_pylist()
                    texts = b.column(4).to_pylist()
                    for lang in set(langs_here):
                        if lang not in scorers:
                            scorers[lang] = Scorer(*shared.value[lang])
                        mine = [i for i, x in enumerate(langs_here) if x == lang]
                        each = [grams(texts[i]) for i in mine]
                        if parts > 1:
                            each = [g[(g.view(np.uint64) >> np.uint64(BITS)) % _PRIME % parts == k] for g in each]
                        ends = np.cumsum([len(g) for g in each])
                        sums = np.concatenate([[0.0], np.cumsum(scorers[lang](np.concatenate(each)), dtype=np.float64)])[[0, *ends]]
                        for i, g, bits in zip(mine, each, np.diff(sums), strict=True):
                            found[i] = (len(g), bits)
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], ["_row", "doc_id", "lang", "of", "n", "bits"])

        return rows.where(F.col("of").isin(langs)).mapInArrow(run, schema)

    out = None
    for langs, k, parts in model.tasks(wanted, shard):
        part = scored(langs, k, parts)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    if split:
        out = out.groupBy("_row").agg(*[F.first(c).alias(c) for c in ("doc_id", "lang", "of")], F.sum("n").alias("n"), F.sum("bits").alias("bits"))
    return out.select("doc_id", "lang", "of", F.col("n").alias("n_symbols"), F.pow(F.lit(2.0), -F.col("bits") / F.col("n")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, enough: int = ENOUGH) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, kept.  labels: doc_id and trusted (boolean)."""
    ids = stored(labels.where("trusted").select(F.col("doc_id").cast("long").alias("_id")).distinct(), "trusted")
    maybe, _ = sifted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text"), "doc_id", ids)
    known = maybe.join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    apart = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    model = Model(known.where(~apart))
    if not model.grams:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.lit(0).cast("long").alias("n_symbols"), F.lit(0.0).alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    rows = stored(perplexities(docs, model).withColumn("band", F.floor(F.log2("n_symbols")).cast("int")), "perplexities")
    trusted = rows.join(ids.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi")
    if not trusted.where(apart).isEmpty():
        trusted = trusted.where(apart)
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    # a row for each language with a model, and for each of its lengths; and one for all
    bands = trusted.groupBy("of", "band").agg(limit.alias("narrow"), F.count("*").alias("n")).where(F.col("n") >= enough).drop("n")
    langs = trusted.groupBy("of").agg(limit.alias("wide"), F.count("*").alias("n")).where(F.col("n") >= FEW).drop("n")
    overall = trusted.agg(limit.alias("t")).first().t
    out = rows.join(F.broadcast(bands), ["of", "band"], "left").join(F.broadcast(langs), "of", "left")
    out = out.withColumn("threshold", F.coalesce("narrow", "wide", F.lit(overall)))
    return out.select("doc_id", "lang", "n_symbols", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), (F.col("perplexity") <= F.col("threshold")).alias("kept"))
