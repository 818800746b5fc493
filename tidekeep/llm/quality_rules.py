"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

measure() adds the measurements, ledger() the failure bits, apply_policy() the verdict of a versioned policy, and
ablation() what each rule of a policy costs, from the bits alone.  All of it is DataFrame functions.

Defined cases: null text counts as no words; an empty text has n_words 0 and fails `few_words`; repeated rows are
measured alike; an empty table gives an empty table.  Columns of the input that carry a name of MEASURES are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekeep.llm.common import WORD

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts", "n_upper")
TEMPORARY = ("_words", "_lines", "_each", "_hashes", "_low", "_packed")
#: Words in a window of which repeats are counted.
WINDOW = 5


def _repeat_words() -> Column:
    """Words that lie in a window whose hash occurs twice or more: the length of the union of those windows.

    _packed holds, sorted, each window's hash with its index in the low bits (as many as the indexes need), so that
    equal windows are neighbours; the whole hashes are then compared.  _low masks the index.
    """
    packed, hashes, low = F.col("_packed"), F.col("_hashes"), F.col("_low")
    full = lambda x: F.get(hashes, x.bitwiseAND(low).cast("int"))
    same = lambda x, j: F.coalesce(full(x) == full(F.get(packed, j)), F.lit(False))
    found = F.filter(packed, lambda x, j: same(x, j - 1) | same(x, j + 1))
    places = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(low)))
    start = F.struct(F.lit(-WINDOW).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(WINDOW).cast("long"), x - a["p"])).alias("n"))
    return F.aggregate(places, start, step)["n"]


def _held(value: Column) -> Column:
    """The value behind an expression that the optimizer doesn't move.

    Else a filter on a verdict is pushed below the measurements, each use of which repeats the whole expression: the
    plan then grows to a size at which planning doesn't end.
    """
    return value + F.spark_partition_id() * 0


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and MEASURES, all long.  Characters are code points; lines are split at newline, and count with a word."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.drop(*MEASURES, *TEMPORARY)
    out = out.withColumns({"_words": F.regexp_extract_all(body, F.lit(WORD), F.lit(0)), "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))})
    n = F.size("_words")
    w = F.col("_words")
    out = out.withColumn("_each", F.transform(w, lambda x: F.xxhash64(x)))
    e = F.col("_each")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(e, i + k) for k in range(WINDOW)])))
    out = out.withColumn("_hashes", hashes)
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_low", F.when(again, F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long") - 1))
    pack = F.sort_array(F.transform("_hashes", lambda h, i: h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_packed", F.when(F.col("_low").isNotNull(), pack))
    repeats = F.when(F.col("_low").isNotNull(), _repeat_words()).otherwise(0)
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _held(repeats.cast("long")),
            "n_shouts": F.regexp_count(body, F.lit("!!")).cast("long"),
            "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
        }
    ).drop(*TEMPORARY)


#: Rules in bit order; new rules go to the end, so that stored ledgers stay valid.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeats", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_shouts > 10 * n_words"),
    ("upper_case", "100 * n_upper > 50 * word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "dup_lines", "shouting", "upper_case", "short_words", "long_words"),
}


def mask(rules: Iterable[str]) -> int:
    return sum(1 << BIT[r] for r in set(rules))


def ledger(measured: DataFrame, column: str = "failures") -> DataFrame:
    """Adds the failure bits, one for each of RULES; a rule that is null on a row doesn't fail it."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn(column, total.cast("long"))


def passes(policy: str, column: str = "failures") -> Column:
    return F.col(column).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds base_failed and kept, from the bits alone."""
    return rows.withColumns({"base_failed": ~passes("base"), "kept": passes("base") & passes(policy)})


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows that only it rejects (kept again without it).

    The ledger is first reduced to a count for each bit pattern (at most 2 ** len(RULES) of them).
    """
    chosen = F.lit(mask(POLICIES[policy]))
    counts = rows.groupBy(F.col("failures").bitwiseAND(chosen).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = counts.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone")
    )


def quality_rules(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """docs with measurements, failure bits and the policy's verdict."""
    return apply_policy(ledger(measure(docs, text)), policy)


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"]
