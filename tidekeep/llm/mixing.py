"""Mixing sources to target weights by temperature, in DataFrame functions alone.

A source with share p of the tokens gets a weight in proportion to p ** exponent.  The exponent is bisected on a grid of
GRID steps (64 parts at a time, two small jobs) for a least entropy, a most repetition, or both.  Weights become token
quotas of a budget; a source's quota is met by whole passes over its rows and the start of one further pass in the order
of a permutation.  Positions in the passes are cut into blocks, so each block has all sources in proportion.

Nothing is shuffled but counts: the permutation is a bijective hash of doc_id, and where the last pass stops is found in
two levels (tokens for each source and hash bucket, then the rows of the one bucket), so no source is gathered in one
task, however many rows it has.

Defined cases: rows with null source form a source of their own; null or empty texts have no tokens and follow their
source's passes; a source without tokens passes once; rows of one doc_id (null ids too) go together, each counted; with
one source the exponent is 1 under an entropy target; an empty table gives an empty table.  Columns mix_epoch, mix_block
and mix_order of the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekeep.llm.common import WORD
from tidekeep.sources.shared import stored

GRID, SECTIONS = 4096, 64
#: Bits of the permutation hash, and those of a bucket.
BITS, BUCKET = 31, 12
M = (1 << BITS) - 1
NONE = "\x00null"


def permuted(key: Column, salt: Column | int = 0) -> Column:
    """A bijective mix of the low 31 bits of key (with its high bits folded in); the same in any SQL with 64-bit integers."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    k = F.coalesce(key.cast("long"), F.lit(-1))
    x = k.bitwiseXOR(F.shiftright(k, BITS)).bitwiseAND(F.lit(M).cast("long"))
    x = (x + salt * 40503).bitwiseAND(F.lit(M).cast("long"))
    for multiplier, shift in ((1103515245, 15), (739982445, 12), (695872825, 15)):
        x = (x * F.lit(multiplier).cast("long")).bitwiseAND(F.lit(M).cast("long"))
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def _tried(shares: DataFrame, low: int, step: int, budget: int | None) -> list:
    """Entropy and largest repetition at the exponents low, low + step, ... in order; repetition as a multiple of the least."""
    at = shares.select("p", "total", F.explode(F.sequence(F.lit(low), F.lit(low + SECTIONS * step), F.lit(step))).alias("g"))
    at = at.withColumn("u", F.pow("p", F.col("g") / GRID))
    # q = u / sum(u); with a budget a source passes q * budget / (p * total) times, else passes are counted from the least
    sums = at.groupBy("g").agg(
        F.sum("u").alias("z"), F.sum(F.when(F.col("u") > 0, F.col("u") * F.log("u")).otherwise(0.0)).alias("e"), F.max(F.col("u") / F.col("p")).alias("most"), F.min(F.col("u") / F.col("p")).alias("least"), F.first("total").alias("total")
    )
    passes = F.col("most") / F.col("least") if budget is None else F.col("most") / F.col("z") * budget / F.col("total")
    return sums.select("g", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), passes.alias("passes")).orderBy("g").collect()


def exponent(shares: DataFrame, min_entropy: float | None, max_passes: float | None, budget: int | None = None) -> int:
    """The exponent, in steps of 1 / GRID: the largest that keeps the entropy, but not below the least within max_passes.

    Both bounds are monotone in the exponent.  min_entropy is a share of the greatest possible entropy.
    """
    n = shares.count()
    if n < 2:
        return GRID
    import math

    def bisect(ok, largest: bool) -> int:
        low, step = 0, GRID // SECTIONS
        while True:
            good = [r.g for r in _tried(shares, low, step, budget) if r.g <= GRID and ok(r)]
            if not good:
                return 0 if largest else GRID
            best = max(good) if largest else min(good)
            if step == 1:
                return best
            low, step = (best, step // SECTIONS) if largest else (max(0, best - step), step // SECTIONS)

    out = GRID
    if min_entropy is not None:
        out = bisect(lambda r: r.entropy >= min_entropy * math.log(n), True)
    if max_passes is not None:
        least = bisect(lambda r: r.passes <= max_passes, False)
        out = least if min_entropy is None else max(out, least)
    return out


def plan(docs: DataFrame, min_entropy: float | None = 0.95, max_passes: float | None = 4.0, budget: int | None = None, key: str = "doc_id", source: str = "source", text: str = "text", budget_percent: int | None = None) -> DataFrame:
    """One row per source: mix_source, tokens, weight, quota, passes (whole ones) and last (the last pass takes rows up to this hash).

    The budget is a number of tokens, or a percentage of the tokens there are.  Without one it is the smallest that drops
    nothing: the source with the fewest passes passes once.
    """
    rows = docs.select(F.coalesce(F.col(source).cast("string"), F.lit(NONE)).alias("mix_source"), permuted(F.col(key)).alias("perm"), tokens(text).alias("tokens"))
    rows = stored(rows.withColumn("bucket", F.shiftright("perm", BITS - BUCKET)), "mix-rows")
    buckets = stored(rows.groupBy("mix_source", "bucket").agg(F.sum("tokens").alias("tokens")), "mix-buckets")
    sources = stored(buckets.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if budget_percent is not None:
        budget = total * budget_percent // 100
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("p"), F.lit(float(total)).alias("total"))
    g = exponent(shares, min_entropy, max_passes, budget)
    u = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(g / GRID))).otherwise(0.0)
    z = sources.select(F.sum(u).alias("z"), F.max(F.when(u > 0, F.col("tokens") / u)).alias("per")).first()
    # a quota is weight * budget; without a budget, u times the most tokens for each unit of u
    scale = (z.per or 0.0) if budget is None else budget / (z.z or 1.0)
    quota = F.round(u * F.lit(float(scale))).cast("long")
    out = sources.select("mix_source", "tokens", (u / F.lit(float(z.z or 1.0))).alias("weight"), quota.alias("quota"))
    out = out.withColumns({"passes": F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("long"), "rest": F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).cast("long")})
    # first level: at most 2 ** BUCKET rows of a source in a window
    sums = buckets.join(out.select("mix_source", "rest"), "mix_source").withColumn("cum", F.sum("tokens").over(Window.partitionBy("mix_source").orderBy("bucket")))
    edge = sums.where(F.col("cum") > F.col("rest")).groupBy("mix_source").agg(F.min(F.struct("bucket", (F.col("cum") - F.col("tokens")).alias("before"), "rest")).alias("x")).select("mix_source", "x.*")
    # second level: the rows of that bucket; equal hashes go together
    inside = rows.join(edge, ["mix_source", "bucket"]).withColumn("cum", F.sum("tokens").over(Window.partitionBy("mix_source").orderBy("perm")))
    last = inside.groupBy("mix_source").agg(F.max(F.when(F.col("before") + F.col("cum") <= F.col("rest"), F.col("perm"))).alias("within"))
    at = edge.join(last, "mix_source", "left").select("mix_source", F.when(F.col("rest") > 0, F.coalesce("within", F.shiftleft(F.col("bucket"), BITS - BUCKET) - 1)).otherwise(-1).cast("long").alias("last"))
    return stored(out.join(at, "mix_source", "left").select("mix_source", "tokens", F.lit(g).alias("exponent"), "weight", "quota", "passes", F.coalesce("last", F.lit(-1)).cast("long").alias("last")), "mix-plan")


def mix(docs: DataFrame, planned: DataFrame, block_tokens: int = 1 << 20, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Every copy of every row that the plan takes, with mix_epoch, mix_block and mix_order (the order inside a block)."""
    blocks = max(1, -(-(planned.agg(F.sum("quota")).first()[0] or 0) // block_tokens))
    own = planned.select(F.col("mix_source").alias("_of"), F.col("passes").alias("_passes"), F.col("last").alias("_last"), F.col("tokens").alias("_tokens"), F.col("quota").alias("_quota"))
    rows = docs.drop("mix_epoch", "mix_block", "mix_order").withColumns({"_source": F.coalesce(F.col(source).cast("string"), F.lit(NONE)), "_perm": permuted(F.col(key))})
    rows = rows.join(own, F.col("_source") == F.col("_of"))
    copies = F.col("_passes") + F.when(F.col("_perm") <= F.col("_last"), 1).otherwise(0)
    rows = rows.where(copies > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    share = (F.col("mix_epoch") + F.col("_perm") / F.lit(float(1 << BITS))) * F.col("_tokens") / F.greatest(F.col("_quota"), F.lit(1))
    block = F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("long")
    order = permuted(F.col(key), F.col("mix_epoch") + 1)
    return rows.withColumns({"mix_block": block, "mix_order": order}).drop("_source", "_perm", "_of", "_passes", "_last", "_tokens", "_quota")
