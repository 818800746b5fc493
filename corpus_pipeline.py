"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet into the
shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekeep.llm import line_dedup, mixing, packing, quality_rules, similar
from tidekeep.llm.common import WORD, read, rowed, sifted
from tidekeep.llm.queries import tokenizer
from tidekeep.sources.shared import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Most passes over a source in the mix.
PASSES = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps.

    Null and empty texts have no words and go; rows are judged one by one, so null and repeated ids stay as they are; further
    columns are left out; an empty table gives an empty table.
    """
    return quality_rules.quality_rules(docs).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of which no word is left goes.

    Rows are told apart by a key of their own, so a row without an id, or with that of another, loses only its own repeats.
    Of repeated rows the first by (doc_id, place) stays, null ids come last; texts without a word go; n_chars is counted anew;
    an empty table gives an empty table.
    """
    rows = rowed(docs)
    out = line_dedup.without_repeats(rows, line_dedup.classes(rows, key="_row"), key="_row")
    return out.where(F.col("text").rlike(WORD)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Rows are told apart by a key of their own: null ids come last, and of rows with the same least id one is kept, whatever
    texts they hold; rows outside a group all stay.  Texts without words are copies of each other; an empty table gives an
    empty table.
    """
    rows = rowed(docs)
    groups = similar.near_copies(rows, shingle=5, similarity=0.8, key="_row")
    gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "gone")
    maybe, others = sifted(rows, "_row", gone)
    return maybe.join(gone.hint("merge"), F.col("_row") == F.col("_gone"), "left_anti").unionByName(others).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; sources with few tokens again, as far as the weights and PASSES let them.

    A null source is a source of its own, a null text has no tokens; rows of one id (null ids too) go together; an empty table
    gives an empty table.
    """
    planned = mixing.plan(docs, min_entropy=0.95, max_passes=PASSES)
    return mixing.mix(docs, planned).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of whole documents and pieces, as packing defines them: each row is packed on its own, whatever its id."""
    return packing.packing(docs, tokenizer())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL can't express the tokenizer and the packing; tests/llm/test_pipeline.py tests the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
