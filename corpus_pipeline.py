"""A training corpus from documents: five stages, each on all that the one before has kept.

quality classifier, line dedup, MinHash near-dedup, benchmark decontamination, mixing. All but
the last return the columns of documents; the last has a row for each copy that the mix takes.
Rows are judged one by one, whatever their ids; ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.common import discard, table, without, written
from factlake.llm.decontaminate import contamination
from factlake.llm.linededup import deduplicate_lines
from factlake.llm.minhash import near_documents
from factlake.llm.mixing import mix
from factlake.llm.quality import quality_scores

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = tuple(COLUMNS[1:])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; labels are learned from those not held out."""
    scores = quality_scores(docs, table(spark, sf_dir, "labels"), carry=CARRY)
    return scores.where("predicted = 1").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that other documents repeat; n_chars is that of the new text."""
    kept = deduplicate_lines(docs, carry=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the smallest id, a null id only where no row has one.

    Rows without words are in no group; of those with the same id and text one is kept.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = near_documents(rows, id_col="row")
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    repeat = F.when(wordless & F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*CARRY).alias("h"), "row")
    ranked = rows.select("row", repeat.alias("repeat"), first.alias("first"))
    group = F.struct(F.col("repeat").isNotNull().alias("is_repeat"), F.coalesce("repeat", "component_id").alias("of"))
    members = written(ranked.join(found, "row").select("row", "first", group.alias("group")))
    discard(found)
    kept = members.groupBy("group").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1").select("group", F.col("least.row").alias("kept"))
    gone = members.join(kept, "group").where("row <> kept").select("row")
    return without(rows, gone, "row").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), carry=CARRY)
    return found.where("NOT contaminated").select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, numbered from 1."""
    mixed = mix(docs, carry=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The quality classifier's fit can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
