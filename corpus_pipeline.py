"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame, written and read again between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, language_id, line_dedup, mixing, simhash
from lexweave.llm.common import Workspace, own_columns, small


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: no letters, or a margin under MIN_MARGIN. Dictionaries are of the stage's own documents."""
    held, back = own_columns(docs)
    at = {c: f"own{i}_" for i, c in enumerate(docs.columns)}
    found = language_id.identify(docs.select(*held), id_col=at["doc_id"], text_col=at["text"], lang_col=at["lang"], keep_text=True)
    return found.where("not rejected").select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts. A document that loses all its text so goes; one that came without text stays. n_chars follows
    the text where it changes."""
    found = line_dedup.dedup(docs).where("n_dropped = 0 or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def _digest():
    """16 bytes that stand for the text (null for null), so that rows are told apart where ids repeat or are null."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, null ids last, then by a digest of the text (of rows that repeat
    id and text any one). Rows of other groups stay, whatever their ids. Groups are linked by a similarity of 0.8 or more of their
    shingles of five words (see simhash.similar_groups)."""
    work = Workspace(spark, "pipeline-simhash")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), _digest().alias("digest"))
    found = simhash.similar_groups(docs.select(row.alias("row"), "text"), id_col="row")
    groups = work.table(found.select(F.col("row.id").alias("_id"), F.col("row.digest").alias("_digest"), (~F.col("row").eqNullSafe(F.col("component_id"))).alias("copy")), "groups")
    gone = work.table(groups.where("copy").select("_id", "_digest").distinct(), "gone")
    held, back = own_columns(docs)
    keyed = docs.select(*held, F.col("doc_id").alias("id"), _digest().alias("k"))
    kept = keyed.join(small(gone), keyed["id"].eqNullSafe(gone["_id"]) & keyed["k"].eqNullSafe(gone["_digest"]), "left_anti")
    twice = groups.groupBy("_id", "_digest").agg(F.count("*").alias("n")).where("n > 1")
    return (kept if twice.isEmpty() else kept.dropDuplicates(["id", "k"])).select(*back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go; other rows stay, whatever their ids."""
    work = Workspace(spark, "pipeline-benchmark")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = docs.select(_digest().alias("doc_id"), "text")
    found = decontaminate.contamination(keyed, benchmark).where("contaminated").select(F.col("doc_id").alias("_digest")).distinct()
    gone = work.table(found, "gone")
    held, back = own_columns(docs)
    own = docs.select(*held, _digest().alias("k"))
    return own.join(small(gone), own["k"] == gone["_digest"], "left_anti").select(*back)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the sources' budgets, with epochs and part_tokens (see mixing.mix)."""
    return mixing.mix(docs, full=True)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
]

#: Compression, MinHash and XXH64 with a seed have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
