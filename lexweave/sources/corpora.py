"""Readers and writers: CoNLL-U lines, tagged tokens, passages, model tables and reports."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def conllu_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of CoNLL-U files; each file's lines are numbered where they are read."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def conllu_tokens(lines: DataFrame, exact: bool = True) -> DataFrame:
    """(file, sent_id, id, word, pos, feats, head, deprel): sentences are parted by blank lines; comments and ids with '-' or '.' are
    skipped; ``exact`` wants 10 columns (dependency reading), else 6 or more do (tagging)."""
    line = F.trim("line") if exact else F.col("line")
    w = Window.partitionBy("file").orderBy("line_no")
    d = lines.withColumn("sent_id", F.sum((F.trim("line") == "").cast("int")).over(w)).withColumn("c", F.split(line, "\t"))
    d = d.where((F.size("c") == 10) if exact else (F.size("c") >= 6)).where(~F.col("line").startswith("#")).where(~F.col("c")[0].rlike("[-.]"))
    get = lambda i: F.get("c", F.lit(i))
    return d.select("file", "sent_id", get(0).cast("int").alias("id"), get(1).alias("word"), get(3).alias("pos"), get(5).alias("feats"), F.expr("try_cast(get(c, 6) as int)").alias("head"), get(7).alias("deprel"))


def tagged_sentences(tokens: DataFrame, keys: list[str], order: str, least: int = 2, morphology: bool = False) -> DataFrame:
    """keys, words, tags: word tokens in order, lower-cased; sentences with under ``least`` of them are dropped."""
    tag = T.morphology_tag(F.col("pos"), F.col("feats")) if morphology else F.col("pos")
    d = tokens.where(T.is_word(F.col("word"))).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, F.lower("word").alias("w"), tag.alias("t")))).alias("s"))
    return d.where(F.size("s") >= least).select(*keys, F.col("s.w").alias("words"), F.col("s.t").alias("tags"))


def passages(sents: DataFrame, seed: int = 7) -> DataFrame:
    """5 to 8 sentences in a row of each document, from a place picked by hash."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("sent_no"))
    d = sents.withColumn("n", n).withColumn("r", rank).withColumn("size", 5 + T.bucket(F.col("doc_id").cast("string"), seed, 4))
    d = d.withColumn("start", T.bucket(F.col("doc_id").cast("string"), seed + 1, 1 << 31) % F.greatest(F.col("n") - F.col("size") + 1, F.lit(1)))
    return d.where("r > start and r <= start + size").select("doc_id", "sent_no", "words")


def fingerprint(*parts: object) -> str:
    return hashlib.sha256("\0".join(map(repr, parts)).encode()).hexdigest()[:16]


def save_model(tables: dict[str, DataFrame], root: str, key: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{key}/{name}")


def load_model(spark: SparkSession, names: list[str], root: str, key: str) -> dict[str, DataFrame]:
    """The tables saved under the key, which is the fingerprint of what they were made from; FileNotFoundError if there are none."""
    from pyspark.errors import AnalysisException

    try:
        return {n: spark.read.parquet(f"{root}/{key}/{n}") for n in names}
    except AnalysisException as error:
        raise FileNotFoundError(f"{root}/{key}") from error


def markdown(rows: list[dict]) -> str:
    """A Markdown table of a report's few rows."""
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |\n"
    return line(rows[0]) + line("---" for _ in rows[0]) + "".join(line(r.values()) for r in rows) if rows else ""


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
