"""Count language models as DataFrames: padded n-grams, counts, contexts, add-k scores, perplexity, tuning of k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SENTENCE = r"[.!?]+\s+|\n"
KS = (0.001, 0.01, 0.05, 0.1, 0.5, 1.0)


def words(sentence: Column) -> Column:
    """The lower-cased words of a sentence."""
    return F.filter(F.regexp_extract_all(F.lower(sentence), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"\p{L}"))


def sentences(docs: DataFrame, lang: str | None = "en", least: int = 1) -> DataFrame:
    """(doc_id, sent_no, words): sentences with at least ``least`` words, lower-cased; null texts have none."""
    d = docs.where(F.col("text").isNotNull())
    d = d.where(F.col("lang") == lang) if lang else d
    s = d.select("doc_id", F.posexplode(F.split("text", SENTENCE)).alias("sent_no", "sentence"))
    return s.select("doc_id", "sent_no", words(F.col("sentence")).alias("words")).where(F.size("words") >= least)


def grams(sents: DataFrame, n: int, pad: int | None = None) -> DataFrame:
    """One row for each n-gram (w1..wn) of the padded sentences, beside the sentence's keys; pad: START symbols (default n - 1)."""
    pad = n - 1 if pad is None else pad
    keys = [c for c in sents.columns if c != "words"]
    padded = F.concat(F.array(*[F.lit(T.START)] * pad), F.col("words"), F.array(F.lit(T.END))) if pad else F.concat(F.col("words"), F.array(F.lit(T.END)))
    at = sents.select(*keys, padded.alias("p")).select(*keys, "p", F.explode(F.sequence(F.lit(1), F.size("p") - (n - 1))).alias("i"))
    return at.select(*keys, *[F.element_at("p", F.col("i") + j).alias(f"w{j + 1}") for j in range(n)])


@dataclass
class Model:
    """Counts of order n; ``table`` has w1..wn, n and c (the count of the first n - 1); ``stats`` one row (v, total)."""

    n: int
    k: float
    table: DataFrame
    unigrams: DataFrame
    stats: DataFrame


def fit(sents: DataFrame, n: int, k: float = 0.1, pad: int | None = None, end_in_unigrams: bool = False) -> Model:
    cols = [f"w{i + 1}" for i in range(n)]
    counts = grams(sents, n, pad).groupBy(*cols).agg(F.count("*").alias("n"))
    table = counts.withColumn("c", F.sum("n").over(Window.partitionBy(*cols[:-1]))) if n > 1 else counts.withColumn("c", F.lit(None).cast("long"))
    words = sents.select(F.explode("words").alias("w"))
    uni = words.groupBy("w").agg(F.count("*").alias("n"))
    if end_in_unigrams:
        uni = uni.unionByName(sents.agg(F.lit(T.END).alias("w"), F.count("*").alias("n")))
    stats = uni.agg((F.count(F.when(F.col("w") != T.END, 1)) + 1).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return Model(n, k, table, uni, stats)


def looked_up(rows: DataFrame, table: DataFrame, cols: list[str], n: str, c: str) -> DataFrame:
    """``rows`` with the counts n of their n-grams (columns ``cols``) and c of the first words of these; ``table``: cols and n. Rows and
    counts are dealt together by the first words, once, and read side by side: a join for each count would move the rows twice. The
    context of START alone, which every sentence has, is dealt by the last word too; its count is added up apart."""
    own, context = rows.columns, cols[:-1]
    opening = F.lit(True)
    for w in context:
        opening = opening & (F.col(w) == T.START)
    part = F.when(opening, F.pmod(F.xxhash64(cols[-1]), F.lit(256)).cast("int")).otherwise(-1)
    starts = table.where(opening).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_starts"))
    counts = table.select(*[F.col(x) if x in cols else F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in own], F.col("n").alias("_n"))
    both = rows.select(*own, F.lit(None).cast("long").alias("_n")).unionByName(counts.select(*own, "_n")).withColumn("_asked", F.col("_n").isNull())
    both = both.withColumn("_part", part).repartition(*context, "_part")
    both = both.withColumn(n, F.max("_n").over(Window.partitionBy(*cols, "_part")))
    both = both.withColumn("_sum", F.sum("_n").over(Window.partitionBy(*context, "_part"))).where("_asked").join(F.broadcast(starts))  # one row
    return both.select(*own, n, F.when(F.col("_part") >= 0, F.col("_starts")).otherwise(F.col("_sum")).alias(c))


def scored(model: Model, sents: DataFrame, own: bool = False) -> DataFrame:
    """Sentence keys, word count, log-probability: each n-gram's counts are looked up, then a sentence's are added up."""
    cols = [f"w{i + 1}" for i in range(model.n)]
    keys = [c for c in sents.columns if c != "words"]
    found = looked_up(grams(sents, model.n), model.table.select(*cols, "n"), cols, "n", "c").join(F.broadcast(model.stats))
    lp = T.add_k(F.col("n"), F.col("c"), F.col("v"), model.k)
    return found.groupBy(*keys).agg((F.count("*") - 1).alias("n_words"), F.sum(lp).alias("logprob"))


def perplexity(model: Model, sents: DataFrame) -> DataFrame:
    """exp(-logprob / (words + 1)), infinite for a sentence without words."""
    s = scored(model, sents)
    p = F.when(F.col("n_words") == 0, F.lit(float("inf"))).otherwise(F.exp(-F.col("logprob") / (F.col("n_words") + 1)))
    return s.withColumn("perplexity", p)


def document_perplexity(docs: DataFrame, lang: str = "en", n: int = 3, k: float = 0.1) -> DataFrame:
    """Perplexity of each document under the model of all documents of the language, whose own counts it therefore has: one
    count of all n-grams, one window for contexts, one join back."""
    sents = docs.where((F.col("lang") == lang) & F.col("text").isNotNull())
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike(r"\p{L}"))
    sents = sents.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    return perplexity(fit(sents, n, k), sents)


def tune(train: DataFrame, dev: DataFrame, n: int, ks: tuple[float, ...] = KS) -> DataFrame:
    """(k, perplexity) of the dev sentences for each k, from one join."""
    cols, model = [f"w{i + 1}" for i in range(n)], fit(train, n)
    asked = grams(dev.select("words"), n).groupBy(*cols).agg(F.count("*").alias("times"))
    j = asked.join(model.table.select(*cols, "n"), cols, "left").join(model.table.select(*cols[:-1], "c").distinct(), cols[:-1], "left").join(F.broadcast(model.stats))
    sums = j.agg(*[F.sum(F.col("times") * T.add_k(F.col("n"), F.col("c"), F.col("v"), k)).alias(f"s{i}") for i, k in enumerate(ks)], F.sum("times").alias("m"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.exp(-F.col(f"s{i}") / F.col("m")).alias("perplexity")) for i, k in enumerate(ks)]))
    return sums.select(rows.alias("r")).select("r.k", "r.perplexity")


def interpolated(sents: DataFrame, train: DataFrame, k: float = 0.1, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> DataFrame:
    """Sentence log-probability under the mixture of trigram, bigram and unigram add-k models, all padded with two START."""
    keys = [c for c in sents.columns if c != "words"]
    tri, bi = fit(train, 3, k, 2, True), fit(train, 2, k, 2, True)
    cols = ["w1", "w2", "w3"]
    j = looked_up(grams(sents, 3, 2), tri.table.select(*cols, "n"), cols, "n3", "c3").drop("w1")
    j = looked_up(j, bi.table.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), "n"), cols[1:], "n2", "c2").drop("w2")
    j = j.join(tri.unigrams.select(F.col("w").alias("w3"), F.col("n").alias("n1")), "w3", "left").join(F.broadcast(tri.stats))
    p = lambda n, c: (F.coalesce(n, F.lit(0)) + F.lit(k)) / (F.coalesce(c, F.lit(0)) + F.lit(k) * F.col("v"))
    mix = F.lit(weights[0]) * p(F.col("n3"), F.col("c3")) + F.lit(weights[1]) * p(F.col("n2"), F.col("c2")) + F.lit(weights[2]) * p(F.col("n1"), F.col("total"))
    return j.groupBy(*keys).agg(F.sum(F.ln(mix)).alias("logprob"))
