"""Evaluation and statistics: attachment scores, confusion, quantiles, corruption, detection, grammar induction, tagging counts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import decoders as D


def attachment(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(sent_id, n_tokens, n_right, las in percent): head and label equal, by dependent; sentences without prediction are left out."""
    p = predicted.select("sent_id", F.col("dep").alias("id"), F.col("head").alias("p_head"), F.col("label").alias("p_label"))
    j = gold.join(predicted.select("sent_id").distinct(), "sent_id", "left_semi").join(p, ["sent_id", "id"], "left")
    right = F.coalesce((F.col("head") == F.col("p_head")) & (F.col("deprel") == F.col("p_label")), F.lit(False))
    n, n_right = F.count("*"), F.sum(right.cast("long"))
    return j.groupBy("sent_id").agg(n.alias("n_tokens"), n_right.alias("n_right"), F.round(100.0 * n_right / n, 4).alias("las"))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def quantiles(values: DataFrame, by: list[str], col: str, qs: tuple[float, ...] = (0.05, 0.1, 0.25, 0.75, 0.9, 0.95)) -> DataFrame:
    """min, median, max and the values at floor(q n) in order, by group. Equal values are counted first, so a group's window sees its
    distinct values only."""
    n = values.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*by)
    r = n.withColumn("_upto", F.sum("_k").over(w.orderBy(col))).withColumn("_n", F.sum("_k").over(w))
    value = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(col)))
    at = [value(F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))).alias(f"p{int(q * 100):02d}") for q in qs]
    mid = (value(F.floor((F.col("_n") - 1) / 2)) + value(F.floor(F.col("_n") / 2))) / 2
    return r.groupBy(*by).agg(F.max("_n").alias("n"), F.min(col).alias("lo"), *at, mid.alias("median"), F.max(col).alias("hi"))


def corruptions(sents: DataFrame, seed: int = 7, rest: tuple[str, ...] = ()) -> DataFrame:
    """sents (id, words of 8 or more) -> (id, kind, words): one variant of each kind, at places picked by hash. With columns ``rest``: these
    too, and each sentence of any length as it is, of kind clean."""
    n, w = F.size("words"), F.col("words")
    h = lambda k: T.bucket(F.col("id"), seed + k, 1 << 31)
    half = (n / 2).cast("int")
    pick = F.element_at(w, (h(0) % n + 1).cast("int"))
    cut = lambda a, b: F.slice(w, (a + 1).cast("int"), (b - a).cast("int"))
    zero = F.lit(0)
    at4, at2 = 1 + h(1) % (n - 5), 1 + h(2) % (n - 3)
    kinds = {
        "duplicate_token": F.concat(cut(zero, half), F.array(pick), cut(half, n)),
        "drop_middle_token": F.concat(cut(zero, half), cut(half + 1, n)),
        "reverse_span4": F.concat(cut(zero, at4), F.reverse(cut(at4, at4 + 4)), cut(at4 + 4, n)),
        "swap_adjacent": F.concat(cut(zero, at2), F.reverse(cut(at2, at2 + 2)), cut(at2 + 2, n)),
    }
    row = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("words"))
    odd = [row(k, v) for k, v in kinds.items()]
    if rest:
        rows = F.explode(F.when(n >= 8, F.array(row("clean", w), *odd)).otherwise(F.array(row("clean", w)))).alias("r")
        return sents.select("id", *rest, rows).select("id", *rest, "r.kind", "r.words")
    return sents.where(n >= 8).select("id", F.explode(F.array(*odd)).alias("r")).select("id", "r.kind", "r.words")


def productions(trees: DataFrame) -> DataFrame:
    """(lhs, b, c) of bracketed trees (column tree) in normal form, one row for each use; c is null over words, empty in a chain."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([r for t in pdf["tree"] for r in D.productions(D.read_tree(t))], columns=["lhs", "b", "c"])

    return trees.select("tree").mapInPandas(run, "lhs string, b string, c string")


def grammar(rules: DataFrame) -> DataFrame:
    """(lhs, b, c, logp) of productions (lhs, b, c), c null over words: relative frequencies by left side."""
    n = rules.groupBy("lhs", "b", "c").agg(F.count("*").alias("n"))
    return n.withColumn("logp", F.ln(F.col("n") / F.sum("n").over(Window.partitionBy("lhs")))).select("lhs", "b", "c", "n", "logp")


def tag_counts(tokens: DataFrame) -> dict[str, DataFrame]:
    """Emissions, transitions, most frequent tag and candidate tags of tokens (sent, pos, word, tag). First seen is by (sent, pos)."""
    first = F.min(F.struct("sent", "pos"))
    emit = tokens.groupBy("word", "tag").agg(F.count("*").alias("n"), first.alias("first"))
    seqs = tokens.groupBy("sent").agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("s"))
    seqs = seqs.select("sent", F.concat(F.array(F.lit(T.START), F.lit(T.START)), F.col("s.tag"), F.array(F.lit(T.END))).alias("p"))
    at = seqs.select("p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("i"))
    tri = at.select(*[F.element_at("p", F.col("i") + j).alias(f"t{j + 1}") for j in range(3)]).groupBy("t1", "t2", "t3").agg(F.count("*").alias("n"))
    best = emit.groupBy("word").agg(F.expr("min_by(tag, struct(-n, first))").alias("tag"))
    seen = emit.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("first", "tag"))).alias("s")).select("word", F.col("s.tag").alias("tags"))
    return {"emissions": emit.select("word", "tag", "n"), "transitions": tri, "most_frequent": best, "candidates": seen}


def baseline_tags(tokens: DataFrame, most_frequent: DataFrame) -> DataFrame:
    """tokens (word, ...) with pred: the word's most frequent tag, UNK for a word without one."""
    known = most_frequent.select("word", F.col("tag").alias("pred"))
    return tokens.join(known, "word", "left").withColumn("pred", F.coalesce("pred", F.lit("UNK")))


def most_supported(confused: DataFrame, k: int) -> DataFrame:
    """The part of a confusion (gold, pred, n) among the ``k`` tags that are gold most often, of equals the smaller."""
    top = confused.groupBy("gold").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "gold").limit(k).select("gold")
    top = F.broadcast(top)  # k rows
    return confused.join(top, "gold", "left_semi").join(top.select(F.col("gold").alias("pred")), "pred", "left_semi").select("gold", "pred", "n")


def micro_attachment(scores: DataFrame) -> DataFrame:
    """All tokens of the scored sentences together; 0 where there are none."""
    n, right = F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_right"), F.lit(0))
    return scores.agg(n.alias("n_tokens"), right.alias("n_right"), F.when(n > 0, F.round(100.0 * right / n, 4)).otherwise(0.0).alias("las"))


def segmentation(rows: DataFrame) -> DataFrame:
    """rows (words, tags, segmented, greedy, predicted: tags of segmented, tagged: tags of words) -> one row: sentences, those that the
    model, the greedy rule, and model and tags together have right; gold tags, those at comparable positions (the same word at the
    same place), right ones, errors of the tagger and errors that segmentation causes; right tags of the words as given."""
    place = F.sequence(F.lit(0), F.size("words") - 1)
    there = F.filter(place, lambda i: F.coalesce(F.get("segmented", i) == F.get("words", i), F.lit(False)) & (i < F.size("predicted")))
    r = rows.where("size(words) > 0").withColumn("there", there)
    right = lambda at, found: F.size(F.filter(at, lambda i: F.get(found, i) == F.get("tags", i)))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    gold, comparable, correct = n(F.size("tags")), n(F.size("there")), n(right(F.col("there"), "predicted"))
    joint = (F.col("segmented") == F.col("words")) & (F.col("predicted") == F.col("tags"))
    return r.agg(
        F.count("*").alias("sentences"), n(F.col("segmented") == F.col("words")).alias("model_exact"), n(F.col("greedy") == F.col("words")).alias("greedy_exact"), n(joint).alias("joint_exact"),
        gold.alias("gold_tags"), comparable.alias("comparable_tags"), correct.alias("right_tags"), (comparable - correct).alias("genuine_errors"), (gold - comparable).alias("segmentation_errors"),
        n(right(place, "tagged")).alias("right_on_gold_words"),
    )


def error_examples(sents: DataFrame, vocabulary: DataFrame, seed: int = 11) -> DataFrame:
    """sents (keys, words) -> (kind, prev, gold, next, observed): of each sentence one word of three letters or more in the vocabulary
    (column word), picked by hash, is replaced by an edit out of the vocabulary (non-word) and by one in it (real-word), each picked
    by hash; a word without such an edit gives no example of that kind."""
    from . import spell

    keys = [c for c in sents.columns if c != "words"]
    t = sents.select(*keys, "words", F.posexplode("words").alias("pos", "word")).where(F.length("word") >= 3).join(vocabulary, "word", "left_semi")
    near = lambda i, edge: F.coalesce(F.get("words", i), F.lit(edge))
    prev = F.when(F.col("pos") == 0, T.START).otherwise(near(F.col("pos") - 1, T.START))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, "pos"))
    one = t.groupBy(*keys).agg(F.min(F.struct(order.alias("o"), "word", prev.alias("prev"), near(F.col("pos") + 1, T.END).alias("next"))).alias("m"))
    one = one.select("m.prev", F.col("m.word").alias("gold"), "m.next")
    words = one.select(F.col("gold").alias("word")).distinct()
    odd = spell.corrupt_nonword(words, vocabulary, seed).select(F.col("word").alias("gold"), "observed")
    real = spell.candidates(words, vocabulary).groupBy("word").agg(F.sort_array(F.collect_set("candidate")).alias("c"))
    pick = F.element_at("c", (T.bucket(F.col("word"), seed + 1, 1 << 31) % F.size("c") + 1).cast("int"))
    real = real.select(F.col("word").alias("gold"), pick.alias("observed"))
    both = [one.join(e, "gold").where("gold <> observed").select(F.lit(k).alias("kind"), "prev", "gold", "next", "observed") for k, e in (("non-word", odd), ("real-word", real))]
    return both[0].unionByName(both[1])


def corrector(sents: DataFrame, model, seed: int = 11, margin: float = 0.75) -> DataFrame:
    """(kind, method, examples, n_right, accuracy) of the corrections of ``error_examples``; neighbours are as given."""
    from . import spell

    model = replace(model, table=model.table.persist(), unigrams=model.unigrams.persist())  # read by every step below
    uni = model.unigrams.where(T.is_ascii_word(F.col("w")))
    e = error_examples(sents, uni.select(F.col("w").alias("word")), seed).persist()  # four corrections read it
    rows = []
    for method in ("edit", "symdelete"):
        odd = e.where("kind = 'non-word'")
        fixed = spell.correct_nonwords(odd.select(F.col("observed").alias("word")), uni, method).withColumnRenamed("word", "observed")
        odd = odd.join(fixed, "observed")
        real = spell.correct_realwords(e.where("kind = 'real-word'").withColumnRenamed("observed", "word"), model, margin, method=method)
        for found in (odd, real):  # one row each, run one by one: the four together are a plan that fills the driver
            r = found.groupBy("kind").agg(F.count("*").alias("examples"), F.sum((F.col("gold") == F.col("corrected")).cast("long")).alias("n_right"))
            r = r.select("kind", F.lit(method).alias("method"), "examples", "n_right", F.round(F.col("n_right") / F.col("examples"), 6).alias("accuracy"))
            rows += [tuple(x) for x in r.collect()]
    e.unpersist()
    return sents.sparkSession.createDataFrame(rows, "kind string, method string, examples long, n_right long, accuracy double")


def benchmark_batch(unigrams: DataFrame, size: int, seed: int = 19) -> DataFrame:
    """``size`` misspellings (word, observed) of words (w, n) of four letters or more, picked by hash, and the corrections by both
    methods; ValueError if there are fewer."""
    from . import spell

    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), "word")), F.col("word")]
    words = unigrams.where(F.length("w") >= 4).select(F.col("w").alias("word"))
    for tries in (2, 50):  # words without a misspelling are few
        odd = spell.corrupt_nonword(words.orderBy(*order).limit(tries * size), unigrams.select(F.col("w").alias("word")), seed)
        odd = odd.where("word <> observed").orderBy(*order).limit(size).persist()
        if odd.count() == size:
            break
    else:
        raise ValueError(f"fewer than {size} misspellings")
    for method, name in (("edit", "method_a"), ("symdelete", "method_b")):
        fixed = spell.correct_nonwords(odd.select(F.col("observed").alias("word")), unigrams, method)
        odd = odd.join(fixed.select(F.col("word").alias("observed"), F.col("corrected").alias(name)), "observed")
    return odd.select("word", "observed", "method_a", "method_b")
