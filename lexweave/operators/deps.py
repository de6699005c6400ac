"""Training of the transition classifier: oracle steps of trees as rows, multinomial logistic regression over one-hot features."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import decoders as D

FEATURES = ("s1", "s2", "b1", "b2")


def training_rows(trees: DataFrame) -> DataFrame:
    """(sent_id, id, pos, head, deprel) -> s1, s2, b1, b2, transition: each tree is replayed by the oracle; trees that no transitions
    build give one row with a null transition, so that they can be counted."""
    per = trees.groupBy("sent_id").agg(F.collect_list(F.struct("id", "pos", "head", "deprel")).alias("t"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for tree in pdf["t"]:
                pos = {int(x["id"]): x["pos"] for x in tree}
                try:
                    steps = D.oracle({int(x["id"]): (int(x["head"]), x["deprel"]) for x in tree})
                    rows += [(*D.features(s, pos), m) for s, m in steps]
                except (ValueError, KeyError):
                    rows.append((None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[*FEATURES, "transition"])

    return per.select("t").mapInPandas(run, ", ".join(f"{c} string" for c in (*FEATURES, "transition")))


def alike(sentences: DataFrame) -> DataFrame:
    """(pos, head, deprel: arrays by place) -> the same, and times: equal trees once, with their count."""
    return sentences.groupBy("pos", "head", "deprel").agg(F.count("*").alias("times"))


def counted_rows(trees: DataFrame) -> DataFrame:
    """Trees of ``alike`` -> s1, s2, b1, b2, transition, times: ``training_rows`` counted where they are made, so that a task gives a few
    rows for each of its batches instead of two for each word. Trees that no transitions build give a null transition."""

    def run(batches):
        for batch in batches:
            found: Counter = Counter()
            for pos, head, deprel, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = Counter(D.steps(dict(enumerate(zip(head, deprel, strict=True), 1)), dict(enumerate(pos, 1))))
                except (ValueError, KeyError):
                    rows = {((None,) * 4, None): 1}
                for row, n in rows.items():
                    found[row] += n * times
            cols = list(zip(*((*seen, move, n) for (seen, move), n in found.items()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:5]] + [pa.array(cols[5], pa.int64())], names=[*FEATURES, "transition", "times"])

    return trees.select("pos", "head", "deprel", "times").mapInArrow(run, ", ".join(f"{c} string" for c in (*FEATURES, "transition")) + ", times long")


def attached(trees: DataFrame, choose) -> DataFrame:
    """Trees of ``alike`` -> (n_tokens, n_right) in sums by batch: what ``evaluate.attachment`` of ``parse`` counts, without a row for each
    word. Sentences that cannot be parsed are left out."""

    def run(batches):
        for batch in batches:
            n_tokens = n_right = 0
            for pos, head, deprel, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    arcs = D.parse(dict(enumerate(pos, 1)), choose.value)
                except ValueError:
                    continue
                n_tokens += len(pos) * times
                n_right += times * sum(head[dep - 1] == h and deprel[dep - 1] == label for h, dep, label in arcs)
            yield pa.RecordBatch.from_arrays([pa.array([n_tokens], pa.int64()), pa.array([n_right], pa.int64())], names=["n_tokens", "n_right"])

    return trees.select("pos", "head", "deprel", "times").mapInArrow(run, "n_tokens long, n_right long")


def parse(trees: DataFrame, choose) -> DataFrame:
    """(sent_id, id, pos, ...) -> (sent_id, head, dep, label): arcs of the sentences by the broadcast classifier. A sentence where it
    chooses a move that is not allowed has no arcs."""
    per = trees.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("id", "pos"))).alias("t"))
    kind = trees.schema["sent_id"].dataType.simpleString()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for sent, tokens in zip(pdf["sent_id"], pdf["t"], strict=True):
                try:
                    rows += [(sent, *arc) for arc in D.parse({int(x["id"]): x["pos"] for x in tokens}, choose.value)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["sent_id", "head", "dep", "label"])

    return per.mapInPandas(run, f"sent_id {kind}, head int, dep int, label string")


class Chooser:
    """The fitted classifier as a function of features, for D.parse: a value not met in training adds nothing."""

    def __init__(self, labels: list[str], bias, weights: list[dict]):
        self.labels, self.bias, self.weights = labels, bias, weights
        self.known: dict[tuple, str] = {}

    def __call__(self, features: tuple) -> str:
        found = self.known.get(features)
        if found is None:
            if len(self.known) > 100_000:
                self.known = {}
            found = self.known[features] = self.chosen(features)
        return found

    def chosen(self, features: tuple) -> str:
        total = self.bias + sum((w[v] for w, v in zip(self.weights, features, strict=True) if v in w), start=0 * self.bias)
        return self.labels[int(total.argmax())]


def train(rows: DataFrame, iterations: int = 100) -> Chooser:
    """The transition chosen for features; equal rows are grouped and weighted, so the fit is over distinct rows. Rows may bring their
    count as times."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

    data = rows.where("transition is not null").groupBy(*FEATURES, "transition").agg((F.sum("times") if "times" in rows.columns else F.count("*")).cast("double").alias("weight"))
    label = StringIndexer(inputCol="transition", outputCol="label", stringOrderType="alphabetAsc")
    index = StringIndexer(inputCols=list(FEATURES), outputCols=[f"{c}_i" for c in FEATURES])
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in FEATURES], outputCols=[f"{c}_v" for c in FEATURES], dropLast=False)
    join = VectorAssembler(inputCols=[f"{c}_v" for c in FEATURES], outputCol="x")
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", maxIter=iterations, regParam=1e-4)
    model = Pipeline(stages=[label, index, hot, join, fit]).fit(data)
    names, values, last = list(model.stages[0].labels), model.stages[1].labelsArray, model.stages[-1]
    matrix, at, weights = last.coefficientMatrix.toArray(), 0, []
    for own in values:
        weights.append({v: matrix[:, at + i].copy() for i, v in enumerate(own)})
        at += len(own)
    return Chooser(names, last.interceptVector.toArray(), weights)
