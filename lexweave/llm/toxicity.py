"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are lower-cased, homoglyphs and digits that stand for letters are folded, and everything but letters becomes a space.
The lexicon's entries are whole words and beginnings of words; their weights come from labelled documents. Occurrences inside
an exception phrase do not count. The score is logistic in the weighted, length-normalised counts.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, Workspace
from .language_id import held_out

#: The lexicon is learned from at most so many labelled documents, those with the smallest hashes of their ids.
SAMPLE_DOCS = 10_000
TERMS, CANDIDATES = 400, 6000
SHORTEST, LONGEST = 4, 10
EXCEPTIONS = ("trash can", "trash bin", "class clown fish", "clown fish", "sore loser bracket", "not stupid", "no idiot", "pond scum")
#: Characters that look like a letter, and digits that stand for one.
FOLDS = {
    "а": "a", "ɑ": "a", "α": "a", "в": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e", "ɡ": "g", "һ": "h", "і": "i",
    "ї": "i", "ι": "i", "ı": "i", "ј": "j", "к": "k", "κ": "k", "ⅼ": "l", "м": "m", "ո": "n", "η": "n", "о": "o", "ο": "o", "р": "p",
    "ρ": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ѵ": "v", "ν": "v", "ѡ": "w", "х": "x", "χ": "x", "у": "y", "γ": "y",
}
_DIGITS = str.maketrans("0134578", "oieastb")
_FOLD = {ord(k): v for k, v in FOLDS.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060)}
_DIGIT = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])")
_SIGN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, each between single spaces; digits count as letters only in a run beside a letter, signs only between letters."""
    text = _DIGIT.sub(lambda m: m.group().translate(_DIGITS), text.lower().translate(_FOLD))
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m.group() == "@" else "s", text)
    return f" {_OTHER.sub(' ', text).strip()} "


def grams(words: set[str]) -> set[str]:
    """Lexicon entries that a document's words offer: ' word ' and ' beginning'."""
    out = {f" {w} " for w in words if SHORTEST <= len(w) <= 24}
    for w in words:
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


def normalised(count, words):
    return np.log1p(100 * count / (words + 50))


class Lexicon:
    def __init__(self, weights: dict[str, float], bias: float, exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.weights, self.bias = weights, bias
        self.terms = list(weights)
        self.auto = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            self.auto.add_word(t, (i, len(t)))
        phrases = [fold(e) for e in exceptions]
        for j, p in enumerate(phrases):
            if p.strip() and p not in weights:
                self.auto.add_word(p, (-1 - j, len(p)))
        if len(self.auto):
            self.auto.make_automaton()

    def counts(self, folded: str) -> dict[int, int]:
        """Occurrences by term, without those inside an exception phrase."""
        if not len(self.auto):
            return {}
        found = list(self.auto.iter(folded))
        free = [(e - n + 1, e) for e, (i, n) in found if i < 0]
        out: dict[int, int] = {}
        for e, (i, n) in found:
            if i >= 0 and not any(a <= e - n + 1 and e <= b for a, b in free):
                out[i] = out.get(i, 0) + 1
        return out

    def score(self, text: str | None) -> float:
        folded = fold(text or "")
        n, total = folded.count(" ") - 1, self.bias
        for i, c in self.counts(folded).items():
            total += self.weights[self.terms[i]] * float(normalised(c, n))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def choose(counts: list[tuple[str, int, int]], pos: int, neg: int, terms: int = TERMS) -> list[str]:
    """Entries by their weight of evidence for the label, without beginnings that a longer entry says all of."""
    by = {g: (a, b) for g, a, b in counts}
    said = {g.rstrip() if g.endswith(" ") else g[:-1] for g in by if by.get(g.rstrip() if g.endswith(" ") else g[:-1]) == by[g]}
    ranked = sorted((-a * math.log((a + 0.5) / (pos + 1) / ((b + 0.5) / (neg + 1))), g) for g, (a, b) in by.items() if g not in said)
    return [g for _, g in ranked[:terms]]


def fit_weights(rows: list[tuple[int, int, dict[int, int]]], terms: int, l2: float = 0.05) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps: rows are (label, words, counts by term)."""
    x, y = np.zeros((len(rows), terms + 1)), np.zeros(len(rows))
    for r, (label, n, counts) in enumerate(rows):
        y[r], x[r, -1] = label, 1
        for i, c in counts.items():
            x[r, i] = normalised(c, n)
    w, ridge = np.zeros(terms + 1), np.full(terms + 1, l2)
    ridge[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Learns entries and weights from labels.toxic of at most ``sample`` documents outside the held-out fifth (crc32 of the id modulo
    5 is 0). An id labelled twice counts as toxic if any label says so; null labels are no labels. Without both labels in the
    sample every score is 0.5 or less."""
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    known = labels.where("toxic is not null").where(~held_out(id_col, 5, 0) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    known = F.broadcast(work.table(known.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(sample), "sample"))  # at most ``sample`` rows
    part = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(known, "_id").select("_y", "_text")
    part = work.table(part, "texts")
    totals = {r._y: r["count"] for r in part.groupBy("_y").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, -1.0)

    def offered(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in grams(set(fold(text).split())):
                    seen.setdefault(g, [0, 0])[y == 1] += 1
            if len(seen) > 500_000:
                yield _counts(seen)
                seen = {}
        yield _counts(seen)

    counts = part.mapInArrow(offered, "gram string, neg long, pos long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    weight = F.expr(f"pos * ln((pos + 0.5) / {pos + 1}D / ((neg + 0.5) / {neg + 1}D))")
    top = counts.where(f"pos >= 3 and (pos + 0.5) / {pos + 1} > 2.5 * (neg + 0.5) / {neg + 1}").orderBy(weight.desc(), "gram").limit(CANDIDATES)
    terms = choose([(r.gram, r.pos, r.neg) for r in top.collect()], pos, neg)
    draft = spark.sparkContext.broadcast(terms)

    def measured(batches):
        lexicon = Lexicon(dict.fromkeys(draft.value, 0.0), 0.0)
        for batch in batches:
            folded = [fold(t) for t in batch.column(1).to_pylist()]
            found = [lexicon.counts(f) for f in folded]
            cols = [batch.column(0), pa.array([f.count(" ") - 1 for f in folded], pa.int64())]
            cols += [pa.array([list(f) for f in found], pa.list_(pa.int32())), pa.array([list(f.values()) for f in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["y", "n", "i", "c"])

    rows = part.mapInArrow(measured, "y int, n long, i array<int>, c array<int>").collect()
    w, bias = fit_weights([(r.y, r.n, dict(zip(r.i, r.c, strict=True))) for r in rows], len(terms))
    return Lexicon({t: float(x) for t, x in zip(terms, w, strict=True) if x > 0}, bias)


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    cols = [pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))]
    return pa.RecordBatch.from_arrays(cols, ["gram", "neg", "pos"])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: id, score (0 to 1), predicted (1 from 0.5 on). Null texts count as empty and get the score of no
    occurrence; rows map one to one; other columns are ignored; empty in, empty out. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.bias))
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        lexicon = Lexicon(*sent.value)
        for batch in batches:
            found = np.array([lexicon.score(t.as_py()) for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {key}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, learn(docs, labels)).select("doc_id", held_out(n=5, rest=0).alias("held_out"), "score", "predicted")
