"""Token counts by a digest cache.

A text is keyed by the SHA-256 of its normalised content; a tokenizer by the SHA-256 of its file and the library's version.
Stored counts are joined by these digests; only distinct texts without a stored count are encoded, and their counts are
appended to the cache. The normalisation only does what cannot change a count: it maps tab, line feed and carriage return to
a space and trims spaces where the tokenizer drops white space, and nothing elsewhere.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, Workspace

MEMO = 1_000_000  # chunks with a remembered count in one worker
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_version(path: str) -> str:
    import importlib.metadata as meta

    lib = "sentencepiece" if str(path).endswith(".model") else "tokenizers"
    return f"{lib}-{meta.version(lib)}-{hashlib.sha256(Path(path).read_bytes()).hexdigest()}"


def drops_space(path: str) -> bool:
    """Whether white space only separates words: then a text's count is the sum over its chunks between spaces."""
    if str(path).endswith(".model"):
        return False
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = {n["type"]: n for n in [norm, *norm.get("normalizers", [])] if "type" in n}
    splits = [p for p in [pre, *pre.get("pretokenizers", [])] if p.get("type") == "Split"]
    plain = not any(t.get("lstrip") or t.get("rstrip") or t["content"] != t["content"].strip() for t in spec.get("added_tokens", []))
    return bool(
        plain
        and spec["model"].get("end_of_word_suffix")
        and not spec["model"].get("dropout")
        and set(kinds) <= {"Sequence", "NFC", "Replace", "Lowercase"}
        and any(p["behavior"] == "Removed" and p["invert"] and p["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+") for p in splits)
    )


class Encoder:
    """Counts ids of whole texts, without begin, end or added special tokens, truncation or padding."""

    def __init__(self, kind: str, data: bytes, chunks: bool):
        self.chunks, self.memo = chunks, {}
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.many = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(data.decode("utf-8"))
            model.no_truncation()
            model.no_padding()
            self.spans = lambda texts: [[a for a, _ in x.offsets] for x in model.encode_batch(texts, add_special_tokens=False)]
            self.many = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, chunks: list[str], width: int = 200) -> dict[str, int]:
        """Counts of chunks, encoded ``width`` to a text; the tokens' offsets tell whose they are."""
        groups = [chunks[i : i + width] for i in range(0, len(chunks), width)]
        out: dict[str, int] = {}
        for group, starts in zip(groups, self.spans([" ".join(g) for g in groups]), strict=True):
            at = np.cumsum([0, *(len(w) + 1 for w in group[:-1])])
            out.update(zip(group, np.bincount(np.searchsorted(at, starts, side="right") - 1, minlength=len(group)).tolist(), strict=True))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        if not self.chunks:
            return self.many(texts)
        get, parts = self.memo.get, [t.replace("\n", " ").split(" ") for t in texts]
        missing = list({w for p in parts for w in p if get(w) is None})
        for i in range(0, len(missing), 20_000):
            self.memo.update(self.each(missing[i : i + 20_000]))
        out = [sum(map(get, p)) for p in parts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        return out


def encode(texts: DataFrame, path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens), by Arrow batches cut to bounded numbers of characters."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(("model" if str(path).endswith(".model") else "json", Path(path).read_bytes(), drops_space(path)))

    version = tokenizer_version(path)

    def run(batches):
        if version not in _ENCODERS:  # one a worker process: later tasks find its remembered counts
            _ENCODERS.clear()
            _ENCODERS[version] = Encoder(*shared.value)
        encoder = _ENCODERS[version]
        for batch in batches:
            keys, values = batch.column("digest"), batch.column("text").to_pylist()
            out, lo, chars = [], 0, 0
            for i, t in enumerate(values):
                chars += len(t)
                if chars > 2_000_000 or i == len(values) - 1:
                    out += encoder.counts(values[lo : i + 1])
                    lo, chars = i + 1, 0
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Counts tokens of every text, through the Parquet cache at ``cache`` (made if absent, appended to otherwise).

    Returns one row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``). A null text counts as
    empty; empty texts have no tokens; repeated ids and texts keep their rows; other columns of ``docs`` are ignored; an empty
    table gives an empty result. Texts are encoded whole. The cache rows are (digest, n_tokens), in a folder for each version; a row
    that two concurrent calls both append is read once.
    """
    version = tokenizer_version(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.trim(F.translate(text, "\n\r\t", "   ")) if drops_space(path) else text
    base = docs.select(F.col(id_col), text.alias("text"), F.unhex(F.sha2(norm, 256)).alias("digest"))
    distinct = base.groupBy("digest").agg(F.first("text").alias("text"))
    schema = "digest binary, n_tokens long, version string"

    def stored() -> DataFrame:
        return spark.read.schema(schema).parquet(cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], schema).write.partitionBy("version").mode("append").parquet(cache)
    missing = distinct.join(stored(), "digest", "left_anti")
    encode(missing, path).withColumn("version", F.lit(version)).write.partitionBy("version").mode("append").parquet(cache)
    keys = base.select(F.col(id_col), F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return keys.join(stored(), "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents under word_bpe_49k.json, from an empty cache: each run does the whole encoding."""
    import public_tokenizers

    work = Workspace(spark, "token-counts")
    docs = read(spark, sf_dir, "documents")
    return count_tokens(spark, docs, public_tokenizers.path("word_bpe_49k.json"), f"{work.path}/cache")
