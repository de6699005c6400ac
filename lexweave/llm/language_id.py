"""Language by compression: a text belongs to the language whose zstandard raw-content dictionary makes it smallest.

Each language's dictionary is raw text of a bounded, documented sample of labelled documents. A text is encoded whole, in
blocks of ``BLOCK`` bytes (each with the dictionary afresh, so that long texts are told as well as short ones) and the sizes
are summed. The margin is the share by which the smallest size is under the second smallest; narrow margins are rejected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Sample bound: at most so many labelled documents a language, those with the smallest hashes of their id, in that order and each
#: whole, until they fill the dictionary (the last one is cut where it is full).
SAMPLE_DOCS = 400
DICT_BYTES = 1 << 17
BLOCK = 4096
LEVEL = 3
#: A text is rejected if its margin is under this, or if it has no letters.
MIN_MARGIN = 0.002

_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower-cased UTF-8 with every ASCII byte that is no letter taken as a space, and runs of spaces as one."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_ASCII).split())


def has_letter(text: str) -> bool:
    """Whether a character has a Unicode category of letters."""
    return any(map(str.isalpha, text))


def sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, the language with the most labelled texts first; bounded by languages x DICT_BYTES and one
    text each, whatever the input's size. The hash has to be small enough first, for eight times the documents wanted, so that few
    rows of a language meet in the task that ranks them."""
    part = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(7)).alias("h"),
        F.col(text_col).cast("string").alias("text"),
    ).where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    share = {r.lang: r["count"] for r in part.groupBy("lang").count().collect()}
    steps = 1 << 30
    most = [(k, max(1, min(steps, 8 * docs_per_lang * steps // n))) for k, n in share.items()]
    limits = F.broadcast(docs.sparkSession.createDataFrame(most, "lang string, most long"))  # one row a language
    part = part.join(limits, "lang").where(F.pmod("h", F.lit(steps)) < F.col("most")).withColumn("size", F.octet_length("text"))
    rank = Window.partitionBy("lang").orderBy("h", "text")
    before = F.sum("size").over(rank.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = part.withColumn("r", F.row_number().over(rank)).withColumn("before", before)
    rows = rows.where(f"r <= {docs_per_lang} and before < {2 * DICT_BYTES}").orderBy("lang", "r").select("lang", F.substring("text", 1, DICT_BYTES).alias("text")).collect()
    out: dict[str, bytes] = {}
    for row in rows:
        done = out.get(row.lang, b"")
        out[row.lang] = done if len(done) >= DICT_BYTES else done + normal(row.text) + b" "
    return {k: out[k][:DICT_BYTES] for k in sorted(out, key=lambda k: (-share[k], k))}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as zstd

        self.langs = list(content)
        self.coders = [
            zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(content[k], dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            for k in self.langs
        ]

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language or und, score, margin); of languages with the same size the one with the most labelled texts."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(normal(text))
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / max(second, 1)
        return self.langs[best], min(1.0, margin / (margin + 0.02) if margin > 0 else 0.0), margin


def identify(docs: DataFrame, train: DataFrame | None = None, min_margin: float = MIN_MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_text: bool = False) -> DataFrame:
    """Language of every whole text of ``docs``: id, lang_pred, score (0 to 1), margin, rejected.

    ``train`` gives the dictionaries (text and non-null language; default: ``docs``). Null texts and texts without a letter are
    ``und``, with score 0, and rejected; so is everything if ``train`` has no labelled text. Rows map one to one; other columns are
    ignored, or all kept (``keep_text``) beside the new ones. An empty table gives an empty result. No shuffle beyond the sample's.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(sample(train if train is not None else docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    source = docs if keep_text else docs.select(id_col, text_col)
    new = {"lang_pred": "string", "score": "double", "margin": "double", "rejected": "boolean"}
    kept = [c for c in source.columns if keep_text or c != text_col]
    kept = [c for c in kept if c not in new]
    at = source.columns.index(text_col)

    def run(batches):
        model = Classifier(content.value)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            cols = [batch.column(source_at) for source_at in places]
            cols += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            cols.append(pa.array([f[0] == "und" or f[2] < min_margin for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, [*kept, *new])

    places = [source.columns.index(c) for c in kept]
    from pyspark.sql import types as T

    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in new.items()])
    return source.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", n: int = 4, rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n == rest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, docs.where(~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")
