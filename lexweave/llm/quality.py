"""Quality by an interpolated modified Kneser-Ney n-gram model over words and signs, trained on trusted text.

Words are looked up in a vocabulary of the ``VOCABULARY`` most frequent words of the trusted text (the model's closed vocabulary);
others are one of three unknown words, by whether they are signs, hold a digit, or neither. The order is two. With discounts D,
context mass g(a) and continuation probabilities P(b), a pair that was not met has the log-probability log g(a) + log P(b), and
one met c times that much and an excess that only (a, b, c) and bounded tables of g and P decide. So the counts of pairs, which grow
with the trusted text, are a table dealt into shards by the hash of the pair; every task sums what its documents need of g and P,
sends the pairs of its documents to the shards, sorted and packed, and the shards join them to their counts and send back each
document's excess. The pairs met most, a bounded number, are joined in the tasks: no shard gets a pair that all documents have.

Nothing of the count table or of the documents' pairs reaches the driver. A document's perplexity is held against a quantile of
trusted documents of its language that the model was not trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, Workspace

#: Ids of the vocabulary with the five special ones, so a pair has 2 x ID_BITS bits.
ID_BITS = 17
START, END, UNKNOWN, SPECIAL = 0, 1, 2, 5
VOCABULARY = (1 << ID_BITS) - SPECIAL
#: So many of the most frequent pairs are joined in the tasks.
HOT_PAIRS = 1 << 16
#: Documents are kept if their perplexity is at most this quantile of the held-out trusted documents of their language.
QUANTILE = 0.995
#: One of so many parts of the trusted texts (by their hash) is held out of training, for the quantiles.
FOLDS = 5
#: A chunk of documents that a task packs together has at most so many bytes (but for one longer text) and documents.
CHUNK_BYTES, DOC_BITS = 3_000_000, 13
#: Bytes of text whose pairs one shard sees, and the most shards: 2^34 pairs at most are then 4 million a shard.
SHARD_BYTES, SHARDS = 16_000_000, 4096

_CLASS = np.array([2 if 33 <= c < 127 else 1 if c > 127 else 0 for c in range(256)], np.uint8)
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = 1
_DIGIT = np.array([48 <= c < 58 for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_STEP = 1 << 21


def _powers(base: int) -> np.ndarray:
    out = np.full(_STEP, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP: list[np.ndarray] = []


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, unknown id, first byte) of the tokens of UTF-8 data: runs of word bytes (digits, letters, bytes over 127), and runs of
    signs. A-Z count as a-z."""
    if not _UP:
        _UP.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    parts, lo = [], 0
    while lo < len(data):
        hi = len(data)
        if hi - lo > _STEP:  # cut where a space is; a longer run without any is cut anywhere
            hi = max(data.rfind(b" ", lo, lo + _STEP), data.rfind(b"\n", lo, lo + _STEP)) + 1 or lo + _STEP
        raw = np.frombuffer(data, np.uint8, hi - lo, lo)
        kinds = _CLASS[raw]
        edge = np.flatnonzero(np.diff(kinds, prepend=0, append=0))
        kind = kinds[edge[:-1]]
        start, end, kind = edge[:-1][kind > 0], edge[1:][kind > 0], kind[kind > 0]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * _UP[0][: len(raw)])])
        h = (total[end] - total[start]) * _UP[1][start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
        unknown = UNKNOWN + np.where(kind == 2, 2, digits[end] > digits[start])
        parts.append((h ^ (h >> np.uint64(32)), unknown, start + lo))
        lo = hi
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))  # type: ignore[return-value]


def chunks(column: pa.Array):
    """(first row, texts' tokens as in ``tokens``, row of each token, rows) of stretches of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    lo = 0
    while lo < len(sizes):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo : lo + (1 << DOC_BITS)] + 1), CHUNK_BYTES, side="right")))
        data = "\n".join(column[lo:hi].to_pylist()).encode()
        h, unknown, start = tokens(data)
        yield lo, h, unknown, np.searchsorted(np.cumsum(sizes[lo:hi] + 1), start, side="right"), hi - lo
        lo = hi


def identify(h: np.ndarray, unknown: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return unknown.astype(np.uint64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at + SPECIAL, unknown).astype(np.uint64)


def pairs(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left << ID_BITS | right, document) of all positions: each text with tokens is opened by START and closed by END. And the number
    of positions of each document."""
    n = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(ids)) + (np.cumsum(n > 0) - 1)[doc]
    size = len(ids) + int((n > 0).sum())
    left, right = np.full(size, START, np.uint64), np.full(size, END, np.uint64)
    left[place + 1] = ids
    right[place] = ids
    n = n + (n > 0)
    return left << np.uint64(ID_BITS) | right, np.repeat(np.arange(n_docs), n), n


def parted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (keys >> np.uint64(ID_BITS)).astype(np.int64), (keys & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint64(_BASE)) >> np.uint64(40)) % np.uint64(shards)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys under 2^40 as differences, and other columns, by planes of bytes."""
    import zstandard

    planes = [np.diff(keys, prepend=np.uint64(0)), *columns]
    raw = b"".join(np.ascontiguousarray(p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes() for p in planes)
    return len(planes).to_bytes(1, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[1:] else b"", np.uint8).reshape(blob[0], 5, -1)
    out = np.zeros((blob[0], raw.shape[2], 8), np.uint8)
    out[:, :, :5] = raw.transpose(0, 2, 1)
    found = list(out.view("<u8")[:, :, 0])
    return [np.cumsum(found[0], dtype=np.uint64), *found[1:]]


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and how often each comes."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(first, append=len(x))


def count_words(texts: DataFrame, most: int) -> np.ndarray:
    """Hashes of the most frequent words of the texts (column text), sorted; at most ``most`` reach the driver."""

    def run(batches):
        seen, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, h, _, _, _ in chunks(batch.column(0)):
                word, k = runs(np.sort(h))
                both, at = np.unique(np.concatenate([seen, word]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, k]), len(both)).astype(np.int64)
                seen = both
                if len(seen) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["h", "n"])
                    seen, n = seen[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n)], ["h", "n"])

    top = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
    return np.sort(top.select("h").toArrow().column(0).to_numpy().view(np.uint64))


def count_pairs(texts: DataFrame, vocabulary, shards: int) -> DataFrame:
    """(shard, blob): the counts of each shard's pairs in one packed row; ``vocabulary`` is broadcast."""

    def local(batches):
        key_bits = np.uint64(2 * ID_BITS)
        for batch in batches:
            for _, h, unknown, doc, n_docs in chunks(batch.column(0)):
                keys, n = runs(np.sort(pairs(identify(h, unknown, vocabulary.value), doc, n_docs)[0]))
                order = np.argsort(shard_of(keys, shards) << key_bits | keys)
                keys, n = keys[order], n[order]
                yield dealt(shard_of(keys, shards), keys, n)

    def dealt(shard, keys, *columns):
        at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(shard))
        blobs = [pack(keys[a:b], *(c[a:b] for c in columns)) for a, b in zip(at, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def merged(batches):
        shard, found = None, []

        def together():
            if len(found) > 1:
                keys, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                found[:] = [[keys, np.bincount(at, np.concatenate([f[1] for f in found]).astype(float), len(keys)).astype(np.uint64)]]
            return found[0]

        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard and found:
                    keys, n = together()
                    yield dealt(np.full(len(keys), shard), keys, n)
                    found.clear()
                shard = s
                found.append(unpack(blob))
                if sum(len(f[0]) for f in found[1:]) > max(len(found[0][0]), 200_000):
                    together()
        if found:
            keys, n = together()
            yield dealt(np.full(len(keys), shard), keys, n)

    each = texts.mapInArrow(local, "shard int, blob binary").repartition(shards, "shard").sortWithinPartitions("shard")
    return each.mapInArrow(merged, "shard int, blob binary")


def statistics(counts: DataFrame) -> tuple[np.ndarray, list[int]]:
    """By id: count as a left word, numbers of right words met once, twice, more, and number of left words (ids x 5). And how many pairs
    come once, twice, thrice, four times. Both are bounded by the vocabulary."""
    size = 1 << ID_BITS

    def run(batches):
        total = np.zeros((size + 1, 5), np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                keys, n = unpack(blob)
                left, right = parted(keys)
                total[:size, 0] += np.bincount(left, n.astype(float), size).astype(np.int64)
                for k in (1, 2):
                    total[:size, k] += np.bincount(left[n == k], minlength=size)
                total[:size, 3] += np.bincount(left[n > 2], minlength=size)
                total[:size, 4] += np.bincount(right, minlength=size)
                total[size, :4] += [int((n == k).sum()) for k in (1, 2, 3, 4)]
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(total[at, k]) for k in range(5))], ["id", *(f"s{k}" for k in range(5))])

    names = [f"s{k}" for k in range(5)]
    rows = counts.mapInArrow(run, "id int, " + ", ".join(f"{x} long" for x in names)).groupBy("id").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
    out = np.zeros((size + 1, 5), np.int64)
    out[rows.column("id").to_numpy()] = np.stack([rows.column(x).to_numpy() for x in names], 1)
    return out[:size], out[size, :4].tolist()


def hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the pairs met most, by key; each shard offers its own most frequent ones."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                keys, n = unpack(blob)
                if len(keys) > most:
                    at = np.argpartition(n, len(n) - most)[-most:]
                    keys, n = keys[at], n[at]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    top = counts.mapInArrow(run, "key long, n long").orderBy(F.desc("n"), "key").limit(most).toArrow()
    order = np.argsort(top.column(0).to_numpy())
    return top.column(0).to_numpy()[order].astype(np.uint64), top.column(1).to_numpy()[order].astype(np.uint64)


def discounts(counts: list[int]) -> np.ndarray:
    """Chen and Goodman's discounts of 0, 1, 2 and more; usual values where the counts of counts are too few."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return np.array([0.0, *(min(max(d, 0.05), k) for k, d in enumerate(found, 1))])


class Model:
    """The bounded part: by id, log context mass and log continuation probability; discounts; the pairs met most."""

    def __init__(self, vocabulary: np.ndarray, stats: np.ndarray, of_counts: list[int], hot: tuple[np.ndarray, np.ndarray] | None = None):
        self.vocabulary, self.d = vocabulary, discounts(of_counts)
        self.total, met = stats[:, 0], stats[:, 4]
        mass = np.where(self.total > 0, stats[:, 1:4] @ self.d[1:] / np.maximum(self.total, 1), 1.0)
        low = discounts([int((met == k).sum()) for k in (1, 2, 3, 4)])
        cut = low[np.minimum(met, 3)]
        words = len(vocabulary) + SPECIAL - 1  # all but START
        part = cut.sum() / met.sum() if met.sum() else 1.0
        share = np.maximum(met - cut, 0) / max(met.sum(), 1) + part / words
        self.mass, self.share = np.log(mass), np.log(share)
        self.hot = hot[0] if hot else np.zeros(0, np.uint64)
        self.hot_excess = self.excess(*hot) if hot else np.zeros(0)

    def excess(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a pair met n times has more than one that was not, in log-probability."""
        left, right = parted(keys)
        n = n.astype(np.int64)
        own = (n - self.d[np.minimum(n, 3)]) / self.total[left]
        return np.log1p(own / np.exp(self.mass[left] + self.share[right]))


def train(work: Workspace, texts: DataFrame, shards: int, most: int = VOCABULARY, hot: int = HOT_PAIRS) -> tuple[Model, DataFrame]:
    """The model's bounded part and its table of counts (shard, blob)."""
    vocabulary = count_words(texts, most)
    counts = work.table(count_pairs(texts, work.spark.sparkContext.broadcast(vocabulary), shards), "counts")
    return Model(vocabulary, *statistics(counts), hot_pairs(counts, hot)), counts


def perplexities(docs: DataFrame, model: Model, counts: DataFrame, shards: int, id_col: str, text_col: str, kept: dict) -> DataFrame:
    """(id, the columns ``kept`` by name, n_symbols, perplexity) of every whole text; no perplexity for texts without tokens."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    own = docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in kept.items()), F.col(text_col).cast("string").alias("_text"))
    fields = {f.name: f.dataType.simpleString() for f in own.schema.fields[:-1]}
    # kinds: 0 counts of a shard, 1 pairs asked for, 2 a document (dealt to any shard), 3 sums that a shard sends back
    names = ["shard", "kind", "chunk", "at", "n", "total", "blob", *fields]
    schema = "shard int, kind int, chunk long, at int, n long, total double, blob binary, " + ", ".join(f"`{k}` {t}" for k, t in fields.items())
    size = len(fields)

    def rows(count: int, types: list, **given) -> pa.RecordBatch:
        kinds = dict(zip(names, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.binary(), *types], strict=True))
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(count, kinds[k]) for k in names], names)

    def ask(batches):
        from pyspark import TaskContext

        m, chunk = sent.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            types = [batch.column(i).type for i in range(size)]
            for lo, h, unknown, doc, n_docs in chunks(batch.column(size)):
                keys, doc, n = pairs(identify(h, unknown, m.vocabulary), doc, n_docs)
                left, right = parted(keys)
                total = np.bincount(doc, m.mass[left] + m.share[right], n_docs).astype(float)  # whole numbers of no rows, else
                if len(m.hot):
                    at = np.minimum(np.searchsorted(m.hot, keys), len(m.hot) - 1)
                    met = m.hot[at] == keys
                    total += np.bincount(doc[met], m.hot_excess[at[met]], n_docs)
                    keys, doc = keys[~met], doc[~met]
                asked, times = runs(np.sort(shard_of(keys, shards) << np.uint64(2 * ID_BITS + DOC_BITS) | keys << np.uint64(DOC_BITS) | doc.astype(np.uint64)))
                shard, key = asked >> np.uint64(2 * ID_BITS + DOC_BITS), asked >> np.uint64(DOC_BITS) & np.uint64((1 << 2 * ID_BITS) - 1)
                cut = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
                there = np.flatnonzero(cut[1:] > cut[:-1])
                blobs = [pack(key[cut[s] : cut[s + 1]], asked[cut[s] : cut[s + 1]] & np.uint64((1 << DOC_BITS) - 1), times[cut[s] : cut[s + 1]]) for s in there]
                k = len(there)
                yield rows(k, types, shard=pa.array(there.astype(np.int32)), kind=pa.array(np.ones(k, np.int32)), chunk=pa.array(np.full(k, chunk)), n=pa.array(np.full(k, n_docs)), blob=pa.array(blobs, pa.binary()))
                one = {name: batch.column(i).slice(lo, n_docs) for i, name in enumerate(fields)}
                yield rows(n_docs, types, shard=pa.array(np.full(n_docs, ((chunk >> 32) + chunk) % (1 << 32) % shards, np.int32)), kind=pa.array(np.full(n_docs, 2, np.int32)), chunk=pa.array(np.full(n_docs, chunk)), at=pa.array(np.arange(n_docs, dtype=np.int32)), n=pa.array(n.astype(np.int64)), total=pa.array(total), **one)
                chunk += 1

    def answer(batches):
        m, own, known, excess = sent.value, None, np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            kind, types = batch.column(1).to_numpy(), [batch.column(names.index(f)).type for f in fields]
            if (kind == 2).any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(kind == 2)).columns, names)
            some = np.flatnonzero(kind < 2)
            out = []
            for i, shard, blob, chunk, n_docs in zip(some, *(batch.column(c).take(pa.array(some)).to_pylist() for c in (0, 6, 2, 4)), strict=True):
                if shard != own:
                    own, known = shard, known[:0]
                if kind[i] == 0:
                    known, n = unpack(blob)
                    excess = m.excess(known, n)
                elif len(known):
                    key, doc, times = unpack(blob)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    met = known[at] == key
                    out.append((shard, chunk, np.bincount(doc[met].astype(np.int64), excess[at[met]] * times[met], n_docs).astype("<f4").tobytes()))
            if out:
                shard, chunk, blob = zip(*out, strict=True)
                yield rows(len(out), types, shard=pa.array(shard, pa.int32()), kind=pa.array(np.full(len(out), 3, np.int32)), chunk=pa.array(chunk, pa.int64()), blob=pa.array(blob, pa.binary()))

    def gather(batches):
        now, more = None, np.zeros(0)
        for batch in batches:
            kind, chunk = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            extra = np.zeros(batch.num_rows)
            sums, places = batch.column(6), batch.column(3).fill_null(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])])) if len(kind) else []
            for a, b in zip(edges, [*edges[1:], len(kind)], strict=True):
                if chunk[a] != now:
                    now, more = chunk[a], np.zeros(1 << DOC_BITS)
                if kind[a] == 3:  # sums come first
                    for s in sums.slice(a, b - a).to_pylist():
                        part = np.frombuffer(s, "<f4")
                        more[: len(part)] += part
                else:
                    extra[a:b] = more[places[a:b]]
            there = np.flatnonzero(kind == 2)
            part = batch.take(pa.array(there))
            n = part.column(4).to_numpy().astype(float)
            p = np.exp(-(part.column(5).to_numpy() + extra[there]) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([*(part.column(names.index(f)) for f in fields), part.column(4), pa.array(p, mask=n == 0)], [*fields, "n_symbols", "perplexity"])

    table = counts.select("shard", F.lit(0).alias("kind"), "blob")
    asked = own.mapInArrow(ask, schema).unionByName(table, allowMissingColumns=True)
    answered = asked.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, schema)
    each = answered.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"), "shard")
    last = ", ".join(f"`{k}` {t}" for k, t in fields.items()) + ", n_symbols long, perplexity double"
    return each.mapInArrow(gather, last).withColumnRenamed("_id", id_col)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: int = VOCABULARY) -> DataFrame:
    """Quality of every document: id, lang, n_symbols, perplexity, high, trained, keep.

    Trusted are the documents with labels.quality 1 (an id labelled twice is trusted if no label says otherwise). Four fifths of them,
    by a hash of the text, so that copies fall together, train the model with all of their text (``trained``); ``high`` is the
    quantile of the other fifth in the language (of all of the fifth where a language, null among them, has none in it, and of
    all trusted documents where the fifth is empty). A document is kept if its perplexity is at most that. Texts without tokens
    (null, empty, blank) have no perplexity and are not kept; with no trusted text nothing is kept. Rows map one to one; other
    columns are ignored; empty in, empty out.
    """
    work = Workspace(docs.sparkSession, "quality")
    trusted = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q")).where("q = 1").select("_id")
    trusted = small(work.table(trusted, "trusted"))
    fold = F.pmod(F.xxhash64(F.col(text_col).cast("string")), F.lit(FOLDS)) != 0
    texts = docs.where(fold & F.col(text_col).isNotNull()).join(trusted, docs[id_col] == trusted["_id"], "left_semi").select(F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first().n or 0
    shards = min(SHARDS, max(8, size // SHARD_BYTES))
    model, counts = train(work, texts, shards, vocabulary)
    scored = perplexities(docs, model, counts, shards, id_col, text_col, {"lang": F.col(lang_col).cast("string"), "fold": fold})
    scored = work.table(scored, "scored")
    good = work.table(scored.where("perplexity is not null").join(trusted, scored[id_col] == trusted["_id"], "left_semi").select("lang", "fold", "perplexity"), "good")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    by = work.table(good.where("not fold").groupBy(F.col("lang").alias("_lang")).agg(cut.alias("_high")), "cuts")
    every = good.agg(F.percentile_approx(F.expr("if(fold, null, perplexity)"), quantile, 10_000).alias("_rest"), cut.alias("_all"))
    every = work.table(every, "cuts_all")
    out = scored.join(small(by), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(every))  # one row
    out = out.join(trusted, scored[id_col] == trusted["_id"], "left").withColumn("high", F.coalesce("_high", "_rest", "_all"))
    keep = F.coalesce(F.col("perplexity") <= F.col("high"), F.lit(False))
    trained = F.coalesce(F.col("_id").isNotNull() & F.col("fold"), F.lit(False))
    return out.select(id_col, "lang", "n_symbols", "perplexity", "high", trained.alias("trained"), keep.alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read(spark, sf_dir, t) for t in ("documents", "labels"))
    return classify(docs, labels)
