"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items, as sequences of words. A table of shifts, indexed by the hash of a block of
words, tells how far a cursor may skip: at a block that is in no pattern, by nearly a whole pattern. Where the shift is zero,
the hash of the block selects a bucket of patterns, and a direct comparison of the words confirms an occurrence. The cursors
of many stretches of text move together, as numpy arrays. Patterns of each length have tables of their own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, read

WINDOW = 10
STRETCH = 1024  # words that one cursor covers
#: About so many patterns are searched at once; more are searched block by block, so tables keep a bound of memory.
BLOCK_PATTERNS = 200_000
BATCH_CHARS = 1_000_000

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bytes of words by themselves (A-Z as a-z), others as 0: UTF-8 bytes over 127 only occur in characters of words.
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 0 for c in range(256)], np.uint8)
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate(_UPPER))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        with np.errstate(over="ignore"):
            out[1:] = np.cumprod(np.full(n - 1, base, np.uint64))
    return out


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


class Text:
    """Words of many documents in one array: start and end of each in the bytes, its hash, and its document."""

    def __init__(self, texts: list[str], powers: Powers):
        data = [t.encode("utf-8", "replace") for t in texts]
        raw = b"\n".join(data) + b"\n"
        self.bytes = _BYTES[np.frombuffer(raw, np.uint8)]
        inside = np.concatenate([[False], self.bytes > 0])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        up, down = powers.get(len(raw))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * up[: len(raw)])])
            h = (total[self.end] - total[self.start]) * down[self.start]
            h ^= h >> np.uint64(29)
            self.hash = h * np.uint64(_MIX)
        offsets = np.cumsum([0, *(len(d) + 1 for d in data)])
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=len(texts))

    def phrase(self, lo: int, hi: int) -> bytes:
        return b" ".join(self.bytes[self.start[i] : self.end[i]].tobytes() for i in range(lo, hi))


class Table:
    """Shift table and suffix buckets of patterns with ``m`` words each."""

    def __init__(self, m: int, patterns: dict[bytes, list[int]]):
        self.m, self.block = m, min(2, m)
        self.bits = max(12, min(22, int(np.ceil(np.log2(len(patterns) * m + 1))) + 4))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.int16)
        self.buckets: dict[int, dict[bytes, list[int]]] = {}
        text = Text([p.decode("utf-8", "replace") for p in patterns], Powers())
        keys = self.keys(text.hash)
        for i, (p, items) in enumerate(patterns.items()):
            first = i * m
            for j in range(self.block - 1, m):
                k = keys[first + j]
                self.shift[k] = min(self.shift[k], m - 1 - j)
            self.buckets.setdefault(int(keys[first + m - 1]), {})[p] = items

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Block hash that ends at each word."""
        with np.errstate(over="ignore"):
            x = h.copy()
            if self.block == 2:
                x[1:] += h[:-1] * np.uint64(_BASE)
            return ((x * np.uint64(_MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: Text) -> list[tuple[int, list[int]]]:
        """(first word, items) of every occurrence that lies in one document."""
        n, m = len(text.hash), self.m
        if n < m:
            return []
        keys = self.keys(text.hash)
        at = np.arange(m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        stops = []
        while len(at):
            skip = self.shift[keys[at]]
            hit = skip == 0
            if hit.any():
                stops.append(at[hit])
            at = at + np.maximum(skip, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        out = []
        if stops:
            last = np.sort(np.concatenate(stops))
            last = last[text.doc[last] == text.doc[last - m + 1]]
            for e in last.tolist():
                items = self.buckets.get(int(keys[e]), {}).get(text.phrase(e - m + 1, e + 1))
                if items:
                    out.append((e - m + 1, items))
        return out


def tables(items: list[tuple[str, str | None]], window: int = WINDOW, block: int = BLOCK_PATTERNS) -> tuple[list[str], list[list[Table]]]:
    """Names of the items, and their windows in blocks of tables by pattern length. Items without words have no window."""
    names = sorted({str(i) for i, _ in items if i is not None})
    index = {n: k for k, n in enumerate(names)}
    found: dict[bytes, set[int]] = {}
    for i, text in items:
        w = words(text)
        if i is None or not w:
            continue
        for j in range(max(1, len(w) - window + 1)):
            found.setdefault(" ".join(w[j : j + window]).encode("utf-8", "replace"), set()).add(index[str(i)])
    all_patterns, blocks = sorted(found), []
    for lo in range(0, len(all_patterns), block):
        by: dict[int, dict[bytes, list[int]]] = {}
        for p in all_patterns[lo : lo + block]:
            by.setdefault(p.count(b" ") + 1, {})[p] = sorted(found[p])
        blocks.append([Table(m, by[m]) for m in sorted(by)])
    return names, blocks


def search(texts: list[str], names: list[str], blocks: list, powers: Powers) -> list[tuple[int, int, list[str]]]:
    """(words, words hit, items) of each text."""
    text = Text(texts, powers)
    cover = np.zeros(len(text.hash) + 1, np.int32)
    items: list[set[int]] = [set() for _ in texts]
    for block in blocks:
        for table in block:
            for first, found in table.search(text):
                cover[first] += 1
                cover[first + table.m] -= 1
                items[text.doc[first]].update(found)
    hit = np.bincount(text.doc[np.cumsum(cover[:-1]) > 0], minlength=len(texts))
    return [(int(n), int(h), sorted(names[k] for k in s)) for n, h, s in zip(text.n_words, hit, items, strict=True)]


def blocks_of(items: DataFrame, window: int, block: int):
    """The items (id, text as strings) in lists of about ``block`` windows, brought to the driver one list at a time."""
    part, n = [], 0
    for row in items.toLocalIterator():
        part.append((row[0], row[1]))
        n += max(1, len(words(row[1])) - window + 1)
        if n >= block:
            yield part
            part, n = [], 0
    if part:
        yield part


def occurrences(docs: DataFrame, sent, id_col: str) -> DataFrame:
    """(id, n_words, first, size, item) of each document's occurrences of the broadcast patterns (first word, number of words, item's
    name), or one row with nulls for a document without any; docs: (id, text)."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        powers = Powers()
        names, blocks = sent.value
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars > BATCH_CHARS or i == len(texts) - 1:
                    text, rows = Text(texts[lo : i + 1], powers), []
                    for table in (t for block in blocks for t in block):
                        for first, items in table.search(text):
                            d = int(text.doc[first])
                            at = first - int(np.searchsorted(text.doc, d))
                            rows += [(lo + d, at, table.m, names[k]) for k in items]
                    rows += [(lo + d, None, None, None) for d in set(range(i + 1 - lo)) - {r[0] - lo for r in rows}]
                    place, first, size, item = zip(*rows, strict=True)
                    n = [int(text.n_words[p - lo]) for p in place]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(item, pa.string())], [id_col, "n_words", "first", "size", "item"])
                    lo, chars = i + 1, 0

    return docs.mapInArrow(run, f"`{id_col}` {key}, n_words long, first long, size long, item string")


def in_blocks(docs: DataFrame, lists, window: int, id_col: str, text_col: str) -> DataFrame:
    """``contamination`` for more patterns than one block: block by block, each block's tables are sent, its occurrences written, and the
    tables given up before the next; then occurrences are gathered by text."""
    work = Workspace(docs.sparkSession, "benchmark")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col), F.unhex(F.md5(text)).alias("_k"), text.alias("_text"))
    texts = keyed.select("_k", "_text").groupBy("_k").agg(F.first("_text").alias("_text"))
    found = None
    for i, items in enumerate(lists):
        sent = docs.sparkSession.sparkContext.broadcast(tables(items, window))
        part = work.table(occurrences(texts, sent, "_k"), f"block{i}")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    hit = found.where("first is not null").select("_k", F.explode(F.expr("sequence(first, first + size - 1)")).alias("w")).distinct().groupBy("_k").agg(F.count("*").alias("n_hit"))
    item = found.where("item is not null").groupBy("_k").agg(F.sort_array(F.collect_set("item")).alias("items"))
    n = found.groupBy("_k").agg(F.max("n_words").alias("n_words"))
    out = keyed.select(id_col, "_k").join(n, "_k").join(hit, "_k", "left").join(item, "_k", "left")
    joined, n_hit = F.coalesce(F.array_join("items", ","), F.lit("")), F.coalesce("n_hit", F.lit(0))
    return out.select(id_col, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), joined.alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK_PATTERNS) -> DataFrame:
    """Every document's share of benchmark words: id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are lower-cased (A-Z) runs of digits, letters a-z and characters over U+007F. Null texts have no words. An item of
    fewer words than the window is one window, an item without words none; items with the same id are one item, items without an
    id are left out. Documents map one to one (repeated ids stay); other columns are ignored; an empty benchmark hits nothing.
    The benchmark is the stated set of patterns: about ``block`` of them are in the driver and in the tasks at a time.
    """
    spark = docs.sparkSession
    lists = blocks_of(benchmark.select(F.col(item_col).cast("string"), F.col(item_text).cast("string")), window, block)
    first, second = next(lists, []), next(lists, None)
    if second is not None:
        return in_blocks(docs, (x for part in ([first, second], lists) for x in part), window, id_col, text_col)
    sent = spark.sparkContext.broadcast(tables(first, window))
    key = docs.schema[id_col].dataType.simpleString()
    columns = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]

    def run(batches):
        powers = Powers()
        names, blocks = sent.value
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found, lo, chars = [], 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars > BATCH_CHARS or i == len(texts) - 1:
                    found += search(texts[lo : i + 1], names, blocks, powers)
                    lo, chars = i + 1, 0
            joined = [",".join(f[2]) for f in found]
            cols = [batch.column(0), *(pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)), pa.array([len(f[2]) for f in found], pa.int64())]
            cols.append(pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()))
            cols += [pa.array([f[1] > 0 for f in found], pa.bool_()), pa.array(joined, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, columns)

    schema = f"`{id_col}` {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("items")


ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
win as (select distinct item_id, least(10, len(w)) as m, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') as p from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as j from b where len(w) > 0)),
lens as (select distinct m from win),
dw as (select r, m, j, array_to_string(w[j : j + m - 1], ' ') as p from (select r, w, m, unnest(range(1, len(w) - m + 2)) as j from d, lens where len(w) >= m)),
occ as (select dw.r, dw.j, dw.m, win.item_id from dw join win on dw.p = win.p and dw.m = win.m),
hit as (select r, count(distinct k) as n_hit from (select r, unnest(range(j, j + m)) as k from occ) group by r),
it as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, item_id from occ) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join it using (r)
"""
