"""SimHash near-duplicates by an inverted index over byte positions, with count filtering.

Two fingerprints within ``RADIUS`` bits differ in at most as many of their 8 bytes, so at least 5 positional bytes are shared.
Any 5 of 8 positions hold one of the tuples of positions in ``TUPLES[t]`` whole; the index lists fingerprints under the bytes
at these tuples, so that every such pair meets in a list. For the pairs met, the shared positional bytes are tallied, those
under the guaranteed minimum are dropped, and the rest are verified by their differing bits.

Copies are collapsed first: the index holds distinct fingerprints. Within a list every member is compared with the list's
smallest; pairs of which both are in the same component by then need no comparison, the remaining ones are compared directly,
in blocks, so that a long list is many tasks.

``similar_groups`` finds the texts whose sets of shingles have a Jaccard similarity, which 64 bits cannot tell: its fingerprints
have ``WIDE`` bits (so as many bytes as a count filter needs to tell pairs apart), the index lists them under ``TABLES`` triples
of byte positions, pairs met are held to the number of differing bits that such texts have, and the exact similarity decides.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, read, small, Workspace

RADIUS, SEED = 3, 42
#: Bits of the fingerprints of ``similar_groups``, and triples of byte positions that they are listed under.
WIDE, TABLES = 512, 168
#: Odd factors that mix a hash anew for each 64 bits of a wide fingerprint.
_MIXES = [(0x9E3779B97F4A7C15 * (2 * k + 1) ** 3) % (1 << 64) | 1 for k in range(WIDE // 64)]
#: By tuple size: positions such that any 5 of the 8 contain one of the tuples. Longer tuples for more fingerprints.
TUPLES = {
    2: [(0, 1), (2, 3), (4, 5), (6, 7)],
    3: [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)],
    5: list(combinations(range(8), 5)),
}


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the shingles of ``width`` words, repeats included; words are split at ASCII white space."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    hashes = [digest(joined[a:b], SEED) for a, b in zip(at[:-width].tolist(), (at[width:] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65_536):
        part = np.array(hashes[lo : lo + 65_536], np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long. A null text has fingerprint zero."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], [id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {key}, fp long")


def links(work: Workspace, fps: DataFrame, size: int | None = None) -> DataFrame:
    """(node, root) of the distinct fingerprints ``fps`` (one column fp) that have a neighbour within RADIUS bits."""
    n = fps.count()
    size = size or (2 if n < 1 << 14 else 3 if n < 1 << 26 else 5)
    byte = lambda p: f"(shiftrightunsigned(fp, {56 - 8 * p}) & 255)"
    keys = [f"shiftleft({i}L, 48) | " + " | ".join(f"shiftleft({byte(p)}, {8 * j})" for j, p in enumerate(t)) for i, t in enumerate(TUPLES[size])]
    index = fps.select("fp", F.explode(F.array(*[F.expr(k) for k in keys])).alias("key"))
    lists = work.table(index.groupBy("key").agg(F.min("fp").alias("head"), F.count("*").alias("n")).where("n > 1"), "lists")
    members = work.table(index.join(small(lists.select("key", "head")), "key").select("key", "head", "fp"), "members")
    shared = " + ".join(f"cast((shiftrightunsigned(a ^ b, {8 * i}) & 255) = 0 as int)" for i in range(8))
    verified = lambda pairs: pairs.where(f"{shared} >= {8 - RADIUS}").where(f"bit_count(a ^ b) <= {RADIUS}").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    first = work.table(verified(members.where("head <> fp").select(F.col("head").alias("a"), F.col("fp").alias("b"))), "stars")
    root = work.table(connected_components(work, first, "cc1"), "roots1")
    at = members.join(small(root), F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    at = work.table(at, "at")
    split = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = work.table(at.join(small(work.table(split, "split")), "key", "left_semi"), "rest")
    close = F.expr(f"{shared.replace('a ^ b', 'node_a ^ node_b')} >= {8 - RADIUS} and bit_count(node_a ^ node_b) <= {RADIUS}")
    more = work.table(verified(blocked(rest.withColumnRenamed("fp", "node"), close, [])), "cross")
    if more.isEmpty():
        return root
    chain = root.select(F.col("node").alias("u"), F.col("root").alias("v"))
    return work.table(connected_components(work, chain.unionByName(more), "cc2"), "roots2")


def blocked(rest: DataFrame, near, by: list[str], block: int = 1000) -> DataFrame:
    """Pairs (a, b) of nodes of ``rest`` (key, node, root, and columns ``by``) in one list under different roots that are near:
    a condition on the columns with _a and _b. One side of a long list is dealt into blocks, the other goes to each of them."""
    n = rest.groupBy("key").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("blocks"))
    held = rest.join(n, "key")
    a, b = (held.select("key", "blocks", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "root", *by))) for x in "ab")
    a = a.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    b = b.withColumn("at", F.pmod(F.xxhash64("node_b"), F.col("blocks")).cast("int")).drop("blocks")
    return a.join(b, (a["key"] == b["key"]) & (a["at"] == b["at"]) & (F.col("root_a") < F.col("root_b")) & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Eight words of 64 bits from a set of 64-bit hashes: a bit is set if it is in over half of them; each word mixes them anew."""
    out = np.zeros(WIDE // 64, np.uint64)
    for k in range(len(out)):
        x = hashes * np.uint64(_MIXES[k])
        x = x ^ (x >> np.uint64(32))
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(x), 65_536):
            part = x[lo : lo + 65_536].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(x)).view(np.uint64)[0]
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the set of shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(at[:-width].tolist(), (at[width:] - 1).tolist(), strict=True)], np.uint64))


def wide_fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, digest of the words, w0 to w7) of each row's whole text."""
    import hashlib

    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    lanes = [f"w{k}" for k in range(WIDE // 64)]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([wide_fingerprint(shingle_hashes(t, width)) for t in texts], np.uint64).reshape(-1, len(lanes)).view(np.int64)
            digests = [hashlib.md5(b" ".join((t or "").encode("utf-8", "replace").lower().split())).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), *(pa.array(found[:, k]) for k in range(len(lanes)))], [id_col, "digest", *lanes])

    key = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {key}, digest binary, " + ", ".join(f"{x} long" for x in lanes))


def triples(tables: int = TABLES) -> list[tuple[int, int, int]]:
    """Triples of byte positions, each position in as many as any other, from permutations by a fixed rule."""
    rng, out = np.random.default_rng(SEED), []
    while len(out) < tables:
        p = rng.permutation(WIDE // 8).tolist()
        out += [tuple(p[i : i + 3]) for i in range(0, len(p) - 2, 3)]
    return out[:tables]


def listed(nodes: DataFrame) -> DataFrame:
    """(node, key): each node under the bytes at every triple of positions; nodes: (node, w0 to w7)."""
    places = np.array(triples())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                words = np.stack([part.column(i).to_numpy() for i in range(1, part.num_columns)], 1).astype(">i8")
                at = words.view(np.uint8).reshape(part.num_rows, WIDE // 8)[:, places].astype(np.int64)
                keys = np.arange(len(places)) << 48 | at[:, :, 0] | at[:, :, 1] << 8 | at[:, :, 2] << 16
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), len(places))), pa.array(keys.ravel())], ["node", "key"])

    return nodes.mapInArrow(run, "node long, key long")


def most_bits(similarity: float) -> int:
    """Bits that texts of the similarity differ in at most (but for one in a thousand): each differs with the angle's share."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(WIDE * p + 3.1 * math.sqrt(WIDE * p * (1 - p)))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group of every document: id, component_id, the smallest id reachable by links. Texts link if the sets of their shingles of
    ``width`` words (lower-cased A-Z, split at ASCII white space; a shorter text is one shingle) have at least the Jaccard similarity;
    so do all texts without words, null ones too. Links are exact; of pairs at a similarity of 0.8 the index finds 0.88, of those at
    0.85 0.97, at 0.9 0.998 (simulated). Rows map one to one, repeated ones are in one group; empty in, empty out."""
    work = Workspace(docs.sparkSession, "similar")
    lanes = [f"w{k}" for k in range(WIDE // 64)]
    each = work.table(wide_fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = each.groupBy("digest").agg(F.min(id_col).alias("low"), *[F.first(x).alias(x) for x in lanes])
    nodes = work.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    index = listed(nodes.select("node", *lanes))
    lists = work.table(index.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1"), "lists")
    members = work.table(index.join(small(lists.select("key", "head")), "key").select("key", "head", "node"), "members")
    apart = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in lanes)
    near = F.expr(f"{apart} <= {most_bits(similarity)}")
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in lanes))
    found = members.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    found = work.table(found.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b"), "near_heads")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of the pairs, those with the similarity, as edges (u, v)."""
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        rows = work.table(wanted.join(nodes, "node").select("node", F.col("low").alias("_low")), f"{name}_wanted")
        texts = docs.join(small(rows, 200_000), docs[id_col].eqNullSafe(rows["_low"])).groupBy("node").agg(F.first(F.col(text_col).cast("string")).alias("text"))
        texts = work.table(texts, f"{name}_texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

        def run(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = shingle_hashes(x, width), shingle_hashes(y, width)
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(len(x) + len(y) and shared >= similarity * (len(x) + len(y) - shared) - 1e-9))
                yield batch.select([0, 1]).rename_columns(["u", "v"]).filter(pa.array(keep, pa.bool_()))

        return work.table(both.select("a", "b", "ta", "tb").mapInArrow(run, "u long, v long"), name)

    # one link for each text first, then those of its heads that it is apart from, then lists that still hold texts apart
    links = verified(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "links1")
    root = work.table(connected_components(work, links, "cc1"), "roots1")
    rooted = lambda df, col: df.join(root.select(F.col("node").alias(col), F.col("root").alias(f"r{col}")), col, "left").withColumn(f"r{col}", F.coalesce(f"r{col}", col))
    more = work.table(rooted(rooted(found, "a"), "b").where("ra <> rb").select("a", "b"), "apart1")
    if not more.isEmpty():
        links = links.unionByName(verified(more, "links2"))
        root = work.table(connected_components(work, links, "cc2"), "roots2")
    at = work.table(members.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "at")
    split = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi and n > 2").select("key")
    split = work.table(split, "split")
    if not split.isEmpty():
        rest = work.table(at.join(small(split), "key", "left_semi").join(nodes.select("node", *lanes), "node"), "rest")
        cross = work.table(blocked(rest, near, lanes).distinct(), "cross")
        if not cross.isEmpty():
            links = links.unionByName(verified(cross, "links3"))
            root = work.table(connected_components(work, links, "cc3"), "roots3")
    named = nodes.join(root, "node", "left").select("digest", "low", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = work.table(named.join(least, "root").select("digest", "component_id"), "named")
    return each.join(named, "digest").select(id_col, "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", size: int | None = None) -> DataFrame:
    """Component of every document: id, fingerprint (16 hex digits), component_id, the smallest id reachable by links.

    Texts link if their fingerprints differ in at most 3 bits; equal fingerprints do, and so do all texts without words (null
    texts too), whose fingerprint is zero. Rows map one to one; repeated rows are in one component; a null id is no component's
    smallest unless there is no other (then component_id is null); other columns are ignored; empty in, empty out.
    """
    work = Workspace(docs.sparkSession, "simhash")
    each = work.table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    low = work.table(each.groupBy("fp").agg(F.min(id_col).alias("low")), "distinct")
    root = links(work, low.select("fp"), size)
    at = low.join(root, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = at.groupBy("root").agg(F.min("low").alias("component_id"))
    named = work.table(at.join(least, "root").select("fp", "component_id"), "named")
    return each.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
