"""Fuzzy line deduplication by MinHash, in DataFrame and SQL functions only.

Equal lines are collapsed first. A line's shingles are the runs of ``WIDTH`` characters from every position of it, whatever its
script or spaces. A shingle's hash deals it to one of ``BANDS`` classes, and a class's band of the signature is the smallest of
``ROWS`` hashes of its shingles: every shingle takes part in one band. Lines that agree on a band are candidates. Were all classes
as similar as the whole line, 8 bands of 3 rows would miss a pair of similarity 0.8 in 3 of 1000 cases; as they are not, one class
being more alike where another is less, fewer are missed, and of short lines, whose few different shingles leave most classes
equal, none (the tests measure this on lines). Every line of a band's bucket is compared with a few of them; then all lines of a
bucket that links have not joined are compared with each other, in very large buckets those that share one of their rarest shingles,
as any similar enough must. A pair whose sketches differ in more bits than such sets can differ in shingles is no link; of the others
the Jaccard similarity of all their shingles, as hashes of 64 bits, decides. Links are closed by distributed union-find, and of each component the first line (by
document, then place) stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, own_columns, quoted, read, small, Workspace

WIDTH, ROWS, BANDS, SIMILARITY = 9, 3, 8, 0.8
#: One of so many lines tells which shingles are common.
SAMPLE = 16
#: Shorter lines (in characters) are not compared. By default all lines but blank ones are.
MIN_CHARS = 1
#: Lines of each bucket that all its lines are compared with. They are the first in orders that all bands share, so that lines
#: that meet in many bands are compared with few lines.
HEADS = 3
#: In buckets of more lines than CROWD, all lines not yet joined with them are compared with so many lines more: of large groups of
#: similar lines that leaves few apart, whose pairs would grow with the square of the group.
CROWD, MORE = 64, 12
#: Words of 64 bits of a line's sketch.
WORDS = 32
#: Sketches are broadcast up to so many lines.
SKETCHES = 100_000
#: Lines of larger buckets that links leave apart are not compared by twos but by their rarest shingles.
WIDE = 2000


def characters(line):
    """The lower-cased line as four bytes for each character, so that any run of characters is cut out at once."""
    return F.encode(F.lower(line), "UTF-32")


def places(chars):
    """First characters of the runs of WIDTH characters of a line; a shorter line is one run, the whole of it."""
    return F.sequence(F.lit(0), F.greatest(F.octet_length(chars).cast("int") / 4 - WIDTH, F.lit(0)).cast("int"))


def shingle(chars, place):
    return F.xxhash64(F.substring(chars, place * 4 + 1, F.lit(4 * WIDTH)))


def shingle_set(low):
    """Distinct shingles of a lower-cased line, as texts. From each of the first WIDTH characters on, a pattern cuts the line in runs side
    by side: a lambda over all places takes eight times as long."""
    runs = [F.regexp_extract_all(F.substring(low, F.lit(i + 1), F.length(low)), F.lit(f"(?s).{{{WIDTH}}}"), F.lit(0)) for i in range(WIDTH)]
    return F.array_distinct(F.when(F.length(low) < WIDTH, F.array(low)).otherwise(F.flatten(F.array(*runs))))


def shingle_hashes(chars):
    """Distinct 64-bit hashes of the shingles of a line in four bytes a character. The outer lambda holds the characters: as a column they
    would be copied for each place, which takes seven times as long."""
    return F.array_distinct(F.flatten(F.transform(F.array(chars), lambda c: F.transform(places(c), lambda i: shingle(c, i)))))


def lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(_doc, _key, _no, line, line_id) of every line that can be a duplicate; _key tells documents apart that share an id."""
    text = F.col(quoted(text_col))
    d = docs.where(text.isNotNull()).select(F.col(quoted(id_col)).alias("_doc"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    d = d.select("_doc", "_key", F.posexplode(F.split("_text", "\n")).alias("_no", "line"))  # a second step, else the key is taken for each line
    return d.where((F.length("line") >= min_chars) & F.col("line").rlike(r"\S")).withColumn("line_id", F.xxhash64("line"))


def other_hash(line):
    """A second hash of a line: with line_id, 128 bits tell lines apart."""
    return F.xxhash64(F.lit(1), line)


def constants(n: int = ROWS) -> list[int]:
    """One odd factor below 2^31 for each row of a band: times a factor, modulo 2^31, permutes the 31-bit hashes of shingles."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 33 | 1)
    return out


def hashed(cut: DataFrame) -> DataFrame:
    """(line_id, x): the hash of the shingle at every place of lines (line_id, chars)."""
    # outer, as else a filter is made up that works the places out once more; they are never empty
    return cut.select("line_id", "chars", F.explode_outer(places(F.col("chars"))).alias("place")).select("line_id", shingle(F.col("chars"), F.col("place")).alias("x"))


def signatures(cut: DataFrame) -> DataFrame:
    """(line_id, band) of lines (line_id, chars): a line has a band of each class that it has shingles in."""
    cut = hashed(cut).select("line_id", F.expr(f"cast(pmod(x, {BANDS}) as int)").alias("class"), F.shiftrightunsigned("x", 33).alias("h"))
    signed = cut.groupBy("line_id", "class").agg(*[F.expr(f"min(h * {c}L & 2147483647L)").alias(f"m{i}") for i, c in enumerate(constants())])
    return signed.select("line_id", F.xxhash64("class", *[f"m{i}" for i in range(ROWS)]).alias("band"))


def sketches(cut: DataFrame) -> DataFrame:
    """(line_id, n, w0..) of lines (line_id, chars): n counts the different shingles; of the bits of the words each shingle sets the
    one that its hash names. Lines that are dealt by line_id are not moved."""
    sets = cut.select("line_id", shingle_hashes(F.col("chars")).alias("s")).select("line_id", F.size("s").cast("long").alias("n"), F.explode_outer("s").alias("x"))
    at = sets.select("line_id", "n", F.expr(f"cast(shiftrightunsigned(x, 9) & {WORDS - 1} as int)").alias("at"), F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 3) & 63 as int))").alias("bit"))
    # by eights first: as many columns as words make a method too long for the JVM to compile, so it is to see few rows
    each = at.groupBy("line_id", F.expr("at div 8").alias("part")).agg(F.max("n").alias("n"), *[F.expr(f"bit_or(if(at % 8 = {i}, bit, 0L))").alias(f"p{i}") for i in range(8)])
    return each.groupBy("line_id").agg(F.max("n").alias("n"), *[F.expr(f"bit_or(if(part = {i // 8}, p{i % 8}, 0L))").alias(f"w{i}") for i in range(WORDS)])


def packed(sketch: DataFrame) -> DataFrame:
    """A table with the words of sketches in one column w. As many columns make methods too long for the JVM to compile."""
    words = [f"w{i}" for i in range(WORDS)]
    return sketch.select(*[c for c in sketch.columns if c not in words], F.array(*words).alias("w"))


def near(a: str, b: str, threshold: float):
    """Whether lines can have the similarity, by their sizes and sketches in columns n and w with these prefixes. Sets of n and m shingles
    that do are of sizes at least so similar and differ by at most (1 - t) / (1 + t) (n + m) shingles, and a bit that one sketch alone has
    is of a shingle that one set alone has: no pair is lost."""
    sizes = f"least({a}n, {b}n) >= {threshold!r}D * greatest({a}n, {b}n) - 1e-9D"
    apart = f"aggregate(zip_with({a}w, {b}w, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(f"{sizes} and {apart} <= {(1 - threshold) / (1 + threshold)!r}D * ({a}n + {b}n) + 1e-9D")


def met(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those rows of a table by line_id that are in a pair (a, b): the others are not moved for the joins."""
    return table.join(small(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct()), "line_id", "left_semi")


def sketched(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) of line ids that can have the similarity by their sketches."""
    sketch = packed(met(sketch, pairs))
    for x in "ab":
        side = sketch.select(F.col("line_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in sketch.columns[1:]])
        pairs = pairs.join(small(side, SKETCHES), x)
    return pairs.where(near("a_", "b_", threshold)).select("a", "b")


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of line ids whose shingle sets (as hashes of 64 bits) have at least the Jaccard similarity; texts: (line_id, line).

    The sets are cut from the lines after the join: they are eight times as large as the lines."""
    texts = met(texts, pairs)
    left = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("la")), "a")
    both = left.join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("lb")), "b")
    both = both.select("a", "b", shingle_hashes(characters(F.col("la"))).alias("sa"), shingle_hashes(characters(F.col("lb"))).alias("sb"))
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    # as a generator, which the optimiser does not push down: a filter would work out the sets anew for every place
    fits = F.when(F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared")), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return both.select(F.col("a").alias("u"), F.col("b").alias("v"), F.explode_outer(fits).alias("fits")).where("fits = 1").select("u", "v")


def facing_heads(members: DataFrame, heads: DataFrame, root: DataFrame | None, sketch: DataFrame | None = None, threshold: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of the lines of buckets ``members`` (band, line_id) with their buckets' ``heads`` (band, head); where components ``root``
    (node, root) are given, only of lines in others than the head's, and each in the first bucket that both meet in: a large group that is
    joined by then makes no row, one that is not a row for each pair. With a ``sketch`` only pairs that can have the similarity by it are
    made: it is looked at in the join, so that a large group of lines that are not so alike makes no row either."""
    if root is None:
        pairs = members.join(small(heads), "band").where("line_id <> head")
    else:
        at = lambda df, x, r: df.join(small(root.select(F.col("node").alias(x), F.col("root").alias("_r"))), x, "left").withColumn(r, F.coalesce("_r", x)).drop("_r")
        sets = lambda df, x, s: df.join(df.groupBy(x).agg(F.collect_set("band").alias(s)), x)
        members = members.join(small(heads.select("band").distinct()), "band", "left_semi")
        left, right = at(sets(members, "line_id", "_in"), "line_id", "_a"), at(sets(heads, "head", "_of"), "head", "_b")
        fits = F.array_min(F.array_intersect("_in", "_of")) == left["band"]
        if sketch is not None:
            some = packed(sketch.join(small(members.select("line_id").distinct()), "line_id", "left_semi"))
            side = lambda x, p: some.select(F.col("line_id").alias(x), *[F.col(c).alias(f"{p}_{c}") for c in some.columns[1:]])
            left, right = left.join(side("line_id", "m"), "line_id"), right.join(side("head", "h"), "head")
            fits = fits & near("m_", "h_", threshold)
        pairs = left.join(right, (left["band"] == right["band"]) & (F.col("_a") != F.col("_b")) & fits)
    return pairs.select(F.least("head", "line_id").alias("a"), F.greatest("head", "line_id").alias("b"))


def facing(each: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the lines ``each`` (band, line_id, root, sketch) of one bucket with other roots that can have the similarity. Lines
    that share several buckets make a pair in the first of them only."""
    each = packed(each)
    each = each.join(each.groupBy("line_id").agg(F.collect_set("band").alias("bands")), "line_id")
    a, b = (each.select(F.col("band").alias(f"{x}_band"), *[F.col(c).alias(f"{x}_{c}") for c in each.columns if c != "band"]) for x in "ab")
    both = a.join(b, (F.col("a_band") == F.col("b_band")) & (F.col("a_root") < F.col("b_root")) & near("a_", "b_", threshold) & (F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("a_band")))
    return both.select(F.least("a_line_id", "b_line_id").alias("a"), F.greatest("a_line_id", "b_line_id").alias("b"))


def sharing(work: Workspace, left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of the lines ``left`` (line_id, root) with other roots that can reach the similarity, none that does missed.

    In any one order of all shingles such a pair shares one of the first n - ceil(threshold n) + 1 of n shingles of each. The order is by
    how many of every ``SAMPLE``-th line hold a shingle, then by its hash: any order is exact, and this one puts the common ones last
    without counting all. Where the first shared one stands in both bounds how many can be shared, which drops most pairs before
    they are made. A line's shingles are ranked where they are cut, so only the first ones are moved."""
    each = left.join(texts, "line_id").repartition("line_id").select("line_id", "root", shingle_hashes(characters(F.col("line"))).alias("s"))
    each = each.select("line_id", "root", F.size("s").alias("n"), F.explode_outer("s").alias("shingle"))
    common = each.where(F.pmod(F.xxhash64("line_id"), F.lit(SAMPLE)) == 0).groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    common = work.table(common, "common")
    by = Window.partitionBy("line_id").orderBy(F.coalesce("df", F.lit(0)), "shingle")
    ranked = each.join(small(common), "shingle", "left").withColumn("at", F.row_number().over(by) - 1)
    head = ranked.where(F.expr(f"at <= n - cast(ceil({threshold}D * n - 1e-9D) as int)"))
    head = work.table(head.select("line_id", "root", "n", "at", F.col("shingle").alias("key")), "heads_left")
    a, b = (head.select("key", F.col("line_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("root", "n", "at"))) for x in "ab")
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = most >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    return a.join(b, (a["key"] == b["key"]) & (F.col("root_a") < F.col("root_b")) & fits).select("a", "b")


def duplicate_lines(work: Workspace, docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, wide: int = WIDE) -> DataFrame:
    """(_doc, _key, gone): numbers of the lines to drop, for documents that lose any."""
    at = work.table(lines(docs, id_col, text_col, min_chars).select("_doc", "_key", "_no", "line_id", other_hash(F.col("line")).alias("other")), "at")
    # different lines under one id, as happens to a few of 10^11, are not compared: they stay
    torn = at.groupBy("line_id").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("line_id")
    torn = work.table(torn, "torn")
    whole = (lambda df: df) if torn.isEmpty() else (lambda df: df.join(small(torn), "line_id", "left_anti"))
    at = whole(at).drop("other")
    distinct = whole(lines(docs, id_col, text_col, min_chars)).groupBy("line_id").agg(F.first("line").alias("line"))
    cut = distinct.select("line_id", characters(F.col("line")).alias("chars"))
    entry = work.table(signatures(cut), "bands")
    work.release()

    heads = entry.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    members = work.table(entry.join(small(work.table(heads, "heads")), "band", "left_semi").select("band", "line_id"), "members")
    wanted = work.table(members.select("line_id").distinct(), "wanted")
    work.drop("bands")
    work.release()
    texts = lines(docs, id_col, text_col, min_chars).select("line_id", "line").join(small(wanted), "line_id", "left_semi")
    texts = work.table(texts.groupBy("line_id").agg(F.first("line").alias("line")), "texts")
    work.release()
    sketch = work.table(sketches(texts.repartition("line_id").select("line_id", characters(F.col("line")).alias("chars"))), "sketch")
    work.release()

    # every line of a bucket is compared with the bucket's heads: reversible orders give them in one hash aggregation
    def first_ones(df, masks):
        each = df.groupBy("band").agg(F.count("*").alias("n"), *[F.min(F.col("line_id").bitwiseXOR(F.lit(m).cast("long"))).alias(f"h{i}") for i, m in enumerate(masks)])
        return each.select("band", "n", F.array_distinct(F.array(*[F.col(f"h{i}").bitwiseXOR(F.lit(m).cast("long")) for i, m in enumerate(masks)])).alias("heads"))

    masks = [c << 32 for c in constants(HEADS + MORE)]
    heads = F.when(F.col("n") > 2, F.col("heads")).otherwise(F.slice("heads", 1, 1))
    split = work.table(first_ones(members, masks[:HEADS]).select("band", "n", heads.alias("heads")), "split")
    against = split.select("band", F.posexplode("heads").alias("at", "head"))
    crowded = members.join(small(split.where(F.col("n") > CROWD).select("band")), "band", "left_semi")
    against = against.unionByName(first_ones(crowded, masks[HEADS:]).select("band", F.lit(HEADS).alias("at"), F.explode("heads").alias("head")))
    against = work.table(against, "against")
    # with the first head first; with the others only lines that are not yet in its component
    root, found = None, None
    for first in (True, False):
        if not first and against.where("at > 0").isEmpty():
            break
        pairs = facing_heads(members, against.where("at = 0" if first else "at > 0").select("band", "head"), root, sketch, threshold).distinct()
        if first:
            pairs = sketched(work.table(pairs, "asked"), sketch, threshold)
        more = work.table(similar(work.table(pairs, f"pairs{int(first)}"), texts, threshold), f"links{int(first)}")
        work.drop("asked")
        work.release()
        if not first and more.isEmpty():
            break
        found = more if first else root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
        root = work.table(connected_components(work, found, f"cc{int(first)}_"), f"roots{int(first)}")

    # buckets with two lines or more beside the heads may hold lines that are still apart
    open_bands = work.table(split.where("n - size(heads) > 1").select("band"), "open")
    placed = members.join(small(open_bands), "band", "left_semi").join(small(root), F.col("line_id") == F.col("node"), "left").select("band", "line_id", F.coalesce("root", "line_id").alias("root"))
    placed = work.table(placed, "placed")
    apart = work.table(placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n"), "apart")
    each = placed.join(small(apart.where(F.col("n") <= wide).select("band")), "band", "left_semi")
    each = each.join(small(sketch.join(small(each.select("line_id").distinct()), "line_id", "left_semi"), SKETCHES), "line_id")
    left = work.table(placed.join(small(apart.where(F.col("n") > wide).select("band")), "band", "left_semi").select("line_id", "root").distinct(), "left")
    pairs = facing(work.table(each, "facing"), threshold)
    if not left.isEmpty():
        pairs = pairs.unionByName(sketched(work.table(sharing(work, left, texts, threshold).distinct(), "shared"), sketch, threshold))
    more = work.table(similar(work.table(pairs.distinct(), "pairs_left"), texts, threshold), "links_left")
    for name in ("facing", "sketch"):
        work.drop(name)
    work.release()
    if not more.isEmpty():
        root = work.table(connected_components(work, root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more), "cc_left"), "roots")

    # each component's first place; lines without a component are their own
    first = at.groupBy("line_id").agg(F.min(F.struct("_doc", "_key", "_no")).alias("first"), F.count("*").alias("n"))
    many = first.join(small(root), F.col("line_id") == F.col("node"), "left")
    many = work.table(many.where("n > 1 or root is not null").select("line_id", "first", F.coalesce("root", "line_id").alias("root")), "many")
    kept = many.groupBy("root").agg(F.min("first").alias("kept"))
    names = work.table(many.join(kept, "root").select("line_id", "kept"), "kept")
    gone = at.select("_doc", "_key", "_no", "line_id").join(small(names, 300_000), "line_id").where(~F.struct("_doc", "_key", "_no").eqNullSafe(F.col("kept")))
    return work.table(gone.groupBy("_doc", "_key").agg(F.sort_array(F.collect_set("_no")).alias("gone")), "gone")


def dedup(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of the text, and n_lines, n_dropped beside its columns (one row for each).

    Lines are what line feeds part; a line stays if it is blank or shorter than ``min_chars``, or is its component's first (by id,
    a hash of the text, number; null ids first). Rows that repeat both id and text are one document: they lose the same lines. A
    null text has no lines and stays null; a text whose lines all go becomes empty. Other columns stay as they are, but for ones
    named n_lines or n_dropped, which are replaced. Empty in, empty out. No row is dropped.
    """
    work = Workspace(docs.sparkSession, "lines")
    gone = duplicate_lines(work, docs, threshold, id_col, text_col, min_chars)
    held, back = own_columns(docs, ("n_lines", "n_dropped"))
    d = docs.select(*held, F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"), F.xxhash64(F.col(quoted(text_col))).alias("_k"))
    d = d.join(small(gone, 300_000), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_k") == F.col("_key")), "left")
    every = F.split("_text", "\n")
    text = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(every, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(every)).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return d.select(*[text.alias(c) if c == text_col else k for c, k in zip(names, back, strict=True)], n_lines.alias("n_lines"), n_gone.alias("n_dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and the digest of the text that is left."""
    found = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
