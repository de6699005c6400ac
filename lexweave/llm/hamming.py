"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments; an index lists the codes under each segment's value. In round r a query looks up all
values within r bits of its own segments' values, and what it meets is verified by the full distance. A code at distance d has
some segment within d div (number of segments) bits, so after round r every code nearer than segments x (r + 1) has been met: a
query is done once its k-th verified distance is under that. Rounds go on for the others.

Copies are collapsed: the index holds distinct codes, each with its k smallest ids (all that a top-k can use).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, small, Workspace

K, BITS = 10, 64


def sign_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit i of the code is set if component i is over zero; components past the 64th are left out, absent ones, nulls
    and NaN count as zero bits (a NaN is not over zero). Rows with a null id or vector have no code."""
    bits = f"transform(slice(`{vector_col}`, 1, {BITS}), (x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L))"
    code = F.expr(f"aggregate({bits}, 0L, (a, b) -> a | b)")
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def segments(n: int) -> int:
    """Segments of 8 or 16 bits: values of a segment stay few enough to be listed, at any number of codes."""
    return 8 if n < 1 << 9 else 4


def flips(width: int, r: int):
    """The values of ``width`` bits (16 at most) with r bits set, as a constant array."""
    return F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), x -> bit_count(x) = {r})")


def search(codes: DataFrame, queries: DataFrame, k: int = K, m: int | None = None) -> DataFrame:
    """The k nearest of ``codes`` (id, code) to each of ``queries`` (id, code): query_id, rank, neighbor_id, distance.

    By distance, then id. A query that is itself a row of ``codes`` finds itself. Fewer than k rows come only if there are fewer
    codes. Queries with the same id and code are one query. Rows that repeat an id with the same code are one row.
    """
    work = Workspace(codes.sparkSession, "hamming")
    codes = codes.distinct()
    first = F.row_number().over(Window.partitionBy("code").orderBy("id"))  # limited in each task before the shuffle
    keep = codes.withColumn("_r", first).where(F.col("_r") <= k)
    listed = work.table(keep.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    n = listed.count()
    m = m or segments(n)
    width = BITS // m
    mask = (1 << width) - 1
    value = lambda s: f"(shiftrightunsigned(code, {s * width}) & {mask}L)"
    asked = work.table(queries.distinct().where("code is not null"), "asked")
    index = work.table(listed.select("code", "ids", F.posexplode(F.array(*[F.expr(value(s)) for s in range(m)])).alias("seg", "val")), "index")
    open_q = work.table(asked.select("code", F.lit(None).cast("int").alias("far")).distinct(), "open0")
    best = work.table(open_q.select(F.col("code").alias("q"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("d")).where("false"), "best0")
    done = []
    # (radius, segments): small radii at once, larger ones a segment at a time, as each is dearer than all before
    steps = [(r, segs) for r in range(width + 1) for segs in ([range(m)] if r < 2 else [[s] for s in range(m)])]
    apart = lambda s: f"bit_count(shiftrightunsigned(q ^ code, {s * width}) & {mask}L)"
    for i, (r, segs) in enumerate(steps):
        covered = m * r + segs[-1] + 1  # codes nearer than this have been met
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.expr(value(s)).alias("val")) for s in segs])).alias("own")
        probes = open_q.select(F.col("code").alias("q"), "far", own).select("q", "far", "own.seg", "own.val", F.explode(flips(width, r)).alias("flip"))
        probes = probes.select("q", "far", "seg", F.expr("val ^ flip").alias("val"))
        # verified in the join: met by no step before (a nearer segment, or one as near and earlier), and no farther than the k-th yet
        new = " and ".join(f"({apart(s)} > {r} or {apart(s)} = {r} and {s} >= seg)" for s in range(m))
        probes = probes.withColumnRenamed("seg", "at").withColumnRenamed("val", "probe")
        rows = index.hint("merge").join(probes, F.expr(f"seg = at and val = probe and {new} and (far is null or bit_count(q ^ code) <= far)"))
        met = rows.select("q", "code", "ids", F.expr("cast(bit_count(q ^ code) as int)").alias("d"))
        # of the codes, the k first by distance and smallest id hold the k first rows
        met = met.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", F.col("ids")[0]))).where(F.col("_r") <= k)
        both = best.unionByName(met.select("q", F.explode("ids").alias("id"), "d"))
        best = work.table(both.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("_r") <= k).drop("_r"), f"best{i + 1}")
        have = best.groupBy("q").agg(F.count("*").alias("n"), F.max("d").alias("kth"))
        have = work.table(have.select("q", F.expr(f"if(n >= {k}, kth, null)").alias("kth")), f"have{i}")
        sure = have.where(F.expr(f"kth < {covered}") | F.lit(i == len(steps) - 1)).select("q")
        done.append(best.join(small(sure), "q", "left_semi"))
        left = open_q.drop("far").join(small(have), F.col("code") == F.col("q"), "left").where(F.lit(i < len(steps) - 1) & F.expr(f"kth is null or kth >= {covered}"))
        open_q = work.table(left.select("code", F.col("kth").alias("far")), f"open{i + 1}")
        if open_q.isEmpty():
            break
        best = best.join(small(sure), "q", "left_anti")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "id")))
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(found, "q").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("neighbor_id"), F.col("d").cast("int").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with an id divisible by 50, against all vectors (itself among them)."""
    codes = sign_codes(read(spark, sf_dir, "embeddings"))
    codes = Workspace(spark, "codes").table(codes, "codes")
    return search(codes, codes.where("id % 50 = 0"))


ORACLE_SQL = f"""
with c as (select distinct vec_id as id, [case when x > 0 and not isnan(x) then 1 else 0 end for x in embedding[1:{BITS}]] as bits from embeddings where vec_id is not null and embedding is not null),
p as (select q.id as query_id, c.id as neighbor_id, cast(list_sum([abs(z[1] - z[2]) for z in list_zip(q.bits, c.bits)]) as integer) as distance from c q, c where q.id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by distance, neighbor_id) as integer) as rank from p)
select query_id, rank, neighbor_id, distance from r where rank <= {K}
"""
