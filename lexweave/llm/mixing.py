"""Mixing sources to target weights by hierarchical budgets.

Weights go down a tree of domain, language and source. At each node the budget is split among the children by weight, and a
child gets at most what its leaves can give (``epochs`` times their tokens); what one cannot take goes to its siblings first,
and only what none of them can take is left for the siblings of their parent. Each level is one exact water-filling in whole
tokens. A leaf takes its budget as whole epochs, and as the token-prefix of one more epoch in an order seeded by its number.

Documents are dealt into buckets of that order by their hash. Sums by bucket are pre-aggregated; the buckets below the one
that the prefix ends in are taken whole, and only that bucket's documents are sorted, so a leaf with a third of all rows is
never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_columns, read, small, Workspace

SEED, EPOCHS, BUCKETS = 17, 4, 4096
LEVELS = ("domain", "lang", "source")
#: Domains of the corpus' sources in the query: by the last digit of the source's name.
DOMAIN_SQL = "case when source is null then 'unknown' when right(source, 1) in ('0', '1', '2', '3') then 'web' when right(source, 1) in ('4', '5', '6') then 'books' else 'forum' end"
DOMAIN_WEIGHTS = {"web": 50, "books": 30, "forum": 20}
LANG_WEIGHTS = {"en": 40, "de": 20, "es": 20, "fr": 20}
#: The query's budget, as a share of all tokens in percent.
SHARE = 60


def n_words(text):
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x09-\\x0D\\x20]+")).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str, out: str) -> DataFrame:
    """Exact water-filling among the children of each parent: columns weight, room (tokens the child can take), budget (the
    parent's). ``out``: whole tokens, at most room, whose sum is the lesser of budget and all room. Children are capped in order
    of room a weight; the rest share by weight, leftover tokens going to the largest fractions, then by name."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.expr("room / weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumn("_b", F.least("budget", F.sum("room").over(by)))
    n = n.withColumn("_c", F.coalesce(F.sum("room").over(order), F.lit(0)))
    n = n.withColumn("_w", F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    n = n.withColumn("_full", F.expr("cast(room as decimal(38,0)) * _w <= cast(_b - _c as decimal(38,0)) * weight"))
    n = n.withColumn("_left", F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("room"))).over(by), F.lit(0)))
    n = n.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(by))
    n = n.withColumn("_share", F.expr("case when _full then room else cast(floor(cast(_left as decimal(38,0)) * weight / _open) as long) end"))
    n = n.withColumn("_frac", F.expr("case when _full then -1 else cast((cast(_left as decimal(38,0)) * weight) % _open as long) end"))
    n = n.withColumn("_extra", F.col("_b") - F.sum("_share").over(by))
    rank = F.row_number().over(by.orderBy(F.col("_frac").desc(), name))
    n = n.withColumn(out, F.col("_share") + (rank <= F.col("_extra")).cast("long"))
    return n.drop("_b", "_c", "_w", "_full", "_left", "_open", "_share", "_frac", "_extra", "budget")


def budgets(leaves: DataFrame, total, weights: dict[str, dict[str, int]], epochs: int = EPOCHS) -> DataFrame:
    """Leaf budgets: ``leaves`` has domain, lang, source, tokens; ``total`` is a column of tokens; ``weights`` gives
    whole numbers over 0 by level and name (others: 1). Adds quota. One row a leaf, whatever the number of documents."""
    spark = leaves.sparkSession
    room = leaves.withColumn("room", F.col("tokens") * epochs)

    def weigh(df: DataFrame, level: str) -> DataFrame:
        rows = list(weights.get(level, {}).items())
        table = spark.createDataFrame(rows or [("", 1)], "_name string, _weight long")
        return df.join(F.broadcast(table), F.col(level) == F.col("_name"), "left").withColumn("weight", F.coalesce("_weight", F.lit(1))).drop("_name", "_weight")

    top = weigh(room.groupBy("domain").agg(F.sum("room").alias("room")), "domain").withColumn("budget", total)
    top = _fill(top, [], "domain", "quota").select("domain", F.col("quota").alias("budget"))
    mid = weigh(room.groupBy("domain", "lang").agg(F.sum("room").alias("room")), "lang").join(top, "domain")
    mid = _fill(mid, ["domain"], "lang", "quota").select("domain", "lang", F.col("quota").alias("budget"))
    low = weigh(room, "source").join(mid, ["domain", "lang"])
    return _fill(low, ["domain", "lang"], "source", "quota").select(*LEVELS, "tokens", "quota")


def mix(docs: DataFrame, share: int = SHARE, weights: dict | None = None, domain: str = DOMAIN_SQL, epochs: int = EPOCHS, seed: int = SEED, buckets: int = BUCKETS, full: bool = False) -> DataFrame:
    """Documents selected under the budgets: doc_id, domain, lang, source, n_tokens, epochs (times taken whole), part_tokens.

    The budget is ``share`` percent of all tokens (words between ASCII white space). A document of a leaf with quota q and T
    tokens is taken q div T times whole; in the last epoch documents come in the order of the hash of (seed, epoch, doc_id),
    then doc_id, n_tokens, and are taken while tokens of the remainder are left; of the last one ``part_tokens`` says how many of
    its first tokens are. Documents without tokens (null or empty texts) are never taken. A null lang or source counts as
    'unknown', a null doc_id as -1 in the order. Repeated rows are rows of their own. ``full``: the columns of ``docs`` and then
    epochs and part_tokens. Empty in, empty out.
    """
    work = Workspace(docs.sparkSession, "mixing")
    weights = weights if weights is not None else {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    held, back = own_columns(docs, ("epochs", "part_tokens"))
    keys = ["_domain", "_lang", "_source"]
    named = docs.select(
        *held, F.col("doc_id"), F.expr(domain).alias("_domain"), F.coalesce("lang", F.lit("unknown")).alias("_lang"),
        F.coalesce("source", F.lit("unknown")).alias("_source"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"),
        F.col("text").cast("string").alias("_text"),
    ).where(F.col("_text").rlike("[^\\x09-\\x0D\\x20]"))
    # words are counted once; sums and orders come from this narrow table
    count = work.table(named.select("doc_id", *keys, "_id", n_words(F.col("_text")).alias("_n")), "counted")
    leaf = count.groupBy(*keys).agg(F.sum("_n").alias("tokens")).select(*(F.col(k).alias(k[1:]) for k in keys), "tokens")
    leaf = work.table(leaf, "leaves")
    total = leaf.agg(F.expr(f"coalesce(sum(tokens), 0) * {int(share)} div 100").alias("t")).first().t
    quota = work.table(budgets(leaf, F.lit(total).cast("long"), weights, epochs).select(
        *LEVELS, "quota", F.expr("quota div tokens").alias("epochs"), F.expr("quota % tokens").alias("rest")), "quotas")
    q = quota.select(*(F.col(k).alias(f"_{k}") for k in LEVELS), F.col("epochs").alias("_epochs"), F.col("rest").alias("_rest"))

    def placed(df: DataFrame) -> DataFrame:
        hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "_epochs", "_id")), 1, 14), 16, 10).cast("long")
        return df.join(small(q), keys).withColumn("_h", hashed).withColumn("_bucket", F.expr(f"_h div {(1 << 56) // buckets}"))

    d = placed(count)
    sums = work.table(d.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_sum"), F.first("_rest").alias("_rest")), "buckets")
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket"))
    edge = sums.withColumn("_upto", before).where("_upto > _rest").groupBy(*keys).agg(F.expr("min_by(struct(_bucket as edge, _upto - _sum as before), _bucket)").alias("_e"))
    edge = work.table(edge.select(*keys, F.col("_e.edge").alias("_edge"), F.col("_e.before").alias("_before")), "edges")
    run = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_h", "_id", "_n").rowsBetween(Window.unboundedPreceding, 0))

    def parted(df: DataFrame) -> DataFrame:
        """Rows with their part; every leaf has an edge, as rest < tokens."""
        at = df.join(small(edge), keys)
        flat = at.where("_bucket < _edge or _bucket > _edge and _epochs > 0").withColumn("_part", F.expr("case when _bucket < _edge then _n else 0L end"))
        cut = at.where("_bucket = _edge").withColumn("_run", run)
        cut = cut.withColumn("_part", F.expr("greatest(0L, least(_n, _rest - _before - (_run - _n)))")).drop("_run")
        return flat.unionByName(cut.where("_epochs > 0 or _part > 0"))

    more = [F.col("_epochs").alias("epochs"), F.col("_part").alias("part_tokens")]
    if not full:
        return parted(d).select("doc_id", *(F.col(k).alias(k[1:]) for k in keys), F.col("_n").alias("n_tokens"), *more)
    # whole rows: words are only counted again of those that are taken as a whole or stand in the edge's bucket
    rows = placed(named).join(small(edge), keys).where("_epochs > 0 or _bucket <= _edge")
    held_n = rows.withColumn("_n", n_words(F.col("_text"))).drop("_edge", "_before", "_text")
    return parted(held_n).select(*back, *more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def oracle(docs: str = "documents", columns: str = "doc_id, domain, lang, source, n_tokens, epochs, part_tokens", ctes: str = "") -> str:
    """The same selection as one DuckDB statement over the relation ``docs``."""

    def weights(level: str, table: dict[str, int]) -> str:
        return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 1 end" if table else "1"

    def fill(name: str, source: str, parent: str, child: str, weight: str) -> str:
        by = f"partition by {parent}" if parent else ""
        head = f"{parent}, {child}" if parent else child
        return f"""
{name}1 as (select *, {weight} as weight from ({source})),
{name}2 as (select *, least(budget, sum(room) over ({by})) as b, coalesce(sum(room) over ({by} order by room / weight, {child} rows between unbounded preceding and 1 preceding), 0) as c,
  sum(weight) over ({by}) - coalesce(sum(weight) over ({by} order by room / weight, {child} rows between unbounded preceding and 1 preceding), 0) as w from {name}1),
{name}3 as (select *, room::hugeint * w <= (b - c)::hugeint * weight as filled from {name}2),
{name}4 as (select *, b - coalesce(sum(case when filled then room end) over ({by}), 0) as rest_, sum(case when not filled then weight end) over ({by}) as open_ from {name}3),
{name}5 as (select *, case when filled then room else (rest_::hugeint * weight) // open_ end as share_, case when filled then -1 else (rest_::hugeint * weight) % open_ end as frac_ from {name}4),
{name}6 as (select *, b - sum(share_) over ({by}) as extra_, row_number() over ({by} order by frac_ desc, {child}) as rank_ from {name}5),
{name} as (select {head}, (share_ + case when rank_ <= extra_ then 1 else 0 end)::bigint as quota from {name}6)"""

    return f"""
with {ctes} d0 as (select *, row_number() over () as _r, {DOMAIN_SQL} as domain, coalesce(lang, 'unknown') as _lang, coalesce(source, 'unknown') as _source,
  coalesce(doc_id, -1) as _id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D\\x20]+')) as bigint) as n_tokens from {docs}),
d as (select * from d0 where n_tokens > 0),
leaf as (select domain, _lang as lang, _source as source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * {EPOCHS})::bigint as room from d group by all),
{fill("f1", f"select domain, sum(room)::bigint as room, (select (coalesce(sum(tokens), 0) * {SHARE}) // 100 from leaf)::bigint as budget from leaf group by domain", "", "domain", weights("domain", DOMAIN_WEIGHTS))},
{fill("f2", "select l.domain, l.lang, sum(l.room)::bigint as room, any_value(f1.quota) as budget from leaf l join f1 using (domain) group by l.domain, l.lang", "domain", "lang", weights("lang", LANG_WEIGHTS))},
{fill("f3", "select l.domain, l.lang, l.source, l.room, f2.quota as budget from leaf l join f2 using (domain, lang)", "domain, lang", "source", "1")},
q as (select f3.*, tokens, quota // tokens as epochs, quota % tokens as rest from f3 join leaf using (domain, lang, source)),
o as (select d.*, q.epochs, q.rest, ('0x' || substr(md5('{SEED}:' || q.epochs::varchar || ':' || d._id::varchar), 1, 14))::bigint as h
  from d join q on d.domain = q.domain and d._lang = q.lang and d._source = q.source),
r as (select *, sum(n_tokens) over (partition by domain, _lang, _source order by h, _id, n_tokens rows between unbounded preceding and current row) as upto from o),
s as (select * exclude (lang, source), _lang as lang, _source as source, lang as own_lang, source as own_source, greatest(0, least(n_tokens, rest - (upto - n_tokens)))::bigint as part_tokens from r)
select {columns} from s where epochs > 0 or part_tokens > 0
"""


ORACLE_SQL = oracle()
