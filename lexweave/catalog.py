"""Registry of the engine's queries and of their DuckDB counterparts, over documents and conversations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import deps, evaluate, ngrams, packed, passage, spell
from .plans import decoders as D
from .sources import corpora
from .sources.tables import dealt, held, spread
from .streaming import editor

FLAGSHIP = "trigram_document_perplexity"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Words of a decoder's tables at most, checked; larger models are pruned by count first. N-grams are held as numbers, 12 bytes each.
LOCAL_ROWS = 3_000_000


TOKEN_SQL = T.TOKEN[1:-1].replace("'", "''")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def sents(spark: SparkSession, d: str, lang: str | None = "en", least: int = 1) -> DataFrame:
    return ngrams.sentences(docs(spark, d), lang, least)


def tokens(s: DataFrame) -> DataFrame:
    return s.select("doc_id", "sent_no", F.posexplode("words").alias("pos", "word"))


WORDS_SQL = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '\p{{L}}'))"
S = rf"""s0 as (select doc_id, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as sent_no from (select doc_id, regexp_split_to_array(text, '[.!?]+\s+|\n') as p from documents where lang = 'en' and text is not null)),
s as (select doc_id, sent_no, {WORDS_SQL.format("sentence")} as words from s0), se as (select * from s where len(words) > 0),
tok as (select doc_id, sent_no, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from se)"""
UNI = "uni as (select word, count(*) as n from tok group by word), st as (select count(*) + 1 as v, sum(n) as total from uni)"


def gram_sql(n: int, pad: int | None = None, source: str = "se", keys: str = "doc_id, sent_no") -> str:
    pad = n - 1 if pad is None else pad
    head = "[" + ", ".join(["'<s>'"] * pad) + "] || " if pad else ""
    cols = ", ".join(f"p[i + {j}] as w{j + 1}" for j in range(n))
    return f"select {keys}, {cols} from (select {keys}, p, unnest(range(1, len(p) - {n} + 2)) as i from (select {keys}, {head}words || ['</s>'] as p from {source}))"


@query(rf"with t as (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}') as t from documents) select doc_id, cast(coalesce(len(t), 0) as bigint) as n_tokens, md5(array_to_string(coalesce(t, []), ' ')) as digest from t")
def tokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", F.coalesce(T.tokenize(F.col("text")), F.array().cast("array<string>")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"""with t as (select unnest(string_split(text, ' ')) as w from documents)
select cast(count(*) as bigint) as n, cast(sum(case when regexp_full_match(w, '[\p{L}\p{N}_]+') and regexp_matches(w, '\p{L}') then 1 else 0 end) as bigint) as n_word,
cast(sum(case when regexp_full_match(lower(trim(w)), '[a-z]+(?:''[a-z]+)?') then 1 else 0 end) as bigint) as n_ascii,
cast(sum(case when len(w) >= 2 or w in ('a', 'i') then 1 else 0 end) as bigint) as n_usable from t""")
def word_predicates(spark: SparkSession, d: str) -> DataFrame:
    w = docs(spark, d).select(F.explode(F.split("text", " ")).alias("w"))
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    return w.agg(F.count("*").alias("n"), n(T.is_word(F.col("w")), "n_word"), n(T.is_ascii_word(F.col("w")), "n_ascii"), n(T.usable_word(F.col("w")), "n_usable"))


@query(rf"""with t as (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}') as t from documents), e as (select doc_id, unnest(t) as x, generate_subscripts(t, 1) as i from t),
g as (select doc_id, i, case when i = 1 or x in ('.', ',', '!', '?', ';', ':', ')', ']', '}}', '''', '"') or right(lag(x) over (partition by doc_id order by i), 1) in ('(', '[', '{{', '"') then x else ' ' || x end as x from e)
select doc_id, md5(coalesce(string_agg(x, '' order by i), '')) as digest from t left join g using (doc_id) group by doc_id""")
def detokenize_documents(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(F.coalesce(T.detokenize(T.tokenize(F.col("text"))), F.lit(""))).alias("digest"))


@query(f"with {S} select word, cast(count(*) as bigint) as n from tok group by word")
def unigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens(sents(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


for _n in (2, 3):
    _cols = [f"w{i + 1}" for i in range(_n)]

    def _grams(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return ngrams.fit(sents(spark, d), n).table

    QUERIES[f"{'bi' if _n == 2 else 'tri'}gram_counts"] = _grams
    ORACLE_SQL[f"{'bi' if _n == 2 else 'tri'}gram_counts"] = (
        f"with {S}, g as ({gram_sql(_n)}), c as (select {', '.join(_cols)}, count(*) as n from g group by all) "
        f"select {', '.join(_cols)}, cast(n as bigint) as n, cast(sum(n) over (partition by {', '.join(_cols[:-1])}) as bigint) as c from c"
    )


@query(f"with {S}, {UNI} select cast(v as bigint) as v, cast(total as bigint) as total from st")
def vocab_stats(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.fit(sents(spark, d), 2).stats


PPL = r"""g as ({grams}), c3 as (select {cols}, count(*) as n from g group by all), c2 as (select {ctx}, sum(n) as c from c3 group by all),
lp as (select {keys}, count(*) - 1 as n_words, sum(ln((coalesce(c3.n, 0) + {k}::double) / (coalesce(c2.c, 0) + {k}::double * v))) as logprob from g left join c3 using ({cols}) left join c2 using ({ctx}), st group by all)"""


@query(rf"""with sd as (select doc_id, {WORDS_SQL.format("text")} as words from documents where lang = 'en' and text is not null), se as (select * from sd where len(words) > 0),
tok as (select unnest(words) as word from se), {UNI}, {PPL.format(grams=gram_sql(3, keys="doc_id"), cols="w1, w2, w3", ctx="w1, w2", keys="doc_id", k=0.1)}
select doc_id, cast(n_words as bigint) as n_words, round(logprob / (n_words + 1), 6) as logprob_per_token from lp""")
def trigram_document_perplexity(spark: SparkSession, d: str) -> DataFrame:
    p = ngrams.document_perplexity(docs(spark, d))
    return p.select("doc_id", "n_words", F.round(F.col("logprob") / (F.col("n_words") + 1), 6).alias("logprob_per_token"))


@query(rf"""with {S}, {UNI}, {PPL.format(grams=gram_sql(2), cols="w1, w2", ctx="w1", keys="doc_id, sent_no", k=0.1)}
select doc_id, sent_no, cast(n_words as bigint) as n_words, round(logprob, 4) as logprob, round(exp(-logprob / (n_words + 1)), 2) as perplexity from lp""")
def sentence_perplexity(spark: SparkSession, d: str) -> DataFrame:
    s = sents(spark, d)
    p = ngrams.perplexity(ngrams.fit(s, 2), s)
    return p.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "n_words", F.round("logprob", 4).alias("logprob"), F.round("perplexity", 2).alias("perplexity"))


SPLIT = "('0x' || substr(md5('7:' || {0}), 1, 8))::bigint % 10"


def sweep_sql(n: int) -> str:
    cols = ", ".join(f"w{i + 1}" for i in range(n))
    ctx = ", ".join(f"w{i + 1}" for i in range(n - 1))
    return rf"""g{n} as ({gram_sql(n, source="tr")}), c{n} as (select {cols}, count(*) as n from g{n} group by all), x{n} as (select {ctx}, sum(n) as c from c{n} group by all),
q{n} as ({gram_sql(n, source="dv")}), p{n} as (select k, exp(-sum(ln((coalesce(c{n}.n, 0) + k) / (coalesce(x{n}.c, 0) + k * v))) / count(*)) as perplexity from q{n} left join c{n} using ({cols}) left join x{n} using ({ctx}), st, ks group by k)"""


SWEEP = rf"""with {S}, b as (select *, {SPLIT.format("md5(array_to_string(words, ' '))")} as b from se), tr as (select * from b where b < 8), tt as (select unnest(words) as word from tr), dv as (select * from b where b >= 8),
u as (select word, count(*) as n from tt group by word), st as (select count(*) + 1 as v from u), ks as (select unnest([0.001, 0.01, 0.05, 0.1, 0.5, 1.0])::double as k), {sweep_sql(2)}, {sweep_sql(3)}"""


@query(SWEEP + " select k, round(perplexity, 2) as perplexity from p3")
def k_sweep_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.tune(_train(spark, d), _held_out(spark, d).select("words"), 3).select("k", F.round("perplexity", 2).alias("perplexity"))


@query(SWEEP + " select 2::bigint as n, arg_min(k, (perplexity, k)) as k, round(min(perplexity), 2) as perplexity from p2 union all select 3::bigint, arg_min(k, (perplexity, k)), round(min(perplexity), 2) from p3")
def tuned_k(spark: SparkSession, d: str) -> DataFrame:
    """The k of the least held-out perplexity (of equals the smaller) for bigrams and trigrams."""
    train, dev = _train(spark, d), _held_out(spark, d).select("words")
    best = [ngrams.tune(train, dev, n).agg(F.expr("min_by(k, struct(perplexity, k))").alias("k"), F.round(F.min("perplexity"), 2).alias("perplexity")).select(F.lit(n).cast("long").alias("n"), "k", "perplexity") for n in (2, 3)]
    return best[0].unionByName(best[1])


@query(rf"""with {S}, u0 as (select word, count(*) as n from tok group by word), u as (select * from u0 union all select '</s>', count(*) from se), st as (select count(*) as v, sum(n) as total from u),
g3 as ({gram_sql(3, 2)}), g2 as ({gram_sql(2, 2)}), c3 as (select w1, w2, w3, count(*) as n3 from g3 group by all), x3 as (select w1, w2, sum(n3) as x3 from c3 group by all),
c2 as (select w1 as w2, w2 as w3, count(*) as n2 from g2 group by all), x2 as (select w2, sum(n2) as x2 from c2 group by all), u3 as (select word as w3, n as n1 from u),
p as (select doc_id, sent_no, ln(0.6::double * ((coalesce(n3, 0) + 0.1::double) / (coalesce(x3, 0) + 0.1::double * v)) + 0.3::double * ((coalesce(n2, 0) + 0.1::double) / (coalesce(x2, 0) + 0.1::double * v)) + 0.1::double * ((coalesce(n1, 0) + 0.1::double) / (total + 0.1::double * v))) as x
  from g3 left join c3 using (w1, w2, w3) left join x3 using (w1, w2) left join c2 using (w2, w3) left join x2 using (w2) left join u3 using (w3), st)
select doc_id, sent_no, round(sum(x), 4) as logprob from p group by all""")
def interpolated_score(spark: SparkSession, d: str) -> DataFrame:
    s = sents(spark, d)
    return ngrams.interpolated(s, s).select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), F.round("logprob", 4).alias("logprob"))


DELS = "list_distinct([substr({0}, 1, i - 1) || substr({0}, i + 1) for i in range(1, len({0}) + 1)])"
VOCAB = f"with {S}, {UNI}, v as (select word, n from uni where regexp_full_match(word, '[a-z]+')), x as (select word as q from v)"
ODD = f"with {S}, {UNI}, v as (select word, n from uni where n >= 2 and regexp_full_match(word, '[a-z]+')), x as (select word as q from uni where n = 1 and regexp_full_match(word, '[a-z]+'))"
CAND = f"""pk as (select q, unnest(list_distinct([q] || {DELS.format("q")})) as key from x), vk as (select word, unnest(list_distinct([word] || {DELS.format("word")})) as key from v),
cand as (select distinct q as word, word as candidate from pk join vk using (key) where q <> word and damerau_levenshtein(q, word) <= 1)"""


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return tokens(sents(spark, d)).groupBy(F.col("word").alias("w")).agg(F.count("*").alias("n")).where("w rlike '^[a-z]+$'")


@query(VOCAB + f", k as (select word, unnest(list_distinct([word] || {DELS.format('word')})) as key from v) select key, word from k")
def deletion_index(spark: SparkSession, d: str) -> DataFrame:
    return spell.delete_index(_vocab(spark, d).select(F.col("w").alias("word")))


@query(VOCAB + ", " + CAND + " select word, candidate from cand")
def symdelete_candidates(spark: SparkSession, d: str) -> DataFrame:
    known = _vocab(spark, d).select(F.col("w").alias("word"))
    return spell.candidates(known, known, "symdelete")


@query(VOCAB + ", " + CAND + " select word, candidate from cand")
def edits1_candidates(spark: SparkSession, d: str) -> DataFrame:
    known = _vocab(spark, d).select(F.col("w").alias("word"))
    return spell.candidates(known, known, "edit")


@query(ODD + ", " + CAND + " select q as word, coalesce(arg_max(candidate, (n, candidate)), q) as corrected from x left join cand on x.q = cand.word left join v on v.word = cand.candidate group by q")
def correct_nonword(spark: SparkSession, d: str) -> DataFrame:
    """Words met once are taken for misspelt, words met more often for the vocabulary."""
    words = _vocab(spark, d)
    return spell.correct_nonwords(words.where("n = 1").select(F.col("w").alias("word")), words.where("n >= 2"))


@query(rf"""with {S}, {UNI}, q as (select doc_id, sent_no, pos, word, coalesce(lag(word) over w, '<s>') as prev, coalesce(lead(word) over w, '</s>') as next from tok where true window w as (partition by doc_id, sent_no order by pos)),
t as (select * from q where len(word) > 2 and regexp_full_match(word, '[a-z]+')), x as (select distinct word as q from t), v as (select * from uni where regexp_full_match(word, '[a-z]+')), {CAND},
op as (select * from cand union select q, q from x), g as ({gram_sql(2)}), b as (select w1, w2, count(*) as n from g group by all), c as (select w1, sum(n) as c from b group by w1),
sc as (select t.doc_id, t.sent_no, t.pos, t.word, o.candidate, u.n as n1, round(0.1::double * ln((u.n + 0.1::double) / (total + 0.1::double * v)) + ln((coalesce(b1.n, 0) + 0.1::double) / (coalesce(c1.c, 0) + 0.1::double * v)) + ln((coalesce(b2.n, 0) + 0.1::double) / (coalesce(c2.c, 0) + 0.1::double * v)), 9) as score
  from t join op o using (word) join uni u on u.word = o.candidate left join b b1 on b1.w1 = t.prev and b1.w2 = o.candidate left join b b2 on b2.w1 = o.candidate and b2.w2 = t.next left join c c1 on c1.w1 = t.prev left join c c2 on c2.w1 = o.candidate, st),
bst as (select doc_id, sent_no, pos, word, arg_max(candidate, (score, n1, candidate)) as best, max(score) as top, max(case when candidate = word then score end) as own from sc group by all)
select best as corrected, word, cast(count(*) as bigint) as n from bst where best <> word and top - own >= 0.75 group by all""")
def correct_realword(spark: SparkSession, d: str) -> DataFrame:
    s = sents(spark, d)
    w = Window.partitionBy("doc_id", "sent_no").orderBy("pos")
    t = tokens(s).select("word", F.coalesce(F.lag("word").over(w), F.lit(T.START)).alias("prev"), F.coalesce(F.lead("word").over(w), F.lit(T.END)).alias("next"))
    found = spell.correct_realwords(t, ngrams.fit(s, 2)).where("corrected <> word")
    return found.groupBy("word", "corrected").agg(F.count("*").alias("n"))


@query(rf"""with {S}, {UNI}, e as (select distinct word, {SPLIT.format("word")} as bucket from uni) select bucket, cast(count(*) as bigint) as n from e group by bucket""")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return tokens(sents(spark, d)).select("word").distinct().groupBy(T.bucket(F.col("word"), 7, 10).alias("bucket")).agg(F.count("*").alias("n"))


FW = ", ".join(f"'{w}'" for w in T.FUNCTION_WORDS)


@query(rf"""with t as (select doc_id, regexp_split_to_array(text, '\s+') as t from documents), e as (select doc_id, unnest(t) as x, generate_subscripts(t, 1) as i from t),
l as (select *, lead(x) over w as y, lead(x, 2) over w as z from e window w as (partition by doc_id order by i)),
m as (select doc_id, 1 as k, i, 'repeated function word ''' || x || ' ' || y || '''' as s from l where lower(x) = lower(y) and lower(x) in ({FW}) union all select doc_id, 2, i, 'token ''' || x || ''' repeated three times' from l where lower(x) = lower(y) and lower(x) = lower(z))
select doc_id, md5(string_agg(s, '; ' order by k, i)) as issues from m group by doc_id""")
def surface_anomalies(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", held(F.split("text", r"\s+")).alias("t")).select("doc_id", T.surface_issues(F.col("t")).alias("issues"))
    return t.where("issues is not null").select("doc_id", F.md5("issues").alias("issues"))


@query(r"""with t as (select doc_id, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[.!?]') as t from documents), e as (select doc_id, unnest(t) as x, generate_subscripts(t, 1) as i from t),
f as (select *, coalesce(sum(case when x in ('.', '!', '?') then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as s from e)
select doc_id, cast(s as bigint) as sentence, cast(count(*) as bigint) as n_tokens from f group by all""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+|[0-9]+|[.!?]"), F.lit(0))).alias("i", "x"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("sentence", F.coalesce(F.sum(F.col("x").isin(".", "!", "?").cast("long")).over(before), F.lit(0)))
    return t.groupBy("doc_id", "sentence").agg(F.count("*").alias("n_tokens"))


TAGGED = rf"{S}, tg as (select (doc_id, sent_no) as sent, pos, word, case when len(word) <= 3 then 'F' || right(word, 1) else 'C' || right(word, 2) end as tag from tok)"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in tags from the word's ending, as no tagged text is at hand."""
    tag = F.when(F.length("word") <= 3, F.concat(F.lit("F"), F.right("word", F.lit(1)))).otherwise(F.concat(F.lit("C"), F.right("word", F.lit(2))))
    return tokens(sents(spark, d)).select(F.struct("doc_id", "sent_no").alias("sent"), "pos", "word", tag.alias("tag"))


@query(f"with {TAGGED} select word, tag, cast(count(*) as bigint) as n from tg group by all")
def pos_emissions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tag_counts(tagged(spark, d))["emissions"]


@query(f"with {TAGGED}, q as (select sent as doc_id, list(tag order by pos) as words from tg group by sent), g as ({gram_sql(3, 2, 'q', 'doc_id')}) select w1 as t1, w2 as t2, w3 as t3, cast(count(*) as bigint) as n from g group by all")
def pos_transitions(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tag_counts(tagged(spark, d))["transitions"]


@query(f"with {TAGGED}, e as (select word, tag, count(*) as n, min((sent, pos)) as f from tg group by all) select word, arg_min(tag, (-n, f)) as tag from e group by word")
def most_frequent_tag(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.tag_counts(tagged(spark, d))["most_frequent"]


SPLIT_TAGS = f"""{S}, sb as (select *, {SPLIT.format("md5(array_to_string(words, ' '))")} as b from se), tk as (select b, doc_id, sent_no, unnest(words) as word, generate_subscripts(words, 1) - 1 as pos from sb),
tg as (select b, (doc_id, sent_no) as sent, pos, word, case when len(word) <= 3 then 'F' || right(word, 1) else 'C' || right(word, 2) end as tag from tk),
mf as (select word, arg_min(tag, (-n, f)) as best from (select word, tag, count(*) as n, min((sent, pos)) as f from tg where b < 8 group by all) group by word),
cf as (select tag as gold, coalesce(best, 'UNK') as pred, cast(count(*) as bigint) as n from tg left join mf using (word) where b >= 8 group by all)"""


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    """Held-out tokens by their tag and by the most frequent tag of their word in the training split, position by position."""
    s = sents(spark, d).withColumn("b", T.bucket(F.md5(F.array_join("words", " ")), 7, 10))
    tag = F.when(F.length("word") <= 3, F.concat(F.lit("F"), F.right("word", F.lit(1)))).otherwise(F.concat(F.lit("C"), F.right("word", F.lit(2))))
    t = s.select("b", F.struct("doc_id", "sent_no").alias("sent"), F.posexplode("words").alias("pos", "word")).withColumn("tag", tag)
    gold = t.where("b >= 8").select("sent", "pos", F.col("tag").alias("gold"), "word")
    pred = evaluate.baseline_tags(gold, evaluate.tag_counts(t.where("b < 8"))["most_frequent"])
    return evaluate.confusion(gold.select("sent", "pos", "gold").join(pred.select("sent", "pos", "pred"), ["sent", "pos"]))


@query(f"with {SPLIT_TAGS} select * from cf")
def tag_confusion(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d)


@query(f"with {SPLIT_TAGS}, top as (select gold as t from cf group by gold order by sum(n) desc, gold limit 15) select gold, pred, n from cf where gold in (select t from top) and pred in (select t from top)")
def top_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The confusion of the 15 tags with most support."""
    return evaluate.most_supported(_confusion(spark, d), 15)


@query(f"with {TAGGED} select tag, cast(count(*) as bigint) as n from tg group by tag order by n desc, tag limit 30")
def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagged(spark, d).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30)


@query(rf"""with {S}, l as (select doc_id, sent_no, len(words)::double as x from se), r as (select doc_id % 4 as g, x, row_number() over (partition by doc_id % 4 order by x) - 1 as r, count(*) over (partition by doc_id % 4) as n from l)
select g, cast(max(n) as bigint) as n, min(x) as lo, max(case when r = least(n - 1, floor(0.05::double * n)) then x end) as p05, max(case when r = least(n - 1, floor(0.1::double * n)) then x end) as p10, max(case when r = least(n - 1, floor(0.25::double * n)) then x end) as p25,
max(case when r = least(n - 1, floor(0.75::double * n)) then x end) as p75, max(case when r = least(n - 1, floor(0.9::double * n)) then x end) as p90, max(case when r = least(n - 1, floor(0.95::double * n)) then x end) as p95,
avg(case when r = floor((n - 1) / 2) or r = floor(n / 2) then x end) as median, max(x) as hi from r group by g""")
def quantile_summary(spark: SparkSession, d: str) -> DataFrame:
    v = sents(spark, d).select((F.col("doc_id") % 4).alias("g"), F.size("words").cast("double").alias("x"))
    return evaluate.quantiles(v, ["g"], "x")


def _numbers(df: DataFrame, names: tuple[dict[str, int], ...]) -> D.Counts:
    """Counts (a column for each name, n) as a decoder's table. Tasks make numbers of the names, so only 16 bytes a row are collected."""
    sent, width = df.sparkSession.sparkContext.broadcast(names), len(names)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(D.numbered(sent.value, b.columns[:width])), b.column(width)], ["key", "n"])

    rows = df.mapInArrow(run, "key long, n long").toArrow()
    return D.Counts(names, rows.column("key").to_numpy(), rows.column("n").to_numpy())


def _gram_numbers(s: DataFrame, n: int, pad: int, names) -> D.Counts:
    """The counts of ngrams.fit as a decoder's table; ``names``: the broadcast numbers of words. N-grams are numbers before they are
    shuffled."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in D.counted(names.value, b.column(0), n, pad)], ["key", "n"])

    rows = s.select("words").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return D.Counts((names.value,) * n, rows.column("key").to_numpy(), rows.column("n").to_numpy())


def local_counts(s: DataFrame, orders: tuple[int, ...], pad: int, k: float, end: bool = False) -> D.LM:
    """The counts of a corpus as a decoder's tables: the words as a dict, checked to be at most LOCAL_ROWS, n-grams as numbers."""
    found = ngrams.fit(s, orders[0], k, pad, end).unigrams.limit(LOCAL_ROWS + 1).toArrow()
    if found.num_rows > LOCAL_ROWS:
        raise ValueError(f"a decoder's vocabulary has over {LOCAL_ROWS} words: prune it by count")
    uni = dict(zip(found.column("w").to_pylist(), found.column("n").to_pylist(), strict=True))
    names = s.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(dict.fromkeys((T.START, T.END, *uni)))})
    return D.LM(uni, *(_gram_numbers(s, n, pad, names) if n in orders else {} for n in (2, 3)), k)


def local_lm(s: DataFrame, k: float = 0.1) -> D.LM:
    """The interpolated model's counts: two START, END among the unigrams."""
    return local_counts(s, (2, 3), 2, k, True)


def _train(spark: SparkSession, d: str) -> DataFrame:
    """Frequent-word sentences of a hash split: four fifths of texts, by their content."""
    return sents(spark, d).withColumn("b", T.bucket(F.md5(F.array_join("words", " ")), 7, 10)).where("b < 8").drop("b")


def _held_out(spark: SparkSession, d: str) -> DataFrame:
    """The other fifth of the texts, for the models that are evaluated on texts they have not seen."""
    s = sents(spark, d).withColumn("b", T.bucket(F.md5(F.array_join("words", " ")), 7, 10)).where("b >= 8")
    return s.select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "words")


def _all(spark: SparkSession, d: str) -> DataFrame:
    return sents(spark, d).select("doc_id", F.col("sent_no").cast("long").alias("sent_no"), "words")


@query()
def beam_segment(spark: SparkSession, d: str) -> DataFrame:
    """Held-out sentences without spaces, split by the beam and by the greedy rule: exact matches."""
    lm = spark.sparkContext.broadcast(local_lm(_train(spark, d)))

    def run(batches):
        for pdf in batches:
            joined = pdf["words"].map("".join)
            pdf["segmented"] = [" ".join(D.segment(t, lm.value)) for t in joined]
            pdf["greedy"] = [" ".join(D.greedy_segment(t, lm.value.vocabulary)) for t in joined]
            pdf["exact"] = pdf["segmented"] == pdf["words"].map(" ".join)
            yield pdf[["doc_id", "sent_no", "segmented", "greedy", "exact"]]

    return dealt(_held_out(spark, d)).mapInPandas(run, "doc_id long, sent_no long, segmented string, greedy string, exact boolean")


def local_tagger(t: DataFrame) -> D.Tagger:
    c = evaluate.tag_counts(t)
    common = [r.tag for r in t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(30).collect()]
    seen = c["candidates"].limit(LOCAL_ROWS + 1).toArrow().combine_chunks()
    if seen.num_rows > LOCAL_ROWS:
        raise ValueError(f"a tagger's vocabulary has over {LOCAL_ROWS} words: prune it by count")
    words = {w: i for i, w in enumerate(seen.column("word").to_pylist())}
    ends = np.cumsum(pc.list_value_length(seen.column("tags")).to_numpy())
    flat = pa.concat_arrays([x.flatten() for x in seen.column("tags").chunks] or [pa.array([], pa.string())]).dictionary_encode()
    labels = flat.dictionary.to_pylist()
    emit = _numbers(c["emissions"].select("word", "tag", "n"), (words, {t: i for i, t in enumerate(labels)}))
    moves = c["transitions"].toArrow()
    name = {t: t for t in moves.column("t3").unique().to_pylist()}
    tri = {tuple(name.get(t, t) for t in ts): n for *ts, n in zip(*(moves.column(x).to_pylist() for x in ("t1", "t2", "t3", "n")), strict=True)}
    return D.Tagger(emit, tri, D.Lists(words, ends, flat.indices.to_numpy(), labels), common)


@query()
def viterbi_tags(spark: SparkSession, d: str) -> DataFrame:
    tagger = spark.sparkContext.broadcast(local_tagger(tagged(spark, d)))

    def run(batches):
        for pdf in batches:
            pdf["tags"] = [" ".join(tagger.value.tag(list(w))) for w in pdf["words"]]
            yield pdf[["doc_id", "sent_no", "tags"]]

    return dealt(_all(spark, d)).mapInPandas(run, "doc_id long, sent_no long, tags string")


def editor_models(spark: SparkSession, d: str):
    """Segmentation and spelling from the training split, windows from all sentences with the k that the held-out split prefers."""
    train, every = _train(spark, d), sents(spark, d)
    k = {r.n: r.k for r in tuned_k(spark, d).collect()}
    bi, tri = (local_counts(every, (n,), n - 1, k[n]) for n in (2, 3))
    return spark.sparkContext.broadcast(editor.Models(local_lm(train), local_tagger(tagged(spark, d)), local_counts(train, (2,), 1, 0.1), bi, tri))


@query()
def editor_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Conversations typed into the editor: a session a conversation, turns in order."""
    t = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null").groupBy(F.col("conv_id").alias("session")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    t = t.select("session", F.split(F.trim(F.array_join(F.col("s.text"), " ")), r"\s+").alias("tokens"))
    return editor.run_batch(dealt(t, "session"), editor_models(spark, d))


@query()
def correct_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences corrected from left to right, each word with the corrected one before it."""
    models = editor_models(spark, d)

    def run(batches):
        for pdf in batches:
            pdf["corrected"] = [" ".join(models.value.correct(list(w))) for w in pdf["words"]]
            yield pdf[["doc_id", "sent_no", "corrected"]]

    return dealt(_all(spark, d)).mapInPandas(run, "doc_id long, sent_no long, corrected string")


MERGED = """hit as (select doc_id, sent_no, words, array_to_string([case when i < len(words) and ('0x' || substr(md5('7:' || doc_id || '-' || sent_no || ':' || (i - 1)), 1, 8))::bigint % 100 < 30 then '1' else '0' end for i in range(1, len(words) + 1)], '') as f from se),
mk as (select *, regexp_replace(f, '11', '10', 'g') as m from hit)"""


@query(f"""with {S}, {MERGED} select doc_id, cast(sent_no as bigint) as sent_no, array_to_string(list_filter([case when i > 1 and m[i - 1] = '1' then null when m[i] = '1' then lower(words[i] || words[i + 1]) else words[i] end for i in range(1, len(words) + 1)], lambda x: x is not null), ' ') as text from mk""")
def merge_injection(spark: SparkSession, d: str) -> DataFrame:
    s = _all(spark, d).select("doc_id", "sent_no", F.concat_ws("-", "doc_id", "sent_no").alias("session"), F.col("words").alias("tokens"))
    return editor.inject_merges(s, 30).select("doc_id", "sent_no", F.array_join("tokens", " ").alias("text"))


CORRUPT = rf"""{S}, b as (select *, {SPLIT.format("md5(array_to_string(words, ' '))")} as b from se), tr as (select * from b where b < 8), tt as (select unnest(words) as word from tr), u as (select word, count(*) as n from tt group by word), st as (select count(*) + 1 as v from u),
dv as (select doc_id || '-' || sent_no as id, words, len(words) as n from se where len(words) >= 8),
hd as (select *, [('0x' || substr(md5(k || ':' || id), 1, 8))::bigint % (1::bigint << 31) for k in [7, 8, 9]] as h from dv),
pl as (select id, words, n, n // 2 as half, words[1 + h[1] % n] as pick, 1 + h[2] % (n - 5) as a4, 1 + h[3] % (n - 3) as a2 from hd),
kd as (select id, 'clean' as kind, words from pl union all select id, 'duplicate_token', words[1:half] || [pick] || words[half + 1:n] from pl union all select id, 'drop_middle_token', words[1:half] || words[half + 2:n] from pl
  union all select id, 'reverse_span4', words[1:a4] || list_reverse(words[a4 + 1:a4 + 4]) || words[a4 + 5:n] from pl union all select id, 'swap_adjacent', words[1:a2] || list_reverse(words[a2 + 1:a2 + 2]) || words[a2 + 3:n] from pl)"""


def ppl_sql(n: int, source: str, keys: str, train: str, k: float, out: str) -> str:
    """CTE ``out``: keys and perplexity of the sentences of ``source`` under the counts of ``train``; wants st."""
    cols, ctx = ", ".join(f"w{i + 1}" for i in range(n)), ", ".join(f"w{i + 1}" for i in range(n - 1))
    return f"""{out}g as ({gram_sql(n, source=source, keys=keys)}), {out}t as (select {cols}, count(*) as n from ({gram_sql(n, source=train, keys="1 as one")}) group by all), {out}c as (select {ctx}, sum(n) as c from {out}t group by all),
{out} as (select {keys}, case when count(*) = 1 then 'inf'::double else exp(-sum(ln((coalesce({out}t.n, 0) + {k}::double) / (coalesce({out}c.c, 0) + {k}::double * v))) / count(*)) end as {out} from {out}g left join {out}t using ({cols}) left join {out}c using ({ctx}), st group by all)"""


@query(f"""with {CORRUPT}, {ppl_sql(3, "kd", "id, kind", "tr", 0.1, "tri")}, {ppl_sql(2, "kd", "id, kind", "tr", 0.1, "bi")}, p as (select id, kind, round(tri, 6) as tri, round(bi, 6) as bi from tri join bi using (id, kind)),
cut as (select quantile_cont(tri, 0.5) as low, quantile_cont(tri, 0.8) as high, quantile_cont(bi, 0.8) as big from p where kind = 'clean')
select kind, cast(count(*) as bigint) as total, cast(sum(case when not (tri < low or (tri >= high and bi < big)) then 1 else 0 end) as bigint) as flagged from p, cut group by kind""")
def corruption_detection(spark: SparkSession, d: str) -> DataFrame:
    """Share of corrupted sentences that the perplexity rule flags, by kind; thresholds are quantiles of the clean sentences."""
    s = sents(spark, d).select(F.concat_ws("-", "doc_id", "sent_no").alias("id"), "words", (T.bucket(F.md5(F.array_join("words", " ")), 7, 10) < 8).alias("train"))
    rows = evaluate.corruptions(s, rest=("train",))
    clean = F.col("kind") == "clean"
    twice = not docs(spark, d).groupBy("doc_id").count().where("count > 1").isEmpty()  # sentences of one id are one
    rows = rows.select(*["id"] * twice, "kind", "words", (clean & F.col("train")).alias("counted"), (~clean | (F.size("words") >= 8)).alias("asked")).where("counted or asked")
    p = packed.perplexities(rows, {"tri": (3, 0.1), "bi": (2, 0.1)}, together=twice)
    p = p.select("kind", F.round("tri", 6).alias("tri"), F.round("bi", 6).alias("bi")).persist()  # read for the thresholds and for the flags
    cut = p.where("kind = 'clean'").agg(F.percentile("tri", 0.5).alias("low"), F.percentile("tri", 0.8).alias("high"), F.percentile("bi", 0.8).alias("big"))
    flag = ~((F.col("tri") < F.col("low")) | ((F.col("tri") >= F.col("high")) & (F.col("bi") < F.col("big"))))
    return p.join(F.broadcast(cut)).groupBy("kind").agg(F.count("*").alias("total"), F.sum(flag.cast("long")).alias("flagged"))  # one row


TYPED = r"""wd as (select conv_id, list(w order by turn, p) as words from (select conv_id, turn, unnest(x) as w, generate_subscripts(x, 1) as p from (select conv_id, turn, regexp_extract_all(lower(text), '[\p{L}]+') as x from conversations where text is not null)) group by conv_id)"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, words): the words of each conversation in order."""
    t = spread(spark.read.parquet(f"{d}/conversations.parquet")).where("text is not null").select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("p", "w"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "p", "w"))).alias("s")).select("conv_id", F.col("s.w").alias("words"))


@query(f"with {TYPED}, n as (select conv_id, len(words) as n from wd) select conv_id, cast(place as bigint) as place, false as flush from (select conv_id, unnest(range(5, n + 1, 5)) as place from n) union all select conv_id, n, true from n where n % 5 <> 0 and n >= 3")
def trigger_points(spark: SparkSession, d: str) -> DataFrame:
    """Tokens after which the editor checks a conversation's grammar: every fifth, and the last as the input ends (of three at least)."""
    n = _typed(spark, d).select("conv_id", F.size("words").cast("long").alias("n"))
    every = n.where("n >= 5").select("conv_id", F.explode(F.expr("sequence(5L, n - n % 5, 5L)")).alias("place"), F.lit(False).alias("flush"))
    return every.unionByName(n.where("n % 5 <> 0 and n >= 3").select("conv_id", F.col("n").alias("place"), F.lit(True).alias("flush")))


@query(f"""with {S}, {TYPED}, b as (select *, {SPLIT.format("md5(array_to_string(words, ' '))")} as b from se), tr as (select * from b where b < 8), tt as (select unnest(words) as word from tr), u as (select word, count(*) as n from tt group by word), st as (select count(*) + 1 as v from u),
wi as (select conv_id, place, words[greatest(1, place - 9):place] as words from (select conv_id, words, unnest(range(5, len(words) + 1, 5)) as place from wd)), {ppl_sql(3, "wi", "conv_id, place", "tr", 0.1, "tri")} select conv_id, cast(place as bigint) as place, round(tri, 2) as perplexity from tri""")
def sliding_window_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity of the last ten words of a conversation, after every fifth."""
    t = _typed(spark, d).where("size(words) >= 5").select("conv_id", "words", F.explode(F.expr("sequence(5L, size(words) - size(words) % 5, 5L)")).alias("place"))
    s = t.select("conv_id", "place", F.expr("slice(words, cast(greatest(1, place - 9) as int), cast(least(place, 10) as int))").alias("words"))
    return ngrams.perplexity(ngrams.fit(_train(spark, d), 3), s).select("conv_id", "place", F.round("perplexity", 2).alias("perplexity"))


@query(VOCAB + """, ks as (select word from uni where n >= 2 and len(word) > 1), t as (select word from uni where n = 1 and len(word) > 3),
c as (select word, substr(word, 1, i) as a, substr(word, i + 1) as r from (select word, unnest(range(2, len(word) - 1)) as i from t)), h as (select c.word, r from c join ks on c.a = ks.word),
two as (select distinct h.word from h join ks on h.r = ks.word), m as (select word, substr(r, 1, j) as b, substr(r, j + 1) as z from (select word, r, unnest(range(2, len(r) - 1)) as j from h where len(r) > 3)),
three as (select distinct m.word from m join ks k1 on m.b = k1.word join ks k2 on m.z = k2.word) select word from two union select word from three""")
def valid_split_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words met once that part in two or three words met more often."""
    uni = tokens(sents(spark, d)).groupBy("word").agg(F.count("*").alias("n"))
    return spell.valid_splits(uni.where("n = 1").select("word"), uni.where("n >= 2").select("word"))


EDGES = f"""{S}, b as (select *, {SPLIT.format("md5(array_to_string(words, ' '))")} as b from se), ks as (select distinct word from (select unnest(words) as word from b where b < 8) where len(word) > 1 or word in ('a', 'i')),
q as (select doc_id, sent_no, array_to_string(words, '') as t from b where b >= 8), g as (select doc_id, sent_no, t, unnest(range(0, len(t))) as lo from q), e as (select doc_id, sent_no, lo, lo + k as hi, substr(t, lo + 1, k) as w from (select *, unnest(range(1, least(20, len(t) - lo) + 1)) as k from g)),
kn as (select doc_id, sent_no, lo, hi from e join ks on e.w = ks.word), al as (select doc_id, sent_no, lo, lo + 1 as hi from g anti join kn using (doc_id, sent_no, lo))"""


@query(f"with {EDGES} select doc_id, cast(sent_no as bigint) as sent_no, cast(count(*) as bigint) as n_edges, cast(sum(lo * 31 + hi) as bigint) as digest from (select * from kn union all select * from al) group by all")
def segmentation_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that held-out sentences without spaces have in the dictionary: the words that begin at each place, else one character."""
    known = tokens(_train(spark, d)).select("word").distinct()
    return spell.edge_totals(_held_out(spark, d).select("doc_id", "sent_no", F.array_join("words", "").alias("text")), ["doc_id", "sent_no"], known)


@query()
def segmentation_report(spark: SparkSession, d: str) -> DataFrame:
    """Held-out sentences without spaces: those that the beam, the greedy rule, and beam and tagger together get right, and tags at
    positions that both have, by their errors' cause (see evaluate.segmentation)."""
    lm, tagger = (spark.sparkContext.broadcast(x) for x in (local_lm(_train(spark, d)), local_tagger(tagged(spark, d))))

    def run(batches):
        for pdf in batches:
            cut = [D.segment("".join(w), lm.value) for w in pdf["words"]]
            pdf["segmented"], pdf["predicted"] = cut, [tagger.value.tag(c) for c in cut]
            pdf["tagged"] = [tagger.value.tag(list(w)) for w in pdf["words"]]
            pdf["greedy"] = [D.greedy_segment("".join(w), lm.value.vocabulary) for w in pdf["words"]]
            yield pdf[["words", "tags", "segmented", "greedy", "predicted", "tagged"]]

    s = _held_out(spark, d)
    gold = F.transform("words", lambda w: F.when(F.length(w) <= 3, F.concat(F.lit("F"), F.right(w, F.lit(1)))).otherwise(F.concat(F.lit("C"), F.right(w, F.lit(2)))))
    out = ", ".join(f"{c} array<string>" for c in ("words", "tags", "segmented", "greedy", "predicted", "tagged"))
    return evaluate.segmentation(dealt(s.select("words", gold.alias("tags"))).mapInPandas(run, out))


TREES = f"{S}, tr as (select doc_id, sent_no, pos, case when len(word) <= 3 then 'DT' else 'NN' end as tag, word, lead(word) over w as nx, count(*) over (partition by doc_id, sent_no) as n from tok window w as (partition by doc_id, sent_no order by pos))"


def _gold_trees(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in dependency trees, as no treebank is at hand: a short word hangs on the next word, others on the last, which is the root."""
    t = tokens(sents(spark, d)).select(F.concat_ws("-", "doc_id", "sent_no").alias("sent_id"), (F.col("pos") + 1).alias("id"), F.when(F.length("word") <= 3, "DT").otherwise("NN").alias("pos"), F.count("*").over(Window.partitionBy("doc_id", "sent_no")).cast("int").alias("n"))
    last = F.col("id") == F.col("n")
    return t.select("sent_id", "id", "pos", F.when(last, 0).when(F.col("pos") == "DT", F.col("id") + 1).otherwise(F.col("n")).alias("head"), F.when(last, "root").when(F.col("pos") == "DT", "det").otherwise("obl").alias("deprel"))


@query(f"with {TREES}, m as (select case when pos + 1 = n then 'RIGHT-ARC(root)' when tag = 'DT' then 'LEFT-ARC(det)' else 'LEFT-ARC(obl)' end as transition from tr union all select 'SHIFT' from tr) select transition, cast(count(*) as bigint) as n from m group by all")
def oracle_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Transitions that build the trees of all sentences."""
    return deps.training_rows(dealt(_gold_trees(spark, d), "sent_id")).groupBy("transition").agg(F.count("*").alias("n"))


LAS = f"with {TREES}, r as (select doc_id || '-' || sent_no as sent_id, case when pos + 1 = n or (tag = 'DT') or (pos + 2 = n) then 1 else 0 end as ok from tr)"


def _gold_arrays(spark: SparkSession, d: str) -> DataFrame:
    """``_gold_trees`` with a row for each sentence: tags, heads and labels by place."""
    s = sents(spark, d).select(F.transform("words", lambda w: F.length(w) <= 3).alias("short"))
    s = s.select("short", F.size("short").alias("n"))
    by = lambda last, short, other: F.transform("short", lambda x, i: F.when(i + 1 == F.col("n"), last).when(x, short(i)).otherwise(other))
    labels = by(F.lit("root"), lambda i: F.lit("det"), F.lit("obl"))
    return s.select(F.transform("short", lambda x: F.when(x, "DT").otherwise("NN")).alias("pos"), by(F.lit(0), lambda i: i + 2, F.col("n")).alias("head"), labels.alias("deprel"))


def _next_word_arcs(gold: DataFrame) -> DataFrame:
    """A baseline parse: every word hangs on the next one, labelled by its tag; the last is the root."""
    last = F.col("id") == F.max("id").over(Window.partitionBy("sent_id"))
    return gold.select("sent_id", F.col("id").alias("dep"), F.when(last, 0).otherwise(F.col("id") + 1).alias("head"), F.when(last, "root").when(F.col("pos") == "DT", "det").otherwise("obl").alias("label"))


@query(LAS + " select sent_id, cast(count(*) as bigint) as n_tokens, cast(sum(ok) as bigint) as n_right, round(100.0::double * sum(ok) / count(*), 4) as las from r group by all")
def las(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold_trees(spark, d)
    return evaluate.attachment(gold, _next_word_arcs(gold))


@query(LAS + " select cast(count(*) as bigint) as n_tokens, cast(sum(ok) as bigint) as n_right, round(100.0::double * sum(ok) / count(*), 4) as las from r")
def las_micro(spark: SparkSession, d: str) -> DataFrame:
    gold = _gold_trees(spark, d)
    return evaluate.micro_attachment(evaluate.attachment(gold, _next_word_arcs(gold)))


@query()
def dependency_parse(spark: SparkSession, d: str) -> DataFrame:
    """Sentences parsed by the classifier trained on the oracle's steps for all of them: tokens of those it can parse, and right arcs."""
    gold = deps.alike(_gold_arrays(spark, d))
    choose = spark.sparkContext.broadcast(deps.train(deps.counted_rows(gold)))
    return evaluate.micro_attachment(deps.attached(gold, choose))


def _treebank(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in treebank, one flat bracketed tree a sentence: (S (DT the) (NN house) ...)."""
    kids = F.transform("words", lambda w: F.concat(F.when(F.length(w) <= 3, "(DT ").otherwise("(NN "), w, F.lit(")")))
    return _all(spark, d).select(F.concat(F.lit("(S "), F.array_join(kids, " "), F.lit(")")).alias("tree"))


PCFG = f"""{TREES}, k as (select *, lead(tag, 1) over w as t1, lead(tag, 2) over w as t2, lag(tag, 0) over w as t0, n - pos as left_ from tr window w as (partition by doc_id, sent_no order by pos)),
ru as (select case when pos = 0 then 'S' else 'S|<' || t0 || case when t1 is null then '' else '-' || t1 end || '>' end as lhs, t0 as b, case when n = 1 then '' when left_ = 2 then t1 else 'S|<' || t1 || '-' || t2 || '>' end as c from k where left_ >= 2 or n = 1
  union all select tag, word, null from tr), rc as (select lhs, b, c, count(*) as n from ru group by all)"""


@query(f"with {PCFG} select lhs, b, c, cast(n as bigint) as n, round(ln(n / sum(n) over (partition by lhs)), 9) as logp from rc")
def pcfg_rules(spark: SparkSession, d: str) -> DataFrame:
    """The grammar of the treebank in normal form: rules and their log-probabilities."""
    return evaluate.grammar(evaluate.productions(dealt(_treebank(spark, d)))).withColumn("logp", F.round("logp", 9))


def _grammar(spark: SparkSession, d: str):
    """The treebank's rules over tags, as the parser's table (bounded by the tags): tags stand for themselves as terminals."""
    rules = evaluate.grammar(evaluate.productions(dealt(_treebank(spark, d)))).where("c is not null").collect()
    tags = sorted({r.b for r in rules} | {r.c for r in rules if r.c and "|" not in r.c})
    g = D.Grammar([(r.lhs, r.b, r.c, r.logp) for r in rules if r.c], [(r.lhs, r.b, r.logp) for r in rules if not r.c], [(t, t, 0.0) for t in tags if "|" not in t])
    return spark.sparkContext.broadcast(g)


@query(f"with {PCFG}, lp as (select lhs, b, c, ln(n / sum(n) over (partition by lhs)) as logp from rc) select doc_id, cast(sent_no as bigint) as sent_no, round(sum(logp), 6) as logprob from (select doc_id, sent_no, n, case when pos = 0 then 'S' else 'S|<' || t0 || case when t1 is null then '' else '-' || t1 end || '>' end as lhs, t0 as b, case when n = 1 then '' when left_ = 2 then t1 else 'S|<' || t1 || '-' || t2 || '>' end as c from k where (left_ >= 2 or n = 1) and n <= 25) join lp using (lhs, b, c) group by all")
def cky_logprob(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities of the best parses of sentences of up to 25 words over their tags. The grammar's rules fix where a tree splits, so
    its best parse is the tree itself."""
    tags = F.transform("words", lambda w: F.when(F.length(w) <= 3, "DT").otherwise("NN"))
    s = _all(spark, d).where(F.size("words") <= passage.LONGEST).select("doc_id", "sent_no", tags.alias("tags"))
    return passage.parsed(dealt(s), _grammar(spark, d)).select("doc_id", "sent_no", F.round("pcfg_logprob", 6).alias("logprob"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).where("lang = 'en' and text is not null").select("doc_id", "text", T.tokenize(F.col("text")).alias("tokens"))
    return t.select("doc_id", "text", "tokens", F.transform("tokens", _stand_in).alias("tags"), F.lit(0).alias("merges"), F.lit(0).alias("corrections"))


def _stand_in(w):
    return F.when(~w.rlike("[A-Za-z]"), F.when(w.rlike("[0-9]"), "CD").otherwise(".")).when(F.length(w) <= 3, "DT").otherwise("NN")


@query(rf"""with {S}, {UNI}, t as (select doc_id, regexp_extract_all(text, '{TOKEN_SQL}') as t from documents where lang = 'en' and text is not null), e as (select doc_id, unnest(t) as x, generate_subscripts(t, 1) as i from t),
f as (select *, 1 + coalesce(sum(case when x in ('.', '!', '?') then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as sentence_index from e),
sn as (select doc_id, sentence_index, list(x order by i) as tokens from f group by all), sw as (select doc_id, sentence_index, list_filter(list_transform(tokens, lambda w: lower(w)), lambda w: regexp_full_match(w, '[\p{{L}}\p{{N}}_]+') and regexp_matches(w, '\p{{L}}')) as words from sn),
{ppl_sql(3, "sw", "doc_id, sentence_index", "se", 0.001, "tri")}, {ppl_sql(2, "sw", "doc_id, sentence_index", "se", 0.01, "bi")}
select doc_id, cast(sentence_index as bigint) as sentence_index, round(tri, 1) as trigram_perplexity, round(bi, 1) as bigram_perplexity from tri join bi using (doc_id, sentence_index)""")
def passage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Both perplexities of the sentences of each document."""
    at = ["doc_id", "sentence_index"]
    p = passage.own_scores(_passages(spark, d), ["doc_id"])
    return p.select(*at, F.round("trigram_perplexity", 1).alias("trigram_perplexity"), F.round("bigram_perplexity", 1).alias("bigram_perplexity"))


@query()
def passage_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents by sentence: parse under the stand-in treebank's grammar, both perplexities, the decision rule and the surface check."""
    return passage.analyze(_passages(spark, d), ["doc_id"], None, _grammar(spark, d))


@query()
def session_report(spark: SparkSession, d: str) -> DataFrame:
    """Conversations typed into the editor and then analysed: its merges and corrections are shared out among the sentences."""
    s = editor_sessions(spark, d).select("session", "tokens", F.transform("tokens", _stand_in).alias("tags"), "merges", "corrections")
    return passage.analyze(s, ["session"], sents(spark, d), _grammar(spark, d))


@query()
def corrector_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Share of corrupted held-out words that the corrector restores, by method and kind of error (see evaluate.corrector)."""
    return evaluate.corrector(_held_out(spark, d), ngrams.fit(_train(spark, d), 2))


@query()
def misspelt_batch(spark: SparkSession, d: str) -> DataFrame:
    """A thousand misspellings of training words of four letters or more, with what both methods make of them."""
    uni = ngrams.fit(_train(spark, d), 2).unigrams.where(T.is_ascii_word(F.col("w")))
    return evaluate.benchmark_batch(uni, 1000)


@query(f"with {S}, q as (select * from tok) select word, tag, cast(count(*) as bigint) as n from (select word, case when len(word) <= 3 then 'DET-Masc-Sg' else 'NOUN-Fem-Pl' end as tag, doc_id, sent_no, count(*) over (partition by doc_id, sent_no) as k from q) where k >= 2 group by all")
def conllu_tags(spark: SparkSession, d: str) -> DataFrame:
    """The documents' sentences written as CoNLL-U text and read back by the scan: words by tag with morphology. Sentences of one word go."""
    n = F.size("words")
    feats = lambda w: F.when(F.length(w) <= 3, "DET\t_\tGender=Masc|Number=Sing").otherwise("NOUN\t_\tGender=Fem|Number=Plur")
    rows = F.transform("words", lambda w, i: F.concat_ws("\t", (i + 1).cast("string"), w, F.lit("_"), feats(w), F.when(i + 1 < n, i + 2).otherwise(0).cast("string"), F.lit("dep"), F.lit("_"), F.lit("_")))
    text = F.concat(F.array(F.concat(F.lit("# sent_id = "), F.col("sent_no").cast("string"))), rows, F.array(F.lit("")))
    per = _all(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_no", text.alias("x")))).alias("s"))
    lines = per.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.flatten("s.x")).alias("line_no", "line"))
    read = corpora.tagged_sentences(corpora.conllu_tokens(lines, exact=False), ["file", "sent_id"], "id", morphology=True)
    return read.select(F.explode(F.arrays_zip("words", "tags")).alias("z")).groupBy(F.col("z.words").alias("word"), F.col("z.tags").alias("tag")).agg(F.count("*").alias("n"))
