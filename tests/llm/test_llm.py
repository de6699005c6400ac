import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lexweave.llm import decontaminate, hamming, language_id, line_dedup, mixing, pii, quality, queries, simhash, token_counts, toxicity
from lexweave.llm.common import Workspace, connected_components

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, component_id string, digest string"
LONG = "word and more of the same. " * 5000
PROSE = "a steady line of plain words that goes on for a while"


def edge(spark, rows=True):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    data = [
        (1, PROSE + " one\n" + PROSE, "en", "src1", 3, 0.5, 1, "x", "d"), (1, PROSE + " one\n" + PROSE, "en", "src1", 3, 0.5, 1, "x", "d"),
        (2, None, "en", "src2", None, None, None, None, None), (3, "", None, None, 0, None, None, None, None), (None, PROSE, "de", "src3", 1, None, None, None, None),
        (4, LONG, "en", "src1", 1, None, None, None, None), (5, "   \n\t ", "en", "src9", 1, None, None, None, None), (6, PROSE, "en", "src5", 1, None, None, None, None),
        (7, "12345 !!!", "fr", "src1", 1, None, None, None, None), (8, PROSE, "en", "src5", 1, None, None, None, None),
    ]
    return spark.createDataFrame(data if rows else [], SCHEMA)


def docs(spark, d=D):
    return spark.read.parquet(f"{d}/documents.parquet")


def duck(sql, d=D):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return sorted(c.sql(sql).fetchall(), key=str), c.sql(sql).columns


def same(df, sql):
    want, columns = duck(sql)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (0, 1), (0, 1)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(map(tuple, connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_token_counts_equal_the_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    work = Workspace(spark, "tc")
    lib = Tokenizer.from_file(path)
    odd = ["a <|endoftext|>b", "<|ENDOFTEXT|> it's don't", "x́ ́a\n\ń", "　b​ c\x1cd", "İ ΣΑΣ"]
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    d = docs(spark).select("doc_id", "text").unionByName(extra).unionByName(edge(spark).select("doc_id", "text"))
    want = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in d.collect())
    for _ in range(2):  # cold, then from the cache
        out = token_counts.count_tokens(spark, d, path, f"{work.path}/c").collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in out) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    cache = spark.read.parquet(f"{work.path}/c")
    assert cache.count() == cache.select("digest").distinct().count() > 0
    assert token_counts.count_tokens(spark, edge(spark, False), path, f"{work.path}/c").count() == 0


def test_pii_base_equals_plain_patterns():
    def plain(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            x = re.sub("[ -]", "", m.group())
            if 13 <= len(x) <= 19 and pii.luhn(x):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        return out

    rng = np.random.default_rng(3)
    parts = ["a", "b.c", "@", "x.y", "_", "%", "+", "1", "22", "255", "256", ".", " ", "-", "(017)", "555-7713", "4111111111111111", "4111 1111-1111 1111", "é"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(4000)] + ["a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "1" * 3000, "a" * 3000 + "@", "+1 (017) 555-7713"]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t


def test_pii_adds_spans_and_keeps_the_base(spark):
    found, added = {}, pii.added_spans(['the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is kept', "Licensed under the Apache License, Version 2.0."])
    assert [s[0] for s in added[0]] == [pii.ADDED.index("secret")] and not added[1]
    for r in pii.find_pii(edge(spark)).collect():
        found[r.doc_id] = r
    assert found[2].spans == "" and found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(edge(spark, False)).count() == 0 and pii.find_pii(edge(spark)).count() == 10


def test_pii_decoding_equals_enumeration():
    """Viterbi against all sequences of labels, and forward-backward's gradient by the fit: the path found has the best score."""
    from itertools import product

    crf = pii.model()
    for words in (["mail", "kim77"], ["call", "555-7713"], ["a"], ["key", "=", "x9"]):
        e, best, path = crf.emissions(words), -np.inf, None
        for y in product(range(len(pii.LABELS)), repeat=len(words)):
            x = crf.first[y[0]] + e[0][y[0]] + sum(crf.t[y[i - 1], y[i]] + e[i][y[i]] for i in range(1, len(words)))
            if x > best + 1e-9:
                best, path = x, list(y)
        assert crf.decode([words])[0].tolist() == path


def test_pii_decoding_equals_plain_viterbi():
    """The batches, which skip forbidden steps and ended sequences, against the plain recursion over all labels, on texts of all lengths;
    words that are only letters go the short way to the same kinds."""
    crf, rng = pii.model(), np.random.default_rng(12)
    assert {"token", "mail"} <= crf.cues
    words = [w for x in pii.LABELLED.split("\n") for w in re.sub(r"\[\w+\||\]", "", x).split()]
    for w in [*words, "Abcdefabcdefabcdef", "TOKEN", "I", "internationally", "tokens"]:
        assert crf.kind(w) == crf._kind(w) == crf.kind(w)
    batch = [[str(x) for x in rng.choice(words, int(n))] for n in [1, 1, 2, 3, 3, *rng.integers(1, 60, 60), 400]]
    for seq, got in zip(batch, crf.decode(batch), strict=True):
        e = crf.emissions(seq)
        score, back = e[0] + crf.first, []
        for x in e[1:]:
            via = score[:, None] + crf.t
            back.append(via.argmax(0))
            score = via.max(0) + x
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert path[::-1] == got.tolist()


def test_pii_kinds_of_words_between_signs(monkeypatch):
    """Words whose letters stand between signs go the short way to the kinds that their features give; words part where the patterns'
    spaces are."""
    crf, rng = pii.CRF().fit(pii.labelled(), steps=2), np.random.default_rng(13)
    cores = ["and", "AND", "token", "Token", "I", "größe", "ÜBER", "İstanbul", "日本語", "internationally", "Abcdefabcdefabcdef", "a" * 45, "x1", "a_b", "don't", "٣", ""]
    words = ["".join(rng.choice(list(pii._SIGNS + "_“"), int(rng.integers(0, 4)))) + str(rng.choice(cores)) + "".join(rng.choice(list(pii._SIGNS + "_“"), int(rng.integers(0, 30)))) for _ in range(4000)]
    for w in words:
        if w:
            assert crf.kind(w) == crf._kind(w) == crf.kind(w), w
    crf.kind("maple,")
    asked = []
    monkeypatch.setattr(crf, "_kind", asked.append)
    assert crf.kind("birch,") == crf.kind("cedar,") and not asked
    every = "".join(f"a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert every.split() == pii._WORD.findall(every)


def test_pii_held_out():
    """Personal data of forms that the table has, in sentences and with values that it has not: found; ordinary text: left alone."""
    rng = np.random.default_rng(10)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexa = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    clean = [r for r in ("they went over the hill and came to a town by the sea in 1911", "es war ein guter tag, und alle 14 kamen", "sur la page 8, il y a 3 images", "the house has 12 rooms and 4 doors.") for _ in range(20)]
    made = [("secret", f'then the token = "{hexa()}" was read') for _ in range(60)] + [("phone", f"ring ({digits(3)}) 555-{digits(4)} after four") for _ in range(60)]
    found = pii.added_spans([t for _, t in made])
    right = [any(pii.ADDED[k] == kind for k, _, _ in s) for (kind, _), s in zip(made, found, strict=True)]
    assert np.mean(right) > 0.9 and np.mean([bool(s) for s in pii.added_spans(clean)]) < 0.05
    strings = re.findall(r"[0-9a-f]{40}|[0-9]{16}", pii.LABELLED)
    import pyarrow.parquet as pq

    texts = "\n".join(t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist())
    assert strings and not [x for x in strings if x in texts and x != "4111111111111111"]


def test_pii_decodes_every_word():
    """Spans without a digit or at sign are met, in texts that hold none; ordinary words are not."""
    far = "plain words of a text without any mark. " * 40
    texts = ["write to ana.lopez (at) mail (dot) example.org before noon", far + "password = hunterSecretPass now", "the end. the end. the end. my password was lost | and so it is."]
    found = [[(pii.ADDED[k], t[a:b]) for k, a, b in s] for t, s in zip(texts, pii.added_spans(texts), strict=True)]
    assert found == [[("email", "ana.lopez (at) mail (dot) example.org")], [("secret", "hunterSecretPass")], []]


def test_language_id(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in language_id.query(spark, d).collect()}
    truth = {r.doc_id: r.lang for r in docs(spark, d).collect()}
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    out = language_id.identify(edge(spark), train=docs(spark), keep_text=True)
    assert out.columns[: len(edge(spark).columns) - 1][:2] == ["doc_id", "text"] and out.count() == 10
    assert {r.lang_pred for r in out.where("doc_id in (2, 3, 5, 7)").collect()} == {"und"}
    assert language_id.identify(edge(spark, False)).count() == 0


def test_language_id_is_the_smallest_encoding(spark):
    """Against plain zstandard: each block of the normalised text with each language's raw dictionary."""
    import zstandard as zstd

    content = language_id.sample(docs(spark))
    model = language_id.Classifier(content)
    assert set(content) == {"en", "de", "es", "fr"} and all(0 < len(v) <= language_id.DICT_BYTES for v in content.values())
    for r in docs(spark).limit(60).collect():
        data = language_id.normal(r.text or "")
        sizes = {}
        for k, v in content.items():
            raw = zstd.ZstdCompressionDict(v, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            c = lambda b, raw=raw: len(zstd.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress(b))
            sizes[k] = sum(c(data[i : i + 4096]) for i in range(0, len(data), 4096))
        pred, score, _ = model.predict(r.text)
        assert pred == ("und" if not any(map(str.isalpha, r.text or "")) else min(sizes, key=lambda k: (sizes[k], list(content).index(k)))) and 0 <= score <= 1
    assert [model.predict(t)[0] for t in ("\u00bd \u00b2", "123", "", None)] == ["und"] * 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    same(queries.QUERIES[name](spark, D), queries.ORACLE_SQL[name])


def test_hamming_copies_and_empty(spark):
    rng = np.random.default_rng(5)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**62), 2**62, 150))] + [(200 + i, 77) for i in range(60)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = defaultdict(list)
    for r in hamming.search(df, df.where("id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.distance, r.neighbor_id))
    for q, c in codes:
        if q % 50 == 0:
            assert got[q] == sorted((((c ^ x) % 2**64).bit_count(), i) for i, x in codes)[:5]
    assert hamming.search(df.limit(0), df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, 5), (1, 7), (2, 5), (50, 6)], "id long, code long")  # an id with two codes is two rows
    assert [(r.neighbor_id, r.distance) for r in hamming.search(two, two.where("id = 50"), 4).orderBy("rank").collect()] == [(50, 0), (1, 1), (1, 2), (2, 2)]
    v = spark.createDataFrame([(1, [1.0, -1.0, float("nan"), None]), (2, None), (None, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in hamming.sign_codes(v).collect()] == [(1, 1)]


def kneser_ney(train, text, most):
    """Perplexity of a text by the definition: pairs of words and signs, closed vocabulary, modified Kneser-Ney, interpolated."""
    cut = lambda t: [x.lower() for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", t or "")]
    count = defaultdict(int)
    for t in train:
        for w in cut(t):
            count[w] += 1
    assert len(count) <= most
    name = lambda w: w if w in count else "?sign" if not re.match(r"[0-9A-Za-z\u0080-\U0010ffff]", w) else "?digit" if re.search("[0-9]", w) else "?word"
    c, left = defaultdict(int), defaultdict(set)
    for t in train:
        w = ["<", *cut(t), ">"]
        for x, y in zip(w, w[1:], strict=False) if len(w) > 2 else ():
            c[x, y] += 1
            left[y].add(x)

    def discounts(values):
        n = [sum(v == k for v in values) for k in range(5)]
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k) for k in (1, 2, 3))]

    d, e = discounts(c.values()), discounts([len(v) for v in left.values()])
    total, types = sum(map(len, left.values())), len(count) + 4
    spare = sum(e[min(len(v), 3)] for v in left.values()) / total

    def p(x, y):
        low = max(len(left[y]) - e[min(len(left[y]), 3)], 0) / total + spare / types
        row = [n for (a, _), n in c.items() if a == x]
        if not row:
            return low
        return max(c.get((x, y), 0) - d[min(c.get((x, y), 0), 3)], 0) / sum(row) + sum(d[min(n, 3)] for n in row) / sum(row) * low

    w = ["<", *map(name, cut(text)), ">"]
    return float(np.exp(-np.mean([np.log(p(x, y)) for x, y in zip(w, w[1:], strict=False)]))) if len(w) > 2 else None


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_quality_equals_brute_force(spark, hot):
    rng = np.random.default_rng(6)
    words = ["the", "House", "is", "é", "x1", "green", "tree", "of", "day", ",", "...", "Über", "99"]
    weight = np.arange(len(words), 0, -1.0) ** 2
    make = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    train = [make(30) for _ in range(40)] + ["", None]
    asked = [*train[:5], "the unseen house, 12z ### is", "", None, "  \n", "of", "\u4e16\u754c the!?", LONG[:2000], make(50)]
    work, shards = Workspace(spark, "q"), 8
    model, counts = quality.train(work, spark.createDataFrame([(t,) for t in train], "text string").repartition(3), shards, hot=hot)
    docs = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(asked)], "doc_id long, row int, text string").repartition(3)
    got = {r.row: r.perplexity for r in quality.perplexities(docs, model, counts, shards, "doc_id", "text", {"row": docs["row"]}).collect()}
    assert len(got) == len(asked)
    for i, t in enumerate(asked):
        want = kneser_ney(train, t, 1000)
        assert got[i] is None if want is None else np.isclose(got[i], want, rtol=1e-4), (t, got[i], want)


def test_quality_parts():
    keys = np.array([3, 9, 2**33 + 1], np.uint64)
    assert [x.tolist() for x in quality.unpack(quality.pack(keys, np.array([1, 2, 70000])))] == [keys.tolist(), [1, 2, 70000]]
    h, unknown, start = quality.tokens("Ab, ab... x9 é\n!".encode())
    assert h[0] == h[2] and start.tolist() == [0, 2, 4, 6, 10, 13, 16] and unknown.tolist() == [2, 4, 2, 4, 3, 2, 4]


def test_quality(spark):
    """Of labelled documents that the model has not seen, clean ones are kept and junk goes; edges have their defined results."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("not trained").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.25
    out = quality.classify(edge(spark), spark.createDataFrame([(1, 1, 0), (6, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    assert out.count() == 10 and not out.where("doc_id in (2, 3, 5)").filter("keep").count()
    assert quality.classify(edge(spark, False), labels).count() == 0
    assert not quality.classify(edge(spark), labels.limit(0)).where("keep").count()


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, PROSE), (2, "plain words"), (None, "of"), (3, None), (4, "!!"), (1, "zzz")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(edge(spark), items).collect()}
    assert got[6].n_words == 12 and got[6].n_hit == 12 and got[6].items == "1,2" and got[2].n_words == 0 and not got[4].contaminated
    assert decontaminate.contamination(edge(spark), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(edge(spark, False), items).count() == 0


def test_decontamination_in_blocks(spark):
    """Patterns searched block by block give what one block gives."""
    items = spark.read.parquet(f"{D}/benchmark.parquet")
    d = docs(spark).select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text"))
    extra = spark.createDataFrame([(900, PROSE), (901, "plain words"), (None, "of"), (900, "zzz")], "item_id long, text string")
    items = items.unionByName(extra)
    rows = lambda block: sorted(map(tuple, decontaminate.contamination(d, items, block=block).collect()), key=str)
    assert rows(500) == rows(10**6) and any(r[5] for r in rows(10**6))


def fuzzy(texts, threshold=0.8):
    """Brute force of line deduplication: kept texts by document, in order of id."""
    def cut(line):
        low = line.lower()
        return {low[i : i + 9] for i in range(max(1, len(low) - 8))}

    where = [(i, k, line) for i, t in sorted(texts.items()) for k, line in enumerate(t.split("\n")) if line.strip()]
    root = list(range(len(where)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [cut(w[2]) for w in where]
    for a in range(len(where)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {where[i][:2] for i in range(len(where)) if find(i) != i}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}


def test_line_banding_finds_similar_lines(spark):
    """Recall of the bands on real lines with edits, of all lengths, by the similarity of their own sets of shingles."""
    rng = np.random.default_rng(4)
    real = [x for r in docs(spark, "/root/testdata/sf0.01").limit(400).collect() for x in (r.text or "").split("\n") if len(x) > 2][:1500]
    cut = lambda t: {t.lower()[i : i + 9] for i in range(max(1, len(t) - 8))}
    pairs = []
    for x in real:
        y, k = list(x), max(1, len(x) // 120)
        for _ in range(int(rng.integers(1, k + 1))):
            y[int(rng.integers(len(y)))] = "abcxyz"[int(rng.integers(6))]
        a, b = cut(x), cut("".join(y))
        if 0.8 <= len(a & b) / len(a | b) < 1:
            pairs.append((x, "".join(y)))
    assert len(pairs) > 300
    df = spark.createDataFrame([(i, t) for i, p in enumerate(pairs) for t in p], "pair int, line string").repartition(8)
    chars = df.select("pair", "line", line_dedup.characters(df["line"]).alias("c"))
    signed = line_dedup.signatures(chars.withColumnRenamed("c", "chars").select(line_dedup.F.struct("pair", "line").alias("line_id"), "chars"))
    met = signed.groupBy("line_id.pair", "band").count().where("count = 2").select("pair").distinct().count()
    assert met >= 0.99 * len(pairs), (met, len(pairs))


def test_line_sketches_drop_pairs_but_no_link(spark):
    """By their sketches alone all pairs of similar lines stay and most of the others go, before any line is cut in shingles."""
    rng = np.random.default_rng(7)
    real = [x for r in docs(spark, "/root/testdata/sf0.01").limit(100).collect() for x in (r.text or "").split("\n") if len(x) > 2][:150]
    edited = lambda x, k: "".join(c if rng.random() > k / len(x) else "%" for c in x)
    lines = list(dict.fromkeys([*real, *(edited(x, k) for x in real for k in (1, 3, len(x) / 50)), "", "ab", "Ab cd \U0001f600 efg hi"]))
    cut = lambda t: {t.lower()[i : i + 9] for i in range(max(1, len(t) - 8))}
    sets = [cut(x) for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").cache()
    own = {r.line_id: set(r.s) for r in df.select("line_id", line_dedup.shingle_set(line_dedup.F.lower("line")).alias("s")).collect()}
    assert own == dict(enumerate(sets))
    sketch = line_dedup.sketches(df.select("line_id", line_dedup.characters(df["line"]).alias("chars"))).cache()
    pairs = df.select(df["line_id"].alias("a")).crossJoin(df.select(df["line_id"].alias("b"))).where("a < b")
    met = {(r.a, r.b) for r in line_dedup.sketched(pairs, sketch, 0.8).collect()}
    true = {(a, b) for b in range(len(lines)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert true <= met and len(met) < 3 * len(true), (len(true), len(met))
    found = line_dedup.similar(spark.createDataFrame(sorted(met), "a long, b long"), df, 0.8)
    assert {(r.u, r.v) for r in found.collect()} == true


def test_line_sketches_count_different_shingles(spark):
    """Lines that share only what they repeat go by their sketches: a repeated shingle counts once."""
    rng = np.random.default_rng(9)
    lines = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 300)) + "ab" * 2000 for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    sketch = line_dedup.sketches(df.select("line_id", line_dedup.characters(df["line"]).alias("chars"))).cache()
    assert [r.n for r in sketch.collect()] == [len({x[i : i + 9] for i in range(len(x) - 8)}) for x in lines]
    assert line_dedup.sketched(spark.createDataFrame([(0, 1)], "a long, b long"), sketch, 0.8).count() == 0


def test_line_pairs_of_several_buckets_are_made_once(spark):
    """Lines that meet in all their bands make one pair, and none where their roots are the same."""
    words = [f"w{i}" for i in range(line_dedup.WORDS)]
    rows = [(band, line, root, 9, *[0] * line_dedup.WORDS) for band in range(8) for line, root in ((1, 1), (2, 2), (3, 2))] + [(9, 4, 4, 9, *[0] * line_dedup.WORDS), (9, 1, 1, 9, *[0] * line_dedup.WORDS)]
    each = spark.createDataFrame(rows, "band long, line_id long, root long, n long, " + ", ".join(f"{w} long" for w in words))
    assert sorted(map(tuple, line_dedup.facing(each, 0.8).collect())) == [(1, 2), (1, 3), (1, 4)]


def test_line_groups_joined_before_make_no_row_with_their_heads(spark):
    """Lines in their head's component make no row of a join; pairs of others are the same as by comparing all."""
    joined, heads = [(band, line) for band in range(8) for line in range(500)], [(band, head) for band in range(8) for head in (0, 1, 2)]
    members = spark.createDataFrame([*joined, *((band, line) for band in (9, 10) for line in (3, 700, 701))], "band long, line_id long")
    against = spark.createDataFrame([*heads, (9, 700), (9, 701), (10, 700)], "band long, head long")
    root = spark.createDataFrame([(line, 0) for line in range(500)] + [(701, 700), (700, 700)], "node long, root long")
    pairs = line_dedup.facing_heads(members, against, root)
    assert sorted(map(tuple, pairs.collect())) == [(3, 700), (3, 701)]
    first = line_dedup.facing_heads(members, against.where("head in (0, 700)"), None)
    assert {tuple(r) for r in first.collect()} == {(0, x) for x in range(1, 500)} | {(3, 700), (700, 701)}
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert sum("Inner" in x and "NOT (_a" in x and "array_min" in x for x in joins) == 1, joins


def test_line_pairs_with_heads_that_sketches_tell_apart_make_no_row(spark):
    """A large group that shares its buckets, but is not alike, makes no row with its heads; pairs that can be links are all made."""
    rng = np.random.default_rng(12)
    base = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 200)) for _ in range(60)]
    lines = dict(enumerate([*base, *(x[:150] + "#" + x[151:] for x in base[:5])]))
    df = spark.createDataFrame(list(lines.items()), "line_id long, line string")
    sketch = line_dedup.sketches(df.select("line_id", line_dedup.characters(df["line"]).alias("chars"))).cache()
    members = spark.createDataFrame([(band, x) for band in range(8) for x in lines], "band long, line_id long")
    against = spark.createDataFrame([(band, head) for band in range(8) for head in range(15)], "band long, head long")
    root = spark.createDataFrame([(0, 0), (60, 0)], "node long, root long")  # joined before: makes no row
    pairs = line_dedup.facing_heads(members, against, root, sketch, 0.8)
    assert sorted(map(tuple, pairs.collect())) == [(i, 60 + i) for i in range(1, 5)]
    joins = [x for x in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "NOT (_a" in x]
    assert len(joins) == 1 and "bit_count" in joins[0], joins


def test_line_shingle_hashes_are_those_of_all_places(spark):
    """The hashes that links are decided by, against the shingles one by one; a sketch's columns are packed before they are compared."""
    lines = ["", "ab", "Ab cd \U0001f600 efg hi", "abcdefghi", "x" * 40, "größe ist 日本語の長い行 und mehr", "word and more " * 30]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string").select("line_id", "line", line_dedup.characters(line_dedup.F.col("line")).alias("chars"))
    got = {r.line_id: sorted(r.s) for r in df.select("line_id", line_dedup.shingle_hashes(line_dedup.F.col("chars")).alias("s")).collect()}
    each = line_dedup.hashed(df.select("line_id", "chars")).distinct().collect()
    assert got == {i: sorted(r.x for r in each if r.line_id == i) for i in range(len(lines))}
    assert [len(got[i]) for i in range(len(lines))] == [len({x.lower()[k : k + 9] for k in range(max(1, len(x) - 8))}) for x in lines]


def test_line_work_releases_shuffle_files(spark):
    """Shuffle files of ended queries go while the driver lives."""
    import os
    import time

    dirs = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: sum(n.startswith("shuffle_") for d in dirs for _, _, names in os.walk(d) for n in names)
    work = Workspace(spark, "release")
    work.release()
    time.sleep(2)
    before = held()
    work.table(spark.range(10_000).repartition(7, "id"), "dealt")
    work.release()
    end = time.time() + 20
    while held() > before and time.time() < end:
        time.sleep(0.2)
    assert held() <= before


def test_line_buckets_of_any_size_find_the_same_links(spark):
    """Lines compared by twos in their bucket, and by their rarest shingles where buckets are too large for that."""
    rng = np.random.default_rng(3)
    base = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 120)) for _ in range(3)]
    near = [x[:k] + "#" * 10 + x[k + 10 :] for x in base for k in range(0, 110, 7)]
    d = spark.createDataFrame([(i, x) for i, x in enumerate([*base, *near])], "doc_id long, text string")
    gone = [sorted(tuple(r) for r in line_dedup.duplicate_lines(Workspace(spark, "wide"), d, wide=w).select("_doc", "gone").collect()) for w in (1, 2000)]
    kept = fuzzy(dict(enumerate([*base, *near])))
    assert gone[0] == gone[1] == [(i, [0]) for i, x in kept.items() if not x]


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "eg", "fin") for b in ("an", "et", "is", "om", "ur", "ex")]
    base = [" ".join(rng.choice(words, 30)) for _ in range(12)]
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(3):
            x = str(rng.choice(base)).split(" ")
            if rng.random() < 0.5:
                x[int(rng.integers(30))] = "zz"
            lines.append(" ".join(x))
        texts[i] = "\n".join([*lines, "short line", f"own line number {i} with text {' '.join(rng.choice(words, 8))}"])
    out = line_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == fuzzy(texts)
    got = line_dedup.dedup(edge(spark)).collect()
    assert len(got) == 10 and next(r for r in got if r.doc_id == 2).text is None
    assert line_dedup.dedup(edge(spark, False)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_line_dedup_sees_all_characters(spark):
    """Lines without spaces, or that differ only late in a long word, are held by all of their characters."""
    lines = ["https://example.org/archive/one/alpha.html", "https://example.org/wiki/another-page?id=77", "今日は天気がとても良いので散歩に行きました。", "今日は天気がとても悪い、家で本を読んで過ごしたい。",
             "identifier-0001-abcdefgh identifier-9999-stuvwxyz", "identifier-0777-qwertyui identifier-3333-zxcvbnma"]
    one = "the same long line without any difference but for its last sign, which is new"
    got = line_dedup.dedup(spark.createDataFrame([(1, "\n".join([*lines, one + "?"])), (2, one + "!")], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: "\n".join([*lines, one + "?"]), 2: ""}


def test_line_dedup_keeps_lines_that_differ_late(spark):
    """Long words that differ at their end, lines without spaces, and columns of any name."""
    texts = ["the transaction number is TRX-0000000000001111", "the transaction number is TRX-0000000000009999", "the contract is internationally binding", "the contract is internationalised now"]
    d = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, gone int, _k int, _doc string, `a.b` string")
    got = line_dedup.dedup(d)
    assert got.columns == [*d.columns, "n_lines", "n_dropped"] and [r.text for r in got.orderBy("doc_id").collect()] == texts


def test_line_dedup_drops_short_lines(spark):
    texts = [(1, "Menu\nRead more\n\n  \nA\n一"), (2, "menu\nRead more\n\n  \nB\n一\nRead me"), (3, "Read more")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(d).collect()} == {1: texts[0][1], 2: "\n  \nB\nRead me", 3: ""}
    assert [r.n_dropped for r in line_dedup.dedup(d, min_chars=20).collect()] == [0, 0, 0]


@pytest.mark.parametrize("size", [2, 3, 5])
def test_simhash_equals_brute_force(spark, size):
    import xxhash

    d = docs(spark).select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text"))
    fps = {}
    for r in d.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0
        fps.setdefault(fp, []).append(r.doc_id)
    keys = list(fps)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for k in keys:
        low[find(k)] += [x for x in fps[k] if x is not None]
    want = sorted((str(i), f"{k:016x}", min(low[find(k)], default=None)) for k in keys for i in fps[k])
    got = simhash.near_duplicates(d, size=size)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(edge(spark, False)).count() == 0


def test_similar_groups(spark):
    """Against brute force over sets of five-word shingles: no link that is none, and at least 0.9 of the pairs in one group."""
    rng, texts = np.random.default_rng(9), []
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (6, 12, 40, 90, 200, 400) for _ in range(12)]
    for w in base:
        texts.append(" ".join(w))
        for _ in range(4):
            y = list(w)
            for _ in range(max(1, int(len(w) * rng.choice([0.004, 0.01, 0.02])))):
                y[int(rng.integers(len(y)))] = f"z{rng.integers(10**6)}"
            texts.append(" ".join(y))
    texts += ["", None, "one two", "one two", "one  TWO", "one two three"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if (sets[i] or sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    group = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in want:
        root[max(find(i), find(j))] = min(find(i), find(j))
    n = len(base) * 5
    assert group[n] == group[n + 1] == n and group[n + 2] == group[n + 3] == group[n + 4] == n + 2 and group[n + 5] == n + 5
    assert all(find(i) == find(j) for i in range(n) for j in [group[i]])
    assert sum(group[i] == group[j] for i, j in want) >= 0.95 * len(want)
    assert simhash.similar_groups(edge(spark, False)).count() == 0 and simhash.similar_groups(edge(spark)).count() == 10


def test_blocks_hold_every_pair(spark):
    rows = [(1, i, i) for i in range(50)] + [(2, i, 7) for i in range(5)]
    got = simhash.blocked(spark.createDataFrame(rows, "key long, node long, root long"), simhash.F.lit(True), [], block=8)
    assert sorted(map(tuple, got.collect())) == [(i, j) for i in range(50) for j in range(50) if i < j]


def test_toxicity_matches_by_the_definition(spark):
    """Scores by plain search for each entry in the folded text, without occurrences inside exception phrases."""
    rng = np.random.default_rng(12)
    weights = {" idiot ": 3.0, " idio": 1.0, " stup": 2.0, " trash ": 1.5, " ass ": 2.0}
    lexicon = toxicity.Lexicon(weights, -2.0)
    free = [toxicity.fold(e) for e in toxicity.EXCEPTIONS]

    def plain(text):
        t = toxicity.fold(text or "")
        inside = [(m.start(), m.start() + len(e)) for e in free for m in re.finditer(f"(?={re.escape(e)})", t)]
        total, n = -2.0, t.count(" ") - 1
        for w, x in weights.items():
            at = [m.start() for m in re.finditer(f"(?={re.escape(w)})", t)]
            c = sum(not any(a <= i and i + len(w) <= b for a, b in inside) for i in at)
            total += x * float(toxicity.normalised(c, n)) if c else 0
        return 1 / (1 + np.exp(-total))

    parts = ["idiot", "1d10t", "not", "stupid", "stup1dly", "trash", "can", "room", "455", "a55", "\u0456diot", "no", "fine", "$tupid", "th@t"]
    for text in [None, "", *(" ".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(400))]:
        assert np.isclose(lexicon.score(text), plain(text)), text
    assert toxicity.fold("room 455 at 10:30") == " room at " and toxicity.fold("a55 1diot") == " ass idiot "


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " trash ": 4.0}, -2.0)
    assert lexicon.score("You IDI0T") == lexicon.score("you idiot") > 0.5 > lexicon.score(None) == lexicon.score("")
    assert lexicon.score("the trash can is full") < 0.5 < lexicon.score("this trash is full")
    assert lexicon.score("іdiоt") > 0.5  # Cyrillic look-alikes
    assert toxicity.score(edge(spark), lexicon).count() == 10 and toxicity.score(edge(spark, False), lexicon).count() == 0
    assert toxicity.learn(edge(spark), spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_mixing_edges(spark):
    got = mixing.mix(edge(spark), full=True)
    assert got.columns == [*edge(spark).columns, "epochs", "part_tokens"] and not got.where("doc_id in (2, 3, 5)").count()
    total = sum(len((r.text or "").split()) for r in edge(spark).collect())
    clash = edge(spark).selectExpr("*", "1 as _rest", "2 as _epochs", "3 as _n", "4 as own0_")
    assert mixing.mix(clash, full=True).columns == [*clash.columns, "epochs", "part_tokens"]
    out = mixing.mix(edge(spark))
    assert out.selectExpr("sum(epochs * n_tokens + part_tokens) as t").first().t == min(total * 60 // 100, total * 4)
    assert mixing.mix(edge(spark, False)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as C

    d = docs(spark)
    for name, stage in C.STAGES[:-1]:
        out = Workspace(spark, "p").table(stage(spark, d, D), name)
        assert out.columns == d.columns and 0 < out.count() <= d.count()
        d = out
    assert C.run(spark, D).count() > 0
    for _, stage in C.STAGES:
        assert stage(spark, edge(spark).drop("digest"), D).count() >= 0
    assert C.near_duplicates(spark, edge(spark), D).where("doc_id = 6 or doc_id = 8").count() <= 1


def test_pipeline_catches_near_copies(spark):
    import corpus_pipeline as C

    rng = np.random.default_rng(3)
    rows, copies = [], 0
    for i in range(0, 400, 2):
        w = [f"w{x}" for x in rng.integers(0, 10**5, int(rng.integers(60, 400)))]
        y = list(w)
        for _ in range(max(1, len(w) // 120)):
            y[int(rng.integers(len(y)))] = "other"
        rows += [(i, " ".join(w), "en", 7, 8, 9), (i + 1, " ".join(y), "en", 7, 8, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, _k int, k int, _id int")
    left = C.near_duplicates(spark, d, D)
    kept = {r.doc_id for r in left.collect()}
    copies = sum(i + 1 not in kept for i in range(0, 400, 2))
    assert left.columns == d.columns and all(i in kept for i in range(0, 400, 2)) and copies >= 180
    assert C.decontaminated(spark, d, D).columns == d.columns and C.language(spark, d, D).columns == d.columns


def test_pipeline_drops_rows_not_ids(spark):
    """Null and repeated ids: only the copies and the contaminated rows go."""
    import corpus_pipeline as C

    rng = np.random.default_rng(8)
    a, b, c, e, f = (" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(5))
    rows = [(None, a), (None, b), (1, a), (1, c), (1, c), (2, e), (2, a), (3, f)]
    left = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(None, b), (1, a), (1, c), (2, e), (3, f)], key=str)
    item = spark.read.parquet(f"{D}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(None, a), (None, item), (1, b), (1, item), (1, None)]
    left = C.decontaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), D).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(None, a), (1, b), (1, None)], key=str)
