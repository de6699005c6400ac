import math
import os
import pickle

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave import catalog
from lexweave.functions import text as T
from lexweave.operators import evaluate, ngrams, spell
from lexweave.plans import decoders as D
from lexweave.sources import corpora
from lexweave.streaming import editor

DIR = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    want = c.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, DIR).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_scalars(spark):
    lit = F.lit
    assert value(spark, T.morphology_tag(lit("NOUN"), lit("Gender=Fem|Number=Sing"))) == "NOUN-Fem-Sg"
    assert [value(spark, T.reconcile_tag(lit(t))) for t in ("AT", "NP", "NOUN-Fem-Sg", "ADJ-Masc-Pl", "PUNCT", "UNKNOWN_TAG")] == ["DT", "NNP", "NN", "JJ", ".", "NN"]
    assert {"ab", "acb", "adc", "abbc"} <= set(value(spark, T.edits1(lit("abc"))))
    assert value(spark, T.within_edit_one(lit("teh"), lit("the"))) and not value(spark, T.within_edit_one(lit("abcd"), lit("badc")))
    assert value(spark, T.detokenize(T.tokenize(lit('He said (well), "no".')))) == 'He said (well),"no".'
    assert [value(spark, T.match_case(lit(a), lit("word"))) for a in ("ABC", "Abc", "abc")] == ["WORD", "Word", "word"]
    issue = lambda s: value(spark, T.surface_issues(F.split(lit(s), " ")))
    assert issue("the the cat") and issue("and and then") and issue("a a a man") and not issue("very very good")
    rule = lambda *a: tuple(value(spark, T.decision_rule(*map(lit, a))))
    assert rule(True, 100, 150) == ("Grammatical", "PCFG") and rule(True, 500, 200) == ("Ungrammatical", "PCFG") and rule(True, 900, 600) == ("Grammatical", "Bigram LM")
    assert rule(False, 150, 250) == ("Grammatical", "Trigram LM") and rule(False, 600, 300) == ("Ungrammatical", "Trigram LM") and rule(False, 900, 900) == ("Ungrammatical", "Bigram LM")


def test_language_model(spark):
    s = spark.createDataFrame([(1, ["the", "quick", "brown", "fox"]), (2, ["the", "lazy", "dog"])], "id long, words array<string>")
    ask = spark.createDataFrame([(9, ["the", "quick", "fox"])], "id long, words array<string>")
    two, three = (ngrams.perplexity(ngrams.fit(s, n, 0.1), ask).first() for n in (2, 3))
    assert math.isclose(two.logprob, -4.417787, abs_tol=1e-5) and math.isclose(three.perplexity, 4.402158, abs_tol=1e-5)


def test_segmentation_and_tagging():
    lm = D.lm_of([["the", "quick", "fox"], ["the", "quick", "dog"]])
    assert D.segment("thequickfox", lm) == ["the", "quick", "fox"] and math.isclose(lm.score("<s>", "<s>", "the"), -0.402411, abs_tol=1e-5)
    assert D.greedy_segment("thequickfox", lm.vocabulary) == ["the", "quick", "fox"] and D.segment("", lm) == []
    assert D.tagger_of([(["the", "dog"], ["DT", "NN"]), (["a", "dog"], ["DT", "NN"])]).tag(["the", "dog"]) == ["DT", "NN"]
    assert D.valid_split("thedog", {"the", "dog"}) and not D.valid_split("dog", {"dog"})


def test_transitions(spark):
    heads = {1: (2, "det"), 2: (3, "nsubj"), 3: (0, "root")}
    steps = D.oracle(heads)
    assert [m for _, m in steps] == ["SHIFT", "SHIFT", "LEFT-ARC(det)", "SHIFT", "LEFT-ARC(nsubj)", "RIGHT-ARC(root)"]
    pos = {1: "DET", 2: "NOUN", 3: "VERB"}
    assert D.features(D.State([0, 1], [2, 3], []), pos) == ("DET", "ROOT", "NOUN", "VERB")
    arcs = D.parse(pos, {D.features(s, pos): m for s, m in steps}.get)
    assert sorted(arcs) == sorted((h, d, label) for d, (h, label) in heads.items())
    with pytest.raises(ValueError):
        D.oracle({1: (3, "a"), 2: (4, "b"), 3: (0, "root"), 4: (3, "c")})
    gold = spark.createDataFrame([(1, i, h, label) for i, (h, label) in heads.items()], "sent_id long, id int, head int, deprel string")
    got = evaluate.attachment(gold, spark.createDataFrame([(1, h, d, x) for h, d, x in arcs[:2]], "sent_id long, head int, dep int, label string")).first()
    assert (got.n_tokens, got.n_right) == (3, 2)


def test_grammar(spark):
    g = D.Grammar([("S", "NP", "VP", 0.0), ("NP", "DT", "NN", 0.0), ("VP", "VB", "NP", 0.0)], [], [(t, t, 0.0) for t in ("DT", "NN", "VB")])
    assert D.cky(["DT", "NN", "VB", "DT", "NN"], g) == (0.0, "(S (NP (DT DT) (NN NN)) (VP (VB VB) (NP (DT DT) (NN NN))))")
    assert D.cky(["VB", "VB"], g)[1] is None and D.cky([], g) == (-math.inf, None)
    rules = D.productions(D.read_tree("(S (NP (DT the) (JJ big) (NN dog)) (VP (VB ran)))"))
    df = evaluate.grammar(spark.createDataFrame(rules, "lhs string, b string, c string"))
    assert all(math.isclose(r.p, 1) for r in df.groupBy("lhs").agg(F.sum(F.exp("logp")).alias("p")).collect())


def test_conllu(spark, tmp_path):
    path = tmp_path / "x.conllu"
    path.write_text("# c\n1\tThe\t_\tDET\t_\t_\t2\tdet\t_\t_\n2\tcat\t_\tNOUN\t_\tGender=Fem|Number=Sing\t3\tnsubj\t_\t_\n3\tsat\t_\tVERB\t_\t_\t0\troot\t_\t_\n4-5\tx\t_\t_\t_\t_\t_\t_\t_\t_\n4\t.\t_\tPUNCT\t_\t_\t3\tpunct\t_\t_\n\n")
    t = corpora.conllu_tokens(corpora.conllu_lines(spark, str(path)))
    assert [r.word for r in t.orderBy("id").collect()] == ["The", "cat", "sat", "."]
    assert corpora.tagged_sentences(t, ["sent_id"], "id", morphology=True).first().tags == ["DET", "NOUN-Fem-Sg", "VERB"]


SPELL = [["i", "would", "like", "to", "see", "the", "world"]] * 2 + [["the", "sea", "is", "blue"]] + [["a", "good", "sentence"]] * 2


def models():
    lm = D.lm_of(SPELL)
    return editor.Models(lm, D.tagger_of([(s, ["X"] * len(s)) for s in SPELL]), lm, lm, lm, margin=0.5)


def test_spelling(spark):
    m = models()
    assert m.correct(["sentnce"]) == ["sentence"] and m.correct("I would like to sea the world .".split()) == "I would like to see the world .".split()
    words = spark.createDataFrame([("sentnce",), ("hell",), ("dont",)], "word string")
    vocab = spark.createDataFrame([("sentence", 2), ("hello", 2), ("help", 1), ("don't", 1)], "w string, n long")
    assert {tuple(r) for r in spell.correct_nonwords(words, vocab).collect()} == {("sentnce", "sentence"), ("hell", "hello"), ("dont", "don't")}
    known = vocab.select(F.col("w").alias("word"))
    edit, delete = ({tuple(r) for r in spell.candidates(words, known, k).collect()} for k in ("a", "b"))
    assert delete - edit == {("dont", "don't")} and not edit - delete
    with pytest.raises(ValueError):
        spell.candidates(words, known, "nope")


def test_editor_batch_and_stream(spark, tmp_path):
    given = spark.createDataFrame([(1, "the quick brown Fox".split()), (2, ["a", "b", "c"]), (3, ["a", ",", "b"]), (4, ["a"]), (5, [])], "session long, tokens array<string>")
    merged = {r.session: r.tokens for r in editor.inject_merges(given, 100).collect()}
    assert merged == {1: ["thequick", "brownfox"], 2: ["ab", "c"], 3: ["a", ",", "b"], 4: ["a"], 5: []}
    assert {r.session: r.tokens for r in editor.inject_merges(given, 0).collect()} == {r.session: r.tokens for r in given.collect()}
    text = "i would liketo sea the wrld is blue a good sentnce".split()
    sent = spark.sparkContext.broadcast(models())
    batch = editor.run_batch(spark.createDataFrame([(1, text)], "session long, tokens array<string>"), sent).first()
    assert "like" in batch.tokens and "sentence" in batch.tokens and batch.n_alerts >= 3
    alone = editor.Session().run(text, models(), flush=False)
    spark.createDataFrame([(1, i, t) for i, t in reversed(list(enumerate(text)))], "session long, seq int, token string").write.parquet(f"{tmp_path}/in")
    typed = spark.readStream.schema("session long, seq int, token string").parquet(f"{tmp_path}/in")
    q = editor.run_stream(typed, sent).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from alerts order by seq").collect()
    assert [(r.alert_type, r.token_index, list(r.replacement)) for r in got] == [(a[0], a[1], a[3]) for a in alone.alerts]


def test_transition_classifier(spark):
    from lexweave.operators import deps

    trees = [(s, i, p, h, r) for s in range(3) for i, p, h, r in ((1, "DET", 2, "det"), (2, "NOUN", 3, "nsubj"), (3, "VERB", 0, "root"))]
    trees += [(9, 1, "X", 3, "a"), (9, 2, "X", 4, "b"), (9, 3, "X", 0, "root"), (9, 4, "X", 3, "c")]  # crossing arcs
    rows = deps.training_rows(spark.createDataFrame(trees, "sent_id long, id int, pos string, head int, deprel string"))
    assert rows.where("transition is null").count() == 1 and rows.count() == 19
    arcs = D.parse({1: "DET", 2: "NOUN", 3: "VERB"}, choose := deps.train(rows))
    assert sorted(arcs) == [(0, 3, "root"), (2, 1, "det"), (3, 2, "nsubj")]
    assert choose(("NEW", "ROOT", "NEW", "NONE")) in choose.labels  # values not met in training
    gold = spark.createDataFrame(trees, "sent_id long, id int, pos string, head int, deprel string")
    got = evaluate.micro_attachment(evaluate.attachment(gold, deps.parse(gold, spark.sparkContext.broadcast(choose)))).first()
    assert got.n_tokens >= 9 and got.n_right >= 9


GRAMMAR = D.Grammar([("S", "NP", "VP", 0.0), ("NP", "DT", "NN", 0.0), ("VP", "VB", "NP", -0.5), ("VP", "VP", "NP", -1.5)], [("S", "NP", -2.0), ("X", "S", -1.0)], [(t, t, 0.0) for t in ("DT", "NN", "VB")])


def test_parse_equals_enumeration():
    """Best parses against all of them, by a plain recursion over spans, with chains of one child."""
    from functools import cache
    from itertools import product

    g = GRAMMAR

    @cache
    def best(tags, depth=3):
        found = {}
        if len(tags) == 1:
            found = {a: p for w, a, p in g.terminal if w == tags[0]}
        for k in range(1, len(tags)):
            for (b, x), (c, y) in product(best(tags[:k]).items(), best(tags[k:]).items()):
                for a, l, r, p in g.binary:
                    if (l, r) == (b, c):
                        found[a] = max(found.get(a, -math.inf), x + y + p)
        for _ in range(depth):
            for a, b, p in g.unary:
                if b in found:
                    found[a] = max(found.get(a, -math.inf), found[b] + p)
        return found

    for n in (1, 2, 3, 4, 5):
        for tags in product(("DT", "NN", "VB"), repeat=n):
            want = best(tags)
            score, tree = D.cky(list(tags), g)
            assert (tree is None) == (not want) and (not want or math.isclose(score, want.get("S", max(want.values())))), tags


def test_tagger_equals_enumeration():
    """Viterbi against all sequences of candidate tags, with a beam that keeps them all."""
    from itertools import product

    import numpy as np

    rng, tags = np.random.default_rng(1), ["A", "B", "C"]
    data = [([f"w{x}" for x in rng.integers(0, 6, 5)], list(rng.choice(tags, 5))) for _ in range(30)]
    t = D.tagger_of(data)
    t.beam = 10_000
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 8, 4)]
        score = {}
        for y in product(*(t.candidates(w) for w in words)):
            p = [T.START, T.START, *y]
            score[y] = sum(t.emission(w, z) + t.transition(p[i], p[i + 1], z) for i, (w, z) in enumerate(zip(words, y, strict=True)))
        got = tuple(t.tag(words))
        assert math.isclose(score[got], max(score.values()), rel_tol=1e-12)
    assert D.tagger_of([]).tag(["x"]) == [] and t.tag([]) == []


def test_segmentation_equals_enumeration():
    lm = D.lm_of([["a", "cat", "at", "sea"], ["the", "cat", "sat"], ["a", "t", "he"]])

    def splits(x):
        if not x:
            yield []
        fit = [n for n in range(1, len(x) + 1) if x[:n] in lm.vocabulary and (n > 1 or x[:n] in "ai")] or [1]
        for n in fit if x else ():
            for rest in splits(x[n:]):
                yield [x[:n], *rest]

    for text in ("thecatsat", "acatatsea", "catthesea", "zzat"):
        def score(words):
            p = ["<s>", "<s>", *words]
            return sum(lm.score(*p[i : i + 3]) for i in range(len(words)))

        assert math.isclose(score(D.segment(text, lm, beam=1000)), max(map(score, splits(text))))
    assert D.greedy_segment(" The Cat", {"the", "cat"}) == ["the", "cat"]


def test_passages(spark):
    """Sentences, parse, decision, surface check, and alerts shared out half to even; a sentence over 25 tokens is not parsed."""
    from lexweave.operators import passage

    words = "the cat saw the dog . the cat the the dog . ".split() + ["cat"] * 26 + ["!"] + ["dog"]
    tags = ["DT", "NN", "VB", "DT", "NN", "NN", "DT", "NN", "VB", "DT", "NN", "NN"] + ["NN"] * 27
    rows = spark.createDataFrame([(1, words, tags, 5, 20)], "id long, tokens array<string>, tags array<string>, merges int, corrections int")
    train = spark.createDataFrame([(["the", "cat", "saw", "the", "dog"],), (["the", "cat"],)], "words array<string>")
    got = passage.analyze(rows, ["id"], train, spark.sparkContext.broadcast(GRAMMAR)).orderBy("sentence_index").collect()
    assert [r.text for r in got][:2] == ["the cat saw the dog.", "the cat the the dog."] and [r.sentence_index for r in got] == [1, 2, 3, 4]
    assert got[2].pcfg == "unparseable (length > 25)" and got[3].pcfg == "0.00" and got[0].pcfg == "unparseable"
    assert got[1].issues == "repeated function word 'the the'" and got[1].verdict == "Ungrammatical"
    assert [r.merges for r in got] == [round(5 * n / 40) for n in (6, 6, 27, 1)] and [r.corrections for r in got] == [round(20 * n / 40) for n in (6, 6, 27, 1)]
    assert [value(spark, T.share_out(F.lit(a), F.lit(1), F.lit(2))) for a in (1, 5, 0)] == [0, 2, 0]


def test_segmentation_report(spark):
    a = (["the", "cat", "sat"], ["D", "N", "V"], ["the", "cat", "sat"], ["the", "cat", "sat"], ["D", "N", "N"], ["D", "N", "V"])
    b = (["a", "dog"], ["D", "N"], ["adog"], ["a", "dog"], ["N"], ["D", "D"])
    c = (["x"], ["N"], ["x"], ["x"], ["N"], ["N"])
    df = spark.createDataFrame([a, b, c], ", ".join(f"{k} array<string>" for k in ("words", "tags", "segmented", "greedy", "predicted", "tagged")))
    assert evaluate.segmentation(df).first().asDict() == {
        "sentences": 3, "model_exact": 2, "greedy_exact": 3, "joint_exact": 1, "gold_tags": 6, "comparable_tags": 4, "right_tags": 3, "genuine_errors": 1,
        "segmentation_errors": 2, "right_on_gold_words": 5,
    }


def test_corrector_examples(spark):
    s = spark.createDataFrame([(i, w) for i, w in enumerate(SPELL)], "id long, words array<string>")
    model = ngrams.fit(s, 2)
    vocabulary = {w for x in SPELL for w in x}
    e = evaluate.error_examples(s, model.unigrams.select(F.col("w").alias("word"))).collect()
    assert e and all(r.gold in vocabulary and (r.observed in vocabulary) == (r.kind == "real-word") for r in e)
    got = {(r.kind, r.method): r for r in evaluate.corrector(s, model, margin=0.5).collect()}
    assert got["non-word", "edit"].n_right == got["non-word", "symdelete"].n_right > 0
    with pytest.raises(ValueError):
        evaluate.benchmark_batch(model.unigrams, 1000)
    batch = evaluate.benchmark_batch(model.unigrams, 3).collect()
    assert len(batch) == 3 and all(r.observed not in vocabulary for r in batch)


def test_corrector_returns_a_small_plan(spark):
    """The four accuracies are worked out one by one: what is returned holds their rows, not their plans."""
    s = spark.createDataFrame([(i, w) for i, w in enumerate(SPELL)], "id long, words array<string>")
    out = evaluate.corrector(s, ngrams.fit(s, 2), margin=0.5)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.kind, r.method) for r in out.collect()} == {(k, m) for k in ("non-word", "real-word") for m in ("edit", "symdelete")}


def test_sources(spark, tmp_path):
    s = spark.createDataFrame([(d, i, [f"w{d}", f"x{i}"]) for d in range(3) for i in range(12)], "doc_id long, sent_no int, words array<string>")
    taken = corpora.passages(s).groupBy("doc_id").agg(F.count("*").alias("n"), (F.max("sent_no") - F.min("sent_no") + 1).alias("span")).collect()
    assert len(taken) == 3 and all(r.n == r.span and 5 <= r.n <= 8 for r in taken)
    model = ngrams.fit(s, 2)
    key = corpora.fingerprint("bigram", 2, 0.1)
    corpora.save_model({"table": model.table, "stats": model.stats}, str(tmp_path), key)
    back = corpora.load_model(spark, ["table", "stats"], str(tmp_path), key)
    assert back["table"].count() == model.table.count() and corpora.fingerprint("bigram", 2, 0.2) != key
    with pytest.raises(FileNotFoundError):
        corpora.load_model(spark, ["table"], str(tmp_path), corpora.fingerprint("other"))
    corpora.write_report(model.stats, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().total == 72
    assert corpora.markdown([{"a": 1, "b": "x|y"}]) == "| a | b |\n| --- | --- |\n| 1 | x\\|y |\n"
    assert value(spark, T.highlighted(F.lit("a bad word."), F.array(F.lit(1)))) == "a **bad** word."


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from lexweave.__main__ import main

    assert main(["vocab_stats", "--data", DIR, "--markdown", "--json", f"{tmp_path}/out"]) == 0
    assert capsys.readouterr().out.startswith("| v | total |\n| --- | --- |\n") and spark.read.json(f"{tmp_path}/out").count() == 1
    monkeypatch.setattr("sys.stdin", io.StringIO("The the, of.\nexit\nmore\n"))
    assert main(["--data", DIR, "--correct"]) == 0
    assert capsys.readouterr().out.count(" ms)") == 1
    with pytest.raises(SystemExit):
        main(["--data", DIR])


def test_typed_stream_with_merges(spark, tmp_path):
    sent = spark.sparkContext.broadcast(models())
    rows = [(1, "i would like to see the world a good sentnce".split())]
    spark.createDataFrame(rows, "session long, tokens array<string>").write.parquet(f"{tmp_path}/in")
    typed = spark.readStream.schema("session long, tokens array<string>").parquet(f"{tmp_path}/in")
    q = editor.type_stream(typed, sent, 100).writeStream.format("memory").queryName("typed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.alert_type, r.original) for r in spark.sql("select * from typed order by seq").collect()]
    alone = editor.Session().run(editor.inject_merges(spark.createDataFrame(rows, "session long, tokens array<string>"), 100).first().tokens, models(), flush=False)
    assert got == [(a[0], a[2]) for a in alone.alerts] and ("SEGMENT-ALERT", "liketo") in got


def test_sentence_queries_cover_all_sentences(spark):
    n = catalog.sents(spark, DIR).count()
    assert catalog._all(spark, DIR).count() == catalog.merge_injection(spark, DIR).count() == n
    assert catalog._held_out(spark, DIR).where("size(words) > 12").count() > 0


def test_decoder_tables_are_numbers(spark, monkeypatch):
    """Models of more n-grams than words, with the limit at the words: the same scores, tags and splits as models of dicts."""
    words = [["the", "dog", "runs"], ["the", "cat", "runs", "a", "mile"], ["a", "dog", "and", "a", "cat", "run"], ["the", "dog", "runs", "a", "mile"], ["ä", "the"]]
    s = spark.createDataFrame([(i, i, w) for i, w in enumerate(words)], "doc_id long, sent_no long, words array<string>")
    monkeypatch.setattr(catalog, "LOCAL_ROWS", len({w for x in words for w in x}) + 1)
    lm, plain = catalog.local_lm(s), D.lm_of(words)
    assert isinstance(lm.tri, D.Counts) and len(lm.tri) > catalog.LOCAL_ROWS and lm.uni == dict(plain.uni) and (lm.v, lm.total) == (plain.v, plain.total)
    names = [D.START, D.END, "none", *plain.vocabulary]
    assert all(lm.score(a, b, w) == plain.score(a, b, w) for a in names for b in names for w in names)
    assert {a: lm.c2.get(a) for a in names} == {a: plain.c2.get(a) for a in names}
    tag = lambda w: w[-1] if w != "runs" else "V"
    rows = [(i, k, w, "N" if (w, i) == ("run", 2) else tag(w)) for i, x in enumerate([*words, ["run", "run"]]) for k, w in enumerate(x)]
    monkeypatch.setattr(catalog, "LOCAL_ROWS", 1000)
    tagger = catalog.local_tagger(spark.createDataFrame(rows, "sent long, pos int, word string, tag string"))
    old = D.tagger_of([([r[2] for r in rows if r[0] == i], [r[3] for r in rows if r[0] == i]) for i in range(len(words) + 1)])
    old.common = tagger.common
    assert isinstance(tagger.emit, D.Counts) and tagger.names == old.names
    assert all(tagger.candidates(w) == old.candidates(w) and tagger.emission(w, t) == old.emission(w, t) for w in [*plain.vocabulary, "run", "none"] for t in old.names)
    assert all(tagger.tag(x) == old.tag(x) for x in [*words, ["none", "run", "a"]])
    empty = D.Counts(({}, {}), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert D.summed(pickle.loads(pickle.dumps(empty))).get("a", 0) == 0
    sent = pickle.loads(pickle.dumps((lm, tagger)))
    assert sent[0].tri.keys.tolist() == lm.tri.keys.tolist() and all(sent[0].score(a, b, w) == plain.score(a, b, w) for a in names for b in names for w in names)
    assert all(sent[1].tag(x) == old.tag(x) for x in words)


def test_scores_move_ngrams_once(spark):
    """A sentence's n-grams are shuffled for their counts and for their sum, no more; unseen words, contexts and empty tables count as 0."""
    s = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a", "c"]), (None, ["z", "z"]), (3, [])], "id long, words array<string>")
    train = spark.createDataFrame([(["a", "b"],), (["a", "b", "a", "b"],), (["c"],)], "words array<string>")
    for n in (2, 3):
        p = ngrams.scored(ngrams.fit(train, n), s)
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" not in plan and plan.count("RepartitionByExpression") == 1
        grams, context = {}, {}
        for r in train.collect():
            w = [T.START] * (n - 1) + r.words + [T.END]
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])] = grams.get(tuple(w[i : i + n]), 0) + 1
                context[tuple(w[i : i + n - 1])] = context.get(tuple(w[i : i + n - 1]), 0) + 1
        want = {}
        for r in s.collect():
            w = [T.START] * (n - 1) + r.words + [T.END]
            at = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            want[r.id] = (len(r.words), round(sum(math.log((grams.get(g, 0) + 0.1) / (context.get(g[:-1], 0) + 0.1 * 4)) for g in at), 9))
        assert {r.id: (r.n_words, round(r.logprob, 9)) for r in p.collect()} == want
    assert ngrams.scored(ngrams.fit(train.limit(0), 2), s.where("id = 2")).first().n_words == 2


def test_transition_steps_equal_states_and_are_linear(spark):
    """The features and moves without states against those of all states; equal trees counted once give the same model rows and scores;
    a sentence of 20,000 words takes no copy of its states."""
    import time

    from lexweave.operators import deps

    rng, trees = np.random.default_rng(5), []
    for n in [1, 2, 3, *rng.integers(1, 12, 40)]:
        pos = [("DT", "NN")[int(x)] for x in rng.integers(0, 2, int(n))]
        trees.append((pos, [0 if i == n else i + 1 if p == "DT" else int(n) for i, p in enumerate(pos, 1)], ["root" if i == n else "det" if p == "DT" else "obl" for i, p in enumerate(pos, 1)]))
    trees += trees[:9] + [(["A", "B", "C", "D"], [3, 4, 0, 3], ["a", "b", "root", "c"])]
    for pos, head, rel in trees[:-1]:
        heads, tags = dict(enumerate(zip(head, rel, strict=True), 1)), dict(enumerate(pos, 1))
        assert D.steps(heads, tags) == [(D.features(s, tags), m) for s, m in D.oracle(heads)]
    with pytest.raises(ValueError):
        D.steps(dict(enumerate(zip(*trees[-1][1:], strict=True), 1)), dict(enumerate(trees[-1][0], 1)))
    rows = spark.createDataFrame([(k, i, p, h, r) for k, t in enumerate(trees) for i, (p, h, r) in enumerate(zip(*t, strict=True), 1)], "sent_id long, id int, pos string, head int, deprel string")
    alike = deps.alike(spark.createDataFrame(trees, "pos array<string>, head array<int>, deprel array<string>")).cache()
    assert alike.count() < len(trees)
    count = lambda df, n: {tuple(r)[:-1]: r[-1] for r in df.groupBy(*deps.FEATURES, "transition").agg(n.alias("n")).collect()}
    assert count(deps.counted_rows(alike), F.sum("times")) == count(deps.training_rows(rows), F.count("*"))
    choose = spark.sparkContext.broadcast(deps.train(deps.counted_rows(alike)))
    want = evaluate.micro_attachment(evaluate.attachment(rows, deps.parse(rows, choose))).first()
    assert evaluate.micro_attachment(deps.attached(alike, choose)).first() == want and want.n_tokens > 0
    n, began = 20_000, time.time()
    steps = D.steps({i: (n if i < n else 0, "obl") for i in range(1, n + 1)}, dict.fromkeys(range(1, n + 1), "NN"))
    assert len(steps) == 2 * n and len(D.parse(dict.fromkeys(range(1, n + 1), "NN"), lambda f: "SHIFT" if f[2] != "NONE" else "LEFT-ARC(obl)" if f[1] != "ROOT" else "RIGHT-ARC(root)")) == n
    assert time.time() - began < 5


def test_edges_of_repeated_keys_and_long_texts_without_a_join_of_substrings(spark):
    """Edges and their sums against a plain search, in texts longer than a piece, with keys that repeat; no substring is moved, and the
    words go to the tasks as numbers whatever the limit for words."""
    rng = np.random.default_rng(6)
    vocabulary = ["a", "i", "b", "ab", "abc", "ba", "cab", "x" * 20, "y" * 21, "caba"]
    texts = [(1, "".join("abcx"[int(c)] for c in rng.integers(0, 4, 700))), (2, "x" * 45 + "y" * 30), (3, "abcab"), (3, "zzabcab"), (None, "é😀abc"), (4, "")]
    known, places = {w for w in vocabulary if (len(w) > 1 or w in "ai") and len(w) <= 20}, {}
    for key, t in texts:
        for lo in range(len(t)):
            places.setdefault((key, lo), []).append([lo + k for k in range(1, 21) if lo + k <= len(t) and t[lo : lo + k] in known])
    want = sorted(((key, lo, hi) for (key, lo), ends in places.items() for hi in (sum(ends, []) if any(ends) else [lo + 1] * len(ends))), key=str)
    df, words = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(w,) for w in vocabulary], "word string")
    assert sorted(map(tuple, spell.dictionary_edges(df, ["doc_id"], words).collect()), key=str) == want
    sums = spell.edge_totals(df, ["doc_id"], words)
    got = {r.doc_id: (r.n_edges, r.digest) for r in sums.collect()}
    assert got == {key: (sum(k == key for k, _, _ in want), sum(lo * 31 + hi for k, lo, hi in want if k == key)) for key in {k for k, _, _ in want}}
    plan = sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1


def test_packed_perplexities_are_those_of_the_joins(spark, monkeypatch):
    from lexweave.operators import packed

    monkeypatch.setattr(packed.chunks, "__defaults__", (3,))  # chunks of three words
    train = [["a", "b", "a"], ["b", "b"], ["</s>x", "a"], ["a", "b", "a"]]
    ask = [["a", "b"], [], ["zz", "a", "b", "a", "zz"], ["b"], ["a", "b"]]
    rows = [(None, w, True, False) for w in train] + [(i, w, False, True) for i, w in enumerate(ask)] + [(9, ["a", "zz"], True, True)]
    rows = spark.createDataFrame(rows, "id long, words array<string>, counted boolean, asked boolean").repartition(3)
    for part in (rows, rows.where("asked and not counted"), rows.where("counted and not asked")):
        got = {r.id: (r.tri, r.bi) for r in packed.perplexities(part, {"tri": (3, 0.1), "bi": (2, 0.01)}).collect()}
        t, s = part.where("counted").select("words"), part.where("asked").select("id", "words")
        for i, (n, k) in enumerate(((3, 0.1), (2, 0.01))):
            want = {r.id: r.perplexity for r in ngrams.perplexity(ngrams.fit(t, n, k), s).collect()}
            assert {x: v[i] for x, v in got.items()} == pytest.approx(want)


def test_passage_sentences_and_scores_move_no_ngrams_as_strings(spark):
    from lexweave import catalog

    for name in ("passage_scores", "passage_report"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "w1" not in plan and "MapInArrow" in plan


def test_passages_of_one_key_are_one_text(spark):
    from lexweave.operators import passage

    rows = [(1, "One two. Three four", ["One", "two", ".", "Three", None, "four"], ["A", "B", "."]), (2, "", [], []), (3, "x. y", ["x", "."], ["A", "."]), (3, "y! z", ["y", "!"], ["B", "."]), (4, "!", ["!"], ["."])]
    p = spark.createDataFrame(rows, "id long, text string, tokens array<string>, tags array<string>")
    got = {(r.id, r.sentence_index): (sorted(r.tokens), r.tags) for r in passage.split_sentences(p, ["id"]).collect()}
    assert got[1, 1] == ([".", "One", "two"], ["A", "B", "."]) and got[1, 2] == (["Three", "four"], ["NN", "NN"])
    assert got[4, 1] == (["!"], ["."]) and not any(k == 2 for k, _ in got)
    assert sum(len(t) for (k, _), (t, _) in got.items() if k == 3) == 4
    want = {(r.id, r.sentence_index): r.trigram_perplexity for r in passage.scores(passage.split_sentences(p, ["id"]), ["id", "sentence_index"], ngrams.sentences(p.select(F.col("id").alias("doc_id"), "text"), None)).collect()}
    assert {(r.id, r.sentence_index): r.trigram_perplexity for r in passage.own_scores(p, ["id"]).collect()} == pytest.approx(want)


def test_corruption_detection_adds_up_sentences_of_one_id(spark, tmp_path):
    d = spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(20)
    d.withColumn("doc_id", F.col("doc_id") % 7).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["corruption_detection"](spark, str(tmp_path))
    assert "w1" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = c.sql(catalog.ORACLE_SQL["corruption_detection"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
