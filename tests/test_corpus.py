import math

import numpy as np

from graphloom.operators import corpus, embedding, kg, linking, text
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_questions_and_equations(spark):
    docs = spark.createDataFrame([(1, "It rose. Why so? Yes $a+b$ and $$c$$."), (2, None), (3, "")], "doc_id long, text string")
    assert rows(corpus.questions(docs)) == [(1, "Why so?")]
    got = rows(corpus.equations(docs))
    assert [r[1] for r in got] == ["$$c$$", "$a+b$"] and all(r[2].startswith("Ltxqtn") for r in got)


def test_split_is_whole_and_stable(spark):
    df = spark.range(1000)
    parts = {"train": 70, "dev": 20, "test": 10}
    a, b = (rows(corpus.split(df, "id", parts)) for _ in range(2))
    assert a == b and {p for _, p in a} == set(parts)


def test_brackets_and_productions(spark):
    t = spark.createDataFrame([(1, "(S (NP (NN a)) (VP b))"), (2, "(S"), (3, "")], "tree_id long, tree string")
    assert rows(corpus.bracket_depths(t)) == [(1, 3, 4, True), (2, 1, 1, False), (3, 0, 0, True)]
    nodes = spark.createDataFrame([(1, 0, None, 0, "S"), (1, 1, 0, 0, "NP"), (1, 2, 0, 1, "VP"), (1, 3, 1, 0, "a")], "tree_id long, node long, parent long, ord int, label string")
    rules = corpus.productions(nodes)
    assert rows(rules) == [("NP", ["a"]), ("S", ["NP", "VP"])]
    assert rows(corpus.roots_and_terminals(rules)) == [("S", "root"), ("VP", "terminal"), ("a", "terminal")]


def test_closure_and_spans(spark):
    deps = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 5, 6)], "sent long, gov long, dep long")
    starts = spark.createDataFrame([(1, 1)], "sent long, token long")
    assert rows(corpus.closure(deps, starts)) == [(1, 1), (1, 2), (1, 3)]
    inner = spark.createDataFrame([(1, 70, 80), (1, 5, 300)], "doc long, start long, end long")
    outer = spark.createDataFrame([(1, 60, 200), (1, 70, 90)], "doc long, start long, end long")
    assert rows(corpus.spans_within(inner, outer)) == [(1, 70, 80, 60, 200)]


def test_category_filter_and_latest(spark):
    p = spark.createDataFrame([("arxiv", [("a",)]), ("arxiv", [("a",), ("b",)]), ("pubmed", [("a",)])], "source string, tags array<struct<term string>>")
    assert corpus.category_filter(p, ["a"]).count() == 2
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, t int, v string")
    assert rows(corpus.latest(df, ["k"], [F.col("t")])) == [("k", 2, "new")]


def test_translations_prefer_true_tails(spark):
    t = spark.createDataFrame([(i, i, i + 100, 1) for i in range(40)], "triple_id long, head long, tail long, relation long")
    e, r = linking.fit_translations(t, epochs=60)
    q = spark.createDataFrame([(3, 1)], "head long, relation long")
    best = linking.tails(q, e, r, 2).collect()
    assert len(best) == 2 and all(x["tail"] != 3 for x in best)


def test_every_fact_is_scored_whatever_the_block(spark):
    t = spark.createDataFrame([(i, i, i + 1000, i % 7) for i in range(300)], "triple_id long, head long, tail long, relation long")
    ids = spark.createDataFrame([(i,) for i in (3, 5000, None)], "id long")
    e, r = linking.fit_translations(t, block=40)
    scores = embedding.translation_scores(kg.facts(t), e, r).collect()
    assert len(scores) == 300 and all(math.isfinite(x["score"]) for x in scores)
    e, r = linking.fit_translations(t, epochs=1, entities=ids, block=40)
    assert e.count() == e.select("id").distinct().count() == 601 and r.count() == 7
    assert len(linking.tails(spark.createDataFrame([(i, i % 7) for i in range(300)], "head long, relation long"), e, r, 1).collect()) == 300


def test_any_number_of_topic_queries_finds_its_nearest_tails(spark):
    r = np.random.default_rng(5)
    ents, rels = r.normal(size=(320, 4)), r.normal(size=(330, 4))
    ents[7] = ents[5]  # equal distances go by id
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    q = spark.range(320 * 330).select(F.expr("id div 330").alias("head"), (F.col("id") % 330).alias("relation"))
    got = {}
    for x in linking.tails(q, frame(ents), frame(rels), 2).collect():
        got.setdefault((x["head"], x["relation"]), []).append((x["score"], x["tail"]))
    assert len(got) == 320 * 330
    for h, k in [(5, 0), (7, 1), *r.integers(0, 320, (300, 2)).tolist()]:
        d = np.linalg.norm(ents[h] + rels[k] - ents, axis=1)
        want = sorted((d[t], t) for t in range(320) if t != h)[:2]
        assert [t for _, t in sorted(got[h, k])] == [t for _, t in want] and np.allclose(sorted(s for s, _ in got[h, k]), [s for s, _ in want])


def test_blocks_train_all_facts(spark):
    """Trained over several blocks, true tails fit better than wrong ones."""
    t = spark.createDataFrame([(i, i, i + 1000, 1) for i in range(200)], "triple_id long, head long, tail long, relation long")
    wrong = t.withColumn("tail", (F.col("head") * 3 + 7) % 200 + 1000)
    e, r = linking.fit_translations(t, epochs=6, block=60)
    mean = lambda facts: np.mean([x["score"] for x in embedding.translation_scores(facts, e, r).collect()])
    assert mean(t) < mean(wrong)


def test_bleu_of_known_pairs(spark):
    import math

    data = [(1, "the cat sat on the mat".split(), "the cat sat on the mat".split()), (2, "the cat sat".split(), "the the the cat".split()), (3, "a b c d".split(), "a b".split()), (4, None, ["x"]), (5, ["x"], [])]
    got = {r["pair_id"]: r for r in text.bleu(spark.createDataFrame(data, "pair_id long, reference array<string>, hypothesis array<string>")).collect()}
    assert math.isclose(got[1]["bleu_5"], 1.0) and math.isclose(got[2]["bleu_1"], 0.5)
    assert math.isclose(got[2]["bleu_2"], math.sqrt(0.5 / 3)) and math.isclose(got[3]["bleu_1"], math.exp(-1)) and got[4]["bleu_1"] == 0 == got[5]["bleu_1"]


def test_ranked_sentences(spark):
    docs = spark.createDataFrame([(1, "Fever spread in towns. Fever spread fast in towns! Cows eat grass."), (2, None), (3, ""), (4, "One only")], "doc_id long, text string")
    got = {(r["doc_id"], r["sent"]): r["rank"] for r in text.ranked_sentences(docs).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (4, 0)} and got[1, 0] == got[1, 1] > got[1, 2]


def test_adapted_vectors_agree_where_the_sides_do(spark):
    r = np.random.default_rng(5)
    z = r.normal(size=(300, 3))
    x, y = z @ r.normal(size=(3, 6)) + 0.01 * r.normal(size=(300, 6)), z @ r.normal(size=(3, 5)) + 0.01 * r.normal(size=(300, 5))
    general = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x[:200])], "token string, vec array<double>")
    domain = spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(y)], "token string, vec array<double>")
    got = {t["token"]: np.array(t["vec"]) for t in embedding.adapted(general, domain, 3).collect()}
    assert len(got) == 300 and all(len(v) == 3 for v in got.values())
    m = np.stack([got[f"w{i}"] for i in range(300)])
    fit = z @ np.linalg.lstsq(z, m, rcond=None)[0]
    assert np.abs(fit - m).max() < 0.2  # the common part is found, also for words of the domain alone
    assert embedding.adapted(general.limit(0), domain).count() == 0


def test_dictionaries_and_draws(spark):
    a, b = (spark.createDataFrame(d, "key string, n long") for d in ([("x", 3), ("y", 1)], [("x", 1), ("y", 1), ("z", 2)]))
    assert rows(corpus.combined(a, b)) == [("x", 4), ("y", 2), ("z", 2)] and rows(corpus.combined(a, b, -1, True)) == [("x", 2)]
    f = spark.createDataFrame([("a | b", "r", "c"), ("d", "s t", "e")], "head_name string, relation_name string, tail_name string")
    got = sorted(tuple(r["tokens"]) for r in corpus.drawn_query(f, 2).collect())
    assert got[1] == ("d", "s", "t", "e") and got[0] in {("a", "r", "c"), ("b", "r", "c")}
    vocab = spark.createDataFrame([("p", 3), ("q", 4)], "token string, id long")
    vecs = spark.createDataFrame([("p", [1.0, 3.0])], "token string, vec array<double>")
    placed = {r["token"]: r["vec"] for r in embedding.in_order(vocab, vecs, 2).collect()}
    assert placed["p"] == [1.0, 3.0] and len(placed["q"]) == 2
