import math

import pytest
from graphloom.operators import semantics as S
from pyspark.sql import functions as F

PARTS = "part string, clust long, reltype string, par string, dep string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def xl(x):
    return x * math.log(x) if x > 0 else 0.0


def sentence(n, verb, subj, obj):
    c = {"rise": 1, "climb": 2, "case": 3, "rate": 4, "fast": 5, "town": 6}
    return [(f"{n}:v", c[verb], verb, None, None), (f"{n}:s", c[subj], subj, f"{n}:v", "nsubj"), (f"{n}:o", c[obj], obj, f"{n}:v", "dobj")]


@pytest.fixture(scope="module")
def parts(spark):
    data = sum((sentence(i, *x) for i, x in enumerate([("rise", "case", "fast"), ("rise", "rate", "fast"), ("rise", "case", "town"), ("climb", "case", "fast"), ("climb", "rate", "town")])), [])
    return spark.createDataFrame(data, PARTS)


def test_count_tables(spark, parts):
    tab = S.tables(parts)
    assert rows(tab["totals"]) == [(1, 3), (2, 2), (3, 3), (4, 2), (5, 3), (6, 2)]
    assert (1, "nsubj", 3, 2) in rows(tab["children"]) and rows(tab["roots"]) == [(1, 3), (2, 2)]
    assert rows(tab["args"]) == [(1, "dobj", 3, 3), (1, "nsubj", 3, 3), (2, "dobj", 2, 2), (2, "nsubj", 2, 2)]
    assert {tuple(r["args"]) for r in S.ordered_args(tab).collect()} == {("nsubj", "dobj")}


def test_merging_gains_what_the_likelihood_gains(spark, parts):
    """The score of merging the two verbs is the change of the likelihood, since their arguments align."""
    tab = S.tables(parts)
    got = {(r["c1"], r["c2"]): r["score"] for r in S.merge_scores(tab, least=3).collect()}
    label = spark.createDataFrame([(2, 1)], "clust long, merged long")
    change = S.likelihood(S.merged(parts, label)) - S.likelihood(parts)
    # the parts' own sums of roots are not in the score; types of the arguments are kept apart in both
    assert set(got) == {(1, 2)} and math.isclose(got[1, 2], change, abs_tol=1e-6)
    conj = spark.createDataFrame([(1, 2, 3)], "a long, b long, n long")
    assert math.isclose(S.merge_scores(tab, conj, 3).first()["score"], got[1, 2] - 30)


def test_arguments_merge(spark, parts):
    more = parts.unionByName(spark.createDataFrame([(f"9{i}:v", 7, "rain", None, None) for i in range(6)] + [(f"9{i}:s", 3, "case", f"9{i}:v", "a" if i % 2 else "b") for i in range(6)], PARTS))
    tab = S.tables(more)
    scores = S.argument_scores(more, tab)
    got = {r["clust"]: r["score"] for r in scores.where("clust = 7").collect()}
    want = xl(6) + xl(0) - 2 * xl(3) - 2 * (xl(6) - 2 * xl(3)) + xl(6) - 2 * xl(3) + 5 + (xl(6) - 2 * xl(3) + 5)
    assert math.isclose(got[7], want)
    assert rows(S.merged_args(scores, tab).where("clust = 7")) == [(7, "a", "b"), (7, "b", "b")]


def test_composing(spark, parts):
    new = S.composed(parts, 1, 5, 100)
    assert rows(new.where("clust = 100").select("part", "reltype", "par")) == [("0:v", "rise (dobj:fast)", None), ("1:v", "rise (dobj:fast)", None)]
    assert new.count() == parts.count() - 2 and new.where("part = '0:s'").first()["par"] == "0:v"
    assert S.compose_score(parts, 3, 5, 100) == -10000.0
    assert math.isclose(S.compose_score(parts, 1, 5, 100), S.likelihood(new) - S.likelihood(parts))


def test_questions_find_answers(spark):
    tokens = [(1, 0, i + 1, f, m, p) for i, (f, m, p) in enumerate([("Bats", "bat", "NNS"), ("and", "and", "CC"), ("rats", "rat", "NNS"), ("carry", "carry", "VBP"), ("marsh", "marsh", "NN"), ("viruses", "virus", "NNS")])]
    tokens += [(2, 0, i + 1, f, m, p) for i, (f, m, p) in enumerate([("Cows", "cow", "NNS"), ("never", "never", "RB"), ("carry", "carry", "VBP"), ("viruses", "virus", "NNS")])]
    deps = [(1, 0, "nsubj", 4, 1), (1, 0, "conj_and", 1, 3), (1, 0, "dobj", 4, 6), (1, 0, "nn", 6, 5), (1, 0, "ROOT", 0, 4), (2, 0, "nsubj", 3, 1), (2, 0, "neg", 3, 2), (2, 0, "dobj", 3, 4), (2, 0, "ROOT", 0, 3)]
    parts, clusters = S.parts_of(spark.createDataFrame(tokens, "doc long, sent int, idx int, form string, lemma string, pos string"), spark.createDataFrame(deps, "doc long, sent int, rel string, gov int, dep int"))
    assert clusters.count() == 7 and parts.count() == 9 and parts.where("par is null").count() == 2
    q = spark.createDataFrame([(1, "carry", "nsubj", "the rat"), (2, "carry", "dobj", "virus"), (3, "carry", "nsubj", "cow"), (4, "carry", "nsubj", "zebra"), (5, "eat", "nsubj", "bat")], "q long, rel string, dep string, arg string")
    assert rows(S.answers(q, parts).select("q", "answer")) == [(1, "marsh viruses"), (2, "Bats")]


def test_parts_of_sentences_equal_those_of_tables(spark):
    """Gaps, several governors, governors without a part, rings, empty sentences."""
    import random

    rng = random.Random(3)
    tokens, deps, sents = [], [], []
    for doc in range(40):
        idx = rng.sample(range(1, 20), rng.randint(0, 9))
        t = [(i, rng.choice("abc"), rng.choice("xyz"), rng.choice(["NN", "VB"])) for i in idx]
        x = [(rng.choice(["nsubj", "dobj", "conj"]), rng.choice([0, 99, *idx]), i) for i in idx for _ in range(rng.choice([0, 1, 1, 2]))]
        tokens += [(doc, 0, *r) for r in t]
        deps += [(doc, 0, *r) for r in x]
        sents.append((doc, 0, t, x))
    t = spark.createDataFrame(tokens, "doc long, sent int, idx int, form string, lemma string, pos string")
    d = spark.createDataFrame(deps, "doc long, sent int, rel string, gov int, dep int")
    s = spark.createDataFrame(sents, "doc long, sent int, tokens array<struct<idx:int,form:string,lemma:string,pos:string>>, deps array<struct<rel:string,gov:int,dep:int>>")
    old, new = S.parts_of(t, d)[0], S.sentence_parts(s)
    names = ["part", "reltype", "par", "dep", "doc", "sent", "idx", "form", "lemma", "pos"]
    assert rows(old.select(*names)) == rows(new.select(*names))
    assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    want = S.tables(old.withColumn("clust", F.xxhash64("reltype")))
    for few in (False, True):
        got = S.sentence_tables(new.withColumn("clust", F.xxhash64("reltype")).withColumn("head", F.when(F.col("head").isNotNull(), F.xxhash64("head"))), few)
        for k in want:
            assert rows(got[k].select(*want[k].columns)) == rows(want[k]), k


def test_answers_join_no_tables_of_all_parts(spark, tmp_path, monkeypatch):
    from graphloom.plans import registry

    docs = [(1, "disease kills cattle"), (2, "disease hits"), (3, "fever kills cattle"), (4, None), (5, ""), (6, "disease kills people cattle kills grass")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.delattr(S, "parts_of")
    assert rows(registry.sem_answers(spark, str(tmp_path)).select("part", "answer")) == [("1:0:003", "cattle"), ("6:0:003", "people")]


def test_numbered_args_read_the_sentences_once(spark):
    token, dep = "array<struct<idx: int, form: string, lemma: string, pos: string>>", "array<struct<rel: string, gov: int, dep: int>>"
    word = lambda i, w: (i, w, w, "N")
    data = [(1, 0, [word(1, "b"), word(2, "a"), word(3, "c"), word(4, "b")], [("x", 2, 1), ("root", 0, 2), ("y", 2, 3), ("y", 2, 4)]), (2, 0, [word(1, "c"), word(2, "b")], [("z", 2, 1), ("root", 0, 2)])]
    schema = f"doc int, sent int, tokens {token}, deps {dep}"
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    parts = S.sentence_parts(spark.createDataFrame(data, schema).mapInPandas(seen, schema))
    got = S.numbered_args(parts).collect()
    assert read.value == 2
    assert sorted((r["clust"], r["args"]) for r in got) == [(0, ["y", "x"]), (1, ["z"])]
    tab = S.sentence_tables(parts.withColumn("clust", F.col("reltype")))
    assert sorted(map(tuple, S.ordered_args({"args": S.with_ids(tab["args"], tab["totals"], "clust")}).collect())) == sorted(map(tuple, got))


def test_tables_of_few_clusters_read_the_sentences_once(spark):
    token, dep = "array<struct<idx: int, form: string, lemma: string, pos: string>>", "array<struct<rel: string, gov: int, dep: int>>"
    word = lambda i, w: (i, w, w, "N")
    data = [(1, 0, [word(1, "b"), word(2, "a"), word(3, "c"), word(4, "b")], [("x", 2, 1), ("root", 0, 2), ("y", 2, 3), ("y", 2, 4)]), (2, 0, [word(1, "c"), word(2, "b")], [("z", 2, 1), ("root", 0, 2)])]
    schema = f"doc int, sent int, tokens {token}, deps {dep}"
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    parts = S.sentence_parts(spark.createDataFrame(data, schema).mapInPandas(seen, schema)).withColumn("clust", F.col("reltype"))
    once = {name: rows(df) for name, df in S.sentence_tables(parts, few=True).items()}
    assert read.value == 2
    assert once == {name: rows(df) for name, df in S.sentence_tables(parts).items()}
