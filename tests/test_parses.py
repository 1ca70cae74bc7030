from graphloom.operators import parses as P
from graphloom.sources import readers, sinks
from pyspark.sql import functions as F

TOKENS = "doc long, sent int, idx int, form string, lemma string, pos string"
DEPS = "doc long, sent int, rel string, gov int, dep int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_dependency_lines(spark):
    lines = ["nsubj(rose-2, Cases-1)", "det(town-5, the-4)", "prep_in(rose-2, town-5)", "root(ROOT-0, rose-2)", "conj_and(rose-2, rose-2)", "broken", "punct(rose-2', .-6)", None]
    data = spark.createDataFrame([(1, 0, x) for x in lines], "doc long, sent int, line string")
    got = P.dependencies(data)
    assert rows(got.select("rel", "gov", "dep", "dep_form")) == sorted([("ROOT", 0, 2, "rose"), ("nsubj", 2, 1, "Cases"), ("prep_in", 2, 5, "town")], key=str)
    assert [r["dep"] for r in P.ordered(got).first()["deps"]] == [1, 2, 5]
    assert P.dependencies(data.limit(0)).count() == 0


def test_sentences_of_parses(spark):
    tokens = spark.createDataFrame([(1, 0, 1, "Cases", "case", "NNS"), (1, 0, 2, "hit", "hit", "VBD"), (1, 0, 3, "towns", "town", "NNS"), (1, 1, 1, "Why", "why", "WRB"), (1, 0, 4, "be", "be", "VB")], TOKENS)
    deps = spark.createDataFrame([(1, 0, "nsubj", 2, 1), (1, 0, "dobj", 2, 3), (1, 0, "ROOT", 0, 2), (1, 1, "dep", 7, 1), (1, 2, "x", 2, 1), (1, 2, "x", 1, 2)], DEPS)
    assert rows(P.triples(tokens, deps).select("subj", "rel", "obj")) == [("Cases", "hit", "towns")]
    assert rows(P.with_verb(tokens)) == [(1, 0)]
    got = {(r["sent"], r["idx"]): r["ignored"] for r in P.reached(deps).collect()}
    assert got == {(0, 1): False, (0, 2): False, (0, 3): False, (1, 1): True, (2, 1): True, (2, 2): True}
    starts = spark.createDataFrame([(1, 0, 2)], "doc long, sent int, token int")
    assert rows(P.subtree(tokens, deps, starts, "N").select("form")) == [("Cases",), ("towns",)]
    kinds = dict(tokens.select("form", P.kind(F.col("pos"), F.col("lemma"))).collect())
    assert kinds["hit"] == "C" and kinds["be"] == "N" and kinds["Why"] == "N"


def test_mentions_and_triples(spark):
    s = spark.createDataFrame([(1, 0, "the ward closed . it reopened".split()), (1, 1, ["x"]), (2, 0, None)], "doc long, sent int, words array<string>")
    m = spark.createDataFrame([(1, 0, 4, 5, ["the", "ward"]), (1, 0, 0, 2, ["Ward", "B"]), (1, 0, 1, 2, ["lost"])], "doc long, sent int, start int, end int, better array<string>")
    got = {(r["doc"], r["sent"]): r["words"] for r in P.resolved(s, m).collect()}
    assert got[1, 0] == "Ward B closed . the ward reopened".split() and got[1, 1] == ["x"] and got[2, 0] is None
    t = spark.createDataFrame([(1, 0, 0, ["a b", "c", "d"]), (1, 0, 1, ["a", "b c", "d e"]), (1, 0, 2, ["a b c", "d", "e"])], "doc long, sent int, n int, triple array<string>")
    assert rows(P.longest(t)) == [(1, 0, ["a", "b c", "d e"])]
    spans = spark.createDataFrame([(1, 0, 0, [3, 4]), (1, 0, 1, [9])], "doc long, sent int, n int, span array<int>")
    ments = spark.createDataFrame([(1, 0, [4, 5]), (1, 0, [1])], "doc long, sent int, mention array<int>")
    assert rows(P.expanded(spans, ments)) == [(1, 0, 0, [3, 4, 5]), (1, 0, 1, [9])]
    raw = spark.createDataFrame([(1, "Cases!", "were rising", "quickly in town"), (2, "Red", "is", "case"), (3, "case", "a b c d e", "town"), (4, "case", "is", "town"), (5, None, "is", "town")], "id long, subj string, rel string, obj string")
    lemmas = spark.createDataFrame([("were", "be"), ("is", "be"), ("rising", "rise")], "form string, lemma string")
    nouns = spark.createDataFrame([("cases",), ("case",), ("town",)], "form string")
    assert rows(P.preprocessed(raw, lemmas, nouns)) == [(1, "cases", "rise", "quickly in town"), (4, "case", "be", "town")]


def test_equations(spark):
    tokens = spark.createDataFrame([(1, 0, i + 1, f, f, "N") for i, f in enumerate(["rate", "Ltxqtnx", "falls"])], TOKENS)
    formulas = spark.createDataFrame([("Ltxqtnx", ["a", "=", "b"])], "tag string, words array<string>")
    assert rows(P.replaced_equations(tokens, formulas).select("idx", "form")) == [(1, "rate"), (2, "a"), (3, "="), (4, "b"), (5, "falls")]
    deps = spark.createDataFrame([(1, 0, "dep", 3, 2), (1, 0, "ROOT", 0, 3)], DEPS)
    assert rows(P.shifted(deps, tokens, formulas).select("rel", "gov", "dep")) == [("ROOT", 0, 5), ("dep", 5, 2)]
    one = spark.range(1).select(P.latex(F.lit(r"$$\left( \mathrm{R} \, = ~ x \right)$$")), P.symbol(F.lit("x_i_VAR")), P.symbol(F.lit("x"))).first()
    assert one[0] == "( {R} = x )" and tuple(one[1]) == ("x_i", "VAR") and tuple(one[2]) == ("x", None)


def test_read_and_written_parses(spark, tmp_path):
    inputs = spark.createDataFrame([("d1", "Cases_NNS\nrose_VBD\n\nWhy_WRB\n"), ("d2", "")], "doc string, text string")
    morphs = spark.createDataFrame([("d1", "case_NN\nrise:x\n\nwhy\n")], "doc string, text string")
    t = readers.parse_tokens(inputs, morphs)
    assert rows(t) == sorted([("d1", 0, 0, "ROOT", "ROOT", "ROOT"), ("d1", 0, 1, "Cases", "NNS", "case"), ("d1", 0, 2, "rose", "VBD", "rise.x"), ("d1", 1, 0, "ROOT", "ROOT", "ROOT"), ("d1", 1, 1, "Why", "WRB", "why")], key=str)
    deps = spark.createDataFrame([("d1", 0, "nsubj", 2, 1), ("d1", 0, "ROOT", 0, 2)], "doc string, sent int, rel string, gov int, dep int")
    sinks.parse_files(t, deps, str(tmp_path / "p"))
    back = spark.read.text(str(tmp_path / "p" / "dep"), wholetext=True).first()["value"].split("\n")
    assert back[:2] == ["nsubj(rose-2, Cases-1)", "ROOT(ROOT-0, rose-2)"]
    again = readers.parse_tokens(*(spark.read.text(str(tmp_path / "p" / k), wholetext=True).select("doc", F.col("value").alias("text")) for k in ("input", "morph")))
    assert rows(again) == rows(t)


def test_articles(spark, tmp_path):
    for source, name, text in [
        ("pubmed", "a.xml", "<article><front><journal-title>J</journal-title><article-id pub-id-type='doi'>10.1/x</article-id><article-title>On <i>R</i> &amp; S</article-title><pub-date><year>2001</year></pub-date></front><body><p>One  two.</p><p id='2'>Three &lt; four</p></body></article>"),
        ("pubmed", "b.xml", "<article><body></body></article>"),
        ("pubmed", "c.txt", "<p>no</p>"),
        ("springer", "s.html", "<body><p class='Para'>R is <span class='InlineEquation'>x.</span> so</p><p>no</p></body>"),
        ("arxiv", "t.xml", "<body><p>As <ref n='1'>[1]</ref> said <formula>a=b,</formula> yes</p><formula>E=mc.</formula></body>"),
        ("arxiv", "e.xml", "  "),
    ]:
        (tmp_path / source).mkdir(exist_ok=True)
        (tmp_path / source / name).write_text(text)
    files = readers.sources(spark, str(tmp_path))
    assert files.count() == 5 and files.where("raw is null").count() == 1
    got = [(r["source"], r["pos"], r["text"]) for r in readers.paragraphs(files).orderBy("source", "file", "pos").collect()]
    assert got == [("arxiv", 0, "As said <FORMULA>, yes"), ("arxiv", 1, "<LONG_FORMULA>."), ("pubmed", 0, "One two."), ("pubmed", 1, "Three < four"), ("springer", 0, "R is <FORMULA>. so")]
    found = readers.pubmed(files.where("source = 'pubmed'"))
    assert [tuple(r)[1:] for r in found.orderBy("file").collect()] == [("10.1/x", None, "On R & S", "J", 2001, "One two. Three < four"), (None, None, None, None, None, "")]
    assert [r["key"] for r in readers.aggregated_pubmed(found).collect()] == ["10.1/x"]
    meta = spark.createDataFrame([("arxiv", "1.pdf", None), ("springer", "s.html", "10.2/y")], "source string, fn string, doi string")
    joined = readers.with_metadata(meta, spark.createDataFrame([("/x/s.html", "text")], "file string, text string"))
    assert rows(joined) == [("1", "arxiv", "1.pdf", None), ("10.2/y", "springer", "s.html", "text")]
    assert rows(readers.usable(joined.withColumnRenamed("key", "id"), ["1"]).select("id")) == [("10.2/y",)]


def test_small_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("id\ttext\tlabel\n1\tWhy \"so?\t1\n")
    (tmp_path / "t.txt").write_text("a b  c\n\n")
    (tmp_path / "q.csv").write_text("Query,x\nwhy,1\n,2\n")
    assert rows(readers.labelled_questions(spark, str(tmp_path / "q.tsv"))) == [(1, 'Why "so?', 1)]
    assert rows(readers.token_lines(spark, str(tmp_path / "t.txt"))) == [(["a", "b", "c"],), ([],)]
    assert rows(readers.query_column(spark, str(tmp_path / "q.csv"))) == [("why",)]
    names = spark.createDataFrame([("net_12Mar2020-10:11:12.txt",), ("net_01Apr2020-00:00:00.txt",), ("none",)], "name string")
    assert readers.newest_by_name(names).first()["name"] == "net_01Apr2020-00:00:00.txt"
    sinks.edge_list(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()["value"] == "1\t2"
    sinks.vector_text(spark.createDataFrame([("w", [1.0, 2.5])], "token string, vec array<double>"), str(tmp_path / "v"))
    assert rows(readers.word_vectors(spark, str(tmp_path / "v"))) == [("w", [1.0, 2.5])]
    sinks.lines(spark.createDataFrame([("term",), (None,)], "t string"), "t", str(tmp_path / "l"))
    assert rows(spark.read.text(str(tmp_path / "l"))) == [("term",)]


def test_reached_of_chains_and_rings(spark):
    import random

    rng = random.Random(5)
    data = [(1, 0, "x", i - 1, i) for i in range(1, 3000)]  # one deep chain
    for doc in range(2, 60):
        n = rng.randint(1, 12)
        data += [(doc, 0, "x", rng.choice([None, 0, 0, 99, *range(1, n + 1)]), rng.randint(1, n)) for _ in range(n)]
    least = {}
    for doc, _, _, gov, dep in data:
        old = least.setdefault((doc, dep), gov)
        least[doc, dep] = gov if old is None else old if gov is None else min(old, gov)

    def want(doc, dep):
        at = least[doc, dep]
        if at is None:
            return None
        for _ in range(3000):
            if least.get((doc, at)) is None:
                return at != 0
            at = least[doc, at]
        return True

    out = P.reached(spark.createDataFrame(data, "doc long, sent int, rel string, gov int, dep int"))
    assert {(r["doc"], r["idx"]): r["ignored"] for r in out.collect()} == {k: want(*k) for k in least}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0  # a sentence is shuffled once and not joined
