import math
import random

from graphloom.common import attach_groups
from graphloom.functions import columns as C
from graphloom.operators import components, graph, kg, mln, references
from graphloom.sources import readers, sinks
from pyspark.sql import functions as F

TRIPLE = "triple_id long, head long, tail long, relation long, loaded_at timestamp_ntz, note string"
ENTRY = "id long, added_at timestamp_ntz, deleted_at timestamp_ntz, note string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stamp(spark, data, schema):
    text = ", ".join(f"{c.split()[0]} {'string' if 'timestamp' in c else c.split()[1]}" for c in schema.split(", "))
    df = spark.createDataFrame(data, text)
    return df.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])


def test_orphans_by_kind(spark):
    e = stamp(spark, [(1, None, None, "x"), (2, None, "2020-01-15 00:00:00", "x"), (3, "2020-03-01 00:00:00", None, "x"), (None, None, None, "x")], ENTRY)
    r = stamp(spark, [(9, None, None, "y")], ENTRY)
    t = stamp(
        spark,
        [
            (1, 1, 2, 9, "2020-02-01 00:00:00", "n"),
            (1, 1, 2, 9, "2020-02-01 00:00:00", "n"),
            (2, 3, 7, 8, "2020-02-02 00:00:00", "n"),
            (3, -1, None, 9, "2020-02-02 00:00:00", "n"),
            (4, 2, 3, 9, "2020-01-14 00:00:00", "n"),
            (5, 7, 2, None, None, "n"),
        ],
        TRIPLE,
    )
    got = sorted(map(str, rows(references.triple_orphans(t, e, r))))
    want = [(1, "tail", "deleted", "2020-02"), (2, "head", "late", "2020-02"), (2, "tail", "missing", "2020-02"), (2, "relation", "missing", "2020-02"), (4, "tail", "late", "2020-01"), (5, "head", "missing", None)]
    assert got == sorted(map(str, want))
    assert references.triple_orphans(t.limit(0), e, r).count() == 0
    assert references.triple_orphans(t, e.limit(0), r.limit(0)).where("kind <> 'missing'").count() == 0


def test_orphans_split_ranges_and_hot_keys(spark):
    parents = spark.range(0, 1000, 2).select(F.lit("t").alias("target"), "id", F.lit(None).cast("timestamp").alias("added_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
    refs = spark.range(3000).select(F.col("id").alias("triple_id"), F.lit("head").alias("field"), F.lit("t").alias("target"), F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 1000).alias("id"), F.lit("2020-01-01").cast("timestamp").alias("loaded_at"))
    found = references.orphans(refs, parents, keys_per_range=50)
    assert found.count() == refs.where("id % 2 = 1").count()


def test_orphans_of_more_keys_than_ranges(spark, monkeypatch):
    monkeypatch.setattr(references, "MAX_RANGES", 4)
    when = F.lit(None).cast("timestamp")
    parents = spark.range(1000).select(F.lit("t").alias("target"), (F.col("id") * F.col("id") * 2).alias("id"), when.alias("added_at"), when.alias("deleted_at"))
    refs = spark.range(2000).select(F.col("id").alias("triple_id"), F.lit("head").alias("field"), F.lit("t").alias("target"), (F.floor(F.col("id") / 2) * F.floor(F.col("id") / 2) * 2 + F.col("id") % 2).alias("id"), F.lit("2020-01-01").cast("timestamp").alias("loaded_at"))
    assert references.orphans(refs, parents, keys_per_range=20).where("triple_id % 2 = 1").count() == 1000 == references.orphans(refs, parents, keys_per_range=20).count()


def test_attach_groups_keeps_all_rows(spark):
    data = spark.range(5000).select("id", F.when(F.col("id") < 3000, F.lit(1)).otherwise(F.col("id")).alias("k"))
    groups = data.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_groups(data, groups, ["k"], "n", 5000)
    assert got.count() == 5000 and got.where("n = if(id < 3000, 3000, 1)").count() >= 4999 and got.columns == ["id", "k", "n"]
    assert attach_groups(data.limit(0), groups, ["k"], "n", 0).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (200, 200), (None, 3)], "src long, dst long")
    got = dict(rows(components.connected_components(edges)))
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and got[200] == 200
    assert components.connected_components(edges.limit(0)).count() == 0


def test_centralities_of_small_graphs(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    d = dict(rows(graph.degree_centrality(star)))
    assert d[0] == 1.0 and d[1] == 0.25
    e = dict(rows(graph.eigenvector_centrality(star)))
    assert math.isclose(e[0], math.sqrt(0.5), abs_tol=1e-3) and math.isclose(e[1], math.sqrt(0.125), abs_tol=1e-3)
    assert graph.eigenvector_centrality(star.limit(0)).count() == 0


def test_power_iteration_of_many_rounds_takes_few_jobs(spark):
    """A chain with a loop and a far part settles late; both ways give the same."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)] + [(3, 3), (50, 51), (50, 52)], "src long, dst long")
    spark.sparkContext.setJobGroup("power", "")
    e = dict(rows(graph.eigenvector_centrality(edges, tol=2e-3)))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("power"))
    spark.sparkContext.setJobGroup("other", "")
    joined = dict(rows(graph.eigenvector_centrality(edges, tol=2e-3, in_one=0)))
    assert jobs < 20 and e.keys() == joined.keys() and all(math.isclose(e[k], joined[k], rel_tol=1e-9) for k in e)


def test_masking_experiment_finds_the_hidden_without_joins(spark):
    r = random.Random(5)
    data = sorted({tuple(sorted((int(r.random() ** 2 * 300), r.randrange(300)))) for _ in range(900)})
    edges = spark.createDataFrame(data, "src long, dst long")
    spark.sparkContext.setJobGroup("masking", "masking")
    got = {tuple(x)[:2]: x["ndcg"] for x in graph.masking_experiment(edges, runs=2).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("masking"))
    spark.sparkContext.setJobGroup("rest", "rest")
    nodes = sorted({x for e in data for x in e})
    pairs = lambda df: {(x["src"], x["dst"]) for x in df.collect()}
    value = lambda df: df.select("node", F.col("centrality").alias("value"))
    for run in range(2):
        hidden = {x["node"] for x in graph.masked_nodes(edges, 0.25, 1 + run).collect()}
        seen = graph.without_nodes(edges, spark.createDataFrame([(x,) for x in hidden], "node long"))
        made = pairs(graph.kronecker_edges(spark, graph.kron_initiator(seen), (len(nodes) - 1).bit_length(), len(data), 1 + run))
        named = {(nodes[a], nodes[b]) for a, b in made if max(a, b) < len(nodes)}
        whole = spark.createDataFrame(sorted(pairs(seen) | {(a, b) for a, b in named if a in hidden or b in hidden}), "src long, dst long")
        for measure, f in (("degree", graph.degree_centrality), ("eigenvector", graph.eigenvector_centrality)):
            expected = graph.ndcg(value(f(edges)), value(f(whole)), 100).first()["ndcg"]
            assert math.isclose(got[run, measure], expected, rel_tol=1e-9)
    assert jobs < 145  # 160 when each run ranked the whole graph and joined what it hides


def test_compare_and_ndcg(spark):
    old = spark.createDataFrame([(1, 0.5), (2, 0.2)], "node long, centrality double")
    new = spark.createDataFrame([(1, 1.0), (3, 0.1)], "node long, centrality double")
    got = {r["node"]: r["change"] for r in graph.compare(old, new).collect()}
    assert math.isclose(got[1], 0.5 / 1.5) and got[2] is None and got[3] is None
    v = spark.createDataFrame([(i, float(i)) for i in range(10)], "node long, value double")
    assert math.isclose(graph.ndcg(v, v, 5).first()[0], 1.0)
    # two nodes change places: gains 2^v - 1 of their predicted ranks, in the actual order
    w = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 2.0)], "node long, value double")
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "node long, value double")
    half = (2**0.5 - 1) + 1 / math.log2(3)
    assert math.isclose(graph.ndcg(x, w).first()[0], half / (1 + (2**0.5 - 1) / math.log2(3)))


def test_kronecker_is_the_same_each_time(spark):
    a, b = (rows(graph.kronecker_edges(spark, (0.9, 0.5, 0.5, 0.2), 4, 50)) for _ in range(2))
    assert a == b and all(0 <= x <= y < 16 for x, y in a)


def test_math_columns(spark):
    r = spark.range(1).select(C.xlogx(F.lit(0.0)), C.xlogx(F.lit(2.0)), C.halvings(F.lit(5)), C.halvings(F.lit(1)), C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), C.relation_class(F.lit("<="))).first()
    assert r[0] == 0 and math.isclose(r[1], 2 * math.log(2)) and r[2] == 3 and r[3] == 0 and r[4] == 0 and r[5] == "compare"
    q = spark.createDataFrame([("  why? so ",), ("",)], "t string").select(C.question(F.col("t"))).collect()
    assert q[0][0] == "Why so?" and q[1][0] is None


def test_dense_ids_and_package(spark):
    names = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "n string")
    ids = kg.dense_ids(names, "n")
    assert rows(ids) == [("a", 0), ("b", 1), ("c", 2)]
    raw = spark.createDataFrame([("a", "c", "b"), ("a", "x", "b")], "subj string, rel string, obj string")
    assert rows(kg.package(raw, ids, ids)) == [(0, 1, 2)]


def test_induced_clusters_merge(spark):
    t = spark.createDataFrame([(i, i, i + 100, r) for i in range(30) for r in (1, 2)] + [(99, 500, 501, 3)], "triple_id long, head long, tail long, relation long")
    got = dict(rows(mln.induce(t)))
    assert got == {1: 1, 2: 1, 3: 3}


def test_induction_ends_when_no_pair_is_active(spark):
    """Equal relations all prefer the first, so one merges in a round."""
    t = spark.createDataFrame([(i, i, i + 100, r) for i in range(12) for r in range(1, 9)], "triple_id long, head long, tail long, relation long")
    assert dict(rows(mln.induce(t))) == dict.fromkeys(range(1, 9), 1)


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x y", 1), ("z", 2)], "ent string, id long")
    sinks.index_table(df, str(tmp_path / "e"))
    assert rows(readers.index_table(spark, str(tmp_path / "e"), "entity2id")) == rows(df)


def test_tei_reader(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><titleStmt><title>T</title></titleStmt><author><surname>A</surname></author><body><p>one</p><p>two</p></body></TEI>')
    r = readers.tei(spark, str(tmp_path)).first()
    assert (r["title"], r["authors"], r["abstract"], r["text"]) == ("T", ["A"], "**NONE**", "one two")


def test_streams(spark, tmp_path):
    from graphloom.streaming import arrivals

    spark.createDataFrame([("2020-01-01 00:10:00", "a"), ("2020-01-01 00:20:00", "a"), ("2020-01-01 02:00:00", "b")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    q = arrivals.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.sql("select n from w").collect()) == [1, 2]
