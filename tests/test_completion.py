import numpy as np
import pytest
from graphloom.operators import clustering, completion
from pyspark.sql import functions as F

SCORES = "head long, relation long, tail long, score double"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame([(1, 9, 1, 0.99), (1, 9, 2, 0.8), (1, 9, 3, 0.05), (2, 9, 1, 0.7), (1, 8, 2, 0.6), (3, 8, 1, 0.4)], SCORES)


def test_dispatch_by_what_is_unknown(spark, scores):
    q = spark.createDataFrame([(1, 1, 9, -1), (2, -1, 9, 1), (3, 1, -1, 2), (4, 1, 9, 2), (5, -1, -1, 2), (6, 7, 9, -1), (7, None, 9, 1)], "query long, head long, relation long, tail long")
    got = rows(completion.dispatch(q, scores, n=2))
    assert got == sorted([(1, 1, 9, 1, 0.99), (1, 1, 9, 2, 0.8), (2, 1, 9, 1, 0.99), (2, 2, 9, 1, 0.7), (3, 1, 9, 2, 0.8), (3, 1, 8, 2, 0.6), (4, 1, 9, 2, 0.8), (5, -1, -1, 2, None)], key=str)
    assert rows(completion.dispatch(spark.createDataFrame([(1, 1, 9, 3)], q.schema), scores)) == [(1, 1, 9, 3, 0.0)]
    assert completion.dispatch(q.limit(0), scores).count() == 0


def test_expansion_and_search(spark, scores):
    t = spark.createDataFrame([(1, 1, 2, 9), (2, 3, 1, 8)], "triple_id long, head long, tail long, relation long")
    e = spark.createDataFrame([(1, "Marsh virus"), (2, "fever"), (3, None)], "id long, ent string")
    r = spark.createDataFrame([(8, "causes"), (9, "spreads")], "id long, rel string")
    assert rows(completion.expansion("VIRUS", t, e, scores)) == sorted([(1, 9, 2, 0.8), (2, 9, 1, 0.7), (1, 8, 2, 0.6), (3, 8, 1, 0.4)], key=str)
    assert rows(completion.term_search("virus", e, r, scores)) == [(1, 8, 2, 0.6), (1, 9, 2, 0.8)]
    q = spark.createDataFrame([(1, "the marsh virus", "spreads", None), (2, "marsh virus", "spreads", "zzz")], "query long, subject string, relation string, object string")
    got = completion.answers(q, e, r, scores, n=1)
    assert rows(got) == [(1, "Marsh virus", "spreads", "Marsh virus", 0.99), (2, "Marsh virus", "spreads", "Marsh virus", 0.99)]


def test_scores_of_facts(spark, scores):
    assert rows(completion.best_and_mean(scores, ["relation"])) == [(8, 0.4, 0.5), (9, 0.05, pytest.approx(1.55 / 3))]
    assert rows(completion.network(scores, 0.65)) == [(1, 1, 0.99), (1, 2, 0.8), (2, 1, 0.7)]
    s = spark.createDataFrame([(1, 0.1, 0), (1, 0.4, 1), (1, 0.35, 0), (1, 0.9, 1), (2, 0.5, 1)], "relation long, score double, label int")
    assert rows(completion.learned_thresholds(s)) == [(1, 0.4), (2, 0.5)]


def brute_linkage(m, distance):
    groups = [[i] for i in range(len(m))]
    while len(groups) > 1:
        best = min((np.mean([1 - m[i] @ m[j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    return sorted(sorted(g) for g in groups)


def test_clusters_like_average_linkage_over_all(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 16))
    m = np.concatenate([c + r.normal(size=(6, 16)) * s for c, s in zip(centres, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    data = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, [0.0] * 16), (101, None), (None, m[0].tolist())]
    got = clustering.clusters(spark.createDataFrame(data, "id long, vec array<double>"), 0.2)
    groups = got.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("g")).collect()
    assert sorted(list(x["g"]) for x in groups) == sorted([*brute_linkage(m, 0.2), [100]])
    assert clustering.clusters(got.select("id", F.lit(None).cast("array<double>").alias("vec"))).count() == 0
