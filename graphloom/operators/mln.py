"""Markov-logic induction: clusters, count tables, candidates, merge scores and rounds of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut
from graphloom.functions.columns import delta


MAX_CLUSTERS = 2000  # so many relations have two million pairs


def parts(triples: DataFrame) -> DataFrame:
    """(clust, argtype, child): each use of an entity by a relation: relations are the first clusters, `head` and `tail` their arguments."""
    f = triples.where("head is not null and tail is not null and relation is not null and head <> -1 and tail <> -1 and relation <> -1")
    return f.select(F.col("relation").alias("clust"), F.explode(F.array(F.struct(F.lit("head").alias("argtype"), F.col("head").alias("child")), F.struct(F.lit("tail").alias("argtype"), F.col("tail").alias("child")))).alias("p")).select("clust", "p.*")


def counts(uses: DataFrame) -> DataFrame:
    """(clust, argtype, child, n): the count table, recomputed instead of kept up to date."""
    return uses.groupBy("clust", "argtype", "child").agg(F.count("*").alias("n"))


def merge_candidates(table: DataFrame, least: int = 10) -> DataFrame:
    """(c1, c2, shared): pairs of clusters with at least `least` distinct shared arguments.

    Clusters are relation types, a small fixed set; the table holds each (cluster, argument) once, so an argument meets at
    most as many pairs as there are pairs of clusters.
    """
    args = table.select("clust", "argtype", "child").distinct()
    other = args.withColumnRenamed("clust", "c2")
    pairs = args.join(other, ["argtype", "child"]).where("clust < c2")
    return pairs.groupBy(F.col("clust").alias("c1"), "c2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def merge_scores(table: DataFrame, least: int = 10, bonus: float = 5.0) -> DataFrame:
    """(c1, c2, shared, score) of the pairs with at least `least` shared arguments: -delta of the totals plus delta + bonus for each shared argument.

    One join of the count table with itself gives both the number of shared arguments and their gain.
    """
    totals = table.groupBy("clust").agg(F.sum("n").alias("n"))  # one row a cluster
    t1, t2 = totals.select(F.col("clust").alias("c1"), F.col("n").alias("n1")), totals.select(F.col("clust").alias("c2"), F.col("n").alias("n2"))
    a, b = table.select(F.col("clust").alias("c1"), "argtype", "child", F.col("n").alias("x")), table.select(F.col("clust").alias("c2"), "argtype", "child", F.col("n").alias("y"))
    both = a.join(b, ["argtype", "child"]).where("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("shared"), F.sum(delta(F.col("x"), F.col("y")) + bonus).alias("gain"))
    return both.where(F.col("shared") >= least).join(t1, "c1").join(t2, "c2").select("c1", "c2", "shared", (F.col("gain") - delta(F.col("n1"), F.col("n2"))).alias("score"))


def induce(triples: DataFrame, rounds: int = 1000, least: int = 10, active: float = 10.0) -> DataFrame:
    """(clust, merged): clusters after rounds of merges, until no pair reaches the active score.

    A round executes, from the best score down, all pairs of which neither cluster was in a better one; ties by the ids. Counts
    are then recomputed for the merged clusters and the agenda is scored anew. Clusters are relations, so the agenda is bounded by their number squared and comes to
    the driver; more than MAX_CLUSTERS are refused. Compose operations are not executed.
    """
    spark = triples.sparkSession
    uses = cut(counts(parts(triples)))
    label = {r["clust"]: r["clust"] for r in uses.select("clust").distinct().limit(MAX_CLUSTERS + 1).collect()}
    if len(label) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    for _ in range(rounds):
        labels = spark.createDataFrame(sorted(label.items()), "clust bigint, merged bigint")
        table = uses.join(F.broadcast(labels), "clust").groupBy(F.col("merged").alias("clust"), "argtype", "child").agg(F.sum("n").alias("n"))
        agenda = merge_scores(cut(table), least).where(F.col("score") >= active).select("c1", "c2", "score").collect()
        if not agenda:
            return labels
        moved: dict[int, int] = {}
        for pair in sorted(agenda, key=lambda r: (-round(r["score"], 6), r["c1"], r["c2"])):
            if pair["c1"] not in moved and pair["c2"] not in moved:
                moved[pair["c1"]] = moved[pair["c2"]] = pair["c1"]
        label = {c: moved.get(m, m) for c, m in label.items()}
    raise RuntimeError("pairs of clusters still reach the active score")


def conjunctions(deps: DataFrame) -> DataFrame:
    """(a, b, n): how often two clusters stand in a `conj_` dependency."""
    c = deps.where(F.col("rel").startswith("conj_"))
    return c.groupBy(F.least("gov", "dep").alias("a"), F.greatest("gov", "dep").alias("b")).agg(F.count("*").alias("n"))


def compose_candidates(table: DataFrame, least: int = 1225) -> DataFrame:
    """(clust, child, n): pairs whose closed-form number of sightings n (n - 1) / 2 reaches the least."""
    return table.groupBy("clust", "child").agg(F.sum("n").alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 >= least)


def printed(table: DataFrame, top: int = 5) -> DataFrame:
    """(clust, line): the most frequent arguments of each cluster."""
    order = W.Window.partitionBy("clust").orderBy(F.desc("n"), "argtype", "child")
    first = table.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    text = F.concat_ws(":", "argtype", "child", "n")
    return first.groupBy("clust").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda x: x["t"]), " | ").alias("line"))
