"""Graphs: edges, centrality, change, ranking quality, masks and generated edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut, lookup, numbered


def undirected(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Simple undirected edges (src <= dst)."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, centrality) = degree / (nodes - 1); 1 for a single node."""
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).select("node", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("degree") / (F.col("n") - 1)).alias("centrality"))


IN_ONE = 20_000_000  # edges that one task holds as numbers, in some 600 MB


def _power(kind: str, tol: float, rounds: int, retries: int):
    """The power iteration of `eigenvector_centrality` over all edges in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)) for batch in batches if batch.num_rows]
        if not pieces:
            return
        src, dst = (np.concatenate(side) for side in zip(*pieces))
        del pieces
        chunks = [slice(i, i + (1 << 21)) for i in range(0, len(src), 1 << 21)]
        nodes = src[:0]
        for c in chunks:
            nodes = np.union1d(nodes, np.concatenate([src[c], dst[c]]))
        n, done, limit = len(nodes), 0, tol
        # both directions in the order of their targets, so that a round gathers and sums runs; a loop counts once
        links = np.empty(2 * len(src) - int((src == dst).sum()), np.int64)
        at = 0
        for c in chunks:
            a, b = np.searchsorted(nodes, src[c]), np.searchsorted(nodes, dst[c])
            for to, of in ((b, a), (a[a != b], b[a != b])):
                links[at : at + len(to)] = to * n + of
                at += len(to)
        del src, dst
        links.sort()
        heads = np.searchsorted(links, np.arange(n + 1, dtype=np.int64) * n)
        for c in (slice(i, i + (1 << 21)) for i in range(0, len(links), 1 << 21)):
            links[c] %= n
        links = links.astype(np.int32)
        steps = np.unique(np.r_[np.searchsorted(heads, np.arange(0, len(links), 1 << 20)), n])  # targets of about so many links each
        x = np.full(n, 1.0 / n)
        while True:
            y = x.copy()
            for i, j in zip(steps[:-1], steps[1:]):
                y[i:j] += np.add.reduceat(x[links[heads[i] : heads[j]]], heads[i:j] - heads[i])  # every node has a link
            y /= np.sqrt((y * y).sum()) or 1.0
            moved, x = np.abs(y - x).sum(), y
            done += 1
            if moved < n * limit:
                break
            if done % rounds == 0:
                if done // rounds > retries:
                    raise RuntimeError("the power iteration did not settle")
                limit *= 10
        for i in range(0, n, 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 20)]), pa.array(x[i : i + (1 << 20)])], ["node", "centrality"])

    return run, f"node {kind}, centrality double"


def eigenvector_centrality(edges: DataFrame, tol: float = 1e-6, rounds: int = 100, retries: int = 3, in_one: int = IN_ONE) -> DataFrame:
    """(node, centrality) by power iteration x + Ax with unit length, until the summed change is below nodes x tol.

    Where it does not settle within the rounds, the tolerance is taken ten times as large. Up to `in_one` edges between whole numbers
    go to one task that iterates over them. More are joined: the adjacency is cut once, and a round is one join and one aggregation.
    """
    return _eigenvector(cut(edges.select("src", "dst")), tol, rounds, retries, in_one)


def _eigenvector(edges: DataFrame, tol: float = 1e-6, rounds: int = 100, retries: int = 3, in_one: int = IN_ONE) -> DataFrame:
    """`eigenvector_centrality` of edges (src, dst) whose lineage is cut already."""
    kinds = {kind for _, kind in edges.dtypes}
    if len(kinds) == 1 and kinds <= {"int", "bigint"} and edges.count() <= in_one:
        return cut(edges.repartition(1).mapInArrow(*_power(*kinds, tol, rounds, retries)))
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    adjacency = cut(edges.select("src", "dst").unionByName(back))
    x = cut(adjacency.select(F.col("src").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    n = x.count()
    if not n:
        return x.select("node", F.col("x").alias("centrality"))
    x = x.withColumn("x", F.lit(1.0 / n))
    done = 0
    while True:
        spread = adjacency.join(x, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("x").alias("s"))
        new = cut(x.join(spread, F.col("node") == F.col("dst"), "left").select("node", F.col("x").alias("old"), (F.col("x") + F.coalesce("s", F.lit(0.0))).alias("y")))
        length = new.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("l")).first()["l"] or 1.0
        moved = new.agg(F.sum(F.abs(F.col("y") / length - F.col("old"))).alias("m")).first()["m"]
        x = new.select("node", (F.col("y") / length).alias("x"))
        done += 1
        if moved < n * tol:
            return x.select("node", F.col("x").alias("centrality"))
        if done % rounds == 0:
            if done // rounds > retries:
                raise RuntimeError("the power iteration did not settle")
            tol *= 10


def sizes(edges: DataFrame) -> DataFrame:
    """(nodes, edges) of simple undirected edges."""
    nodes = degrees(edges).agg(F.count("*").alias("nodes"))
    return nodes.join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


def most_central(centrality: DataFrame, n: int) -> DataFrame:
    """The n nodes of the greatest centrality, ties by node."""
    return centrality.orderBy(F.desc("centrality"), "node").limit(n)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, old, new, change) of two centralities; change is null where a side is missing."""
    both = old.select("node", F.col("centrality").alias("old")).join(new.select("node", F.col("centrality").alias("new")), "node", "full_outer")
    return both.withColumn("change", (F.col("new") - F.col("old")) / (F.col("old") + 1))


def gains(changes: DataFrame, n: int) -> DataFrame:
    return changes.where("change is not null").orderBy(F.desc("change"), "node").limit(n)


def losses(changes: DataFrame, n: int) -> DataFrame:
    return changes.where("change is not null").orderBy("change", "node").limit(n)


def scored_triples(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """(head, tail, relation, score): the summed change of head and tail of each fact; a node without one adds 0."""
    c = changes.where("change is not null").select("node", "change")
    both = lookup(facts, c.select(F.col("node").alias("head"), F.col("change").alias("ch")), "head")
    both = lookup(both, c.select(F.col("node").alias("tail"), F.col("change").alias("ct")), "tail")
    return both.select("head", "tail", "relation", (F.coalesce("ch", F.lit(0.0)) + F.coalesce("ct", F.lit(0.0))).alias("score"))


def key_triples(facts: DataFrame, changes: DataFrame, n: int, digits: int = 5) -> DataFrame:
    """The n facts with the largest score, rounded before they are ordered so that no last digit decides."""
    scored = scored_triples(facts, changes).withColumn("score", F.round("score", digits))
    return scored.orderBy(F.desc("score"), "head", "tail", "relation").limit(n)


def ranks(values: DataFrame, name: str) -> DataFrame:
    """(node, name): the rank of (node, value) from 0 to 1, ties by node; 0 for a single node."""
    n = values.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    return numbered(values.select("value", "node"), ["value", "node"]).join(F.broadcast(n)).select("node", (F.col("row") / F.col("n")).alias(name))


def ndcg(actual: DataFrame, predicted: DataFrame, k: int = 100) -> DataFrame:
    """(ndcg) of two tables (node, value): the gain 2^v - 1 of the predicted ranks of the k nodes with the greatest actual ranks, over that of their actual ranks.

    Values are replaced by their ranks from 0 to 1 on each side; a node that one side lacks has 0 there. The k best are found by
    sort and limit. Empty tables give 0.
    """
    return _ranked_ndcg(ranks(actual, "v"), ranks(predicted, "p"), k)


def _ranked_ndcg(actual: DataFrame, predicted: DataFrame, k: int) -> DataFrame:
    """`ndcg` of ranks (node, v) and (node, p)."""
    both = actual.join(predicted, "node", "full_outer").fillna(0.0, ["v", "p"])
    top = both.orderBy(F.desc("v"), F.desc("node")).limit(k)
    placed = top.withColumn("rn", F.row_number().over(W.Window.orderBy(F.desc("v"), F.desc("node"))))  # k rows
    gain = lambda c: F.sum((F.pow(F.lit(2.0), c) - 1) / F.log2(F.col("rn") + 1))
    sums = placed.agg(gain("v").alias("ideal"), gain("p").alias("reached"))
    return sums.select(F.when(F.col("ideal") > 0, F.col("reached") / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    k = nodes.select("node").distinct()
    return edges.join(k, F.col("src") == F.col("node"), "left_anti").join(k, F.col("dst") == F.col("node"), "left_anti")


def _masked(node: str, part: float, seed: int) -> Column:
    mark = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), node).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return mark % 1_000_000 < int(part * 1_000_000)


def masked_nodes(edges: DataFrame, part: float, seed: int = 1) -> DataFrame:
    """A part of the nodes, chosen by a seeded hash: the same on every run and cluster."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.where(_masked("node", part, seed))


def kronecker_edges(spark: SparkSession, weights: tuple[float, float, float, float], levels: int, n: int, seed: int = 1) -> DataFrame:
    """Edges drawn from a stochastic Kronecker graph: each level picks a quarter of the matrix by the 2 x 2 initiator."""
    total = sum(weights)
    a, b, c, _ = (w / total for w in weights)
    rows = spark.range(n)
    src = dst = F.lit(0).cast("bigint")
    for level in range(levels):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id"), F.lit(2**31)) / float(2**31)
        src = src * 2 + F.when(u < a + b, 0).otherwise(1)
        dst = dst * 2 + F.when(u < a, 0).when(u < a + b, 1).when(u < a + b + c, 0).otherwise(1)
    return rows.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def kron_initiator(edges: DataFrame, levels: int | None = None) -> tuple[float, float, float, float]:
    """A 2 x 2 initiator by moments: expected edges, wedges and degrees of the generated graph meet those seen.

    Two sums of the graph come to the driver; the fit is a search over the symmetric initiator (a, b, b, c).
    """
    d = degrees(edges)
    n, m, wedges = d.agg(F.count("*"), F.sum("degree") / 2, F.sum(F.col("degree") * (F.col("degree") - 1) / 2)).first()
    if not n:
        return (0.0, 0.0, 0.0, 0.0)
    k = levels or max(1, (int(n) - 1).bit_length())
    best = None
    for i in range(1, 100):
        for j in range(0, 100, 2):
            b, c = j / 100, i / 100
            root = (2 * float(m)) ** (1 / k)
            a = root - 2 * b - c
            if not 0 < a <= 1 or a < c:
                continue
            h = ((a + b) ** 2 + (b + c) ** 2) ** k / 2 - float(m)
            loss = abs(h - float(wedges)) / max(1.0, float(wedges))
            if best is None or loss < best[0]:
                best = loss, (a, b, b, c)
    return best[1] if best else (0.9, 0.5, 0.5, 0.2)


def completed(observed: DataFrame, generated: DataFrame) -> DataFrame:
    return observed.select("src", "dst").unionByName(generated.select("src", "dst")).distinct()


def masking_experiment(edges: DataFrame, runs: int = 5, part: float = 0.25, k: int = 100, seed: int = 1) -> DataFrame:
    """(run, measure, ndcg): in each run a part of the nodes is hidden, the rest is completed by edges of a fitted Kronecker graph, and the centralities of the completed graph are held against those of the whole.

    Generated nodes are numbered anew, so the completed graph takes the hidden nodes' places in the order of their ids. Whether a node is hidden follows
    from its id, so edges and numbers tell it without a join; the whole graph is ranked once for all runs.
    """
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst"))
    rated = lambda c, name: cut(ranks(c.select("node", F.col("centrality").alias("value")), name))
    degree = cut(degree_centrality(edges))
    order = cut(numbered(degree.select("node"), ["node"], "row"))
    truth = {"degree": rated(degree, "v"), "eigenvector": rated(_eigenvector(edges), "v")}
    n, m = order.count(), edges.count()
    out = None
    for run in range(runs):
        hidden = lambda c: _masked(c, part, seed + run)  # noqa: B023, E731
        seen = cut(edges.where(~hidden("src") & ~hidden("dst")))
        made = kronecker_edges(spark, kron_initiator(seen), max(1, (n - 1).bit_length()), m, seed + run)
        place = order.withColumn("h", hidden("node"))
        named = made.join(place.select(F.col("row").alias("src"), F.col("node").alias("a"), F.col("h").alias("ha")), "src").join(place.select(F.col("row").alias("dst"), F.col("node").alias("b"), F.col("h").alias("hb")), "dst")
        fresh = named.where("ha or hb").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        whole = cut(completed(seen, fresh))
        for measure, found in (("degree", cut(degree_centrality(whole))), ("eigenvector", _eigenvector(whole))):
            row = _ranked_ndcg(truth[measure], rated(found, "p"), k).select(F.lit(run).alias("run"), F.lit(measure).alias("measure"), "ndcg")
            out = row if out is None else out.unionByName(row)
    return out
