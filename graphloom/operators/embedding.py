"""Embedding tables: averages, matching, standardisation and link scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import cosine, norm
from graphloom.operators.linking import seeded

MAX_QUERIES = 100_000
MAX_SUMS = 32  # tasks that each send one sum of products


def mean_vectors(members: DataFrame, vectors: DataFrame, zeros: bool = False) -> DataFrame:
    """(phrase, vec): mean of the vectors of a phrase's tokens.

    With zeros, a token without a vector counts as a zero vector; without, it is left out, and a phrase without any is
    dropped. Sums are aggregated by position, map side first.
    """
    joined = members.join(vectors.select("token", "vec"), "token", "left" if zeros else "inner")
    n = members.groupBy("phrase").agg(F.count("*").alias("n")) if zeros else joined.groupBy("phrase").agg(F.count("*").alias("n"))
    sums = joined.where("vec is not null").select("phrase", F.posexplode("vec").alias("i", "v")).groupBy("phrase", "i").agg(F.sum("v").alias("s"))
    means = sums.join(n, "phrase").groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("vec"))
    return means


def label_centroids(vectors: DataFrame) -> DataFrame:
    """(label, i, mean): the mean of each dimension by label."""
    return vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def standardised(vectors: DataFrame) -> DataFrame:
    """(vec_id, i, z): population z-score of each dimension; 0 where a dimension does not vary."""
    rows = vectors.select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    stats = rows.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))  # one row a dimension
    return rows.join(F.broadcast(stats), "i").select("vec_id", "i", F.when(F.col("s") == 0, F.lit(0.0)).otherwise((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


def best_match(queries: DataFrame, vectors: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """(vec_id, match, similarity): for each stated query the most similar other vector by cosine, the least id among equals, -1 below the threshold.

    The queries are a stated set of MAX_QUERIES at most; they go to every task, where each batch of vectors meets them in
    blocks of matrix products and leaves one best for each query. These are aggregated.
    """
    rows = queries.select("vec_id", "embedding").limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError(f"state at most {MAX_QUERIES} queries at once")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    shared = queries.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), unit(np.array([r["embedding"] for r in rows], float)) if rows else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, goals = shared.value
        for pdf in batches:
            if not len(ids) or pdf.empty:
                continue
            pdf = pdf.sort_values("vec_id")  # argmax takes the first among equals
            base, m = pdf["vec_id"].to_numpy(), unit(np.stack(pdf["embedding"].to_numpy()).astype(float))
            for a in range(0, len(ids), block):
                sims = goals[a : a + block] @ m.T
                sims[np.equal.outer(ids[a : a + block], base)] = -np.inf
                at = sims.argmax(axis=1)
                yield pd.DataFrame({"vec_id": ids[a : a + block], "match": base[at], "similarity": sims[np.arange(len(at)), at]})

    found = vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id bigint, match bigint, similarity double").where("similarity > -2")
    best = found.groupBy("vec_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("match").alias("m"))).alias("b"))
    return best.select("vec_id", F.when(-F.col("b.s") >= threshold, F.col("b.m")).otherwise(F.lit(-1)).alias("match"), (-F.col("b.s")).alias("similarity"))


def translation_scores(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(head, tail, relation, score): length of head + relation - tail; the lower, the more plausible."""
    e, r = entities.select("id", "vec"), relations.select("id", "vec")
    rows = triples.join(e.select(F.col("id").alias("head"), F.col("vec").alias("h")), "head").join(e.select(F.col("id").alias("tail"), F.col("vec").alias("t")), "tail").join(r.select(F.col("id").alias("relation"), F.col("vec").alias("r")), "relation")
    gap = F.zip_with(F.zip_with("h", "r", lambda a, b: a + b), F.col("t"), lambda a, b: a - b)
    return rows.select("head", "tail", "relation", norm(gap).alias("score"))


def phrase_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("similarity", cosine(F.col("a"), F.col("b")))


def in_order(vocabulary: DataFrame, vectors: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    """(id, token, vec) of a vocabulary (token, id): its vectors, and for words without one normal draws, by id alone, of the mean and deviation of all numbers of the vectors."""
    numbers = vectors.select(F.explode("vec").alias("v"))
    s = numbers.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()  # two numbers
    mean, deviation = s["m"] or 0.0, s["s"] or 0.0

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            drawn = seeded(pdf["id"].to_numpy(np.int64), dims, seed) * dims**0.5 * deviation + mean
            yield pd.DataFrame({"id": pdf["id"], "token": pdf["token"], "vec": [*drawn]})

    joined = vocabulary.select("id", "token").join(vectors.select("token", "vec"), "token", "left")
    new = joined.where("vec is null").select("id", "token").mapInPandas(draw, "id bigint, token string, vec array<double>")
    return joined.where("vec is not null").select("id", "token", F.transform("vec", lambda x: x.cast("double")).alias("vec")).unionByName(new)


def adapted(general: DataFrame, domain: DataFrame, components: int = 100) -> DataFrame:
    """(token, vec): domain-adapted vectors by canonical correlation of general and domain vectors (token, vec).

    Both sides are standardised over the shared words; a shared word gets the mean of its two projections, one of the domain alone the projection of its domain vector. Only sums of
    products, a square of the dimensions for each task, come to the driver, where the small decomposition is done. Without shared words there are no vectors.
    """
    both = general.select("token", F.col("vec").alias("x")).join(domain.select("token", F.col("vec").alias("y")), "token").where("x is not null and y is not null")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, dims = None, 0, (0, 0)
        for pdf in batches:
            if pdf.empty:
                continue
            x, y = (np.stack(pdf[c].to_numpy()).astype(float) for c in ("x", "y"))
            m = np.concatenate([np.ones((len(x), 1)), x, y], axis=1)
            total = m.T @ m if total is None else total + m.T @ m
            n, dims = n + len(x), (x.shape[1], y.shape[1])
        if total is not None:
            yield pd.DataFrame({"p": [dims[0]], "q": [dims[1]], "s": [total.ravel()]})

    rows = both.repartition(MAX_SUMS).select("x", "y").mapInPandas(sums, "p int, q int, s array<double>").collect()
    schema = "token string, vec array<double>"
    if not rows:
        return general.sparkSession.createDataFrame([], schema)
    p, q = rows[0]["p"], rows[0]["q"]
    s = sum(np.array(r["s"]) for r in rows).reshape(1 + p + q, 1 + p + q)
    n = s[0, 0]
    mean = s[0, 1:] / n
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    cov = cov / np.outer(deviation, deviation)

    def root(c: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(c)
        return v @ np.diag(np.where(w > 1e-9, 1 / np.sqrt(np.maximum(w, 1e-9)), 0.0)) @ v.T

    rx, ry = root(cov[:p, :p]), root(cov[p:, p:])
    u, _, vt = np.linalg.svd(rx @ cov[:p, p:] @ ry)
    k = min(components, p, q)
    signs = np.sign(u[np.abs(u[:, :k]).argmax(axis=0), np.arange(k)])
    wx, wy = rx @ u[:, :k] * signs, ry @ vt[:k].T * signs

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            y = (np.stack(pdf["y"].to_numpy()).astype(float) - mean[p:]) / deviation[p:] @ wy
            has = pdf["x"].notna().to_numpy()
            if has.any():
                x = (np.stack(pdf.loc[has, "x"].to_numpy()).astype(float) - mean[:p]) / deviation[:p] @ wx
                y[has] = (y[has] + x) / 2
            yield pd.DataFrame({"token": pdf["token"], "vec": [*y]})

    all_ = domain.where("vec is not null").select("token", F.col("vec").alias("y")).join(general.select("token", F.col("vec").alias("x")), "token", "left")
    return all_.select("token", "x", "y").mapInPandas(project, schema)
