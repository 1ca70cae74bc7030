"""Average-linkage clustering of entities by the cosine distance of their vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.operators.components import connected_components

MISS, MOST_TABLES = 1e-4, 256
MAX_COMPONENT = 20_000


def tables_for(distance: float, miss: float = MISS, most: int = MOST_TABLES) -> tuple[int, int]:
    """(tables, bits): hash tables of so many signs of random projections that miss a pair at the distance with the probability `miss`; the most bits that `most` tables allow."""
    agree = 1 - np.arccos(1 - distance) / np.pi
    need = lambda bits: int(np.ceil(np.log(miss) / np.log1p(-(agree**bits))))
    bits = 1
    while bits < 24 and need(bits + 1) <= most:
        bits += 1
    return need(bits), bits


def close_pairs(vectors: DataFrame, distance: float, seed: int = 1) -> DataFrame:
    """(a, b, distance): pairs of (id, vec) with a cosine distance of at most `distance`.

    Vectors with the same signs under a group of random projections are compared exactly. A pair at the distance is missed
    with the probability MISS at most. Null and all-zero vectors are near to none.
    """
    n, bits = tables_for(distance)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for pdf in batches:
            if pdf.empty:
                continue
            m = np.stack(pdf["vec"].to_numpy()).astype(float)
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(m.shape[1], n * bits))
            signs = (m @ planes > 0).reshape(len(m), n, bits)
            keys = (signs * (1 << np.arange(bits))).sum(axis=2) + np.arange(n) * (1 << bits)
            yield pd.DataFrame({"id": pdf["id"].to_numpy().repeat(n), "key": keys.ravel()})

    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = vectors.where("id is not null and vec is not null").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("l", norm).where("l > 0")
    unit = cut(unit.select("id", F.transform("vec", lambda x: x / F.col("l")).alias("vec")))
    keys = unit.mapInPandas(hashes, "id bigint, key bigint").repartition("key")
    pairs = keys.select(F.col("id").alias("a"), "key").join(keys.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    both = pairs.join(unit.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a").join(unit.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
    gap = 1 - F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", gap.alias("distance")).where(F.col("distance") <= distance)


def average_linkage(m: np.ndarray, distance: float) -> np.ndarray:
    """Labels of the rows of unit vectors: the two clusters with the least mean distance merge until it exceeds `distance`.

    The mean distance of two clusters is one less the product of their mean vectors, so no matrix of all pairs of members is kept up.
    """
    labels = np.arange(len(m))
    sums, sizes = m.copy(), np.ones(len(m))
    gaps = 1 - sums @ sums.T
    np.fill_diagonal(gaps, np.inf)
    while len(m) > 1:
        i, j = np.unravel_index(gaps.argmin(), gaps.shape)
        if not gaps[i, j] <= distance + 1e-12:
            break
        i, j = min(i, j), max(i, j)
        labels[labels == j] = i
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        gaps[j, :] = gaps[:, j] = np.inf
        live = np.isfinite(gaps[i]) & (np.arange(len(m)) != i)
        gaps[i, live] = 1 - (sums[live] @ sums[i]) / (sizes[live] * sizes[i])
        gaps[live, i] = gaps[i, live]
    return labels


def clusters(vectors: DataFrame, distance: float = 0.2) -> DataFrame:
    """(id, cluster): average-linkage clusters of (id, vec) cut at a cosine distance; a cluster is named by its least id.

    Two clusters only merge if some members are within the distance, so clusters lie within the connected components of the
    close pairs, and each component is clustered by itself: the same result as over all vectors. A component of more than
    MAX_COMPONENT vectors is refused rather than cut. Null ids and vectors take no part; all-zero vectors are alone; an empty table gives no rows.
    """
    rows = vectors.where("id is not null and vec is not null").select("id", "vec").dropDuplicates(["id"])
    comp = cut(connected_components(close_pairs(rows, distance), "a", "b"))
    largest = comp.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > MAX_COMPONENT:
        raise ValueError(f"a component of {largest} vectors; take a smaller distance")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["vec"].to_numpy()).astype(float)
        labels = average_linkage(m / np.linalg.norm(m, axis=1, keepdims=True), distance)
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"id": ids, "cluster": ids[labels]})

    near = rows.join(comp, F.col("id") == F.col("node")).select("id", "vec", "component")
    found = near.groupBy("component").applyInPandas(run, "id bigint, cluster bigint")
    return found.unionByName(rows.join(comp, F.col("id") == F.col("node"), "left_anti").select("id", F.col("id").alias("cluster")))
