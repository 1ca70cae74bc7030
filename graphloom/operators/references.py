"""P6: references to records that do not exist."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import HOT_GROUPS

KEYS_PER_RANGE, MAX_RANGES, MAX_TARGETS = 100_000, 4096, 1000
KINDS = ("missing", "deleted", "late")
FAR_PAST, FAR_FUTURE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Binary search of batches of references in sorted parent keys.

    Rows come by key: the parents of a cell (even keys), which become one sorted array for each column, and then its references (odd keys).
    """
    here, parts, parents = None, [], None
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        keys, ids, first, second = (column[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "first", "second"))
        known = column["known"].to_numpy(zero_copy_only=False).astype(bool)
        kind = np.zeros(len(keys), np.int32)
        edges = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(keys)]):
            if lo == hi:
                continue
            if keys[lo] >> 1 != here:
                here, parts, parents = keys[lo] >> 1, [], None
            if not keys[lo] & 1:
                parts.append((ids[lo:hi], first[lo:hi], second[lo:hi]))
                continue
            if parents is None and parts:
                whole = [np.concatenate(c) for c in zip(*parts)]
                order = np.argsort(whole[0], kind="stable")
                parents, parts = [c[order] for c in whole], []
            if parents is None:
                kind[lo:hi] = 1
                continue
            sorted_ids, added, deleted = parents
            at = np.minimum(np.searchsorted(sorted_ids, ids[lo:hi]), len(sorted_ids) - 1)
            hit = sorted_ids[at] == ids[lo:hi]
            dead = known[lo:hi] & (deleted[at] <= first[lo:hi])
            late = known[lo:hi] & (added[at] > first[lo:hi])
            kind[lo:hi] = np.where(~hit, 1, np.where(dead, 2, np.where(late, 3, 0)))
        some = pa.array(np.flatnonzero(kind))
        out = [column[c].take(some) for c in ("triple_id", "field", "first", "known")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(kind[kind > 0])], names=["triple_id", "field", "loaded", "known", "kind"])


def orphans(refs: DataFrame, parents: DataFrame, keys_per_range: int = KEYS_PER_RANGE) -> DataFrame:
    """Distinct references without a valid target: triple_id, field, kind, period.

    refs has triple_id, field, target, id, loaded_at; parents has target, id, added_at, deleted_at.
    Both are cut into ranges of keys by at most MAX_RANGES quantiles of the parents' keys, and these evenly into more where there are
    more keys. A range's parents go ahead of its references and become one sorted array; the references stream past it in batches, so
    no task holds more than one range and one batch. Ranges with more than a HOT_GROUPS-th of all references, which are at most that many, are split
    over several tasks, each with its own copy of the parents. Null ids and -1 are no references. A null loaded_at can
    only be `missing` and has a null period. A parent without added_at was known from the start,
    one without deleted_at was not deleted. Where a key stands twice among the parents, one of its rows
    that comes first in the order of added_at and deleted_at decides. Empty parents make every reference missing.
    """
    parents = (
        parents.where(F.col("id").isNotNull())
        .groupBy("target", "id")
        .agg(F.min(F.struct(F.coalesce(_micros("added_at"), F.lit(int(FAR_PAST))).alias("added"), F.coalesce(_micros("deleted_at"), F.lit(int(FAR_FUTURE))).alias("deleted"))).alias("t"))
        .select("target", "id", "t.added", "t.deleted")
    )
    refs = refs.where("id is not null and id <> -1").select("triple_id", "field", "target", "id", F.coalesce(_micros("loaded_at"), F.lit(0)).alias("loaded"), F.col("loaded_at").isNotNull().alias("known"))
    n_keys = parents.count()
    n_ranges = min(MAX_RANGES, max(1, -(-n_keys // keys_per_range)))
    finer = max(1, -(-n_keys // (n_ranges * keys_per_range)))
    # the sketch of the quantiles is as large as the number of ranges asks for, whatever the data
    splits = sorted(set(parents.approxQuantile("id", [i / n_ranges for i in range(1, n_ranges)], 0.1 / n_ranges))) if n_ranges > 1 else []
    cutter = Bucketizer(splits=[-float("inf"), *splits, float("inf")], inputCol="key", outputCol="coarse") if splits else None

    def ranged(df: DataFrame) -> DataFrame:
        if cutter is None:
            return df.withColumn("range", F.lit(0).cast("bigint"))
        at = cutter.transform(df.withColumn("key", F.col("id").cast("double"))).drop("key").withColumn("coarse", F.col("coarse").cast("int"))
        if finer == 1:
            return at.withColumn("range", F.col("coarse").cast("bigint")).drop("coarse")
        bounds = F.array(*[F.lit(int(x)) for x in [2 * splits[0] - splits[-1], *splits, 2 * splits[-1] - splits[0]]])
        lo, hi = F.get(bounds, F.col("coarse")), F.get(bounds, F.col("coarse") + 1)
        within = F.floor(F.least(F.greatest((F.col("id") - lo) / F.greatest(hi - lo, F.lit(1)), F.lit(0.0)), F.lit(0.999999)) * finer)
        return at.withColumn("range", F.col("coarse") * F.lit(finer).cast("bigint") + within).drop("coarse")

    refs, parents = ranged(refs), ranged(parents)
    sizes = refs.groupBy("target", "range").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(200_000), F.col("total") / HOT_GROUPS)
    hot = F.broadcast(sizes.join(F.broadcast(total)).where(F.col("n") > least).select("target", "range", F.ceil(F.col("n") / least).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    # cells of a target, a range and a part, each with its parents (even) before its references (odd)
    targets = sorted(r["target"] for r in sizes.select("target").distinct().limit(MAX_TARGETS + 1).collect())
    if len(targets) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    code = F.lit(0)
    for i, t in enumerate(targets):
        code = F.when(F.col("target") == t, i + 1).otherwise(code)
    cell = lambda part: ((F.col("range") * (MAX_TARGETS + 1) + code) * 2**20 + part).cast("bigint").alias("cell")
    refs = refs.join(hot, ["target", "range"], "left").select("triple_id", "field", "id", F.col("loaded").alias("first"), F.lit(0).cast("bigint").alias("second"), "known", cell(F.pmod(F.xxhash64("triple_id", "field"), parts)))
    parents = parents.join(hot, ["target", "range"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    parents = parents.select("id", F.col("added").alias("first"), F.col("deleted").alias("second"), F.lit(False).alias("known"), cell(F.col("part")))
    rows = refs.withColumn("key", F.col("cell") * 2 + 1).unionByName(parents.withColumn("key", F.col("cell") * 2), allowMissingColumns=True)
    ordered = rows.repartition("cell").sortWithinPartitions("key").drop("cell")
    found = ordered.mapInArrow(_probe, "triple_id bigint, field string, loaded bigint, known boolean, kind int")
    period = F.when(F.col("known"), F.date_format(F.timestamp_micros("loaded"), "yyyy-MM"))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return found.select("triple_id", "field", kind.alias("kind"), period.alias("period")).distinct()


def triple_orphans(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Orphan references of a triple table whose head and tail name entities and whose relation names relations."""
    slots = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), F.col(f).alias("id")) for f, t in (("head", "entity"), ("tail", "entity"), ("relation", "relation"))])
    refs = triples.select("triple_id", "loaded_at", F.explode(slots).alias("s")).select("triple_id", "s.field", "s.target", "s.id", "loaded_at")
    parents = entities.select(F.lit("entity").alias("target"), "id", "added_at", "deleted_at").unionByName(relations.select(F.lit("relation").alias("target"), "id", "added_at", "deleted_at"))
    return orphans(refs, parents)
