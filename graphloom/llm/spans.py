"""P10: long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import attach_groups, cut, release

SPAN = 200  # characters
BUCKETS = 1 << 17
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring sums get unrelated values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[base]
    return up[:n], down[:n]


_CODES = _mix(np.arange(1, 0x110001, dtype=np.uint64))


class Hashes:
    """Hashes of all windows of a text, from sums over its prefixes."""

    def __init__(self, text: str, base: int):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(codes)
        up, self.down = _powers(base, self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_CODES[codes] * up[:-1], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.down[: self.n - size + 1])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def _rolling(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """op over each window of the width, in two passes over blocks of the width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, fill, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    left = op.accumulate(grid, axis=1).ravel()
    right = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least hash of some window of the width: every window holds one, chosen by its content alone."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    least = _rolling(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_rolling(around, width, np.maximum, 0) == hashes)


def _scan(span: int):
    """The anchors of each text with their positions and the hashes of their surroundings."""
    gram, width = span // 2, span - span // 2 + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if len(text) < span:
                    continue
                h = Hashes(text, BASES[0])
                w = h.windows(gram)
                at = anchors(w, width)
                context = h.at(np.maximum(at - (span - gram), 0), np.minimum(at + span, h.n))
                rows.append((doc, w[at].view(np.int64), at.astype(np.int32), context.view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "anchor", "pos", "context"])

    return run


def _windows(span: int):
    gram, width = span // 2, span - span // 2 + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, spots in zip(pdf["doc_id"], pdf["text"], pdf["spots"]):
                first, second = Hashes(text, BASES[0]), Hashes(text, BASES[1])
                starts = np.unique(np.concatenate([np.arange(max(0, p - (span - gram)), min(p, first.n - span) + 1) for p in spots]))
                rows.append((doc, starts.astype(np.int32), first.at(starts, starts + span).view(np.int64), second.at(starts, starts + span).view(np.int64)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "h1", "h2"])

    return run


def merged(runs: DataFrame) -> DataFrame:
    """Maximal runs (doc_id, span_start, span_end) of the intervals [lo, hi) of each document that touch or overlap."""
    order = W.Window.partitionBy("doc_id").orderBy("lo", "hi")
    top = F.max("hi").over(order.rowsBetween(W.Window.unboundedPreceding, -1))
    fresh = runs.withColumn("fresh", F.when(F.col("lo") <= top, 0).otherwise(1)).where("lo < hi")
    numbered = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)))
    return numbered.groupBy("doc_id", "run").agg(F.min("lo").alias("span_start"), F.max("hi").alias("span_end")).drop("run")


def shared_spans(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Maximal runs of characters (doc_id, span_start, span_end) that lie in a stretch of `span` characters which another doc_id's text also holds.

    A run of consecutive sentences may be shorter or longer than the span and a shared stretch may hold
    no whole sentence, so the units are cut by content instead: of the half-span grams the locally
    least hashes are anchors, every stretch of the span holds one, and equal stretches hold the same.
    1. Texts are hashed whole; of equal texts only one is searched and its spans hold for all.
    2. Anchors that occur once are dropped.
    3. An anchor whose whole surroundings recur is shared without more ado. Around the others the
       stretches of the span are hashed (two independent 64-bit hashes) and counted by text.
    Every step groups by hashes with partial aggregation; nothing is listed by group. What a step has used up is released before the next
    writes. A document with null id or text has no spans; empty tables give none; a text is never cut.
    """
    gram, spark = span // 2, docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    total = docs.count()
    marks = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("mark"), F.char_length("text").alias("n"))
    classes = marks.groupBy("mark", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    reps = classes.select(F.col("rep").alias("doc_id"), "copies", F.col("n").alias("size"))
    spots = cut(docs.mapInPandas(_scan(span), "doc_id bigint, anchor array<bigint>, pos array<int>, context array<bigint>"))  # the texts are hashed once
    often = spots.select(F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    often = cut(often)  # most anchors are single; only a count of them is shuffled
    n_spots = often.agg(F.sum("n")).first()[0] or 0
    release(spark)
    spots = spots.select("doc_id", F.explode(F.arrays_zip("anchor", "pos", "context")).alias("s")).select("doc_id", "s.*")
    spots = cut(attach_groups(spots, often, ["anchor"], "n", n_spots).drop("n").join(reps.select("doc_id", "size"), "doc_id"))
    release(spark)  # all anchors, of which the rest needs those that recur
    around = spots.groupBy("anchor", "context").agg(F.count("*").alias("m"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    around = around.select("anchor", "context", "m", (F.col("a") != F.col("b")).alias("whole"))
    spots = cut(attach_groups(spots.select("doc_id", "anchor", "context", "pos", "size"), around, ["anchor", "context"], "m", n_spots))
    lo, hi = F.greatest(F.col("pos") - (span - gram), F.lit(0)), F.least(F.col("pos") + span, F.col("size"))
    wholes = spots.where("whole").select("doc_id", lo.alias("lo"), hi.alias("hi"))
    # occurrences of the least and the greatest doc_id stand for each surroundings, so that one is in another document than any
    # occurrence that differs; the whole ones are needed as partners only where an anchor has others too
    at = F.struct("doc_id", "pos")
    two = spots.where("whole").groupBy("anchor", "context").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    two = two.select("anchor", "a.doc_id", "a.pos", F.col("b.doc_id").alias("doc2"), F.col("b.pos").alias("pos2"))
    keep = spots.where("not whole").select("anchor", "doc_id", "pos").unionByName(two, allowMissingColumns=True)
    keep = cut(keep)  # those without doc2 are not whole
    partial = keep.groupBy("anchor").agg(F.count("*").alias("k"), F.bool_or(F.col("doc2").isNull()).alias("open")).where("open and k > 1").select("anchor", "k")
    ends = F.array(at, F.struct(F.col("doc2").alias("doc_id"), F.col("pos2").alias("pos")))
    edges = attach_groups(keep, partial, ["anchor"], "k", keep.count()).select(F.explode(ends).alias("o")).select("o.*").where("doc_id is not null")
    edges = edges.groupBy("doc_id").agg(F.collect_set("pos").alias("spots"))
    edges = cut(edges)
    release(spark)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    some = F.broadcast(edges.select(bucket.alias("bucket")).distinct())  # at most BUCKETS rows, whatever the data
    near = docs.withColumn("bucket", bucket).join(some, "bucket", "left_semi").drop("bucket")  # spares most texts the shuffle
    rows = cut(near.join(edges, "doc_id").mapInPandas(_windows(span), "doc_id bigint, start array<int>, h1 array<bigint>, h2 array<bigint>"))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("start", "h1", "h2")).alias("s")).select("doc_id", "s.*")
    both = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h1", "h2", "n")
    both = cut(both)
    n_both = both.agg(F.sum("n")).first()[0] or 0
    release(spark)
    parts = attach_groups(rows, both, ["h1", "h2"], "n", n_both).select("doc_id", F.col("start").alias("lo"), (F.col("start") + span).alias("hi"))
    runs = wholes.unionByName(parts)
    copied = reps.where(f"copies > 1 and size >= {span}").select("doc_id", F.lit(0).cast("bigint").alias("lo"), F.col("size").cast("bigint").alias("hi"))
    found = merged(runs.unionByName(copied))
    members = attach_groups(marks.select("doc_id", "mark", "n"), classes.where("copies > 1"), ["mark", "n"], "copies", total).where("doc_id <> rep").select("doc_id", F.lit(0).cast("bigint").alias("span_start"), F.col("n").cast("bigint").alias("span_end")).where(f"span_end >= {span}")
    return found.select("doc_id", F.col("span_start").cast("bigint"), F.col("span_end").cast("bigint")).unionByName(members)
