"""P8: filling containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut
from graphloom.llm.tokens import TOKENIZER, sized

ROWS_PER_PART = 200_000  # rows of one length that are numbered in one task
MAX_CAPACITY = 1_000_000  # lengths that are planned on the driver


def fullest(free: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to free, by subset sums in a bitset."""
    mask = (1 << (free + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > free:
            continue
        left, part = min(counts[n], free // n), 1
        while left > 0:
            k = min(part, left)
            new = (reach | reach << (n * k)) & mask
            if new != reach:
                steps.append((n, k, reach))
                reach = new
                if reach >> free & 1:
                    break
            left -= k
            part *= 2
        if reach >> free & 1:
            break
    at, use = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            use[n] = use.get(n, 0) + k
            at -= n * k
    return use


def plan(capacity: int, histogram: dict[int, int]) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: items in the bin}) that use up the histogram.

    Each bin takes the longest item left and the fullest combination of the others beside it; the pattern
    is repeated as often as its items last. The work depends on the capacity, which bounds the lengths, not on the number of items.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    longest = sorted(counts)
    while longest:
        top = longest[-1]
        if not counts.get(top):
            longest.pop()
            continue
        counts[top] -= 1
        ready = sorted((n for n, c in counts.items() if c), key=lambda n: (-counts[n], -n))
        use = fullest(capacity - top, ready, counts)
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        times = min(counts[n] // k for n, k in use.items())
        for n, k in use.items():
            counts[n] -= k * times
        counts = {n: c for n, c in counts.items() if c}
        out.append((times, use))
    return out


def _lookup(patterns: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each length: first rank, first bin and items a bin of the patterns that take it; and the number of bins."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for times, use in patterns:
        for n, k in use.items():
            by.setdefault(n, []).append((rank.get(n, 0), base, k))
            rank[n] = rank.get(n, 0) + times * k
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in by.items()}, base


def packed(docs: DataFrame, containers: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container, bin, doc_id, piece, tokens): every piece of every text in one bin of each container size.

    A text that exceeds the capacity gives full pieces, each a bin of its own (numbered below zero), and one rest; no other
    is cut. The lengths' histogram, at most one entry for each length up to the capacity, is planned by minimum
    bin slack on the driver; items then find their bins by their rank among the items of their length, which are numbered
    in parts of about ROWS_PER_PART rows. Texts without tokens (null, empty) need no container. Repeated rows are items
    each. Containers with a null name or capacity below 1 are left out, one above MAX_CAPACITY is refused; empty tables give no rows.
    """
    sizes = cut(sized(docs, tokenizer).where("tokens > 0").select("doc_id", "tokens"))
    sizes = sizes.withColumn("row", F.monotonically_increasing_id())  # the partitions are written, so it is the same each time
    kinds = [(r["container"], r["capacity"]) for r in containers.where("container is not null and capacity >= 1").select("container", "capacity").distinct().collect()]
    if any(c > MAX_CAPACITY for _, c in kinds):
        raise ValueError(f"a container of more than {MAX_CAPACITY} tokens")
    schema = "container string, bin bigint, doc_id bigint, piece int, tokens bigint"
    if not kinds:
        return docs.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in kinds]))
    items = sizes.select("doc_id", "row", "tokens", each.alias("k")).select("doc_id", "row", "tokens", "k.container", "k.capacity")
    items = items.select("container", "capacity", "doc_id", "row", (F.col("tokens") % F.col("capacity")).alias("length"), F.floor(F.col("tokens") / F.col("capacity")).cast("int").alias("full"))
    salts = max(1, -(-sizes.count() // ROWS_PER_PART))
    items = items.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    # the full pieces are numbered like the items of a length, each text by as many as it fills
    rests = items.where("length > 0").withColumn("bins", F.lit(1)).unionByName(items.where("full > 0").withColumn("length", F.lit(0).cast("bigint")).withColumn("bins", F.col("full")))
    parts = cut(rests.groupBy("container", "length", "salt").agg(F.sum("bins").alias("n")))
    histogram: dict[str, dict[int, int]] = {n: {} for n, _ in kinds}
    for r in parts.where("length > 0").groupBy("container", "length").agg(F.sum("n").alias("n")).collect():  # bounded by the capacities
        histogram[r["container"]][r["length"]] = r["n"]
    lookups = {n: _lookup(plan(c, histogram[n])) for n, c in kinds}
    shared = docs.sparkSession.sparkContext.broadcast(lookups)
    before = W.Window.partitionBy("container", "length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = parts.select("container", "length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.sum("bins").over(W.Window.partitionBy("container", "length", "salt").orderBy("row").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    ranked = rests.withColumn("rank", number - F.col("bins")).join(offsets, ["container", "length", "salt"])
    ranked = ranked.select("container", "capacity", "doc_id", "length", "full", (F.col("rank") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bins = np.empty(len(pdf), np.int64)
            for (container, length), at in pdf.groupby(["container", "length"]).indices.items():
                first, base, k = shared.value[container][0][length]
                rank = pdf["rank"].to_numpy()[at]
                i = np.searchsorted(first, rank, "right") - 1
                bins[at] = base[i] + (rank - first[i]) // k[i]
            yield pd.DataFrame({"container": pdf["container"], "bin": bins, "doc_id": pdf["doc_id"], "piece": pdf["full"], "tokens": pdf["length"]})

    fulls = ranked.where("length = 0").select("container", "doc_id", "capacity", "rank", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = fulls.select("container", (-1 - F.col("rank") - F.col("piece")).alias("bin"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    return ranked.where("length > 0").select("container", "doc_id", "length", "full", "rank").mapInPandas(place, schema).unionByName(whole)


def report(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, capacity, bins, items, tokens, fill) of a packing."""
    bins = placed.groupBy("container", "bin").agg(F.count("*").alias("i"), F.sum("tokens").alias("t"))
    rows = bins.groupBy("container").agg(F.count("*").alias("bins"), F.sum("i").alias("items"), F.sum("t").alias("tokens"))
    return rows.join(containers.select("container", "capacity").distinct(), "container").withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))
