"""P9: mixing sources to target weights by Sainte-Laguë apportionment of token blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut
from graphloom.llm.tokens import TOKENIZER, sized

BLOCK, SHARDS, MAX_SOURCES = 1024, 8, 10_000
ROWS_PER_BUCKET = 200_000  # documents that are put in order in one task


def apportion(seats: list[int], shares: dict[str, float], most: dict[str, int]) -> list[dict[str, int]]:
    """Blocks by source for each growing number of seats, given to the highest quotients share / (2 x blocks + 1).

    No source gets more than its most blocks. Quotas for more seats never take a block away. Far from the
    end blocks are given in bulk: with a divisor d each source holds round(share / d) blocks, which is the same apportionment.
    """
    out = []
    sources = sorted(s for s in shares if shares[s] > 0 and most.get(s, 0) > 0)
    for n in seats:
        n = min(n, sum(most[s] for s in sources))
        got = {s: 0 for s in sources}
        if sources and n > 0:
            lo, hi = 0.0, sum(shares[s] for s in sources) * 4 + 1.0  # divisor that gives too many, too few
            held = lambda d: {s: min(most[s], int(shares[s] / d + 0.5)) for s in sources}
            for _ in range(200):
                mid = (lo + hi) / 2
                if mid <= lo or mid >= hi:
                    break
                if sum(held(mid).values()) > n:
                    lo = mid
                else:
                    hi = mid
            got = held(hi)
        rest = n - sum(got.values())
        heap = [(-shares[s] / (2 * got[s] + 1), s) for s in sources if got[s] < most[s]]
        heapq.heapify(heap)
        while rest > 0 and heap:
            _, s = heapq.heappop(heap)
            got[s] += 1
            rest -= 1
            if got[s] < most[s]:
                heapq.heappush(heap, (-shares[s] / (2 * got[s] + 1), s))
        out.append(got)
    return out


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]], block: int, shards: int, total: int | None = None) -> tuple[list[dict[str, int]], dict[str, int]]:
    """(blocks by source up to each shard, most blocks by source)."""
    most = {s: available.get(s, 0) * r // block for s, (_, r) in targets.items()}
    shares = {s: share for s, (share, _) in targets.items() if share > 0 and most[s] > 0}
    if total is None:  # the largest total for which every source with documents reaches its share
        whole = sum(shares.values())
        total = min((int(most[s] / (share / whole)) for s, share in shares.items()), default=0) * block
    n = total // block
    return apportion([n * (i + 1) // shards for i in range(shards)], shares, most), most


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 7, block: int = BLOCK, shards: int = SHARDS, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection: doc_id, source, copy, shard, tokens, one row for each use of a document. report: source, target_share, max_repeats,
    available_tokens, blocks, tokens, actual_share.
    The documents of a source stand in a seeded random order on a line of tokens, once for each allowed use; the
    line is cut into blocks of equal tokens, and the source's quota takes the first. Blocks of different shards follow one another. A document counts to the
    block in which it begins, so a source is off by less than one document. Positions are sums over hash buckets and then within
    them, so no source is ordered in one task. Documents without a listed source, without tokens or with a null id
    take no part; a source without documents gets nothing and the others share in proportion. By default the total is the largest
    that the caps on repeats allow at the target shares.
    """
    spark = docs.sparkSession
    listed = targets.where("source is not null and target_share is not null").select("source", "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    goal = listed.limit(MAX_SOURCES + 1).collect()
    if len(goal) > MAX_SOURCES:
        raise ValueError("more sources than a table of targets may list")
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in goal}
    sizes = sized(docs.where("doc_id is not null and source is not null"), tokenizer).where("tokens > 0")
    known = spark.createDataFrame([(s,) for s in wanted] or [], "source string")
    sizes = sizes.join(F.broadcast(known), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    sizes = cut(sizes)
    sizes = sizes.withColumn("bucket", F.pmod("h", F.lit(max(1, -(-sizes.count() // ROWS_PER_BUCKET)))))
    sums = cut(sizes.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")))
    available = {r["source"]: r["t"] for r in sums.groupBy("source").agg(F.sum("t").alias("t")).collect()}  # one row a source
    upto, _ = quotas(available, wanted, block, shards, total)
    ends = {s: [q.get(s, 0) * block for q in upto] for s in wanted}
    table = spark.createDataFrame([(s, available.get(s, 0), wanted[s][1], ends[s]) for s in wanted] or [], "source string, available bigint, repeats int, ends array<bigint>")
    before = W.Window.partitionBy("source").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = W.Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    placed = sizes.withColumn("at", F.sum("tokens").over(inner) - F.col("tokens")).join(offsets, ["source", "bucket"]).join(F.broadcast(table), "source")
    placed = placed.withColumn("at", F.col("at") + F.col("base"))
    uses = placed.where("repeats > 0").select("doc_id", "source", "tokens", "available", "at", "ends", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)).alias("copy"))
    uses = uses.withColumn("line", F.col("at") + F.col("copy") * F.col("available")).where(F.col("line") < F.element_at("ends", -1))
    selection = cut(uses.select("doc_id", "source", "copy", F.size(F.filter("ends", lambda e: e <= F.col("line"))).alias("shard"), "tokens"))
    taken = selection.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    whole = selection.agg(F.sum("tokens").alias("all"))
    blocks = table.select("source", "available", (F.element_at("ends", -1) / block).cast("bigint").alias("blocks"))
    rows = listed.join(blocks, "source").join(taken, "source", "left").join(F.broadcast(whole))
    report = rows.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "blocks", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"))
    return selection, report
