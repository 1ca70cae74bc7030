"""P4: near-duplicate records with small edits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.llm.spans import _mix

SHINGLE, THRESHOLD = 5, 0.7
MISS, BANDS = 1e-5, 96  # a pair at the threshold is missed with this probability at most; bands of a text at most
SKETCH_MISS = MISS / 10  # the part of MISS that the sketches take
SKETCH, TOGETHER, IN_ONE = 384, 32, 500_000  # bits of a sketch at most, bands that share a copy of it, texts whose tokens meet in one task


def banding(threshold: float, miss: float = MISS - SKETCH_MISS, most: int = BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which no more than `most` bands miss a pair at the threshold with the probability `miss`."""
    if threshold >= 1:
        return 1, 32
    need = lambda rows: math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    rows = 1
    while need(rows + 1) <= most and rows < 32:
        rows += 1
    return need(rows), rows


def agreement(threshold: float, bits: int, miss: float = SKETCH_MISS) -> int:
    """The bits of sketches that agree at least, but for the probability `miss`, for a pair at the threshold; each agrees with (1 + threshold) / 2."""
    p, below = min(1.0, (1 + threshold) / 2), 0.0
    for k in range(bits):
        below += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if below > miss:
            return k
    return bits


def shingle_sets(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the substrings of the width, for each text."""
    out: list[np.ndarray] = []
    for i in range(0, len(texts), 64):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts[i : i + 64]]
        flat = np.concatenate(codes).astype(np.uint64)
        n = max(0, len(flat) - width + 1)
        # a code point has 21 bits, so three are mixed at once
        h = np.zeros(n, np.uint64)
        for j in range(0, width, 3):
            for k in range(j, min(j + 3, width)):
                h = h + ((flat[k : k + n] + np.uint64(1)) << np.uint64(21 * (k - j)))
            h = _mix(h * np.uint64(0x100000001B3) + np.uint64(1))
        at = 0
        for c in codes:
            s = np.sort(h[at : at + max(0, len(c) - width + 1)])
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
            at += len(c)
    return out


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the substrings of the width."""
    return shingle_sets([text], width)[0]


def least_members(s: np.ndarray, n: int) -> np.ndarray:
    """The least members of the set under n random orders."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    times = (_mix(k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    # the members are mixed well, so an odd factor gives an order; half of the orders come from each half of the members
    halves = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    least = np.empty(n, np.uint32)
    for i in range(0, n, 64):
        j = min(i + 64, n)
        least[i:j] = (halves[i // 64 % 2][None, :] * times[i:j, None]).min(axis=1)
    return least


def bands(least: np.ndarray, n: int, rows: int) -> np.ndarray:
    """MinHash bands of texts, one row each: a band joins the least members of the set under so many random orders."""
    each = least.reshape(len(least), n, rows).astype(np.uint64)
    h = np.zeros(each.shape[:2], np.uint64)
    for i in range(rows):
        h = _mix(h * np.uint64(0x100000001B3) + each[:, :, i] + np.uint64(1))
    return _mix(h + np.arange(n, dtype=np.uint64))


def _tokens(n: int, rows: int, ranges: int):
    """(part, grp, size, data): data is the sketch of a text and its tokens of one group of bands and one range of tokens; part names both."""
    bits = min(SKETCH, n * rows) // 8 * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = shingle_sets(part.column(1).to_pylist())
                some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                if not len(some):
                    continue
                least = np.stack([least_members(sets[i], n * rows) for i in some])
                sketch = np.packbits((least[:, :bits] * np.uint32(0x9E3779B1)) >> np.uint32(31), axis=1).tobytes()
                tokens = bands(least, n, rows)
                low, of = tokens.astype(np.uint32), (tokens >> np.uint64(32)) % np.uint64(ranges)
                ids, sizes, wide = part.column(0).to_numpy()[some], np.array([len(sets[i]) for i in some], np.int32), bits // 8
                for g, j in enumerate(range(0, n, TOGETHER)):
                    for r in range(ranges):
                        inside = of[:, j : j + TOGETHER] == r
                        row = np.flatnonzero(inside.any(axis=1))
                        data = [sketch[i * wide : (i + 1) * wide] + low[i, j : j + TOGETHER][inside[i]].tobytes() for i in row]
                        columns = [pa.array(np.full(len(row), g * ranges + r, np.int32)), pa.array(ids[row]), pa.array(sizes[row]), pa.array(data, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["part", "grp", "size", "data"])

    return run


def _meetings(threshold: float, n: int, rows: int, most: int = 1 << 20):
    """(a, b) of the texts of one part that share a token and whose sizes and sketches fit."""
    bits = min(SKETCH, n * rows) // 8 * 8
    wide, words, agreed = bits // 8, -(-bits // 64), agreement(threshold, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, sketches, tokens, counts = [], [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            data = batch.column(3)
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            flat = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            length = np.diff(offsets)
            place = np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], length)
            own = np.zeros((len(length), words * 8), np.uint8)
            own[:, :wide] = flat[place < wide].reshape(-1, wide)
            ids.append(batch.column(1).to_numpy())
            sizes.append(batch.column(2).to_numpy())
            sketches.append(own.view(np.uint64))
            tokens.append(flat[place >= wide].view(np.uint32))
            counts.append((length - wide) // 4)
        if not ids:
            return
        ids, sizes, sketches = np.concatenate(ids), np.concatenate(sizes), np.concatenate(sketches)
        counts = np.concatenate(counts)
        keys = np.empty(int(counts.sum()), np.uint64)
        np.concatenate(tokens, out=keys)
        del tokens
        keys <<= np.uint64(32)
        row = at = 0
        while row < len(ids):
            some = counts[row : row + 10_000]
            keys[at : at + int(some.sum())] |= np.repeat(np.arange(row, row + len(some), dtype=np.uint64), some)
            row, at = row + len(some), at + int(some.sum())
        keys.sort()
        halves = keys.astype("<u8", copy=False).view("<u4")
        text, token = halves[0::2], halves[1::2]
        same = np.r_[False, token[1:] == token[:-1], False].view(np.int8)
        steps = np.diff(same)
        first, last = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)  # of the tokens that several texts have
        length = last - first
        at = np.repeat(first, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        later = np.repeat(last, length) - at  # those of the same token that follow
        before = np.cumsum(later)
        i = 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(before, (before[i - 1] if i else 0) + most, "right")))
            x = np.repeat(at[i:j], later[i:j])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later[i:j]) - later[i:j], later[i:j])
            x, y = text[x], text[y]
            fits = np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y])
            x, y = x[fits], y[fits]
            differ = np.zeros(len(x), np.int64)
            for w in range(words):
                differ += np.bitwise_count(sketches[x, w] ^ sketches[y, w])
            fits = (differ <= bits - agreed) & (x != y)
            pairs = np.unique(np.minimum(x[fits], y[fits]).astype(np.uint64) << np.uint64(32) | np.maximum(x[fits], y[fits]))
            a, b = ids[(pairs >> np.uint64(32)).astype(np.int64)], ids[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)]
            a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            i = j

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 500):
            part = pdf.iloc[k : k + 500]
            yield pd.DataFrame({"grp": part["grp"], "tokens": [x.view(np.int64) for x in shingle_sets(list(part["text"]))]})


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for k in range(0, len(pdf), 1000):
            part = pdf.iloc[k : k + 1000]
            texts = dict(zip(part["a"], part["text_a"])) | dict(zip(part["b"], part["text_b"]))
            known = dict(zip(texts, shingle_sets(list(texts.values()))))
            sims = []
            for a, b in zip(part["a"], part["b"]):
                p, q = known[a], known[b]
                common = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
                sims.append(common / (len(p) + len(q) - common))
            yield pd.DataFrame({"a": part["a"], "b": part["b"], "similarity": sims})


def normal_text(title, abstract):
    """title, a space and the abstract in lower case, each run of white space one space."""
    joined = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), abstract))
    return F.trim(F.regexp_replace(joined, r"[ \t\r\n]+", " "))


def groups_of_equals(records: DataFrame) -> DataFrame:
    """(id, grp): records of one normalised text form one group, named by its least id."""
    marks = cut(records.select("id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("mark"), F.char_length("text").alias("n")))
    named = marks.groupBy("mark", "n").agg(F.min("id").alias("grp"))
    return marks.join(named, ["mark", "n"]).select("id", "grp")


def banded_candidates(records: DataFrame, threshold: float, total: int | None = None, in_one: int = IN_ONE) -> DataFrame:
    """(a, b): pairs of records (id, text) that share a MinHash band and whose sketches agree; bands follow the threshold.

    The tokens of TOGETHER bands go to one task, with one copy of the sketch, as numbers; those of more than `in_one` texts are
    split into ranges, each with its own copy. total: the number of records, if known.
    """
    n, rows = banding(threshold)
    ranges = max(1, -(-(records.count() if total is None else total) // in_one))
    tokens = records.select(F.col("id").cast("bigint"), "text").mapInArrow(_tokens(n, rows, ranges), "part int, grp bigint, size int, data binary")
    parts = tokens.repartitionById(-(-n // TOGETHER) * ranges, "part")
    return parts.mapInArrow(_meetings(threshold, n, rows), "a bigint, b bigint").distinct()


def prefix_candidates(records: DataFrame, threshold: float, total: int | None = None) -> DataFrame:
    """(a, b): pairs of records (id, text) that the grouped prefix join cannot exclude; no pair of the threshold is missing.

    Shingles are ordered by their number of texts, rarest first; two sets of the threshold share one of
    their first n - ceil(threshold x n) + 1. Records with the same prefix and size are one group; groups that share a
    token of their prefix and whose sizes fit are paired, and pairs of groups are expanded to their members.
    """
    sets = cut(records.select(F.col("id").alias("grp"), "text").mapInPandas(_sets, "grp bigint, tokens array<bigint>").where("size(tokens) > 0"))
    each = sets.select("grp", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("df"))
    ordered = each.join(often, "token").groupBy("grp", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))  # one text's own shingles
    length = (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int")
    prefixes = cut(ordered.select("grp", "size", F.transform(F.slice("t", F.lit(1), length), lambda x: x["token"]).alias("prefix")).withColumn("key", F.sha2(F.to_json("prefix"), 256)))
    groups = prefixes.groupBy("key", "size").agg(F.min("grp").alias("g"), F.first("prefix").alias("prefix"))
    tokens = cut(groups.select("g", "size", F.explode("prefix").alias("token")))
    left = tokens.select(F.col("g").alias("ga"), F.col("size").alias("sa"), "token")
    right = tokens.select(F.col("g").alias("gb"), F.col("size").alias("sb"), "token")
    fits = (F.col("ga") <= F.col("gb")) & (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb"))
    pairs = left.join(right, "token").where(fits).select("ga", "gb").distinct()
    members = prefixes.join(groups.select("key", "size", "g"), ["key", "size"]).select("g", "grp")
    both = pairs.join(members.select(F.col("g").alias("ga"), F.col("grp").alias("x")), "ga").join(members.select(F.col("g").alias("gb"), F.col("grp").alias("y")), "gb").where("x <> y")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


CANDIDATES = {"bands": banded_candidates, "prefix": prefix_candidates}


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose shingle sets reach the threshold; texts has id and text."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.sortWithinPartitions("b").mapInPandas(_verify, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold)


def group_links(records: DataFrame, threshold: float = THRESHOLD, method: str = "bands") -> DataFrame:
    """(a, b, similarity): pairs of different groups whose shingle sets reach the threshold.

    records has id and text, one row for each group. Candidates are those of equal MinHash bands whose sketches agree, which miss
    a pair at the threshold with a probability of MISS, or, by the method "prefix", those of the grouped
    prefix join, which misses none. A prefix of the rarest shingles is not selective here (the alphabet of
    five-character substrings stays small while the collection grows, so its pairs grow with the square). Candidates are
    verified exactly on the whole texts. Texts shorter than a shingle have no set and no links.
    """
    pairs = cut(CANDIDATES[method](records, threshold))
    return verified(pairs, records.join(ends_of(pairs), "id", "left_semi").select("id", "text"), threshold)


def near_duplicates(papers: DataFrame, threshold: float = THRESHOLD, method: str = "bands") -> tuple[DataFrame, DataFrame]:
    """(membership id/grp, links a/b between groups) of papers with article_id, title and abstract.

    A null title is empty; rows with a null abstract or `**NONE**` or a null id take no part. Repeated rows
    of one text are one group; a group of texts shorter than a shingle has no members here.
    """
    rows = papers.where("article_id is not null and abstract is not null and abstract <> '**NONE**'").select(F.col("article_id").alias("id"), "title", "abstract")
    records = lambda some: some.select("id", normal_text(F.col("title"), F.col("abstract")).alias("text")).where(F.char_length("text") >= SHINGLE)
    members = cut(groups_of_equals(records(rows)))
    firsts = members.where("id = grp").select("id").distinct()
    pairs = cut(CANDIDATES[method](records(rows.join(firsts, "id", "left_semi")), threshold, firsts.count()))
    # only texts with a candidate are made again
    return members, cut(verified(pairs, records(rows.join(ends_of(pairs), "id", "left_semi")), threshold))


def near_pairs(papers: DataFrame, threshold: float = THRESHOLD, method: str = "bands") -> DataFrame:
    """All pairs (article_a, article_b): links between groups expanded to their members, and the pairs within groups."""
    members, links = near_duplicates(papers, threshold, method)
    left = members.select(F.col("grp").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("grp").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("article_a"), F.greatest("x", "y").alias("article_b"))
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("article_a"), F.col("y").alias("article_b"))
    return across.unionByName(within)
