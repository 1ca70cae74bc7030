"""Corpus operators: merging, splitting, filtering, questions and equations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut
from graphloom.functions.columns import equation_tag, tokens

ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")


def folded(text: Column) -> Column:
    """Latin letters without accents."""
    return F.translate(text, *ACCENTS)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last by the order. max_by combines before the shuffle, so hot keys are no burden."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("v")).select(*keys, "v.*")


def split(rows: DataFrame, key: str, parts: dict[str, int]) -> DataFrame:
    """Rows with a part (train, dev, test ...) by percent, chosen by the key alone: the same on each run and size."""
    at = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    out = None
    upto = 0
    for name, share in parts.items():
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return rows.withColumn("part", out)


def in_vocabulary(docs: DataFrame, vocabulary: DataFrame, least: float = 0.2) -> DataFrame:
    """(doc_id, ratio, removed): part of the tokens that are known words of more than two letters; below the least the text is to be removed."""
    t = docs.where("text is not null").select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    known = vocabulary.select("token", F.lit(1).alias("k"))
    good = F.when(F.col("k").isNotNull() & (F.char_length("token") > 2) & F.col("token").rlike(r"^\p{L}+$"), F.col("n")).otherwise(0)
    sums = t.join(known, "token", "left").groupBy("doc_id").agg((F.sum(good) / F.sum("n")).alias("ratio"))
    return sums.withColumn("removed", F.col("ratio") < least)


def questions(docs: DataFrame) -> DataFrame:
    """(doc_id, question): sentences that end with a question mark."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?]*\?"), F.lit(0))).alias("q")).select("doc_id", F.trim("q").alias("question")).where("question <> '?'")


def equations(docs: DataFrame) -> DataFrame:
    """(doc_id, formula, tag): formulas between dollar signs with the placeholder that takes their place."""
    found = F.array_union(F.regexp_extract_all("text", F.lit(r"\$\$[^$]+\$\$"), F.lit(0)), F.regexp_extract_all(F.regexp_replace("text", r"\$\$[^$]+\$\$", " "), F.lit(r"\$[^$]+\$"), F.lit(0)))
    return docs.select("doc_id", F.explode(found).alias("formula")).withColumn("tag", equation_tag(F.col("formula")))


def category_filter(papers: DataFrame, drops: list[str]) -> DataFrame:
    """Papers of arXiv of which some tag is not dropped; other sources pass. papers has source and tags array<struct<term>>."""
    return papers.where((F.col("source") != "arxiv") | F.exists("tags", lambda t: ~t["term"].isin(drops)))


def shuffled_negatives(docs: DataFrame, seed: int = 3) -> DataFrame:
    """(doc_id, tokens, label): each text as it is (1) and with its words in a seeded order (0)."""
    w = docs.where("text is not null").select("doc_id", tokens(F.col("text")).alias("tokens"))
    keyed = F.array_sort(F.transform("tokens", lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col("doc_id"), i).alias("h"), x.alias("x"))))
    return w.select("doc_id", "tokens", F.lit(1).alias("label")).unionByName(w.select("doc_id", F.transform(keyed, lambda s: s["x"]).alias("tokens"), F.lit(0).alias("label")))


def padded(ids: Column, size: int = 150, pad: int = 0) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("bigint"), size)), 1, size)


def encoded(docs: DataFrame, vocabulary: DataFrame, size: int = 150) -> DataFrame:
    """(doc_id, ids): the first tokens as vocabulary ids from 3 (0 pad, 1 unknown, 2 end), padded to the size."""
    at = docs.where("text is not null").select("doc_id", F.posexplode(F.slice(tokens(F.col("text")), 1, size)).alias("i", "token"))
    ids = at.join(vocabulary.select("token", "id"), "token", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("id", F.lit(1)).cast("bigint").alias("v")))).alias("s"))
    return ids.select("doc_id", padded(F.transform("s", lambda x: x["v"]), size).alias("ids"))


def bracket_depths(trees: DataFrame) -> DataFrame:
    """(tree_id, depth, nodes, balanced) of bracketed parse strings: deepest level, number of nodes, whether the brackets match."""
    steps = F.transform(F.regexp_extract_all("tree", F.lit(r"[()]"), F.lit(0)), lambda b: F.when(b == "(", 1).otherwise(-1))
    run = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"), F.lit(0).alias("low")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["top"], s["now"] + x).alias("top"), F.least(s["low"], s["now"] + x).alias("low")))
    return trees.select("tree_id", run.alias("r"), F.size(F.filter(steps, lambda x: x == 1)).alias("nodes")).select("tree_id", F.col("r.top").alias("depth"), "nodes", ((F.col("r.now") == 0) & (F.col("r.low") == 0)).alias("balanced"))


def productions(trees: DataFrame) -> DataFrame:
    """(lhs, rhs): distinct rules of trees given as rows tree_id, node, parent, ord, label."""
    kids = trees.where("parent is not null").groupBy("tree_id", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]).alias("rhs"))
    return kids.join(trees.select("tree_id", F.col("node").alias("parent"), F.col("label").alias("lhs")), ["tree_id", "parent"]).select("lhs", "rhs").distinct()


def roots_and_terminals(rules: DataFrame) -> DataFrame:
    """(symbol, kind): symbols only on the left are roots, only on the right terminals."""
    left, right = rules.select(F.col("lhs").alias("symbol")).distinct(), rules.select(F.explode("rhs").alias("symbol")).distinct()
    return left.join(right, "symbol", "left_anti").withColumn("kind", F.lit("root")).unionByName(right.join(left, "symbol", "left_anti").withColumn("kind", F.lit("terminal")))


def closure(deps: DataFrame, starts: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(sent, token): tokens below the starting ones, level by level. deps has sent, gov, dep."""
    seen = cut(starts.select("sent", "token").distinct())
    edge = seen
    for _ in range(rounds):
        below = deps.select("sent", F.col("gov").alias("token"), "dep").join(edge, ["sent", "token"]).select("sent", F.col("dep").alias("token")).distinct()
        edge = cut(below.join(seen, ["sent", "token"], "left_anti"))
        if edge.isEmpty():
            return seen
        seen = cut(seen.unionByName(edge))
    raise RuntimeError("the tree is deeper than any sentence")


def spans_within(inner: DataFrame, outer: DataFrame, width: int = 64) -> DataFrame:
    """(doc, start, end, chunk_start, chunk_end): the first chunk that contains each span, found by equi-joins on stripes of positions."""
    stripes = outer.select("doc", F.col("start").alias("chunk_start"), F.col("end").alias("chunk_end"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("stripe"))
    hits = inner.withColumn("stripe", F.floor(F.col("start") / width)).join(stripes, ["doc", "stripe"]).where("chunk_start <= start and end <= chunk_end")
    return hits.groupBy("doc", "start", "end").agg(F.min(F.struct("chunk_start", "chunk_end")).alias("c")).select("doc", "start", "end", "c.*")


def representatives(members: DataFrame, limit: int = 80) -> DataFrame:
    """(cluster, name): members joined by ` | `; if that is too long, the first member."""
    g = members.groupBy("cluster").agg(F.sum(F.char_length("name")).alias("n"), F.min("name").alias("first"), F.count("*").alias("k"))
    short = members.join(g.where(F.col("n") <= limit).select("cluster"), "cluster", "left_semi")
    joined = short.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("name"))  # no longer than the limit
    return joined.unionByName(g.where(F.col("n") > limit).select("cluster", F.col("first").alias("name")))


def rank_normalised(values: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Rows with (rank - 1) / (n - 1) within each group, ties by key."""
    w = W.Window.partitionBy(group)
    n = F.count("*").over(w)
    return values.withColumn("v", F.when(n > 1, (F.row_number().over(w.orderBy(value, key)) - 1) / (n - 1)).otherwise(F.lit(0.0)))


def combined(a: DataFrame, b: DataFrame, sign: int = 1, remove: bool = False) -> DataFrame:
    """(key, n) of two dictionaries (key, n): the sums, or differences with sign -1; with `remove` those not above zero are left out."""
    both = a.select("key", F.col("n").alias("x")).join(b.select("key", F.col("n").alias("y")), "key", "full_outer")
    out = both.select("key", (F.coalesce("x", F.lit(0)) + sign * F.coalesce("y", F.lit(0))).alias("n"))
    return out.where("n > 0") if remove else out


def combinations(members: DataFrame, group: str, member: str) -> DataFrame:
    """(combination, n): how many groups have which set of members, written in order with colons. Members are kinds, of which there are few."""
    sets = members.where(F.col(member).isNotNull()).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(member)), ":").alias("combination"))
    return sets.groupBy("combination").agg(F.count("*").alias("n"))


def drawn_query(facts: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(tokens) of n facts (head_name, relation_name, tail_name), drawn by a seeded hash; of a name with alternatives between ` | ` one is taken."""
    slots = ("head_name", "relation_name", "tail_name")
    mark = F.xxhash64(F.lit(seed), *slots)
    one = lambda c, i: F.get(F.split(c, r" \| "), F.pmod(F.xxhash64(F.lit(seed + i), *slots), F.size(F.split(c, r" \| "))).cast("int"))
    some = facts.orderBy(mark, *slots).limit(n)
    return some.select(F.split(F.concat_ws(" ", *[one(c, i) for i, c in enumerate(slots)]), r"\s+").alias("tokens"))
