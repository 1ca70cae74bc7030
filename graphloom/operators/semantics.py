"""Markov-logic induction over parses: parts, count tables, scores of merging and composing, and questions.

parts: part (id), clust, reltype, par (id of the parent part, null for a root), dep (relation to the parent). A part's arguments are its children; an
argument cluster is (clust, dep of the children).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut, numbered
from graphloom.functions.cleaning import node_id
from graphloom.functions.columns import delta, xlogx
from graphloom.operators import kg

# Costs of a parameter and of a conjunction; dependencies that belong to an answer; arguments that stand in for others
PARAM, CONJ = 5.0, 10.0
ALLOWED = ("nn", "nmod", "obl", "amod", "case", "num", "appos")
INSTEAD = {"nsubj": ("nsubj", "nsubjpass"), "dobj": ("dobj", "obj")}
SKIPPED = ("the", "of", "in")


def parts_of(tokens: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts with doc, sent, idx, form, lemma, pos; clusters reltype, clust) of parses: one cluster for each part of speech and lemma, one part for each token with a dependency.

    Of several governors of a token the one of the least index counts; one that has no part itself makes a root.
    """
    tokens = tokens.withColumn("reltype", F.format_string("(%s:%s)", F.col("pos"), F.col("lemma")))
    one = deps.groupBy("doc", "sent", F.col("dep").alias("idx")).agg(F.min(F.struct("gov", "rel")).alias("g")).select("doc", "sent", "idx", "g.gov", F.col("g.rel").alias("dep"))
    nodes = tokens.join(one, ["doc", "sent", "idx"])
    heads = nodes.select("doc", "sent", F.col("idx").alias("gov"), node_id(F.col("doc"), F.col("sent"), F.col("idx")).alias("par"))
    clusters = kg.dense_ids(nodes, "reltype").select(F.col("name").alias("reltype"), F.col("id").alias("clust"))
    rows = nodes.join(heads, ["doc", "sent", "gov"], "left").join(clusters, "reltype")
    part = node_id(F.col("doc"), F.col("sent"), F.col("idx")).alias("part")
    return rows.select(part, "clust", "reltype", "par", F.when(F.col("par").isNotNull(), F.col("dep")).alias("dep"), "doc", "sent", "idx", "form", "lemma", "pos"), clusters


def cluster_name(pos: Column, lemma: Column) -> Column:
    """`(POS:lemma)`, the name of the cluster of a part of speech and lemma."""
    return F.concat(F.lit("("), F.coalesce(pos, F.lit("null")), F.lit(":"), F.coalesce(lemma, F.lit("null")), F.lit(")"))


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The parts of some sentences (doc, sent, tokens, deps); see sentence_parts."""
    sides = []
    for column in (batch.column(2), batch.column(3)):
        number = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        flat = column.flatten()
        sides.append((number, {f.name: pc.struct_field(flat, f.name) for f in flat.type}))
    (own, tokens), (other, deps) = sides
    whole = lambda x: x.cast(pa.int64()).fill_null(-1).to_numpy()
    idx, dep, gov = whole(tokens["idx"]), whole(deps["dep"]), whole(deps["gov"])
    least = min([x.min() for x in (idx, dep, gov) if len(x)], default=0)
    wide = max([x.max() for x in (idx, dep, gov) if len(x)], default=0) - least + 1
    key = lambda number, x: number * wide + (x - least)
    rels = deps["rel"].dictionary_encode()
    code = rels.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    rank = np.empty(len(rels.dictionary) + 1, np.int64)
    rank[-1] = -1
    rank[pc.sort_indices(rels.dictionary).to_numpy()] = np.arange(len(rels.dictionary))
    # the governor of the least index of each token
    dkey = key(other, dep)
    order = np.lexsort((rank[code], gov, dkey)) if len(dkey) else np.empty(0, np.int64)
    order = order[np.r_[True, dkey[order][1:] != dkey[order][:-1]]] if len(order) else order
    find = lambda keys, x: np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
    tkey = key(own, idx)
    at = find(dkey[order], tkey)
    node = np.flatnonzero(dkey[order][at] == tkey) if len(order) else np.empty(0, np.int64)  # tokens with a dependency
    link = order[at[node]] if len(order) else node
    above = key(other[link], gov[link])
    by_key = np.argsort(tkey[node], kind="stable")
    place = find(tkey[node][by_key], above)
    head = by_key[place] if len(node) else node
    some = tkey[node][head] == above if len(node) else np.empty(0, bool)
    # how many children of one relation the parent has, at the first of them
    group = (head * (len(rank) + 1) + code[link] + 1)[some]
    _, first, size = np.unique(group, return_index=True, return_counts=True)
    k = np.zeros(len(node), np.int64)
    k[np.flatnonzero(some)[first]] = size
    up = pa.array(node[head] if len(node) else node, mask=~some)
    take = lambda x, i: x.take(pa.array(i))
    columns = [take(batch.column(i), own[node]) for i in (0, 1)] + [take(tokens[n], node) for n in ("idx", "form", "lemma", "pos")]
    columns += [tokens[n].take(up) for n in ("idx", "lemma", "pos")] + [deps["rel"].take(pa.array(link, mask=~some)), pa.array(k, mask=k == 0)]
    return pa.RecordBatch.from_arrays(columns, ["doc", "sent", "idx", "form", "lemma", "pos", "head_idx", "head_lemma", "head_pos", "dep", "k"])


def sentence_parts(sentences: DataFrame) -> DataFrame:
    """The parts of `parts_of` with what tells their parent's cluster, for sentences (doc, sent, tokens, deps), one row each, so that nothing is shuffled.

    tokens array<struct<idx, form, lemma, pos>>, deps array<struct<rel, gov, dep>>. Rows: part, reltype, par, dep, head (reltype of the parent), k (at the first
    child of a relation: how many the parent has of it), doc, sent, idx, form, lemma, pos, head_lemma, head_pos.
    """
    kinds = dict(sentences.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield _linked(batch.slice(i, 500))

    idx = sentences.schema["tokens"].dataType.elementType["idx"].dataType.simpleString()
    out = sentences.select("doc", "sent", "tokens", "deps").mapInArrow(run, f"doc {kinds['doc']}, sent {kinds['sent']}, idx {idx}, form string, lemma string, pos string, head_idx {idx}, head_lemma string, head_pos string, dep string, k bigint")
    below = F.col("head_idx").isNotNull()
    return out.select(
        node_id(F.col("doc"), F.col("sent"), F.col("idx")).alias("part"),
        cluster_name(F.col("pos"), F.col("lemma")).alias("reltype"),
        F.when(below, node_id(F.col("doc"), F.col("sent"), F.col("head_idx"))).alias("par"),
        "dep",
        F.when(below, cluster_name(F.col("head_pos"), F.col("head_lemma"))).alias("head"),
        "k", "doc", "sent", "idx", "form", "lemma", "pos", "head_lemma", "head_pos",
    )


def sentence_tables(parts: DataFrame, few: bool = False) -> dict[str, DataFrame]:
    """The count tables of `tables` for sentence parts with clust and head, the cluster of the parent (null for a root).

    Each table is a pass over the sentences that shuffles only its own counts; few clusters are counted once, for all tables, and their links kept.
    """
    links = parts.select("head", "dep", "clust", "reltype", "k", F.lit(1).alias("n"), F.col("k").isNotNull().cast("int").alias("p"))
    if few:
        links = cut(links.groupBy("head", "dep", "clust", "reltype", "k").agg(F.sum("n").alias("n"), F.sum("p").alias("p")))
    below, n = links.where("head is not null"), F.sum("n").alias("n")
    return {
        "totals": links.groupBy("clust").agg(n),
        "reltypes": links.groupBy("clust", "reltype").agg(n),
        "roots": links.where("head is null").groupBy("clust").agg(n),
        "children": below.groupBy(F.col("head").alias("clust"), F.col("dep").alias("arg"), F.col("clust").alias("child")).agg(n),
        "args": below.groupBy(F.col("head").alias("clust"), F.col("dep").alias("arg")).agg(F.sum("n").alias("t"), F.sum("p").alias("p")),
        "nums": links.where("k is not null").groupBy(F.col("head").alias("clust"), F.col("dep").alias("arg"), "k").agg(n),
    }


def tables(parts: DataFrame) -> dict[str, DataFrame]:
    """Count tables: totals (clust, n), reltypes (clust, reltype, n), roots (clust, n), children (clust, arg, child, n), args (clust, arg, t arguments, p parts that have some), nums (clust, arg, k, n parts with k arguments)."""
    heads = parts.select(F.col("part").alias("par"), F.col("clust").alias("head"))
    links = cut(parts.where("par is not null").select("par", "dep", F.col("clust").alias("child")).join(heads, "par").select(F.col("head").alias("clust"), F.col("dep").alias("arg"), "child", "par"))
    per_part = cut(links.groupBy("clust", "arg", "par").agg(F.count("*").alias("k")))
    count = F.count("*").alias("n")
    return {
        "totals": parts.groupBy("clust").agg(count),
        "reltypes": parts.groupBy("clust", "reltype").agg(count),
        "roots": parts.where("par is null").groupBy("clust").agg(count),
        "children": links.groupBy("clust", "arg", "child").agg(count),
        "args": per_part.groupBy("clust", "arg").agg(F.sum("k").alias("t"), F.count("*").alias("p")),
        "nums": per_part.groupBy("clust", "arg", "k").agg(count),
    }


def with_ids(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """A count table with the ids of clusters in place of their names; names has clust, one row for each or more."""
    ids = cut(kg.dense_ids(names, "clust"))
    for c in columns:
        table = table.join(ids.select(F.col("name").alias(c), F.col("id").alias("_id")), c).drop(c).withColumnRenamed("_id", c)
    return table


def _sides(table: DataFrame, keys: list[str], value: str = "n", more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    side = lambda i: table.select(F.col("clust").alias(f"c{i}"), *keys, *[F.col(m).alias(f"{m}{i}") for m in (value, *more)])
    return side(1), side(2)


def merge_scores(tab: dict[str, DataFrame], conjunctions: DataFrame | None = None, least: int = 10) -> DataFrame:
    """(c1, c2, score), c1 < c2, of the pairs of clusters with at least `least` distinct neighbours in common, a neighbour being an argument with its child or a parent with its argument.

    score = - CONJ for each conjunction of the two - delta(totals) + (delta + PARAM) for each shared type, for common roots and for each shared parent
    argument + the best alignment of the arguments: each argument of c2 with the one of c1 that gains most, or none. conjunctions: a, b, n with a < b.
    """
    neigh = tab["children"].select("clust", F.concat_ws("|", F.lit("c"), "arg", "child").alias("v")).unionByName(tab["children"].select(F.col("child").alias("clust"), F.concat_ws("|", F.lit("p"), "clust", "arg").alias("v")))
    neigh = neigh.distinct()
    pairs = neigh.select(F.col("clust").alias("c1"), "v").join(neigh.select(F.col("clust").alias("c2"), "v"), "v").where("c1 < c2").groupBy("c1", "c2").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    n1, n2 = _sides(tab["totals"], [])
    pairs = cut(pairs.join(n1, "c1").join(n2, "c2").select("c1", "c2", F.col("n1").alias("t1"), F.col("n2").alias("t2")))

    def common(table: DataFrame, keys: list[str], name: str) -> DataFrame:
        a, b = _sides(table, keys)
        return a.join(b, keys).where("c1 < c2").groupBy("c1", "c2").agg(F.sum(delta(F.col("n1"), F.col("n2")) + PARAM).alias(name))

    a, b = _sides(tab["roots"], [])
    rooted = pairs.select("c1", "c2").join(a, "c1").join(b, "c2").select("c1", "c2", (delta(F.col("n1"), F.col("n2")) + PARAM).alias("roots"))
    up = tab["children"].select(F.col("child").alias("clust"), F.col("clust").alias("head"), "arg", "n")
    score = -delta(F.col("t1"), F.col("t2"))
    out = pairs
    for df, name in ((common(tab["reltypes"], ["reltype"], "types"), "types"), (rooted, "roots"), (common(up, ["head", "arg"], "parents"), "parents"), (alignments(tab, pairs), "aligned")):
        out = out.join(df.select("c1", "c2", name), ["c1", "c2"], "left")
        score = score + F.coalesce(name, F.lit(0.0))
    if conjunctions is not None:
        out = out.join(conjunctions.select(F.col("a").alias("c1"), F.col("b").alias("c2"), F.col("n").alias("conj")), ["c1", "c2"], "left")
        score = score - CONJ * F.coalesce("conj", F.lit(0))
    return out.select("c1", "c2", score.alias("score"))


def alignments(tab: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """(c1, c2, aligned) for pairs (c1, c2, t1, t2): what the arguments add when two clusters merge, each argument of the one with fewer going to the best of the other or staying alone."""
    args = tab["args"]
    size = args.groupBy("clust").agg(F.count("*").alias("n"))
    sized = pairs.join(size.select(F.col("clust").alias("c1"), F.col("n").alias("s1")), "c1", "left").join(size.select(F.col("clust").alias("c2"), F.col("n").alias("s2")), "c2", "left")
    swap = F.coalesce("s2", F.lit(0)) > F.coalesce("s1", F.lit(0))
    turned = sized.select("c1", "c2", F.when(swap, F.col("c2")).otherwise(F.col("c1")).alias("x"), F.when(swap, F.col("c1")).otherwise(F.col("c2")).alias("y"), F.when(swap, F.col("t2")).otherwise(F.col("t1")).alias("nx"), F.when(swap, F.col("t1")).otherwise(F.col("t2")).alias("ny"))
    both = F.col("nx") + F.col("ny")
    side = lambda c, a, p, t: args.select(F.col("clust").alias(c), F.col("arg").alias(a), F.col("p").alias(p), F.col("t").alias(t))
    ax, ay = turned.join(side("x", "ax", "px", "tx"), "x"), turned.join(side("y", "ay", "py", "ty"), "y")
    alone_x = ax.groupBy("c1", "c2").agg(F.sum(xlogx(both - F.col("px")) - xlogx(both) - xlogx(F.col("nx") - F.col("px")) + xlogx(F.col("nx"))).alias("gx"))
    alone_y = ay.groupBy("c1", "c2").agg(F.sum(xlogx(both - F.col("py")) - xlogx(both) - xlogx(F.col("ny") - F.col("py")) + xlogx(F.col("ny"))).alias("gy"))
    grid = ay.join(side("x", "ax", "px", "tx"), "x").select("c1", "c2", "x", "y", "nx", "ny", "ax", "ay", "px", "py", "tx", "ty")

    def gain(table: DataFrame, key: str, name: str) -> DataFrame:
        a = table.select(F.col("clust").alias("x"), F.col("arg").alias("ax"), key, F.col("n").alias("m1"))
        b = table.select(F.col("clust").alias("y"), F.col("arg").alias("ay"), key, F.col("n").alias("m2"))
        met = grid.select("x", "y", "ax", "ay").distinct().join(a, ["x", "ax"]).join(b, ["y", "ay", key])
        return met.groupBy("x", "y", "ax", "ay").agg(F.sum(delta(F.col("m1"), F.col("m2")) + PARAM).alias(name))

    grid = grid.join(gain(tab["nums"], "k", "by_num"), ["x", "y", "ax", "ay"], "left").join(gain(tab["children"], "child", "by_child"), ["x", "y", "ax", "ay"], "left")
    same = F.when(F.col("ax") == F.col("ay"), delta(F.col("tx"), F.col("ty")) + PARAM).otherwise(0.0)  # the types of the arguments
    together = xlogx(both - F.col("px") - F.col("py")) - xlogx(both - F.col("px")) + 2 * xlogx(F.col("tx")) - 2 * xlogx(F.col("tx") + F.col("ty"))
    together = together + F.coalesce("by_num", F.lit(0.0)) + F.coalesce("by_child", F.lit(0.0)) + same
    apart = xlogx(both - F.col("py")) - xlogx(both) - 2 * xlogx(F.col("ty"))
    best = grid.withColumn("more", together - apart).groupBy("c1", "c2", "ay").agg(F.greatest(F.max("more"), F.lit(0.0)).alias("more")).groupBy("c1", "c2").agg(F.sum("more").alias("best"))
    out = pairs.select("c1", "c2").join(alone_x, ["c1", "c2"], "left").join(alone_y, ["c1", "c2"], "left").join(best, ["c1", "c2"], "left")
    return out.select("c1", "c2", (F.coalesce("gx", F.lit(0.0)) + F.coalesce("gy", F.lit(0.0)) + F.coalesce("best", F.lit(0.0))).alias("aligned"))


def ordered_args(tab: dict[str, DataFrame]) -> DataFrame:
    """(clust, args): the argument clusters of each cluster, the largest first, the later name first among equals."""
    kept = tab["args"].groupBy("clust").agg(F.collect_list(F.struct("t", "arg")).alias("a"))  # a cluster has as many arguments as there are dependencies
    return kept.select("clust", F.transform(F.reverse(F.array_sort("a")), lambda x: x["arg"]).alias("args"))


def numbered_args(parts: DataFrame) -> DataFrame:
    """(clust, args) of `ordered_args` for sentence parts, with the id of the cluster in the order of all names; the sentences are read once and nothing is joined."""
    own = F.struct(F.col("reltype").alias("clust"), F.lit(None).cast("string").alias("arg"), F.lit(False).alias("below"))
    up = F.struct(F.col("head").alias("clust"), F.col("dep").alias("arg"), F.lit(True).alias("below"))
    each = parts.select(F.explode(F.when(F.col("head").isNull(), F.array(own)).otherwise(F.array(own, up))).alias("e")).groupBy("e.clust", "e.arg", "e.below").agg(F.count("*").alias("t"))
    kept = each.groupBy("clust").agg(F.collect_list(F.when(F.col("below"), F.struct("t", "arg"))).alias("a"))  # a cluster has as many arguments as there are dependencies
    ordered = kept.select("clust", F.transform(F.reverse(F.array_sort("a")), lambda x: x["arg"]).alias("args"))
    return numbered(ordered, ["clust"], "id").where(F.size("args") > 0).select(F.col("id").alias("clust"), "args")


def argument_scores(parts: DataFrame, tab: dict[str, DataFrame]) -> DataFrame:
    """(clust, a1, a2, score) for the pairs of arguments of each cluster, a1 < a2: what merging them changes in the likelihood, less the parameters."""
    heads = parts.select(F.col("part").alias("par"), F.col("clust").alias("head"))
    each = parts.where("par is not null").join(heads, "par").groupBy(F.col("head").alias("clust"), F.col("dep").alias("arg"), "par").agg(F.count("*").alias("k"))
    each = cut(each)
    grid = tab["args"].select("clust", F.col("arg").alias("a1"), F.col("t").alias("t1"), F.col("p").alias("p1")).join(tab["args"].select("clust", F.col("arg").alias("a2"), F.col("t").alias("t2"), F.col("p").alias("p2")), "clust").where("a1 < a2")
    side = lambda i: each.select("clust", F.col("arg").alias(f"a{i}"), "par", F.col("k").alias(f"k{i}"))
    # parts that have both arguments leave their old numbers and get the sum
    both = side(1).join(side(2), ["clust", "par"]).where("a1 < a2")
    moves = F.explode(F.array(F.struct(F.col("k1").alias("k"), F.lit(-1).alias("m")), F.struct(F.col("k2").alias("k"), F.lit(-1).alias("m")), F.struct((F.col("k1") + F.col("k2")).alias("k"), F.lit(1).alias("m"))))
    moved = both.select("clust", "a1", "a2", moves.alias("v")).groupBy("clust", "a1", "a2", F.col("v.k").alias("k")).agg(F.sum("v.m").alias("m"))
    nums = tab["nums"]
    keys = ["clust", "a1", "a2"]
    kept = [grid.select(*keys).join(nums.select("clust", F.col("arg").alias(a), "k", F.col("n").alias("m")), ["clust", a]).select(*keys, "k", "m") for a in ("a1", "a2")]
    old = kept[0].unionByName(kept[1])
    before = old.groupBy(*keys).agg(F.sum(xlogx(F.col("m"))).alias("x0"), F.count("*").alias("q0"))
    after = old.unionByName(moved.select(*keys, "k", "m")).groupBy(*keys, "k").agg(F.sum("m").alias("m")).where("m > 0").groupBy(*keys).agg(F.sum(xlogx(F.col("m"))).alias("x1"), F.count("*").alias("q1"))
    shared = both.groupBy(*keys).agg(F.count("*").alias("c"))
    kids = tab["children"]
    kid = kids.select("clust", F.col("arg").alias("a1"), "child", F.col("n").alias("m1")).join(kids.select("clust", F.col("arg").alias("a2"), "child", F.col("n").alias("m2")), ["clust", "child"]).where("a1 < a2")
    kid = kid.groupBy(*keys).agg(F.sum(delta(F.col("m1"), F.col("m2")) + PARAM).alias("kid"))
    rows = grid.join(tab["totals"], "clust").join(before, keys).join(after, keys).join(shared, keys, "left").join(kid, keys, "left")
    union = F.col("p1") + F.col("p2") - F.coalesce("c", F.lit(0))
    score = xlogx(F.col("n")) + xlogx(F.col("n") - union) - xlogx(F.col("n") - F.col("p1")) - xlogx(F.col("n") - F.col("p2")) - 2 * delta(F.col("t1"), F.col("t2"))
    return rows.select(*keys, (score + F.col("x1") - F.col("x0") + PARAM * (F.col("q0") - F.col("q1")) + F.coalesce("kid", F.lit(0.0))).alias("score"))


def merged_args(scores: DataFrame, tab: dict[str, DataFrame]) -> DataFrame:
    """(clust, arg, merged): the largest arguments first, each goes to the kept one of the best positive score or is kept itself.

    Scores are those of the arguments as they came; a merged one is not scored again.
    """
    order = ordered_args(tab)
    edges = scores.where("score > 0").select("clust", F.struct("a1", "a2", "score").alias("e")).groupBy("clust").agg(F.collect_list("e").alias("es"))
    rows = order.join(edges, "clust", "left")

    def run(batches):
        for pdf in batches:
            out = []
            for clust, args, es in zip(pdf["clust"], pdf["args"], pdf["es"]):
                gain = {}
                for e in es if es is not None else []:
                    gain[e["a1"], e["a2"]] = gain[e["a2"], e["a1"]] = e["score"]
                kept: list[str] = []
                for a in args:
                    best = max((k for k in kept if (k, a) in gain), key=lambda k: (gain[k, a], k), default=None)
                    if best is None:
                        kept.append(a)
                    out.append((clust, a, best or a))
            yield pd.DataFrame(out, columns=["clust", "arg", "merged"])

    return rows.mapInPandas(run, "clust bigint, arg string, merged string")


def merged(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """parts with clusters relabelled by (clust, merged); those without a label stay."""
    return parts.join(labels.select("clust", "merged"), "clust", "left").withColumn("clust", F.coalesce("merged", "clust")).select(*parts.columns)


def composed(parts: DataFrame, head: int, arg: int, new: int) -> DataFrame:
    """parts after the parts of cluster `arg` below parts of cluster `head` became one with them, in the cluster `new`.

    A head takes its first such child; its type is written with the child's after the relation, and the child's children become its own.
    """
    heads = parts.where(F.col("clust") == head).select(F.col("part").alias("par"), F.col("reltype").alias("hr"))
    taken = parts.where(F.col("clust") == arg).join(heads, "par").groupBy("par", "hr").agg(F.min(F.struct("part", "dep", "reltype")).alias("c"))
    taken = cut(taken.select("par", F.col("c.part").alias("child"), F.format_string("%s (%s:%s)", "hr", F.col("c.dep"), F.col("c.reltype")).alias("type")))
    rest = parts.join(taken.select(F.col("child").alias("part")), "part", "left_anti")
    up = taken.select(F.col("child").alias("par"), F.col("par").alias("above"))
    rest = rest.join(up, "par", "left").withColumn("par", F.coalesce("above", "par")).drop("above")
    grown = taken.select(F.col("par").alias("part"), "type")
    rest = rest.join(grown, "part", "left").withColumn("clust", F.when(F.col("type").isNotNull(), F.lit(new)).otherwise(F.col("clust")).cast("bigint"))
    return rest.withColumn("reltype", F.coalesce("type", "reltype")).select(*parts.columns)


def likelihood(parts: DataFrame) -> float:
    """Logarithm of the likelihood of the parts under their clusters, less PARAM for each count that is not zero.

    Types given the cluster, roots, and for each argument cluster how many of it a part has, of which relations and of which clusters.
    """
    tab = tables(parts)
    total = lambda df, c: float(df.agg(F.sum(xlogx(F.col(c)))).first()[0] or 0.0)
    size = lambda df: df.count()
    args = cut(tab["args"].join(tab["totals"], "clust"))
    free = float(args.agg(F.sum(xlogx(F.col("n") - F.col("p")) - xlogx(F.col("n")) - 2 * xlogx(F.col("t")))).first()[0] or 0.0)
    roots = tab["roots"].agg(F.sum(xlogx(F.col("n"))), xlogx(F.sum("n"))).first()
    value = total(tab["reltypes"], "n") - total(tab["totals"], "n") + total(tab["nums"], "n") + total(tab["children"], "n") + total(tab["args"], "t") + free + (roots[0] or 0.0) - (roots[1] or 0.0)
    return value - PARAM * (size(tab["reltypes"]) + size(tab["roots"]) + size(tab["nums"]) + size(tab["children"]) + size(tab["args"]))


def compose_score(parts: DataFrame, head: int, arg: int, new: int) -> float:
    """What composing changes in the likelihood; -10000 where no part of `arg` stands below one of `head`."""
    heads = parts.where(F.col("clust") == head).select(F.col("part").alias("par"))
    if parts.where(F.col("clust") == arg).join(heads, "par", "left_semi").isEmpty():
        return -10000.0
    return likelihood(cut(composed(parts, head, arg, new))) - likelihood(parts)


def questions_asked(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """(q, rel, dep, clust): the clusters that the words of a question's argument (q, rel, dep, arg) name; the, of and in do not count.

    A question with a word that no part has is dropped.
    """
    words = questions.select("q", "rel", "dep", F.explode(F.split(F.lower("arg"), r"\s+")).alias("lemma")).where(~F.col("lemma").isin(*SKIPPED, ""))
    known = parts.select("lemma", "clust").distinct()
    found = words.join(known, "lemma", "left")
    bad = found.where("clust is null").select("q").distinct()
    return found.join(bad, "q", "left_anti").select("q", "rel", "dep", "clust").distinct()


def answers(questions: DataFrame, parts: DataFrame) -> DataFrame:
    """(q, part, answer): answers to questions (q, rel, dep, arg), asked by the lemma of a verb, the relation of the known argument, and its words.

    A part of the verb's cluster answers if a child by that relation, or one of the child's conjuncts or appositions, is of a cluster the words name, it has no child by
    `neg`, and it has a child by the opposite relation; that child's words with those of its modifiers are the answer. Passive subjects and `obj` stand in for
    missing ones.
    """
    asked = questions_asked(questions, parts)
    dep = lambda c: F.when(F.col(c).startswith("nsubj"), "nsubj").when(F.col(c).contains("obj"), "dobj").otherwise(F.col(c))
    asked = asked.select("q", F.lower("rel").alias("rel"), dep("dep").alias("known"), F.col("clust").alias("want"))
    asked = asked.withColumn("open", F.when(F.col("known") == "nsubj", "dobj").otherwise("nsubj"))
    verbs = parts.where(F.col("pos").startswith("V")).select(F.col("part").alias("verb"), F.col("lemma").alias("rel"))
    kids = parts.where("par is not null").select(F.col("par").alias("verb"), F.col("part").alias("child"), dep("dep").alias("role"), F.col("dep").alias("raw"), F.col("clust").alias("c"))
    denied = kids.where("raw = 'neg'").select("verb").distinct()
    beside = parts.where("(dep like 'conj%' and dep <> 'conj_negcc') or dep = 'appos'").select(F.col("par").alias("child"), F.col("clust").alias("c2"))
    heads = kids.select("verb", "role", F.col("c").alias("want")).unionByName(kids.join(beside, "child").select("verb", "role", F.col("c2").alias("want"))).distinct()
    hit = asked.join(verbs, "rel").join(denied, "verb", "left_anti").join(heads.withColumnRenamed("role", "known"), ["verb", "known", "want"], "left_semi").select("q", "verb", "open").distinct()
    found = cut(hit.join(kids.select("verb", F.col("role").alias("open"), "child"), ["verb", "open"]).select("q", F.col("child").alias("part")).distinct())
    below = found.select("part", F.col("part").alias("top")).distinct()
    whole = below
    links = parts.where(F.col("dep").isin(*ALLOWED)).select(F.col("par").alias("part"), F.col("part").alias("next"))
    for _ in range(64):  # modifiers of modifiers
        below = cut(below.join(links, "part").select(F.col("next").alias("part"), "top"))
        if below.isEmpty():
            break
        whole = cut(whole.unionByName(below))
    text = whole.distinct().join(parts.select("part", "idx", "form"), "part").groupBy("top").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "form"))), lambda x: x["form"]), " ").alias("answer"))
    return found.join(text, F.col("part") == F.col("top")).select("q", "part", "answer")
