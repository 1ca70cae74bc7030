"""Constituency trees in bracket notation: node tables, actions, grammars, hypotheses and training rows.

A tree is `(LABEL child ...)`, a child being a tree or a word. Strings whose brackets do not match, empty and null ones have no
nodes and no actions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.operators import corpus, kg

Tree = tuple[str, list]


def parse(text: str | None) -> Tree | None:
    """(label, children) of a bracketed string, children being trees or words."""
    if not text:
        return None
    stack: list[Tree] = []
    root = None
    for token in text.replace("(", " ( ").replace(")", " ) ").split():
        if root is not None:
            return None  # something follows the tree
        if token == "(":
            stack.append(("", []))
        elif not stack:
            return None
        elif token == ")":
            done = stack.pop()
            if not done[0]:
                return None
            if stack:
                stack[-1][1].append(done)
            else:
                root = done
        elif not stack[-1][0] and not stack[-1][1]:
            stack[-1] = (token, [])
        else:
            stack[-1][1].append(token)
    return root


def written(tree: Tree | str) -> str:
    """The bracketed string of a tree, with single spaces."""
    return tree if isinstance(tree, str) else f"({' '.join([tree[0], *map(written, tree[1])])})"


def walk(tree: Tree) -> Iterator[tuple[int, int | None, int, int, str, bool]]:
    """(node, parent, ord, depth, label, word) of all nodes, parents before children, numbered from 0."""
    count = 0
    todo = [(tree, None, 0, 0)]
    while todo:
        node, parent, order, depth = todo.pop()
        here = count
        count += 1
        yield here, parent, order, depth, node if isinstance(node, str) else node[0], isinstance(node, str)
        if not isinstance(node, str):
            todo += [(c, here, i, depth + 1) for i, c in reversed(list(enumerate(node[1])))]


def rule(label: str, children: list) -> str:
    """The production of a node; words count as `*`."""
    return f"{label} -> {' '.join('*' if isinstance(c, str) else c[0] for c in children)}"


def action_list(tree: Tree) -> list[str]:
    """What builds the tree from left to right: `apply RULE` for a node, `word WORD` for a word, `reduce` when a node is whole."""
    out: list[str] = []
    todo: list = [tree]
    while todo:
        node = todo.pop()
        if node is None:
            out.append("reduce")
        elif isinstance(node, str):
            out.append(f"word {node}")
        else:
            out.append(f"apply {rule(*node)}")
            todo += [None, *reversed(node[1])]
    return out


def replay(actions: list[str]) -> tuple[str | None, str | None]:
    """(tree, frontier) after the actions: the bracketed string once the tree is whole, else what must come next: a label, `*` or `reduce`.

    (None, None) for actions that do not fit.
    """
    stack: list[tuple[str, list[str], list]] = []  # label, what is expected, what is there
    for a in actions:
        if a == "reduce":
            if not stack or stack[-1][1]:
                return None, None
            label, _, children = stack.pop()
            if not stack:
                return (written((label, children)), None) if a is actions[-1] else (None, None)
            stack[-1][2].append((label, children))
            continue
        kind, _, rest = a.partition(" ")
        want = stack[-1][1][:1] if stack else [rest.split(" -> ")[0]]
        if kind == "word":
            if want != ["*"]:
                return None, None
            stack[-1][1].pop(0)
            stack[-1][2].append(rest)
        else:
            label, _, right = rest.partition(" -> ")
            if want != [label]:
                return None, None
            if stack:
                stack[-1][1].pop(0)
            stack.append((label, right.split(), []))
    if not stack:
        return None, None
    return None, stack[-1][1][0] if stack[-1][1] else "reduce"


ROWS = 50_000  # node rows of one batch, beyond which only the nodes of a single tree go


def nodes(trees: DataFrame) -> DataFrame:
    """(tree_id, node, parent, ord, depth, label, word) of trees (tree_id, tree)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda rows: pd.DataFrame(rows, columns=["tree_id", "node", "parent", "ord", "depth", "label", "word"]).astype({"parent": "Int64"})
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["tree_id"], pdf["tree"]):
                if t := parse(text):
                    rows += [(i, *n) for n in walk(t)]
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
            yield table(rows)

    return trees.select("tree_id", "tree").mapInPandas(run, "tree_id bigint, node int, parent int, ord int, depth int, label string, word boolean")


def shape(rows: Iterable[tuple]) -> tuple[int, int, int, str]:
    """(nodes, leaves, depth, sentence) of the node rows of one tree, in their order."""
    n = deepest = 0
    words = []
    for _, _, _, depth, label, word in rows:
        n, deepest = n + 1, max(deepest, depth)
        if word:
            words.append(label)
    return n, len(words), deepest, " ".join(words) if words else "<None>"


def is_sane(rows: Iterable[tuple]) -> bool:
    """`sane` for the node rows of one tree."""
    here, kids, roots = set(), {}, 0
    for node, parent, order, *_ in rows:
        here.add(node)
        if parent is None:
            roots += 1
        elif not parent < node:
            return False
        else:
            kids.setdefault(parent, []).append(order)
    return roots == 1 and all(p in here and sorted(o) == list(range(len(o))) for p, o in kids.items())


def _each(trees: DataFrame, of: Callable[[Iterator[tuple]], tuple], names: list[str], types: str) -> DataFrame:
    """tree_id with values of the node rows of each tree. A tree is one row, so its nodes need no shuffle and no table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                rows = [(i, *of(walk(t))) for i, text in zip(part["tree_id"], part["tree"]) if (t := parse(text))]
                yield pd.DataFrame(rows, columns=["tree_id", *names])

    return trees.select("tree_id", "tree").mapInPandas(run, f"tree_id bigint, {types}")


def shapes_of(trees: DataFrame) -> DataFrame:
    """`shapes` of trees (tree_id, tree), a row for each."""
    return _each(trees, shape, ["nodes", "leaves", "depth", "sentence"], "nodes bigint, leaves bigint, depth int, sentence string")


def sane_of(trees: DataFrame) -> DataFrame:
    """`sane` of trees (tree_id, tree), a row for each."""
    return _each(trees, lambda rows: (is_sane(rows),), ["sane"], "sane boolean")


def actions(trees: DataFrame) -> DataFrame:
    """(tree_id, actions) of trees (tree_id, tree)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, action_list(t)) for i, text in zip(pdf["tree_id"], pdf["tree"]) if (t := parse(text))]
            yield pd.DataFrame(rows, columns=["tree_id", "actions"])

    return trees.select("tree_id", "tree").mapInPandas(run, "tree_id bigint, actions array<string>")


def replayed(hypotheses: DataFrame) -> DataFrame:
    """(hyp, tree, frontier) of hypotheses (hyp, actions): the tree once it is whole, else what must come next; both null where actions do not fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [replay(list(a)) if a is not None else (None, None) for a in pdf["actions"]]
            yield pd.DataFrame({"hyp": pdf["hyp"], "tree": [d[0] for d in done], "frontier": [d[1] for d in done]})

    return hypotheses.select("hyp", "actions").mapInPandas(run, "hyp bigint, tree string, frontier string")


def shapes(table: DataFrame) -> DataFrame:
    """(tree_id, nodes, leaves, depth, sentence) of a node table; the sentence of a tree without words is `<None>`."""
    leaf = F.when(F.col("word"), F.struct("node", "label"))
    g = table.groupBy("tree_id").agg(F.count("*").alias("nodes"), F.count_if("word").alias("leaves"), F.max("depth").alias("depth"), F.array_sort(F.collect_list(leaf)).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["label"]), " ")
    return g.select("tree_id", "nodes", "leaves", "depth", F.when(F.size("w") == 0, "<None>").otherwise(text).alias("sentence"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tree_id, equal): whether two tables (tree_id, tree) hold the same tree, whatever the white space; false where one side is missing or no tree."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r" ?([()]) ?", "$1")
    both = a.select("tree_id", plain(F.col("tree")).alias("x")).join(b.select("tree_id", plain(F.col("tree")).alias("y")), "tree_id", "full_outer")
    return both.select("tree_id", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("equal"))


def grammar(built: DataFrame) -> DataFrame:
    """(rule, lhs, rhs, id) of all productions in actions, numbered in their order from 0."""
    rules = built.select(F.explode("actions").alias("a")).where(F.col("a").startswith("apply ")).select(F.expr("substr(a, 7)").alias("rule")).distinct()
    ids = kg.dense_ids(rules, "rule")
    side = F.split("name", " -> ", 2)
    return ids.select(F.col("name").alias("rule"), side[0].alias("lhs"), F.filter(F.split(side[1], " "), lambda x: x != "").alias("rhs"), "id")


def types(rules: DataFrame) -> DataFrame:
    """(type, id, kind) of the symbols of a grammar: `terminal` if only words stand below it, `composite` otherwise; numbered in their order."""
    kind = rules.groupBy(F.col("lhs").alias("name")).agg(F.bool_and(F.forall("rhs", lambda x: x == "*")).alias("t"))
    return kg.dense_ids(kind, "name").join(kind, "name").select(F.col("name").alias("type"), "id", F.when(F.col("t"), "terminal").otherwise("composite").alias("kind"))


def continuations(fronts: DataFrame, rules: DataFrame, words: DataFrame) -> DataFrame:
    """(hyp, action): everything that may come next for (hyp, frontier): the rules of a label, the words of `*`, or reduce."""
    apply = fronts.join(rules.select(F.col("lhs").alias("frontier"), "rule"), "frontier").select("hyp", F.concat(F.lit("apply "), "rule").alias("action"))
    word = fronts.where("frontier = '*'").join(words.select(F.lit("*").alias("frontier"), "word").distinct(), "frontier").select("hyp", F.concat(F.lit("word "), "word").alias("action"))
    return apply.unionByName(word).unionByName(fronts.where("frontier = 'reduce'").select("hyp", F.lit("reduce").alias("action")))


def beam(hypotheses: DataFrame, steps: DataFrame, k: int) -> DataFrame:
    """(sample, actions, score): the k best extensions of each sample by one step.

    hypotheses has sample, hyp, actions, score; steps has sample, hyp, action, score of that action. Ties go by the actions.
    """
    longer = hypotheses.join(steps.withColumnRenamed("score", "gain"), ["sample", "hyp"]).select("sample", F.concat("actions", F.array("action")).alias("actions"), (F.col("score") + F.col("gain")).alias("score"))
    return longer.withColumn("n", F.row_number().over(W.Window.partitionBy("sample").orderBy(F.desc("score"), "actions"))).where(F.col("n") <= k).drop("n")


def sane(table: DataFrame) -> DataFrame:
    """(tree_id, sane): one root, every other node with a parent above it, and children numbered without gaps."""
    kids = table.where("parent is not null").groupBy("tree_id", "parent").agg(F.count("*").alias("n"), F.max("ord").alias("last"), F.count_distinct("ord").alias("d"))
    lost = kids.join(table.select("tree_id", F.col("node").alias("parent")), ["tree_id", "parent"], "left_anti").select("tree_id")
    bad = kids.where("n <> last + 1 or n <> d").select("tree_id").unionByName(lost).distinct().withColumn("bad", F.lit(True))
    ends = table.groupBy("tree_id").agg((F.count_if(F.col("parent").isNull()) == 1).alias("one"), F.bool_and(F.col("parent").isNull() | (F.col("parent") < F.col("node"))).alias("below"))
    return ends.join(bad, "tree_id", "left").select("tree_id", (F.col("one") & F.col("below") & F.col("bad").isNull()).alias("sane"))


def steps(built: DataFrame, sources: DataFrame, rules: DataFrame, vocabulary: DataFrame, most: int = 100) -> DataFrame:
    """(tree_id, step, rule_id, token_id, copied, copy_at) of each action of trees with at most `most` actions.

    rule_id is of the grammar, token_id of the vocabulary (token, id; 1 for unknown words); copied tells whether the word stands in
    the source (tree_id, tokens), copy_at where, from 0. What does not apply is null, reduce has none.
    """
    each = built.where(F.size("actions") <= most).select("tree_id", F.posexplode("actions").alias("step", "a"))
    each = each.select("tree_id", "step", F.when(F.col("a").startswith("apply "), F.expr("substr(a, 7)")).alias("rule"), F.when(F.col("a").startswith("word "), F.expr("substr(a, 6)")).alias("token"))
    ids = each.join(rules.select("rule", F.col("id").alias("rule_id")), "rule", "left").join(vocabulary.select("token", F.col("id").alias("known")), "token", "left").join(sources.select("tree_id", "tokens"), "tree_id", "left")
    at = F.array_position("tokens", F.col("token")) - 1
    return ids.select("tree_id", "step", "rule_id", F.when(F.col("token").isNotNull(), F.coalesce("known", F.lit(1))).alias("token_id"), F.when(F.col("token").isNotNull(), F.coalesce(at >= 0, F.lit(False))).alias("copied"), F.when(at >= 0, at).alias("copy_at"))


def dataset(trees: DataFrame, shares: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows tree_id, actions, part; grammar; vocabulary token, id) of trees, split by percent; grammar and vocabulary are those of the first part.

    Ids of the vocabulary begin at 3: 0 pads, 1 is unknown, 2 ends.
    """
    rows = corpus.split(actions(trees), "tree_id", shares)
    train = rows.where(F.col("part") == next(iter(shares)))
    words = train.select(F.explode("actions").alias("a")).where(F.col("a").startswith("word ")).select(F.expr("substr(a, 6)").alias("token"))
    return rows, grammar(train), kg.dense_ids(words, "token").select(F.col("name").alias("token"), (F.col("id") + 3).alias("id"))


def action_statistics(built: DataFrame, long: int = 100) -> DataFrame:
    """(most, mean, long): the greatest and mean number of actions and how many trees have more than `long`."""
    n = built.select(F.size("actions").alias("n"))
    return n.agg(F.max("n").alias("most"), F.avg("n").alias("mean"), F.count_if(F.col("n") > long).alias("long"))


def batches(rows: DataFrame, size: int, length: str, seed: int = 1) -> DataFrame:
    """Rows with a batch number: `size` rows each, chosen by a seeded hash of the row, and their place in it, the longest first.

    Batches are hash buckets, so nothing is ordered over all rows; their sizes vary about the given one.
    """
    n = F.greatest(F.ceil(F.lit(rows.count()) / size), F.lit(1))
    mixed = rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), *rows.columns), n).cast("int"))
    return mixed.withColumn("place", F.row_number().over(W.Window.partitionBy("batch").orderBy(F.desc(length), *[c for c in rows.columns if c != length])) - 1)


def predicted_class(rows: DataFrame) -> DataFrame:
    """(id, label, probability): the most probable class of logits (id, logits), the first among equals; null logits have none."""
    e = F.transform("logits", lambda x: F.exp(x - F.array_max("logits")))
    p = rows.select("id", F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)).alias("p"))
    return p.select("id", F.when(F.col("p").isNotNull(), F.array_position("p", F.array_max("p")) - 1).cast("int").alias("label"), F.array_max("p").alias("probability"))


def pointer_depths(lines: DataFrame) -> DataFrame:
    """(tree_id, node, parent, depth) of parent-pointer lines (tree_id, parents array<int>): 0 is the root's parent, nodes count from 1, -1 is no node.

    A node's depth is counted along its pointers, as far as the line is long; nodes on a ring have a null depth.
    """
    parents = F.col("parents")
    up = F.aggregate(
        F.sequence(F.lit(1), F.size(parents)),
        F.struct(F.col("node").alias("at"), F.lit(0).alias("n")),
        lambda s, _: F.when(s["at"] <= 0, s).otherwise(F.struct(F.coalesce(F.get(parents, s["at"] - 1), F.lit(-1)).alias("at"), (s["n"] + F.when(F.get(parents, s["at"] - 1) > 0, 1).otherwise(0)).alias("n"))),
    )
    each = lines.select("tree_id", "parents", F.posexplode("parents").alias("i", "parent")).where("parent >= 0").select("tree_id", "parents", (F.col("i") + 1).alias("node"), "parent")
    return each.withColumn("u", up).select("tree_id", "node", "parent", F.when(F.col("u.at") <= 0, F.col("u.n")).alias("depth"))
