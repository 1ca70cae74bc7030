"""Knowledge-graph completion over a table of scores: dispatch by what is unknown, expansion of terms, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.operators import kg


def threshold(score: Column, least: Column | float = 0.1) -> Column:
    """0 for a score below the least, which may be a column of each relation's own."""
    return F.when(score < least, F.lit(0.0)).otherwise(score)


def learned_thresholds(scores: DataFrame) -> DataFrame:
    """(relation, least): the threshold that tells most of a relation's held-out true facts (label 1) from false ones (0).

    Candidates are the scores themselves; facts at or above it count as true. Of equal ones the lowest is taken. The running counts are sums by
    distinct score, which are aggregated before.
    """
    each = scores.groupBy("relation", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    before = W.Window.partitionBy("relation").orderBy("score").rowsBetween(W.Window.unboundedPreceding, -1)
    total = W.Window.partitionBy("relation")
    right = F.sum("p").over(total) - F.coalesce(F.sum("p").over(before), F.lit(0)) + F.coalesce(F.sum("q").over(before), F.lit(0))
    return each.withColumn("right", right).groupBy("relation").agg(F.min_by("score", F.struct(-F.col("right"), F.col("score"))).alias("least"))


def best_and_mean(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best, mean: the least and mean score of the facts (head, tail) that do not lead back to their head; null where there is none."""
    other = F.when(F.col("head") != F.col("tail"), F.col("score"))
    return scores.groupBy(*keys).agg(F.min(other).alias("best"), F.avg(other).alias("mean"))


def network(scores: DataFrame, least: float) -> DataFrame:
    """(head, tail, score): edges of a predicted network above the least score."""
    return scores.where(F.col("score") > least).select("head", "tail", "score").distinct()


def first_other(candidates: DataFrame, given: str, found: str) -> DataFrame:
    """One candidate for each (given, relation): the best that is not the given entity itself; higher scores are better, ties by id."""
    others = candidates.where(F.col(given) != F.col(found))
    return others.groupBy(given, "relation").agg(F.max_by(F.struct(found, "score"), F.struct(F.col("score"), -F.col(found))).alias("b")).select(given, "relation", f"b.{found}", "b.score")


def dispatch(queries: DataFrame, scores: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """(query, head, relation, tail, score): what completes each query (query, head, relation, tail with -1 for unknown).

    With one unknown the n best candidates of the scores are taken, with none the fact itself; with more than one there is a single
    row without a score. Scores below the least are 0. Queries are a stated set, scores are (head, relation, tail, score); a query without candidates has no
    row. Each kind of query is one equi-join on what is known, so no pairs are made beyond the matches.
    """
    slots = ["head", "relation", "tail"]
    unknown = sum((F.when(F.col(c) == -1, 1).otherwise(0) for c in slots), F.lit(0))
    asked = queries.where("head is not null and relation is not null and tail is not null").withColumn("unknown", unknown)
    parts = []
    for hidden in [None, *slots]:
        known = [c for c in slots if c != hidden]
        mine = asked.where("unknown = 0") if hidden is None else asked.where((F.col("unknown") == 1) & (F.col(hidden) == -1))
        parts.append(mine.select("query", *known).join(scores.select(*slots, "score"), known).select("query", *slots, "score"))
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    top = found.withColumn("k", F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), *slots))).where(F.col("k") <= n)
    answered = top.select("query", *slots, threshold(F.col("score"), least).alias("score"))
    return answered.unionByName(asked.where("unknown > 1").select("query", *slots, F.lit(None).cast("double").alias("score")))


def expansion(term: str, triples: DataFrame, entities: DataFrame, scores: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """(head, relation, tail, score): the n best predicted facts about entities whose name holds a term.

    Each matching entity is taken with each relation of its facts, once as head and once as tail, and completed by the best other entity; both
    lists are united and ordered by score.
    """
    ids = entities.where(F.lower("ent").contains(term.lower())).select("id").distinct()
    facts = kg.facts(triples)
    as_head = facts.join(ids, F.col("head") == F.col("id"), "left_semi").select(F.col("head").alias("given"), "relation")
    as_tail = facts.join(ids, F.col("tail") == F.col("id"), "left_semi").select(F.col("tail").alias("given"), "relation")
    asked = as_head.unionByName(as_tail).distinct()
    tails = first_other(scores.join(asked.withColumnRenamed("given", "head"), ["head", "relation"]), "head", "tail").select("head", "relation", "tail", "score")
    heads = first_other(scores.join(asked.withColumnRenamed("given", "tail"), ["tail", "relation"]), "tail", "head").select("head", "relation", "tail", "score")
    both = tails.unionByName(heads).distinct().withColumn("score", threshold(F.col("score"), least))
    return both.orderBy(F.desc("score"), "head", "relation", "tail").limit(n)


def term_search(term: str, entities: DataFrame, relations: DataFrame, scores: DataFrame, n: int = 10) -> DataFrame:
    """(head, relation, tail, score): every relation with every entity whose name holds the term and its best other tail, the n of the least rounded score first.

    The pairs of relations and entities are those that have a score, so they come from a join.
    """
    ids = entities.where(F.lower("ent").contains(term.lower())).select(F.col("id").alias("head")).distinct()
    known = scores.join(ids, "head", "left_semi").join(relations.select(F.col("id").alias("relation")).distinct(), "relation", "left_semi")
    found = first_other(known, "head", "tail").withColumn("score", F.round("score", 3))
    return found.select("head", "relation", "tail", "score").orderBy("score", "head", "relation", "tail").limit(n)


def linked_entities(mentions: DataFrame, names: DataFrame, least: float = 0.75) -> DataFrame:
    """(mention, id, similarity): the entity most similar to each mention, -1 below the least, by the part of shared words (cosine of their sets).

    mentions has mention, names id and name. Words of names meet in an equi-join, so only names with a word in common are compared; where phrases have
    vectors, `embedding.best_match` takes the place of the word sets.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    m = mentions.where("mention is not null").select("mention").distinct().select("mention", words(F.col("mention")).alias("w")).select("mention", F.size("w").alias("n"), F.explode_outer("w").alias("word"))
    e = names.where("name is not null and id is not null").select("id", words(F.col("name")).alias("w")).select("id", F.size("w").alias("k"), F.explode("w").alias("word"))
    shared = m.join(e, "word", "left").groupBy("mention", "n", "id", "k").agg(F.count("*").alias("s"))
    rated = shared.select("mention", "id", F.when(F.col("id").isNotNull(), F.col("s") / F.sqrt(F.col("n") * F.col("k"))).otherwise(0.0).alias("similarity"))
    best = rated.groupBy("mention").agg(F.max_by(F.struct("id", "similarity"), F.struct(F.col("similarity"), -F.coalesce("id", F.lit(2**62)))).alias("b"))
    return best.select("mention", F.when(F.col("b.similarity") >= least, F.col("b.id")).otherwise(F.lit(-1)).alias("id"), "b.similarity")


def answers(questions: DataFrame, entities: DataFrame, relations: DataFrame, scores: DataFrame, n: int = 10, least: float = 0.1) -> DataFrame:
    """(query, subject, relation, object, score) in names: answers to questions (query, subject, relation, object) of which a part is null or no name.

    Parts are linked to entities and relations by `linked_entities`, then `dispatch` completes what is unknown.
    """
    e = entities.select("id", F.col("ent").alias("name"))
    r = relations.select("id", F.col("rel").alias("name"))
    asked = questions
    for part, names, slot in (("subject", e, "head"), ("relation", r, "relation"), ("object", e, "tail")):
        found = linked_entities(asked.select(F.col(part).alias("mention")), names).select(F.col("mention").alias(part), F.col("id").alias(f"{slot}_id"))
        asked = asked.join(found, part, "left").withColumn(f"{slot}_id", F.coalesce(f"{slot}_id", F.lit(-1)))
    goal = asked.select("query", *[F.col(f"{s}_id").cast("bigint").alias(s) for s in ("head", "relation", "tail")])
    done = dispatch(goal, scores, n, least)
    one = lambda names, key, out: names.groupBy("id").agg(F.max("name").alias(out)).withColumnRenamed("id", key)
    named = done.join(one(e, "head", "subject"), "head", "left").join(one(e, "tail", "object"), "tail", "left").join(one(r, "relation", "rel"), "relation", "left")
    return named.select("query", "subject", F.col("rel").alias("relation"), "object", "score")
