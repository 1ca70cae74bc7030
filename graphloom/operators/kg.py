"""Knowledge-graph tables: dictionaries, packaging, lookups, constraints and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import lookup, numbered


def facts(triples: DataFrame) -> DataFrame:
    """Distinct (head, tail, relation) with all three linked; null keys and -1 are no facts."""
    return triples.where("head is not null and tail is not null and relation is not null and head <> -1 and tail <> -1 and relation <> -1").select("head", "tail", "relation").distinct()


def top_entities(triples: DataFrame, n: int) -> DataFrame:
    """The n most frequent keys over heads and tails; ties by key."""
    keys = triples.select(F.explode(F.array("head", "tail")).alias("id")).where("id is not null and id <> -1")
    return keys.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(n)


def top_relations(triples: DataFrame, n: int) -> DataFrame:
    keys = triples.where("relation is not null and relation <> -1")
    return keys.groupBy(F.col("relation").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(n)


def dense_ids(names: DataFrame, column: str) -> DataFrame:
    """(name, id): ids from 0 over the sorted distinct names.

    """
    return numbered(names.where(F.col(column).isNotNull()).select(F.col(column).alias("name")).distinct(), ["name"], "id")


def type_constraints(triples: DataFrame) -> DataFrame:
    """(relation, n_heads, n_tails): sizes of the sets of heads and tails that a relation allows."""
    return facts(triples).groupBy("relation").agg(F.count_distinct("head").alias("n_heads"), F.count_distinct("tail").alias("n_tails"))


def constraint_members(triples: DataFrame) -> DataFrame:
    """(relation, side, id): the sets themselves, one row a member, so that no set must fit into one row."""
    f = facts(triples)
    return f.select("relation", F.lit("head").alias("side"), F.col("head").alias("id")).unionByName(f.select("relation", F.lit("tail").alias("side"), F.col("tail").alias("id"))).distinct()


def named(triples: DataFrame, entities: DataFrame, relations: DataFrame, missing: str = "missing") -> DataFrame:
    """Facts with names for ids; an id without a name is called `missing`."""
    e = entities.where("ent is not null").groupBy("id").agg(F.max("ent").alias("name"))
    r = relations.where("rel is not null").groupBy("id").agg(F.max("rel").alias("name"))
    out = facts(triples)
    for key, names in (("head", e), ("tail", e), ("relation", r)):
        out = lookup(out, names.select(F.col("id").alias(key), F.col("name").alias(f"{key}_name")), key)
    return out.select("head", "tail", "relation", *[F.coalesce(f"{k}_name", F.lit(missing)).alias(f"{k}_name") for k in ("head", "tail", "relation")])


def package(raw: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(head, tail, relation) ids of string triples (subj, rel, obj) whose three parts are all in the dictionaries (name, id)."""
    out = raw.join(entities.select(F.col("name").alias("subj"), F.col("id").alias("head")), "subj")
    out = out.join(entities.select(F.col("name").alias("obj"), F.col("id").alias("tail")), "obj")
    return out.join(relations.select(F.col("name").alias("rel"), F.col("id").alias("relation")), "rel").select("head", "tail", "relation").distinct()


def incident(triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with an end among ids: two equi-joins instead of a condition with OR."""
    f, k = facts(triples), ids.select("id").distinct()
    return f.join(k, F.col("head") == F.col("id"), "left_semi").unionByName(f.join(k, F.col("tail") == F.col("id"), "left_semi")).distinct()


def admissible(triples: DataFrame, least: int = 3) -> DataFrame:
    """String triples without digits, with a letter first and parts of a least length."""
    ok = F.lit(True)
    for c in ("subj", "rel", "obj"):
        ok = ok & ~F.col(c).rlike(r"\p{Nd}") & F.col(c).rlike("^[A-Za-z]") & (F.char_length(c) >= least)
    return triples.where(ok)


def surface_triples(docs: DataFrame) -> DataFrame:
    """(doc_id, subj, rel, obj): every three words in a row that start at a multiple of three; stands in for a parser."""
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).where("size(w) >= 3")
    at = words.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3))).alias("i"))
    return at.select("doc_id", F.element_at("w", F.col("i")).alias("subj"), F.element_at("w", F.col("i") + 1).alias("rel"), F.element_at("w", F.col("i") + 2).alias("obj"))
