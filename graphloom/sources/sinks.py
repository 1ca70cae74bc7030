"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_table(df: DataFrame, path: str, single: bool = False) -> None:
    """A tab-separated index whose first line is the number of rows; in one file, written by one task, only where a reader needs that."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = df.agg(F.count("*").cast("string").alias("value")).select(F.lit(0).alias("k"), "value")
    rows = head.unionByName(df.select(F.lit(1).alias("k"), line.alias("value")))
    (rows.coalesce(1) if single else rows).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose keys are not in new: create or merge without a table format."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def edge_list(edges: DataFrame, path: str) -> None:
    """Edges (src, dst) as tab-separated lines."""
    edges.select("src", "dst").write.mode("overwrite").option("sep", "\t").csv(path)


def lines(rows: DataFrame, column: str, path: str) -> None:
    """One line for each value, such as search terms; nulls are left out."""
    rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def vector_text(vectors: DataFrame, path: str) -> None:
    """Vectors (token, vec) as lines of a word and its numbers."""
    rows = vectors.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    rows.write.mode("overwrite").text(path)


def parse_files(tokens: DataFrame, deps: DataFrame, path: str) -> None:
    """Folders input, morph and dep with a file set for each document: lines `form_POS`, lemmas and `rel(form-i, form-j)`, a blank line after each sentence."""
    blocks = lambda df, line, order: df.groupBy("doc", "sent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    words = tokens.where("idx > 0")
    form = lambda key: tokens.select("doc", "sent", F.col("idx").alias(key), F.col("form").alias(f"{key}_f"))
    named = deps.select("doc", "sent", "rel", "gov", "dep").join(form("gov"), ["doc", "sent", "gov"], "left").join(form("dep"), ["doc", "sent", "dep"])
    line = F.concat("rel", F.lit("("), F.coalesce("gov_f", F.lit("ROOT")), F.lit("-"), "gov", F.lit(", "), "dep_f", F.lit("-"), "dep", F.lit(")"))
    for kind, df in (("input", blocks(words, F.concat_ws("_", "form", "pos"), "idx")), ("morph", blocks(words, F.col("lemma"), "idx")), ("dep", blocks(named, line, "dep"))):
        whole = df.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent", "b"))), lambda x: x["b"]), "\n\n").alias("value"))
        whole.repartition("doc").write.mode("overwrite").partitionBy("doc").text(f"{path}/{kind}")
