"""P3: duplicates hidden by formatting, found by bottom-up hashing of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.common import attach_groups


def leaf(c: Column) -> Column:
    """Only letters and digits count, case does not; a null leaf is empty."""
    return F.coalesce(F.lower(F.regexp_replace(c.cast("string"), r"[^\p{L}\p{N}]", "")), F.lit(""))


def canonical(c: Column, kind: T.DataType) -> Column:
    """A nested value in one writing: leaves normalised, children of unordered nodes sorted.

    Arrays are unordered and drop contentless children; struct fields are known by name, so their
    order in the schema does not matter. Every child is wrapped with its length, so two
    different trees never have one writing.
    """
    wrap = lambda x: F.concat(F.char_length(x).cast("string"), F.lit(":"), x)
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{len(f.name)}:{f.name}"), wrap(canonical(c[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.concat(F.lit("{"), *parts, F.lit("}"))
    if isinstance(kind, T.ArrayType):
        children = F.filter(F.transform(c, lambda x: canonical(x, kind.elementType)), lambda x: ~x.isin("", "[]"))
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(children), wrap), ""), F.lit("]")), F.lit("[]"))
    return leaf(c)


def digest(c: Column, kind: T.DataType) -> Column:
    """128-bit Merkle digest: hash the leaves, sort the children's digests at unordered nodes, hash upwards."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}="), digest(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.md5(F.concat(F.lit("{"), *parts))
    if isinstance(kind, T.ArrayType):
        empty = [F.md5(F.lit("[").cast("binary")), F.md5(F.lit("").cast("binary"))]
        children = F.filter(F.transform(c, lambda x: digest(x, kind.elementType)), lambda x: ~x.isin(*empty))
        return F.md5(F.concat(F.lit("["), F.array_join(F.array_sort(F.coalesce(children, F.array().cast("array<string>"))), "")))
    return F.md5(leaf(c).cast("binary"))


def entry(c: Column) -> Column:
    """An entry as an unordered node: the fields between its semicolons."""
    return F.split(c, ";")


def grouped(df: DataFrame, id_col: str, value: Column, kind: T.DataType) -> tuple[DataFrame, DataFrame]:
    """(rows with root digest and canonical form, groups with keep_id and copies)."""
    rows = df.select(F.col(id_col).alias("dup_id"), value.alias("v")).where(F.col("v").isNotNull())
    rows = rows.select("dup_id", F.unhex(digest(F.col("v"), kind)).alias("root"), canonical(F.col("v"), kind).alias("canon"))
    rows = rows.where(~F.col("canon").isin("", "[]"))
    groups = rows.groupBy("root", "canon").agg(F.min("dup_id").alias("keep_id"), F.count("*").alias("copies"))
    return rows, groups


ENTRY = T.ArrayType(T.StringType())


def duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, dup_id) for each superfluous copy.

    Groups share the root digest and are confirmed by the full canonical form. Null entries and
    entries without a letter or digit are no case; rows with a null id can be named by nobody and
    are left out; an empty table gives no rows; other columns are ignored.
    """
    rows, groups = grouped(df.where(F.col(id_col).isNotNull()), id_col, entry(F.col(text_col)), ENTRY)
    many = groups.where("copies > 1").withColumnRenamed("canon", "same")
    out = attach_groups(rows, many, ["root"], "copies", df.count(), F.col("r.canon") == F.col("g.same"))
    return out.where("dup_id <> keep_id").select("keep_id", "dup_id")


def collapsed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, copies): each entry once, with the number of its rows."""
    return grouped(df.where(F.col(id_col).isNotNull()), id_col, entry(F.col(text_col)), ENTRY)[1].select("keep_id", "copies")
