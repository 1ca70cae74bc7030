"""Queries of this subpackage over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.common import table
from graphloom.llm import garbled, merkle, mixing, names, near, packing, scans, sentences, spans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_P3 = """
WITH e AS (SELECT 'entity2id' tbl, id, ent v FROM entity2id UNION ALL SELECT 'relation2id', id, rel FROM relation2id),
c AS (SELECT tbl, id, list_sort(list_filter(list_transform(string_split(v, ';'),
        lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))), lambda x: x <> '')) k FROM e WHERE v IS NOT NULL),
g AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, k) keep_id, count(*) OVER (PARTITION BY tbl, k) copies FROM c WHERE len(k) > 0)
"""


@query(_P3 + "SELECT tbl, keep_id, id AS dup_id FROM g WHERE id <> keep_id")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [merkle.duplicates(table(spark, d, t), "id", c).select(F.lit(t).alias("tbl"), "keep_id", "dup_id") for t, c in (("entity2id", "ent"), ("relation2id", "rel"))]
    return parts[0].unionByName(parts[1])


@query(_P3 + "SELECT tbl, keep_id, copies FROM g WHERE id = keep_id")
def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    parts = [merkle.collapsed(table(spark, d, t), "id", c).select(F.lit(t).alias("tbl"), "keep_id", "copies") for t, c in (("entity2id", "ent"), ("relation2id", "rel"))]
    return parts[0].unionByName(parts[1])


_P10 = """
WITH w AS (SELECT doc_id, s, substr(text, s + 1, 200) k FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) s FROM documents)),
g AS (SELECT k FROM w GROUP BY k HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) p FROM w SEMI JOIN g USING (k)),
i AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) r FROM h)
SELECT doc_id, min(s) AS span_start, max(s) + 200 AS span_end FROM i GROUP BY doc_id, r
"""


@query(_P10)
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


_P4 = """
WITH t AS (SELECT article_id, trim(regexp_replace(lower(coalesce(title, '') || ' ' || abstract), '[ \\t\\r\\n]+', ' ', 'g'), ' ') v
           FROM clean_text WHERE abstract IS NOT NULL AND abstract <> '**NONE**'),
s AS (SELECT DISTINCT article_id, substr(v, i, 5) k FROM (SELECT article_id, v, unnest(range(1, length(v) - 3)) i FROM t)),
n AS (SELECT article_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT x.article_id a, y.article_id b, count(*) c FROM s x JOIN s y ON x.k = y.k AND x.article_id < y.article_id GROUP BY 1, 2)
SELECT a AS article_a, b AS article_b FROM p JOIN n m ON m.article_id = a JOIN n o ON o.article_id = b WHERE c >= 0.7 * (m.n + o.n - c)
"""


@query(_P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(table(spark, d, "clean_text"))


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "clean_text")
    return sentences.sentences(papers.where(~F.col("abstract").contains("\n")))


@query()
def p2_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "clean_text"))


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "clean_text")).where("garbled").select("article_id", "field")


@query()
def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restored(table(spark, d, "clean_text")).where("garbled")


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scanned(table(spark, d, "clean_text"))


@query()
def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "clean_text"))


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "clean_text"))


@query()
def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.entities(table(spark, d, "clean_text")).groupBy("entity").agg(F.count("*").alias("spellings"), F.min("name").alias("name"))


@query()
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


@query()
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes")
    return packing.report(packing.packed(table(spark, d, "documents"), sizes), sizes)


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query("""SELECT container, capacity, 0 AS overfull, (SELECT count(*) FROM documents WHERE length(text) > 0) AS texts, 0 AS cut_needlessly, 0 AS incomplete, true AS well_filled
FROM (SELECT DISTINCT container, capacity FROM pack_sizes WHERE container IS NOT NULL AND capacity >= 1)""")
def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """No bin above its capacity, no text cut that fits, every text whole, and nine tenths of the room used at least."""
    sizes = table(spark, d, "pack_sizes").where("container is not null and capacity >= 1").select("container", "capacity").distinct()
    docs = table(spark, d, "documents")
    placed = packing.cut(packing.packed(docs, sizes).join(F.broadcast(sizes), "container"))
    bins = placed.groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("t"))
    full = bins.groupBy("container", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.sum("t") >= 0.9 * F.count("*") * F.first("capacity")).alias("well_filled"))
    texts = placed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    known = packing.sized(docs).select("doc_id", F.col("tokens").alias("all"))
    texts = texts.join(known, "doc_id").groupBy("container").agg(F.count("*").alias("texts"), F.count_if((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))).alias("cut_needlessly"), F.count_if(F.col("t") != F.col("all")).alias("incomplete"))
    return full.join(texts, "container").select("container", "capacity", "overfull", "texts", "cut_needlessly", "incomplete", "well_filled")


@query("SELECT source, true AS within_repeats, true AS near_target FROM mix_targets WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)")
def p9_invariants(spark: SparkSession, d: str) -> DataFrame:
    """No document used more often than its source allows, and every source with documents within a block and a document of its part of the whole."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    chosen, report = mixing.mixed(docs, targets)
    uses = chosen.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("tokens").alias("longest")).groupBy("source").agg(F.max("n").alias("n"), F.max("longest").alias("longest"))
    held = report.where("available_tokens > 0")
    total = held.agg(F.sum("target_share").alias("shares"), F.sum("blocks").alias("all"))
    rows = held.join(uses, "source", "left").join(F.broadcast(total))
    exact = F.col("all") * F.col("target_share") / F.col("shares")
    near = (F.abs(F.col("blocks") - exact) <= 1) & (F.abs(F.col("tokens") - F.col("blocks") * mixing.BLOCK) <= F.coalesce("longest", F.lit(0)))
    return rows.select("source", (F.coalesce("n", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_target"))
