"""Corpus statistics over tokenised texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.columns import tokens


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token) of all texts."""
    return docs.where("text is not null").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def vocabulary(docs: DataFrame, least: int = 1) -> DataFrame:
    """(token, n) of tokens with at least `least` occurrences."""
    return tokenised(docs).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def tf_idf(docs: DataFrame) -> DataFrame:
    """(doc_id, token, tf, df, tfidf) with idf = ln((N + 1) / (df + 1))."""
    tf = tokenised(docs).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = docs.where("text is not null").agg(F.count_distinct("doc_id").alias("n"))
    return tf.join(df, "token").join(F.broadcast(n)).select("doc_id", "token", "tf", "df", (F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("tfidf"))


def cooccurrence(docs: DataFrame, window: int = 10, least: int = 5) -> DataFrame:
    """(a, b, weight), a <= b: sum of 1 / distance over the pairs of frequent words within the window.

    The words after a position are sliced from the document's array, so no join of positions is needed.
    """
    often = vocabulary(docs, least).select("token")
    w = docs.where("text is not null").select(tokens(F.col("text")).alias("w"))
    unit = math.lcm(*range(1, window + 1))  # sums of unit / distance are whole numbers, so their order does not matter
    pairs = w.select("w", F.posexplode("w").alias("i", "x")).select("x", F.posexplode(F.slice(F.col("w"), F.col("i") + 2, window)).alias("d", "y"))
    share = F.element_at(F.array(*[F.lit(unit // d) for d in range(1, window + 1)]), F.col("d") + 1)
    found = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum(share.cast("bigint")).alias("s"))
    found = found.join(often.withColumnRenamed("token", "a"), "a", "left_semi").join(often.withColumnRenamed("token", "b"), "b", "left_semi")
    return found.select("a", "b", (F.col("s") / unit).alias("weight"))


def admissible_sentences(docs: DataFrame, least: float = 2.0) -> DataFrame:
    """(doc_id, mean_length): texts whose tokens have an average length of at least `least`."""
    return tokenised(docs).groupBy("doc_id").agg(F.avg(F.char_length("token")).alias("mean_length")).where(F.col("mean_length") >= least)


def length_statistics(docs: DataFrame) -> DataFrame:
    """count, mean, sd, least, quartiles (interpolated) and most tokens of a text."""
    n = docs.where("text is not null").select(F.size(tokens(F.col("text"))).alias("k"))
    quartiles = [F.percentile("k", F.lit(q)).alias(name) for q, name in ((0.25, "lower"), (0.5, "median"), (0.75, "upper"))]
    return n.agg(F.count("*").alias("count"), F.avg("k").alias("mean"), F.stddev_samp("k").alias("sd"), F.min("k").alias("least"), *quartiles, F.max("k").alias("most"))


def runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by spaces."""
    at = F.transform(words, lambda x, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))
    return F.filter(at, lambda g: g.isNotNull())


def ngrams(docs: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, gram, tf): runs of one to `most` words of each text, joined by spaces."""
    w = docs.where("text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    each = w.select("doc_id", F.explode(F.concat(*[runs(F.col("w"), n) for n in range(1, most + 1)])).alias("gram"))
    return each.groupBy("doc_id", "gram").agg(F.count("*").alias("tf"))


def tf_idf_of(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc_id, gram, tf, df, tfidf) of counts (doc_id, gram, tf); n_docs holds the number of texts."""
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    return tf.join(df, "gram").join(F.broadcast(n_docs)).select("doc_id", "gram", "tf", "df", (F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1))).alias("tfidf"))


def ranked_sentences(docs: DataFrame, rounds: int = 30, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """(doc_id, sent, sentence, rank): TextRank of the sentences of each text, ranks of a text sum to the number of its sentences.

    Sentences end with . ! or ?. Two sentences of a text are bound by their shared words over the sum of the logarithms of their lengths;
    the pairs are those within one text, so their number is bounded by its length. Texts and sentences without words have no ranks.
    """
    parts = F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?]+[.!?]*"), F.lit(0))).alias("sent", "sentence")
    each = docs.where("text is not null").select("doc_id", parts).withColumn("w", F.array_distinct(tokens(F.col("sentence")))).where("size(w) > 0")
    each = cut(each.select("doc_id", "sent", F.trim("sentence").alias("sentence"), "w"))
    words = each.select("doc_id", F.col("sent").alias("a"), F.size("w").alias("n"), F.explode("w").alias("word"))
    other = words.select("doc_id", F.col("a").alias("b"), F.col("n").alias("m"), "word")
    shared = words.join(other, ["doc_id", "word"]).where("a <> b").groupBy("doc_id", "a", "b", "n", "m").agg(F.count("*").alias("s"))
    weight = F.col("s") / F.greatest(F.log("n") + F.log("m"), F.lit(1.0))
    edges = shared.select("doc_id", "a", "b", weight.alias("v"))
    total = edges.groupBy("doc_id", "a").agg(F.sum("v").alias("total"))
    edges = cut(edges.join(total, ["doc_id", "a"]).select("doc_id", "a", "b", (F.col("v") / F.col("total")).alias("v")))
    ranks = each.select("doc_id", "sent", F.lit(1.0).alias("rank"))
    for _ in range(rounds):
        given = edges.join(ranks.withColumnRenamed("sent", "a"), ["doc_id", "a"]).groupBy("doc_id", F.col("b").alias("sent")).agg(F.sum(F.col("v") * F.col("rank")).alias("g"))
        new = cut(ranks.join(given, ["doc_id", "sent"], "left").select("doc_id", "sent", F.col("rank").alias("old"), (1 - damping + damping * F.coalesce("g", F.lit(0.0))).alias("rank")))
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        ranks = new.select("doc_id", "sent", "rank")
        if moved < least:
            break
    return each.select("doc_id", "sent", "sentence").join(ranks, ["doc_id", "sent"])


def bleu(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(pair_id, bleu_1 ... bleu_most) of (pair_id, reference, hypothesis) arrays of words.

    Precisions of runs clipped by the reference, geometric mean, brevity penalty; a run length without a match counts 0.1 matches (smoothing method 1). An
    empty hypothesis or a reference that is null has 0.
    """
    out = pairs.select("pair_id", F.coalesce("reference", F.array().cast("array<string>")).alias("r"), F.coalesce("hypothesis", F.array().cast("array<string>")).alias("h"))
    logs = []
    for n in range(1, most + 1):
        out = out.withColumn("rg", runs(F.col("r"), n)).withColumn("hg", runs(F.col("h"), n))
        count = lambda g, c: F.size(F.filter(c, lambda x: x == g))
        clipped = F.aggregate(F.array_distinct("hg"), F.lit(0), lambda s, g: s + F.least(count(g, F.col("hg")), count(g, F.col("rg"))))
        out = out.withColumn(f"p{n}", F.log(F.when(clipped > 0, clipped.cast("double")).otherwise(0.1) / F.greatest(F.size("hg"), F.lit(1)))).drop("rg", "hg")
        logs.append(F.col(f"p{n}"))
    short = F.when(F.size("h") >= F.size("r"), F.lit(1.0)).otherwise(F.exp(1 - F.size("r") / F.size("h")))
    score = lambda n: F.when((F.size("h") == 0) | (F.size("r") == 0), F.lit(0.0)).otherwise(short * F.exp(sum(logs[1:n], logs[0]) / n))
    return out.select("pair_id", *[score(n).alias(f"bleu_{n}") for n in range(1, most + 1)])
