"""Operators on parses supplied as data: tokens, dependencies, mentions and equations.

tokens: doc, sent, idx (from 1), form, lemma, pos. deps: doc, sent, rel, gov, dep (idx of the governor, 0 for the root, and of the dependent).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.operators import corpus

# Relations that are left out of dependencies
IGNORED = ("aux", "auxpass", "det", "cop", "complm", "preconj", "predet", "punct", "quantmod", "expl", "mark")
STOP = ("be", "%", "say", "$")
SENTENCE = ["doc", "sent"]


def dependencies(lines: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(doc, sent, rel, gov, gov_form, dep, dep_form) of lines (doc, sent, line) such as `nsubj(rose-2, cases-1)`.

    Roots are governors that depend on nothing in their sentence; they get a row `ROOT` from 0. Written roots, ignored relations and conjunctions of a
    token with itself are left out, after they have told what is a root; lines of another form are no dependencies.
    """
    line = r"^([^(]+)\((.*)-(\d+)'*, (.*)-(\d+)'*\)$"
    part = lambda i: F.regexp_extract(F.trim("line"), line, i)
    rows = lines.where(F.trim("line").rlike(line)).select(*SENTENCE, part(1).alias("rel"), part(3).cast("int").alias("gov"), part(2).alias("gov_form"), part(5).cast("int").alias("dep"), part(4).alias("dep_form"))
    rows = rows.where((F.lower("rel") != "root") & ~(F.col("rel").startswith("conj") & (F.col("gov") == F.col("dep"))))
    governs = rows.select(*SENTENCE, F.col("gov").alias("dep"), F.col("gov_form").alias("dep_form")).distinct()
    roots = governs.join(rows.select(*SENTENCE, "dep"), [*SENTENCE, "dep"], "left_anti")
    kept = rows.where(~F.col("rel").isin(*ignored))
    return kept.unionByName(roots.select(*SENTENCE, F.lit("ROOT").alias("rel"), F.lit(0).alias("gov"), F.lit("ROOT").alias("gov_form"), "dep", "dep_form"))


def ordered(deps: DataFrame) -> DataFrame:
    """(doc, sent, deps): the dependencies of a sentence in the order of their dependents."""
    row = F.struct("dep", "rel", "gov")
    return deps.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(row)).alias("deps"))


def content(pos: Column) -> Column:
    """Whether a part of speech is an adjective, adverb, verb or noun."""
    return F.substring(pos, 1, 1).isin("J", "R", "V", "N")


def kind(pos: Column, lemma: Column) -> Column:
    """C for a word of content that is no stop word, N else."""
    return F.when(content(pos) & ~lemma.isin(*STOP), "C").otherwise("N")


def with_verb(tokens: DataFrame) -> DataFrame:
    """(doc, sent) of the sentences with a verb."""
    return tokens.where(F.upper("pos").startswith("VB")).select(*SENTENCE).distinct()


def reached(deps: DataFrame) -> DataFrame:
    """(doc, sent, idx, ignored): a token is ignored unless its governors lead up to the root, 0.

    A sentence's pointers are one row, shuffled once; there they jump, so the rounds are the logarithm of the sentence's depth. Of several governors the
    one of the least index counts.
    """
    row = F.struct(F.col("dep").cast("bigint").alias("dep"), F.col("gov").cast("bigint").alias("gov"))
    whole = deps.where("dep > 0").groupBy(*SENTENCE).agg(F.sort_array(F.collect_list(row)).alias("d"))
    flat = whole.select(*SENTENCE, F.transform("d", lambda x: x["dep"]).alias("dep"), F.transform("d", lambda x: x["gov"]).alias("gov"))
    kinds = dict(deps.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                dep, gov = batch.column(2)[k].values, batch.column(3)[k].values
                none, idx = np.asarray(gov.is_null()), dep.to_numpy()
                at = np.where(none, np.iinfo(np.int64).min, gov.fill_null(0).to_numpy())
                # the least governor of each token; one without any has a null
                order = np.lexsort((at, none, idx))
                first = order[np.r_[True, idx[order][1:] != idx[order][:-1]]]
                idx, at, none = idx[first], at[first], none[first]
                place = np.minimum(np.searchsorted(idx, at), len(idx) - 1)
                to = np.where((idx[place] == at) & ~none[place], place, -1)  # row of the governor, if it leads on
                end = at
                for _ in range(len(idx).bit_length()):  # what still moves then is on a ring
                    end = np.where(to >= 0, end[to], end)
                    to = np.where(to >= 0, to[to], -1)
                ignored = pa.array((end != 0) | (to >= 0), mask=none)
                keys = [pa.repeat(batch.column(i)[k], len(idx)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(idx), ignored], ["doc", "sent", "idx", "ignored"])

    found = flat.mapInArrow(run, f"doc {kinds['doc']}, sent {kinds['sent']}, idx bigint, ignored boolean")
    return found.select(*SENTENCE, F.col("idx").cast(kinds["dep"]).alias("idx"), "ignored")


def subtree(tokens: DataFrame, deps: DataFrame, starts: DataFrame, prefixes: str) -> DataFrame:
    """(doc, sent, idx, form): tokens below the starting ones (doc, sent, token) whose part of speech begins with one of the letters."""
    key = F.to_json(F.struct(*SENTENCE))
    below = corpus.closure(deps.select(key.alias("sent"), "gov", "dep"), starts.select(key.alias("sent"), "token"))
    keyed = tokens.where(F.substring("pos", 1, 1).isin(*prefixes)).withColumn("key", key)
    return keyed.join(below.select(F.col("sent").alias("key"), F.col("token").alias("idx")), ["key", "idx"], "left_semi").select(*SENTENCE, "idx", "form")


def triples(tokens: DataFrame, deps: DataFrame) -> DataFrame:
    """(doc, sent, subj, rel, obj, verb): subject, verb and object of each verb that governs both, in the forms of the tokens."""
    side = lambda rels, name: deps.where(F.col("rel").isin(*rels)).select(*SENTENCE, F.col("gov").alias("verb"), F.col("dep").alias(name))
    both = side(("nsubj", "nsubjpass"), "s").join(side(("dobj", "obj"), "o"), [*SENTENCE, "verb"])
    form = lambda key, name: tokens.select(*SENTENCE, F.col("idx").alias(key), F.col("form").alias(name))
    verbs = tokens.where(F.col("pos").startswith("V")).select(*SENTENCE, F.col("idx").alias("verb"), F.col("form").alias("rel"))
    out = both.join(verbs, [*SENTENCE, "verb"]).join(form("s", "subj"), [*SENTENCE, "s"]).join(form("o", "obj"), [*SENTENCE, "o"])
    return out.select(*SENTENCE, "subj", "rel", "obj", "verb")


def longest(rows: DataFrame) -> DataFrame:
    """(doc, sent, triple): of the stored triples (doc, sent, n, triple array<string>) of a sentence the one of most words, the first among equals."""
    words = F.size(F.flatten(F.transform("triple", lambda x: F.split(x, " "))))
    return rows.groupBy(*SENTENCE).agg(F.max_by("triple", F.struct(words, -F.col("n"))).alias("triple"))


def expanded(spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows (doc, sent, n, span array<int>) with each span united with the mentions (doc, sent, mention array<int>) of its sentence that it overlaps."""
    each = spans.select(*SENTENCE, "n", "span").join(mentions.select(*SENTENCE, "mention"), SENTENCE).where(F.arrays_overlap("span", "mention"))
    more = each.groupBy(*SENTENCE, "n").agg(F.array_distinct(F.flatten(F.collect_list("mention"))).alias("more"))  # mentions of one sentence
    joined = spans.select(*SENTENCE, "n", "span").join(more, [*SENTENCE, "n"], "left")
    return joined.select(*SENTENCE, "n", F.array_sort(F.array_union("span", F.coalesce("more", F.array().cast("array<int>")))).alias("span"))


def resolved(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc, sent, words): sentences (doc, sent, words array<string>) with their mentions replaced.

    mentions has doc, sent, start, end (positions from 0, end exclusive) and better array<string>, the words of the representative mention. They are applied from
    left to right; one that begins within another is left out. Sentences without mentions stay.
    """
    row = F.struct(F.col("start"), F.col("end"), F.col("better"))
    each = mentions.groupBy(*SENTENCE).agg(F.array_sort(F.collect_list(row)).alias("m"))  # mentions of one sentence
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    step = lambda s, m: F.when(m["start"] < s["at"], s).otherwise(F.struct(m["end"].cast("int").alias("at"), F.concat(s["out"], F.slice("words", s["at"] + 1, m["start"] - s["at"]), m["better"]).alias("out")))
    done = F.aggregate(F.col("m"), start, step)
    rest = F.concat(F.col("d.out"), F.slice("words", F.col("d.at") + 1, F.greatest(F.size("words") - F.col("d.at"), F.lit(0))))
    both = sentences.select(*SENTENCE, "words").join(each, SENTENCE, "left").withColumn("d", F.when(F.col("m").isNotNull(), done))
    return both.select(*SENTENCE, F.when(F.col("d").isNull(), F.col("words")).otherwise(rest).alias("words"))


def preprocessed(raw: DataFrame, lemmas: DataFrame, nouns: DataFrame, most: int = 4) -> DataFrame:
    """(id, subj, rel, obj) of string triples (id, subj, rel, obj) in lower-case words without punctuation.

    Verbs of the relation become their lemmas (lemmas: form, lemma; others stay), `be` is left out of relations of several words, relations of more than
    `most` words are dropped. An entity of a single word must be a noun (nouns: form). Triples that lose a part are dropped.
    """
    slots = ("subj", "rel", "obj")
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"), F.lit(0))
    each = raw.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), words(F.col(s)).alias("w")) for s in slots])).alias("p")).select("id", "p.slot", F.size("p.w").alias("n"), F.posexplode("p.w").alias("i", "form"))
    each = each.join(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma")), "form", "left").join(nouns.select("form").distinct().withColumn("noun", F.lit(True)), "form", "left")
    each = each.withColumn("word", F.when(F.col("slot") == "rel", F.coalesce("lemma", "form")).otherwise(F.col("form")))
    kept = each.where((F.col("slot") != "rel") | ((F.col("n") <= most) & ((F.col("n") == 1) | (F.col("word") != "be"))))
    kept = kept.where((F.col("slot") == "rel") | (F.col("n") > 1) | F.col("noun"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    parts = kept.groupBy("id", "slot").agg(text.alias("t"))
    whole = parts.groupBy("id").agg(*[F.max(F.when(F.col("slot") == s, F.col("t"))).alias(s) for s in slots])
    return whole.where("subj is not null and rel is not null and obj is not null")


def replaced_equations(tokens: DataFrame, formulas: DataFrame) -> DataFrame:
    """(doc, sent, idx, form) with the tokens that are tags of formulas (tag, words array<string>) replaced by the words of the formula, and all indexes moved on.

    A token's shift is the number of words that the formulas before it in its sentence add.
    """
    rows = tokens.select(*SENTENCE, "idx", "form").join(formulas.select(F.col("tag").alias("form"), "words"), "form", "left")
    words = F.coalesce("words", F.array("form"))
    before = W.Window.partitionBy(*SENTENCE).orderBy("idx").rowsBetween(W.Window.unboundedPreceding, -1)
    moved = rows.select(*SENTENCE, "idx", words.alias("w")).withColumn("shift", F.coalesce(F.sum(F.size("w") - 1).over(before), F.lit(0)))
    return moved.select(*SENTENCE, "idx", "shift", F.posexplode("w").alias("k", "form")).select(*SENTENCE, (F.col("idx") + F.col("shift") + F.col("k")).cast("int").alias("idx"), "form")


def shifted(deps: DataFrame, tokens: DataFrame, formulas: DataFrame) -> DataFrame:
    """Dependencies with the indexes of `replaced_equations`; a formula is met at its first word."""
    rows = tokens.select(*SENTENCE, "idx", "form").join(formulas.select(F.col("tag").alias("form"), F.size("words").alias("n")), "form", "left")
    before = W.Window.partitionBy(*SENTENCE).orderBy("idx").rowsBetween(W.Window.unboundedPreceding, -1)
    at = rows.select(*SENTENCE, "idx", (F.col("idx") + F.coalesce(F.sum(F.coalesce("n", F.lit(1)) - 1).over(before), F.lit(0))).cast("int").alias("new"))
    out = deps
    for end in ("gov", "dep"):
        moved = at.select(*SENTENCE, F.col("idx").alias(end), F.col("new").alias(f"new_{end}"))
        out = out.join(moved, [*SENTENCE, end], "left")
    return out.select(*SENTENCE, "rel", F.coalesce("new_gov", "gov").alias("gov"), F.coalesce("new_dep", "dep").alias("dep"))


def latex(formula: Column) -> Column:
    """A formula without dollar signs, spacing commands, sizes and fonts, its white space collapsed."""
    t = F.regexp_replace(formula, r"^\$+|\$+$", "")
    t = F.regexp_replace(t, r"\\(?:left|right|big|Big|bigg|Bigg|displaystyle|limits|nonumber)(?![A-Za-z])", "")
    t = F.regexp_replace(t, r"\\(?:mathrm|mathbf|mathit|mathcal|text|boldsymbol|rm|bf|it)(?![A-Za-z])\s*", "")
    t = F.regexp_replace(t, r"\\[,;:! ]|\\q?quad(?![A-Za-z])|~", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def symbol(token: Column) -> Column:
    """struct(symbol, type) of `symbol_TYPE`; without an underscore the type is null."""
    return F.struct(F.when(token.contains("_"), F.regexp_extract(token, r"^(.*)_[^_]*$", 1)).otherwise(token).alias("symbol"), F.when(token.contains("_"), F.regexp_extract(token, r"_([^_]*)$", 1)).alias("type"))
