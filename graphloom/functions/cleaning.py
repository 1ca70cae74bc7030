"""Text cleaning as chains of replacements, for columns and for SQL alike."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, str]]

# What each cleaner replaces, in this order; \1 is the first group
PARAGRAPH: Rules = [
    (r"\n", ""),
    (r"\x{00A0}", " "),
    (r"\s*\[[1-9][0-9,–\-\s]*\]", ""),
    (r"\s*\(.+?[12][0-9]{3}\)", ""),
    (r"[0-9]{1,3}(?:,\s[0-9]{1,3})+", ""),
    (r"^\(.+?\)[.\s]*", ""),
    (r"\([ivx]+?\)\s*", ""),
    (r"([a-z])[0-9]+", r"\1"),
    (r"\(\)[\s,]*", ""),
    (r"\[\][\s,]*", ""),
    (r"\.\s\.\s\.", "..."),
    (r"^\s+|\s+$", ""),
]
ARTICLE: Rules = [
    (r"\(cid:\d+\)", " "),
    (r"\[\d+(?:,\s*\d+)*\]", " NumericCitation "),
    (r"(?:http|ftp|https)://[-a-zA-Z0-9@:%._+~#=/?&]+", " "),
    (r"[A-Z][A-Za-z'’-]+(?:,? (?:and |& )?[A-Z][A-Za-z'’-]+| et al\.?)*,? \(?(?:19|20)[0-9][0-9][a-z]?\)?", " Citation "),
    (r"\((?:\s*;+\s*)+\)", " "),
    (r"\(e\.g\.[\s;]*,*\s*\)", " "),
    (r"Click here[^.]*\.", " "),
    (r"[\w.-]+@[\w.-]+", " "),
    (r"\(\s*\)", " "),
    (r"\(see\s*\)", " "),
    (r"a r X i v[^a-zA-Z]*", " "),
    (r"^(?:\s?.?\s)+v i X r a", " "),
]
QUERY: Rules = [
    (r"^\s+|\s+$", ""),
    (r"[“”]", '"'),
    (r"[‘’`]", "'"),
    (r"^[\"']+|[\"']+$", ""),
    (r"^.*\"", ""),
    (r"^.*NumericCitation", ""),
    (r"^.*[.!?]\s+", ""),
    (r"^[^a-zA-Z(]+", ""),
    (r"^(?:\(.*\))?\W+", ""),
    (r"\s+([)\]}.,?!])", r"\1"),
    (r"([(\[{])\s+", r"\1"),
]
QUESTION: Rules = [
    (r"^\(?[a-zA-Z0-9.\-]+\)\)?,?\s*", ""),
    (r"^[0-9.\s\-]+\s*", ""),
    (r"^\*\s*", ""),
    (r"^[a-zA-Z]+\.\s+", ""),
    (r"^P[0-9]{1,3}\s*", ""),
    (r"\s*(?:Numeric)?Citation*", ""),
    (r"\s*\?$", "?"),
    (r"^[^a-zA-Z]*([a-zA-Z])", r"\1"),
]
HEADING = "conclusions|conclusion|methods|results|background|abstract|objective|discussion"
ABSTRACT: Rules = [
    (r"\n+", " "),
    (r"\$.+\$", ""),
    (r"\\\w", "variable"),
    (r"\s+", " "),
    (rf"^\s*(?i:(?:{HEADING})+)\s*", ""),
    (rf"([.!?]) (?i:(?:{HEADING})+)\s*", r"\1 "),
    (r"^\s+|\s+$", ""),
]
DOCUMENT: Rules = [
    (r"[‘’]", "'"),
    (r"[“”]", '"'),
    (r"\(\)[\s,]*", ""),
    (r"\[\][\s,]*", ""),
    (r"\.\s\.\s\.", "..."),
    (r"\n+", " "),
    (r"\s+", " "),
]
TRIPLE: Rules = [
    (r"[()\"‘,.%{}`\\:\[\]“•]+", ""),
    (r"^(?:[-—–]|’s|’)\s?", ""),
    (r"^\s+|\s+$", ""),
]
DETOKENISE: Rules = [
    (r"-LRB-", "("),
    (r"-RRB-", ")"),
    (r"-LSB-", "["),
    (r"-RSB-", "]"),
    (r"\s+([.,;:!?%)\]])", r"\1"),
    (r"([(\[])\s+", r"\1"),
    (r" (n't|'s|'re|'ve|'ll|'d|'m)\b", r"\1"),
]


def chain(text: Column, rules: Rules) -> Column:
    return functools.reduce(lambda t, r: F.regexp_replace(t, F.lit(r[0]), F.lit(r[1].replace("\\1", "$1"))), rules, text)


def chain_sql(text: str, rules: Rules) -> str:
    """The same chain in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return functools.reduce(lambda t, r: f"regexp_replace({t}, {quote(r[0])}, {quote(r[1])}, 'g')", rules, text)


def paragraph(text: Column) -> Column:
    """A cleaned paragraph; null if it does not begin with what equals its capital, or begins with `click`."""
    t = chain(text, PARAGRAPH)
    first = F.substring(t, 1, 1)
    ok = (t != "") & (first == F.upper(first)) & ~F.lower(t).startswith("click")
    return F.when(ok, F.when(t.endswith(":"), F.concat(F.left(t, F.char_length(t) - 1), F.lit("."))).otherwise(t))


def sponsors(text: Column) -> Column:
    """Without what follows `This work was supported` on its line, where that stands in the second half."""
    at = F.instr(text, "This work was supported")
    tail = F.regexp_replace(F.substring(text, F.greatest(at, F.lit(1)), F.lit(2**31 - 1)), "This work was supported.+", " ")
    return F.when(at - 1 > F.char_length(text) / 2, F.concat(F.left(text, at - 1), tail)).otherwise(text)


def query(text: Column, least: float = 2.0) -> Column:
    """A question cut out of its surroundings, with a capital and a question mark; null if words are shorter than `least` on average."""
    t = chain(text, QUERY)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    mean = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.char_length(w)) / F.size(words)
    marked = F.when(t.endswith("?"), t).otherwise(F.concat(t, F.lit("?")))
    return F.when((t != "") & (mean >= least), capital(marked))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def without(text: Column, literals: Column) -> Column:
    """A text without any of the literals, which are taken away one after the other; null and empty ones do nothing."""
    return F.aggregate(F.filter(F.coalesce(literals, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), text, lambda t, x: F.replace(t, x, F.lit("")))


def template(dep: Column, rel: Column, arg: Column) -> Column:
    """What asks for an argument: `What does ARG REL?`, `What RELs ARG?`, or the three parts."""
    return F.when(dep == "nsubj", F.format_string("What does %s %s?", arg, rel)).when(dep == "dobj", F.format_string("What %ss %s?", rel, arg)).otherwise(F.concat_ws(" ::: ", rel, dep, arg))


def node_id(article: Column, sentence: Column, token: Column) -> Column:
    """article:sentence:token, the token with three digits at least."""
    return F.concat_ws(":", article.cast("string"), sentence.cast("string"), F.when(token < 1000, F.lpad(token.cast("string"), 3, "0")).otherwise(token.cast("string")))


def node_parts(node: Column) -> Column:
    """struct(article, sentence, token) of a node's id; an article may hold colons."""
    return F.struct(
        F.regexp_extract(node, r"^(.*):[^:]*:[^:]*$", 1).alias("article"),
        F.regexp_extract(node, r":([^:]*):[^:]*$", 1).try_cast("int").alias("sentence"),
        F.regexp_extract(node, r":([^:]*)$", 1).try_cast("int").alias("token"),
    )


def rejoined(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, text): words cut by a hyphen and a space are joined; the hyphen stays only where both parts are words (token) and the whole is none.

    A text's own cuts are few; the vocabulary is joined by equal words, never sent around.
    """
    cuts = docs.where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+- [A-Za-z]+"), F.lit(0)))).alias("cut"))
    left, right = F.split("cut", "- ")[0], F.split("cut", "- ")[1]
    known = vocabulary.select("token").distinct()
    each = cuts.select("doc_id", "cut", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lower(w).alias("token")) for k, w in (("whole", F.concat(left, right)), ("left", left), ("right", right))])).alias("w"))
    found = each.select("doc_id", "cut", "w.k", "w.token").join(known.withColumn("yes", F.lit(1)), "token", "left")
    has = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("yes"))), F.lit(0)) == 1
    kept = found.groupBy("doc_id", "cut").agg((~has("whole") & has("left") & has("right")).alias("keep"))
    fixes = kept.select("doc_id", F.struct("cut", F.when(F.col("keep"), F.replace("cut", F.lit(" "), F.lit(""))).otherwise(F.replace("cut", F.lit("- "), F.lit(""))).alias("fix")).alias("f"))
    fixes = fixes.groupBy("doc_id").agg(F.array_sort(F.collect_list("f")).alias("fixes"))
    fixed = F.aggregate(F.coalesce("fixes", F.array().cast("array<struct<cut:string,fix:string>>")), F.col("text"), lambda t, f: F.replace(t, f["cut"], f["fix"]))
    return docs.select("doc_id", "text").join(fixes, "doc_id", "left").select("doc_id", fixed.alias("text"))
