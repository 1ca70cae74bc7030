"""P5: noise in text from scanned pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.llm.garbled import fields

# What stands on the page, what the scanner reads, and the cost of that reading
CONFUSIONS = [
    ("e", "c", 1.0), ("m", "rn", 1.0), ("d", "cl", 1.0), ("h", "li", 1.0), ("t", "f", 1.2), ("t", "l", 1.2), ("u", "ii", 1.0),
    ("g", "q", 1.2), ("o", "0", 0.5), ("l", "1", 0.5), ("i", ";", 0.5), ("a", "ɑ", 0.3), ("n", "ri", 1.2), ("w", "vv", 1.0),
    ("i", "1", 0.6), ("s", "5", 0.6), ("b", "6", 0.8), ("i", "l", 1.6), ("rn", "m", 1.4), ("cl", "d", 1.4), ("ri", "n", 1.6), ("c", "e", 1.4),
]
WORD = r"\p{L}(?:[\p{L}\p{M}0156;]*\p{L})?"
STRONG = regex.compile(r"(?<=\p{Latin})[01](?=\p{Ll})|(?<=\p{Ll})[01](?=\p{Latin})|(?<=\p{Latin});(?=\p{Ll})|ɑ")
STRONG_JVM = r"\p{IsLatin}[01]\p{Ll}|\p{Ll}[01]\p{IsLatin}|\p{IsLatin};\p{Ll}|ɑ"
CUT_WORD = regex.compile(r"(\p{L})(?:[-­‐]|¬) ?\r?\n\s*(?=\p{L})")
EOL = regex.compile(r"\r\n|[\n\r\f]")
SMALL = frozenset("of on the and for in to a an de la le les des du el los las der die das und für et al y da do e".split())
PAGE = regex.compile(r"^[-–—\[(\s]*(?:\d{1,4}|[ivxlc]{2,7}|[IVXLC]{2,7})[-–—\])\s]*$|^(?:Page|Seite|Página|p\.)\s+\d+(?:\s+(?:of|von|de|sur|/)\s+\d+)?$", regex.I)
SHORT_HEAD = regex.compile(r"^\p{Lu}[\p{L}'’-]+ et al\.?$|^vol\.?\s*\d+,?\s*(?:no|nr|n°|iss)\.?\s*\d+$", regex.I)


def is_header(line: str, usual: int) -> bool:
    """Whether a line among wrapped lines is a running header or page number; usual is the lines' usual length."""
    s = line.strip()
    if not s:
        return False
    if PAGE.match(s) or SHORT_HEAD.match(s):
        return True
    m = regex.match(r"^(?:(\d{1,4})\s+)?(.*?)(?:(\s{2,})\d{1,4})?$", s)
    number, body, gap = m[1], m[2], m[3]
    if gap and body and len(s) < 1.3 * usual:
        return True
    if number and SHORT_HEAD.match(body):
        return True
    words = regex.findall(r"[\p{L}’'-]+", body)
    letters = [c for c in body if c.isalpha()]
    if len(letters) >= 6 and not any(c.islower() for c in letters) and any(c.isupper() for c in letters) and len(words) >= 2:
        return True
    named = [w for w in words if w.lower() not in SMALL]
    titled = len(named) >= 2 and all(w[0].isupper() for w in named) and not regex.search(r"[.,;:!?]", body)
    return titled and (bool(number) or len(words) >= 3 and len(s) < 0.85 * usual and any(w.lower() in SMALL for w in words))


def page_lines(text: str) -> list[int]:
    """Indexes of the lines that are running headers or page numbers."""
    lines = EOL.split(text)
    full = sorted(len(x) for x in lines if x.strip())
    if len(full) < 2:
        return []
    usual = full[3 * len(full) // 4]
    if usual > 140:
        return []  # paragraphs, not the lines of a page
    return [i for i, x in enumerate(lines) if is_header(x, usual)]


def flowing(text: str) -> tuple[str, bool]:
    """(text in continuous paragraphs, whether it had traces of lines and pages)."""
    if not EOL.search(text):
        return text, False
    drop = set(page_lines(text))
    lines = EOL.split(text)
    if drop:
        kept = []
        for i, x in enumerate(lines):
            beside = i - 1 in drop or i + 1 in drop
            if i not in drop and (x.strip() or not beside):
                kept.append(x)
        lines = kept
    joined = "\n".join(lines)
    traces = bool(drop) or bool(CUT_WORD.search(joined)) or bool(CUT_WORD.search(text))
    joined = CUT_WORD.sub(r"\1", joined)
    widths = [len(x) for x in lines if x.strip()]
    if traces or widths and max(widths) <= 100 and len(widths) > 2:
        joined = regex.sub(r"(?<!\n)\n(?!\n)", " ", joined)
    return joined, traces


def _flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [flowing(t) for t in pdf["text"]]
        strong = [bool(STRONG.search(t)) for t, _ in done]
        yield pd.DataFrame({"article_id": pdf["article_id"], "field": pdf["field"], "text": [t for t, _ in done], "traces": [x for _, x in done], "strong": strong})


# a misread letter outside the list, a lost or an added one; neighbours that changed places; the dearest repair
OTHER, SWAP, DEAREST = 2.0, 1.8, 2.6
PREFIX = 7  # deletions are made in so many first characters; what follows is compared
NATS, SURE, STRANGE = 3.0, 1.8, 7.0  # a unit of cost; evidence a repair needs; what a character that words do not have tells
RATIO = 5  # a repair is so many times as frequent at least
BUCKETS = 1 << 18


def deletions(word: str, most: int) -> set[str]:
    """The first characters of the word with up to `most` of them deleted."""
    out = {word[:PREFIX]}
    last = out
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def cost(page: str, reading: str, other: float = OTHER, swap: float = SWAP) -> float:
    """Weighted edit distance: what it takes to read the word of the page so, confusions of the list being cheap."""
    n, m = len(page), len(reading)
    d = [[float("inf")] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > DEAREST:
                continue
            if i < n and j < m:
                step = here + (0.0 if page[i] == reading[j] else other)
                d[i + 1][j + 1] = min(d[i + 1][j + 1], step)
                if page[i : i + 2] == reading[j : j + 2][::-1] and i + 1 < n:
                    d[i + 2][j + 2] = min(d[i + 2][j + 2], here + swap)
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], here + other)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], here + other)
            for p, r, c in CONFUSIONS:
                if page.startswith(p, i) and reading.startswith(r, j):
                    d[i + len(p)][j + len(r)] = min(d[i + len(p)][j + len(r)], here + c)
    return d[n][m]


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(w, n, most, key) for w, n, most in zip(pdf["word"], pdf["n"], pdf["most"]) for key in deletions(w, most)]
        yield pd.DataFrame(rows, columns=["word", "n", "most", "key"]).astype({"n": "int64"})


def _costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pdf.assign(cost=[cost(b, w) for b, w in zip(pdf["better"], pdf["word"])])
        out = out[out["cost"] <= DEAREST]
        yield out.assign(alike=[cost(b, w, DEAREST + 1, DEAREST + 1) <= DEAREST for b, w in zip(out["better"], out["word"])])


def candidates(words: DataFrame) -> DataFrame:
    """(word, n, better, m, cost, alike): possible repairs by a symmetric-delete index, at a weighted edit distance of DEAREST at most.

    words has word, n (fields that hold it) and lower (whether it ever stands in lower case). Both the words of the
    corpus and their readings are entered with up to two characters deleted, any of them (names, which are many and rare, and words of three letters with one), and
    meet where these agree. A repair is RATIO times as frequent at least. It is alike if confusions of the list alone lead to the reading.
    """
    latin = words.where(F.col("word").rlike(r"\p{IsLatin}") & (F.char_length("word") >= 3) & (F.char_length("word") <= 40))
    odd = F.col("word").rlike("[0-9;ɑ]")
    most = F.when((F.char_length("word") >= 4) & (F.col("lower") | odd), 2).otherwise(1).alias("most")
    schema = "word string, n bigint, most int, key string"
    pages = latin.where((F.col("n") >= RATIO) & ~odd).select("word", "n", most).mapInPandas(_keys, schema).select(F.col("word").alias("better"), F.col("n").alias("m"), F.xxhash64("key").alias("key"))
    reads = latin.select("word", "n", most).mapInPandas(_keys, schema).select("word", "n", F.xxhash64("key").alias("key"))
    met = reads.join(pages, "key").where(f"m >= {RATIO} * n and word <> better").where((F.levenshtein("word", "better", 4) >= 0) & (F.abs(F.char_length("word") - F.char_length("better")) <= 2))
    return met.select("word", "n", "better", "m").distinct().mapInPandas(_costs, "word string, n bigint, better string, m bigint, cost double, alike boolean")


def _some(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose column may be among the wanted: a filter of at most BUCKETS rows, whatever the data, that spares the others the shuffle."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
    return rows.join(F.broadcast(wanted.select(bucket(column).alias("bucket")).distinct()), bucket(F.col(column)) == F.col("bucket"), "left_semi")


def repairs(flow: DataFrame) -> DataFrame:
    """(article_id, field, word, better, alike, evidence): the repair of each misread word.

    The evidence for a repair is the logarithm of how much more frequent it is, the mutual information with the
    words before and after, and what the cost of the confusion takes away; only ratios of counts enter, so a
    corpus of any size is judged alike.
    """
    tokens = flow.select("article_id", "field", F.expr(f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)").alias("w"))
    each = tokens.select("article_id", "field", F.explode(F.array_distinct("w")).alias("t"))
    words = cut(each.groupBy(F.lower("t").alias("word")).agg(F.count("*").alias("n"), F.bool_or(F.col("t").rlike(r"^\p{Ll}")).alias("lower")))
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    options = cut(candidates(words))
    low = tokens.select("article_id", "field", F.transform("w", lambda x: F.lower(x)).alias("w")).where("size(w) > 0")
    around = F.transform("w", lambda x, i: F.struct(F.get("w", i - 1).alias("prev"), x.alias("word"), F.get("w", i + 1).alias("next")))
    each = low.select("article_id", "field", F.explode(around).alias("a")).select("article_id", "field", "a.*")
    suspects = options.groupBy("word").agg(F.collect_list(F.struct("better", "n", "m", "cost", "alike")).alias("o"))  # a word has few neighbours at this distance
    seen = cut(_some(each, "word", suspects).join(suspects, "word").select("article_id", "field", "word", "prev", "next", F.explode("o").alias("o")).select("article_id", "field", "word", "prev", "next", "o.*"))
    ways = F.array(F.struct(F.col("prev").alias("x"), F.col("better").alias("y"), F.col("prev").alias("other")), F.struct(F.col("better").alias("x"), F.col("next").alias("y"), F.col("next").alias("other")))
    asked = seen.select("article_id", "field", "word", "better", "n", "m", "cost", "alike", F.explode(ways).alias("p")).select("article_id", "field", "word", "better", "n", "m", "cost", "alike", "p.*")
    pair = F.concat_ws(" ", "x", "y")
    wanted = asked.where("other is not null").select(pair.alias("pair"), "other").distinct()
    pairs = low.select(F.explode(F.transform(F.slice("w", 2, 2**30), lambda y, i: F.concat_ws(" ", F.get("w", i), y))).alias("pair"))
    counted = _some(pairs, "pair", wanted).join(wanted.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(F.count("*").alias("c"))
    often = words.select(F.col("word").alias("other"), F.col("n").alias("f"))
    known = wanted.join(counted, "pair").join(often, "other").select("pair", "other", F.log(1 + F.col("c") * total / F.col("f")).alias("info"))
    info = F.coalesce(F.greatest(F.col("info") - F.log("m"), F.lit(0.0)), F.lit(0.0))
    rated = asked.withColumn("pair", pair).join(known, ["pair", "other"], "left").groupBy("article_id", "field", "word", "better", "n", "m", "cost", "alike").agg(F.sum(info).alias("info"))
    evidence = F.log(F.col("m") / F.col("n")) + F.col("info") - NATS * F.col("cost") + F.when(F.col("word").rlike(STRONG_JVM), STRANGE).otherwise(0.0)
    told = rated.withColumn("evidence", evidence).where(F.col("evidence") >= SURE)
    best = F.max_by(F.struct("better", "alike", "evidence"), F.struct("evidence", "better")).alias("r")
    return told.groupBy("article_id", "field", "word").agg(best).select("article_id", "field", "word", "r.better", "r.alike", "r.evidence")


def flows(papers: DataFrame) -> DataFrame:
    return fields(papers).mapInPandas(_flow, "article_id bigint, field string, text string, traces boolean, strong boolean")


def scanned(papers: DataFrame) -> DataFrame:
    """(article_id, field) of titles and abstracts with a word cut at a line end, misread letters, or a header or page number among the lines.

    Misread words are those for which the index has a repair of similar look, and those with a character that words do not have. Null
    and `**NONE**` fields are no case; an empty table gives no rows.
    """
    flow = cut(flows(papers))
    return flow.where("traces or strong").select("article_id", "field").unionByName(repairs(flow).where("alike").select("article_id", "field")).distinct()


_PLAIN = {"ɑ": "a", "0": "o", "1": "l", ";": "i"}


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word = regex.compile(WORD)
    for pdf in batches:
        out = []
        for text, pairs in zip(pdf["text"], pdf["pairs"]):
            better = {p["word"]: p["better"] for p in pairs} if pairs is not None else {}

            def fix(m: regex.Match) -> str:
                w = m[0]
                b = better.get(w.lower())
                if b is None:
                    return STRONG.sub(lambda s: _PLAIN[s[0]], w)
                return b.upper() if w.isupper() and len(w) > 1 else b.capitalize() if w[0].isupper() else b

            out.append(word.sub(fix, text))
        yield pd.DataFrame({"article_id": pdf["article_id"], "field": pdf["field"], "text": out})


def repaired(papers: DataFrame) -> DataFrame:
    """(article_id, field, text): the scanned titles and abstracts in continuous paragraphs, without headers and page numbers, misread words repaired.

    In these, words are also repaired whose reading is not among the listed confusions.
    """
    flow = cut(flows(papers))
    pairs = repairs(flow).groupBy("article_id", "field").agg(F.collect_list(F.struct("word", "better")).alias("pairs"), F.bool_or("alike").alias("alike"))
    rows = flow.join(pairs, ["article_id", "field"], "left").where("traces or strong or alike")
    return rows.select("article_id", "field", "text", "pairs").mapInPandas(_apply, "article_id bigint, field string, text string")
