"""P7: text garbled by a wrong character encoding, found by character pairs and restored by inverse mappings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (decoder that was used wrongly, encoding of the bytes)
MAPPINGS = [
    *((wrong, "utf-8") for wrong in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250", "cp1254", "cp1256", "cp874", "gbk", "shift_jis", "big5")),
    *((wrong, right) for wrong in ("cp1252", "latin-1", "mac_roman", "cp437") for right in ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1256", "gbk", "shift_jis", "euc_jp", "big5", "euc_kr", "cp874", "cp1253", "cp1250")),
    *((wrong, right) for wrong in ("cp1251", "koi8_r", "cp866", "iso8859_5") for right in ("cp1251", "koi8_r", "cp866", "iso8859_5", "cp1252") if wrong != right),
    *((wrong, "cp1252") for wrong in ("mac_roman", "cp437", "cp850", "cp1250", "cp1253", "cp1256")),
    *(("cp1252", right) for right in ("mac_roman", "cp437", "cp850")),
    ("latin-1", "cp1252"),
]
MAPPINGS = list(dict.fromkeys(MAPPINGS))
WRONG = list(dict.fromkeys(wrong for wrong, _ in MAPPINGS))
HOMOGLYPHS = frozenset("аеорсухіѕԁɑ")
MAX_PAIRS = 2_000_000  # classes of characters squared; far above what scripts with letters need
NEVER = regex.compile(r"[�\u0080-\u009F-]")
FOREIGN = regex.compile(r"[^\x00-\x7f]")
TOKENS = regex.compile(r"[^ \n\r\t]*[^\x00-\x7f][^ \n\r\t]*")
ISLAND = regex.compile(r"[^\x00-\x7f]+")
DISTRUST = regex.compile(
    r"[�\u0080-\u009F-─-▟]|\p{Latin}(?=\p{Cyrillic})|\p{Cyrillic}(?=\p{Latin})|\p{L}(?=[¡-ª¬-º¼-¿€√∂∏∫≠≤≥÷×])"
    r"|[¡-©¬-¯±-´¶-¹¼-¾](?=\p{Ll})|(?![\x00-\x7f])\p{Ll}(?=(?![\x00-\x7f])\p{Lu})|[ÂÃÐÑâ](?=[^\x00-\x7fÀ-ÿ])|[À-ÿ]{3}"
)


def _class(c: str) -> str:
    o = ord(c)
    if o < 128:
        return "0" if c.isdigit() else c
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or o > 0x20000:
        return "一"
    if 0x3041 <= o <= 0x309F:
        return "あ"
    if 0x30A0 <= o <= 0x30FF:
        return "ア"
    if 0xAC00 <= o <= 0xD7AF:
        return "가"
    return c


class _Classes(dict):
    def __missing__(self, o: int) -> str:
        self[o] = c = _class(chr(o))
        return c


_CLASSES = _Classes()


def classes(text: str) -> str:
    return text.translate(_CLASSES)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pairs: Counter = Counter()
        for text in pdf["text"]:
            if DISTRUST.search(text):
                continue
            s = classes(f" {text} ")
            pairs.update(map(str.__add__, s, s[1:]))
        yield pd.DataFrame({"pair": list(pairs), "n": list(pairs.values())}).astype({"n": "int64"})


UTF8 = 5.0  # bits by which UTF-8 is more likely to be the right encoding than any other, where the bytes allow both
WITHIN = {"一": 10.0, "あ": 5.0, "ア": 5.5, "가": 10.0}  # bits that tell a character within its class


class Model:
    """Mutual information of adjacent characters, and log2 p(b | a), from counts over the corpus."""

    PRIOR, LEAST = 0.01, 2.0**-12  # part of all characters that is spread evenly over the alphabet; ratio of p(ab) and p(a) p(b) of a pair never seen

    def __init__(self, counts: dict[str, int]):
        self.pairs = counts
        self.total = sum(counts.values()) + 1
        self.first: Counter = Counter()
        for pair, n in counts.items():
            self.first[pair[0]] += n
        self.known = {c for c, n in self.first.items() if n >= 3}
        self.even = self.PRIOR * self.total / max(1, len(self.first))
        self.likes: dict[str, float] = {}
        self.scores: dict[str, float] = {}

    def sure(self, ab: str) -> float:
        """The count two deviations below what was seen, so that the garbled fields among the counted ones vouch for nothing."""
        joint = self.pairs.get(ab, 0)
        return max(0.0, joint - 2 * joint**0.5)

    def info(self, ab: str) -> float:
        """log2 p(ab) / (p(a) p(b))."""
        joint = self.sure(ab)
        return math.log2(joint * self.total / ((self.first.get(ab[0], 0) + self.even) * (self.first.get(ab[1], 0) + self.even)) + self.LEAST)

    def score(self, ab: str) -> float:
        """Above zero for pairs whose mutual information lies below -6 bits, as it hardly does in sound text."""
        if ab not in self.scores:
            sound = 2.0 if ab[0] < "\x80" and ab[1] < "\x80" else 0.7
            self.scores[ab] = max(-sound, min(2.0, (-6 - self.info(ab)) / 3))
        return self.scores[ab]

    def like(self, ab: str) -> float:
        """log2 p(b | a); pairs and characters never seen get what half a sight would."""
        if ab not in self.likes:
            pb = (self.first.get(ab[1], 0) + 0.05) / self.total
            self.likes[ab] = math.log2((self.sure(ab) + 2 * pb) / (self.first.get(ab[0], 0) + 2))
        return self.likes[ab]

    def likelihood(self, text: str) -> float:
        if text.isupper():
            text = text.lower()  # capitals are rarer, not less sound
        s = classes(text)
        return sum(map(self.like, map(str.__add__, s, s[1:]))) - sum(WITHIN.get(c, 0) for c in s)

    def improbable(self, text: str, least: float = 2.0) -> list[tuple[int, int]]:
        """Maximum-scoring segments of the pairs, scored by their mutual information."""
        s = classes(text)
        pairs = list(map(str.__add__, s, s[1:]))
        if max(map(self.score, set(pairs)), default=0.0) <= 0:
            return []
        out, best, total, begin, end = [], 0.0, 0.0, 0, 0
        for i, score in enumerate(map(self.scores.__getitem__, pairs)):
            if total <= 0:
                if best >= least:
                    out.append((begin, end))
                best, total, begin = 0.0, 0.0, i
            total += score
            if total > best:
                best, end = total, i + 2
        if best >= least:
            out.append((begin, end))
        return out


def _raw(text: str, wrong: str) -> bytes | None:
    """The bytes which `wrong` decoded; None if there are none."""
    try:
        return text.encode(wrong)
    except UnicodeEncodeError:
        if wrong not in ("cp1252", "cp1254"):
            return None
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode(wrong)
        except UnicodeEncodeError:
            if ord(c) >= 256:
                return None
            raw.append(ord(c))  # bytes without a character pass as controls
    return bytes(raw)


def inverse(text: str, wrong: str, right: str) -> str | None:
    """The text that `right` gives for the bytes which `wrong` decoded; None if there are none."""
    raw = _raw(text, wrong)
    try:
        return None if raw is None else raw.decode(right)
    except UnicodeDecodeError:
        return None


def _best(model: Model, text: str, a: int, b: int, trusted: frozenset = frozenset()) -> tuple[float, str, tuple[str, str]] | None:
    """The mapping of text[a:b] that gains most, with the gain in bits."""
    piece = text[a:b]
    left, right_ = text[max(0, a - 1) : a] or " ", text[b : b + 1] or " "
    before = model.likelihood(left + piece + right_)
    if before > -4.5 * (len(piece) + 1) and model.known.issuperset(classes(piece)):
        return None
    if piece in HOMOGLYPHS:
        return None  # a lone letter of similar look is a misreading
    top = 0.0
    best, lone = None, len(FOREIGN.findall(piece)) == 1  # a single byte may be read as anything, unless the mapping is at home in the text
    raws = {wrong: _raw(piece, wrong) for wrong in WRONG}
    seen: set[str] = set()
    for mapping in MAPPINGS:
        raw = raws[mapping[0]]
        try:
            fixed = None if raw is None else raw.decode(mapping[1])
        except UnicodeDecodeError:
            continue
        if fixed is None or fixed == piece or NEVER.search(fixed) and not NEVER.search(piece) or "\x00" in fixed:
            continue
        twice = _twice(fixed)
        for f in {fixed, twice} - seen:
            seen.add(f)
            strange = set(classes(f)) - model.known
            if len(strange) > 0.2 * len(f):
                continue
            gain = model.likelihood(left + f + right_) - before - (7.0 if lone and mapping[1] != "utf-8" and mapping not in trusted else 0.0)
            rank = gain + (UTF8 if mapping[1] == "utf-8" else 0.0)
            if best is None or rank > top:
                best, top = (gain, f, mapping), rank
    return best


def _twice(text: str) -> str:
    for wrong in ("cp1252", "latin-1"):
        again = inverse(text, wrong, "utf-8")
        if again is not None and again != text:
            return again
    return text


def _fixes(model: Model, text: str, segments: list[list[int]], margin: float, trusted: frozenset) -> list[tuple[int, int, str, tuple[str, str]]]:
    fixes = []
    for a, b in segments:
        found = _best(model, text, a, b, trusted) if FOREIGN.search(text, a, b) else None
        if found and found[0] >= margin and found[0] >= 0.5 * len(ISLAND.findall(text[a:b])):
            fixes.append((a, b, *found[1:]))
            continue
        for m in TOKENS.finditer(text, a, b):
            found = _best(model, text, m.start(), m.end(), trusted)
            if found and found[0] >= margin:
                fixes.append((m.start(), m.end(), *found[1:]))
                continue
            for i in ISLAND.finditer(text, m.start(), m.end()):
                found = _best(model, text, i.start(), i.end(), trusted)
                if found and found[0] >= margin:
                    fixes.append((i.start(), i.end(), *found[1:]))
    return fixes


def restore(model: Model, text: str, margin: float = 7.0) -> tuple[str, list[tuple[int, int, str]]]:
    """(restored text, replaced runs as start, end, replacement).

    Only segments of improbable pairs are tried, widened to the words they touch; first the whole run, then each
    word, then each island of foreign characters. Mappings that were found are trusted with single characters in a second pass.
    """
    if not FOREIGN.search(text):
        return text, []
    segments = []
    for a, b in model.improbable(text):
        a = max(text.rfind(" ", 0, a + 1), text.rfind("\n", 0, a + 1)) + 1
        ends = [x for x in (text.find(" ", b - 1), text.find("\n", b - 1)) if x >= 0]
        b = min(ends, default=len(text))
        if segments and a <= segments[-1][1] + 1:
            segments[-1][1] = max(b, segments[-1][1])
        elif FOREIGN.search(text, a, b):
            segments.append([a, b])
    fixes = _fixes(model, text, segments, margin, frozenset())
    if fixes:
        fixes = _fixes(model, text, segments, margin, frozenset(f[3] for f in fixes))
    fixes = [f[:3] for f in fixes]
    out, at = [], 0
    for a, b, f in fixes:
        out += [text[at:a], f]
        at = b
    return "".join([*out, text[at:]]), fixes


def fields(papers: DataFrame) -> DataFrame:
    """(article_id, field, text) of the titles and abstracts there are."""
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "abstract")]))
    rows = papers.where("article_id is not null").select("article_id", parts.alias("p")).select("article_id", "p.field", "p.text")
    return rows.where("text is not null and text <> '**NONE**'")


def pair_counts(texts: DataFrame) -> dict[str, int]:
    """Counts of adjacent character classes over all fields, at most MAX_PAIRS of them.

    Fields with signs of garbling are not counted. Letters of large scripts are one class each, so the table is bounded by the alphabets, not by the data.
    """
    rows = texts.select("text").mapInPandas(_count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    found = rows.limit(MAX_PAIRS + 1).collect()
    if len(found) > MAX_PAIRS:
        raise ValueError("more character pairs than any set of alphabets gives")
    return {r["pair"]: r["n"] for r in found}


def restored(papers: DataFrame) -> DataFrame:
    """(article_id, field, garbled, restored): every title and abstract that is there.

    garbled tells whether some characters came from a wrong decoding; restored is the text as far as it
    can be had back. Null and `**NONE**` fields are left out; an empty table gives no rows.
    """
    rows = fields(papers)
    shared = papers.sparkSession.sparkContext.broadcast(pair_counts(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for pdf in batches:
            flags, texts = [], []
            for text in pdf["text"]:
                fixed, fixes = restore(model, text)
                flags.append(bool(fixes) or bool(NEVER.search(text)))
                texts.append(fixed)
            yield pd.DataFrame({"article_id": pdf["article_id"], "field": pdf["field"], "garbled": flags, "restored": texts})

    return rows.mapInPandas(run, "article_id bigint, field string, garbled boolean, restored string")
