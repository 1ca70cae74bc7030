"""P2: sentence boundaries across languages and scripts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, lower case, without the last full stop.
# never: no sentence ends after them; number: none ends before a number or bracket; end: one ends only before a capital.
ABBREVIATIONS = {
    "en": {
        "never": "dr prof mr mrs ms st mt vs cf e.g i.e approx ca viz messrs rev gen col sen rep gov hon sp spp subsp nov var",
        "number": "fig figs sect sec no nos eq eqs tab ch vol pp p ref refs app jan feb mar apr jun jul aug sept sep oct nov dec al art par ver",
        "end": "etc al inc ltd jr sr co corp esp",
    },
    "de": {
        "never": "dr prof z b d h u a s o vgl ca bzw evtl ggf hr fr sog inkl zzgl insb bspw dipl ing st z.b d.h u.a",
        "number": "abb nr bd tab kap art abs s jan feb mrz apr aug sept okt nov dez",
        "end": "usw etc al ff jh mio mrd",
    },
    "fr": {
        "never": "p ex c.-à-d cf env m mm mme mlle dr pr st ste av p.ex",
        "number": "fig figs no n° vol chap art tab éd pp janv févr avr juil sept oct nov déc",
        "end": "etc coll al",
    },
    "es": {
        "never": "p ej dr dra sr sra srta prof profa ud uds aprox p.ej d dña ee uu cf",
        "number": "fig figs núm pág págs vol cap art tab sec no ene abr ago sept oct nov dic",
        "end": "etc al",
    },
    "pt": {
        "never": "p ex dr dra sr sra prof profa cf aprox p.ex exmo",
        "number": "fig figs núm pág págs vol cap art tab sec n jan fev abr ago set out nov dez",
        "end": "etc al",
    },
    "ru": {
        "never": "т е п см ср напр им проф акад доц гл обл ул т.е т.п",
        "number": "рис табл стр с гл п пп вып",
        "end": "др г гг тыс млн млрд руб в вв пр д",
    },
    "hi": {"never": "डॉ श्री प्रो कु", "number": "सं पृ", "end": ""},
    "ar": {"never": "د أ م ص", "number": "ص", "end": ""},
}
# Frequent function words that tell the language of a Latin text.
FUNCTION_WORDS = {
    "en": "the of and in with was that by from for on is",
    "de": "der die das und für wurden bei von zu ein eine mit war",
    "fr": "le la les des une nous avons chez est du dans par à",
    "es": "el la los las en entre fue una que y del por",
    "pt": "o a os as em entre foi uma que e do da é",
}
GERMAN_MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())
ABBREVIATIONS = {lang: {k: frozenset(v.split()) for k, v in kinds.items()} for lang, kinds in ABBREVIATIONS.items()}
FUNCTION_WORDS = {lang: frozenset(v.split()) for lang, v in FUNCTION_WORDS.items()}

OPEN = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "《": "》", "【": "】", "〈": "〉"}
CLOSE = frozenset(OPEN.values()) | {'"'}
QUOTES = frozenset("“„«「『\"")
# one or more terminators of any script, as Unicode's sentence-break property has them
END = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…]+")
CONTINUES = regex.compile(r"[\p{SB=SContinue}—–;]")
UNCASED = regex.compile(r"\p{SB=OLetter}")
MARKS = regex.compile(r"[“”„«»「」『』()（）\[\]《》【】〈〉\"]")
WORD_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}°][\p{L}\p{M}.°-]*\G")
THAI_GAP = regex.compile(r"(?<=[\p{Thai}])\s+(?=\p{Thai})")
THAI_LATIN = regex.compile(r"(?<=[\p{Thai}])\s+(?=[\"“]?\p{Lu}\p{Ll}*[ ’]\p{Ll})")
PARAGRAPH = regex.compile(r"\s*[\n\u2028\u2029]\s*")
THAI = regex.compile(r"\p{Thai}")


def languages(text: str, declared: str | None = None) -> list[str]:
    """Languages whose abbreviations apply: by script, and among Latin ones by function words; the declared one breaks ties."""
    out = []
    if regex.search(r"\p{Cyrillic}", text):
        out.append("ru")
    if regex.search(r"\p{Devanagari}", text):
        out.append("hi")
    if regex.search(r"\p{Arabic}", text):
        out.append("ar")
    words = regex.findall(r"\p{Latin}+", text.lower())
    if words:
        votes = {lang: sum(w in known for w in words) + 0.5 * (lang == (declared or "").lower()) for lang, known in FUNCTION_WORDS.items()}
        most = max(votes.values())
        out += [lang for lang, n in votes.items() if n > 0.6 * most or lang == "en"] if most else ["en"]
    return out or ["en"]


def _pairs(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets, from opening to closing mark; a mark without partner is ignored."""
    stack: list[int] = []
    out = []
    for m in MARKS.finditer(text):
        c, i = m[0], m.start()
        top = text[stack[-1]] if stack else ""
        if c == '"':
            if '"' in (text[j] for j in stack):
                while text[stack[-1]] != '"':
                    stack.pop()
                out.append((stack.pop(), i))
            else:
                stack.append(i)
        elif c in CLOSE and not (c == "“" and "„" not in (text[j] for j in stack)):
            for k in range(len(stack) - 1, -1, -1):
                if OPEN.get(text[stack[k]]) == c:
                    out.append((stack[k], i))
                    del stack[k:]
                    break
        elif c in OPEN and not (c == "„" and top == "„"):
            stack.append(i)
    return out


def split(text: str, declared: str | None = None) -> list[tuple[int, int]]:
    """[start, end) of each sentence of a text, without the white space around it.

    The rules of Unicode's sentence breaks: an end of a paragraph ends a sentence, unless a line is only wrapped; terminators with
    the closing marks after them do, unless a digit (after a full stop), a small letter, a continuing mark or another terminator
    follows, or capitals stand on both sides of a full stop. Added are whole quotations and brackets, abbreviations and gaps of Thai.
    """
    langs = languages(text, declared)
    never = frozenset().union(*(ABBREVIATIONS[x]["never"] for x in langs))
    number = frozenset().union(*(ABBREVIATIONS[x]["number"] for x in langs))
    end_only = frozenset().union(*(ABBREVIATIONS[x]["end"] for x in langs))
    n = len(text)
    inside = bytearray(n + 1)  # 1: within a matched pair
    opener = {}
    for a, b in _pairs(text):
        inside[a + 1 : b] = b"\x01" * (b - a - 1)
        opener[b] = a
    cuts = []
    start = 0

    def first(at: int) -> int:
        while at < n and text[at].isspace():
            at += 1
        return at

    for m in END.finditer(text):
        end = m.end()
        if inside[m.start()]:
            # a terminator inside counts only if closing marks follow at once
            j = end
            while j < n and text[j].isspace():
                j += 1
            if not (j < n and j in opener and text[j] in CLOSE):
                continue
            end = j
        quoted = None
        while end < n and end in opener:
            quoted = opener[end]
            end += 1
        if end < n and text[end] in "’'" and not text[end + 1 : end + 2].isalpha():
            end += 1
        if end < n and inside[end - 1] and quoted is None or end < n and inside[end] and quoted is not None:
            continue
        nxt = first(end)
        if nxt >= n:
            continue
        if END.match(text, nxt) and nxt > end:
            continue
        c = text[nxt]
        spaced = nxt > end
        soft = set(m[0]) <= {".", "…", "．", "․"}
        start = first(start)
        if CONTINUES.match(c) and not (spaced and c == "-"):
            continue
        if c in CLOSE and c not in OPEN and c != '"':
            continue
        word = regex.match(r"[\p{L}\p{M}]+", text[nxt : nxt + 40])
        mixed = bool(word) and word[0][0].islower() and any(x.isupper() for x in word[0])
        capital = c.isupper() or c.istitle() or mixed or c in "¿¡"
        opens = c in OPEN or c == '"'
        uncased = bool(UNCASED.match(c))
        if quoted is not None:
            if c.islower() and not mixed:
                continue
            if uncased and text[quoted] in QUOTES and (quoted == start or c == "と"):
                continue  # who said it follows
            cuts.append(end)
            start = end
            continue
        if soft:
            before = regex.search(r"[\p{L}\p{M}°][\p{L}\p{M}.°-]*$", text[max(0, m.start() - 24) : m.start()])
            w = before[0].lower() if before else ""
            tail = w.rsplit(".", 1)[-1]
            if len(m[0]) > 1 or m[0] == "…":
                if c.islower() and not mixed:
                    continue
            else:
                if not spaced:
                    prev = text[m.start() - 1] if m.start() else ""
                    if not ((prev.islower() or prev.isdigit() or prev == "%") and (c.isupper() and (text[nxt + 1 : nxt + 2].islower() or text[nxt + 1 : nxt + 2] == " " and len(w) > 3) or opens) or uncased and not prev.isdigit()) or len(w) == 1:
                        continue
                if c.islower() and not mixed:
                    continue
                if w in never or tail in never:
                    if not (w in end_only and capital and not before[0][0].isupper()):
                        continue
                if (w in number or tail in number) and (c.isdigit() or c in "(（[" or not (capital or opens or uncased)):
                    continue
                if (w in end_only or tail in end_only) and not (capital or opens and c not in "(["):
                    continue
                if before and len(tail) == 1 and before[0][-1].isupper() and capital:
                    continue  # an initial
                if "de" in langs and word and word[0] in GERMAN_MONTHS and regex.search(r"(?<![\d,.])\d{1,2}$", text[max(0, m.start() - 4) : m.start()]):
                    continue
        elif c.islower() and not mixed and set(m[0]) <= {"!", "?"} and not spaced:
            continue
        cuts.append(end)
        start = end
    for m in PARAGRAPH.finditer(text):
        # a paragraph's end is a sentence's, but lines may only be wrapped: within a pair, before a small letter, after a hyphen or comma
        blank = len(regex.findall(r"[\n\u2029]", m[0])) > 1
        wrapped = inside[m.start()] or text[m.end() : m.end() + 1].islower() or text[m.start() - 1 : m.start()] in {"-", "¬", "\xad", "‐", ","}
        if blank or not wrapped:
            cuts.append(m.start())
    if THAI.search(text):
        cuts += [m.start() for p in (THAI_GAP, THAI_LATIN) for m in p.finditer(text) if not inside[m.start()]]
    out = []
    at = 0
    for cut in [*sorted(set(cuts)), n]:
        a, b = first(at), cut
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        at = cut
    return out


GARBLED = regex.compile(r"[^\x00-\x7f]{2,}")
LEADS = regex.compile(r"[ÃÂâãäåæçèéàÐÑØÙ√‚├Γðã]")
DECODERS = ("cp1252", "latin-1", "mac_roman", "cp437")


def _bytes(c: str, decoder: str) -> bytes | None:
    try:
        return c.encode(decoder)
    except UnicodeEncodeError:
        return bytes([ord(c)]) if decoder == "cp1252" and ord(c) < 256 else None


def shadow(text: str) -> tuple[str, list[int]] | None:
    """(text with UTF-8 that was decoded bytewise put right, position of each of its characters); None if there is none.

    Only runs whose bytes are whole UTF-8 sequences are put right, which hardly happens to sound text.
    """
    if not LEADS.search(text):
        return None
    out: list[str] = []
    at: list[int] = []
    end = 0
    for m in GARBLED.finditer(text):
        for decoder in DECODERS:
            raw = [_bytes(c, decoder) for c in m[0]]
            if None in raw:
                continue
            try:
                fixed = b"".join(raw).decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(text[end : m.start()])
            at += range(end, m.start())
            i = m.start()
            for c in fixed:
                out.append(c)
                at.append(i)
                i += len(c.encode("utf-8"))
            end = m.end()
            break
    if not end:
        return None
    return "".join([*out, text[end:]]), [*at, *range(end, len(text)), len(text)]


def split_any(text: str, declared: str | None = None) -> list[tuple[int, int]]:
    """Like split, and terminators and quotation marks are also known where UTF-8 was decoded as single bytes."""
    seen = shadow(text)
    if seen is None:
        return split(text, declared)
    plain, at = seen
    return [(at[a], at[b]) for a, b in split(plain, declared)]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, starts, ends = [], [], []
        for i, lang, text in zip(pdf["article_id"], pdf["lang"], pdf["abstract"]):
            for a, b in split_any(text, lang):
                ids.append(i)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"article_id": ids, "sent_start": starts, "sent_end": ends}, dtype="int64")


def sentences(papers: DataFrame) -> DataFrame:
    """(article_id, sent_start, sent_end): the sentences of every abstract.

    Unicode's sentence-break properties give the terminators of all scripts; abbreviations of the
    languages present suppress a break; a quotation or bracket stays whole with its sentence; scripts
    without terminators break at their gaps. Null and `**NONE**` abstracts have none, neither has a text of white space.
    Null ids are kept as they are; rows repeat as they come.
    """
    rows = papers.where("article_id is not null and abstract is not null and abstract <> '**NONE**'")
    return rows.select("article_id", "lang", "abstract").mapInPandas(_run, "article_id bigint, sent_start bigint, sent_end bigint")
