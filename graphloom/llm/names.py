"""P1: variant spellings of names typed by people."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from graphloom.common import cut

# Nicknames of forenames
NICKNAMES = {
    "alexander": "alex sasha sandy xander alec", "anthony": "tony", "antonia": "toni tonia", "katherine": "kate kathy kathie katie kat", "elizabeth": "liz beth lizzie betty",
    "william": "bill will billy willy", "robert": "bob rob bobby robbie bert", "francisco": "fran paco pancho cisco", "isabella": "isa bella", "dorothea": "thea doro dora dorothy", "frederik": "fred rik freddy fritz",
    "sebastian": "seb bastian basti", "matthias": "matt hias matti", "christina": "tina chris", "theodore": "theo ted teddy", "natalia": "talia natasha nata", "giuseppe": "peppe beppe pino", "nikolai": "nick kolya niko",
    "johannes": "hans hannes", "margaret": "peggy maggie margie", "michael": "mike mick mikey", "richard": "rick dick", "charles": "charlie chuck", "edward": "ed eddie ned", "joseph": "joe", "james": "jim jimmy",
    "john": "jack johnny", "thomas": "tom tommy", "daniel": "dan danny", "samuel": "sam sammy", "benjamin": "ben benny", "stephen": "steve", "susan": "sue suzy", "jennifer": "jen jenny", "patricia": "pat patty", "vladimir": "vova volodya", "dmitri": "dima mitya",
}
TO_FULL = {n: full for full, ns in NICKNAMES.items() for n in ns.split()}
ORG = regex.compile(r"(?i)\b(?:inst(?:itut\w*)?|univ(?:ersit\w*)?|cons(?:ort\w*)?|centre|center|ctr|dep(?:t|artm\w*)|lab(?:orat\w*)?|faculty|school|college|hosp(?:ital)?|ministry|agency|society|council)\b")
SMALL = frozenset("of for the and in on at de la des du der für to".split())
PARTICLES = frozenset("van von der den de da di del della dos du la le ten ter zu al el bin ibn".split())
TITLES = regex.compile(r"^(?:(?:dr|prof|mr|mrs|ms|sir|dame|dipl|ing|herr|frau|mme)\.?\s+)+", regex.I)
SUFFIX = regex.compile(r"(?:\s*\([^()]*\)|[*†‡§¶#]+|,?\s+(?:ph\.?\s?d|m\.?\s?d|m\.?\s?sc|b\.?\s?sc|mph|dphil|jr|sr|iii?|esq)\.?|[\s,]*\d+(?:\s*,\s*\d+)*|\s+[a-z](?:,[a-z])*)\s*$", regex.I)
PREFIX = regex.compile(r"^(?:&amp;|&|and\s|und\s|et\s|y\s|[*†,;.\s]+)+\s*", regex.I)
EXTRA = str.maketrans({"ø": "o", "Ø": "o", "ł": "l", "Ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "Æ": "ae", "œ": "oe", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents."""
    plain = unicodedata.normalize("NFKD", text.translate(EXTRA))
    return "".join(c for c in plain if not unicodedata.combining(c)).casefold()


def clean(name: str) -> str:
    """The name without titles, degrees, footnote marks and notes."""
    s = regex.sub(r"\s+", " ", name.replace("\xa0", " ")).strip()
    s = TITLES.sub("", PREFIX.sub("", s))
    while True:
        m = SUFFIX.search(s)
        # a lone letter is a mark of a footnote only where it is small and a name stands before it
        if not m or not m.start() or regex.match(r"\s+[A-Z]$", m[0]) or regex.match(r"\s+[a-z]$", m[0]) and " " not in s[: m.start()]:
            return TITLES.sub("", s).strip(" ,;")
        s = s[: m.start()].rstrip(" ,;")


def letters(tokens: list[str]) -> str:
    return "".join(fold(c) for t in tokens for c in (t if regex.fullmatch(r"\p{Lu}{1,4}", t) else regex.split(r"[.\-]", t)) if c)


def initials_only(t: str) -> bool:
    return bool(regex.fullmatch(r"(?:\p{Lu}\.?-?){1,3}|\p{L}\.", t)) and not (len(t) > 3 and "." not in t)


def parse(name: str) -> dict | None:
    """kind, sur, given (whole forename), abbr (begun forename), inits (first and middle initials), sure (order known)."""
    s = clean(name)
    if not s or "**NONE**" in name or not any(c.isalpha() for c in s):
        return None
    tokens = [t for t in s.replace(",", " , ").split() if t]
    words = [t for t in tokens if t != ","]
    acronym = [t for t in words if regex.fullmatch(r"\p{Lu}{3,5}", t) and len(words) == 2 and not all(w.isupper() for w in words)]
    if ORG.search(s) or acronym or len(words) >= 4 and any(w.lower() in SMALL - PARTICLES for w in words):
        place = None
        if "," in tokens:
            at = len(tokens) - 1 - tokens[::-1].index(",")
            place, rest = " ".join(tokens[at + 1 :]), [t for t in tokens[:at] if t != ","]
        else:
            body = [w for w in words if w.lower() not in ("the", "die", "le")]
            if acronym:
                rest, place = acronym, next((w for w in body if w not in acronym), None)
            else:
                heads = [i for i, w in enumerate(body) if ORG.match(w)]
                # topic, head and place stand without "of"; else the place comes first
                last = heads[-1:] == [len(body) - 2] and len(body) > 2 and not any(w.lower() in SMALL for w in body)
                place, rest = (body[-1], body[:-1]) if last else (body[0], body[1:])
        if acronym:
            marks = sorted(fold("".join(acronym)))
        else:
            marks = sorted(fold(w)[0] for w in rest if w.lower() not in SMALL and fold(w)[:1].isalpha())
        if place and marks:
            return {"kind": "o", "sur": regex.sub(r"[^\w]", "", fold(place)), "given": "#" + "".join(marks), "abbr": "", "inits": "", "sure": True, "one": "", "two": ""}
    sure = True
    one = two = ""
    if "," in tokens:
        at = tokens.index(",")
        sur, rest = tokens[:at], [t for t in tokens[at + 1 :] if t != ","]
    elif len(words) == 1:
        return {"kind": "p", "sur": regex.sub(r"[^\w]", "", fold(words[0])), "given": "", "abbr": "", "inits": "", "sure": True, "one": "", "two": ""}
    elif initials_only(words[-1]) and not initials_only(words[0]) and not (words[-1].endswith(".") and len(words) > 2):
        k = len(words) - 1
        while k > 1 and initials_only(words[k - 1]):
            k -= 1
        sur, rest = words[:k], words[k:]
    else:
        k = len(words) - 1
        while k > 1 and words[k - 1].lower() in PARTICLES:
            k -= 1
        sur, rest = words[k:], words[:k]
        if len(words) == 2 and not initials_only(words[0]) and not words[0].endswith("."):
            caps = [len(w) > 3 and w.isupper() for w in words]
            if caps == [True, False]:
                sur, rest = words[:1], words[1:]
            elif caps != [False, True]:
                sure = False
    if not rest or not sur:
        return None
    first = rest[0]
    given = abbr = ""
    bare = regex.sub(r"[^\w-]", "", fold(first))
    if initials_only(first):
        inits = letters(rest)
    elif first.endswith(".") and len(bare) >= 2 or len(bare) == 2 and bare not in TO_FULL:
        abbr, inits = bare, bare[0] + letters([t for t in rest[1:] if initials_only(t)])
    else:
        given = TO_FULL.get(bare, bare)
        inits = given[:1] + letters([t for t in rest[1:] if initials_only(t)])
    s_ = regex.sub(r"[^\w]", "", fold("".join(sur)))
    if not s_ or not inits:
        return None
    if not sure:
        one, two = bare, s_
    return {"kind": "p", "sur": s_, "given": given, "abbr": abbr, "inits": inits, "sure": sure, "one": one, "two": two}


PARSED = "name string, kind string, sur string, given string, abbr string, inits string, sure boolean, one string, two string"
ROUNDS = 100


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [{"name": n} | p for n in pdf["name"] if (p := parse(n))]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])


def near(a: str, b: str) -> bool:
    """Whether one insertion, deletion, replacement or exchange of neighbours makes a of b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _shorter(word: str, least: int) -> set[str]:
    """The word, and each of its spellings with one character deleted if it is long enough."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= least else {word}


BLOCKS = "key string, cl string, role string, mid string, sur string, given string, k bigint"


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys of each profile. Role s: profiles with forenames meet each other; w: initials and begun forenames meet the profiles with forenames, role t."""
    for pdf in batches:
        out = []
        for cl, kind, surs, givens, abbr, firsts, mid in zip(*(pdf[c] for c in ("cl", "kind", "surs", "givens", "abbr", "firsts", "mid"))):
            for sur in surs:
                short = _shorter(sur, 5)
                for g in givens:
                    given, k = g["given"], g["k"]
                    out += [(f"s{kind}|{s}|{given}", cl, "s", mid, sur, given, k) for s in short]
                    if kind == "p" and len(given) >= 4:
                        out += [(f"g|{sur}|{x}", cl, "s", mid, sur, given, k) for x in _shorter(given, 4)]
                if kind == "p":
                    role, text = ("t", " ".join(sorted(g["given"] for g in givens))) if len(givens) else ("w", abbr)
                    out += [(f"w|{s}|{f}", cl, role, mid, sur, text, 0) for s in short for f in firsts if f]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """how: 0 the profiles are one, 1 initials fit a profile of the same surname, 2 of a surname one edit apart."""
    for pdf in batches:
        how = []
        for role, a, b, c, d in zip(pdf["role"], pdf["sur"], pdf["sur2"], pdf["given"], pdf["given2"]):
            if role == "s":
                how.append(0 if a == b and near(c, d) or c == d and near(a, b) else -1)
            else:
                fits = any(g.startswith(c) for g in d.split(" "))
                how.append(1 if fits and a == b else 2 if fits and near(a, b) else -1)
        out = pdf[["cl", "cl2", "mid", "mid2"]].assign(how=how)
        yield out[out["how"] >= 0].drop_duplicates()


def _aliases(whole: DataFrame) -> DataFrame:
    """(given, full): forenames that stand beside a more common one under most of their surnames, which chance does not do.

    whole has distinct sur and given. All surnames are evidence; by chance, a surname of many other forenames has any of them more
    often, in proportion to their number. A forename meets those under its surnames of fewest forenames alone, so many that none which it shares most
    surnames with is missed; the surnames of these pairs are then counted in full.
    """
    sizes = whole.groupBy("sur").agg(F.count("*").alias("f"))
    total = whole.agg(F.count("*").alias("total"))
    seen = whole.join(sizes, "sur")
    n = seen.groupBy("given").agg(F.count("*").alias("n"), F.sum(F.col("f") - 1).alias("room"))
    n = cut(n.where("n >= 3"))
    rank = F.row_number().over(W.Window.partitionBy("given").orderBy("f", "sur"))
    least = F.greatest(F.floor(F.col("n") / 2) + 1, F.lit(3))  # of the surnames are shared, so one of the first n - least + 1 is
    first = seen.withColumn("rank", rank).join(n, "given").where(F.col("rank") <= F.col("n") - least + 1).select("sur", "given", "n", "room")
    m = n.select(F.col("given").alias("full"), F.col("n").alias("m"))
    # with k = n at most, what is too common for every k is left out
    fulls = whole.select("sur", F.col("given").alias("full")).join(m, "full")
    met = first.join(fulls, "sur").where("given <> full and m > n").select("given", "full", "n", "m", "room").distinct()
    met = cut(met.join(F.broadcast(total)).where("n * total >= 10 * room * m"))
    both = met.join(whole, "given").join(whole.select("sur", F.col("given").alias("full")), ["sur", "full"])
    rated = both.groupBy("given", "full", "n", "m", "room", "total").agg(F.count("*").alias("k")).where("k >= 3")
    told = rated.where("2 * k > n and k * total >= 10 * room * m")
    return told.groupBy("given").agg(F.max_by("full", F.struct("k", "m", "full")).alias("full"))


def _profiles(names: DataFrame) -> DataFrame:
    """(name, kind, sur, given, abbr, first, mid, k) of the names that can be read; k is the number of surnames of the forename."""
    parsed = cut(names.mapInPandas(_parse, PARSED))
    # which of two bare words is the forename: how often each stands in either part where the order is known, and, for less, where it is not
    person = parsed.where("kind = 'p' and given <> ''")
    parts = F.explode(F.array(*[F.struct(F.col(c).alias("w"), F.lit(i).alias("part"), F.col(o).alias("other")) for i, (c, o) in enumerate((("given", "sur"), ("sur", "given")))]))
    seen = person.select("sure", parts.alias("p")).select("sure", "p.*").groupBy("w", "part", "other").agg(F.max(F.when(F.col("sure"), 1.0).otherwise(0.25)).alias("v"))
    roles = seen.groupBy("w").agg(F.sum(F.when(F.col("part") == 0, F.col("v"))).alias("f"), F.sum(F.when(F.col("part") == 1, F.col("v"))).alias("s"))
    odds = roles.select("w", F.log((F.coalesce("f", F.lit(0.0)) + 0.25) / (F.coalesce("s", F.lit(0.0)) + 0.25)).alias("odds"))
    both = parsed.join(odds.select(F.col("w").alias("one"), F.col("odds").alias("o1")), "one", "left").join(odds.select(F.col("w").alias("two"), F.col("odds").alias("o2")), "two", "left")
    nick = F.create_map(*[F.lit(x) for kv in TO_FULL.items() for x in kv])
    turn = F.coalesce(~F.col("sure") & (F.col("o2") - F.col("o1") > F.log(F.lit(2.0))) & (F.col("o2") > 0), F.lit(False))
    full = F.coalesce(nick[F.col("two")], F.col("two"))
    rows = both.select(
        "name", "kind",
        F.when(turn, F.col("one")).otherwise(F.col("sur")).alias("sur"),
        F.when(turn, full).otherwise(F.col("given")).alias("given"),
        "abbr",
        F.when(turn, F.substring(full, 1, 1)).otherwise(F.col("inits")).alias("inits"),
    )
    rows = cut(rows.select("name", "kind", "sur", "given", "abbr", F.substring("inits", 1, 1).alias("first"), F.substring("inits", 2, 1).alias("mid")))
    whole = rows.where("kind = 'p' and given <> ''").select("sur", "given").distinct()
    told = rows.join(_aliases(whole), "given", "left")
    told = told.withColumn("first", F.when(F.col("full").isNotNull(), F.substring("full", 1, 1)).otherwise(F.col("first"))).withColumn("given", F.coalesce("full", "given")).drop("full")
    known = whole.groupBy("given").agg(F.count("*").alias("k"))
    return told.join(known, "given", "left").select("name", "kind", "sur", "given", "abbr", "first", "mid", F.coalesce("k", F.lit(0)).alias("k"))


def _matches(profiles: DataFrame) -> DataFrame:
    """(cl, cl2, mid, mid2, how) of the profiles that meet in a block and fit."""
    blocks = profiles.mapInPandas(_blocks, BLOCKS).withColumn("key", F.xxhash64("key"))  # what keys of one hash do not share, the fit finds
    other = blocks.select("key", *[F.col(c).alias(f"{c}2") for c in ("cl", "role", "mid", "sur", "given", "k")])
    pairs = blocks.join(other, "key").where("(role = 's' and role2 = 's' and cl < cl2) or (role = 'w' and role2 = 't')")
    # two forenames that both are common are no misspellings of each other
    rare, often = F.least("k", "k2"), F.greatest("k", "k2")
    pairs = pairs.where("mid = '' or mid2 = '' or mid = mid2").where((F.col("role") == "w") | (F.col("given") == F.col("given2")) | (rare < 3) | (rare * 4 <= often))
    return pairs.mapInPandas(_fit, "cl string, cl2 string, mid string, mid2 string, how int").groupBy("cl", "cl2", "mid", "mid2").agg(F.min("how").alias("how"))


def _edges(profiles: DataFrame) -> DataFrame:
    """(a, b, amid, bmid) of the profiles that merge in this round; of profiles with initials each joins one other at most."""
    found = cut(_matches(profiles))
    strong = found.where("how = 0").select(F.col("cl").alias("a"), F.col("cl2").alias("b"), F.col("mid").alias("amid"), F.col("mid2").alias("bmid"))
    # a profile of the same surname goes first, and among these one of the same middle initial
    tier = 2 * F.col("how") - ((F.col("mid") != "") & (F.col("mid") == F.col("mid2"))).cast("int")
    ends = [f(F.struct(t.alias("tier"), F.col("cl2").alias("b"), F.col("mid2").alias("bmid"))).alias(n) for f, t, n in ((F.min, tier, "lo"), (F.max, -tier, "hi"))]
    fits = found.where("how > 0").groupBy(F.col("cl").alias("a"), F.col("mid").alias("amid")).agg(*ends)
    fits = fits.select("a", "amid", (F.col("lo.tier") <= 2).alias("exact"), F.expr("if(lo.b = hi.b, lo, null)").alias("to"))
    sole = fits.where("to is not null").select("a", F.col("to.b").alias("b"), "amid", F.col("to.bmid").alias("bmid"))
    # without any whole forename, initials of one surname that do not differ are one profile
    lone = profiles.where("size(givens) = 0 and kind = 'p' and firsts[0] <> ''").select(F.col("cl").alias("a"), F.explode("surs").alias("sur"), F.col("firsts")[0].alias("first"), F.col("mid").alias("amid"), "abbr")
    lone = lone.join(fits.where("exact or to is not null").select("a"), "a", "left_anti")
    one = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.col(c))) == F.max(F.when(F.col(c) != "", F.col(c))), F.lit(True))
    least = lone.groupBy("sur", "first").agg(F.min(F.struct(F.col("a").alias("b"), F.col("amid").alias("bmid"))).alias("to"), one("amid").alias("m"), one("abbr").alias("n")).where("m and n")
    alike = lone.join(least, ["sur", "first"]).where("a <> to.b").select("a", F.col("to.b").alias("b"), "amid", F.col("to.bmid").alias("bmid"))
    edges = strong.unionByName(sole).unionByName(alike)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bmid").alias("amid"), F.col("amid").alias("bmid"))).distinct()
    both = cut(both)
    # a profile without middle initial that fits different ones may be either, and joins none of them
    middle = F.when(F.col("bmid") != "", F.col("bmid"))
    torn = both.where("amid = ''").groupBy("a").agg(F.min(middle).alias("lo"), F.max(middle).alias("hi")).where("lo <> hi").select("a")
    kept = both.where("amid = '' and bmid <> ''").join(torn, "a", "left_anti").select("a", "b", "amid")
    turned = kept.select(F.col("b").alias("a"), F.col("a").alias("b")).join(both.where("amid <> '' and bmid = ''"), ["a", "b"]).select("a", "b", "amid")
    return both.where("(amid = '') = (bmid = '')").select("a", "b", "amid").unionByName(kept).unionByName(turned)


def _steps(edges: DataFrame) -> DataFrame:
    """(a, amid, to): each profile's least neighbour, and that one's; those further off follow in the next round."""
    step = edges.groupBy("a", "amid").agg(F.min("b").alias("b")).select("a", "amid", F.least("a", "b").alias("to"))
    return cut(step.join(step.select(F.col("a").alias("to"), F.col("to").alias("next")), "to").select("a", "amid", F.col("next").alias("to")))


def _labels(steps: DataFrame) -> DataFrame:
    """(cl, to): where profiles of different middle initials would come together, each initial stays by itself."""
    middle = F.when(F.col("amid") != "", F.col("amid"))
    torn = steps.groupBy("to").agg(F.min(middle).alias("lo"), F.max(middle).alias("hi")).where("lo <> hi").select("to", F.lit("\x01").alias("torn"))
    return steps.join(torn, "to", "left").select(F.col("a").alias("cl"), F.when(F.col("torn").isNull(), F.col("to")).otherwise(F.concat("to", "torn", "amid")).alias("to"))


def entities(papers: DataFrame) -> DataFrame:
    """(name, entity): each distinct author string that can be read, with the entity it names.

    1. Strings are read into profiles: surname, forename, begun forename, initials; of two bare words the one that
       stands as forename elsewhere is taken for it. Short forms of forenames come from a list of
       common ones and from the corpus (`_aliases`).
    2. A profile holds all spellings of the surname and forename and the middle initial of its names. Profiles meet
       under keys with at most one character deleted. They are one if, for some of their spellings, surname or
       forename is the same and the other one edit apart at most; profiles with different middle initials are never one, and one without that
       fits several different joins none of these. Initials and begun forenames join if exactly one profile fits, first among those of the same surname.
    3. Merged profiles unite their spellings and initials and go back into blocking, until nothing merges.
    A block under a key with a deleted character holds at most (length x alphabet) spellings of one
    name, whatever the number of rows, since equal profiles are merged before. Names with `**NONE**`, null and empty
    elements, and elements without a letter are no names; empty tables give no rows.
    """
    names = papers.select(F.explode("authors").alias("name")).where("name is not null and not contains(name, '**NONE**')").distinct()
    node = F.concat_ws("|", "kind", "sur", F.when(F.col("given") != "", F.col("given")).otherwise(F.concat(F.lit("?"), F.col("abbr"), F.lit("?"), F.col("first"))), "mid")
    rows = cut(_profiles(names).withColumn("node", node))
    nodes = rows.select("node", F.col("node").alias("cl"), "kind", "sur", "given", "abbr", "first", "mid", "k").dropDuplicates(["node"])
    for _ in range(ROUNDS):
        given = F.when(F.col("given") != "", F.struct("given", "k"))
        profiles = nodes.groupBy("cl").agg(F.min("kind").alias("kind"), F.collect_set("sur").alias("surs"), F.collect_set(given).alias("givens"), F.max("abbr").alias("abbr"), F.collect_set("first").alias("firsts"), F.max("mid").alias("mid"))
        steps = _steps(_edges(cut(profiles)))
        if steps.isEmpty():
            return rows.join(nodes.select("node", F.col("cl").alias("entity")), "node").select("name", "entity")
        nodes = cut(nodes.join(_labels(steps), "cl", "left").withColumn("cl", F.coalesce("to", "cl")).drop("to"))
    raise RuntimeError("profiles still merge")


def variant_pairs(papers: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b: different strings of one entity. A person's spellings are few, however many rows hold them."""
    e = entities(papers)
    return e.join(e.select(F.col("name").alias("name_b"), "entity"), "entity").where("name < name_b").select(F.col("name").alias("name_a"), "name_b")
