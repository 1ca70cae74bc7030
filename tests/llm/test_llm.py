import os
import random
import time

import pytest
from graphloom.llm import garbled, merkle, mixing, names, near, packing, scans, sentences, spans
from pyspark.sql import functions as F

PAPER = "article_id long, lang string, title string, abstract string, authors array<string>, extra string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def papers(spark, *data):
    return spark.createDataFrame([(i, None, t, a, n, "x") for i, t, a, n in data], PAPER)


def sents(text, lang=None):
    return [text[a:b] for a, b in sentences.split(text, lang)]


# p1


def test_name_forms():
    assert names.parse("&amp; Dr. Ána K. Müller, PhD")["sur"] == "muller"
    assert names.parse("MÜLLER, A. K.")["inits"] == "ak"
    assert names.parse("Müller AK")["inits"] == "ak"
    assert names.parse("Inst. of Vector Ecology, Zeru")["given"] == names.parse("The Zeru Vector Ecology Institute")["given"]
    assert names.parse("**NONE** Smith") is None and names.parse(" ") is None
    assert names.near("abcd", "abdc") and names.near("abc", "abcd") and not names.near("abcd", "abee")


def test_variants_link_and_people_stay_apart(spark):
    p = papers(spark, (1, None, None, ["Nadia W. Kikenebra", "Nadia Kikenebra", "KIKENEBRA, N.", "Nadia Kikenbra", "Otto Kikenebra", None, "**NONE** Kikenebra", ""]), (2, None, None, None), (3, None, None, []))
    got = rows(names.variant_pairs(p))
    same = {"Nadia W. Kikenebra", "Nadia Kikenebra", "KIKENEBRA, N.", "Nadia Kikenbra"}
    assert {x for pair in got for x in pair} == same and len(got) == 6 and all(a < b for a, b in got)
    assert names.variant_pairs(p.limit(0)).count() == 0


def test_initials_that_fit_two_people_link_to_none(spark):
    p = papers(spark, (1, None, None, ["Nadia Kikenebra", "Nora Kikenebra", "N. Kikenebra"]))
    assert rows(names.variant_pairs(p)) == []


def test_middle_initials_keep_people_apart(spark):
    p = papers(spark, (1, None, None, ["Anna B. Smith", "Anna C. Smith", "Anna D. Smith", "Anna Smith", "A. C. Smith", "SMITH, Anna C."]))
    assert rows(names.variant_pairs(p)) == [("A. C. Smith", "Anna C. Smith"), ("A. C. Smith", "SMITH, Anna C."), ("Anna C. Smith", "SMITH, Anna C.")]
    # neither may two that differ come together over one without an initial, nor over two of those
    p = papers(spark, (1, None, None, ["Anna B. Smithson", "Anna Smithson", "Anna Smithsen", "Anna C. Smithsn"]))
    assert not any({"Anna B. Smithson", "Anna C. Smithsn"} <= set(x) for x in rows(names.variant_pairs(p)))


def test_merged_spellings_rematch(spark):
    p = papers(spark, (1, None, None, ["Nadia Kikenebra", "N. Kikenbra", "N. Kikenra"]))
    assert len(rows(names.variant_pairs(p))) == 3


def test_short_forms_are_learned(spark):
    surs = ["Abelard", "Brockhus", "Cantorov", "Dimmlich", "Ebersold", "Fenwick", "Gorodets", "Hallmann"]
    found = [f"{g}, {f}" for g in surs[:4] for f in ("Wilhelmina", "Quilla")]
    found = [", ".join(x.split(", ")) for x in found] + [f"{s}, Wilhelmina" for s in surs[4:]] + [f"Ottosen{x}, {x}" for x in ("Rudolfo", "Marvin", "Sigrun")] * 10
    others = [f"Sur{chr(97 + i)}{chr(97 + j)}xem, Person{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(10)]
    got = rows(names.variant_pairs(papers(spark, (1, None, None, [*found, *others]))))
    assert ("Abelard, Quilla", "Abelard, Wilhelmina") in got and all(a.split(",")[0] == b.split(",")[0] for a, b in got)


# p2


@pytest.mark.parametrize(
    ("text", "count"),
    [
        ("Dr. A. B. Smith saw 3.5 cases (Fig. 8), i.e. few. It fell.", 2),
        ("He noted: “It rained. It stopped.” We left.", 2),
        ("“It never settled,” wrote Fox. Then it did.", 2),
        ("(It was known.) We went on.", 2),
        ("“楠岛下降。”梓枫写道。基于模型。", 2),
        ("「下がった。」とスシツは述べた。降雨が続いた！", 2),
        ("Am 3. Mai kam er z. B. an. Es war spät.", 2),
        ("Le Dr Roy (cf. fig. 5) dit « jamais ». Env. 4 % restent !", 2),
        ("По данным и др., доля в 2007 г. и рис. 3 выросли. Мы т. е. все.", 2),
        ("क्या यह है? डॉ. राम गए। \"ऐसा है।\" ऐसा लिखा।", 3),
        ("ในปี 2015 พบว่าลดลงภายใน 4 วัน การแพร่เชื้อในเมือง แม้มีฝน", 3),
        ("First ended.Second began. mRNA rose.", 3),
        ("It is unclear ... whether so. End", 2),
        ("", 0),
        (" \t ", 0),
    ],
)
def test_sentence_counts(text, count):
    assert len(sents(text)) == count, sents(text)


def test_paragraphs_end_sentences():
    assert sents("First heading\nSecond line without stop\nThird para. Next one.") == ["First heading", "Second line without stop", "Third para.", "Next one."]
    assert sents("The rate was mea-\nsured in all\ntowns. It fell.") == ["The rate was mea-\nsured in all\ntowns.", "It fell."]
    assert sents("a “b\nc” d\n\ne f") == ["a “b\nc” d", "e f"]


def test_sentences_cover_everything_but_space():
    text = "A b. C d! «E f. G», h? I." * 50
    got = sentences.split(text)
    inside = set().union(*(range(a, b) for a, b in got))
    assert all(text[i].isspace() for i in range(len(text)) if i not in inside)


def test_sentences_of_garbled_text():
    text = "He noted: “It rained. It stopped.” We left. Señora came."
    bad = text.encode().decode("latin-1")
    assert [bad[a:b].encode("latin-1").decode() for a, b in sentences.split_any(bad)] == sents(text)
    assert sentences.split_any(text) == sentences.split(text)


def test_sentences_of_null_and_empty(spark):
    assert rows(sentences.sentences(papers(spark, (1, None, None, None), (2, None, "**NONE**", None), (3, None, "", None), (4, None, "A b.", None)))) == [(4, 0, 4)]


# p3


def test_duplicates(spark):
    df = spark.createDataFrame([(5, "A b; host: C"), (2, "HOST c;a-B"), (3, "ab"), (4, None), (6, " ; -"), (7, "ab; ab"), (8, "hostc;;ab")], "id long, ent string")
    assert rows(merkle.duplicates(df, "id", "ent")) == [(2, 5), (2, 8)]
    assert rows(merkle.collapsed(df, "id", "ent")) == [(2, 3), (3, 1), (7, 1)]
    assert merkle.duplicates(df.limit(0), "id", "ent").count() == 0


def test_hot_group_of_copies(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("ent"))
    assert merkle.duplicates(df, "id", "ent").count() == 1999


# p4


def brute(texts, threshold=0.7):
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts}
    return sorted((a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]))


def edited_papers(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    data = []
    for k in range(12):
        base = [word() for _ in range(60)]
        for v in range(4):
            text = list(base)
            for _ in range(v * 4):
                text[r.randrange(60)] = word()
            data.append((k * 10 + v, None, " ".join(text), None))
    data.append((900, None, data[0][2], None))
    return data + [(901, None, None, None), (902, None, "**NONE**", None), (903, "ab", "", None)]


@pytest.mark.parametrize("method", ["bands", "prefix"])
def test_near_pairs_like_brute_force(spark, method):
    data = edited_papers()
    want = brute([(i, f" {a}".strip()) for i, _, a, _ in data if a and a != "**NONE**"])
    assert rows(near.near_pairs(papers(spark, *data), method=method)) == want
    assert near.near_pairs(papers(spark, *data).limit(0), method=method).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8, 0.9])
def test_bands_follow_the_threshold(spark, threshold):
    n, k = near.banding(threshold)
    assert n <= near.BANDS and (1 - threshold**k) ** n <= near.MISS
    data = edited_papers(2)
    want = brute([(i, f" {a}".strip()) for i, _, a, _ in data if a and a != "**NONE**"], threshold)
    assert rows(near.near_pairs(papers(spark, *data), threshold)) == want


def test_texts_far_below_the_threshold_are_no_candidates(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    texts = [(i, " ".join(base[:50] + [word() for _ in range(50)])) for i in range(120)] + [(500, " ".join(base)), (501, " ".join(base[1:]))]
    records = spark.createDataFrame(texts, "id long, text string")
    got = rows(near.banded_candidates(records, 0.7))
    assert (500, 501) in got and len(got) <= 20  # shared bands alone give hundreds of the 7 140 pairs
    assert rows(near.banded_candidates(records, 0.7, in_one=10)) == got


# p5


def test_flowing_text():
    text = "The rate was mea-\nsured in all\n- 156 -\nVol. 12, No. 5\ntowns of the\nisland."
    assert scans.flowing(text) == ("The rate was measured in all towns of the island.", True)
    sections = "Background: one two three.\nMethods: four five six."
    assert scans.flowing(sections)[1] is False


def test_misread_words(spark):
    data = [(i, None, "the force of infection were measured in every town", None) for i in range(40)]
    data += [(100, None, "the force of infection wcre measured in every town", None), (101, None, "the forcɑ of infection", None), (102, None, None, None), (103, None, "", None)]
    assert rows(scans.scanned(papers(spark, *data))) == [(100, "abstract"), (101, "abstract")]
    fixed = {r["article_id"]: r["text"] for r in scans.repaired(papers(spark, *data)).collect()}
    assert "were measured" in fixed[100]


def test_deletion_index_finds_readings_that_no_list_has(spark):
    assert scans.cost("virus", "vims") > scans.cost("modern", "modem") and scans.cost("were", "wcre") == 1.0
    assert scans.deletions("abc", 2) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    words = spark.createDataFrame([("population", 900, True), ("popuiation", 1, True), ("virus", 500, True), ("virs", 2, True), ("xylo", 1, True)], "word string, n long, lower boolean")
    got = {(r["word"], r["better"], r["alike"]) for r in scans.candidates(words).collect()}
    assert got == {("popuiation", "population", False), ("virs", "virus", False)}


def test_without_the_index_misread_words_are_lost(spark, monkeypatch):
    data = [(i, None, "the force of infection were measured in every town", None) for i in range(40)] + [(100, None, "the force of infection wcre measured in every town", None)]
    assert rows(scans.scanned(papers(spark, *data))) == [(100, "abstract")]
    monkeypatch.setattr(scans, "candidates", lambda words: words.limit(0).selectExpr("word", "n", "word better", "n m", "0d cost", "true alike"))
    assert rows(scans.scanned(papers(spark, *data))) == []


# p7


def test_garbled_text_comes_back(spark):
    sound = "La taille finale chez les élèves a été mesurée à Körné près de la rivière où l’été fut sévère"
    russian = "Мы применили сетевую модель к случаям из района Тубре"
    data = [(i, russian, f"{sound} {i}", None) for i in range(60)]
    bad = [(100, russian.encode("utf-8").decode("latin-1"), sound.encode("utf-8").decode("cp1252", "replace").replace("�", "?"), None), (101, russian.encode("cp1251").decode("latin-1"), None, None), (102, russian, "La pr�valence", None)]
    got = {(r["article_id"], r["field"]): r for r in garbled.restored(papers(spark, *data, *bad)).collect()}
    assert {k for k, r in got.items() if r["garbled"]} == {(100, "title"), (100, "abstract"), (101, "title"), (102, "abstract")}
    assert got[100, "title"]["restored"] == russian and got[101, "title"]["restored"] == russian


def test_segments_come_from_mutual_information(monkeypatch):
    """Without the information no segment is found, and nothing is restored."""
    sound = "la taille finale chez les élèves a été mesurée à körné près de la rivière où l’été fut sévère "
    counts = {}
    for a, b in zip(garbled.classes(sound * 300), garbled.classes(sound * 300)[1:]):
        counts[a + b] = counts.get(a + b, 0) + 1
    bad = "mesurée près de la riviÃ¨re où"
    assert garbled.restore(garbled.Model(counts), bad)[0] == "mesurée près de la rivière où"
    assert garbled.Model(counts).improbable("mesurée près de la rivière") == []
    monkeypatch.setattr(garbled.Model, "info", lambda self, ab: 0.0)
    assert garbled.restore(garbled.Model(counts), bad) == (bad, [])


# p8


def test_fullest_is_the_best_sum():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        free = r.randrange(1, 80)
        use = packing.fullest(free, sorted(counts, reverse=True), counts)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        assert sum(n * k for n, k in use.items()) == max(s for s in sums if s <= free) and all(k <= counts[n] for n, k in use.items())


def test_packing_keeps_all_tokens(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 37), "s") for i in range(300)] + [(300, "word " * 200, "s"), (301, None, "s")], "doc_id long, text string, source string")
    sizes = spark.createDataFrame([("c", 50)], "container string, capacity int")
    got = packing.packed(docs, sizes).cache()
    bins = got.groupBy("bin").agg(F.sum("tokens").alias("t"))
    total = packing.sized(docs).agg(F.sum("tokens")).first()[0]
    assert got.agg(F.sum("tokens")).first()[0] == total and bins.agg(F.max("t")).first()[0] <= 50
    assert bins.count() <= -(-total // 50) + 2
    assert packing.packed(docs.limit(0), sizes).count() == 0


def test_repeated_ids_share_no_bin(spark):
    docs = spark.createDataFrame([(1, "word " * 40, "s"), (1, "word " * 40, "s"), (2**62, "word " * 90, "s")], "doc_id long, text string, source string")
    got = packing.packed(docs, spark.createDataFrame([("c", 16)], "container string, capacity int"))
    bins = got.groupBy("bin").agg(F.sum("tokens").alias("t"))
    assert bins.agg(F.max("t")).first()[0] <= 16 and got.agg(F.sum("tokens")).first()[0] == packing.sized(docs).agg(F.sum("tokens")).first()[0]
    with pytest.raises(ValueError, match="container"):
        packing.packed(docs, spark.createDataFrame([("c", 2_000_000)], "container string, capacity int"))


# p9


def test_apportionment_like_the_quotients():
    shares, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 3, "c": 100}
    for n in (0, 1, 7, 10, 33):
        got = {s: 0 for s in shares}
        for _ in range(n):
            s = max((s for s in shares if got[s] < most[s]), key=lambda s: (shares[s] / (2 * got[s] + 1), s))
            got[s] += 1
        assert mixing.apportion([n], shares, most)[0] == got


def test_mix_reaches_shares(spark):
    docs = spark.createDataFrame([(i, "word " * 20, "ab"[i % 10 == 0]) for i in range(2000)] + [(5000, None, "a"), (5001, "x", None), (5002, "x", "z")], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixed(docs, goal, block=100, shards=3)
    share = {r["source"]: r["actual_share"] for r in report.collect()}
    assert abs(share["a"] - 2 / 3) < 0.01 and share["none"] == 0
    assert chosen.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert {r["shard"] for r in chosen.collect()} == {0, 1, 2}


# p10


def brute_spans(texts, span):
    seen = {}
    for i, t in texts:
        for k in range(len(t) - span + 1):
            seen.setdefault(t[k : k + span], set()).add(i)
    out = []
    for i, t in texts:
        runs = []
        for k in range(len(t) - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + span
                else:
                    runs.append([k, k + span])
        out += [(i, a, b) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_spans_like_brute_force(spark, seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcé😀 ") for _ in range(n))
    shared = [text(n) for n in (39, 40, 41, 90, 200)]
    data = [(i, text(r.randrange(0, 80)) + r.choice(shared)[r.randrange(0, 3) :] + text(r.randrange(0, 80)) + r.choice(shared)) for i in range(40)]
    data += [(100, data[0][1]), (101, "a" * 300), (102, "a" * 150), (103, ""), (104, "ab" * 100)]
    docs = spark.createDataFrame([*data, (105, None)], "doc_id long, text string")
    assert rows(spans.shared_spans(docs, 40)) == brute_spans(data, 40)


def test_spans_within_the_least_document_that_has_them_twice(spark):
    r = random.Random(7)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    data = []
    for k in range(0, 30, 3):
        around, passage = (text(100), text(100)), text(60)
        data += [(k, around[0] + passage + around[1] + text(100) + passage + text(100)), (k + 1, text(9) + around[0] + passage + around[1])]
        data += [(k + 2, text(50))]
    assert rows(spans.shared_spans(spark.createDataFrame(data, "doc_id long, text string"), 40)) == brute_spans(data, 40)


def test_spans_let_go_of_all_anchors_before_windows_are_hashed(spark, monkeypatch):
    context = spark.sparkContext
    made, was_there = [], []
    plain = spans.cut

    def watched(df):
        if made:
            deadline = time.time() + 10 * (len(made) == 6)
            while os.path.exists(made[0]) and time.time() < deadline:
                time.sleep(0.1)
            was_there.append(os.path.exists(made[0]))
        done = plain(df)
        folder = context._jsc.sc().getCheckpointDir().get().removeprefix("file:")
        made.append(max((os.path.join(folder, x) for x in os.listdir(folder)), key=lambda x: int(x.rpartition("-")[2])))
        return done

    monkeypatch.setattr(spans, "cut", watched)
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    same = text(60)
    data = [(i, text(80) + same + text(80)) for i in range(20)]
    assert rows(spans.shared_spans(spark.createDataFrame(data, "doc_id long, text string"), 40)) == brute_spans(data, 40)
    assert len(made) == 7 + 1 and was_there[0] and not was_there[5]


def test_short_forms_show_under_surnames_of_many_forenames(spark):
    """More forenames than 64 stand under each surname of the short form; those that meet by chance are no short forms."""
    from graphloom.llm import names

    big = [(f"s{i}", g) for i in range(5) for g in ["zed", "zedekiah", *(f"g{i}x{j}" for j in range(70))]]
    common = [(f"s{i}", "anna") for i in range(5)] + [(f"t{i}", "anna") for i in range(900)]
    whole = big + common + [("u", "zedekiah")] + [(f"r{i}", f"h{i}") for i in range(4000)]
    got = names._aliases(spark.createDataFrame(whole, "sur string, given string")).collect()
    assert [tuple(r) for r in got] == [("zed", "zedekiah")]
