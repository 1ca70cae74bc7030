"""Readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())])
INDEX = {
    "entity2id": "ent string, id bigint",
    "relation2id": "rel string, id bigint",
    "train2id": "head bigint, tail bigint, relation bigint",
}


def index_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A tab-separated index whose first line is the number of rows; short lines give nulls."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*\d*\s*$"))
    cells = F.split(F.rtrim("value"), "\t")
    fields = T.StructType.fromDDL(INDEX[kind]).fields
    return lines.select(*[F.trim(F.get(cells, F.lit(i))).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def newest(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file of a pattern, by its modification time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", "modificationTime").alias("p")).first()
    return row["p"]


def corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, metadata, text) of a JSON object keyed by article."""
    value = "map<string, struct<metadata: map<string, string>, text: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", value).alias("m"))
    return whole.select(F.explode("m").alias("id", "v")).select("id", "v.metadata", "v.text")


def tei(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, authors, abstract, text) of TEI files; a missing title or abstract is `**NONE**`, a file that is no XML gives nulls."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"\sxmlns=\"[^\"]*\"", "").alias("x"))
    ok = F.col("x").rlike(r"(?s)^\s*<.*</\w+>\s*$")
    joined = lambda p: F.when(ok, F.array_join(F.filter(F.xpath("x", F.lit(p)), lambda s: s.isNotNull()), " "))
    none = lambda c: F.when(F.trim(c) == "", F.lit("**NONE**")).otherwise(F.trim(c))
    return raw.select("file", none(joined("//titleStmt/title/text()")).alias("title"), F.when(ok, F.array_distinct(F.xpath("x", F.lit("//author//surname/text()")))).alias("authors"), none(joined("//abstract//p/text()")).alias("abstract"), joined("//body//p/text()").alias("text"))


def html_article(pages: DataFrame) -> DataFrame:
    """The text of <article>, white space collapsed; null where there is none."""
    body = F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)
    return pages.withColumn("text", F.when(body != "", F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]+>", " "), r"\s+", " "))))


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """(token, vec) of a text of words and numbers, restricted to a vocabulary (token) where one is given."""
    cells = F.split("value", " ")
    rows = spark.read.text(path).select(F.get(cells, F.lit(0)).alias("token"), F.transform(F.slice(cells, 2, 2**30), lambda x: x.cast("double")).alias("vec"))
    return rows if vocabulary is None else rows.join(vocabulary, "token", "left_semi")


# Endings of the files of each source
EXTENSIONS = {"springer": ("html",), "pubmed": ("xml",), "arxiv": ("xml",)}
# How paragraphs and formulas are marked
PARAGRAPHS = {"springer": r"(?s)<p[^>]*class=['\"]Para['\"][^>]*>(.*?)</p>", "pubmed": r"(?s)<p(?:\s[^>]*)?>(.*?)</p>", "arxiv": r"(?s)(?:<p(?:\s[^>]*)?>(.*?)</p>)|(?:<formula[^>]*>.*?</formula>)"}


def sources(spark: SparkSession, root: str, kinds: dict[str, tuple[str, ...]] = EXTENSIONS) -> DataFrame:
    """(file, source, raw) of the files in a folder for each source, those with the source's endings only; an empty file has a null raw."""
    rows = spark.read.text(f"{root}/*", wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("raw"))
    place = F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1)
    wanted = F.lit(False)
    for source, ends in kinds.items():
        wanted = wanted | ((place == source) & F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*ends))
    return rows.where(wanted).select("file", place.alias("source"), F.when(F.trim("raw") != "", F.col("raw")).alias("raw"))


def plain(xml: Column) -> Column:
    """The text of a piece of XML: tags dropped, entities read, white space collapsed."""
    t = F.regexp_replace(xml, r"(?s)<[^>]+>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def stringified(xml: Column) -> Column:
    """A paragraph's text: references dropped, formulas within as `<FORMULA>`, one that stands alone as `<LONG_FORMULA>`, with the mark they end in."""
    inline = r"(?s)<(formula|[a-z]+ class=['\"]InlineEquation['\"])[^>]*>[^<]*?([,.;:]?)</\w+>"
    t = F.regexp_replace(xml, r"(?s)<ref[^>]*>.*?</ref>|<ref[^>]*/>", "")
    long = F.regexp_replace(t, r"(?s)^\s*<formula[^>]*>[^<]*?([,.;:]?)</formula>\s*$", "&lt;LONG_FORMULA&gt;$1")
    return plain(F.regexp_replace(long, inline, "&lt;FORMULA&gt;$2"))


def paragraphs(files: DataFrame) -> DataFrame:
    """(file, source, pos, text): the paragraphs of files (file, source, raw) as their source marks them, in order; empty ones are left out."""
    found = F.lit(None).cast("array<string>")
    for source, pattern in PARAGRAPHS.items():
        found = F.when(F.col("source") == source, F.regexp_extract_all("raw", F.lit(pattern), F.lit(0))).otherwise(found)
    each = files.select("file", "source", F.posexplode(found).alias("pos", "p"))
    return each.select("file", "source", "pos", stringified(F.col("p")).alias("text")).where("text <> ''")


def pubmed(files: DataFrame) -> DataFrame:
    """(file, doi, pmid, title, journal, year, text) of articles (file, raw) in the journal tag set; text joins the paragraphs of the body.

    What is missing is null. Articles are read with patterns, so one that is not well-formed still gives what can be found.
    """
    one = lambda p: F.when(F.regexp_extract("raw", p, 1) != "", plain(F.regexp_extract("raw", p, 1)))
    ident = lambda kind: one(rf"(?s)<article-id[^>]*pub-id-type=['\"]{kind}['\"][^>]*>(.*?)</article-id>")
    body = F.regexp_extract("raw", r"(?s)<body[^>]*>(.*)</body>", 1)
    joined = F.array_join(F.filter(F.transform(F.regexp_extract_all(body, F.lit(PARAGRAPHS["pubmed"]), F.lit(1)), plain), lambda p: p != ""), " ")
    return files.select("file", ident("doi").alias("doi"), ident("pmid").alias("pmid"), one(r"(?s)<article-title[^>]*>(.*?)</article-title>").alias("title"), one(r"(?s)<journal-title[^>]*>(.*?)</journal-title>").alias("journal"), one(r"(?s)<pub-date[^>]*>.*?<year>(\d+)</year>").cast("int").alias("year"), joined.alias("text"))


def aggregated_pubmed(articles: DataFrame) -> DataFrame:
    """(key, text, ...): articles with text by DOI, else by the name of the file; of several with one key the last file counts."""
    name = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"\.xml$", "")
    keyed = articles.where("length(text) > 0").withColumn("key", F.coalesce("doi", name))
    rest = [c for c in keyed.columns if c != "key"]
    return keyed.groupBy("key").agg(F.max_by(F.struct(*rest), "file").alias("a")).select("key", "a.*")


def with_metadata(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """(key, source, fn, text): articles (source, fn, doi) with the text of their file (file, text); arXiv by the file's name, others by DOI. Without a file the text is null."""
    texts = files.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("fn"), "text")
    key = F.when(F.col("source") == "arxiv", F.regexp_replace("fn", r"\.pdf$", "")).otherwise(F.col("doi"))
    return metadata.join(texts, "fn", "left").select(key.alias("key"), "source", "fn", "text")


def usable(corpus: DataFrame, bad: list[str]) -> DataFrame:
    """Articles (id, text) with text whose id is not among the bad ones."""
    return corpus.where((F.length(F.trim("text")) > 0) & ~F.col("id").isin(*bad)) if bad else corpus.where(F.length(F.trim("text")) > 0)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, metadata, text) of JSON lines, which unlike one object are read in parallel."""
    return spark.read.schema(CORPUS).json(path)


def parse_tokens(inputs: DataFrame, morphs: DataFrame) -> DataFrame:
    """(doc, sent, idx, form, pos, lemma) of texts (doc, text) with lines `form_POS` and lines of lemmas; blank lines end sentences, ROOT is token 0.

    A colon of a lemma becomes a full stop, and what follows `_nn` is cut off.
    """

    def lines(df: DataFrame) -> DataFrame:
        blocks = df.select("doc", F.posexplode(F.filter(F.split(F.trim("text"), r"\n\s*\n"), lambda b: F.trim(b) != "")).alias("sent", "b"))
        return blocks.select("doc", "sent", F.posexplode(F.split(F.trim("b"), r"\s*\n\s*")).alias("i", "line")).select("doc", "sent", (F.col("i") + 1).alias("idx"), "line")

    lemma = F.regexp_replace(F.lower(F.replace("morph", F.lit(":"), F.lit("."))), r"_nn.*$", "")
    both = lines(inputs).join(lines(morphs).withColumnRenamed("line", "morph"), ["doc", "sent", "idx"], "left")
    words = both.where(F.col("line").contains("_")).select("doc", "sent", "idx", F.regexp_extract("line", r"^(.*)_[^_]*$", 1).alias("form"), F.regexp_extract("line", r"_([^_]*)$", 1).alias("pos"), lemma.alias("lemma"))
    roots = words.select("doc", "sent").distinct().select("doc", "sent", F.lit(0).alias("idx"), F.lit("ROOT").alias("form"), F.lit("ROOT").alias("pos"), F.lit("ROOT").alias("lemma"))
    return words.unionByName(roots)


def labelled_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label) of a tab-separated file with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="id bigint, text string, label int", quote="")


def token_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tokens) of lines of words with spaces between them."""
    return spark.read.text(path).select(F.filter(F.split("value", " "), lambda w: w != "").alias("tokens"))


def query_column(spark: SparkSession, path: str, column: str = "Query") -> DataFrame:
    """(query) of a file of comma-separated values with a header."""
    return spark.read.csv(path, header=True).select(F.col(column).alias("query")).where("query is not null")


def newest_by_name(names: DataFrame) -> DataFrame:
    """(name, stamp): of names with a time such as `12Mar2020-10:11:12` the newest."""
    stamp = F.try_to_timestamp(F.regexp_extract("name", r"(\d{2}[A-Z][a-z]{2}\d{4}-\d{2}:\d{2}:\d{2})", 1), F.lit("ddMMMyyyy-HH:mm:ss"))
    return names.select("name", stamp.alias("stamp")).where("stamp is not null").orderBy(F.desc("stamp"), "name").limit(1)
