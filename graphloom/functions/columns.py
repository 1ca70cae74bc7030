"""Column functions: mathematics, vectors, text cleaning and equations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    """x ln x, 0 for x <= 0; null stays null."""
    return F.when(x <= 0, F.lit(0.0)).otherwise(x * F.log(x))


def delta(x: Column, y: Column) -> Column:
    """Change of the log likelihood when counts x and y merge."""
    return xlogx(x + y) - xlogx(x) - xlogx(y)


def relative_change(old: Column, new: Column) -> Column:
    return (new - old) / (old + 1)


def halvings(n: Column) -> Column:
    """How often n is halved until it is 1 at most: ceil(log2 n), 0 for n <= 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.ceil(F.log2(n))).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is all zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def clean_abstract(text: Column) -> Column:
    """Line breaks to spaces, formulas dropped, commands named `variable`, white space collapsed."""
    t = F.regexp_replace(text, r"[\r\n]+", " ")
    t = F.regexp_replace(t, r"\$.*\$", "")
    t = F.regexp_replace(t, r"\\\w+", "variable")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_article(text: Column) -> Column:
    """Citations to placeholders, white space collapsed."""
    t = F.regexp_replace(text, r"\[\d+(?:\s*[,–-]\s*\d+)*\]", " NumericCitation ")
    t = F.regexp_replace(t, r"\(\p{Lu}[^()]{0,80}?\d{4}[a-z]?\)", " Citation ")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_paragraph(text: Column) -> Column:
    t = F.regexp_replace(text, r"[\n ]+", " ")
    t = F.regexp_replace(t, r"\[\s*\d+(?:\s*[,–-]\s*\d+)*\s*\]", "")
    t = F.regexp_replace(t, r"\([^()]*\b(?:19|20)\d{2}\)", "")
    t = F.regexp_replace(t, r"\(\s*\)|\[\s*\]", "")
    t = F.regexp_replace(t, r"\. \. \.", "...")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r":\s*$", "."), r"\s+", " "))


def drop_repeat(text: Column, width: int = 500) -> Column:
    """A text whose first characters come again is cut just before the second time."""
    head = F.substring(text, 1, width)
    at = F.instr(F.substring(text, 2, 2**31 - 1), head)
    return F.when((F.char_length(text) > width) & (at > 0), F.left(text, at - 1)).otherwise(text)


def question(text: Column) -> Column:
    """One question mark at the end, first letter a capital."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\?", ""), r"^[^\p{L}]+", ""))
    return F.when(t == "", F.lit(None)).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2**31 - 1), F.lit("?")))


def equation_tag(formula: Column) -> Column:
    """A placeholder for a formula, made of its digest so that it is the same everywhere."""
    return F.concat(F.lit("Ltxqtn"), F.translate(F.substring(F.sha2(formula, 256), 1, 8), "0123456789abcdef", "bcdfghjklmnpqrst"))


def relation_class(operator: Column) -> Column:
    """compare, combine, function or transform."""
    o = F.lower(operator)
    return (
        F.when(o.isin("=", "<", ">", "<=", ">=", "!=", "eq", "ne", "lt", "gt", "le", "ge"), "compare")
        .when(o.isin("+", "-", "*", "/", "^", "add", "mul", "pow"), "combine")
        .when(o.isin("sin", "cos", "tan", "log", "exp", "sqrt"), "function")
        .otherwise("transform")
    )


def log_softmax(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.transform(a, lambda x: x.cast("double") - top - F.log(total))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def smoothed_loss(logits: Column, label: Column, smoothing: float = 0.1) -> Column:
    """Cross-entropy with the label's probability 1 - smoothing and the rest spread evenly over the other classes (from 0); null without another class."""
    p = log_softmax(logits)
    rest = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    own = F.get(p, label.cast("int"))
    return F.when(F.size(logits) > 1, -(1 - smoothing) * own - smoothing / (F.size(logits) - 1) * (rest - own))


def mask(length: Column, size: int) -> Column:
    """Ones for the first places, zeros for the others, `size` in all."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i <= length, 1).otherwise(0))
