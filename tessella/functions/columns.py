"""Scalar column functions: text cleaning, tokens, sentences, vectors, edit distance and confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands for a missing text.
PLACEHOLDER = "暂无相关信息"


def strip(value: Column) -> Column:
    """White space of any kind taken off both ends."""
    return F.btrim(value, F.lit(" \t\n\r\x0b\x0c\u3000\u00a0"))


def clean_text(value: Column, default: str = PLACEHOLDER) -> Column:
    """A string trimmed, line breaks as spaces; empty or null as the default."""
    plain = F.replace(strip(value), F.lit("\n"), F.lit(" "))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def clean_list(values: Column, default: str = PLACEHOLDER, mark: str = "、") -> Column:
    """The non-empty items of an array, trimmed and joined; nothing left as the default."""
    items = F.filter(F.transform(values, lambda x: F.replace(strip(x), F.lit("\n"), F.lit(" "))), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(items, mark), F.lit("")), F.lit(default))


def scrub(value: Column) -> Column:
    """Carriage returns, line breaks, no-break spaces, tabs and runs of three spaces taken out."""
    return F.replace(F.translate(value, "\r\n \t", ""), F.lit("   "), F.lit(""))


def strip_blanks(value: Column) -> Column:
    return F.translate(value, " \t", "")


def split_words(value: Column) -> Column:
    return F.filter(F.split(value, " "), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, then every CJK character; duplicates stay."""
    latin = F.transform(F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1)), F.lower)
    return F.concat(latin, F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1)))


def keyword_score(query: Column, doc: Column) -> Column:
    """Query tokens (with duplicates) found in the document, over the larger of the two token counts (query all, document distinct)."""
    hits = F.size(F.filter(query, lambda x: F.array_contains(doc, x)))
    return hits / F.greatest(F.size(query), F.size(doc))


def sentences(text: Column) -> Column:
    """Sentences with their closing mark, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, "(?<=[。；\n!?])"), strip), lambda x: x != "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) * F.lit(0.65)).cast("int")


def dot(a: Column, b: Column) -> Column:
    as_double = lambda v: v.cast("array<double>")
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    return F.transform(v.cast("array<double>"), lambda x: x / (F.sqrt(dot(v, v)) + F.lit(1e-8)))


def cosine_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def max_distance(n: Column) -> Column:
    """Edits allowed for a mention of n characters."""
    return F.when(n <= 2, 0).when(n <= 4, 1).otherwise(2)


def edit_similarity(distance: Column, a: Column, b: Column) -> Column:
    return F.lit(1.0) - distance / F.greatest(F.length(a), F.length(b))


def calibrated(stage: Column, similarity: Column, name: Column) -> Column:
    """Base confidence of the stage, 0.2 of the similarity and up to 0.1 for length, within 0 and 1."""
    base = F.when(stage == "exact", 1.0).when(stage == "alias", 0.95).when(stage == "vector", 0.85).when(stage == "edit", 0.75).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + 0.2 * similarity + F.least(F.length(name) / 10.0, F.lit(0.1))))


def edge_confidence(weight: Column, completeness: Column, hop: Column) -> Column:
    """0.7 of the relation weight (0.5 if unknown) and 0.3 of the node's completeness; a fifth less at the second hop."""
    plain = 0.7 * F.coalesce(weight, F.lit(0.5)) + 0.3 * completeness
    return F.when(hop == 2, plain * 0.8).otherwise(plain)


def completeness(props: Column) -> Column:
    """Filled share of a property map, name and id aside; 0.5 where there are no other keys."""
    rest = F.map_filter(props, lambda k, v: ~k.isin("name", "id"))
    full = F.map_filter(rest, lambda k, v: v.isNotNull() & (v != ""))
    return F.when(F.size(rest) == 0, 0.5).otherwise(F.size(full) / F.size(rest))


def before_paren(value: Column) -> Column:
    return F.substring_index(value, "(", 1)


def inside_paren(value: Column) -> Column:
    return F.replace(F.substring_index(value, "(", -1), F.lit(")"), F.lit(""))


def title_cut(value: Column) -> Column:
    return F.substring_index(value, "的简介", 1)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n...（内容已截断）"))).otherwise(text)


def three_digits(value: Column) -> Column:
    """A number with three digits as printf rounds it: by its binary value, halves to even. (format_string rounds its shortest decimal, halves up.)

    The thousandfold as an exact sum of two doubles (the number split into halves of 26 bits); huge numbers and NaN go to format_string.
    """
    x = F.abs(value)
    scaled = x * F.lit(134217729.0)
    high = scaled - (scaled - x)
    h, low = high * 1000.0, (x - high) * 1000.0
    n = F.floor(h + low)
    over = h - n.cast("double") - 0.5
    m = n + F.when((over > -low) | ((over == -low) & (n % 2 == 1)), 1).otherwise(0)
    sign = F.when(value < 0, "-").otherwise("")
    exact = F.concat(sign, F.format_string("%d.%03d", F.floor(m / 1000).cast("long"), m % 1000))
    return F.when(x < 1e12, exact).otherwise(F.format_string("%.3f", value))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)
