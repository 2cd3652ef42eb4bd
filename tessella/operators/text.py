"""Graph linearisation, sections, chunks and flags; HTML and attribute extraction; word segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .constants import EMPTY_SECTIONS, SECTION_RELATIONS
from .graph import literal_map

#: Fixed value: the document template, one section a line; the cure period and rate share a line.
TEMPLATE = [
    ("疾病档案", "name"), ("分类路径", "category"), ("疾病简介", "desc"), ("发病原因", "cause"), ("易感人群", "easy_get"), ("预防措施", "prevent"),
    ("治疗周期", "cure_lasttime"), ("临床治愈率", "cured_prob"), ("医保状态", "yibao_status"),
    ("常见症状", "has_symptom"), ("并发疾病", "acompany_with"), ("推荐检查", "need_check"), ("治疗方案", "cure_way"), ("临床推荐用药", "recommand_drug"),
    ("常用辅助药物", "common_drug"), ("饮食宜吃", "do_eat"), ("饮食禁忌", "no_eat"), ("推荐食谱", "recommand_eat"),
]
JOINED_AFTER, BLANK_AFTER = {"治疗周期": " | "}, {"医保状态"}


def neighbourhoods(edges: DataFrame, names: DataFrame, relations: list[str]) -> DataFrame:
    """(id, one sorted array of neighbour names for each relation): one group-by with a pivot, not a join for each relation."""
    named = edges.filter(F.col("rel_type").isin(relations)).join(names.select(F.col("id").alias("dst"), F.col("name")), "dst")
    return named.groupBy(F.col("src").alias("id")).pivot("rel_type", relations).agg(F.array_sort(F.collect_set("name")))


def render(records: DataFrame, template: list[tuple[str, str]] = TEMPLATE) -> DataFrame:
    """records with raw_text: every template section with its field cleaned, missing fields as the placeholder."""
    kinds = dict(records.dtypes)
    parts = []
    for k, (title, field) in enumerate(template):
        value = F.lit(C.PLACEHOLDER) if field not in kinds else C.clean_list(F.col(field)) if kinds[field].startswith("array") else C.clean_text(F.col(field).cast("string"))
        end = "" if k + 1 == len(template) else JOINED_AFTER.get(title, "\n\n" if title in BLANK_AFTER else "\n")
        parts += [F.lit(f"【{title}】"), value, F.lit(end)]
    return records.withColumn("raw_text", F.concat(*parts))


def sections(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """docs exploded into (pos, title, content); empty and placeholder sections go."""
    parts = F.filter(F.transform(F.split(text_col, "【", -1), lambda p: F.split(p, "】", 2)), lambda p: F.size(p) == 2)
    rows = docs.select("*", F.posexplode(parts).alias("pos", "part"))
    out = rows.withColumn("title", C.strip(F.col("part")[0])).withColumn("content", C.strip(F.col("part")[1])).drop("part")
    return out.filter((F.col("content") != "") & ~F.col("content").isin(EMPTY_SECTIONS))


def chunk_texts(content: Column, prefix: Column, most: int = 256, overlap: int = 2, min_tail: int = 15, tail_rule: str = "reference") -> Column:
    """The chunks of a section, as an array: the whole if it fits, else sentences packed greedily with an overlap.

    A full buffer is flushed before the sentence that would overflow it, and its last `overlap` sentences start the next
    one if it held more than those. tail_rule "reference" keeps the last buffer only with min_tail sentences or more,
    "chars" only with min_tail characters or more.
    """
    est = C.token_estimate
    state_type = "struct<chunks:array<string>,buf:array<string>,tok:int>"
    start = F.struct(F.array().cast("array<string>").alias("chunks"), F.array().cast("array<string>").alias("buf"), F.lit(0).alias("tok")).cast(state_type)
    joined = lambda buf: F.concat(prefix, F.array_join(buf, ""))

    def step(s: Column, sentence: Column) -> Column:
        full = (s["tok"] + est(sentence) > most) & (F.size(s["buf"]) > 0)
        carried = F.when(F.size(s["buf"]) > overlap, F.slice(s["buf"], -overlap, overlap)).otherwise(F.array().cast("array<string>"))
        carried_tokens = F.aggregate(F.transform(carried, est), F.lit(0), lambda a, x: a + x)
        return F.struct(
            F.when(full, F.concat(s["chunks"], F.array(joined(s["buf"])))).otherwise(s["chunks"]).alias("chunks"),
            F.concat(F.when(full, carried).otherwise(s["buf"]), F.array(sentence)).alias("buf"),
            (F.when(full, carried_tokens).otherwise(s["tok"]) + est(sentence)).cast("int").alias("tok"),
        ).cast(state_type)

    def finish(s: Column) -> Column:
        enough = F.size(s["buf"]) >= min_tail if tail_rule == "reference" else F.length(F.array_join(s["buf"], "")) >= min_tail
        return F.when(enough, F.concat(s["chunks"], F.array(joined(s["buf"])))).otherwise(s["chunks"])

    whole = F.concat(prefix, content)
    return F.when(est(whole) <= most, F.array(whole)).otherwise(F.aggregate(C.sentences(content), start, step, finish))


def safety_flags(cured_prob: Column, yibao_status: Column) -> Column:
    """low_cure_rate if the first number of the rate is below 50, non_medical_insurance if the status is no."""
    rate = F.nullif(F.regexp_extract(F.coalesce(cured_prob, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return F.array_compact(F.array(F.when(rate < 50, F.lit("low_cure_rate")), F.when(yibao_status == "否", F.lit("non_medical_insurance"))))


def chunks(docs: DataFrame, **packing) -> DataFrame:
    """Chunk rows of documents (kg_id, entity_type, name, raw_text): chunk_id, section_type, involved_relations, text."""
    rows = sections(docs)
    prefix = F.concat(F.lit("【"), F.col("name"), F.lit("】的"), F.col("title"), F.lit("包括："))
    made = rows.select("*", F.posexplode(chunk_texts(F.col("content"), prefix, **packing)).alias("idx", "text"))
    relations = F.split(F.coalesce(F.element_at(literal_map({k: ",".join(v) for k, v in SECTION_RELATIONS.items()}), F.col("title")), F.lit("")), ",")
    return made.select(
        F.concat_ws("__", F.col("kg_id").cast("string"), "title", F.col("idx").cast("string")).alias("chunk_id"), "kg_id", "entity_type",
        F.col("title").alias("section_type"), F.array_remove(relations, "").alias("involved_relations"), "text",
    )


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def html_links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def html_paragraphs(html: Column) -> Column:
    """The text of every paragraph, tags taken out."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.transform(inner, lambda x: C.strip(F.regexp_replace(x, "<[^>]*>", "")))


def html_by_class(html: Column, tag: str, name: str) -> Column:
    """The texts of elements of a class (one among several it may have), the tags inside taken out; elements of one tag don't nest."""
    inner = F.regexp_extract_all(html, F.lit(rf'(?is)<{tag}\s[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</{tag}>'), F.lit(1))
    return F.transform(inner, lambda x: C.strip(F.regexp_replace(x, "<[^>]*>", "")))


def attr_pairs(items: Column, mark: str = "：") -> Column:
    """A map of items of exactly two parts around the mark; the last of a repeated key wins."""
    parts = F.filter(F.transform(items, lambda x: F.split(x, mark, -1)), lambda p: F.size(p) == 2)
    last = F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: q[0] == p[0]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], p[1])))


def rename_keys(attrs: Column, names: dict[str, str]) -> Column:
    """A map with its keys renamed; unknown keys go."""
    table = literal_map(names)
    return F.transform_keys(F.map_filter(attrs, lambda k, v: F.map_contains_key(table, k)), lambda k, v: F.element_at(table, k))


def clean_names(names: Column) -> Column:
    """Distinct names that don't begin with a-z or 0-9."""
    return F.array_distinct(F.filter(names, lambda x: ~x.rlike("^[a-z0-9]")))


def forward_cut(text: str, words: set[str], longest: int) -> list[str]:
    out, i = [], 0
    while i < len(text):
        step = next((n for n in range(min(longest, len(text) - i), 1, -1) if text[i : i + n] in words), 1)
        out.append(text[i : i + step])
        i += step
    return out


def backward_cut(text: str, words: set[str], longest: int) -> list[str]:
    out, end = [], len(text)
    while end:
        step = next((n for n in range(min(longest, end), 1, -1) if text[end - n : end] in words), 1)
        out.append(text[end - step : end])
        end -= step
    return out[::-1]


def two_way_cut(text: str, words: set[str], longest: int) -> list[str]:
    """The cut with fewer tokens; on a tie, with fewer single characters, else forward."""
    f, b = forward_cut(text, words, longest), backward_cut(text, words, longest)
    if len(f) != len(b):
        return f if len(f) < len(b) else b
    return b if sum(len(x) == 1 for x in b) < sum(len(x) == 1 for x in f) else f


#: Words that are shipped to the workers at most, some tens of bytes each.
SHIPPED_WORDS = 500_000


def segment(texts: DataFrame, words: DataFrame, text_col: str = "text", shipped: int = SHIPPED_WORDS) -> DataFrame:
    """texts with `cut`, their two-way segmentation by the words in the one column of words.

    Up to `shipped` words go to the workers. More stay a table: the substrings of each distinct text meet it in a join, and
    a text is cut by the words found in it, which gives the same cut. A null text has a null cut.
    """
    known = words.select(F.col(words.columns[0]).alias("__w")).filter("__w <> ''").distinct()
    size, longest = known.agg(F.count(F.lit(1)), F.max(F.length("__w"))).first()
    if size <= shipped:
        return texts.withColumn("cut", segmenter([r["__w"] for r in known.orderBy("__w").toLocalIterator()])(F.col(text_col)))
    alone = texts.select(F.col(text_col).alias("__t")).filter(F.length("__t") > 1).distinct()
    windows = alone.select("__t", F.explode(F.transform(F.sequence(F.lit(1), F.length("__t") - 1), lambda i: F.substring("__t", i, F.lit(longest)))).alias("__x"))
    pieces = windows.select("__t", F.explode(F.transform(F.sequence(F.lit(2), F.length("__x")), lambda n: F.substring("__x", F.lit(1), n))).alias("__w"))
    found = pieces.join(known, "__w", "left_semi").groupBy(F.col("__t").alias(text_col)).agg(F.collect_set("__w").alias("__found"))
    return texts.join(found, text_col, "left").withColumn("cut", _cut_by_found()(F.col(text_col), F.col("__found"))).drop("__found")


def _cut_by_found():
    import pandas as pd

    def cut(texts, found):
        sets = ([] if words is None else list(words) for words in found)
        return pd.Series([None if t is None else two_way_cut(t, set(words), max(map(len, words), default=1)) for t, words in zip(texts, sets)], dtype=object)

    cut.__annotations__ = {"texts": pd.Series, "found": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, T.ArrayType(T.StringType()))


def segmenter(words: list[str]):
    """A pandas UDF that segments strings by a dictionary, which is shipped with it; `segment` checks its size."""
    import pandas as pd

    known, longest = set(words), max(map(len, words), default=1)

    def cut(texts):
        return texts.map(lambda t: None if t is None else two_way_cut(t, known, longest))

    cut.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(cut, T.ArrayType(T.StringType()))
