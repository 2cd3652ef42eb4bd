"""Readers and writers: records, dictionaries, chunks, graphs and exports. Paths are read by Spark only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.constants import FILE_TYPES
from ..operators.graph import literal_map

_S, _A = T.StringType(), T.ArrayType(T.StringType())
SCALARS = ["name", "desc", "prevent", "cause", "get_prob", "easy_get", "cure_lasttime", "cured_prob", "yibao_status", "get_way", "cost_money"]
LISTS = ["symptom", "acompany", "cure_department", "cure_way", "common_drug", "recommand_drug", "drug_detail", "not_eat", "do_eat", "recommand_eat", "check", "category"]
RECORD = T.StructType([T.StructField(c, _S) for c in SCALARS] + [T.StructField(c, _A) for c in LISTS])
CHUNK = T.StructType([
    T.StructField("chunk_id", _S), T.StructField("kg_id", _S), T.StructField("entity_type", _S), T.StructField("section_type", _S),
    T.StructField("involved_relations", _A), T.StructField("safety_flags", _A), T.StructField("text", _S), T.StructField("version", _S),
    T.StructField("metadata", T.MapType(_S, _S)), T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """One JSON record a line; missing strings are empty, missing lists empty lists, and records without a name go."""
    raw = spark.read.schema(schema).json(path)
    filled = [F.coalesce(F.col(f.name), F.lit("") if isinstance(f.dataType, T.StringType) else F.array().cast(f.dataType)).alias(f.name) for f in schema]
    return raw.select(*filled).filter(F.length("name") > 0) if "name" in schema.names else raw.select(*filled)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    told = T.StructType([*schema.fields, T.StructField("_bad", _S)])
    parsed = lines.select("value", F.from_json("value", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter(F.col("r._bad").isNull() & F.col("r").isNotNull())
    return good.select("r.*").drop("_bad"), parsed.filter(F.col("r._bad").isNotNull() | F.col("r").isNull()).select("value")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_dictionary(spark: SparkSession, folder: str, types: dict[str, str] = FILE_TYPES) -> DataFrame:
    """(name, aliases, kg_id, etype) of `name|alias,alias|id` lines; the type comes from the file name, other files are skipped."""
    lines = spark.read.text(f"{folder}/*.txt").select(F.trim("value").alias("value"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("file"))
    parts = F.split("value", r"\|", -1)
    part = lambda k: F.trim(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    aliases = F.filter(F.transform(F.split(part(1), ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.element_at(literal_map(types), F.lower("file"))
    return lines.select(part(0).alias("name"), aliases.alias("aliases"), F.nullif(part(2), F.lit("")).alias("kg_id"), known.alias("etype")).filter("name <> '' and etype is not null")


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(word) of a word list, and the longest word's length."""
    words = spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()
    return words, words.agg(F.max(F.length("word"))).first()[0] or 0


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes partitioned by label, edges by relation: later reads of one kind prune the rest."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_names(nodes: DataFrame, path: str) -> None:
    """The names of each label as text, one folder a label."""
    nodes.select(F.col("name").alias("value"), "label").write.mode("overwrite").partitionBy("label").text(path)


def page_urls(spark: SparkSession, first: int, last: int, patterns: list[str]) -> DataFrame:
    """(page, url) of a range of pages and url patterns with %d; fetching is left to a crawler."""
    ids = spark.range(first, last + 1).withColumnRenamed("id", "page")
    return ids.select("page", F.explode(F.array(*(F.format_string(p, "page") for p in patterns))).alias("url"))


def page_bundle(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, links, paragraphs) of raw pages."""
    from ..operators import text as TX

    html = F.col("html")
    return pages.select("page_id", "url", C.title_cut(TX.html_title(html)).alias("title"), TX.html_links(html).alias("links"), TX.html_paragraphs(html).alias("paragraphs"))
