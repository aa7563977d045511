"""Sources and sinks: text, HTML, GraphML, index tables, property-graph export."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions import text as T


def url_slug(url: Column) -> Column:
    """doc_id of a URL: host and path in lower case, other characters as single underscores."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z]+://", ""), "[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(path, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def html_text(html: Column) -> Column:
    """Fallback text of a page: without script, style and noscript, tags as line ends, white space cleaned."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    t = F.regexp_replace(t, "(?s)<[^>]*>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return T.clean_whitespace(F.regexp_replace(t, r"\n\s*", "\n"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a folder of UTF-8 text or markdown files; undecodable bytes are replaced."""
    rows = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    return rows.select(stem.alias("doc_id"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("sha256"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a sources list without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("source")).filter("source <> '' AND NOT startswith(source, '#')")


def corpus(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text) of stored documents and pages under one key."""
    a = documents.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), T.clean_whitespace(F.col("text")).alias("text"))
    return a.unionByName(pages.select(url_slug(F.col("url")).alias("doc_id"), html_text(F.col("html")).alias("text")))


_DATA = "data array<struct<_key:string,_VALUE:string>>"


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: id or source and target, and a map of named properties."""
    def rows(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)

    keys = rows("key", "_id string, `_attr.name` string").select(F.col("_id").alias("k"), F.col("`_attr.name`").alias("name"))
    look = {r["k"]: r["name"] for r in keys.distinct().collect()}  # the attribute declarations
    names = F.create_map(*[F.lit(x) for kv in look.items() for x in kv]) if look else F.create_map().cast("map<string,string>")
    props = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(names[d["_key"]], d["_key"]), d["_VALUE"])))
    nodes = rows("node", f"_id string, {_DATA}").select(F.col("_id").alias("id"), props.alias("props")).withColumn("label", F.col("props")["label"])
    edges = rows("edge", f"_id string, _source string, _target string, {_DATA}").select("_id", F.col("_source").alias("src"), F.col("_target").alias("dst"), props.alias("props"))
    kind = F.coalesce(F.col("props")["type"], F.lit("RELATED_TO"))
    return nodes, edges.select(F.coalesce("_id", T.edge_id(F.col("src"), kind, F.col("dst"), F.lit(""))).alias("edge_id"), "src", "dst", kind.alias("type"), "props")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of GraphML documents, one for each task; reads (id, label) and (edge_id, src, dst, type)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.lit(1).alias("o"), F.concat(F.lit('<node id="'), esc("id"), F.lit('"><data key="label">'), esc("label"), F.lit("</data></node>")).alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.concat(F.lit('<edge id="'), esc("edge_id"), F.lit('" source="'), esc("src"), F.lit('" target="'), esc("dst"), F.lit('"><data key="type">'), esc("type"), F.lit("</data></edge>")).alias("value"))
    head = nodes.sparkSession.createDataFrame([(0, '<key id="label" for="node" attr.name="label" attr.type="string"/>'), (0, '<key id="type" for="edge" attr.name="type" attr.type="string"/>')], "o int, value string")
    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['<?xml version="1.0" encoding="UTF-8"?>', "<graphml>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</graphml>"]})

    head.unionByName(n).unionByName(e).select("value").mapInPandas(document, "value string").write.text(path)


def write_index(items: DataFrame, path: str) -> None:
    """Index items as a table by type, for pruning."""
    items.write.mode("overwrite").partitionBy("item_type").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_groups(nodes: DataFrame, batch: int = 1000) -> DataFrame:
    """(label, n, batches): what a batched export of nodes by label sends."""
    label = T.schema_name(F.col("label"))
    return nodes.groupBy(label.alias("label")).agg(F.count("*").alias("n")).withColumn("batches", F.ceil(F.col("n") / batch))


def clean_number(c: Column) -> Column:
    """A property value without NaN."""
    return F.when(F.isnan(c), None).otherwise(c)
