"""Registered queries of the build plan, files, streams and model-output parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import parsing
from kestrel.operators import graph as graph_ops
from kestrel.operators import relations, retrieve, vectors
from kestrel.operators.scratch import folder
from kestrel.plans import build, retrieval
from kestrel.plans.base import rows, table
from kestrel.plans.graph_queries import tree_edges, tree_nodes
from kestrel.sources import io
from kestrel.streaming import ingest

RAW = ("id int, raw string", [(0, '```json\n{"b": 1, "a": [1, 2]}\n```'), (1, 'text {"a": {"b": [1, 2'), (2, "no json"), (3, '{"a": "open'), (4, '[1, 2, {"x": true}'), (5, None)])


def graph(spark, sf):
    nodes, edges = build.build(table(spark, sf, "documents").select("doc_id", "text"))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")))


def hybrid_search(spark, sf):
    """The benchmark's texts as questions to the graph and index of all documents."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = retrieval.search(asked, retrieval.corpus(table(spark, sf, "documents").select("doc_id", "text")))
    return found.select("query_id", "id", "item_type", "sem", "graph", "hybrid", "place")


def expansion(spark, sf):
    nodes, edges = tree_nodes(spark, sf), tree_edges(spark, sf)
    items = nodes.select("id", F.col("label").alias("item_type"))
    cands = nodes.filter("label = 'COMMUNITY'").select(F.lit(0).alias("query_id"), "id", F.col("label").alias("item_type"), F.lit(0.5).alias("sem"), F.lit(0.1).alias("graph"))
    return build.expand(cands, nodes, edges, items).select("query_id", "id", "item_type", "sem", F.round("graph", 6).alias("graph"))


EXPAND_SQL = """WITH n AS (SELECT 'r:' || r_regionkey AS id, 'COMMUNITY' AS t FROM region UNION ALL SELECT 'n:' || n_nationkey, 'COMMUNITY' FROM nation UNION ALL SELECT 's:' || s_suppkey, 'ENTITY' FROM supplier),
e AS (SELECT 'n:' || n_nationkey AS a, 'r:' || n_regionkey AS b FROM nation UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), hit AS (SELECT DISTINCT u.b AS id FROM u JOIN n ON n.id = u.a AND n.t = 'COMMUNITY')
SELECT 0 AS query_id, n.id, n.t AS item_type, CASE WHEN t = 'COMMUNITY' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sem, CASE WHEN t = 'COMMUNITY' THEN round(0.1::DOUBLE + CASE WHEN hit.id IS NOT NULL THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, 6) ELSE 1.0::DOUBLE END AS graph
FROM n LEFT JOIN hit ON hit.id = n.id WHERE t = 'COMMUNITY' OR hit.id IS NOT NULL"""


def structural(spark, sf):
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("comm"), F.col("s_name").alias("canonical"), F.lit(1).alias("mentions"))
    comms = members.groupBy("comm").agg(F.count("*").alias("members_count")).withColumn("coherence", F.lit(0.5)).withColumn("id", F.concat(F.lit("n:"), "comm"))
    cands = comms.select(F.lit(0).alias("query_id"), "id", F.col("members_count").cast("double").alias("hybrid"))
    return build.structural_answer(cands, comms, members, least=1)


STRUCT_SQL = """WITH c AS (SELECT s_nationkey AS comm, count(*) AS n, 'n:' || s_nationkey AS id FROM supplier GROUP BY 1), b AS (SELECT * FROM c ORDER BY n DESC, id LIMIT 12),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, id) AS INTEGER) AS r FROM b WHERE n > 1), m AS (SELECT s_nationkey AS comm, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS k FROM supplier)
SELECT 0 AS query_id, r.comm, r.r, string_agg(s_name, ', ' ORDER BY k) AS members FROM r JOIN m ON m.comm = r.comm AND k <= 10 WHERE r.r <= 6 GROUP BY ALL"""


def second_pass(spark, sf):
    q = rows(spark, ("query_id int, q string", [(0, "statutory override of an exclusion"), (1, "what is x")]))
    first = rows(spark, ("query_id int, id string, text string, hybrid double", [(0, "a", "notwithstanding the exclusion", 0.5), (1, "b", "x", 0.4)]))
    found = lambda again: again.select("query_id", F.lit("z").alias("id"), F.concat(F.lit("right of recovery: "), F.length("q").cast("string")).alias("text"), F.lit(0.3).alias("hybrid"))
    return build.second_pass(first, q, found)


def cached(spark, sf):
    docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    cache = vectors.hash_embed(docs.filter("id % 2 = 0").select(F.sha2("text", 256).alias("id"), "text").dropDuplicates(["id"])).withColumnRenamed("id", "key")
    every, _ = build.cached(docs, cache, vectors.hash_embed)
    return every.select("id", F.size("embedding").alias("dim"))


def graphml(spark, sf):
    nodes, edges = tree_nodes(spark, sf), tree_edges(spark, sf).withColumn("edge_id", F.concat("src", F.lit("-"), "dst"))
    path = folder(spark, "graphml")
    io.write_graphml(nodes, edges, path)
    n, e = io.read_graphml(spark, path)
    return n.select("id", "label").unionByName(e.select(F.col("edge_id").alias("id"), F.col("type").alias("label")))


def index_files(spark, sf):
    docs = table(spark, sf, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("id"), "text", F.lit("SENTENCE").alias("item_type"))
    path = folder(spark, "index")
    io.write_index(retrieve.build_index(docs), path)
    return io.read_index(spark, path).groupBy("item_type").agg(F.count("*").alias("n"))


def text_files(spark, sf):
    path = folder(spark, "texts")
    table(spark, sf, "region").select("r_name").coalesce(1).write.text(path)
    return io.read_texts(spark, path).select(F.regexp_replace("text", "\n", ",").alias("text"), "sha256")


def sliding(spark, sf):
    since = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', start)")  # whatever the session's zone is
    return ingest.sliding_counts(table(spark, sf, "events")).select(since.alias("start"), "event_type", "n")


def stream(spark, sf):
    """The same counts of events by type, through a file stream and a table of batches."""
    base = folder(spark, "stream")
    table(spark, sf, "events").write.parquet(base + "/in")
    schema = table(spark, sf, "events").schema
    ingest.ingest(spark, base + "/in", schema, base + "/out", base + "/state", lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")))
    return spark.read.parquet(base + "/out").groupBy("event_type").agg(F.sum("n").alias("n"))


def merged(spark, sf):
    cat = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("canonical"), F.col("p_type").alias("label"))
    return relations.merge_catalog(cat).select("label", "canonical", "ord", F.size("aliases").alias("n"))


MERGED_SQL = r"""WITH k AS (SELECT p_partkey AS ord, p_name, p_type AS label, list_sort(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS b FROM part)
SELECT label, arg_min(p_name, ord) AS canonical, min(ord) AS ord, CAST(count(DISTINCT p_name) AS INTEGER) AS n FROM k GROUP BY label, b"""


def importance(spark, sf):
    e = tree_edges(spark, sf).filter("type = 'PART_OF'").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight"))
    return graph_ops.importance(e).select("node", F.round("rank", 6).alias("rank"))


def ingested(spark, sf):
    raw = rows(spark, ("doc_id int, head string, relation string, tail string, confidence double, evidence string", [(1, "Insurer", "owns", "Claim", 0.9, "pays"), (1, "Insurer", "owns", "Claim", 0.9, "pays"), (1, "New Thing", "part of", "Insurer", 0.8, "nowhere"), (1, "a", "9x", "b", 0.9, "")]))
    cat = rows(spark, ("canonical string", [("insurer",), ("claim",)]))
    sents = rows(spark, ("doc_id int, idx int, sent_id string, text string", [(1, 0, "s0", "First."), (1, 1, "s1", "The insurer pays.")]))
    nodes, edges = build.ingest_relations(raw, cat, sents)
    return edges.select("src", "type", "dst", "sent_id").unionByName(nodes.select(F.col("id").alias("src"), F.lit("NODE").alias("type"), F.col("canonical").alias("dst"), F.lit(None).cast("string").alias("sent_id")))


def community_items(spark, sf):
    c = table(spark, sf, "nation").select(F.concat(F.lit("comm:"), "n_nationkey").alias("id"), F.concat(F.lit("Community of "), "n_name").alias("summary"), F.col("n_name").alias("micro_summary"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("bullets"))
    return retrieve.community_items(c)


def queries() -> dict:
    """name: (query, SQL or None)."""
    return {
        "build_graph": (graph, None),
        "ret1_hybrid_search": (hybrid_search, None),
        "gra5_expand": (expansion, EXPAND_SQL),
        "gra18_structural_answer": (structural, STRUCT_SQL),
        "jon5_merge_catalog": (merged, MERGED_SQL),
        "gra12_betweenness": (importance, None),
        "rel3_ingest_relations": (ingested, None),
        "idx1_community_items": (community_items, "SELECT 'comm:' || n_nationkey AS id, 'Community of ' || n_name AS text, 'COMMUNITY' AS item_type FROM nation UNION ALL SELECT 'comm:' || n_nationkey || '::micro', n_name, 'COMMUNITY_MICRO' FROM nation UNION ALL SELECT 'comm:' || n_nationkey || '::bullets', n_name || ' | ' || n_regionkey, 'COMMUNITY_BULLETS' FROM nation"),
        "ans4_second_pass": (second_pass, None),
        "vec3_agg16_cache": (cached, "SELECT item_id AS id, CAST(384 AS INTEGER) AS dim FROM benchmark"),
        "txt26_repair_json": (lambda s, d: rows(s, RAW).select("id", parsing.repaired_json(F.col("raw")).alias("j")), None),
        "txt27_answer_text": (lambda s, d: rows(s, RAW).select("id", parsing.answer_text(F.col("raw")).alias("t")), None),
        "src7_snk1_graphml": (graphml, "SELECT 'r:' || r_regionkey AS id, 'COMMUNITY' AS label FROM region UNION ALL SELECT 'n:' || n_nationkey, 'COMMUNITY' FROM nation UNION ALL SELECT 's:' || s_suppkey, 'ENTITY' FROM supplier UNION ALL SELECT 'n:' || n_nationkey || '-r:' || n_regionkey, 'PART_OF' FROM nation UNION ALL SELECT 's:' || s_suppkey || '-n:' || s_nationkey, 'MEMBER_OF' FROM supplier"),
        "src8_snk2_index_files": (index_files, r"WITH n AS (SELECT DISTINCT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations) SELECT 'SENTENCE' AS item_type, count(*) AS n FROM n WHERE length(t) >= 40"),
        "src2_txt8_text_files": (text_files, None),
        "str1_sliding_counts": (sliding, "WITH e AS (SELECT event_type, CAST(floor(epoch(ts) / 30) AS BIGINT) * 30 AS s FROM events), w AS (SELECT event_type, s AS start FROM e UNION ALL SELECT event_type, s - 30 FROM e) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL"),
        "str2_file_stream": (stream, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    }


