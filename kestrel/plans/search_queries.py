"""Registered queries of the vector, index, retrieval and answer operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.operators import retrieve, segment, vectors
from kestrel.plans.base import rows, table, values
from kestrel.plans.graph_queries import TREE, tree_edges, tree_nodes
from kestrel.plans.text_queries import CHUNK_SQL, QUESTIONS, SURFACES, TEXTS
from kestrel.sources import io

CANDS = ("query_id int, id string, text string, item_type string, sem double, graph double", [
    (0, "c1", "the insurer shall pay the third party", "CHUNK", 0.5, 1.0), (0, "c2", "right of recovery from the insured", "CHUNK", 0.4, 0.0), (0, "c3", "weak", "CHUNK", 0.1, 0.1),
    (0, "e1", "insurer", "ENTITY", 0.5, 1.0), (1, "c1", "the insurer shall pay the third party", "SENTENCE", 0.9, 0.0), (1, "r1", "a OWNS b.", "RELATION", 0.62, 0.2), (1, "m1", "summary", "COMMUNITY", 0.3, 0.3),
])
ITEMS = ("id string, text string, item_type string, ends array<string>", [("p1", "around article 3 here", "PROVISION_CONTEXT", ["art:3"]), ("r1", "article 3 AMENDS x.", "RELATION", ["art:3", "art:13"]), ("s1", "as article 31A says", "SENTENCE", ["z"]), ("s2", "part 3 and art 32", "SENTENCE", ["z"])])
COMMS = ("id int, boost double, level int, coherence double", [(0, 0.15, 0, 1.0), (1, 0.15, 2, 0.0), (2, 0.45, 1, 0.5), (3, 0.05, 0, None)])


def ids(docs):
    return docs.select(F.col("doc_id").alias("id"), "text")


def asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def index(spark, sf):
    items = segment.chunks(table(spark, sf, "documents")).select(F.col("chunk_id").alias("id"), "text", F.lit("CHUNK").alias("item_type"))
    ents = tree_nodes(spark, sf).filter("label = 'ENTITY'").select("id", F.col("canonical").alias("text"), F.lit("ENTITY").alias("item_type"))
    return retrieve.build_index(items.unionByName(ents)).select("id", "item_type", F.sha2("text", 256).alias("digest"))


def cosine(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.cosine_top(v, v.filter("id % 50 = 0").withColumnRenamed("id", "query_id")).select("query_id", "id", "score", "rank")


def search(spark, sf):
    return retrieve.search(asked(spark, sf), table(spark, sf, "documents").select("doc_id", "text"))


def answers(spark, sf):
    return retrieve.answers(asked(spark, sf), table(spark, sf, "documents").select("doc_id", "text")).select("query_id", "query_class", "n_evidence", F.array_join("used_evidence", ",").alias("used_evidence"), F.array_join("facts", "\n").alias("facts"), "abstention")


def flagship(spark, sf):
    """Documents to chunks, index, embeddings, search with the benchmark as questions, and answers."""
    return answers(spark, sf)


def relation_index(spark, sf):
    e = tree_edges(spark, sf).filter("type = 'PART_OF'").withColumn("edge_id", F.concat("src", F.lit("-"), "dst")).withColumn("evidence", F.lit(""))
    return retrieve.relation_items(e, tree_nodes(spark, sf).withColumn("label", F.lit("ENTITY"))).select("id", "text")


def contexts(spark, sf):
    c = table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"])
    return retrieve.provision_contexts(c.filter("role = 'user'").select(F.lit("u").alias("node"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx")), c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.lower("role").alias("text")), 1)


def cells(spark, sf):
    return vectors.hash_cells(ids(table(spark, sf, "documents")))


CELL_SQL = r"""WITH w AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS t FROM documents),
n AS (SELECT id, t, count(*) AS n FROM w GROUP BY 1, 2), h AS (SELECT t, sha256(t) AS h FROM (SELECT DISTINCT t FROM n)),
c AS (SELECT id, CAST(CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 384 AS INTEGER) AS idx, CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN n ELSE -n END AS v FROM n JOIN h USING (t))
SELECT id, idx, CAST(sum(v) AS BIGINT) AS value FROM c GROUP BY 1, 2 HAVING sum(v) <> 0"""
COS_SQL = """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 5) AS score FROM q, embeddings)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""
INDEX_SQL = rf"""WITH ch AS ({CHUNK_SQL}), {TREE}, it AS (SELECT chunk_id AS id, text, 'CHUNK' AS item_type FROM ch UNION ALL SELECT id, canonical, 'ENTITY' FROM tn WHERE label = 'ENTITY'),
n AS (SELECT *, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm FROM it)
SELECT id, item_type, sha256(text) AS digest FROM n WHERE length(norm) >= CASE item_type WHEN 'ENTITY' THEN 6 ELSE 40 END QUALIFY item_type = 'ENTITY' OR row_number() OVER (PARTITION BY norm, item_type = 'ENTITY' ORDER BY id) = 1"""


def hybrid(spark, sf):
    return retrieve.rank(rows(spark, CANDS)).select("query_id", "id", "hybrid", "place")


_hy = f"WITH {values(CANDS, 'f')}, h AS (SELECT *, round(0.7::DOUBLE * sem + 0.3::DOUBLE * graph, 6) AS hybrid FROM f)"


def _dedup(spark, sf):
    return retrieve.dedup_ranked(retrieve.rank(rows(spark, CANDS)).withColumn("embedding", F.lit(None).cast("array<float>")))


def _coverage(spark, sf):
    need = rows(spark, QUESTIONS).select(F.col("id").alias("query_id"), rules.required_tags(F.col("q")).alias("tags"))
    have = retrieve.rank(rows(spark, CANDS)).groupBy("query_id").agg(F.flatten(F.collect_list(rules.tags(F.col("text")))).alias("have"))
    m = need.join(have, "query_id", "left").select("query_id", F.lit("high").alias("confidence"), F.array_except("tags", F.coalesce("have", F.array().cast("array<string>"))).alias("missing"))
    return retrieve.calibrate(m).select("query_id", "confidence", "note")


def _chain(spark, sf):
    need = rows(spark, ("query_id int, tags array<string>", [(0, ["recovery"]), (1, ["override"])]))
    near = rows(spark, ("query_id int, id string", [(0, "e1")]))
    return retrieve.chain_prune(retrieve.rank(rows(spark, CANDS)), near, need).select("query_id", "id")


def queries() -> dict:
    """name: (query, SQL or None)."""
    return {
        "vec1_hash_cells": (cells, CELL_SQL),
        "vec2_vec3_hash_embed": (lambda s, d: vectors.hash_embed(ids(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))).select("id", F.size("embedding").alias("dim")), "SELECT item_id AS id, CAST(384 AS INTEGER) AS dim FROM benchmark"),
        "vec4_srt1_cosine_top": (cosine, COS_SQL),
        "vec5_kmeans": (lambda s, d: vectors.kmeans(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")), None),
        "vec6_rnk1_cross_rerank": (lambda s, d: retrieve.rerank(retrieve.rank(rows(s, CANDS)).withColumn("q", F.lit("insurer pay")), 2, retrieve.overlap_score).select("query_id", "id", "rerank"), None),
        "idx1_ded2_index": (index, INDEX_SQL),
        "idx2_entity_items": (lambda s, d: retrieve.entity_items(tree_nodes(s, d).select("id", "canonical", F.array(F.lit("alias")).alias("aliases"), F.array().cast("array<string>").alias("descriptions"))).select("id", "text"), f"WITH {TREE} SELECT id, canonical || '. alias' AS text FROM tn"),
        "idx3_flt3_relation_items": (relation_index, f"WITH {TREE} SELECT 'rel:' || src || '-' || dst AS id, a.canonical || ' PART_OF ' || b.canonical || '.' AS text FROM te JOIN tn a ON a.id = src JOIN tn b ON b.id = dst WHERE type = 'PART_OF'"),
        "jon9_win4_contexts": (contexts, "WITH c AS (SELECT DISTINCT conv_id, turn, first(lower(role)) OVER (PARTITION BY conv_id, turn) AS role FROM conversations), k AS (SELECT DISTINCT u.conv_id, o.turn, o.role FROM c u JOIN c o ON o.conv_id = u.conv_id AND o.turn BETWEEN u.turn - 1 AND u.turn + 1 WHERE u.role = 'user') SELECT 'u' AS node, conv_id AS doc_id, string_agg(role, ' ' ORDER BY turn) AS text FROM k GROUP BY conv_id"),
        "jon13_inject": (lambda s, d: retrieve.inject(retrieve.cited(rows(s, QUESTIONS).select(F.col("id").alias("query_id"), "q")), rows(s, ITEMS)), None),
        "jon14_lexical": (lambda s, d: retrieve.lexical(retrieve.cited(rows(s, QUESTIONS).select(F.col("id").alias("query_id"), "q")), rows(s, ITEMS)), None),
        "jon15_evidence_text": (lambda s, d: table(s, d, "labels").join(table(s, d, "documents").dropDuplicates(["doc_id"]), "doc_id", "left").select("doc_id", F.coalesce(F.sha2("text", 256), F.concat(F.lit("evidence "), "doc_id")).alias("t")), "SELECT l.doc_id, coalesce(sha256(d.text), 'evidence ' || l.doc_id) AS t FROM labels l LEFT JOIN (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id) d ON d.doc_id = l.doc_id"),
        "gra6_community_score": (lambda s, d: rows(s, COMMS).select("id", F.round(retrieve.community_score(F.col("boost"), F.col("level"), F.col("coherence")), 6).alias("score")), f"WITH {values(COMMS, 'f')} SELECT id, round(boost::DOUBLE * CASE WHEN level <= 0 THEN 1.2 WHEN level = 1 THEN 1.0 ELSE 0.8 END * (0.8 + 0.4 * least(greatest(coalesce(coherence, 0.0), 0.0), 1.0))::DOUBLE, 6) AS score FROM f"),
        "srt2_flt4_hybrid_rank": (hybrid, f"{_hy} SELECT query_id, id, hybrid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS INTEGER) AS place FROM h WHERE hybrid >= 0.15"),
        "srt4_type_priority": (lambda s, d: rows(s, CANDS).select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("item_type").isin("SENTENCE", "ENTITY_CONTEXT", "RELATION"), 0).when(F.col("item_type") == "ENTITY", 1).when(F.col("item_type") == "CHUNK", 2).when(F.col("item_type").startswith("COMMUNITY"), 3).otherwise(4), F.desc("sem"), "id")).alias("place")), f"WITH {values(CANDS, 'f')} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN item_type IN ('SENTENCE','ENTITY_CONTEXT','RELATION') THEN 0 WHEN item_type = 'ENTITY' THEN 1 WHEN item_type = 'CHUNK' THEN 2 WHEN starts_with(item_type, 'COMMUNITY') THEN 3 ELSE 4 END, sem DESC, id) AS INTEGER) AS place FROM f"),
        "srt5_rerank_none": (lambda s, d: retrieve.rerank(retrieve.rank(rows(s, CANDS)), 2).select("query_id", "id", "rerank"), f"{_hy} SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, id) AS INTEGER) AS rerank FROM h WHERE hybrid >= 0.15 QUALIFY rerank <= 2"),
        "ded3_dedup_candidates": (_dedup, None),
        "ded4_merge": (lambda s, d: retrieve.merge(retrieve.rank(rows(s, CANDS)).select("query_id", "id", "hybrid"), retrieve.rank(rows(s, CANDS)).select("query_id", "id", (F.col("hybrid") + F.when(F.col("id") == "c2", 0.1).otherwise(-0.1)).alias("hybrid"))).select("query_id", "id", F.round("hybrid", 6).alias("hybrid")), f"{_hy} SELECT query_id, id, round(hybrid + CASE WHEN id = 'c2' THEN 0.1 ELSE 0 END, 6) AS hybrid FROM h WHERE hybrid >= 0.15"),
        "ans3_calibrate": (_coverage, None),
        "flt9_chain_prune": (_chain, None),
        "snk6_report": (lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("x")).select("n_regionkey", F.concat(F.lit("Evidence:\n- "), F.array_join("x", "\n- ")).alias("report")), "SELECT n_regionkey, 'Evidence:' || chr(10) || '- ' || string_agg(n_name, chr(10) || '- ' ORDER BY n_name) AS report FROM nation GROUP BY n_regionkey"),
        "gra19_abstain": (lambda s, d: table(s, d, "benchmark").select("item_id").join(table(s, d, "documents").select(F.col("doc_id").alias("item_id"), "lang").filter("lang = 'en'"), "item_id", "left_anti").select(F.concat(F.lit("abstain:"), "item_id").alias("id")), "SELECT 'abstain:' || item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
        "ret1_search": (search, None),
        "ans1_answers": (answers, None),
        "src6_sources": (lambda s, d: table(s, d, "region").select(F.trim("r_name").alias("source")).filter("source <> '' AND NOT startswith(source, '#')"), "SELECT trim(r_name) AS source FROM region WHERE trim(r_name) <> '' AND NOT starts_with(trim(r_name), '#')"),
        "src_url_slug": (lambda s, d: table(s, d, "pages").select("page_id", io.url_slug(F.col("url")).alias("slug")), "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '[?#].*$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages"),
    }


FIXTURES = (SURFACES, QUESTIONS, TEXTS)
