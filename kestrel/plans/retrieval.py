"""The question path over the whole graph: an index of all item types, nearest items, citations, expansion, ranking, selection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators import community, graph, relations, retrieve, segment, vectors
from kestrel.operators.scratch import written
from kestrel.plans import build

COMMUNITY_BOOST = 0.15


class Corpus(NamedTuple):
    """Written tables: nodes (id, label, canonical, text), edges (src, dst, type), items (id, text, item_type, ends,
    coherence), embeddings (id, embedding) of the items."""

    nodes: DataFrame
    edges: DataFrame
    items: DataFrame
    embeddings: DataFrame


def rule_edges(sents: DataFrame, found: DataFrame) -> DataFrame:
    """(edge_id, src, dst, type, evidence, head, tail): relations that rules find between the entities of a sentence, one for its ends, type and sentence."""
    canons = found.select("sent_id", "canonical").distinct().join(sents.select("sent_id", "text"), "sent_id")
    order = F.struct(F.instr(F.lower("text"), F.col("canonical")).alias("at"), "canonical")
    s = canons.groupBy(F.col("sent_id").alias("sid"), "text").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["canonical"]).alias("canons"))
    r = relations.constitution(s).unionByName(relations.finance(s)).select("sid", "head", "relation", "tail").distinct()
    e = r.join(sents.select(F.col("sent_id").alias("sid"), F.col("text").alias("evidence")), "sid")
    e = e.select("sid", T.node_id(F.col("head")).alias("src"), T.node_id(F.col("tail")).alias("dst"), F.col("relation").alias("type"), "evidence", "head", "tail")
    return e.withColumn("edge_id", T.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.col("sid"))).dropDuplicates(["edge_id"])


def communities(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(COMMUNITY nodes of materialise, MEMBER_OF edges) of the co-occurrence graph with hubs weighed down; nodes without pairs have none."""
    co = edges.filter("type = 'CO_OCCURS_WITH'").select("src", "dst", "weight", "count", F.lit(None).cast("double").alias("confidence"))
    pairs = written(graph.hub_downweight(graph.entity_graph(co)).select("a", "b", "weight"), "pairs")
    part = community.choose(pairs)
    stats = community.coherence(community.collapse(pairs, part))
    names = nodes.filter("label = 'ENTITY'").select(F.col("id").alias("node"), "canonical")
    comms = written(community.materialise(part, names, stats), "communities")
    members = part.join(comms.select("comm", F.col("id").alias("dst")), "comm").select(F.col("node").alias("src"), "dst", F.lit("MEMBER_OF").alias("type"))
    return comms, members


def corpus(docs: DataFrame) -> Corpus:
    """The graph of (doc_id, text) with rule relations and communities, and its index of chunks, sentences, entities,
    contexts of legal provisions, relations and communities. Null and empty texts give a DOCUMENT node alone."""
    sents, found = made = build.parts(docs)
    nodes, edges = build.build(docs, made)
    said = written(rule_edges(sents, found), "relations")
    ends = said.select(F.col("src").alias("id"), F.col("head").alias("canonical")).unionByName(said.select(F.col("dst").alias("id"), F.col("tail").alias("canonical")))
    own = nodes.join(sents.select(F.col("sent_id").alias("id"), "text"), "id", "left").select("id", "label", "canonical", "text")
    new = ends.groupBy("id").agg(F.lit("ENTITY").alias("label"), F.min("canonical").alias("canonical"), F.lit(None).cast("string").alias("text")).join(own.select("id"), "id", "left_anti")
    edges = written(edges, "edges")
    own = written(own.unionByName(new), "nodes")
    comms, members = communities(edges, own)
    nodes = own.unionByName(comms.select("id", F.lit("COMMUNITY").alias("label"), F.lit(None).cast("string").alias("canonical"), F.col("summary").alias("text")))
    none = F.array().cast("array<string>")
    texts = segment.chunks(docs).select(F.col("chunk_id").alias("id"), "text", F.lit("CHUNK").alias("item_type"))
    texts = texts.unionByName(sents.select(F.col("sent_id").alias("id"), "text", F.lit("SENTENCE").alias("item_type")))
    texts = texts.unionByName(retrieve.entity_items(own.filter("label = 'ENTITY'").select("id", "canonical", none.alias("aliases"), none.alias("descriptions"))))
    legal = found.filter(F.col("node").rlike("^(art|sec|part|sched):"))
    about = retrieve.provision_contexts(legal.select("node", "doc_id", "idx"), sents).withColumn("id", F.concat_ws(":", F.lit("ctx"), "node", "doc_id"))
    texts = texts.unionByName(about.select("id", "text", F.lit("PROVISION_CONTEXT").alias("item_type")))
    texts = texts.unionByName(retrieve.relation_items(said, own))
    sums = comms.select("id", "summary", F.lit(None).cast("string").alias("micro_summary"), none.alias("bullets"))
    texts = texts.unionByName(retrieve.community_items(sums))
    touched = about.select("id", F.array("node").alias("ends")).unionByName(said.select(F.concat(F.lit("rel:"), "edge_id").alias("id"), F.array("src", "dst").alias("ends")))
    items = retrieve.build_index(texts).join(touched, "id", "left").join(comms.select("id", "coherence"), "id", "left")
    items = written(items, "items")
    every = edges.select("src", "dst", "type").unionByName(said.select("src", "dst", "type")).unionByName(members)
    return Corpus(written(nodes, "nodes"), written(every.distinct(), "edges"), items, written(vectors.hash_embed(items.select("id", "text")), "embeddings"))


def reach(start: DataFrame, edges: DataFrame, sample: int = 6) -> DataFrame:
    """(query_id, id) that expansion reaches from (query_id, id, item_type): the neighbours, sentences and communities
    of entities, the first members of communities, the entities of sentences."""
    of = lambda kind: start.filter(F.col("item_type") == kind).select("query_id", F.col("id").alias("node"))
    near = graph.undirected(edges.filter(F.col("type").isin(graph.RETRIEVAL_TYPES)))
    said = edges.filter("type = 'MENTION_IN'")
    from_entity = near.unionByName(said.select(F.col("src").alias("node"), F.col("dst").alias("other")))
    first = edges.filter("type = 'MEMBER_OF'").withColumn("r", F.row_number().over(W.partitionBy("dst").orderBy("src"))).filter(F.col("r") <= sample)
    steps = [("ENTITY", from_entity), ("COMMUNITY", first.select(F.col("dst").alias("node"), F.col("src").alias("other"))), ("SENTENCE", said.select(F.col("dst").alias("node"), F.col("src").alias("other")))]
    out = [of(kind).join(step, "node").select("query_id", F.col("other").alias("id")) for kind, step in steps]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def search(queries: DataFrame, c: Corpus, top_n: int = 20, top_k: int = 40, least: float = 0.15) -> DataFrame:
    """(query_id, id, text, item_type, sem, graph, hybrid, place) of the evidence of (query_id, q).

    The nearest items and those that cited articles force in are expanded in the graph; an item keeps its cosine or its
    floor, whichever is more, a bare node has 0; what was there and is reached again gains 0.6 or 0.25, what enters has
    1, communities their own score. Ties go to the smaller id. Query ids are distinct; null questions find nothing.
    """
    asked = written(vectors.hash_embed(queries.select(F.col("query_id").alias("id"), F.col("q").alias("text"))).withColumnRenamed("id", "query_id"), "asked")
    near = vectors.cosine_top(c.embeddings, asked, top_n).select("query_id", "id", F.lit(None).cast("double").alias("floor"))
    cites = written(retrieve.cited(queries.filter("q IS NOT NULL")), "cites")
    forced = retrieve.inject(cites, c.items).unionByName(retrieve.lexical(cites, c.items))
    start = near.unionByName(forced).groupBy("query_id", "id").agg(F.max("floor").alias("floor"))
    start = written(start.join(c.items.select("id", "item_type"), "id"), "start")
    both = start.select("query_id", "id", "floor", F.lit(True).alias("old")).join(reach(start, c.edges).withColumn("hit", F.lit(True)), ["query_id", "id"], "full_outer")
    known = c.items.select("id", F.col("text").alias("own"), "item_type", "coherence")
    bare = c.nodes.select("id", "label", F.coalesce("text", F.lit("")).alias("said"))
    j = both.join(known, "id", "left").join(bare, "id", "left").filter("item_type IS NOT NULL OR label IS NOT NULL")
    j = j.join(c.embeddings, "id", "left").join(asked.withColumnRenamed("embedding", "e"), "query_id")
    cosine = F.round(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("e").cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 5)
    indexed, old, hit = F.col("item_type").isNotNull(), F.coalesce("old", F.lit(False)), F.coalesce("hit", F.lit(False))
    kind = F.coalesce("item_type", "label")
    level = F.when(indexed & kind.startswith("COMMUNITY"), retrieve.community_score(F.lit(COMMUNITY_BOOST), F.lit(0), F.col("coherence")))
    bonus = F.when(hit, F.when(kind.isin("ENTITY", "COMMUNITY", "COMMUNITY_MICRO", "COMMUNITY_BULLETS"), 0.6).otherwise(0.25)).otherwise(0.0)
    score = F.when(old, F.coalesce(level, F.lit(0.0)) + bonus).otherwise(F.coalesce(level, F.lit(1.0)))
    sem = F.when(indexed, F.greatest(F.coalesce(cosine, F.lit(0.0)), F.coalesce("floor", F.lit(-1.0)))).otherwise(0.0)
    cands = j.select("query_id", "id", F.coalesce("own", "said").alias("text"), kind.alias("item_type"), sem.alias("sem"), score.alias("graph"))
    ranked = written(retrieve.rank(cands, least), "ranked")
    made = vectors.hash_embed(ranked.select("id", "text").distinct())
    return retrieve.dedup_ranked(ranked.join(made, "id", "left"), top_k)
