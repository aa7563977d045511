"""The build plan: documents to a property graph of documents, sentences, entities and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators import graph, relations, retrieve, segment
from kestrel.operators.scratch import written


def mentions(sentences: DataFrame) -> DataFrame:
    """(sent_id, doc_id, idx, canonical, label, node): structural entities and capitalised runs of each sentence."""
    s = sentences.select(F.col("sent_id").alias("doc_id"), "text")
    found = segment.structure(s).select("doc_id", "canonical", "label")
    runs = segment.rule_candidates(s).filter("score IN (2, 6)").select("doc_id", T.normalize_surface(F.col("surface")).alias("canonical"), F.lit("CONCEPT").alias("label"))
    every = found.unionByName(runs).filter("canonical <> ''").withColumnRenamed("doc_id", "sent_id").distinct()
    return every.join(sentences.select("sent_id", "doc_id", "idx"), "sent_id").withColumn("node", T.node_id(F.col("canonical")))


def parts(docs: DataFrame, min_chars: int = 30) -> tuple[DataFrame, DataFrame]:
    """(sentences, mentions) of the documents, each written once, as every branch of the plan reads them."""
    sents = written(segment.sentences(docs, min_chars), "sentences")
    return sents, written(mentions(sents), "mentions")


def build(docs: DataFrame, made: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (id, label, canonical, type), edges (edge_id, src, dst, type, weight, count)."""
    sents, found = made or parts(docs)
    d = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("DOCUMENT").alias("label"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("type"))
    s = sents.select(F.col("sent_id").alias("id"), F.lit("SENTENCE").alias("label"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("type"))
    e = found.groupBy(F.col("node").alias("id")).agg(F.lit("ENTITY").alias("label"), F.min("canonical").alias("canonical"), F.min_by("label", F.struct("sent_id", "label")).alias("type"))
    has = sents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("src"), F.col("sent_id").alias("dst"), F.lit("HAS_SENTENCE").alias("type"))
    at = found.select(F.col("node").alias("src"), F.col("sent_id").alias("dst"), F.lit("MENTION_IN").alias("type")).distinct()
    generic = F.col("node").isin([f"ent:{g.replace(' ', '_')}" for g in rules.GENERIC])
    co = graph.cooccurrence(found.select(F.col("sent_id").alias("sid"), "node").filter("node <> 'ent:unknown'"), generic)
    co = co.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_OCCURS_WITH").alias("type"), "weight", "count")
    none = [F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("count")]
    edges = has.select("*", *none).unionByName(at.select("*", *none)).unionByName(co)
    return d.unionByName(s).unionByName(e), edges.withColumn("edge_id", T.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.lit("")))


def ingest_relations(raw: DataFrame, catalog: DataFrame, sentences: DataFrame, least: float = 0.35) -> tuple[DataFrame, DataFrame]:
    """(new nodes, edges) of extracted relations (doc_id, head, relation, tail, confidence, evidence).

    Ends are matched to the catalog, unknown ones become CONCEPT entities; evidence is placed in a
    sentence of its document; an edge counts once for its ends, type and sentence.
    """
    r = raw.withColumn("type", rules.relation_label(F.col("relation"))).filter(F.col("type").isNotNull() & (F.col("confidence") >= least))
    r = r.withColumn("h", T.normalize_surface(F.col("head"))).withColumn("t", T.normalize_surface(F.col("tail"))).filter("h <> '' AND t <> '' AND h <> t")
    names = r.select(F.explode(F.array("h", "t")).alias("name")).distinct()
    ends = relations.match_ends(names, catalog)
    of = lambda c, n: ends.select(F.col("name").alias(c), F.col("canonical").alias(n))
    j = r.join(of("h", "hc"), "h").join(of("t", "tc"), "t").select("doc_id", T.node_id(F.col("hc")).alias("src"), "type", T.node_id(F.col("tc")).alias("dst"), "confidence", "evidence")
    placed = relations.evidence_sentence(j, sentences).dropDuplicates(["src", "type", "dst", "sent_id"])
    new = ends.filter("how = 'new'").select(T.node_id(F.col("canonical")).alias("id"), F.lit("ENTITY").alias("label"), "canonical", F.lit("CONCEPT").alias("type"))
    return new, placed.withColumn("edge_id", T.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.coalesce("sent_id", F.lit(""))))


def expand(cands: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates (query_id, id, item_type, sem, graph) after graph expansion from entities, communities and sentences.

    What the expansion reaches once: an existing candidate gains 0.6 (entities and communities)
    or 0.25; an indexed item or a bare node enters with graph score 1.
    """
    start = cands.filter(F.col("item_type").isin("ENTITY", "COMMUNITY", "SENTENCE")).select("query_id", "id")
    ends = graph.undirected(edges.filter(F.col("type").isin(graph.RETRIEVAL_TYPES + ["MENTION_IN"]))).distinct()
    reached = start.join(ends, F.col("id") == F.col("node")).select("query_id", F.col("other").alias("id")).distinct().withColumn("hit", F.lit(True))
    known = nodes.select("id", F.col("label").alias("node_label")).join(items.select("id", F.col("item_type").alias("own")), "id", "full_outer")
    j = cands.join(reached, ["query_id", "id"], "full_outer").join(known, "id", "left")
    kind = F.coalesce("item_type", "own", "node_label")
    bonus = F.when(kind.isin("ENTITY", "COMMUNITY", "COMMUNITY_MICRO", "COMMUNITY_BULLETS"), 0.6).otherwise(0.25)
    score = F.when(F.col("item_type").isNull(), F.lit(1.0)).otherwise(F.col("graph") + F.when(F.coalesce("hit", F.lit(False)), bonus).otherwise(0.0))
    return j.select("query_id", "id", kind.alias("item_type"), F.coalesce("sem", F.lit(0.0)).alias("sem"), score.alias("graph"))


def structural_answer(cands: DataFrame, communities: DataFrame, members: DataFrame, top: int = 12, least: int = 5, coherence: float = 0.2, most: int = 6, shown: int = 10) -> DataFrame:
    """(query_id, comm, members): the most coherent communities among a query's best evidence, with their first members."""
    best = cands.withColumn("p", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hybrid"), "id"))).filter(F.col("p") <= top)
    fit = communities.filter((F.col("members_count") > least) & (F.col("coherence") >= coherence))
    j = best.join(fit, "id").withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("coherence"), F.desc("members_count"), "id"))).filter(F.col("r") <= most)
    m = members.withColumn("k", F.row_number().over(W.partitionBy("comm").orderBy(F.desc("mentions"), "canonical"))).filter(F.col("k") <= shown)
    names = m.groupBy("comm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "canonical"))), lambda x: x["canonical"]), ", ").alias("members"))
    return j.join(names, "comm").select("query_id", "comm", "r", "members")


def second_pass(first: DataFrame, queries: DataFrame, search) -> DataFrame:
    """First-pass candidates merged with those of augmented questions, for the queries whose evidence lacks required tags."""
    have = first.groupBy("query_id").agg(F.flatten(F.collect_list(rules.tags(F.col("text")))).alias("have"))
    need = queries.join(have, "query_id", "left").withColumn("missing", F.array_except(rules.required_tags(F.col("q")), F.coalesce("have", F.array().cast("array<string>"))))
    again = need.filter(F.size("missing") > 0).select("query_id", rules.augment(F.col("q"), F.col("missing")).alias("q"))
    return retrieve.merge(first, search(again))


def cached(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """(embeddings of all texts, new cache rows): only distinct texts that the cache (key, embedding) lacks are embedded."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    new = embed(keyed.select(F.col("key").alias("id"), "text").dropDuplicates(["id"]).join(cache.select(F.col("key").alias("id")), "id", "left_anti")).withColumnRenamed("id", "key")
    return keyed.select("id", "key").join(cache.unionByName(new), "key").select("id", "embedding"), new
