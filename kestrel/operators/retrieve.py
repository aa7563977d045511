"""Index items, hybrid retrieval, evidence selection and evidence-only answers; every step works on many queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators import segment, vectors
from kestrel.operators.scratch import written

EXEMPT = ["ENTITY", "PROVISION_CONTEXT"]
PRIORITY = ["CHUNK", "SENTENCE", "ENTITY", "RELATION", "ENTITY_CONTEXT", "PROVISION_CONTEXT", "COMMUNITY", "COMMUNITY_MICRO", "COMMUNITY_BULLETS"]
DISTINCT_FREE = ["ENTITY", "ENTITY_CONTEXT", "PROVISION_CONTEXT", "RELATION"]


def min_chars(item_type: Column, text_min: int = 40) -> Column:
    return F.when(item_type == "ENTITY", 6).when(item_type == "RELATION", 8).when(item_type == "COMMUNITY_MICRO", max(20, 40)).otherwise(text_min)


def priority(item_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PRIORITY)), item_type)


def build_index(items: DataFrame) -> DataFrame:
    """Items (id, text, item_type) long enough, without repeats of a normalised text but for exempt types.

    Of equal texts the first by type, then id, stays.
    """
    n = items.withColumn("norm", T.index_norm(F.col("text"))).filter(F.length("norm") >= min_chars(F.col("item_type")))
    free = n.filter(F.col("item_type").isin(EXEMPT))
    order = F.struct(priority(F.col("item_type")).alias("p"), F.col("id").alias("id"))
    first = n.filter(~F.col("item_type").isin(EXEMPT)).groupBy("norm").agg(F.min_by(F.struct("id", "text", "item_type"), order).alias("r")).select("r.*")
    return free.select("id", "text", "item_type").unionByName(first)


def entity_items(catalog: DataFrame) -> DataFrame:
    """ENTITY items from (id, canonical, aliases, descriptions)."""
    text = F.concat_ws(". ", F.col("canonical"), F.get("aliases", F.lit(0)), F.get("descriptions", F.lit(0)))
    return catalog.select("id", text.alias("text"), F.lit("ENTITY").alias("item_type"))


def community_items(comms: DataFrame) -> DataFrame:
    """COMMUNITY, COMMUNITY_MICRO and COMMUNITY_BULLETS items from (id, summary, micro_summary, bullets); empty ones are left out."""
    kinds = [("COMMUNITY", "", F.coalesce("summary", "micro_summary")), ("COMMUNITY_MICRO", "::micro", F.col("micro_summary")), ("COMMUNITY_BULLETS", "::bullets", F.array_join("bullets", " | "))]
    every = F.array(*[F.struct(F.concat("id", F.lit(end)).alias("id"), text.alias("text"), F.lit(kind).alias("item_type")) for kind, end, text in kinds])
    return comms.select(F.explode(every).alias("i")).select("i.*").filter("text <> ''")


def relation_items(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """RELATION items of semantic edges between entities: 'source TYPE target.' and the evidence."""
    of = lambda c, n: nodes.filter(F.col("label").isin("ENTITY", "DOMAIN")).select(F.col("id").alias(c), F.col("canonical").alias(n))
    e = edges.filter(~F.col("type").isin(rules.NOT_INDEXED)).join(of("src", "sc"), "src").join(of("dst", "dc"), "dst")
    said = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(" Evidence: "), F.col("evidence"))).otherwise("")
    return e.select(F.concat(F.lit("rel:"), "edge_id").alias("id"), F.concat(F.col("sc"), F.lit(" "), F.col("type"), F.lit(" "), F.col("dc"), F.lit("."), said).alias("text"), F.lit("RELATION").alias("item_type"))


def provision_contexts(mentions: DataFrame, sentences: DataFrame, n: int = 3) -> DataFrame:
    """(node, doc_id, text): the sentences within n places of a mention (node, doc_id, idx), each once, in order."""
    near = mentions.select("node", "doc_id", F.explode(F.sequence(F.col("idx") - n, F.col("idx") + n)).alias("idx")).distinct()
    hit = near.join(sentences.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    return hit.groupBy("node", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("text"))


def community_score(boost: Column, level: Column, coherence: Column) -> Column:
    """Base graph score of a community: boost x level weight x (0.8 + 0.4 x coherence in [0, 1])."""
    lw = F.when(level <= 0, 1.2).when(level == 1, 1.0).otherwise(0.8)
    return boost * lw * (0.8 + 0.4 * F.least(F.greatest(F.coalesce(coherence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))


def hybrid(sem: Column, graph: Column, alpha: float = 0.7, beta: float = 0.3) -> Column:
    return alpha * sem + beta * graph


def cited(queries: DataFrame) -> DataFrame:
    """(query_id, cid): node ids of the articles that a query names, ranges expanded, and bare numbers."""
    bare = F.transform(F.regexp_extract_all("q", F.lit(r"\b(\d{1,3}[A-Za-z]?)\b"), F.lit(1)), lambda x: F.concat(F.lit("art:"), F.lower(x)))
    return queries.select("query_id", F.explode(F.array_distinct(F.concat(rules.article_ids(F.col("q")), bare))).alias("cid"))


def inject(cites: DataFrame, items: DataFrame, per_context: int = 6, per_relation: int = 20) -> DataFrame:
    """(query_id, id, floor): contexts and relations of cited articles, capped per article; items have `ends`."""
    e = items.filter(F.col("item_type").isin("PROVISION_CONTEXT", "RELATION")).select("id", "item_type", F.explode("ends").alias("cid"))
    j = cites.join(e, "cid")
    first = j.groupBy("query_id", "id", "item_type").agg(F.min("cid").alias("cid"))
    cap = F.when(F.col("item_type") == "RELATION", per_relation).otherwise(per_context)
    r = first.withColumn("r", F.row_number().over(W.partitionBy("query_id", "cid", "item_type").orderBy("id"))).filter(F.col("r") <= cap)
    return r.select("query_id", "id", F.when(F.col("item_type") == "RELATION", 0.72).otherwise(0.78).alias("floor"))


def lexical(cites: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id, floor): items whose text cites an article of the query, by a join on the citations in the text."""
    kinds = ["SENTENCE", "CHUNK", "ENTITY", "ENTITY_CONTEXT", "PROVISION_CONTEXT"]
    refs = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)(?<!\w)article[\s_]+(\d{1,3}[A-Za-z]?)(?!\w)"), F.lit(1)), lambda x: F.concat(F.lit("art:"), F.lower(x))))
    e = items.filter(F.col("item_type").isin(kinds)).select("id", "item_type", F.explode(refs).alias("cid"))
    floor = F.max(F.when(F.col("item_type") == "PROVISION_CONTEXT", 0.65).otherwise(0.55)).alias("floor")
    return cites.join(e, "cid").groupBy("query_id", "id").agg(floor)


def rank(cands: DataFrame, least: float = 0.15) -> DataFrame:
    """Candidates (query_id, id, text, item_type, sem, graph) with hybrid and their place, weak ones left out."""
    c = cands.withColumn("hybrid", F.round(hybrid(F.col("sem"), F.col("graph")), 6)).filter(F.col("hybrid") >= least)
    return c.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hybrid"), "id")))


def dedup_ranked(ranked: DataFrame, top_k: int = 40, words: float = 0.9, cosine: float = 0.92) -> DataFrame:
    """Greedy selection by place: no text too like a kept one by words or by vector; some types are exempt.

    Reads (query_id, id, text, item_type, hybrid, place, embedding). Rows come by query and place, and a task holds
    one batch and at most `top_k` kept texts, however many candidates a query has. Texts without words repeat none.
    """
    cols = [c for c in ranked.columns if c != "embedding"]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, sets, vecs, n = None, [], [], 0
        for b in batches:
            kept = []
            for i, (of, text, kind, e) in enumerate(zip(b["query_id"], b["text"], b["item_type"], b["embedding"])):
                if n == 0 or of != query:
                    query, sets, vecs, n = of, [], [], 0
                if n >= top_k:
                    continue
                s, v = set((text or "").lower().split()), None if e is None else np.asarray(e, float)
                if kind not in DISTINCT_FREE:
                    if s and any(k and len(s & k) >= words * len(s | k) for k in sets):
                        continue
                    if v is not None and vecs and max(float(v @ k) / ((np.linalg.norm(v) + 1e-9) * (np.linalg.norm(k) + 1e-9)) for k in vecs) >= cosine:
                        continue
                kept.append(i)
                n += 1
                sets.append(s)
                if v is not None:
                    vecs.append(v)
            yield b.iloc[kept][cols]

    ordered = ranked.repartition(F.col("query_id")).sortWithinPartitions("query_id", "place")
    return ordered.mapInPandas(pick, ranked.select(cols).schema)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Candidates of both lists once each, with the higher hybrid; at equal ones the first list's row."""
    cols = [c for c in a.columns]
    both = a.withColumn("o", F.lit(0)).unionByName(b.select(*cols).withColumn("o", F.lit(1)))
    best = both.groupBy("query_id", "id").agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col("hybrid"), -F.col("o"))).alias("r"))
    return best.select("r.*")


def rerank(ranked: DataFrame, top_k: int = 12, scorer=None) -> DataFrame:
    """The best rows of each query by hybrid, or by a scorer (a function of query text and text columns) after a trim to 3 x top_k or 60."""
    w = W.partitionBy("query_id").orderBy(F.desc("hybrid"), "id")
    if scorer is not None:
        trimmed = ranked.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max(3 * top_k, 60)).drop("r")
        ranked = trimmed.withColumn("cross", scorer(F.col("q"), F.col("text")))
        w = W.partitionBy("query_id").orderBy(F.desc("cross"), F.desc("hybrid"), "id")
    return ranked.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= top_k)


def overlap_score(q: Column, text: Column) -> Column:
    """The offline scorer: share of the query's distinct words that the text has."""
    a, b = (F.array_distinct(T.tokens(T.normalize_text(c))) for c in (q, text))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def evidence_answer(ranked: DataFrame, most: int = 25) -> DataFrame:
    """(query_id, used_evidence, facts): up to `most` ids by place and the first 240 characters of their texts."""
    top = ranked.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rerank", "id"))).filter(F.col("r") <= most)
    g = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "id", F.substring("text", 1, 240).alias("fact")))).alias("e"))
    return g.select("query_id", F.transform("e", lambda x: x["id"]).alias("used_evidence"), F.transform("e", lambda x: x["fact"]).alias("facts"))


def calibrate(answers: DataFrame) -> DataFrame:
    """Confidence one step lower, with a note, where required tags or relations are missing; reads (confidence, missing)."""
    lower = F.when(F.col("confidence") == "high", "medium").otherwise("low")
    lacking = F.size("missing") > 0
    return answers.withColumn("confidence", F.when(lacking, lower).otherwise(F.col("confidence"))).withColumn("note", F.when(lacking, F.concat(F.lit("Missing evidence: "), F.array_join(F.array_sort("missing"), ", "))))


def chain_prune(ranked: DataFrame, around: DataFrame, required: DataFrame) -> DataFrame:
    """Rows with a required tag or an entity near tagged ones; a query that would lose a required tag keeps all.

    Reads ranked (query_id, id, text), around (query_id, id) and required (query_id, tags).
    """
    t = ranked.join(required, "query_id").withColumn("has", F.array_intersect(rules.tags(F.col("text")), F.col("tags")))
    near = around.select("query_id", "id").distinct().withColumn("near", F.lit(True))
    t = t.join(near, ["query_id", "id"], "left").withColumn("keep", (F.size("has") > 0) | F.coalesce("near", F.lit(False)))
    w = W.partitionBy("query_id")
    before = F.size(F.array_distinct(F.flatten(F.collect_set("has").over(w))))
    after = F.size(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("keep"), F.col("has"))).over(w))))
    return t.withColumn("lost", after < before).filter(F.col("keep") | F.col("lost")).drop("has", "near", "keep", "lost", "tags")


def search(queries: DataFrame, docs: DataFrame, top_n: int = 20, top_k: int = 40, size: int = 160, overlap: int = 40) -> DataFrame:
    """Retrieval over the chunks of documents: index, hash embeddings, nearest items, lexical floors, ranking, selection.

    Reads (query_id, q) and (doc_id, text); gives (query_id, id, text, item_type, sem, graph, hybrid, place).
    """
    items = build_index(segment.chunks(docs, size, overlap).select(F.col("chunk_id").alias("id"), "text", F.lit("CHUNK").alias("item_type")))
    items = written(items, "items")
    emb = written(vectors.hash_embed(items.select("id", "text")), "embeddings")
    asked = vectors.hash_embed(queries.select(F.col("query_id").alias("id"), F.col("q").alias("text"))).withColumnRenamed("id", "query_id")
    near = vectors.cosine_top(emb, asked, top_n).select("query_id", "id", F.col("score").alias("sem"))
    forced = lexical(cited(queries), items)
    both = near.join(forced, ["query_id", "id"], "full_outer").select("query_id", "id", F.coalesce("floor", "sem").alias("sem"), F.lit(0.0).alias("graph"))
    ranked = rank(both.join(items, "id").select("query_id", "id", "text", "item_type", "sem", "graph"))
    ranked = written(ranked, "ranked")  # at most a few dozen rows for each query
    own = vectors.hash_embed(ranked.select("id", "text").dropDuplicates(["id"]))
    return dedup_ranked(ranked.join(own, "id", "left"), top_k)


def answers(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """The whole question path without models: search, rerank by hybrid, evidence-only answer; queries without evidence abstain."""
    found = evidence_answer(rerank(search(queries, docs)))
    out = queries.join(found, "query_id", "left")
    return out.select("query_id", rules.classify(F.col("q")).alias("query_class"), F.coalesce(F.size("used_evidence"), F.lit(0)).alias("n_evidence"), "used_evidence", "facts", F.when(F.col("used_evidence").isNull(), F.concat(F.lit("abstain:"), F.col("query_id").cast("string"))).alias("abstention"))
