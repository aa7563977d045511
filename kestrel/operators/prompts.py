"""What models and stores are sent and what is shown of their answers: packing, batching, reports, statements.

The calls themselves lie outside (`sources/providers.py`); everything here is data work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import text as T
from kestrel.operators import spans

# How much evidence an answer reads, and which properties of it.
EVIDENCE_ITEMS, SUMMARY_ITEMS, LEAST_CHARS, MOST_CHARS = 25, 40, 50, 4000
METADATA = ["doc_id", "index", "canonical", "type", "entity_id", "sent_id", "level", "coherence", "members_count", "sample_entities"]
#: Sentences in one call of a relation extractor; clusters in one call of a labeller, and clusters labelled at all.
RELATION_BATCH, CLUSTER_BATCH, CLUSTERS = 10, 15, 60
# Endings of files that may be uploaded, and labels whose ids a store keeps unique.
ENDINGS = [".pdf", ".docx", ".doc", ".txt", ".md", ".xls", ".xlsx", ".csv"]
UNIQUE = ["ENTITY", "DOCUMENT", "SENTENCE", "COMMUNITY"]


def pack_evidence(candidates: DataFrame, summary: Column, max_chars: int = MOST_CHARS) -> DataFrame:
    """(query_id, place, id, item_type, text, metadata): the first items of each query, their texts cut, of their properties the known ones.

    Reads (query_id, place, id, item_type, text, metadata map). The limits are the operator's purpose: what fits one question.
    """
    most = F.when(summary, SUMMARY_ITEMS).otherwise(EVIDENCE_ITEMS)
    text = F.substring(spans.sanitize_evidence(F.coalesce("text", F.lit(""))), 1, max(LEAST_CHARS, max_chars))
    known = F.map_filter("metadata", lambda k, v: k.isin(METADATA))
    ranked = candidates.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("place", "id")))
    return ranked.filter(F.col("place") <= most).select("query_id", "place", "id", "item_type", text.alias("text"), known.alias("metadata"))


def report(answer: Column, confidence: Column, note: Column, used: Column, facts: Column | None = None) -> Column:
    """An answer as text: the answer, its confidence, a note, the ids of its evidence, and facts (fact, evidence_ids)."""
    bar, end = "=" * 80, "\n"
    out = [F.lit(f"{bar}\nANSWER\n{bar}\n"), F.coalesce(answer, F.lit("")), F.lit("\n\nConfidence: "), F.upper(F.coalesce(confidence, F.lit("medium"))), F.lit(end)]
    out.append(F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit("Note: "), note, F.lit(end))).otherwise(""))
    ids = F.coalesce(used, F.array().cast("array<string>"))
    out += [F.lit("\nEvidence Used ("), F.size(ids).cast("string"), F.lit(" items):\n"), F.array_join(F.transform(ids, lambda x: F.concat(F.lit("  - "), x, F.lit(end))), ""), F.lit(end)]
    if facts is not None:
        shown = F.transform(facts, lambda f, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), f["fact"], F.lit("\n     Sources: "), F.array_join(f["evidence_ids"], ", "), F.lit(end)))
        out.append(F.when(F.size(facts) > 0, F.concat(F.lit("Key Facts Extracted:\n"), F.array_join(shown, ""), F.lit(end))).otherwise(""))
    return F.concat(*out, F.lit(bar))


def relation_batches(sentences: DataFrame, size: int = RELATION_BATCH) -> DataFrame:
    """(doc_id, batch, sids, text, canons): `size` sentences of a document in order, with the entities of all; ones with less than two are left out.

    Reads (doc_id, idx, sid, text, canons). Each call of an extractor answers one row.
    """
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("idx", "sid")) - 1
    each = sentences.withColumn("batch", F.floor(place / size)).groupBy("doc_id", "batch")
    whole = each.agg(F.array_sort(F.collect_list(F.struct("idx", "sid", "text"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("canons")))).alias("canons"))
    return whole.filter(F.size("canons") >= 2).select("doc_id", "batch", F.col("s.sid").alias("sids"), F.array_join("s.text", "\n").alias("text"), "canons")


def cluster_batches(clusters: DataFrame, size: int = CLUSTER_BATCH, most: int = CLUSTERS) -> DataFrame:
    """(batch, cluster, n): the largest clusters of (cluster, n) in batches for a labeller; the others stay unlabelled, that is entities."""
    best = clusters.orderBy(F.desc("n"), "cluster").limit(most)
    place = F.row_number().over(W.orderBy(F.desc("n"), "cluster")) - 1  # of `most` rows
    return best.withColumn("batch", F.floor(place / size)).select("batch", "cluster", "n")


def with_labels(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """The clusters that are entities: all but those of which a labeller's answer (cluster, is_entity) says otherwise."""
    no = labels.filter(~F.col("is_entity")).select("cluster").distinct()
    return clusters.join(no, "cluster", "left_anti")


def constraints() -> list[str]:
    """Statements that make ids unique in a property-graph store."""
    return [f"CREATE CONSTRAINT {x.lower()}_id IF NOT EXISTS FOR ({x[0].lower()}:{x}) REQUIRE {x[0].lower()}.id IS UNIQUE" for x in UNIQUE]


def statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, statement, id, source, target): what merges the nodes (id, label), then the edges (edge_id, src, dst, type) into a store."""
    none = F.lit(None).cast("string")
    merge = F.concat(F.lit("MERGE (n:"), T.schema_name(F.col("label")), F.lit(" {id: $id}) SET n += $props"))
    n = nodes.select(F.lit(1).alias("step"), merge.alias("statement"), "id", none.alias("source"), none.alias("target"))
    link = F.concat(F.lit("MATCH (s {id: $source}), (t {id: $target}) MERGE (s)-[r:"), T.schema_name(F.col("type")), F.lit(" {id: $id}]->(t) SET r += $props"))
    return n.unionByName(edges.select(F.lit(2).alias("step"), link.alias("statement"), F.col("edge_id").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target")))


def send(rows: DataFrame, run: Callable[[list[dict]], None], size: int = 1000) -> None:
    """Sends the rows of statements in batches from each task, the nodes before the edges; merges may be repeated if a task is."""
    for step in (1, 2):

        def part(found, size=size) -> None:
            own: list[dict] = []
            for r in found:
                own.append(r.asDict())
                if len(own) == size:
                    run(own)
                    own = []
            if own:
                run(own)

        rows.filter(F.col("step") == step).foreachPartition(part)


def safe_name(name: Column) -> Column:
    """A file name of ASCII letters, digits, dots, dashes and underscores only, without folders or leading dots."""
    ascii_only = F.regexp_replace(F.regexp_replace(name, r"[/\\]", " "), r"[^\x00-\x7f]", "")
    joined = F.regexp_replace(F.trim(F.regexp_replace(ascii_only, r"\s+", " ")), " ", "_")
    return F.regexp_replace(F.regexp_replace(joined, "[^A-Za-z0-9_.-]", ""), "^[._]+|[._]+$", "")


def may_upload(name: Column) -> Column:
    """Whether a name ends as one of the known kinds of file."""
    return F.lower(F.regexp_extract(safe_name(name), r"(\.[^.]*)$", 1)).isin(ENDINGS)


def join_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of a document's pages (doc_id, page, text) in order, an empty line between, white space cleaned."""
    whole = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return whole.select("doc_id", T.clean_whitespace(F.array_join("p.text", "\n\n")).alias("text"))
