"""Queries of what models and stores are sent, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import parsing
from kestrel.operators import prompts
from kestrel.plans.base import table
from kestrel.plans.graph_queries import TREE, tree_edges, tree_nodes


def evidence(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("place"), F.concat_ws("-", "conv_id", "turn", F.sha1("text")).alias("id"), F.col("role").alias("item_type"),
        F.regexp_replace("text", "[^a-z]", "").alias("text"), F.create_map(F.lit("doc_id"), F.col("conv_id").cast("string"), F.lit("other"), F.lit("x")).alias("metadata"),
    )
    p = prompts.pack_evidence(c, F.col("query_id") % 2 == 0, 60)
    return p.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.max(F.size("metadata")).alias("properties"))


EVIDENCE_SQL = """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, concat_ws('-', conv_id, turn, sha1(text))) AS k FROM conversations)
SELECT conv_id AS query_id, count(*) AS n, CAST(1 AS INTEGER) AS properties FROM r WHERE k <= CASE WHEN conv_id % 2 = 0 THEN 40 ELSE 25 END GROUP BY conv_id"""


def reports(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("used"))
    facts = F.transform("used", lambda x: F.struct(F.lower(x).alias("fact"), F.array(x, F.lit("z")).alias("evidence_ids")))
    note = F.when(F.col("n_regionkey") == 1, "few")
    return n.select("n_regionkey", prompts.report(F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")), F.lit("high"), note, F.col("used"), facts).alias("report"))


REPORT_SQL = """WITH g AS (SELECT n_regionkey AS k, list_sort(list(n_name)) AS u FROM nation GROUP BY n_regionkey), e AS (SELECT chr(10) AS nl, repeat('=', 80) AS bar)
SELECT k AS n_regionkey, bar || nl || 'ANSWER' || nl || bar || nl || 'Region ' || k || nl || nl || 'Confidence: HIGH' || nl || CASE WHEN k = 1 THEN 'Note: few' || nl ELSE '' END || nl
  || 'Evidence Used (' || len(u) || ' items):' || nl || array_to_string(list_transform(u, lambda x: '  - ' || x || nl), '') || nl || 'Key Facts Extracted:' || nl
  || array_to_string(list_transform(u, lambda x, i: '  ' || i || '. ' || lower(x) || nl || '     Sources: ' || x || ', z' || nl), '') || nl || bar AS report FROM g, e"""


def batches(spark, sf):
    c = table(spark, sf, "conversations")
    s = c.select(F.lit("all").alias("kind"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.concat_ws("-", "turn", F.sha1("text")).alias("sid"), "text", F.array("role", F.lit("topic")).alias("canons"))
    return prompts.relation_batches(s).select("doc_id", "batch", F.size("sids").alias("n"), F.sha2("text", 256).alias("digest"), F.array_join("canons", ",").alias("canons"))


BATCH_SQL = """WITH s AS (SELECT *, turn || '-' || sha1(text) AS sid, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, turn || '-' || sha1(text)) - 1) // 10 AS batch FROM conversations)
SELECT conv_id AS doc_id, CAST(batch AS BIGINT) AS batch, CAST(count(*) AS INTEGER) AS n, sha256(string_agg(text, chr(10) ORDER BY turn, sid)) AS digest, array_to_string(list_sort(list_append(list(DISTINCT role), 'topic')), ',') AS canons FROM s GROUP BY conv_id, batch"""


def labelled(spark, sf):
    n = table(spark, sf, "part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("n"))
    answers = table(spark, sf, "part").filter("p_size = 1").select(F.col("p_brand").alias("cluster"), (F.col("p_partkey") % 3 != 0).alias("is_entity"))
    return prompts.with_labels(prompts.cluster_batches(n), answers)


LABEL_SQL = """WITH c AS (SELECT p_brand AS cluster, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, cluster LIMIT 60), b AS (SELECT *, CAST((row_number() OVER (ORDER BY n DESC, cluster) - 1) // 15 AS BIGINT) AS batch FROM c)
SELECT batch, cluster, n FROM b WHERE cluster NOT IN (SELECT p_brand FROM part WHERE p_size = 1 AND p_partkey % 3 = 0)"""


def stored(spark, sf):
    edges = tree_edges(spark, sf).withColumn("edge_id", F.concat_ws("|", "src", "dst"))
    return prompts.statements(tree_nodes(spark, sf), edges)


STORE_SQL = f"""WITH {TREE} SELECT CAST(1 AS INTEGER) AS step, 'MERGE (n:' || label || ' {{id: $id}}) SET n += $props' AS statement, id, NULL AS source, NULL AS target FROM tn
UNION ALL SELECT 2, 'MATCH (s {{id: $source}}), (t {{id: $target}}) MERGE (s)-[r:' || type || ' {{id: $id}}]->(t) SET r += $props', src || '|' || dst, src, dst FROM te"""


def uploads(spark, sf):
    name = F.concat(F.lit("../ Étude  "), F.col("p_name"), F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".exe", ".md", "", ".tar.csv")]), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", prompts.safe_name(name).alias("name"), prompts.may_upload(name).alias("allowed"))


UPLOAD_SQL = r"""WITH f AS (SELECT p_partkey, trim(regexp_replace('tude  ' || p_name || ['.PDF', '.exe', '.md', '', '.tar.csv'][p_partkey % 5 + 1], '\s+', ' ', 'g')) AS x FROM part)
SELECT p_partkey, regexp_replace(regexp_replace('.._' || replace(x, ' ', '_'), '[^A-Za-z0-9_.-]', '', 'g'), '^[._]+|[._]+$', '', 'g') AS name, p_partkey % 5 IN (0, 2, 4) AS allowed FROM f"""


def limits(spark, sf):
    given = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("workers"), (F.col("p_size") * 10).alias("top_k"))
    keep = F.udf(lambda w, k: [parsing.options({"workers": w, "top_k": k, "unknown": 1})[x] for x in ("workers", "top_k")], "array<int>")
    return given.select("p_partkey", keep("workers", "top_k").alias("o")).selectExpr("p_partkey", "o[0] AS workers", "o[1] AS top_k")


def queries() -> dict:
    """name: (query, SQL or None)."""
    joined = lambda s, d: prompts.join_pages(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.regexp_replace("text", r"\s+", " ").alias("text"))).select("doc_id", F.length(F.regexp_replace("text", r"\s", "")).alias("n"))
    return {
        "ans2_evidence": (lambda s, d: evidence(s, d).select("query_id", "n", "properties"), EVIDENCE_SQL),
        "snk6_answer_report": (reports, REPORT_SQL),
        "rel4_relation_batches": (batches, BATCH_SQL),
        "rel5_cluster_labels": (labelled, LABEL_SQL),
        "snk3_store_statements": (stored, STORE_SQL),
        "src9_uploads": (uploads, UPLOAD_SQL),
        "src3_join_pages": (joined, r"SELECT conv_id AS doc_id, CAST(sum(length(regexp_replace(text, '\s', '', 'g'))) AS INTEGER) AS n FROM conversations GROUP BY conv_id"),
        "txt30_options": (limits, "SELECT p_partkey, CAST(least(greatest(p_size, 1), 16) AS INTEGER) AS workers, CAST(least(greatest(p_size * 10, 1), 200) AS INTEGER) AS top_k FROM part"),
        "flt2_long_sentences": (lambda s, d: table(s, d, "conversations").filter(F.length(F.trim("text")) >= 25).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 25"),
    }
