"""Registered queries of the graph, community, join and aggregation operators.

Orders are sentences and parts are entities, a line item is a mention; regions, nations,
customers and suppliers are a hierarchy; events of a user stand in time order.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators import community, graph, relations
from kestrel.plans.base import rows, table, values
from kestrel.sources import io

RELATIONS = ("sid int, text string, canons array<string>", [
    (0, "Article 3: on the recommendation of the President the Bill shall be referred to the Legislature of the affected State for its views", ["article 3", "president"]),
    (1, "Notwithstanding anything, the motor vehicles act overrides the general exclusion", ["motor vehicles act", "general exclusion"]),
    (2, "Laws under Article 31A shall not be deemed to be void by article 13", ["article 13", "article 31a"]),
    (3, "The insurer has a right of recovery from the insured, subject to the code", ["insurer", "insured", "civil code"]),
    (4, "The liability must comply with the regulation", ["liability", "regulation"]),
    (5, "3. Changes to the First Schedule", ["first schedule"]),
    (6, "nothing here", ["a", "b"]),
    (7, "", ["x", "y"]),
])
FOUND = ("sid int, head string, relation string, tail string, confidence double, canons array<string>", [
    (0, "a", "part of", "b", 0.9, ["a", "b"]), (1, "a", "Invented Label", "b", 0.5, ["a", "b"]), (2, "a", "owns", "a", 0.9, ["a"]),
    (3, "a", "owns", "c", 0.9, ["a", "b"]), (4, "a", "owns", "b", 0.2, ["a", "b"]), (5, "a", "9x", "b", 0.9, ["a", "b"]),
])
NAMES = ("name string", [("Motor Vehicles Act",), ("motor vehicle act",), ("unknown thing",), ("Insurer",), ("insurers",)])
CATALOG = ("canonical string", [("motor vehicles act",), ("insurer",), ("claim",)])
CITED = ("id int, src string, dst string, type string", [(0, "art:3", "inst:president", "AMENDS"), (1, "art:13", "art:31a", "LIMITS"), (2, "art:31a", "art:13", "OVERRIDES"), (3, "x", "y", "OVERRIDES")])


def mentions(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sid"), F.col("l_partkey").alias("node"))


def pairs(spark, sf):
    return graph.cooccurrence(mentions(spark, sf)).select("a", "b", "weight")


COOC = """m AS (SELECT DISTINCT l_orderkey AS sid, l_partkey AS node FROM lineitem),
k AS (SELECT sid, count(*) AS k FROM m GROUP BY sid),
co AS (SELECT x.node AS a, y.node AS b, count(*) AS count, sum(1.0::DOUBLE / (k.k - 1)) AS weight, min(x.sid) AS first_sid FROM m x JOIN m y ON x.sid = y.sid AND x.node < y.node JOIN k ON k.sid = x.sid GROUP BY 1, 2)"""


def brands(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("comm"))


COLL = f"""{COOC}, cl AS (SELECT least(pa.p_brand, pb.p_brand) AS ca, greatest(pa.p_brand, pb.p_brand) AS cb, sum(weight) AS weight FROM co JOIN part pa ON a = pa.p_partkey JOIN part pb ON b = pb.p_partkey GROUP BY 1, 2)"""
COH = f"""{COLL}, sp AS (SELECT ca AS comm, weight AS i, 0.0::DOUBLE AS e FROM cl WHERE ca = cb UNION ALL SELECT ca, 0.0, weight FROM cl WHERE ca <> cb UNION ALL SELECT cb, 0.0, weight FROM cl WHERE ca <> cb),
ch AS (SELECT comm, sum(i) AS internal, sum(e) AS external FROM sp GROUP BY comm)"""


def tree_nodes(spark, sf):
    n = lambda t, k, p, label, name: table(spark, sf, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(label).alias("label"), F.col(name).alias("canonical"))
    return n("region", "r_regionkey", "r:", "COMMUNITY", "r_name").unionByName(n("nation", "n_nationkey", "n:", "COMMUNITY", "n_name")).unionByName(n("supplier", "s_suppkey", "s:", "ENTITY", "s_name"))


def tree_edges(spark, sf):
    up = table(spark, sf, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("src"), F.concat(F.lit("r:"), "n_regionkey").alias("dst"), F.lit("PART_OF").alias("type"))
    return up.unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("src"), F.concat(F.lit("n:"), "s_nationkey").alias("dst"), F.lit("MEMBER_OF").alias("type")))


TREE = """tn AS (SELECT 'r:' || r_regionkey AS id, 'COMMUNITY' AS label, r_name AS canonical FROM region UNION ALL SELECT 'n:' || n_nationkey, 'COMMUNITY', n_name FROM nation UNION ALL SELECT 's:' || s_suppkey, 'ENTITY', s_name FROM supplier),
te AS (SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'PART_OF' AS type FROM nation UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'MEMBER_OF' FROM supplier),
tu AS (SELECT src AS node, dst AS other, type FROM te UNION ALL SELECT dst, src, type FROM te)"""


def catalog(spark, sf):
    li = table(spark, sf, "lineitem")
    first = F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber"))
    g = li.groupBy("l_partkey").agg(first.alias("label"), F.array_sort(F.collect_set("l_linestatus")).alias("aliases"), F.countDistinct("l_orderkey").alias("sources"))
    return g.select("l_partkey", "label", F.array_join("aliases", ",").alias("aliases"), "sources")


def intervals(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    left = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("l_id"), F.col("s").alias("ls"), (F.col("s") + 3600000000).alias("le"))
    right = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("r_id"), F.col("s").alias("rs"), (F.col("s") + 1800000000).alias("re"))
    return graph.interval_join(left, right, "user_id", 3600000000).select("l_id", "r_id")


def asof(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", (F.col("event_type") != "signup").cast("int"))
    return graph.last_before(e, "user_id", ["ts", "kind", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "part").select("event_id", "part")


def pagerank(spark, sf):
    e = tree_edges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight"))
    return graph.pagerank(e).select("node", F.round("rank", 6).alias("rank"))


def pagerank_sql(n: int = 10) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT DISTINCT node, 1.0::DOUBLE / (SELECT count(DISTINCT node) FROM tu) AS rank FROM tu)", "dg AS MATERIALIZED (SELECT node, count(*) AS d FROM tu GROUP BY node)"]
    for k in range(1, n + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT r0.node, 0.15::DOUBLE / (SELECT count(*) FROM r0) + 0.85::DOUBLE * coalesce(x.x, 0.0) AS rank FROM r0 LEFT JOIN (SELECT tu.other AS node, sum(p.rank / dg.d) AS x FROM tu JOIN r{k - 1} p ON p.node = tu.node JOIN dg ON dg.node = tu.node GROUP BY 1) x ON x.node = r0.node)")
    return f"WITH {TREE}, {', '.join(steps)} SELECT node, round(rank, 6) AS rank FROM r{n}"


def nation_partition(spark, sf):
    return table(spark, sf, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("node"), F.concat(F.lit("n:"), "s_nationkey").alias("comm"))


def communities(spark, sf):
    stats = community.coherence(community.collapse(pairs(spark, sf), brands(spark, sf)))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("canonical"))
    out = community.materialise(brands(spark, sf), names, stats)
    return out.select("id", "members_count", F.round("coherence", 6).alias("coherence"), "summary")


def detected(spark, sf):
    e = tree_edges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight"))
    return community.detect(e)


def hierarchy(spark, sf):
    e = tree_edges(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight"))
    return community.hierarchy(e, max_levels=3, min_size=2)


def bridges(spark, sf):
    deg = graph.weighted_degree(pairs(spark, sf)).select("node", F.round("degree", 6).alias("rank"))
    return graph.bridges(brands(spark, sf), deg)


def queries() -> dict:
    """name: (query, SQL or None)."""
    r6 = lambda c: F.round(c, 6).alias(c)
    return {
        "agg1_entity_catalog": (catalog, "SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS label, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS aliases, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY l_partkey"),
        "agg2_jon4_cooccurrence": (lambda s, d: graph.cooccurrence(mentions(s, d)).select("a", "b", "count", r6("weight"), F.get("evidence", F.lit(0)).alias("first_sid")), f"WITH {COOC} SELECT a, b, count, round(weight, 6) AS weight, first_sid FROM co"),
        "agg3_degree": (lambda s, d: graph.degree(tree_edges(s, d)), f"WITH {TREE} SELECT node, count(*) AS degree FROM tu GROUP BY node"),
        "agg4_entity_graph": (lambda s, d: graph.entity_graph(table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit(None).cast("double").alias("weight"), F.col("l_linenumber").alias("count"), F.col("l_discount").alias("confidence"))).select("a", "b", r6("weight")), "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, round(sum(l_linenumber::DOUBLE), 6) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2"),
        "agg5_hub_downweight": (lambda s, d: graph.hub_downweight(pairs(s, d)).select("a", "b", r6("weight"), "hub"), f"WITH {COOC}, dg AS (SELECT node, round(sum(weight), 9) AS g FROM (SELECT a AS node, weight FROM co UNION ALL SELECT b, weight FROM co) GROUP BY node), hb AS (SELECT node FROM dg WHERE g >= round((SELECT quantile_cont(g, 0.98) FROM dg WHERE g > 0), 9)) SELECT a, b, round(weight * CASE WHEN a IN (SELECT node FROM hb) OR b IN (SELECT node FROM hb) THEN 0.2 ELSE 1.0 END, 6) AS weight, (a IN (SELECT node FROM hb) OR b IN (SELECT node FROM hb)) AS hub FROM co"),
        "agg6_evidence_sentences": (lambda s, d: mentions(s, d).join(brands(s, d), "node").groupBy("comm", "sid").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(W.partitionBy("comm").orderBy(F.desc("n"), "sid"))).filter("r <= 12").select("comm", "sid", "n"), "SELECT comm, sid, n FROM (SELECT p_brand AS comm, l_orderkey AS sid, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, l_orderkey) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 12"),
        "agg7_collapse": (lambda s, d: community.collapse(pairs(s, d), brands(s, d)).select("ca", "cb", r6("weight")), f"WITH {COLL} SELECT ca, cb, round(weight, 6) AS weight FROM cl"),
        "agg8_coherence": (lambda s, d: community.coherence(community.collapse(pairs(s, d), brands(s, d))).select("comm", r6("internal"), r6("external"), r6("coherence")), f"WITH {COH} SELECT comm, round(internal, 6) AS internal, round(external, 6) AS external, round(internal / nullif(internal + external, 0), 6) AS coherence FROM ch"),
        "agg9_modularity": (lambda s, d: community.modularity(pairs(s, d), brands(s, d)).select(r6("q"), "communities", "nodes", r6("score")), f"WITH {COH}, t AS (SELECT sum(2 * internal + external) / 2 AS m, sum(internal) AS i, sum((2 * internal + external) ** 2) AS s FROM ch), n AS (SELECT count(DISTINCT p_brand) AS c, count(*) AS n FROM part) SELECT round(i / m - s / (4 * m * m), 6) AS q, c AS communities, n AS nodes, round(i / m - s / (4 * m * m) - 0.08::DOUBLE * c / n, 6) AS score FROM t, n"),
        "agg10_validate": (lambda s, d: graph.validate(tree_nodes(s, d).filter("label = 'COMMUNITY'"), tree_edges(s, d)), f"WITH {TREE}, c AS (SELECT * FROM tn WHERE label = 'COMMUNITY'), j AS (SELECT type, a.label AS ls, b.label AS ld FROM te LEFT JOIN c a ON a.id = src LEFT JOIN c b ON b.id = dst) SELECT count(*) FILTER (ls IS NULL OR ld IS NULL) AS dangling, CAST(sum((ls IS NULL)::INT + (ld IS NULL)::INT) AS BIGINT) AS missing, 0::BIGINT AS bad_member, count(*) FILTER (type = 'PART_OF' AND ls = 'COMMUNITY' AND ld <> 'COMMUNITY') AS bad_part FROM j"),
        "agg11_scn_label_counts": (lambda s, d: tree_nodes(s, d).groupBy("label").agg(F.count("*").alias("n")).unionByName(tree_edges(s, d).groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n"))), f"WITH {TREE} SELECT label, count(*) AS n FROM tn GROUP BY label UNION ALL SELECT type, count(*) FROM te GROUP BY type"),
        "agg14_required_relations": (lambda s, d: rows(s, CITED).filter(F.col("type").isin("OVERRIDES", "LIMITS") & (F.col("src").isin("art:13", "art:31a") | F.col("dst").isin("art:13", "art:31a"))).groupBy("type").agg(F.count("*").alias("n")), f"WITH {values(CITED, 'f')} SELECT type, count(*) AS n FROM f WHERE type IN ('OVERRIDES', 'LIMITS') AND (src IN ('art:13', 'art:31a') OR dst IN ('art:13', 'art:31a')) GROUP BY type"),
        "agg15_adjacency": (lambda s, d: mentions(s, d).groupBy("node").agg(F.countDistinct("sid").alias("sentences"), F.min("sid").alias("first_sid")), "SELECT l_partkey AS node, count(DISTINCT l_orderkey) AS sentences, min(l_orderkey) AS first_sid FROM lineitem GROUP BY l_partkey"),
        "jon1_endpoints": (lambda s, d: tree_edges(s, d).join(tree_nodes(s, d).select(F.col("id").alias("src"), F.col("canonical").alias("sc")), "src").join(tree_nodes(s, d).select(F.col("id").alias("dst"), F.col("canonical").alias("dc")), "dst").select("sc", "type", "dc"), f"WITH {TREE} SELECT a.canonical AS sc, type, b.canonical AS dc FROM te JOIN tn a ON a.id = src JOIN tn b ON b.id = dst"),
        "jon2_interval_overlap": (intervals, "SELECT l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r ON l.user_id = r.user_id WHERE l.event_type = 'purchase' AND r.event_type = 'view' AND r.ts < l.ts + INTERVAL 1 HOUR AND r.ts + INTERVAL 30 MINUTE > l.ts"),
        "jon3_win3_asof": (asof, "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'signup', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM events"),
        "jon5_jon6_jon7_match_ends": (lambda s, d: relations.match_ends(rows(s, NAMES), rows(s, CATALOG)), None),
        "jon8_evidence_sentence": (lambda s, d: relations.evidence_sentence(table(s, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("r"), F.substring("text", 1, 20).alias("evidence")), table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).alias("sent_id"), "text")).distinct(), "WITH r AS (SELECT DISTINCT conv_id AS doc_id, turn AS r, substr(text, 1, 20) AS evidence FROM conversations WHERE role = 'user'), j AS (SELECT r.*, c.turn, c.conv_id || ':' || c.turn AS sent_id, contains(lower(c.text), lower(evidence)) AND evidence <> '' AS hit FROM r LEFT JOIN conversations c ON c.conv_id = r.doc_id) SELECT doc_id, r, evidence, coalesce(arg_min(sent_id, turn) FILTER (hit), arg_min(sent_id, turn)) AS sent_id FROM j GROUP BY doc_id, r, evidence"),
        "jon10_previous_turn": (lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "text")), "text").alias("context")), "SELECT conv_id, turn, concat_ws(' ', lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), text) AS context FROM conversations"),
        "jon11_semi": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
        "jon12_anti": (lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
        "gra1_neighbors": (lambda s, d: graph.neighbors(tree_edges(s, d).select("src", "dst", "type"), tree_nodes(s, d), 2, ["PART_OF", "MEMBER_OF"]), f"WITH {TREE}, o AS (SELECT DISTINCT node AS start, other AS node FROM tu) SELECT start, node FROM o UNION SELECT o.start, tu.other FROM o JOIN tu ON tu.node = o.node"),
        "gra2_gra4_linked": (lambda s, d: graph.linked(tree_edges(s, d), "MEMBER_OF", tree_nodes(s, d).select("id"), "dst").unionByName(graph.linked(tree_edges(s, d), "MEMBER_OF", tree_nodes(s, d).select("id"), "src")), f"WITH {TREE} SELECT dst AS id, src AS other FROM te WHERE type = 'MEMBER_OF' UNION ALL SELECT src, dst FROM te WHERE type = 'MEMBER_OF'"),
        "gra3_parents": (lambda s, d: graph.linked(tree_edges(s, d), "PART_OF", tree_nodes(s, d).select("id"), "src"), f"WITH {TREE} SELECT src AS id, dst AS other FROM te WHERE type = 'PART_OF'"),
        "gra7_simple_paths": (lambda s, d: graph.simple_paths(tree_edges(s, d).filter("type = 'PART_OF'"), tree_nodes(s, d).filter("label = 'COMMUNITY'"), 3).select(F.array_join("path", ">").alias("path")), f"WITH RECURSIVE {TREE}, u AS (SELECT DISTINCT node, other FROM tu WHERE type = 'PART_OF'), p(path, last) AS (SELECT [id], id FROM tn WHERE label = 'COMMUNITY' UNION ALL SELECT list_append(path, u.other), u.other FROM p JOIN u ON u.node = p.last WHERE NOT list_contains(path, u.other) AND len(path) <= 3) SELECT DISTINCT array_to_string(path, '>') AS path FROM p WHERE len(path) > 1"),
        "gra8_prune": (lambda s, d: graph.prune(tree_nodes(s, d), tree_edges(s, d), 2).select("id", "label"), f"WITH {TREE}, dg AS (SELECT node, count(*) AS d FROM tu GROUP BY node) SELECT id, label FROM tn LEFT JOIN dg ON node = id WHERE coalesce(d, 0) >= 2 OR label IN ('DOCUMENT', 'SENTENCE', 'COMMUNITY')"),
        "gra9_gra10_detect": (detected, None),
        "gra11_hierarchy": (hierarchy, None),
        "gra12_pagerank": (pagerank, pagerank_sql()),
        "gra13_part_communities": (lambda s, d: tree_edges(s, d).filter("type = 'PART_OF'").groupBy("dst").agg(F.count("*").alias("members")).select(F.concat(F.lit("comm_part:"), "dst").alias("id"), "members", F.lit(1.0).alias("coherence")), f"WITH {TREE} SELECT 'comm_part:' || dst AS id, count(*) AS members, 1.0::DOUBLE AS coherence FROM te WHERE type = 'PART_OF' GROUP BY dst"),
        "gra14_communities": (communities, f"WITH {COH}, nm AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS r FROM part), g AS (SELECT p_brand, count(*) AS n, substr(string_agg(p_name, ', ' ORDER BY r) FILTER (r <= 6), 1, 220) AS summary FROM nm GROUP BY p_brand) SELECT 'comm_l0:' || p_brand AS id, n AS members_count, round(internal / nullif(internal + external, 0), 6) AS coherence, summary FROM g LEFT JOIN ch ON comm = p_brand WHERE n >= 3"),
        "gra15_member_edges": (lambda s, d: nation_partition(s, d).select(F.col("node").alias("src"), F.lit("MEMBER_OF").alias("type"), F.col("comm").alias("dst")), "SELECT 's:' || s_suppkey AS src, 'MEMBER_OF' AS type, 'n:' || s_nationkey AS dst FROM supplier"),
        "gra16_bridges": (bridges, f"WITH {COOC}, dg AS (SELECT node, round(sum(weight), 6) AS rank FROM (SELECT a AS node, weight FROM co UNION ALL SELECT b, weight FROM co) GROUP BY node), b AS (SELECT * FROM dg ORDER BY rank DESC, node LIMIT 12) SELECT p_partkey AS node, p_brand AS comm, b.node IS NOT NULL AS is_bridge, coalesce(b.rank, 0.0) AS bridge_score FROM part LEFT JOIN b ON b.node = p_partkey"),
        "gra17_contains": (lambda s, d: graph.contains_edges(table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("doc"), F.col("n_regionkey").cast("string").alias("part"), F.col("n_nationkey").cast("string").alias("art"))), "WITH j AS (SELECT c_mktsegment AS doc, n_regionkey::VARCHAR AS part, n_nationkey::VARCHAR AS art FROM customer JOIN nation ON c_nationkey = n_nationkey), e AS (SELECT 'doc:' || doc AS src, 'part:' || part AS dst FROM j UNION SELECT 'doc:' || doc, 'art:' || art FROM j UNION SELECT 'part:' || part, 'art:' || art FROM j) SELECT src, dst, substr(sha256(src || '||CONTAINS||' || dst), 1, 16) AS edge_id FROM e"),
        "rel1_constitution": (lambda s, d: relations.constitution(rows(s, RELATIONS)), None),
        "rel2_finance": (lambda s, d: relations.finance(rows(s, RELATIONS)), None),
        "flt6_rel3_clean_relations": (lambda s, d: relations.clean_relations(rows(s, FOUND)).select("sid", "head", "relation", "tail"), "SELECT * FROM (VALUES (0, 'a', 'PART_OF', 'b'), (1, 'a', 'RELATED_TO', 'b')) t(sid, head, relation, tail)"),
        "ded5_relation_edges": (lambda s, d: table(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_returnflag").alias("type"), F.col("l_partkey").alias("dst")).dropDuplicates(), "SELECT DISTINCT l_suppkey AS src, l_returnflag AS type, l_partkey AS dst FROM lineitem"),
        "txt6_edge_ids": (lambda s, d: tree_edges(s, d).select("src", "dst", T.edge_id(F.col("src"), F.col("type"), F.col("dst"), F.lit("s")).alias("edge_id")), f"WITH {TREE} SELECT src, dst, substr(sha256(src || '||' || type || '||' || dst || '||s'), 1, 16) AS edge_id FROM te"),
        "snk4_export_groups": (lambda s, d: io.export_groups(table(s, d, "customer").select(F.col("c_mktsegment").alias("label")), 100), "SELECT regexp_replace(trim(c_mktsegment), '[^A-Za-z0-9_]', '_', 'g') AS label, count(*) AS n, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM customer GROUP BY 1"),
        "win1_top_per_group": (lambda s, d: table(s, d, "part").withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("r <= 10").select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 10"),
        "win2_running_caps": (lambda s, d: table(s, d, "lineitem").withColumn("a", F.row_number().over(W.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber"))).filter("a <= 8").withColumn("b", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber"))).filter("b <= 240").groupBy("l_suppkey").agg(F.count("*").alias("n")), "WITH a AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) <= 8), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) <= 240) SELECT l_suppkey, count(*) AS n FROM b GROUP BY 1"),
        "set1_union": (lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey")).distinct(), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
        "set2_intersect": (lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier"),
        "set3_except": (lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(s, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()).distinct(), "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT DISTINCT s_nationkey FROM supplier)"),
        "set4_union_all": (lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k").agg(F.count("*").alias("n")), "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k"),
        "scn2_edges_by_type": (lambda s, d: tree_edges(s, d).filter(F.col("type").isin([t for t in graph.RETRIEVAL_TYPES])).select("src", "type"), f"WITH {TREE} SELECT src, type FROM te WHERE type IN ({', '.join(repr(t) for t in sorted({*rules.RELATIONS, 'CO_OCCURS_WITH', 'MEMBER_OF'}))})"),
    }
