"""Every registered query of the library against its SQL; rules without SQL against expected rows."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions import parsing, rules
from kestrel.functions import text as T
from kestrel.operators import community, graph, relations, segment, spans, vectors
from kestrel.plans import build_queries, graph_queries, model_queries, search_queries, text_queries
from tests.conftest import SF, rows_of, sql_rows

def _names():
    return {**text_queries.queries(), **graph_queries.queries(), **search_queries.queries(), **build_queries.queries(), **model_queries.queries()}


@pytest.mark.parametrize("name", list(_names()))
def test_query(spark, name):
    query, sql = _names()[name]
    got = rows_of(query(spark, SF))
    if sql is not None:
        assert got == sql_rows(sql)
    elif name not in ("agg12_candidates", "srt3_ranked_candidates"):
        assert got[1]


def test_structure_and_candidates(spark):
    docs = spark.createDataFrame([(1, "Article 3 says\n1. Regulated DC power supply\nPART III RIGHTS\nFirst Schedule\nthe President")], "doc_id int, text string")
    found = {(r.label, r.canonical) for r in segment.structure(docs).collect()}
    assert found == {("ARTICLE", "article 3"), ("ARTICLE", "article 1"), ("PART", "part iii"), ("SCHEDULE", "first schedule"), ("INSTITUTION", "president")}
    docs = spark.createDataFrame([(1, "see Section 12(2) here. European Central Bank too.")], "doc_id int, text string")
    assert {(r.surface, r.score) for r in segment.rule_candidates(docs).collect()} == {("Section 12", 4), ("European Central Bank", 2)}


def test_relations(spark):
    s = spark.createDataFrame([(0, "on the recommendation of the President", ["article 3"]), (1, "Notwithstanding this", ["motor vehicles act", "general exclusion"])], "sid int, text string, canons array<string>")
    assert [(r.head, r.relation, r.tail, r.confidence) for r in relations.constitution(s).collect()] == [("article 3", "REQUIRES_RECOMMENDATION_FROM", "president", 0.92)]
    assert {(r.relation, r.head, r.tail, r.confidence) for r in relations.finance(s).collect()} == {("OVERRIDES", "motor vehicles act", "general exclusion", 0.82), ("NOTWITHSTANDING", "motor vehicles act", "general exclusion", 0.78)}


def test_greedy_keep():
    assert spans.greedy_keep(["a b c", "a b c", "d", "", ""], 0.9) == [0, 2, 3, 4]
    assert spans.greedy_keep(["a b c d", "a b c d e"], 0.8) == [0]


def test_spans(spark):
    docs = spark.createDataFrame([(1, "A third-party claim. Third party again.")], "doc_id int, text string")
    seeds = spark.createDataFrame([("third party",)], "surface string")
    assert sorted((r.start_char, r.end_char) for r in spans.seed_mentions(docs, seeds).collect()) == [(2, 13), (21, 32)]


@pytest.mark.parametrize("raw,want", [('```json\n{"a": 1}\n```', {"a": 1}), ('x {"a": [1, 2', {"a": [1, 2]}), ("none", None), (None, None), ('{"a": "b', {"a": "b"})])
def test_repair(raw, want):
    assert parsing.loads(raw) == want


def test_options_and_text():
    assert parsing.options({"top_n": 9999, "workers": "0", "x": 1, "top_k": "a"}) == {"top_n": 500, "workers": 1}
    assert parsing.as_text({"a_b": ["x", "y"]}) == "A B:\n- x\n- y"


def test_partition_measures(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    part = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "y")], "node string, comm string")
    r = community.modularity(pairs, part).first()
    assert (r.q, round(r.score, 6)) == (0.5, 0.46)
    found = {r.node: r.comm for r in community.detect(pairs).collect()}
    assert found["a"] == found["b"] != found["c"] == found["d"]


def test_small_communities_move(spark):
    pairs = spark.createDataFrame([("n", "a", 2.0), ("n", "b", 3.0)], "a string, b string, weight double")
    part = spark.createDataFrame([("n", "0"), ("a", "1"), ("b", "2")], "node string, comm string")
    assert {r.node: r.comm for r in community.reassign_small(pairs, part, 2).collect()}["n"] == "2"


def test_validate(spark):
    nodes = spark.createDataFrame([("a", "SENTENCE"), ("c", "COMMUNITY")], "id string, label string")
    edges = spark.createDataFrame([("a", "x", "OWNS"), ("a", "c", "MEMBER_OF")], "src string, dst string, type string")
    assert tuple(graph.validate(nodes, edges).first()) == (1, 1, 1, 0)


def test_generic_weight(spark):
    m = spark.createDataFrame([(1, "ent:policy"), (1, "ent:claim")], "sid int, node string")
    r = graph.cooccurrence(m, F.col("node").isin("ent:policy", "ent:claim")).first()
    assert round(r.weight, 8) == 0.00625


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = rows_of(segment.chunks(docs).select("chunk_id"))
    assert a == rows_of(segment.chunks(docs.orderBy(F.desc("doc_id"))).select("chunk_id"))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for f in (segment.paragraphs, segment.sentences, segment.chunks, segment.structure, segment.rule_candidates):
        assert f(docs).count() == 0
    assert vectors.hash_embed(docs.withColumnRenamed("doc_id", "id")).count() == 0


def test_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert segment.chunks(docs).count() == 0 and segment.sentences(docs).count() == 0
    row = docs.select(rules.classify(F.col("text")).alias("c"), T.node_id(F.col("text")).alias("n")).first()
    assert (row.c, row.n) == ("general", "ent:unknown")


def test_betweenness(spark):
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("b", "d", 1.0)], "a string, b string, weight double")
    assert {r.node: r.rank for r in graph.importance(pairs).collect()} == {"a": 0.0, "b": 2.0, "c": 0.0, "d": 0.0}


def test_ingested_relations(spark):
    got = {(r.src, r.type, r.dst, r.sent_id) for r in build_queries.queries()["rel3_ingest_relations"][0](spark, SF).collect()}
    assert got == {("ent:insurer", "OWNS", "ent:claim", "s1"), ("ent:new_thing", "PART_OF", "ent:insurer", "s0"), ("ent:new_thing", "NODE", "new thing", None)}


def test_embedding_has_the_cells(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").filter("id < 40")
    cells = {}
    for r in vectors.hash_cells(docs).collect():
        cells.setdefault(r.id, {})[r.idx] = r.value
    for r in vectors.hash_embed(docs).collect():
        size = sum(x * x for x in cells[r.id].values()) ** 0.5
        assert all(abs(x - cells[r.id].get(i, 0) / (size + 1e-9)) < 1e-6 for i, x in enumerate(r.embedding))


def test_close_ends(spark):
    got = {r.name: (r.canonical, r.how) for r in graph_queries.queries()["jon5_jon6_jon7_match_ends"][0](spark, SF).collect()}
    assert got["insurers"] == ("insurer", "close") and got["motor vehicle act"] == ("motor vehicles act", "close") and got["unknown thing"][1] == "new"
    cat = spark.createDataFrame([("Motor Vehicles Act", ["MV Act 1988", "motor law"]), ("motor law", None), ("third party insurer", ["insurer of others"])], "canonical string, aliases array<string>")
    names = [("mv act 1988",), ("m v act 1988",), ("Motor Law",), ("xhird party insurey",), ("insurer of otherss",), ("",)]
    got = {r.name: (r.canonical, r.how) for r in relations.match_ends(spark.createDataFrame(names, "name string"), cat).collect()}
    assert got == {"mv act 1988": ("Motor Vehicles Act", "exact"), "m v act 1988": ("Motor Vehicles Act", "close"), "motor law": ("motor law", "exact"), "xhird party insurey": ("xhird party insurey", "new"), "insurer of otherss": ("third party insurer", "close"), "": ("", "new")}


def test_close_ends_are_those_of_difflib(spark):
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(3, 40))).strip() for _ in range(150)} - {""})
    keys = sorted({" ".join(k.split()) for k in keys})
    names = set()
    for k in keys * 6:
        x = list(k)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        names.add(" ".join("".join(x).split()))
    got = {r.name: r.canonical for r in relations.match_ends(spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(k,) for k in keys], "canonical string")).collect()}
    want = {x: x if x in keys else (difflib.get_close_matches(x, keys, n=1, cutoff=0.92) or [x])[0] for x in names}
    assert got == want and sum(x != y for x, y in want.items()) > 100
