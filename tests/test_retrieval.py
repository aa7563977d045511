"""Retrieval over the whole graph, communities and quantiles against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import community, graph, relations, retrieve, vectors
from kestrel.plans import build_queries, retrieval
from kestrel.functions import rules

DOCS = [
    (1, "Article 3 lets Parliament form new States on the recommendation of the President alone. Article 13 says that laws against these rights are void from the start."),
    (2, "Laws under Article 31A shall not be deemed to be void under Article 13 of the Constitution. The Motor Vehicles Act governs every insurer and the insured in this country."),
    (3, "The Motor Vehicles Act names the Third Party Liability of the Insurance Company in plain words. The Insurance Company may recover under the Motor Vehicles Act from the insured."),
    (4, "Notwithstanding the General Exclusion the Motor Vehicles Act prevails in Article 13 matters. The Insurance Company and the Motor Vehicles Act share this sentence again."),
    (5, None), (6, ""), (7, "The Insurance Company and the Motor Vehicles Act share this sentence again."),
]
ASKED = [(1, "what does Article 3 say about the President"), (2, "the Insurance Company and the Motor Vehicles Act"), (3, None), (4, "Articles 31A and 13")]


def embed(text, dim=vectors.DIM):
    v = np.zeros(dim)
    cells = vectors.Cells(dim)
    for t in vectors._TOKEN.findall((text or "").lower()):
        v[cells[t][0]] += cells[t][1]
    return v / (np.linalg.norm(v) + 1e-9)


def plain(c, top_n=20, top_k=40):
    """The steps of the search one by one over collected tables."""
    items = {r.id: r for r in c.items.collect()}
    nodes = {r.id: r for r in c.nodes.collect()}
    edges = [(r.src, r.dst, r.type) for r in c.edges.collect()]
    vec = {i: embed(r.text) for i, r in items.items()}
    members = {}
    for a, b, t in sorted(edges):
        if t == "MEMBER_OF":
            members.setdefault(b, []).append(a)
    out = {}
    spark = c.items.sparkSession
    for qid, q in ASKED:
        if not q:
            continue
        e = embed(q)
        sem = {i: round(float(v @ e), 5) for i, v in vec.items() if v.any()}
        floors = {}
        asked = retrieve.cited(spark.createDataFrame([(qid, q)], "query_id int, q string"))
        for r in retrieve.inject(asked, c.items).collect() + retrieve.lexical(asked, c.items).collect():
            floors[r.id] = max(r.floor, floors.get(r.id, 0))
        start = set(sorted(sem, key=lambda i: (-sem[i], i))[:top_n]) | set(floors)
        reached = set()
        for i in start:
            kind = items[i].item_type
            for a, b, t in edges:
                if kind == "ENTITY" and t in graph.RETRIEVAL_TYPES and i in (a, b):
                    reached.add(b if a == i else a)
                if t == "MENTION_IN" and (kind, i) == ("ENTITY", a):
                    reached.add(b)
                if t == "MENTION_IN" and (kind, i) == ("SENTENCE", b):
                    reached.add(a)
            if kind == "COMMUNITY":
                reached.update(members.get(i, [])[:6])
        rows = []
        for i in start | reached:
            kind = items[i].item_type if i in items else nodes[i].label
            comm = 0.15 * 1.2 * (0.8 + 0.4 * min(max(items[i].coherence or 0.0, 0.0), 1.0)) if i in items and kind.startswith("COMMUNITY") else None
            if i in start:
                g = (comm or 0.0) + (0.0 if i not in reached else 0.6 if kind.startswith("COMMUNITY") or kind == "ENTITY" else 0.25)
            else:
                g = 1.0 if comm is None else comm
            s = max(sem.get(i, 0.0), floors.get(i, -1.0)) if i in items else 0.0
            text = items[i].text if i in items else nodes[i].text or ""
            rows.append((round(0.7 * s + 0.3 * g, 6), i, kind, text))
        kept = []
        for h, i, kind, text in sorted((r for r in rows if r[0] >= 0.15), key=lambda r: (-r[0], r[1])):
            words = set(text.lower().split())
            free = kind in retrieve.DISTINCT_FREE
            if not free and any(words and k[2] and len(words & k[2]) >= 0.9 * len(words | k[2]) for k in kept):
                continue
            if not free and words and any(k[2] and float(embed(text) @ embed(k[3])) >= 0.92 for k in kept):
                continue
            kept.append((i, h, words, text))
            if len(kept) == top_k:
                break
        out[qid] = {(i, h) for i, h, _, _ in kept}
    return out


def test_hybrid_search(spark):
    c = retrieval.corpus(spark.createDataFrame(DOCS, "doc_id long, text string"))
    kinds = {r.item_type for r in c.items.select("item_type").distinct().collect()}
    assert kinds >= {"CHUNK", "SENTENCE", "ENTITY", "RELATION", "PROVISION_CONTEXT", "COMMUNITY"}
    asked = spark.createDataFrame(ASKED, "query_id int, q string")
    got = {}
    for r in retrieval.search(asked, c).collect():
        got.setdefault(r.query_id, set()).add((r.id, r.hybrid))
    want = plain(c)
    assert got.keys() == want.keys()
    for q in want:
        assert {i for i, _ in got[q]} == {i for i, _ in want[q]}
        assert all(abs(dict(got[q])[i] - h) < 2e-5 for i, h in want[q])


def test_search_of_nothing(spark):
    c = retrieval.corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert retrieval.search(spark.createDataFrame(ASKED, "query_id int, q string"), c).count() == 0


def test_selection_keeps_one_of_like_vectors(spark):
    rows = [(1, f"i{k}", t, kind, 1.0 - k / 100, k + 1, e) for k, (t, kind, e) in enumerate([("a b", "CHUNK", [1.0, 0.0]), ("c d", "CHUNK", [0.99, 0.05]), ("e f", "ENTITY", [1.0, 0.0]), ("a b", "SENTENCE", None), ("", "CHUNK", None), ("g", "CHUNK", [0.0, 1.0]), ("h", "CHUNK", [-1.0, 0.0])])]
    many = [(2, f"m{k:04}", "x y", "CHUNK", 0.5, k + 1, [1.0, 0.0]) for k in range(3000)]
    df = spark.createDataFrame(rows + many, "query_id int, id string, text string, item_type string, hybrid double, place int, embedding array<double>")
    got = sorted((r.query_id, r.id) for r in retrieve.dedup_ranked(df, 4).collect())
    assert got == [(1, "i0"), (1, "i2"), (1, "i4"), (1, "i5"), (2, "m0000")]


@pytest.mark.parametrize("share", [0.5, 0.98, 0.999])
def test_quantile(spark, share):
    rng = random.Random(3)
    xs = [round(rng.paretovariate(0.7), 9) for _ in range(3000)] + [7.0] * 2000
    got = graph.quantile(spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double"), "x", share, few=5, bins=10)
    assert math.isclose(got, float(np.quantile(xs, share)), rel_tol=1e-12)


def test_quantile_of_nothing_and_of_ties(spark):
    assert graph.quantile(spark.createDataFrame([], "x double"), "x", 0.5) is None
    assert graph.quantile(spark.createDataFrame([(2.0,)] * 5, "x double"), "x", 0.7) == 2.0
    assert graph.hub_downweight(spark.createDataFrame([], "a string, b string, weight double")).count() == 0


def test_chosen_communities_are_as_good_as_planted_ones(spark):
    rng = random.Random(1)
    pairs = [(f"n{a:02}", f"n{b:02}", 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    df = spark.createDataFrame(pairs, "a string, b string, weight double")
    planted = spark.createDataFrame([(f"n{a:02}", a // 10) for a in range(60)], "node string, comm int")
    best = community.modularity(df, community.choose(df)).first()
    assert best.q >= 0.98 * community.modularity(df, planted).first().q and best.nodes == 60


def test_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (500, 8)).astype(float)
    rows = [(f"v{i:03}", list(map(float, v))) for i, v in enumerate(x)] + [("none", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    q = df.filter("id < 'v020'").withColumnRenamed("id", "query_id")
    got = {}
    for r in vectors.cosine_top(df, q, 7, block=6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    s = np.round(unit @ unit.T, 5)
    for i in range(20):
        assert [got[f"v{i:03}"][k + 1] for k in range(7)] == [f"v{j:03}" for j in sorted(range(500), key=lambda j: (-s[i, j], j))[:7]]


def test_merged_catalog_in_order(spark):
    rng = random.Random(9)
    names = []
    for _ in range(40):
        base = [rng.choice("abcdefghij") * rng.choice([1, 2, 7]) for _ in range(rng.choice([2, 3, 40, 60, 80]))]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(["zz", "a", "b2"])
            rng.shuffle(x)
            names.append(" ".join(x))
    names += ["Article 3", "article 3", "Article 13", "", " "]
    rng.shuffle(names)
    rows = [(k, x, "AB"[k % 2]) for k, x in enumerate(names)]
    got = {r.ord: (r.label, r.canonical, tuple(r.aliases)) for r in relations.merge_catalog(spark.createDataFrame(rows + [(999, None, "A")], "ord int, canonical string, label string")).collect()}
    want, used = {}, set()
    bags = [collections.Counter(x.lower().split()) for x in names]
    size = [sum(n * n for n in b.values()) for b in bags]
    firm = [bool(re.search("[0-9]", x)) or len(" ".join(x.split())) <= 5 for x in names]
    for i, x in enumerate(names):
        if i in used:
            continue
        merged = {x}
        for j in range(i + 1, len(names)):
            if j in used or i % 2 != j % 2 or not bags[i] or not bags[j]:
                continue
            if "article" in bags[i] or "article" in bags[j]:
                close = bags[i] == bags[j]
            else:
                close = sum(n * bags[j][w] for w, n in bags[i].items()) / math.sqrt(size[i] * size[j]) >= (0.985 if firm[i] or firm[j] else 0.99) - 1e-12
            if close:
                used.add(j)
                merged.add(names[j])
        want[i] = ("AB"[i % 2], x, tuple(sorted(merged)))
    assert got == want and sum(len(v[2]) > 1 for v in want.values()) > 10
