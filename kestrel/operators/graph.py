"""Property-graph operators over nodes (id, label) and edges (src, dst, type, ...)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.operators.scratch import written

KEPT_LABELS = ["DOCUMENT", "SENTENCE", "COMMUNITY"]


def undirected(edges: DataFrame, *extra: str) -> DataFrame:
    """(node, other, *extra): every edge from both ends."""
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *extra)
    return there.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *extra))


def degree(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("node").agg(F.count("*").alias("degree"))


def cooccurrence(mentions: DataFrame, generic: Column | None = None, evidence: int = 6, max_nodes: int | None = None) -> DataFrame:
    """(a, b, count, weight, evidence) of unordered node pairs of a sentence, from (sid, node).

    A sentence of k nodes adds 1 / (k - 1) to each pair, a quarter for each generic end and a
    tenth more if both are. With `max_nodes` larger sentences are left to the caller.
    """
    m = mentions.filter("node IS NOT NULL").select("sid", "node", (F.lit(False) if generic is None else generic).alias("g")).distinct()
    sets = m.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("node", "g"))).alias("n")).filter(F.size("n") > 1)
    if max_nodes:
        sets = sets.filter(F.size("n") <= max_nodes)
    one = sets.select("sid", "n", F.size("n").alias("k"), F.posexplode("n").alias("i", "x"))
    pair = one.select("sid", "k", "x", F.explode(F.slice("n", F.col("i") + 2, F.col("k"))).alias("y"))
    w = F.lit(1.0) / (F.col("k") - 1) * F.when(F.col("x.g"), 0.25).otherwise(1.0) * F.when(F.col("y.g"), 0.25).otherwise(1.0) * F.when(F.col("x.g") & F.col("y.g"), 0.1).otherwise(1.0)
    pair = pair.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), "sid", w.alias("w"))
    grouped = pair.groupBy("a", "b").agg(F.count("*").alias("count"), F.sum("w").alias("weight"))
    first = pair.withColumn("r", F.row_number().over(W.partitionBy("a", "b").orderBy("sid"))).filter(F.col("r") <= evidence)  # cut before it is collected
    return grouped.join(first.groupBy("a", "b").agg(F.array_sort(F.collect_list("sid")).alias("evidence")), ["a", "b"])


def entity_graph(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """(a, b, weight): directed multi-edges as one undirected pair; weight, else count, else confidence, else 1."""
    w = F.coalesce("weight", F.col("count").cast("double"), "confidence", F.lit(1.0))
    kept = edges.withColumn("w", w).filter((F.col("w") >= min_weight) & (F.col("src") != F.col("dst")))
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("weight"))


def weighted_degree(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.round(F.sum("weight"), 9).alias("degree"))


def quantile(rows: DataFrame, column: str, share: float, few: int = 10_000, bins: int = 1000) -> float | None:
    """The exact, interpolated quantile of a double column; null without values.

    Counts of equal bins narrow the range that holds the place until at most `few` distinct values are in it,
    so that neither a task nor the driver holds more.
    """
    v = rows.select(F.col(column).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    s = v.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not s["n"]:
        return None
    place = (s["n"] - 1) * share

    def at(k: int) -> float:
        lo, hi, before = s["lo"], s["hi"], 0
        while lo < hi:
            inside = v.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            step = (hi - lo) / bins
            cell = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1)) if step > 0 else F.lit(0)
            own = inside.groupBy(cell.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for r in sorted(own.collect()):  # at most `bins` rows
                if before + r["n"] > k:
                    break
                before += r["n"]
            lo, hi = r["lo"], r["hi"]
            if r["d"] <= few:
                for x in sorted(inside.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect()):
                    if before + x["n"] > k:
                        return x["v"]
                    before += x["n"]
        return lo

    low = at(int(place))
    return low if place == int(place) else low + (at(int(place) + 1) - low) * (place - int(place))


def hub_downweight(pairs: DataFrame, pctl: float = 0.98, penalty: float = 0.2) -> DataFrame:
    """The pairs with `penalty` on those that touch a node at or over the quantile of positive weighted degrees."""
    pctl, penalty = min(max(pctl, 0.5), 0.999), min(max(penalty, 0.01), 1.0)
    deg = written(weighted_degree(pairs), "degrees")
    limit = quantile(deg.filter("degree > 0"), "degree", pctl)
    hubs = deg.filter(F.col("degree") >= F.round(F.lit(limit).cast("double"), 9)).select("node")
    flag = lambda c: hubs.select(F.col("node").alias(c), F.lit(True).alias(f"hub_{c}"))
    marked = pairs.join(flag("a"), "a", "left").join(flag("b"), "b", "left")
    hub = F.coalesce("hub_a", F.lit(False)) | F.coalesce("hub_b", F.lit(False))
    return marked.select("a", "b", (F.col("weight") * F.when(hub, penalty).otherwise(1.0)).alias("weight"), hub.alias("hub"))


def neighbors(edges: DataFrame, starts: DataFrame, hops: int = 1, types: list[str] | None = None) -> DataFrame:
    """(start, node): neighbours over the types in either direction; two hops may come back to the start."""
    ends = undirected(edges if types is None else edges.filter(F.col("type").isin(types))).distinct()
    one = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).join(ends, "node").select("start", F.col("other").alias("node")).distinct()
    if hops == 1:
        return one
    two = one.join(ends, "node").select("start", F.col("other").alias("node"))
    return one.unionByName(two).distinct()


def linked(edges: DataFrame, kind: str, ids: DataFrame, end: str = "src") -> DataFrame:
    """(id, other): the far ends of edges of one type that begin (`src`) or end (`dst`) at the ids."""
    far = "dst" if end == "src" else "src"
    return edges.filter(F.col("type") == kind).select(F.col(end).alias("id"), F.col(far).alias("other")).join(ids, "id", "left_semi").distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """(path): distinct paths of 1 to `hops` edges from the starts, without a repeated node."""
    ends = undirected(edges).distinct()
    now = starts.select(F.array("id").alias("path"))
    out = None
    for _ in range(hops):
        now = now.withColumn("node", F.element_at("path", -1)).join(ends, "node").filter(~F.array_contains("path", F.col("other"))).select(F.concat("path", F.array("other")).alias("path")).distinct()
        out = now if out is None else out.unionByName(now)
    return out


def prune(nodes: DataFrame, edges: DataFrame, min_degree: int = 1, keep: list[str] = KEPT_LABELS) -> DataFrame:
    """Nodes of at least `min_degree` or with a label to keep; one pass."""
    d = nodes.join(degree(edges).withColumnRenamed("node", "id"), "id", "left")
    return d.filter((F.coalesce("degree", F.lit(0)) >= min_degree) | F.col("label").isin(keep)).drop("degree")


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: dangling edges, missing references, bad MEMBER_OF and bad PART_OF edges."""
    s = nodes.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    d = nodes.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    e = edges.join(s, "src", "left").join(d, "dst", "left")
    ok = F.col("ls").isNotNull() & F.col("ld").isNotNull()
    member = (F.col("type") == "MEMBER_OF") & ok & ~(F.col("ls").isin("ENTITY", "DOMAIN", "COMMUNITY") & (F.col("ld") == "COMMUNITY"))
    part = (F.col("type") == "PART_OF") & ok & (F.col("ls") == "COMMUNITY") & (F.col("ld") != "COMMUNITY")
    miss = F.col("ls").isNull().cast("int") + F.col("ld").isNull().cast("int")
    return e.agg(F.count_if(~ok).alias("dangling"), F.coalesce(F.sum(miss), F.lit(0)).alias("missing"), F.count_if(member).alias("bad_member"), F.count_if(part).alias("bad_part"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of rounds over undirected weighted pairs (a, b, weight)."""
    both = pairs_both(edges)
    out = both.join(both.groupBy("node").agg(F.sum("weight").alias("total")), "node").select("node", "other", (F.col("weight") / F.col("total")).alias("p"))
    out = written(out, "pagerank")
    nodes = out.select("node").distinct()
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        flow = out.join(rank, "node").groupBy(F.col("other").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("x"))
        rank = nodes.join(flow, "node", "left").select("node", ((1 - damping) / n + damping * F.coalesce("x", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            rank = written(rank, "rank")
    return rank


def betweenness(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, rank): betweenness from the given sources, weights as distances; for graphs of bounded size, whose pairs go to all tasks."""
    near: dict = {}
    for r in pairs.select("a", "b", "weight").collect():
        near.setdefault(r["a"], []).append((r["b"], r["weight"]))
        near.setdefault(r["b"], []).append((r["a"], r["weight"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = dict.fromkeys(near, 0.0)
        for batch in batches:
            for s in batch["node"]:
                dist, paths, before, done, heap = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, 0, s)]
                seen, order = set(), 0
                while heap:
                    d, _, v = heapq.heappop(heap)
                    if v in seen:
                        continue
                    seen.add(v)
                    done.append(v)
                    for w, x in near[v]:
                        new = d + x
                        if w not in dist or new < dist[w] - 1e-12:
                            dist[w], paths[w], before[w] = new, paths[v], [v]
                            order += 1
                            heapq.heappush(heap, (new, order, w))
                        elif w not in seen and abs(new - dist[w]) <= 1e-12:
                            paths[w] += paths[v]
                            before[w].append(v)
                part = dict.fromkeys(done, 0.0)
                for w in reversed(done):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        score[w] += part[w] / 2
        yield pd.DataFrame({"node": list(score), "rank": list(score.values())})

    kind = pairs.schema["a"].dataType.simpleString()
    return sources.select("node").mapInPandas(run, f"node {kind}, rank double").groupBy("node").agg(F.sum("rank").alias("rank"))


def importance(pairs: DataFrame, exact: int = 250, sampled: int = 1000, k: int = 50) -> DataFrame:
    """(node, rank): betweenness of small graphs, from `k` sources of middle ones, PageRank of others."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    n = nodes.count()
    if n <= exact:
        return betweenness(pairs, nodes)
    if n <= sampled:
        return betweenness(pairs, nodes.orderBy(F.xxhash64("node"), "node").limit(k))
    return pagerank(pairs)


def pairs_both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of both sides with the same key whose half-open intervals (ls, le) and (rs, re) overlap.

    Each interval goes to its bins of `width`; a pair is taken from the first bin both have.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width))).alias("bin")
    a, b = left.select("*", bins("ls", "le")), right.select("*", bins("rs", "re"))
    first = F.greatest(F.floor(F.col("ls") / width), F.floor(F.col("rs") / width))
    return a.join(b, [key, "bin"]).filter((F.col("rs") < F.col("le")) & (F.col("re") > F.col("ls")) & (F.col("bin") == first)).drop("bin")


def last_before(rows: DataFrame, key: str, order: list, mark: Column, value: Column, name: str) -> DataFrame:
    """The rows with `name`: the last `value` of a marked row at or before each row of its key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(F.when(mark, value), ignorenulls=True).over(w))


def contains_edges(mentions: DataFrame) -> DataFrame:
    """CONTAINS edges (edge_id, src, dst) from (doc, part, art): document to part and article, part to article."""
    parts = [mentions.select(F.concat(F.lit("doc:"), "doc").alias("src"), F.concat(F.lit("part:"), "part").alias("dst")), mentions.select(F.concat(F.lit("doc:"), "doc").alias("src"), F.concat(F.lit("art:"), "art").alias("dst")), mentions.select(F.concat(F.lit("part:"), "part").alias("src"), F.concat(F.lit("art:"), "art").alias("dst"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).dropna().distinct()
    return every.withColumn("edge_id", F.substring(F.sha2(F.concat_ws("||", "src", F.lit("CONTAINS"), "dst"), 256), 1, 16))


def bridges(members: DataFrame, score: DataFrame, top: int = 12) -> DataFrame:
    """The MEMBER_OF edges (node, comm) with a flag and score for the `top` most central nodes."""
    best = score.orderBy(F.desc("rank"), "node").limit(top).withColumn("is_bridge", F.lit(True))
    return members.join(best, "node", "left").select("node", "comm", F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"), F.coalesce("rank", F.lit(0.0)).alias("bridge_score"))


RETRIEVAL_TYPES = sorted({*rules.RELATIONS, "CO_OCCURS_WITH", "MEMBER_OF"})
