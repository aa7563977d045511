"""Communities: measures of a given partition, detection by local moving, hierarchy, materialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.operators.graph import pairs_both
from kestrel.operators.scratch import written


def collapse(pairs: DataFrame, partition: DataFrame) -> DataFrame:
    """(ca, cb, weight): weights between (ca < cb) and inside (ca = cb) communities, from (a, b, weight) and (node, comm)."""
    pa = partition.select(F.col("node").alias("a"), F.col("comm").alias("ca"))
    pb = partition.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
    j = pairs.join(pa, "a").join(pb, "b")
    return j.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.sum("weight").alias("weight"))


def coherence(collapsed: DataFrame) -> DataFrame:
    """(comm, internal, external, coherence): internal / (internal + external), null without weight."""
    inside = collapsed.filter("ca = cb").select(F.col("ca").alias("comm"), F.col("weight").alias("i"), F.lit(0.0).alias("e"))
    outside = collapsed.filter("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("comm"), F.lit(0.0).alias("i"), F.col("weight").alias("e"))
    t = inside.unionByName(outside).groupBy("comm").agg(F.sum("i").alias("internal"), F.sum("e").alias("external"))
    return t.withColumn("coherence", F.try_divide("internal", F.col("internal") + F.col("external")))


def modularity(pairs: DataFrame, partition: DataFrame, penalty: float = 0.08) -> DataFrame:
    """One row: q, communities, nodes, and score = q - penalty * communities / nodes."""
    c = coherence(collapse(pairs, partition)).select("internal", (2 * F.col("internal") + F.col("external")).alias("total"))
    m = c.agg((F.sum("total") / 2).alias("m"), F.sum("internal").alias("inside"), F.sum(F.col("total") ** 2).alias("squares"))
    n = partition.agg(F.countDistinct("comm").alias("communities"), F.count("*").alias("nodes"))
    q = F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") ** 2)
    return m.crossJoin(n).select(q.alias("q"), "communities", "nodes", (q - penalty * F.col("communities") / F.col("nodes")).alias("score"))  # one row each


def detect(pairs: DataFrame, rounds: int = 24) -> DataFrame:
    """(node, comm) by synchronous weighted local moving; in each round half the nodes may move, by a hash.

    A node moves to the community with the greatest gain of weight over its expectation;
    ties go to the least community. It ends when no node gains, or after `rounds`.
    Ids are strings or numbers; a community is named by a node.
    """
    both = written(pairs_both(pairs), "both")
    deg = written(both.groupBy("node").agg(F.sum("weight").alias("k")), "deg")
    total = deg.agg(F.sum("k")).first()[0] or 1.0
    part = deg.select("node", F.col("node").alias("comm"))
    for r in range(rounds):
        size = part.join(deg, "node").groupBy("comm").agg(F.sum("k").alias("tot"))
        own = part.withColumnRenamed("comm", "own")
        links = both.filter("other <> node").join(part.select(F.col("node").alias("other"), "comm"), "other").select("node", "comm", "weight")
        near = links.unionByName(part.withColumn("weight", F.lit(0.0))).groupBy("node", "comm").agg(F.sum("weight").alias("w"))
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("comm") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        scored = near.join(size, "comm").join(deg, "node").join(own, "node").withColumn("gain", F.round(gain, 9))
        best = scored.withColumn("rank", F.row_number().over(W.partitionBy("node").orderBy(F.desc("gain"), F.desc(F.col("comm") == F.col("own")), "comm"))).filter("rank = 1")
        may = F.pmod(F.xxhash64(F.col("node"), F.lit(r)), F.lit(2)) == 0
        moved = written(best.select("node", F.when(may, F.col("comm")).otherwise(F.col("own")).alias("comm"), (F.col("comm") != F.col("own")).alias("gains")), "part")
        part = moved.select("node", "comm")
        if moved.filter("gains").isEmpty():
            break
    return part


def multilevel(pairs: DataFrame, levels: int = 8) -> DataFrame:
    """(node, comm) by repeated detection on the graph of communities, whose inner weights stay as loops."""
    out, now = None, pairs
    for _ in range(levels):
        part = detect(now)
        out = part if out is None else written(out.join(part.select(F.col("node").alias("comm"), F.col("comm").alias("to")), "comm").select("node", F.col("to").alias("comm")), "merged")
        if part.filter("node <> comm").isEmpty():
            break
        now = written(collapse(now, part).select(F.col("ca").alias("a"), F.col("cb").alias("b"), "weight"), "level")
    return out


def choose(pairs: DataFrame, penalty: float = 0.08) -> DataFrame:
    """The better by score of one level of local moving and of all levels; the first of equal ones."""
    found = [detect(pairs), multilevel(pairs)]
    scores = [modularity(pairs, p, penalty).first()["score"] or 0.0 for p in found]
    return found[scores.index(max(scores))]


def reassign_small(pairs: DataFrame, partition: DataFrame, min_size: int = 5) -> DataFrame:
    """Nodes of small communities go to the community of their heaviest neighbour in another one, all at once."""
    small = partition.groupBy("comm").agg(F.count("*").alias("n")).filter(F.col("n") < min_size).select("comm")
    moving = partition.join(small, "comm", "left_semi")
    near = pairs_both(pairs).join(moving, "node").join(partition.select(F.col("node").alias("other"), F.col("comm").alias("to")), "other").filter("to <> comm")
    best = near.groupBy("node").agg(F.max_by("to", F.struct(F.col("weight"), F.col("to"))).alias("to"))
    return partition.join(best, "node", "left").select("node", F.coalesce("to", "comm").alias("comm"))


def hierarchy(pairs: DataFrame, max_levels: int = 4, min_size: int = 1, stop_nodes: int = 4, stop_ratio: float = 0.95) -> DataFrame:
    """(level, node, comm): detection on the graph, then on the graph of its communities, until that no longer shrinks."""
    out, now = None, pairs
    for level in range(max_levels):
        part = detect(now)
        if min_size > 1:
            part = written(reassign_small(now, part, min_size), "reassigned")
        s = part.agg(F.count("*").alias("n"), F.countDistinct("comm").alias("c")).first()
        here = part.select(F.lit(level).alias("level"), "node", "comm")
        out = here if out is None else out.unionByName(here)
        if s["n"] < stop_nodes or s["c"] <= 1 or s["c"] >= stop_ratio * s["n"]:
            break
        now = written(collapse(now, part).filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "weight"), "level")
        if now.isEmpty():
            break
    return out


def materialise(partition: DataFrame, names: DataFrame, stats: DataFrame, min_members: int = 3, sample: int = 6, cut: int = 220) -> DataFrame:
    """COMMUNITY nodes (id, comm, members_count, coherence, summary, sample_entities) of communities of enough members."""
    named = partition.join(names, "node").select("comm", "canonical")
    first = named.withColumn("r", F.row_number().over(W.partitionBy("comm").orderBy("canonical"))).filter(F.col("r") <= sample)  # cut before it is collected
    rows = named.groupBy("comm").agg(F.count("*").alias("members_count")).join(first.groupBy("comm").agg(F.array_sort(F.collect_list("canonical")).alias("sample_entities")), "comm")
    kept = rows.filter(F.col("members_count") >= min_members).join(stats.select("comm", "coherence"), "comm", "left")
    return kept.select(F.concat(F.lit("comm_l0:"), F.col("comm").cast("string")).alias("id"), "comm", "members_count", "coherence", F.substring(F.array_join("sample_entities", ", "), 1, cut).alias("summary"), "sample_entities")
