"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at `DISTANCE` or fewer differing bits. Bits that agree or
disagree together are grouped into partitions of unequal worth; dynamic programming gives
each partition an own radius (-1: not probed) whose sum is DISTANCE - partitions + 1 from
candidate counts estimated on a sample. A fingerprint probes the balls of these radii;
every link within DISTANCE shares such a bucket, and candidates are verified by their
distance. Buckets of more than `BUCKET` fingerprints are not paired: their members emit
the 65 points within one bit of them, and two fingerprints share such a point exactly if
they differ in at most two bits, so a point links all its (at most 65) fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common
from kestrel.llm.components import components

DISTANCE = 2
BUCKET = 100
#: Partitions and radii are fitted on about this many fingerprints; they never change the result.
SAMPLE = 20000
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text; zero for a null text or one without words."""
    w = (text or "").encode("utf-8", "replace").lower().split()  # bytes: lowers A-Z only, splits at x20 and x09-x0D
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else map(b" ".join, zip(w, w[1:], w[2:]))
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, max(1, len(w) - 2))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and fp, the fingerprint as a signed long."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            fp = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], names=[*keep, "fp"])

    return docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """64 bit positions in `parts` groups: each group grows by the bit that correlates most with it."""
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        scale = np.sqrt((centred**2).sum(axis=0)) + 1e-9
        corr = np.abs(centred.T @ centred) / np.outer(scale, scale)
    else:
        corr = np.zeros((64, 64))
    left, out = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        out.append(sorted(group))
    return out


def allocate(values: list[np.ndarray], sizes: list[int], scale: float, distance: int) -> tuple[float, list[int]]:
    """Radii with sum distance - parts + 1 and the least estimated cost (candidates and probes for one fingerprint)."""
    n, costs = max(1, len(values[0])), []
    for v, bits in zip(values, sizes):
        uniq, counts = np.unique(v, return_counts=True)
        exact = float((counts.astype(float) ** 2).sum() - n) / n * scale
        near, probes = exact, 1.0
        own = {-1: 0.0, 0: exact + probes}
        look = dict(zip(uniq.tolist(), counts.tolist()))
        some = list(zip(uniq.tolist(), counts.tolist()))[:: max(1, len(uniq) // 500)]
        weight = sum(c for _, c in some) or 1
        for r in range(1, distance + 1):
            flips = [sum(1 << b for b in x) for x in combinations(range(bits), r)]
            probes += len(flips)
            near += sum(c * look.get(u ^ f, 0) for u, c in some for f in flips) / weight * scale if len(flips) <= 64 else np.inf
            own[r] = near + probes
        costs.append(own)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, radii) in best.items():
            for r, c in own.items():
                at = used + r
                if cost + c < new.get(at, (np.inf,))[0]:
                    new[at] = cost + c, [*radii, r]
        best = new
    return best.get(distance - len(values) + 1, (np.inf, []))


def plan(fps: DataFrame, distance: int = DISTANCE, sample: int = SAMPLE) -> list[tuple[int, int, list[int]]]:
    """[(radius, mask, bit positions)] for each probed partition."""
    total = fps.count()
    share = min(1.0, sample / max(1, total))
    rows = fps.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("fp").limit(2 * sample)
    fp = np.array([r["fp"] for r in rows.collect()], np.int64).view(np.uint64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
    best = None
    for parts in range(1, distance + 2):
        groups = group_bits(bits, parts)
        packed = [(bits[:, g].astype(np.int64) << np.arange(len(g))).sum(axis=1) if len(g) < 63 else fp.view(np.int64) for g in groups]
        cost, radii = allocate(packed, [len(g) for g in groups], total / max(1, len(fp)), distance)
        if radii and (best is None or cost < best[0]):
            best = cost, [(r, sum(1 << b for b in g), g) for r, g in zip(radii, groups) if r >= 0]
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(a, b) between distinct fingerprints: enough of the links within `distance` (1 or 2) for their components.

    Of ordinary buckets it has every link; of a large bucket each point's links to its least member.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2: the points of large buckets link at most two bits")
    parts = plan(fps, distance)
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, (_, m, _) in enumerate(parts)])).alias("k")).select("k.part", "k.value", "fp")
    counts = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    flips = []
    for i, (r, m, g) in enumerate(parts):
        for k in range(r + 1):
            flips += [(i, _signed(m), _signed(sum(1 << b for b in x))) for x in combinations(g, k)]
    literal = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).bitwiseXOR(F.lit(f)).alias("value")) for i, m, f in flips])
    probes = fps.select(F.col("fp").alias("probe"), F.explode(literal).alias("k")).select("k.part", "k.value", "probe")
    met = probes.join(counts, ["part", "value"])
    same = all(r == 0 for r, _, _ in parts)  # probes are the members themselves
    if same:
        met = met.filter("n > 1")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = (
        met.filter(F.col("n") <= bucket)
        .join(index.join(counts.filter((F.col("n") > 1) & (F.col("n") <= bucket)).select("part", "value") if same else counts.filter(F.col("n") <= bucket).select("part", "value"), ["part", "value"]), ["part", "value"])
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
        .filter("a < b")
        .filter(close)
    )
    hot = counts.filter(F.col("n") > bucket).select("part", "value")
    members = index.join(hot, ["part", "value"], "left_semi").select("fp").unionByName(met.filter(F.col("n") > bucket).select(F.col("probe").alias("fp"))).distinct()
    around = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)]))
    points = members.select("fp", F.explode(around).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("all"))
    stars = points.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    if distance == 1:
        stars = stars.filter(close)
    return pairs.unionByName(stars).distinct()


def groups(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root) for all fingerprints that link to another."""
    found = components(links(fps, distance))
    return found.select(F.col("node").alias("fp"), "root")


def _hex(c: str):
    return F.lower(F.lpad(F.hex(F.col(c)), 16, "0"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and link like others. component_id is the
    least doc_id of the component; rows without doc_id take part and get their component's.
    Repeated rows each give a row.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    prints, _ = common.written(fingerprints(docs, ["doc_id"]), "prints")
    distinct, _ = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    found = groups(distinct.select("fp"))
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes, _ = common.written(rooted.join(least, "root").select("fp", "component_id", "n"), "classes")
    return common.join_counted(prints, classes, "fp", "inner").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: that with the least doc_id (one row of it if it repeats)."""
    keep = [*[f"c{i}" for i in range(len(docs.columns))], "doc_id"]
    rows, _ = common.written(fingerprints(common.masked(docs, "doc_id", "text"), keep).withColumn("row", F.monotonically_increasing_id()), "stage3")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    distinct, _ = common.written(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    found = groups(distinct.select("fp"))
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept, _ = common.written(winners, "winners")
    kept = kept.hint("merge")  # as many rows as documents: never broadcast
    return common.unmasked(rows.join(kept, "row", "left_semi"), docs.columns)
