"""Rule relations between the canonical forms of a sentence, and ingestion of extracted relations."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.functions import rules
from kestrel.functions import text as T
from kestrel.operators.scratch import written

REL = "struct<head:string,relation:string,tail:string,confidence:double>"
# What statutes, exclusions and obligations look like.
STATUTE = r"\b(act|acts|statute|regulation|rule|rules|code|law|laws|directive|byelaw|bye-law)\b|^(section|sec|s|article|clause|chapter|part|schedule|regulation|rule)\s+\d+"
EXCLUSION = r"\b(exclusion|exclusions|exception|exceptions|excluded|not covered|shall not apply)\b"
OBLIGATION = r"\b(liability|liable|obligation|obligations|duty|indemnif(y|ies|ication))\b"


def _rel(when: Column, head: Column | str, name: str, tail: Column | str, confidence: float) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(lit(head).alias("head"), F.lit(name).alias("relation"), lit(tail).alias("tail"), F.lit(confidence).alias("confidence")))


def constitution(sentences: DataFrame) -> DataFrame:
    """Relations of (sid, text, canons): safeguards of article 3, amended schedules, shields against article 13."""
    low = F.lower(F.coalesce("text", F.lit("")))
    arts = F.array_sort(F.filter("canons", lambda c: c.startswith("article ")))
    spoken = low.contains("article 3") | F.col("text").rlike(r"(?m)^\s*3\s*[.\-\x{2013}\x{2014}]{1,2}\s+")
    head = F.when(F.array_contains(arts, "article 3"), F.lit("article 3")).otherwise(F.coalesce(F.get(arts, F.lit(0)), F.when(spoken, F.lit("article 3"))))
    has = head.isNotNull()
    views = low.contains("legislature") & (low.contains("views") | low.rlike(r"express(?:ing)?\s+its\s+views") | low.rlike(r"\b(refer|referred|referring)\b"))
    body = F.when(low.contains("affected"), F.lit("affected state legislature")).otherwise(F.lit("state legislature"))
    shield = (low.rlike(r"shall\s+not\s+be\s+deemed\s+to\s+be\s+void") | low.contains("shall not be void")) & low.contains("article 13")
    found = [
        _rel(has & low.contains("recommendation") & low.contains("president"), head, "REQUIRES_RECOMMENDATION_FROM", "president", 0.92),
        _rel(has & views, head, "REQUIRES_CONSULTATION_WITH", body, 0.88),
        _rel(has & views, head, "CONSIDERS_VIEWS_OF", body, 0.82),
        _rel(has & low.contains("first schedule"), head, "AMENDS", "first schedule", 0.84),
        _rel(has & low.contains("fourth schedule"), head, "AMENDS", "fourth schedule", 0.84),
    ]
    for a in ("article 31a", "article 31b", "article 31c"):
        here = shield & F.array_contains(arts, a)
        found += [_rel(here, a, "OVERRIDES", "article 13", 0.9), _rel(here, a, "SAVES_LAWS_FROM_INVALIDATION", "article 13", 0.88)]
    return sentences.filter(F.size("canons") > 0).select("sid", F.explode(F.array_compact(F.array(*found))).alias("r")).select("sid", "r.*")


def finance(sentences: DataFrame) -> DataFrame:
    """Relations of (sid, text, canons in sentence order): override, subjection, compliance, recovery."""
    low = F.lower(F.coalesce("text", F.lit("")))
    canons = F.array_distinct(F.filter("canons", lambda c: c != ""))
    s = sentences.withColumn("canons", canons).filter(F.size("canons") > 1)
    first = lambda p: F.get(F.filter("canons", lambda c: c.rlike(p)), F.lit(0))
    one, two = F.get("canons", F.lit(0)), F.get("canons", F.lit(1))
    st, ex, ob = first(STATUTE), first(EXCLUSION), first(OBLIGATION)
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    over = rules.any_of(low, ["notwithstanding", "override", "prevail"])
    subj = rules.any_of(low, ["subject to", "in accordance with", "pursuant to", "as per"])
    comp = rules.any_of(low, ["comply", "compliance"])
    rec = rules.any_of(low, ["recovery", "reimburse", "recourse", "indemnif"]) | low.rlike(r"\brecover\b")
    insurer, insured, third = first("insurer|insurance"), first("insured"), first("third party|third-party")
    other = F.when(one == st, two).otherwise(one)
    a, b = differ(st, ex), differ(st, ob)
    back, owes = differ(insurer, insured), differ(insured, third)
    found = [
        _rel(over & a, st, "OVERRIDES", ex, 0.82),
        _rel(over & a, st, "NOTWITHSTANDING", ex, 0.78),
        _rel(over & ~a & b, st, "OVERRIDES", ob, 0.78),
        _rel(over & ~a & ~b, one, "NOTWITHSTANDING", two, 0.7),
        _rel(subj & b, ob, "SUBJECT_TO", st, 0.76),
        _rel(subj & ~b & a, ex, "SUBJECT_TO", st, 0.72),
        _rel(subj & ~b & ~a & st.isNotNull() & differ(other, st), other, "SUBJECT_TO", st, 0.68),
        _rel(comp & b, ob, "COMPLIES_WITH", st, 0.72),
        _rel(comp & ~b, one, "COMPLIES_WITH", two, 0.62),
        _rel(rec & back, insurer, "HAS_RIGHT_OF_RECOVERY", insured, 0.8),
        _rel(rec & back, insurer, "RECOVERS_FROM", insured, 0.76),
        _rel(rec & ~back & owes, insured, "LIABLE_FOR", third, 0.68),
        _rel(rec & ~back & ~owes, one, "RECOVERS_FROM", two, 0.62),
    ]
    return s.select("sid", F.explode(F.array_compact(F.array(*found))).alias("r")).select("sid", "r.*")


def clean_relations(rows: DataFrame, allowed: list[str] = rules.RELATIONS, least: float = 0.35) -> DataFrame:
    """Relations of enough confidence with two ends of their sentence's entities; unknown labels become RELATED_TO."""
    label = rules.relation_label(F.col("relation"))
    known = rows.withColumn("relation", label).filter(F.col("relation").isNotNull() & (F.col("confidence") >= least) & (F.col("head") != F.col("tail")))
    ends = F.array_contains("canons", F.col("head")) & F.array_contains("canons", F.col("tail"))
    return known.filter(ends).withColumn("relation", F.when(F.col("relation").isin(allowed), F.col("relation")).otherwise("RELATED_TO"))


def pieces(n: int, cutoff: float) -> tuple[int, list[tuple[int, int]]]:
    """(most unmatched characters, pieces as (start, end)) of a key of n characters: one piece more, so that one stands whole in a close name."""
    far = int((1 - cutoff) * (n + int(n * (2 - cutoff) / cutoff + 1e-9)) + 1e-9)
    at = [n * k // (far + 1) for k in range(far + 2)]
    return far, list(zip(at, at[1:]))


def key_pieces(key: str, cutoff: float) -> list[str]:
    return [f"{len(key)} {a} {key[a:b]}" for a, b in pieces(len(key), cutoff)[1]]


def name_pieces(name: str, cutoff: float) -> list[str]:
    """Pieces that a key within the cutoff could share with a name, for each length of key and shift."""
    n, out = len(name), set()
    for size in range(1, int(n * (2 - cutoff) / cutoff + 1e-9) + 1):
        if 2 * min(n, size) + 1e-9 >= cutoff * (n + size):
            far, parts = pieces(size, cutoff)
            for a, b in parts:
                out.update(f"{size} {a} {name[at : at + b - a]}" for at in range(max(0, a - far), min(n - b + a, a + far) + 1))
    return sorted(out)


def close_ratio(name: str, key: str, cutoff: float) -> float | None:
    """The ratio of difflib where it reaches the cutoff."""
    m = difflib.SequenceMatcher(None, key, name)
    if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and (ratio := m.ratio()) >= cutoff:
        return ratio
    return None


def match_ends(names: DataFrame, catalog: DataFrame, cutoff: float = 0.92) -> DataFrame:
    """(name, canonical, how): exact normalised canonical or alias, else the closest of them by difflib's ratio, else a new node.

    Reads (canonical) or (canonical, aliases). A key of several entries stands for the one whose canonical it is, else the least.
    Unmatched characters of a close pair are few, so one of that many pieces and one more of the key stands whole in the
    name, shifted by no more: the candidates by pieces are all pairs within the cutoff.
    """
    n = names.select(T.normalize_surface(F.col("name")).alias("name")).distinct()
    keys = catalog.select("canonical", T.normalize_surface(F.col("canonical")).alias("key"), F.lit(0).alias("alias"))
    if "aliases" in catalog.columns:
        keys = keys.unionByName(catalog.select("canonical", F.explode("aliases").alias("key")).select("canonical", T.normalize_surface(F.col("key")).alias("key"), F.lit(1).alias("alias")))
    c = keys.filter("canonical IS NOT NULL AND key <> ''").groupBy("key").agg(F.min_by("canonical", F.struct("alias", "canonical")).alias("canonical"))
    exact = n.join(c.withColumnRenamed("key", "name"), "name", "left")
    hit = exact.filter("canonical IS NOT NULL").withColumn("how", F.lit("exact"))
    rest = exact.filter("canonical IS NULL").select("name")
    of_key = F.udf(lambda x: key_pieces(x, cutoff), "array<string>")
    of_name = F.udf(lambda x: name_pieces(x, cutoff), "array<string>")
    ratio = F.udf(lambda x, y: close_ratio(x, y, cutoff), "double")
    near = rest.select("name", F.explode(of_name("name")).alias("piece")).join(c.select("key", "canonical", F.explode(of_key("key")).alias("piece")), "piece")
    near = near.select("name", "key", "canonical").distinct().withColumn("ratio", ratio("name", "key")).filter("ratio IS NOT NULL")
    best = near.groupBy("name").agg(F.max_by("canonical", F.struct("ratio", "key")).alias("canonical")).withColumn("how", F.lit("close"))
    new = rest.join(best, "name", "left_anti").select("name", F.col("name").alias("canonical"), F.lit("new").alias("how"))
    return hit.select("name", "canonical", "how").unionByName(best.select("name", "canonical", "how")).unionByName(new)


def close_bags(bags: DataFrame, loose: float = 0.99, strict: float = 0.985, longest: int = 32) -> DataFrame:
    """(lo, hi) of the pairs of (ord, label, words, strict) with a label whose word counts have a cosine of the
    threshold, that of strict names where either is one; words are sorted and no two bags of a label are equal.

    Unequal bags of at most `longest` words without repeats stay below sqrt(32 / 33) < 0.985, so that a pair has a longer
    bag or one with a repeat. Of that one the rarest words are taken until the others are shorter than the cosine
    allows: the other bag of a close pair has one of them. The candidates so found are all close pairs.
    """
    count = lambda words, x: F.size(F.filter(words, lambda y: y == x)).cast("double")
    dot = lambda a, b: F.aggregate(a, F.lit(0.0), lambda n, x: n + count(b, x))
    some = bags.filter((F.size("words") > longest) | (F.size(F.array_distinct("words")) < F.size("words")))
    words = lambda df: df.select("ord", "label", F.explode(F.array_distinct("words")).alias("w"))
    often = words(bags).groupBy("label", "w").agg(F.count("*").alias("df"))
    own = some.select("ord", "label", "words", F.explode(F.array_distinct("words")).alias("w")).withColumn("sq", count(F.col("words"), F.col("w")) ** 2)
    own = own.drop("words").join(often, ["label", "w"])
    w = W.partitionBy("ord").orderBy("df", "w")
    rest = F.sum("sq").over(W.partitionBy("ord")) - F.sum("sq").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("sq")
    first = own.withColumn("rest", rest).withColumn("all", F.sum("sq").over(W.partitionBy("ord"))).filter(F.col("rest") >= strict**2 * F.col("all") - 1e-9)
    pair = first.select(F.col("ord").alias("x"), "label", "w").join(words(bags).withColumnRenamed("ord", "y"), ["label", "w"]).filter("x <> y")
    pair = pair.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()
    of = lambda c, n: bags.select(F.col("ord").alias(c), F.col("words").alias(f"w{n}"), F.col("strict").alias(f"s{n}"))
    j = pair.join(of("lo", 1), "lo").join(of("hi", 2), "hi")
    cosine = dot(F.col("w1"), F.col("w2")) / F.sqrt(dot(F.col("w1"), F.col("w1")) * dot(F.col("w2"), F.col("w2")))
    return j.filter(cosine >= F.when(F.col("s1") | F.col("s2"), strict).otherwise(loose) - 1e-12).select("lo", "hi")


def first_bases(links: DataFrame) -> DataFrame:
    """(ord, base) of the rows that a base before them takes in, in order: a row is a base unless linked to an earlier one."""
    links = written(links, "links")
    open_, bases = links.select(F.col("lo").alias("ord")).union(links.select("hi")).distinct(), None
    while True:
        live = links.join(open_.withColumnRenamed("ord", "lo"), "lo").join(open_.withColumnRenamed("ord", "hi"), "hi")
        new = written(open_.join(live.select(F.col("hi").alias("ord")), "ord", "left_anti"), "bases")
        if new.isEmpty():
            break
        bases = new if bases is None else bases.unionByName(new)
        taken = links.join(new.withColumnRenamed("ord", "lo"), "lo").select(F.col("hi").alias("ord"))
        open_ = written(open_.join(new, "ord", "left_anti").join(taken, "ord", "left_anti"), "open")
    if bases is None:
        return links.select(F.col("hi").alias("ord"), F.col("lo").alias("base"))
    near = links.join(bases.withColumnRenamed("ord", "lo"), "lo").groupBy(F.col("hi").alias("ord")).agg(F.min("lo").alias("base"))
    return near.join(bases, "ord", "left_anti")


def merge_catalog(catalog: DataFrame, loose: float = 0.99, strict: float = 0.985) -> DataFrame:
    """(label, canonical, ord, aliases): entries (ord, canonical, label) in order, each merged into the first base of its
    label with word counts of a cosine of `loose`, or `strict` if either has a digit or at most five characters.

    Not transitive: an entry joins a base, never another joined entry. Legal references merge only if equal. Orders are
    distinct; names without words merge with none; entries without a name are left out.
    """
    norm = T.normalize_surface(F.col("canonical"))
    legal = T.is_legal_id(F.col("canonical"))
    words = F.when(legal, F.array(norm)).otherwise(F.array_sort(F.split(norm, " ")))
    key = F.when(norm == "", F.array(F.concat(F.lit(" "), F.col("ord").cast("string")))).otherwise(words)
    strictly = norm.rlike("[0-9]") | (F.length(norm) <= 5)
    rows = catalog.filter("canonical IS NOT NULL").select("ord", "canonical", "label", key.alias("words"), (legal | (norm == "")).alias("alone"), strictly.alias("strict"))
    same = written(rows.groupBy("label", "words", "alone", "strict").agg(F.min("ord").alias("ord"), F.min_by("canonical", "ord").alias("canonical"), F.collect_set("canonical").alias("names")), "names")
    taken = first_bases(close_bags(same.filter("NOT alone").select("ord", "label", "words", "strict"), loose, strict))
    to = same.join(taken, "ord", "left").select("label", "canonical", "ord", "names", F.coalesce("base", "ord").alias("base"))
    return to.groupBy("label", "base").agg(F.min_by("canonical", "ord").alias("canonical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("aliases")).withColumnRenamed("base", "ord")


def evidence_sentence(relations: DataFrame, sentences: DataFrame) -> DataFrame:
    """The relations with sent_id: the first sentence of the document that holds the evidence, else its first sentence."""
    s = sentences.select("doc_id", "idx", "sent_id", F.lower("text").alias("low"))
    j = relations.join(s, "doc_id", "left")
    hit = F.when(F.col("low").contains(F.lower("evidence")) & (F.col("evidence") != ""), F.struct("idx", "sent_id"))
    keys = [F.col(c) for c in relations.columns]
    return j.groupBy(*keys).agg(F.coalesce(F.min(hit), F.min(F.when(F.col("sent_id").isNotNull(), F.struct("idx", "sent_id"))))["sent_id"].alias("sent_id"))
