"""Operators that need match offsets or order: mention spans, greedy near-duplicate removal, NFKC."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from kestrel.functions import text as T


def greedy_keep(texts: list[str], threshold: float) -> list[int]:
    """Places of the texts whose token set overlaps no kept one by `threshold` or more (Jaccard), in order.

    Texts without tokens are kept and compared with none. A kept set is only compared if it
    shares a token and its size allows the threshold.
    """
    kept, sets, by_token = [], [], {}
    for i, t in enumerate(texts):
        s = set((t or "").split())
        if s:
            near = {k for x in s for k in by_token.get(x, ())}
            if any(min(len(s), len(sets[k])) >= threshold * max(len(s), len(sets[k])) and len(s & sets[k]) >= threshold * len(s | sets[k]) for k in near):
                continue
            for x in s:
                by_token.setdefault(x, []).append(len(sets))
            sets.append(s)
        kept.append(i)
    return kept


def dedup_in_order(docs: DataFrame, parts: Column, threshold: float = 0.9) -> DataFrame:
    """(doc_id, idx, text): the array `parts` of each text without near repeats, first ones kept."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def keep(norm: pd.Series) -> pd.Series:
        return norm.map(lambda xs: greedy_keep(list(xs), threshold))

    rows = docs.select("doc_id", parts.alias("p")).withColumn("k", keep(F.transform("p", T.normalize_text)))
    return rows.select("doc_id", "p", F.explode("k").alias("idx")).select("doc_id", "idx", F.element_at("p", F.col("idx") + 1).alias("text"))


def mention_spans(pairs: DataFrame, per_surface: int = 12) -> DataFrame:
    """(doc_id, surface, start_char, end_char) from (doc_id, text, surface, patterns): at most `per_surface` distinct spans each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text, surface, patterns in zip(b["doc_id"], b["text"], b["surface"], b["patterns"]):
                seen: list[tuple[int, int]] = []
                for p in patterns:
                    for m in re.finditer(p, text or ""):
                        if len(seen) >= per_surface:
                            break
                        if m.span() not in seen:
                            seen.append(m.span())
                out += [(doc, surface, *s) for s in seen]
            yield pd.DataFrame(out, columns=["doc_id", "surface", "start_char", "end_char"])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.select("doc_id", "text", "surface", "patterns").mapInPandas(run, f"doc_id {kind}, surface string, start_char int, end_char int")


def seed_mentions(docs: DataFrame, seeds: DataFrame, per_surface: int = 12) -> DataFrame:
    """Spans of every seed surface in the texts that hold its longest word: a join on words before any pattern runs."""
    words = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(T.normalize_text(F.col("text"))))).alias("w"))
    keyed = seeds.select("surface").distinct().withColumn("w", F.expr("get(array_sort(split(trim(regexp_replace(lower(surface), '[^a-z0-9]+', ' ')), ' '), (a, b) -> length(b) - length(a)), 0)"))
    hits = words.join(keyed, "w").select("doc_id", "surface").distinct()
    patterns = F.transform(T.surface_variants(F.col("surface")), T.surface_pattern)
    return mention_spans(hits.join(docs.select("doc_id", "text"), "doc_id").withColumn("patterns", patterns), per_surface)


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def sanitize_evidence(c: Column) -> Column:
    """NFKC, runs of three or more of a letter to one, single spaces, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(nfkc(c), r"([A-Za-z])\1{2,}", "$1"), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))
