"""Benchmark decontamination by greedy string tiling.

Words of benchmark items get codes; a text is its words' codes. Runs of `MIN_MATCH` shared
words are the seeds that join texts and items. Around the seeds of a pair, tiling repeatedly
marks the longest match whose words are still free on both sides, found by running Karp-Rabin
hashes of falling length, so moved passages count in full. The share of an item's words
under tiles is its coverage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

MIN_MATCH = 5
COVERAGE = 0.8
#: Benchmark items that one pass over the texts holds in memory; more items take more passes.
ITEMS_PER_PASS = 20000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = 20


def fold(word: str) -> str:
    """Lower case, letters and digits only; empty for a word without any."""
    return word if word.isalpha() and word.islower() else "".join(c for c in word.lower() if c.isalnum())


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of n codes, modulo 2^64."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for k in range(n):
        h = h * _BASE + codes[k : len(codes) - n + 1 + k].astype(np.uint64)
    return h


def tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of the tiles. Codes below 1 match nothing.

    Longest first; equal lengths go by place in the item, then in the text.
    """
    free_i, free_t = item > 0, text > 0
    out: list[tuple[int, int, int]] = []
    s = max(min_match, min(_FIRST, len(item)))
    while True:
        found, longest = [], 0
        at: dict[int, list[int]] = {}
        run_i = np.convolve(free_i, np.ones(s, int), "valid") == s if len(item) >= s else np.zeros(0, bool)
        run_t = np.convolve(free_t, np.ones(s, int), "valid") == s if len(text) >= s else np.zeros(0, bool)
        hi, ht = windows(item, s), windows(text, s)
        for i in np.flatnonzero(run_i):
            at.setdefault(int(hi[i]), []).append(int(i))
        known = np.isin(ht, np.fromiter(at, np.uint64, len(at))) & run_t if at and len(ht) else np.zeros(0, bool)
        for t in np.flatnonzero(known):
            for i in at[int(ht[t])]:
                if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                    continue  # part of a match that begins earlier
                n = 0
                while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n >= s:
                    found.append((-n, i, int(t)))
                    longest = max(longest, n)
        if longest > 2 * s:
            s = longest
            continue
        marked = False
        for n, i, t in sorted(found):
            n = -n
            if free_i[i : i + n].all() and free_t[t : t + n].all():
                free_i[i : i + n] = free_t[t : t + n] = False
                out.append((i, t, n))
                marked = True
        if marked and found:
            continue  # what overlapped a tile may still have a free part of this length
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


class Benchmark:
    """Codes and seeds of a block of items."""

    def __init__(self, items: list[tuple], min_match: int = MIN_MATCH):
        self.ids, self.codes, vocab = [], [], {}
        for key, text in items:
            w = [x for x in map(fold, (text or "").split()) if x]
            if w:
                self.ids.append(key)
                self.codes.append(np.array([vocab.setdefault(x, len(vocab) + 1) for x in w], np.int64))
        self.vocab, self.min_match = vocab, min_match
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, codes in enumerate(self.codes):
            n = min(min_match, len(codes))
            own = self.seeds.setdefault(n, {})
            for i, h in enumerate(windows(codes, n).tolist()):
                own.setdefault(h, []).append((k, i))
        self.size = np.array([len(x) for x in self.codes], np.int64)
        self.sorted, self.first, self.place = {}, {}, {}
        for n, own in self.seeds.items():
            keys = np.sort(np.fromiter(own, np.uint64, len(own)))
            listed = [own[x] for x in keys.tolist()]
            self.sorted[n] = keys
            self.first[n] = np.cumsum([0, *map(len, listed)])  # where the places of a seed begin
            self.place[n] = np.array([p for x in listed for p in x], np.int64).reshape(-1, 2)

    def near(self, codes: np.ndarray, coverage: float) -> dict[int, tuple[int, np.ndarray]]:
        """For each item of which shared seeds cover enough words: the length of a seed and the places in the text of its seeds.

        Tiles consist of shared seeds, so that the words under seeds bound the coverage.
        """
        out: dict[int, tuple[int, np.ndarray]] = {}
        known = codes > 0
        for n, look in self.sorted.items():
            if len(codes) < n or not len(look):
                continue
            full = known[: len(codes) - n + 1].copy()
            for k in range(1, n):
                full &= known[k : len(codes) - n + 1 + k]
            at = np.flatnonzero(full)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * _BASE + codes[at + k].astype(np.uint64)
            place = np.minimum(np.searchsorted(look, h), len(look) - 1)
            hit = look[place] == h
            at, place = at[hit], place[hit]
            if not len(at):
                continue
            found = np.unique(place)
            first, size = self.first[n][found], np.diff(self.first[n])[found]
            own = self.place[n][np.repeat(first - np.concatenate([[0], size.cumsum()[:-1]]), size) + np.arange(size.sum())]
            own = own[np.lexsort((own[:, 1], own[:, 0]))]  # (item, place in it) of shared seeds
            new = np.ones(len(own), np.int64) * n
            same = own[1:, 0] == own[:-1, 0]
            new[1:][same] = np.minimum(n, own[1:, 1] - own[:-1, 1])[same]
            covered = np.bincount(own[:, 0], new, len(self.codes))
            for k in np.flatnonzero((covered > 0) & (covered >= coverage * self.size)).tolist():
                if min(self.min_match, len(self.codes[k])) == n:
                    out[k] = n, at[np.isin(h[hit], self.item_seeds(k, n))]
        return out

    def item_seeds(self, k: int, n: int) -> np.ndarray:
        return np.unique(windows(self.codes[k], n))

    def matches(self, codes: np.ndarray, coverage: float = 0.0) -> Iterator[tuple[int, float, int, int]]:
        """(item, coverage, tiles, words under tiles) for each item that shares a seed and may reach the coverage."""
        for k, (n, places) in self.near(codes, coverage).items():
            places = np.unique((places[:, None] + np.arange(n)[None, :]).ravel())
            gaps = np.flatnonzero(np.diff(places) > 1) + 1
            text = np.insert(codes[places], gaps, 0)  # only words under seeds can be under tiles
            item = self.codes[k]
            found = tiles(item, text, n)
            words = sum(n for _, _, n in found)
            yield k, words / len(item), len(found), words


class Codes(dict):
    """Code of a raw word: 0 if no item has it, -1 if it has neither letter nor digit."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        x = fold(word)
        code = self[word] = self.vocab.get(x, 0) if x else -1
        return code


def passes(benchmark: DataFrame, min_match: int, per_pass: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of about `per_pass` items."""
    n = max(1, -(-benchmark.count() // per_pass))
    for b in range(n):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == b).select("item_id", "text").collect()
        yield Benchmark([(r["item_id"], r["text"]) for r in rows], min_match)


def found_in(text: str | None, block: Benchmark, look: Codes, coverage: float) -> list[tuple]:
    """(item_id, coverage, tiles, words) of the items that reach the coverage in a text."""
    if not text:
        return []
    w = text.split()
    codes = np.fromiter(map(look.__getitem__, w), np.int64, len(w))
    return [(block.ids[k], c, n, m) for k, c, n, m in block.matches(codes[codes >= 0], coverage) if c >= coverage]


def scan(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, matched_words for each pair that reaches the coverage.

    Items shorter than `min_match` words must occur whole. Null and empty texts or items match
    nothing; repeated rows give a row each. The benchmark is read in passes of about `per_pass` items.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for block in passes(benchmark, min_match, per_pass):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            look = Codes(block.vocab)
            for batch in common.slices(batches):
                found = [(r, *x) for r, text in enumerate(batch.column(1).to_pylist()) for x in found_in(text, block, look, coverage)]
                if found:
                    r, k, c, n, m = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), pa.array(k), pa.array(c), pa.array(n), pa.array(m)], names=["doc_id", "item_id", "coverage", "n_tiles", "matched_words"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles long, matched_words long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows in which no item reaches the coverage, with all their columns: one map over the texts for each pass."""
    columns = list(docs.columns)
    at = columns.index("text")
    for block in passes(benchmark, min_match, per_pass):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            look = Codes(block.vocab)
            for batch in common.slices(batches):
                yield batch.filter(pa.array([not found_in(t, block, look, coverage) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with each item's coverage.

    Null and empty texts and items match nothing; long texts are read in full; of equal items each gives a row, as does each repeated row.
    """
    return scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item reaches the coverage, null and empty texts and repeated rows among them."""
    return clean(docs, common.table(spark, sf_dir, "benchmark"))
