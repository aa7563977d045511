"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel compares words by their common subsequences of three characters, each weighted by
DECAY to the length it spans, whatever that is, so gaps and inserted characters cost little.
Neighbouring short fragments are also read as one word. Labels exist for whole texts, each a
bag of words. All words that occur in far more toxic than clean texts are positive instances,
words of clean texts negative ones, and negatives that score highest are added and the machine
trained again. The landmarks are the positives of most evidence and frequent negatives. In
their space the machine is linear; written out over the subsequences of the landmarks it is one
table, which scores a new word without its landmarks. A text's score is a logistic function of
its highest word scores and of how many are positive.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

DECAY = 0.7
#: Learning reads at most about so many toxic and clean labelled texts.
TRAIN_TOXIC, TRAIN_CLEAN = 5000, 15000
LANDMARKS, NEGATIVES = 300, 1500
#: Evidence (log-likelihood ratio) that makes a word a positive instance.
EVIDENCE = 8.0
THRESHOLD = 0.7
#: Longer words are scored by windows of this many characters at half their distance.
WINDOW = 24
#: Word scores below this are all alike.
FLOOR = -0.5
#: A text without a positive instance counts as one of so many instances at least, so that an empty one is like other clean ones.
SHORT = 100
#: Tokens of at most so many letters and digits are fragments, which also count joined to their neighbours.
FRAGMENT = 3
_MARKS = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Letters, digits and others have codes below MARK; words stand between the marks MARK and MARK + 1.
_BASE, _OTHER, MARK = 96, 36, 94
_SIZE = _BASE**3


def clean_word(raw: str) -> str:
    """Letters and digits of a lower-cased token."""
    if raw.isalpha():
        return raw
    out = raw.translate(_MARKS)
    return out if not out or out.isalnum() else "".join(c for c in out if c.isalnum())


def tokens(text: str | None) -> set[str]:
    """Distinct lower-cased tokens of a text; fragments in a row also as one word, as are all rows within them that fit a window."""
    listed = (text or "").lower().split()
    found = set(listed)
    short = {x: c for x in found if len(c := clean_word(x)) <= FRAGMENT}
    if short:
        run: list[str] = []
        for x in listed:
            c = short.get(x)
            if c is None:
                if len(run) > 1:
                    joined(run, found)
                run = []
            elif c:
                run.append(c)
        if len(run) > 1:
            joined(run, found)
    return found


def joined(run: list[str], found: set[str]) -> None:
    """Adds the words that a row of fragments makes from each of them on, and the whole row."""
    for i in range(len(run) - 1):
        word = run[i]
        for x in run[i + 1 :]:
            word += x
            if len(word) > WINDOW:
                break
            found.add(word)
    found.add("".join(run))


#: Letters and digits have codes of their own; other characters share the rest by a hash of their code point.
_CODE = (np.arange(1 << 16, dtype=np.uint64) * 2654435761 % (1 << 32) * (MARK - _OTHER) >> 32).astype(np.int32) + _OTHER
_CODE[97:123] = np.arange(26)
_CODE[48:58] = np.arange(26, 36)


def code_matrix(words: list[str], n: int) -> np.ndarray:
    """Codes of words of n characters, a row each."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).reshape(len(words), n)
    out = np.empty((len(words), n + 2), np.int32)
    out[:, 0], out[:, -1] = MARK, MARK + 1
    out[:, 1:-1] = _CODE[(raw ^ raw >> 16) & 0xFFFF]
    return out


@functools.lru_cache(maxsize=64)
def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j < k below n, and the weight of each."""
    at = np.array(list(itertools.combinations(range(n), 3)), np.int32).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


def features(word: str) -> dict[int, float]:
    """Weights of the subsequences of a word, normalised to length one."""
    c = code_matrix([word], len(word))[0]
    at, w = places(len(c))
    out: dict[int, float] = Counter()
    for key, x in zip(((c[at[:, 0]] * _BASE + c[at[:, 1]]) * _BASE + c[at[:, 2]]).tolist(), w.tolist()):
        out[key] += x
    norm = math.sqrt(sum(x * x for x in out.values()))
    return {k: x / norm for k, x in out.items()}


def parts(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def totals(m: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of table times weight over all subsequences of words, a column of codes each."""
    n = len(m)
    out = np.zeros(m.shape[1])
    weight = (DECAY ** np.arange(n + 1)).astype(table.dtype)
    for i in range(n - 2):
        for j in range(i + 1, n - 1):
            out += weight[j - i + 2 : n - i + 1] @ table.take((m[i] * _BASE + m[j]) * _BASE + m[j + 1 :])
    return out


def norms(m: np.ndarray) -> np.ndarray:
    """Lengths of the feature vectors of words, a column of codes each: the kernel of each with itself by recursion over positions."""
    far = np.subtract.outer(np.arange(len(m)), np.arange(len(m)))
    gap = np.where(far > 0, DECAY ** np.maximum(far, 0), 0.0)
    same = (m[:, None, :] == m[None, :, :]).transpose(2, 0, 1).astype(np.float64)
    two = same * (gap @ same @ gap.T)
    return DECAY * np.sqrt((same * (gap @ two @ gap.T)).sum(axis=(1, 2)))


def word_scores(words: list[str], table: np.ndarray, bias: float, small: np.ndarray | None = None) -> np.ndarray:
    """max(FLOOR, decision value) of each cleaned word; `small` is the table in single precision."""
    out = np.full(len(words), FLOOR)
    small = table.astype(np.float32) if small is None else small
    by: dict[int, tuple[list[int], list[str]]] = {}
    for i, w in enumerate(words):
        if w:
            for p in parts(w):
                at, group = by.setdefault(len(p), ([], []))
                at.append(i)
                group.append(p)
    for n, (at, group) in by.items():
        _, weight = places(n + 2)
        least, most = math.sqrt(float((weight**2).sum())), float(weight.sum())  # a word's length lies between: none or all subsequences equal
        for s in range(0, len(group), 2048):
            m = np.ascontiguousarray(code_matrix(group[s : s + 2048], n).T, np.intp)
            sums = totals(m, small)
            above = np.flatnonzero(np.where(sums > 0, sums / least, sums / most) + bias > FLOOR - 1e-3)  # single precision may err by less
            if len(above):
                some = m[:, above]
                np.maximum.at(out, np.array(at[s : s + 2048])[above], totals(some, table) / norms(some) + bias)
    return out


def train_words(positive: list[tuple[str, float]], negative: list[tuple[str, float]], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(table, bias) of the machine from weighted words of both classes."""
    rows = [(w, 1.0, x) for w, x in positive] + [(w, -1.0, x) for w, x in negative]
    phi = [features(w[:WINDOW]) for w, _, _ in rows]
    marks = list(range(min(len(positive), 2 * landmarks // 3)))
    marks += list(range(len(positive), len(positive) + min(len(negative), landmarks - len(marks))))
    used = {k: i for i, k in enumerate(sorted({k for m in marks for k in phi[m]}))}
    dense = np.zeros((len(marks), len(used)))
    for i, m in enumerate(marks):
        for k, x in phi[m].items():
            dense[i, used[k]] = x
    kernel = np.zeros((len(rows), len(marks)))
    for r, f in enumerate(phi):
        hit = [(used[k], x) for k, x in f.items() if k in used]
        if hit:
            kernel[r] = dense[:, [h[0] for h in hit]] @ np.array([h[1] for h in hit])
    value, basis = np.linalg.eigh(dense @ dense.T)
    keep = value > 1e-6
    root = basis[:, keep] / np.sqrt(value[keep])
    x = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    y = np.array([r[1] for r in rows])
    c = np.array([r[2] for r in rows])
    for sign in (1, -1):
        c[y == sign] /= max(c[y == sign].sum(), 1e-9)
    c *= 200.0
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton steps on the squared hinge loss
        act = y * (x @ w) < 1
        xa = x[act] * c[act, None]
        new = np.linalg.solve(ridge + xa.T @ x[act], xa.T @ y[act])
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    table = np.zeros(_SIZE)
    table[np.array(list(used), np.int64)] = (root @ w[:-1]) @ dense
    return table, float(w[-1])


FEATURES = 5


#: Words whose scores a worker keeps.
CACHE = 300_000


class Scorer:
    """Features of texts by cached word scores."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.cache = table, bias, {}
        self.small = None if table is None else table.astype(np.float32)

    def features(self, texts: list[str | None]) -> np.ndarray:
        sets = [tokens(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = [w for w in set().union(*sets) if w not in self.cache] if sets else []
        self.cache.update(zip(new, word_scores([clean_word(w) for w in new], self.table, self.bias, self.small).tolist()))
        out = np.zeros((len(texts), FEATURES))
        get = self.cache.__getitem__
        for i, found in enumerate(sets):
            s = sorted((x for x in map(get, found) if x > FLOOR), reverse=True)
            n = sum(x > 0 for x in s)
            out[i] = (s[0] if s else FLOOR, s[1] if len(s) > 1 else FLOOR, min(n, 6), min(n, 2), math.log1p(n) - 0.3 * math.log1p(len(found) if n else max(len(found), SHORT)))
        return out


def packed(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a table that are not zero: what is sent to workers."""
    at = np.flatnonzero(table).astype(np.int32)
    return at, table[at]


def unpacked(entries: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    table = np.zeros(_SIZE)
    table[entries[0]] = entries[1]
    return table


class Model:
    """The trained machine; without both classes a constant score."""

    def __init__(self, entries=None, bias=0.0, weights=None, constant=0.0):
        self.entries, self.bias, self.weights, self.constant = entries, bias, weights, constant

    def score(self, f: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(f), self.constant)
        mean, scale, w = self.weights
        return 1 / (1 + np.exp(-np.clip(np.hstack([(f - mean) / scale, np.ones((len(f), 1))]) @ w, -40, 40)))


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    mean, scale = f.mean(axis=0), f.std(axis=0) + 1e-6
    x, w = np.hstack([(f - mean) / scale, np.ones((len(f), 1))]), np.zeros(f.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.5 * w)
    return mean, scale, w


def _sketch(text: str | None) -> tuple[int, int]:
    """Two least hashes of three-word runs: near copies mostly share one of them."""
    w = (text or "").split()
    if len(w) < 3:
        return (zlib.crc32(" ".join(w).encode("utf-8", "replace")),) * 2
    h = [zlib.crc32(" ".join(x).encode("utf-8", "replace")) for x in zip(w, w[1:], w[2:])]
    return min(h), min(x * 2654435761 % 4294967291 for x in h)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of the training sample without its near copies, and how many labelled texts a row of each class stands for."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(common.learns(F.col("doc_id"), 3, 1))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, most / max(1, sizes.get(k, 0))) for k, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))}
    some = marks.filter(common.chance(F.col("doc_id"), 3) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most about TRAIN_TOXIC + TRAIN_CLEAN ids
    twice = docs.select("doc_id").join(F.broadcast(some), "doc_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if not twice.isEmpty():  # of a repeated id the least text
        least = rows.join(F.broadcast(twice), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        rows = rows.join(F.broadcast(twice), "doc_id", "left_anti").unionByName(least)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = zip(*map(_sketch, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "text", "toxic", "a", "b"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, toxic {labels.schema['toxic'].dataType.simpleString()}, a long, b long"
    sketched, _ = common.written(rows.select("doc_id", "text", "toxic").mapInArrow(sketch, kinds), "toxsample")
    one = sketched.groupBy("a").agg(F.min("doc_id").alias("doc_id"))
    one = sketched.select("doc_id", "b").join(one, "doc_id", "left_semi").groupBy("b").agg(F.min("doc_id").alias("doc_id"))
    kept, _ = common.written(sketched.join(F.broadcast(one.select("doc_id")), "doc_id", "left_semi").select("text", "toxic"), "toxtrain")
    return kept, {k: 1 / s for k, s in share.items()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from (doc_id, text) and (doc_id, toxic); conflicting labels of an id count as toxic."""
    train, stands = sample(docs, labels)
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return Model(constant=1.0 if n1 else 0.0)
    out = pa.schema([("word", pa.string()), ("x1", pa.int64()), ("x0", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[toxic].update({clean_word(w) for w in tokens(text)} - {""})
        words = list(sums[0].keys() | sums[1].keys())
        for i in range(0, len(words), 20000):
            some = words[i : i + 20000]
            yield common.arrow(out, [some, [sums[1][w] for w in some], [sums[0][w] for w in some]])

    counted = train.mapInArrow(count, "word string, x1 long, x0 long").groupBy("word").agg(F.sum("x1").alias("x1"), F.sum("x0").alias("x0"))
    stats, _ = common.written(counted, "toxwords")

    rate1, rate = F.col("x1") / n1, (F.col("x1") + F.col("x0")) / (n1 + n0)
    told = stats.withColumn("g", F.when(F.col("x1") > 0, F.col("x1") * F.log(rate1 / rate)).otherwise(0.0)).withColumn("pure", rate1 / (rate1 + F.col("x0") / n0))
    best = told.filter(F.col("g") >= EVIDENCE).filter(F.col("pure") >= 0.9).orderBy(F.desc("g"), "word").collect()  # words of the bounded sample
    positive = [(r["word"], math.log1p(r["x1"])) for r in best if len(r["word"]) <= WINDOW]
    if not positive:
        return Model(constant=n1 * stands[1] / (n1 * stands[1] + n0 * stands[0]))
    plain = told.filter("x0 > 0 AND pure < 0.75").filter(F.length("word") <= WINDOW)
    frequent = plain.orderBy(F.desc("x0"), "word").limit(NEGATIVES).collect()
    other = plain.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()
    negative = {r["word"]: math.log1p(r["x0"]) for r in [*frequent, *other]}
    table, bias = train_words(positive, list(negative.items()))
    for _ in range(2):  # clean words that score highest
        def hard(batches: Iterator[pa.RecordBatch], entries=packed(table), bias=bias) -> Iterator[pa.RecordBatch]:
            table = unpacked(entries)
            for batch in batches:
                s = word_scores(batch.column(0).to_pylist(), table, bias)
                hit = np.flatnonzero(s > FLOOR)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), batch.column(1).take(pa.array(hit)), pa.array(s[hit])], names=["word", "x0", "s"])

        worst = plain.select("word", "x0").mapInArrow(hard, "word string, x0 long, s double").orderBy(F.desc("s"), "word").limit(NEGATIVES)
        worst = {r["word"]: math.log1p(r["x0"]) for r in worst.collect()}
        negative = {**worst, **negative}
        table, bias = train_words(positive, list(negative.items()))

    entries = packed(table)

    def doc_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(unpacked(entries), bias)
        for batch in common.slices(batches):
            f = own.features(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(f.tolist(), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["f", "toxic"])

    rows = train.mapInArrow(doc_features, "f array<double>, toxic int").collect()  # the bounded sample
    rows.sort(key=lambda r: (r["toxic"], r["f"]))
    y = np.array([r["toxic"] for r in rows], float)
    weights = logistic(np.array([r["f"] for r in rows]), y, np.where(y == 1, stands[1], stands[0]))
    return Model(entries, bias, weights)


def predict(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep`, score and predicted for each row.

    Null and empty texts score as texts without words, long ones in full; repeated rows give a row each, and equal texts
    equal scores.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(None if model.entries is None else unpacked(model.entries), model.bias)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            s = model.score(own.features(texts) if model.entries is not None else np.zeros((len(texts), FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels of the other two folds.

    Of a repeated id the least text is learned from, with label 1 if any of its labels is 1. Without labels of both classes the score is constant.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return predict(docs, model, ["doc_id"]).select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic, null and empty texts and repeated rows among them."""
    model = fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    kept = predict(common.masked(docs, "text"), model, [f"c{i}" for i in range(len(docs.columns))]).filter("predicted = 0")
    return common.unmasked(kept, docs.columns)
