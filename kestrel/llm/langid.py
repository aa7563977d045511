"""Language identification by multilingual mixture inference.

A document is a bag of hashed byte trigrams drawn from a mixture of the learned
languages. Expectation-maximisation estimates the proportions of a set of languages;
the set grows from the best single language while the likelihood gained exceeds a
penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

BUCKETS = 1 << 15
#: Learning reads at most about this many labelled documents of each language.
TRAIN_DOCS = 1500
UNDETERMINED = "und"
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased UTF-8 bytes; runs of other characters than letters are gaps."""
    b = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    if len(b) < 3:
        return np.empty(0, np.int64)
    keep = (b[1:-1] != 0x20) | ((b[:-2] != 0x20) & (b[2:] != 0x20))
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64) & (BUCKETS - 1)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(trigrams(text), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids].astype(np.float64)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, their trigram probabilities) from rows of (doc_id, text, lang).

    At most about `train_docs` documents of each language are read, chosen by a hash
    of their ids; their whole texts count. Without labelled rows the list is empty.
    """
    rows = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.empty((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    chosen = rows.filter(common.chance(F.col("doc_id")) < share[F.col("lang")])
    out = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, own in sums.items():
            ids = np.flatnonzero(own)
            yield common.arrow(out, [[lang] * len(ids), ids, own[ids]])

    counted = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs = sorted(sizes)
    freq = np.zeros((len(langs), BUCKETS))
    place = {x: i for i, x in enumerate(langs)}
    for r in counted.collect():  # languages x BUCKETS at most
        freq[place[r["lang"]], r["bucket"]] = r["n"]
    freq += 0.5
    return langs, freq / freq.sum(axis=1, keepdims=True)


def proportions(ids: np.ndarray, n: np.ndarray, prob: np.ndarray, penalty: float = 2.0, rounds: int = 30) -> np.ndarray:
    """Mixture proportions over all languages for one bag (zeros outside the selected set)."""
    p, total = prob[:, ids], n.sum()
    cost = penalty * np.log(total + 1.0)
    single = np.log(p) @ n
    chosen = [int(np.argmax(single))]
    share, mix, best = np.ones(1), p[chosen[0]], single[chosen[0]]
    while len(chosen) < len(p):
        slope = p @ (n / mix) - total  # the log-likelihood is concave: no language can gain more than its slope
        slope[chosen] = -np.inf
        tried = np.flatnonzero(slope > cost)
        better = None
        for k in tried:
            members = [*chosen, int(k)]
            a, w, last = p[members], np.append(share * 0.9, 0.1), -np.inf
            for _ in range(rounds):
                m = w @ a
                now = float(np.log(m) @ n)
                if now - last < 1e-3 * cost:
                    break
                last = now
                w = w * (a @ (n / m)) / total
            if now - best > cost and (better is None or now > better[0]):
                better = now, members, w, w @ a
        if better is None:
            break
        best, chosen, share, mix = better
    out = np.zeros(len(p))
    out[chosen] = share / share.sum()
    return out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (its proportion) and mixture to the columns `keep` (default: all).

    `und` with score 0 where text is null, has no letter, or nothing was learned.
    """
    langs, prob = model
    keep = list(docs.columns) if keep is None else keep
    fields = [docs.select("text").schema["text"], *[docs.schema[c] for c in keep]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[1:])
    schema += ", lang_pred string, score double, mixture string"

    def guess(text: str | None) -> tuple[str, float, str]:
        if not langs or text is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, ""
        ids, n = bag(text)
        if not len(ids):
            return UNDETERMINED, 0.0, ""
        w = proportions(ids, n, prob)
        k = int(np.argmax(w))
        return langs[k], min(1.0, float(w[k])), " ".join(f"{langs[i]}:{w[i]:.3f}" for i in np.argsort(-w, kind="stable") if w[i] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [guess(t) for t in batch.column(0).to_pylist()]
            extra = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *extra], names=[*keep, "lang_pred", "score", "mixture"])

    chosen = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    return chosen.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from labelled rows of the other two folds.

    Null texts and ones without a letter are `und`, long ones count in full; of languages in equal shares the
    first by name wins, and repeated rows give a row each.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(common.learns(F.col("doc_id"), 3, 1)))
    out = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", common.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "mixture")


#: The pipeline rejects documents without a letter, or whose main language has less than this share.
MIN_SHARE = 0.5


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose main language is determined and holds at least MIN_SHARE of the text; null and empty texts go, repeated rows stay."""
    model = fit(docs.filter(common.learns(F.col("doc_id"), 3, 1)))
    kept = predict(common.masked(docs, "text"), model).filter(F.col("lang_pred") != UNDETERMINED).filter(F.col("score") >= MIN_SHARE)
    return common.unmasked(kept, docs.columns)
