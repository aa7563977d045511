"""Language-model scoring by the marginal likelihood of a subword lattice.

A text is its lower-cased words and one end token. The lattice of a text has arcs of three
lengths. Pieces of an existing vocabulary carry their existing scores (ranks, read as a Zipf
law) and spell any word. A word of the training texts also has an arc of its own, weighted by
its count c: P(w) = (c - d) / N + d * V / N * P_pieces(w), N training tokens of V kinds. So has
a phrase, the words up to and with one whose hash is divisible by PHRASE: P(p) = (k - e) / M +
e * U / M * product of its P(w), where k counts the phrase among M training phrases of U kinds.
The discounts d and e are estimated from the numbers of kinds seen once and twice. No arc
crosses a phrase, so the forward recursion in log space over the arcs of each phrase, which
sums over all segmentations, gives the marginal probability of the document (`score`).

The corpus is read once into blocks: a block's own dictionaries of words and phrases, and its
documents as their numbers. Counts are summed over all dictionaries by word and by phrase (told
apart by 64-bit hashes) and joined back to them, and a block meets its dictionaries again by
its number, so no task holds more than a few blocks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

PIECES = "piece_bpe_32k.model"
#: A block ends with the text that brings it to so many distinct words or bytes.
BLOCK_WORDS, BLOCK_BYTES = 600_000, 32 << 20
#: Texts of a block are scored in steps of about so many tokens, which bounds memory.
STEP = 1_000_000
#: A phrase ends with a word whose hash is divisible by this: its mean length.
PHRASE = 16
START = "▁"
_STOP = 0.3
_LN10 = math.log(10)


def vocabulary(path: str = PIECES) -> dict[str, float]:
    """Pieces and their log probabilities from their existing scores: the k-th best has mass in proportion to 1 / (k + 10)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer(path))
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(usable, key=lambda i: (-sp.get_score(i), i))
    return {sp.id_to_piece(i): -math.log(k + 10) for k, i in enumerate(ranked)}


def _norm(logs: dict[str, float], mass: float = 1.0) -> dict[str, float]:
    total = math.log(sum(map(math.exp, logs.values()))) - math.log(mass) if logs else 0.0
    return {k: v - total for k, v in logs.items()}


def _walk(table: dict[str, float]) -> dict[str, float | None]:
    """All beginnings of pieces, with the log probability of those that are pieces."""
    out: dict[str, float | None] = {p[:k]: None for p in table for k in range(1, len(p))}
    out.update(table)
    return out


class Lattice:
    """Log probabilities of first pieces, later pieces and the stop after a word's last piece."""

    def __init__(self, first: dict[str, float], later: dict[str, float], stop: float):
        self.first, self.later, self.stop = first, later, stop
        self.walk_first, self.walk_later = _walk(first), _walk(later)

    @classmethod
    def existing(cls, pieces: dict[str, float]) -> Lattice:
        first = {p: v for p, v in pieces.items() if p.startswith(START)}
        first.setdefault(START, min(pieces.values()))
        later = {p: v for p, v in pieces.items() if not p.startswith(START)}
        for b in range(256):
            later.setdefault(f"<0x{b:02X}>", min(pieces.values()))
        return cls(_norm(first), _norm(later, 1 - _STOP), math.log(_STOP))

    def log_prob(self, word: str) -> float:
        """Natural log of the marginal probability of a word: the forward recursion without keeping the arcs."""
        s = START + word
        n, exp, log1p = len(s), math.exp, math.log1p
        alpha: list[float | None] = [None] * (n + 1)
        alpha[0] = 0.0
        get = self.walk_first.get
        for i in range(n):
            a = alpha[i]
            if i == 1:
                get = self.walk_later.get
            if a is None:
                continue
            if i and get(s[i]) is None:
                arcs = [(i + 1, sum(self.later[f"<0x{b:02X}>"] for b in s[i].encode("utf-8", "replace")))]
            else:
                arcs = []
            j = i + 1
            while j <= n:
                lp = get(s[i:j], 1.0)
                if lp is not None:
                    if lp > 0.0:
                        break
                    arcs.append((j, lp))
                j += 1
            for j, lp in arcs:
                x, y = a + lp, alpha[j]
                alpha[j] = x if y is None else x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
        return alpha[n] + self.stop


class _Numbers(dict):
    """Numbers in the order of first use."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


_ROW = "block long, doc_id {id}, held_out boolean, seq array<int>, cut array<int>, phrase array<int>, first int, words array<string>, keys array<long>, c array<int>"


def blocks(docs: DataFrame) -> DataFrame:
    """Rows of documents (numbers of their words in order, lengths and numbers of their phrases), and of dictionaries.

    A row of a dictionary has the words or the hashes of the phrases with numbers from `first` on, and
    their counts in training texts. Reads (doc_id, text, learns, held_out).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ints, longs, strings = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
    names = [x.split()[0] for x in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, key = TaskContext.get().partitionId() << 24, 0, None
        words, phrases = _Numbers(), _Numbers()
        ends = np.zeros(1 << 16, bool)  # whether a word ends a phrase
        known = 0
        learned: tuple[list, list] = [], []  # numbers of words and phrases in training texts
        rows: list[tuple] = []

        def batch_of(n: int, **cols: pa.Array) -> pa.RecordBatch:
            kinds = dict(zip(names, (pa.int64(), key, pa.bool_(), ints, ints, ints, pa.int32(), strings, longs, ints)))
            return pa.RecordBatch.from_arrays([cols[x] if x in cols else pa.nulls(n, t) for x, t in kinds.items()], names=names)

        def docs_out() -> Iterator[pa.RecordBatch]:
            if rows:
                doc, held, seq, cut, phrase = zip(*rows)
                n = len(rows)
                rows.clear()
                yield batch_of(n, block=pa.array([at] * n, pa.int64()), doc_id=pa.array(doc, key), held_out=pa.array(held, pa.bool_()), seq=pa.array(seq, ints), cut=pa.array(cut, ints), phrase=pa.array(phrase, ints))

        def dictionary() -> Iterator[pa.RecordBatch]:
            step = 8192
            for found, seen, name in ((words, learned[0], "words"), (phrases, learned[1], "keys")):
                listed = [w.decode("utf-8") for w in found] if name == "words" else list(found)
                count = np.bincount(np.concatenate([np.zeros(0, np.int32), *seen]), minlength=len(listed)).astype(np.int32)
                parts = range(0, len(listed), step)
                if parts:
                    n = len(parts)
                    values = pa.array([listed[i : i + step] for i in parts], strings if name == "words" else longs)
                    yield batch_of(n, block=pa.array([at] * n, pa.int64()), first=pa.array(parts, pa.int32()), c=pa.array([count[i : i + step] for i in parts], ints), **{name: values})

        for batch in common.slices(batches):
            key = batch.schema.field(0).type
            for doc, text, learns, held in zip(*(batch.column(i).to_pylist() for i in range(4))):
                b = (text or "").encode("utf-8", "replace").lower()
                listed = b.split()
                seq = np.fromiter(map(words.__getitem__, listed), np.int32, len(listed))
                if len(words) > known:
                    if len(words) > len(ends):
                        ends = np.concatenate([ends, np.zeros(max(len(ends), len(words)), bool)])
                    for i in np.flatnonzero(seq >= known).tolist():
                        ends[seq[i]] = zlib.crc32(listed[i]) % PHRASE == 0
                    known = len(words)
                stop = np.flatnonzero(ends[seq]) + 1
                if len(seq) and (not len(stop) or stop[-1] < len(seq)):
                    stop = np.append(stop, len(seq))
                start = [0, *stop[:-1].tolist()] if len(stop) else []
                hashes = [xxhash.xxh64_intdigest(b" ".join(listed[i:j])) - (1 << 63) for i, j in zip(start, stop.tolist())]
                phrase = np.fromiter(map(phrases.__getitem__, hashes), np.int32, len(hashes))
                if learns:
                    learned[0].append(seq)
                    learned[1].append(phrase)
                size += len(b)
                rows.append((doc, held, seq, np.diff(stop, prepend=0).astype(np.int32), phrase))
                if len(words) >= BLOCK_WORDS or size >= BLOCK_BYTES:
                    yield from docs_out()
                    yield from dictionary()
                    words, phrases, learned, known, size, at = _Numbers(), _Numbers(), ([], []), 0, 0, at + 1
                    ends = np.zeros(1 << 16, bool)
            yield from docs_out()
        yield from dictionary()

    return docs.select("doc_id", "text", "learns", "held_out").mapInArrow(run, _ROW.format(id=kind))


def summed(dictionaries: DataFrame, column: str, tag: str) -> tuple[DataFrame, dict]:
    """(key, c) of all words or phrases with their training counts, and what the discount needs: n, kinds, and kinds seen once and twice."""
    pairs = dictionaries.filter(F.col(column).isNotNull()).selectExpr(f"explode(arrays_zip({column}, c)) AS x").select(F.col(f"x.{column}").alias("key"), "x.c")
    table, _ = common.written(pairs.groupBy("key").agg(F.sum("c").alias("c")), tag)
    return table, table.selectExpr("coalesce(sum(c), 0) AS n", "count_if(c > 0) AS kinds", "count_if(c = 1) AS once", "count_if(c = 2) AS twice").first().asDict()


def discount(once: int, twice: int) -> float:
    """What is taken off each count: the Good-Turing estimate, kept between 0 and 1."""
    return (once + 1) / (once + 2 * twice + 2)


def score(docs: DataFrame, pieces: str = PIECES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of (doc_id, text, learns, held_out).

    Scores are log10 probabilities. A null text is empty: its end token alone is scored. Without training rows every word is
    spelled and the end token is certain; repeated rows give a row each.
    """
    spark = docs.sparkSession
    ends = docs.filter("learns").count()
    made, path = common.written(blocks(docs), "blocks")
    dictionaries = made.filter("doc_id IS NULL AND seq IS NULL")
    vocab, told = summed(dictionaries, "words", "vocab")
    repeated, heard = summed(dictionaries, "keys", "phrases")
    n_train, n_types = int(told["n"]) + ends, int(told["kinds"]) + (ends > 0)
    less, less_phrase = discount(told["once"], told["twice"]), discount(heard["once"], heard["twice"])
    escape = math.log(less * n_types / n_train) if n_train else 0.0
    escape_phrase, n_phrases = math.log10(less_phrase * heard["kinds"] / heard["n"]) if heard["n"] else 0.0, heard["n"]
    lattice = Lattice.existing(vocabulary(pieces))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column(1), np.float64)
            lp = np.array([lattice.log_prob(w) for w in batch.column(0).to_pylist()]) + escape
            if n_train:
                with np.errstate(divide="ignore"):
                    lp = np.logaddexp(np.log(np.maximum(c - less, 0.0) / n_train), lp)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp / _LN10)], names=["key", "c", "lp"])

    def numbers(column: str, sign: str) -> DataFrame:
        """block, place and key of each entry of the dictionaries; phrases have places below zero."""
        each = dictionaries.filter(F.col(column).isNotNull()).selectExpr("block", "first", f"posexplode({column}) AS (i, key)")
        return each.selectExpr("block", f"CAST({sign}(first + i) AS INT) AS place", "key")

    own = numbers("words", "").join(vocab.mapInArrow(spell, "key string, c long, lp double"), "key").select("block", "place", "c", "lp")
    arcs = numbers("keys", "-1 - ").join(repeated.filter("c > 0"), "key").selectExpr("block", "place", "c", "0D AS lp")
    end = math.log10((ends - less) / n_train) if ends else 0.0
    base_end, base_all = math.log10(ends + 1), math.log10(n_train + n_types + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        place, count, log = (right.column(x).to_numpy() for x in ("place", "c", "lp"))
        word = place >= 0
        c, lp = np.zeros(int(word.sum())), np.zeros(int(word.sum()))
        c[place[word]], lp[place[word]] = count[word], log[word]
        arc = np.full(max((pa.compute.max(x.flatten()).as_py() or 0 for x in left.column("phrase").chunks), default=0) + 1, -np.inf)
        arc[-1 - place[~word]] = np.log10(count[~word] - less_phrase) - math.log10(max(n_phrases, 1))
        gain = np.log10(c + 1)

        def some(left: pa.Table) -> pa.Table:
            rows = left.num_rows
            lists = {x: left.column(x).combine_chunks() for x in ("seq", "cut", "phrase")}
            flat = {x: np.asarray(v.flatten()) for x, v in lists.items()}
            size = {x: np.asarray(v.value_lengths()) for x, v in lists.items()}
            row = np.repeat(np.arange(rows), size["seq"])
            n = size["seq"] + 1
            base = np.bincount(row, gain[flat["seq"]], rows) + base_end - n * base_all
            known = np.bincount(row, c[flat["seq"]] > 0, rows).astype(np.int64) + (ends > 0)
            spelled = np.bincount(np.repeat(np.arange(len(flat["cut"])), flat["cut"]), lp[flat["seq"]], len(flat["cut"])) + escape_phrase
            whole = np.logaddexp(spelled * _LN10, arc[flat["phrase"]] * _LN10) / _LN10
            total = np.bincount(np.repeat(np.arange(rows), size["phrase"]), whole, rows) + end
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
            return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(rows, n_train)), pa.array(base), pa.array(total)], names=names)

        if not left.num_rows:
            return some(left)
        filled = np.concatenate([np.asarray(x.value_lengths()) for x in left.column("seq").chunks]).cumsum() // STEP
        cut = [0, *(np.flatnonzero(np.diff(filled)) + 1).tolist(), left.num_rows]
        return pa.concat_tables([some(left.slice(i, j - i)) for i, j in zip(cut, cut[1:])])

    rows = spark.read.schema(made.schema).parquet(path).filter("seq IS NOT NULL").select("block", "doc_id", "held_out", "seq", "cut", "phrase")
    parts = max(1, made.select("block").distinct().count())  # so that a task has few blocks however many there are
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    met = own.unionByName(arcs).repartition(parts, "block").groupBy("block")
    return rows.repartition(parts, "block").groupBy("block").cogroup(met).applyInArrow(meet, schema)


def op7_lattice_lm(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; learned from those of the other six folds."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs.withColumn("learns", common.learns(F.col("doc_id"), 7, 2)).withColumn("held_out", common.held_out(F.col("doc_id"), 7, 2)))
