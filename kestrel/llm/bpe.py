"""Byte-level BPE encoding and decoding with an existing vocabulary, exact for texts of any length.

Texts of up to `LEAF` characters go to the library in batches; those of ordinary Latin
characters, whose classes no edition of Unicode changes, to a rank encoder of the same merges,
which is faster. A longer text is encoded by tree concatenation: it is halved until the parts
are short, these are encoded in one parallel batch, and around each join a growing window is
encoded again until its pieces and those of the right side end at the same place. The pattern
that splits text goes from left to right and looks one character ahead, so that from such a
place on both sides agree for good, and the pieces well before the join are those of the left
side. One piece of more than `LEAF` characters is halved too; there windows of tokens grow
until their first and last tokens are those that both sides have.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm import common

VOCABULARY = "byte_bpe_50k.json"
LEAF = 1 << 13
#: Tokens on each side of a join that a window must leave as they were.
AGREE = 2
#: The pattern of byte-level vocabularies, and texts on which all its implementations agree.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")
#: Pieces at the end of a part that more text may change, and pieces that a window takes of the right side at first.
UNSURE, WINDOW = 3, 4


def parallel(on: bool) -> None:
    """Whether the library spreads a batch over threads: a task has one core, so only leaves of a long piece are."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


def rank_encoder(path: str):
    """An encoder by ranks for a byte-level vocabulary whose ids are in the order of its merges; else None."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    ordered = all(model["vocab"].get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges))
    plain = (model.get("type"), pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True), spec.get("normalizer")) == ("BPE", "ByteLevel", False, True, None)
    if not (ordered and plain) or model.get("ignore_merges") or model.get("dropout"):
        return None
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str = VOCABULARY, leaf: int = LEAF):
        from tokenizers import Tokenizer

        parallel(False)

        path = common.tokenizer(path)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = Tokenizer(self.whole.model)  # merges only: its input is one piece in the vocabulary's characters
        self.leaf = leaf
        added = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.ranks = rank_encoder(path)
        #: A piece of more than `leaf` characters has such a run.
        self.giant = re.compile(rf"\S{{{leaf - 1},}}|\s{{{leaf - 1},}}")
        self.bytes = np.zeros(self.whole.get_vocab_size(), np.int64)  # bytes of each token: a character each in the vocabulary
        for token, i in self.whole.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = len(token)
        self.names = [str(i) for i in range(self.whole.get_vocab_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, as the library's own encode gives them."""
        out: list[list[int]] = [[] for _ in texts]
        short = []
        for i, t in enumerate(texts):
            if len(t) <= self.leaf:
                if self.ranks is not None and _PLAIN.fullmatch(t) and not (self.special and self.special.search(t)):
                    out[i] = self.ranks.encode_ordinary(t)
                else:
                    short.append(i)
        for i, e in zip(short, self.whole.encode_batch_fast([texts[i] for i in short], add_special_tokens=False)):
            out[i] = e.ids
        for i, t in enumerate(texts):
            if len(t) > self.leaf:
                out[i] = self.long(t)
        return out

    def long(self, text: str) -> list[int]:
        """A text of more than `leaf` characters: apart at special tokens, then by tree concatenation."""
        if self.giant.search(text):
            return self.unsplit(text)
        ids, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self.halves(text[at : m.start()]) + [self.added[m[0]]]
            at = m.end()
        return ids + self.halves(text[at:])

    def parts(self, texts: list[str]) -> list[tuple]:
        """(text, ids, first token of each piece, character where each piece begins) of texts without special tokens."""
        out = []
        for t, e in zip(texts, self.whole.encode_batch(texts, add_special_tokens=False)):
            words = np.array(e.word_ids, np.int64)
            first = np.flatnonzero(np.diff(words, prepend=-1))
            size = self.bytes[np.array(e.ids, np.int64)]
            where = np.concatenate([[0], np.cumsum(size)])[first]  # pieces begin at whole characters
            if len(t) != len(raw := t.encode("utf-8", "surrogatepass")):
                where = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[where] - 1
            out.append((t, np.array(e.ids, np.int64), first, where))
        return out

    def halves(self, text: str) -> list[int]:
        """Tree concatenation of a text without special tokens and giant pieces."""
        if not text:
            return []
        leaves = [text]
        while len(leaves[0]) > self.leaf:
            leaves = [p for x in leaves for p in (x[: len(x) // 2], x[len(x) // 2 :])]
        parallel(True)
        level = self.parts(leaves)
        parallel(False)
        while len(level) > 1:
            level = [self.concatenated(level[i], level[i + 1]) for i in range(0, len(level), 2)]
        return level[0][1].tolist()

    def concatenated(self, left: tuple, right: tuple) -> tuple:
        """The encoding of both texts as one."""
        text, ids, first, where = left
        more, ids2, first2, where2 = right
        keep = max(0, len(first) - UNSURE - 1)  # pieces of the left that stand
        start, take = int(where[keep]), WINDOW
        while True:
            whole = take >= len(first2)
            stop = len(more) if whole else int(where2[take])
            (_, own, own_first, own_where), = self.parts([text[start:] + more[:stop]])
            if whole:
                n, skip = len(own_first), len(first2)
                break
            sure = own_where[: max(0, len(own_first) - UNSURE)] + start - len(text)
            shared = np.intersect1d(sure, where2)
            if len(shared):  # from the first such place on the right side stands
                n, skip = int(np.searchsorted(sure, shared[0])), int(np.searchsorted(where2, shared[0]))
                break
            take *= 2
        cut = own_first[n] if n < len(own_first) else len(own)
        rest = first2[skip] if skip < len(first2) else len(ids2)
        head = first[keep]
        return (
            text + more,
            np.concatenate([ids[:head], own[:cut], ids2[rest:]]),
            np.concatenate([first[:keep], own_first[:n] + head, first2[skip:] - rest + head + cut]),
            np.concatenate([where[:keep], own_where[:n] + start, where2[skip:] + len(text)]),
        )

    def unsplit(self, text: str) -> list[int]:
        """A text with giant pieces: the pattern splits it, and pieces of more than `leaf` characters go by tree concatenation."""
        ids, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            ids += self.plain(text[at : m.start()]) + [self.added[m[0]]]
            at = m.end()
        return ids + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        if not text:
            return []
        pieces = [p for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]
        ids: list[int] = []
        for p, e in zip(pieces, self.bare.encode_batch_fast([p if len(p) <= self.leaf else "" for p in pieces], add_special_tokens=False)):
            ids += e.ids if len(p) <= self.leaf else self.tree(p)
        return ids

    def tree(self, piece: str) -> list[int]:
        """One long piece, in the vocabulary's characters: parallel leaves, then joins by pairs."""
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        parallel(True)
        level = [e.ids for e in self.bare.encode_batch_fast(leaves, add_special_tokens=False)]
        parallel(False)
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the concatenation, from the ids of both sides."""
        width = 2 * AGREE
        while True:
            a, b = left[-width:], right[:width]
            own = self.bare.encode("".join(map(self.bare.id_to_token, a + b)), add_special_tokens=False).ids
            near = len(a) == len(left) or own[:AGREE] == a[:AGREE]
            far = len(b) == len(right) or own[-AGREE:] == b[-AGREE:]
            if near and far and (len(own) >= 2 * AGREE or (len(a) == len(left) and len(b) == len(right))):
                return left[: len(left) - len(a)] + own + right[len(b) :]
            width *= 2

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def digest(self, ids: list[int]) -> str:
        names = self.names
        return hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest()


@functools.lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def encode(docs: DataFrame, path: str = VOCABULARY, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """Adds `ids`, the token ids of the whole text (null: none), to all columns."""
    keep = list(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, leaf)
        for batch in common.slices(batches):
            ids = own.encode([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids, pa.list_(pa.int32()))], names=[*keep, "ids"])

    return docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Adds `decoded`, the text of `ids` (null: empty), to all columns."""
    keep = list(rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches):
            text = own.decode([x or [] for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string())], names=[*keep, "decoded"])

    return rows.select(F.col("ids").alias("__ids"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches):
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            text = own.decode(ids)
            cols = [[len(x) for x in ids], [own.digest(x) for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in text]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], schema=pa.schema([("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the tokens and of the decoded text of every document.

    Null and empty texts have no tokens; long ones go by tree concatenation; repeated rows give a row each.
    """
    return digests(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the digests of every document kept, null and empty texts and repeated rows among them."""
    return digests(docs)
