"""Interfaces of what lies outside the engine, with offline defaults."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from kestrel.operators import retrieve, vectors


class Embedder(Protocol):
    def embed(self, rows: DataFrame) -> DataFrame:
        """(id, embedding) of (id, text)."""


class Scorer(Protocol):
    def __call__(self, query: Column, text: Column) -> Column:
        """A score of a text for a query."""


class Fetcher(Protocol):
    def fetch(self, sources: DataFrame) -> DataFrame:
        """(doc_id, text) of (source)."""


class RelationExtractor(Protocol):
    def extract(self, sentences: DataFrame) -> DataFrame:
        """(sid, head, relation, tail, confidence) of (sid, text, canons)."""


class Store(Protocol):
    def write(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Send a graph to an external store."""


class HashEmbedder:
    """The offline embedder: every token adds to one cell."""

    def __init__(self, dim: int = vectors.DIM):
        self.dim = dim

    def embed(self, rows: DataFrame) -> DataFrame:
        return vectors.hash_embed(rows, self.dim)


def overlap_scorer(query: Column, text: Column) -> Column:
    return retrieve.overlap_score(query, text)
