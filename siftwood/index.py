"""A searchable index: its tables and how they were built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from siftwood.functions import text
from siftwood.mapping import Mapping

Analyzer = Callable[[Column], Column]

# Analyzers an index can be built with, by the name kept in its settings.
ANALYZERS: dict[str, Analyzer] = {"terms": text.tokenize, "full": text.analyze}


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # the mapping's fields but the vector
    postings: DataFrame  # tbucket, field, term, doc_id, tf, dl
    dfs: DataFrame  # tbucket, field, term, df
    lengths: DataFrame  # field, doc_id, len
    stats: DataFrame  # field, n, total_len, avg_len
    vectors: DataFrame  # doc_id, vec (unit, float)
    mapping: Mapping
    term_buckets: int
    doc_buckets: int
    analyzer_name: str = "terms"
    cells: DataFrame | None = None  # cell, ids, codes: packed 8-bit vectors, if built with cells
    centres: DataFrame | None = None  # cell, centre
    tops: DataFrame | None = None  # tbucket, field, term, dblock, top: if built with blocks
    block_docs: int = 0
    segments: int = 1  # with several, dfs has a row per term and segment

    @property
    def analyzer(self) -> Analyzer:
        return ANALYZERS[self.analyzer_name]

    def split_fields(self, fields: list[str] | None) -> tuple[list[str], list[str]]:
        """Text and keyword fields among ``fields``, by default all of the mapping."""
        fields = self.mapping.search_fields if fields is None else fields
        unknown = sorted(set(fields) - set(self.mapping.search_fields))
        if unknown:
            raise ValueError(f"unknown search fields: {unknown}")
        return (
            [f for f in self.mapping.text_fields if f in fields],
            [f for f in self.mapping.keyword_fields if f in fields],
        )
