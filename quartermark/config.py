"""Tunables that change results; one frozen value, passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # Lags in days, caps and thresholds that results depend on.
    result_lag_days: int = 90
    annual_lag_days: int = 200
    max_docs_per_period: int = 15
    max_pages: int = 5
    pdf_page_cap: int = 250
    pdf_page_limit: int = 25
    doc_max_chars: int = 60_000
    min_doc_chars: int = 200
    min_chunk_chars: int = 50
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_table_chars: int = 6_000
    top_k: int = 12
    rerank_candidates: int = 25
    rerank_max_pairs: int = 500
    min_chunks_to_score: int = 5
    fuzzy_threshold: float = 0.85
    recency: str = "oldest"


DEFAULT = EngineConfig()
