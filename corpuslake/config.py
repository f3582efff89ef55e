"""Settings, and the fixed values of the text rules."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Tunables; ``from_env`` reads CORPUSLAKE_<NAME>."""

    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_chunk_chars: int = 50
    chars_per_token: int = 4
    top_k: int = 5
    min_similarity: float = 0.3
    max_pages: int = 60
    max_file_mb: int = 50
    max_results: int = 20
    confidence: float = 0.35
    requests_per_minute: int = 5
    min_quality: float = 0.4
    near_zero_quality: float = 0.05
    history_turns: int = 3
    stored_turns: int = 20
    rerank_pool: int = 5
    reserved_tokens: int = 4000
    fallback_context_tokens: int = 8000
    min_budget_tokens: int = 1000
    retry_delays: tuple[float, ...] = (1.0, 2.0, 4.0)

    @classmethod
    def from_env(cls) -> Settings:
        found = {}
        for f in fields(cls):
            raw = os.environ.get(f"CORPUSLAKE_{f.name.upper()}")
            if raw is not None:
                kind = type(f.default)
                found[f.name] = tuple(map(float, raw.split(","))) if kind is tuple else kind(raw)
        return cls(**found)

    def budget_chars(self, context_tokens: int | None) -> int:
        """Characters of paper text that a model's window leaves room for."""
        usable = (context_tokens or self.fallback_context_tokens) - self.reserved_tokens
        return max(usable, self.min_budget_tokens) * self.chars_per_token


def steady_unions(spark) -> None:
    """Have unions forget how their inputs are dealt out.

    Spark 4.1 plans a union by its inputs' common partitioning; when adaptive execution then
    changes the partitions of one of them, the job fails ("Can't zip RDDs").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
