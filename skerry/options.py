"""Engine options: one frozen record, defaults in one place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class SearchOptions:
    """All knobs of indexing, retrieval, ranking and answers.

    ``as_of_ms`` stands in for the clock, so that recency, relative dates and
    reruns are reproducible.
    """

    chunk_size: int = 150
    chunk_overlap: int = 40
    dim: int = 384
    max_results: int = 50
    sparse_limit: int = 100
    dense_limit: int = 50
    threshold: float = 0.3
    mmr_lambda: float = 0.7
    mmr_limit: int = 20
    rrf_k: int = 60
    rrf_limit: int = 25
    rerank: bool = False
    rerank_considered: int = 100
    rerank_returned: int = 20
    dense: bool = True
    expansion: bool = True
    skip_dense_files: int = 50
    skip_dense_score: float = 0.85
    context_chunks: int = 5
    context_chars: int = 2000
    quality_budget: int = 100
    as_of_ms: int = 1717200000000

    @property
    def step(self) -> int:
        return max(self.chunk_size - self.chunk_overlap, 1)

    @classmethod
    def from_conf(cls, spark, prefix: str = "skerry.") -> SearchOptions:
        """Defaults overridden by session settings ``skerry.<option>``."""
        found = {}
        for f in fields(cls):
            raw = spark.conf.get(prefix + f.name, None)
            if raw is not None:
                kind = type(f.default)
                found[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**found)

    def reset(self) -> SearchOptions:
        return type(self)()

    def update(self, **changes) -> SearchOptions:
        return replace(self, **changes)


DEFAULTS = SearchOptions()
DAY_MS = 86_400_000
