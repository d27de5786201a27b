"""Engine settings.  The numbers are fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Chunking:
    min_words: int = 100
    max_words: int = 200
    target_words: int = 150


@dataclass(frozen=True)
class Weights:
    bm25: float = 0.5
    semantic: float = 0.5
    exact: float = 0.8
    phrase: float = 0.6
    proximity: float = 0.4

    def for_intent(self, intent: str) -> Weights:
        factor = {
            "factual": {"bm25": 1.15, "exact": 1.2, "phrase": 1.1, "semantic": 0.9},
            "list": {"bm25": 1.1, "semantic": 1.1, "proximity": 0.9},
            "comparison": {"phrase": 1.2, "proximity": 1.2, "semantic": 1.05},
        }.get(intent, {})
        return Weights(**{k: v * factor.get(k, 1.0) for k, v in self.__dict__.items()})


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    page_chunking: Chunking = Chunking(100, 300, 200)
    weights: Weights = field(default_factory=Weights)
    k1: float = 1.5
    b: float = 0.75
    dims: int = 384
    ngram_min: int = 3
    ngram_max: int = 5
    ivf_lists: int = 64
    ivf_probe: int = 4
    kmeans_rounds: int = 8
    train_sample: int = 5000
    pq_parts: int = 8
    pq_codes: int = 256
    graph_degree: int = 16
    graph_build: int = 100
    graph_search: int = 64
    graph_shard: int = 4096
    retrieve_k: int = 50
    results_k: int = 10
    snippet_chars: int = 180
    shard_docs: int = 50_000
    vector_enabled: bool = True

    def k_for(self, intent: str) -> int:
        return max(self.retrieve_k, {"factual": 150, "list": 100, "comparison": 100}.get(intent, 0))


#: Weights of the second ranking profile and what an intent changes in them.
WEB_WEIGHTS = {"bm25": 1.0, "semantic": 1.0, "exact": 0.8, "phrase": 0.6, "freshness": 0.4, "feedback": 0.5}
WEB_OVERRIDES = {
    "factual": {"exact": 1.0, "phrase": 0.7},
    "list": {"semantic": 1.2, "bm25": 0.9, "phrase": 0.5},
    "comparison": {"phrase": 0.9, "bm25": 1.1},
}
