"""Settings. The default values are fixed by the behaviour this engine has to match."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class FetchSettings:
    user_agent: str = "gleanery/1.0"
    timeout_seconds: int = 30
    max_attempts: int = 3
    retry_delay_seconds: float = 1.0


@dataclass(frozen=True)
class ChunkSettings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    min_chunk_size: int = 50
    separators: tuple[str, ...] = ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", " ")
    include_section_context: bool = True


@dataclass(frozen=True)
class EmbeddingSettings:
    model_name: str = "feature-hashing"
    dimension: int = 384
    batch_size: int = 64
    normalize: bool = True


@dataclass(frozen=True)
class VectorSettings:
    distance_metric: str = "cosine"
    search_top_k: int = 10


@dataclass(frozen=True)
class TreeSettings:
    preview_chars: int = 200
    llm_model: str = "none"
    max_tokens: int = 4096
    trees_per_prompt: int = 50


@dataclass(frozen=True)
class Bm25Settings:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    enabled: bool = True


@dataclass(frozen=True)
class FusionSettings:
    vector_weight: float = 0.40
    bm25_weight: float = 0.35
    tree_weight: float = 0.25
    rank_step: float = 0.05


@dataclass(frozen=True)
class CacheSettings:
    similarity_threshold: float = 0.92
    ttl_seconds: float = 86_400.0
    max_entries: int = 1_000


@dataclass(frozen=True)
class Settings:
    root: str = "gleanery-data"
    # Directory-level partitions of every url-keyed table. One re-ingested url rewrites one
    # partition, so this bounds write amplification; raise it with the size of the corpus.
    url_buckets: int = 16
    # Pages whose main text is shorter than this many tokens get no chunks, whatever their headings add to them.
    min_page_tokens: int = 0
    fetch: FetchSettings = field(default_factory=FetchSettings)
    chunking: ChunkSettings = field(default_factory=ChunkSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    vectors: VectorSettings = field(default_factory=VectorSettings)
    tree: TreeSettings = field(default_factory=TreeSettings)
    bm25: Bm25Settings = field(default_factory=Bm25Settings)
    fusion: FusionSettings = field(default_factory=FusionSettings)
    cache: CacheSettings = field(default_factory=CacheSettings)
    llm_api_key: str | None = None
    # Compatibility switches; the defaults repair defects of the behaviour being matched.
    url_filter_covers_tree: bool = True
    report_unreachable_as_cached: bool = False

    @classmethod
    def load(cls, **overrides) -> "Settings":
        """Defaults, plus the key for the optional text generator from the environment."""
        overrides.setdefault("llm_api_key", os.environ.get("GLEANERY_LLM_KEY"))
        return cls(**overrides)
