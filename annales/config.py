"""All settings in one frozen object; the defaults are those of the engine this one stands in for."""

from __future__ import annotations

from dataclasses import dataclass, field


def _fusion() -> dict[str, tuple[float, float, float]]:
    # Weights of vector, graph and path lists by intent (fixed values).
    return {
        "factoid": (0.5, 0.5, 0.0),
        "multihop": (0.3, 0.7, 0.0),
        "temporal": (0.4, 0.6, 0.0),
        "relational": (0.2, 0.4, 0.4),
        "comparison": (0.4, 0.6, 0.0),
        "overview": (0.6, 0.4, 0.0),
    }


@dataclass(frozen=True)
class Config:
    max_year: int = 1945
    min_age_at_cutoff: int = 20
    target_tokens: int = 500
    overlap_sentences: int = 1
    min_tokens: int = 80
    drop_post_cutoff: bool = True
    drop_sections: tuple[str, ...] = ("Tham khảo", "Chú thích", "Xem thêm", "Liên kết ngoài", "Đọc thêm", "Ghi chú")
    min_confidence: float = 0.6
    evidence_ratio: float = 90.0
    max_chunks_b: int = 3
    fuzzy_threshold: float = 92.0
    event_year_tolerance: int = 1
    chunk_k: int = 20
    hops: int = 2
    max_paths: int = 400
    year_slack: int = 5
    max_degree: str | int | None = "p99"
    path_hops: int = 4
    path_degree: int = 200
    path_limit: int = 5
    ppr_alpha: float = 0.85
    ppr_iterations: int = 100
    ppr_tolerance: float = 1e-6
    ppr_top_n: int = 25
    top_chunks: int = 8
    overview_top_chunks: int = 12
    context_max_tokens: int = 1200
    max_sources: int = 8
    max_entities: int = 12
    max_relations: int = 25
    rerank_top: int = 30
    rrf_k: int = 60
    evidence_boost: float = 1.3
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    passage_chars: int = 700
    passage_overlap: int = 120
    passage_k: int = 5
    history_turns: int = 6
    fusion: dict[str, tuple[float, float, float]] = field(default_factory=_fusion)
    #: Where documents and behaviour of the replaced engine differ, follow its behaviour instead of its documents.
    strict: bool = False

    def weights(self, intent: str, mode: str = "graph") -> tuple[float, float, float]:
        """Fusion weights of an intent; vector mode uses the vector list alone."""
        return (1.0, 0.0, 0.0) if mode == "vector" else self.fusion.get(intent, (0.5, 0.5, 0.0))


DEFAULT = Config()
