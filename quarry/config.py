"""Every constant the operators use, in one place.

The values below are fixed values taken from the behaviour being reproduced
(thresholds, weights, priors, caps, templates' parameters). Change them only
through a new ``RetrievalConfig`` instance.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: fan-out list weights (relation questions / other questions)
RELATION_LIST_WEIGHTS = {"full": 0.9, "name_boost": 1.8, "entity": 1.5, "pair": 2.0, "rel": 2.0, "vs": 2.0}
DEFAULT_LIST_WEIGHTS = {"full": 1.0, "name_boost": 1.4, "entity": 1.3, "pair": 1.2, "rel": 1.2, "vs": 1.2}
# ---- fixed values: document type prior and subfamily hint prior
TYPE_PRIOR = {"KPI": 1.08, "Objective": 1.0, "Criteria": 1.0}
SUBFAMILY_PRIOR = {"operational efficiency": 1.10, "data quality": 1.08, "data monetization": 1.06}
# ---- fixed values: evaluation grid
GRID_KS = (1, 2, 3, 4, 5, 7, 10)
GRID_THRESHOLDS = (0.1, 0.2, 0.25, 0.3, 0.35, 0.5, 0.7, 0.9)


@dataclass(frozen=True)
class RetrievalConfig:
    # retrieval sizes
    k: int = 3
    k_init: int = 30
    pool_cap: int = 20
    # fusion
    rrf_k: int = 60
    rrf_weight: float = 0.5
    co_mention_bonus: float = 0.15
    relation_weights: dict = field(default_factory=lambda: dict(RELATION_LIST_WEIGHTS))
    default_weights: dict = field(default_factory=lambda: dict(DEFAULT_LIST_WEIGHTS))
    type_prior: dict = field(default_factory=lambda: dict(TYPE_PRIOR))
    subfamily_prior: dict = field(default_factory=lambda: dict(SUBFAMILY_PRIOR))
    # re-rank
    temperature: float = 1.6
    entity_prior: float = 0.6
    entity_name_boost: float = 2.0
    mmr_lambda: float = 0.5
    mmr_top_k: int = 12
    # adaptive selection
    relevance_threshold: float = 0.85
    max_tokens: int = 2000
    min_docs: int = 1
    max_docs_simple: int = 2
    max_docs_complex: int = 5
    anchor_min_prob: float = 0.008
    abstain_top1: float = 0.15
    abstain_top5_sum: float = 0.50
    abstain_gap: float = 0.03
    # question splitting and validation queries: limits of the behaviour being reproduced; the
    # operators return a ``truncated`` flag where one of them cuts something off
    max_question_chars: int = 6000
    max_parts: int = 5
    max_subqs: int = 3
    max_json_items: int = 5
    max_json_chars: int = 200
    concept_words: int = 20
    # gates and validation
    min_similarity: float = 0.40
    api_min_similarity: float = 0.48
    validation_pass: float = 0.60
    validation_partial: float = 0.50
    dense_dim: int = 64
    # physical sizing: questions are broadcast to KB partitions only below this many
    # vector rows (checked with a count); above it the exact blocked product is used
    broadcast_question_rows: int = 50_000
    kb_block_rows: int = 20_000
    question_block_rows: int = 2_048


DEFAULT = RetrievalConfig()
