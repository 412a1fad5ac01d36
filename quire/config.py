"""Engine settings with the defaults of the review rules."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class EngineConfig:
    """All thresholds that the operators read; every field is honoured."""

    chunk_size: int = 1500
    overlap: int = 200
    min_chunk_size: int = 500
    max_chunk_size: int = 2500
    chunking_strategy: str = "fixed"
    spellcheck: bool = True
    grammar_check: bool = True
    style_check: bool = True
    section_targets_from_text: bool = False
    image_size_floor: int = 10_000
    llm_threshold: float = 0.95
    llm_min_gain: float = 0.05
    auto_above: float = 0.95
    high_below: float = 0.7
    human_below: float = 0.9
    batch_size: int = 10
    align_threshold: float = 0.7
    suggest_threshold: float = 0.85
    verbosity: str = "normal"
    max_review_items: int = 50
    manual_minutes_per_page: float = 5.0
    embedding_model: str = "all-MiniLM-L6-v2"

    @classmethod
    def from_mapping(cls, values: dict[str, Any]) -> EngineConfig:
        """From a flat or nested mapping, such as a parsed YAML file; unknown keys are an error."""
        flat: dict[str, Any] = {}
        for k, v in values.items():
            flat |= v if isinstance(v, dict) else {k: v}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(flat) - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**flat)


DEFAULT = EngineConfig()
