"""Settings of the engine. Executors never read the environment."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    rel_tolerance: float = 0.005
    lexical_threshold: float = 93.0
    definition_threshold: float = 75.0
    max_upload_mb: int = 50
    primary_pages: int | None = 60  # None: all
    entity_sample: int = 400_000
    all_periods: bool = True  # else pairs of two known, different periods are left to period_contrasts()
