"""Settings of the pipelines, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Settings:
    # Defaults that results depend on.
    confidence_level: float = 0.95
    top_n: int = 10
    significance_alpha: float = 0.05
    min_videos_per_partition: int = 3
    zone_policy: str = "hot_only"
    temporal_grouping: bool = False
    temporal_granularity: str = "year"
    fixed_step: int = 30
    min_segment_samples: int = 30
    context_seconds: float = 5.0
    context_tokens: int = 200
    low_consensus_weight: float = 0.2
    consensus_high_below: float = 0.2
    consensus_medium_below: float = 0.6
    pelt_penalty: float = 1.0

    def with_overrides(self, overrides: dict) -> "Settings":
        """Known keys with a usable type replace defaults; others are ignored."""
        mine = asdict(self)
        good = {k: type(mine[k])(v) for k, v in overrides.items() if k in mine and isinstance(v, (int, float, str)) and not isinstance(v, bool)}
        return replace(self, **good)


DEFAULT = Settings()
