"""Typed settings with environment overrides."""

from __future__ import annotations

import dataclasses
import os
from collections.abc import Mapping
from typing import Any

PREFIX = "CODEXMILL_"


@dataclasses.dataclass(frozen=True)
class Settings:
    vector_query_k: int = 50
    cascade_hops: int = 3
    cascade_nodes: int = 100
    big_chunk: int = 3000
    big_overlap: int = 300
    small_chunk: int = 512
    small_overlap: int = 80
    rrf_k: int = 60
    evidence_per_node: int = 3
    evidence_per_field: int = 2
    evidence_region: int = 200
    rerank_cap: int = 120
    mmr_lambda: float = 0.75
    recluster_every: int = 10
    match_threshold: float = 0.45
    embed_model: str = ""
    embed_dim: int = 768
    embed_api_key: str = ""
    llm_api_key: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        return cls().overridden({k[len(PREFIX) :].lower(): v for k, v in env.items() if k.startswith(PREFIX)})

    def overridden(self, values: Mapping[str, Any]) -> Settings:
        """With the known keys of ``values``; what can't be read is passed over, whole numbers are 0 at least."""
        new = {}
        for field in dataclasses.fields(self):
            if field.name in values:
                kind = type(getattr(self, field.name))
                try:
                    new[field.name] = max(0, int(values[field.name])) if kind is int else kind(values[field.name])
                except (TypeError, ValueError):
                    continue
        return dataclasses.replace(self, **new)

    def patched(self, values: Mapping[str, Any]) -> Settings:
        """As overridden, but blank secrets leave the old ones in place."""
        return self.overridden({k: v for k, v in values.items() if not (k.endswith("_api_key") and not str(v).strip())})

    def redacted(self) -> dict[str, Any]:
        return {k: "" if k.endswith("_api_key") else v for k, v in dataclasses.asdict(self).items()}


def clamp_limit(limit: int, low: int = 1, high: int = 200) -> int:
    return max(low, min(high, int(limit)))
