"""Gates and tolerances. Each can be set by an environment variable SPANWRIGHT_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Gates:
    """Distances in points on a sheet (pt) or feet in the model (ft), angles in degrees."""

    match_pt: float = 16.0
    mismatch_pt: float = 40.0
    wall_match_pt: float = 60.0
    wall_mismatch_pt: float = 120.0
    match_ft: float = 2.0
    mismatch_ft: float = 6.0
    cluster_ft: float = 3.0
    level_ft: float = 8.0
    ambiguity_ft: float = 1.0
    ceiling: float = 3.0
    wall_match_ft: float = 4.0
    wall_mismatch_ft: float = 12.0
    orientation_deg: float = 20.0
    context_samples: int = 2
    context_share: float = 0.6
    band_ft: float = 6.0

    @classmethod
    def from_env(cls) -> Gates:
        given = {f.name: os.environ.get(f"SPANWRIGHT_{f.name.upper()}") for f in fields(cls)}
        return cls(**{n: (int if n == "context_samples" else float)(v) for n, v in given.items() if v})
