"""Settings from a file and the environment: a file's value holds over the environment's, that over the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

from lodestrand.operators.ranking import DEFAULT_WEIGHTS

#: Ranges of a search request.
RANGES = {"top_k": (1, 100), "candidate_depth": (1, 500), "rrf_k": (1, 1000)}


def flag(name: str, default: bool = False, env: dict[str, str] | None = None) -> bool:
    raw = (os.environ if env is None else env).get(name)
    return default if raw is None else raw.strip().lower() in ("1", "true", "yes", "on")


def read_env_file(path: str) -> dict[str, str]:
    """NAME=value lines; comments and blank lines are left out, an absent file is empty."""
    p = Path(path)
    lines = p.read_text().splitlines() if p.exists() else []
    pairs = [x.split("=", 1) for x in lines if "=" in x and not x.lstrip().startswith("#")]
    return {k.strip(): v.strip().strip("'\"") for k, v in pairs}


@dataclass(frozen=True)
class Settings:
    top_k: int = 10
    candidate_depth: int = 50
    rrf_k: int = 60
    data_root: str = "data"

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")

    @classmethod
    def load(cls, file: str = ".env", env: dict[str, str] | None = None) -> Settings:
        found = dict(os.environ if env is None else env) | read_env_file(file)
        named = {f.name: type(f.default)(found[f.name.upper()]) for f in fields(cls) if f.name.upper() in found}
        return cls(**named)


def weights(env: dict[str, str] | None = None) -> dict[str, float]:
    """Weights of the sources, each default replaced by RRF_WEIGHT_<SOURCE>."""
    found = os.environ if env is None else env
    return {s: float(found.get(f"RRF_WEIGHT_{s.upper()}", w)) for s, w in DEFAULT_WEIGHTS.items()}
