"""Settings of an audit: an immutable value passed to the plans, never a module global."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    """What a caller may change; ``as_of_year`` keeps year checks independent of the clock."""

    as_of_year: int = 2026
    protected_terms: tuple[str, ...] = ("LaTeX", "TeX", "Bayesian", "Markov", "Gaussian", "Hamiltonian", "Fourier", "Hilbert", "Ising", "Monte", "Poisson", "Python")
    severity: dict = field(default_factory=dict)
    search_hits: int = 8
    contexts_per_entry: int = 3


def load_settings(paths: list[str]) -> Settings:
    """The first existing JSON file of ``paths``; unknown keys are ignored, no file gives the defaults."""
    for path in paths:
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                raw = json.load(f)
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Settings.__dataclass_fields__}
            return replace(Settings(), **known)
    return Settings()
