"""Settings with the defaults of the path service; a file of TOML may change them, unknown names are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace


# Names and defaults are fixed values: users' files name them.


@dataclass(frozen=True)
class Expansion:
    seed_papers: int = 25
    references_per_paper: int = 60
    min_co_citations: int = 3
    max_ancestors: int = 20
    expand_ancestors: bool = True
    ancestor_seeds: int = 12
    forward_enabled: bool = True
    forward_seeds: int = 6
    citations_per_paper: int = 25


@dataclass(frozen=True)
class Graph:
    damping: float = 0.5
    iterations: int = 100
    tolerance: float = 1e-9
    cohort_years: int = 3
    min_cohort: int = 5
    resolution: float = 1.0
    max_path_papers: int = 24


@dataclass(frozen=True)
class Settings:
    candidates_per_provider: int = 25
    max_candidates: int = 300
    rrf_k: int = 60
    strategy: str = "syllabus"
    expansion: Expansion = field(default_factory=Expansion)
    graph: Graph = field(default_factory=Graph)


def _with(base, values: dict):
    known = {f.name: f.type for f in fields(base)}
    for name, value in values.items():
        if name not in known:
            raise ValueError(f"unknown setting {name}")
        old = getattr(base, name)
        if type(old) is not type(value) and not isinstance(value, dict) and not (isinstance(old, float) and isinstance(value, int)):
            raise ValueError(f"setting {name} isn't a {type(old).__name__}")
        base = replace(base, **{name: _with(old, value) if isinstance(value, dict) else value})
    return base


def load(text: str) -> Settings:
    return _with(Settings(), tomllib.loads(text))
