"""Named defaults of the workflow, validated."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Expansion:
    seed_k: int = 20
    final_k: int = 20
    direction: str = "both"
    weight: float = 0.8
    mode: str = "max"
    cap: int | None = None

    def __post_init__(self):
        if self.direction not in ("both", "outgoing", "incoming") or self.mode not in ("max", "sum"):
            raise ValueError("direction or mode unknown")
        if self.seed_k <= 0 or self.final_k <= 0 or self.weight < 0 or (self.cap is not None and self.cap < 0):
            raise ValueError("expansion parameters out of range")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    keep_votes: int = 4
    judge_votes: int = 3
    rrf_k: int = 60
    union_k: int = 200
    cutoffs: tuple[int, ...] = (5, 10, 20)


@dataclass(frozen=True)
class Sampling:
    """n of 0 takes all rows."""

    mode: str = "random"
    n: int = 0
    seed: int = 13
    low_overlap: float = 0.15

    MODES = ("random", "low_overlap", "multi_ref_source", "target_definition_or_condition", "mixed_difficulty", "hard_enriched")

    def __post_init__(self):
        if self.mode not in self.MODES or self.n < 0:
            raise ValueError("sampling mode or size unknown")


@dataclass(frozen=True)
class Generation:
    """Rows to sample, pairs to use (0: all) and questions for each pair and persona."""

    rows: int = 0
    pairs: int = 0
    per_pair: int = 2


# Sizes of the presets.
PRESETS = {"smoke": Generation(5, 5, 1), "dev": Generation(50, 50, 2), "paper": Generation(500, 500, 2), "full": Generation(1000, 0, 2)}


def with_preset(given: Generation, name: str | None) -> Generation:
    """A preset's values wherever the given ones are still at their defaults."""
    if name is None:
        return given
    base, preset = Generation(), PRESETS[name]
    return replace(given, **{f.name: getattr(preset, f.name) for f in fields(Generation) if getattr(given, f.name) == getattr(base, f.name)})


@dataclass(frozen=True)
class Split:
    train: float = 0.70
    dev: float = 0.15
    seed: int = 42

    def __post_init__(self):
        if self.train < 0 or self.dev < 0 or self.train + self.dev > 1:
            raise ValueError("shares of a split out of range")


@dataclass(frozen=True)
class Judge:
    """Passes over each item, the pass mark, retries of a call and the pause between calls in seconds."""

    passes: int = 1
    pass_mark: int = 7
    retries: int = 2
    pause: float = 0.15
    least_majority: float = 0.67
    least_weighted: float = 0.70
    least_confidence: float = 0.75


@dataclass(frozen=True)
class Quality:
    """The gate of cross-reference texts, and the least passage."""

    least_chars: int = 40
    most_chars: int = 12_000
    least_letters: float = 0.35
    most_dots: float = 0.22
    passage_chars: int = 25
    passage_words: int = 4


@dataclass(frozen=True)
class Audit:
    """Items for annotators; groups below ``small`` are named in the report."""

    n: int = 200
    seed: int = 13
    small: int = 5


@dataclass(frozen=True)
class Pilot:
    n: int = 50
    seed: int = 13
    suffix: str = "pilot"


@dataclass(frozen=True)
class Cleaning:
    """References kept after cleaning (0: all), and whether repeated pairs go."""

    top_k: int = 0
    dedup_pair: bool = True


@dataclass(frozen=True)
class Config:
    """The whole workflow's parameters; ``final_basis`` names the cohort that is exported."""

    retrieval: Retrieval = field(default_factory=Retrieval)
    expansion: Expansion = field(default_factory=Expansion)
    sampling: Sampling = field(default_factory=Sampling)
    generation: Generation = field(default_factory=Generation)
    split: Split = field(default_factory=Split)
    judge: Judge = field(default_factory=Judge)
    quality: Quality = field(default_factory=Quality)
    audit: Audit = field(default_factory=Audit)
    pilot: Pilot = field(default_factory=Pilot)
    cleaning: Cleaning = field(default_factory=Cleaning)
    final_basis: str = "dependency_valid"
    corpora: tuple[str, ...] = ()

    def __post_init__(self):
        if self.final_basis not in ("dependency_valid", "answer_valid"):
            raise ValueError("no such final cohort")


def from_dict(raw: dict[str, Any]) -> Config:
    """A configuration from nested values; names that no section has are an error."""
    parts = {f.name: f for f in fields(Config)}
    unknown = set(raw) - set(parts)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    out: dict[str, Any] = {}
    for name, value in raw.items():
        kind = type(getattr(Config(), name))
        if hasattr(kind, "__dataclass_fields__"):
            extra = set(value or {}) - set(kind.__dataclass_fields__)
            if extra:
                raise ValueError(f"unknown values of {name}: {sorted(extra)}")
            out[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in (value or {}).items()})
        else:
            out[name] = tuple(value) if isinstance(value, list) else value
    return Config(**out)


def load(path: str) -> Config:
    """A configuration from a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        import json

        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text) or {})


def corpus_of(raw: dict[str, Any], known: tuple[str, ...] = ()) -> str:
    """The corpus a configuration is for: that of its adapter section, else the one at the top."""
    section = raw.get("adapter")
    name = (section.get("corpus") if isinstance(section, dict) else None) or raw.get("corpus")
    if not name or (known and name not in known):
        raise ValueError("the configuration names no known corpus")
    return name
