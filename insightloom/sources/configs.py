"""Validated settings of data generation and training, from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

# Fixed values of the default settings.
OVERSIZE = ("ignore", "cut_first", "cut_last", "cut_random")
RATING_FROM = ("mean", "median", "best", "worst")
INITIAL = ("worst", "random")
STEP_OF = ("definition_range", "current_value", "definition_range_then_current_value")
KINDS = ("linear", "quadratic", "logarithmic")


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Named:
    name: str
    lo: float
    hi: float

    def __post_init__(self):
        _check(self.lo < self.hi, f"{self.name}: empty range")


@dataclass(frozen=True)
class NoiseSettings:
    share: float = 0.0  # of the experiments
    mean: float = 0.0
    std_share: float = 0.05

    def __post_init__(self):
        _check(0 <= self.share <= 1 and self.std_share >= 0, "noise shares lie in 0..1")


@dataclass(frozen=True)
class SeriesSettings:
    kind: str = "expert"  # expert or trial
    share: float = 1.0
    max_size: int = 15
    score_threshold: float = 0.05
    max_trial_length: int = 25  # no further parameter is tried from there on
    one_direction: bool = True  # an improving direction is enough
    group_size: int = 1  # qualities improved together
    overlapping: bool = False  # only groups that share a parameter
    max_steps: int = 100_000  # an expert series that is longer raises
    rating_from: str = "mean"
    initial: str = "worst"
    step_of: str = "definition_range"
    step_share: float = 0.1

    def __post_init__(self):
        _check(self.kind in ("expert", "trial"), f"unknown series kind {self.kind}")
        _check(self.rating_from in RATING_FROM and self.initial in INITIAL and self.step_of in STEP_OF, "unknown series option")
        _check(self.max_size >= 2 and 0 <= self.score_threshold < 1, "series bounds")


@dataclass(frozen=True)
class DataSettings:
    """Generation of a synthetic data set; defaults follow the default settings file."""

    n_experiments: int = 500
    parameters: tuple = tuple(Named(f"parameter_{i}", 0.0, 255.0) for i in range(46))
    qualities: tuple = tuple(Named(f"quality_{i}", 0.0, 10.0) for i in range(14))
    correlating_share: float = 0.1
    expert_share: float = 0.75
    function_kinds: tuple = KINDS
    series: tuple = (SeriesSettings(),)
    oversize: str = "ignore"
    noise: NoiseSettings = field(default_factory=NoiseSettings)
    seed: int = 0

    def __post_init__(self):
        _check(self.oversize in OVERSIZE, f"unknown oversize option {self.oversize}")
        _check(set(self.function_kinds) <= set(KINDS), "unknown function kind")
        _check(0 < self.correlating_share <= 1 and 0 < self.expert_share <= 1, "shares lie in 0..1")
        _check(len({p.name for p in (*self.parameters, *self.qualities)}) == len(self.parameters) + len(self.qualities), "names differ")


@dataclass(frozen=True)
class KgSettings:
    encodings: tuple = ("basic",)
    knowledge_share: float = 1.0
    seed: int = 0


@dataclass(frozen=True)
class RunSettings:
    """Exactly one of generated data or a stored graph is given."""

    data: DataSettings | None = None
    stored: str | None = None
    kg: KgSettings = field(default_factory=KgSettings)

    def __post_init__(self):
        _check((self.data is None) != (self.stored is None), "give either data or stored")


_NESTED = {"series": SeriesSettings, "parameters": Named, "qualities": Named}


def _build(cls, raw: dict):
    known = {f.name for f in fields(cls)}
    _check(set(raw) <= known, f"unknown settings {sorted(set(raw) - known)}")
    out = {}
    for k, v in raw.items():
        if cls is DataSettings and k in _NESTED:
            v = tuple(_build(_NESTED[k], x) if isinstance(x, dict) else x for x in v)
        elif cls is DataSettings and k == "noise":
            v = _build(NoiseSettings, v)
        elif cls is RunSettings and k in ("data", "kg") and isinstance(v, dict):
            v = _build(DataSettings if k == "data" else KgSettings, v)
        out[k] = tuple(v) if isinstance(v, list) else v
    return cls(**out)


def load(text: str) -> RunSettings:
    """Settings from JSON text; unknown names and bad ranges raise."""
    return _build(RunSettings, json.loads(text))
