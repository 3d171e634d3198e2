"""Rule tables and thresholds.  YAML files with the same names in another folder replace the tables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from functools import cached_property
from pathlib import Path
from typing import Any

import yaml

HERE = Path(__file__).parent
LEVELS = ("taxonomie_niveau_1", "taxonomie_niveau_2", "taxonomie_niveau_3", "taxonomie_niveau_4")


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    quarantine_anomaly_rate: float = 0.60
    max_ean_missing_rate: float = 0.30
    max_url_unreachable_rate: float = 0.30
    min_publishable_rate: float = 0.10
    min_label_confidence: float = 0.80
    min_taxonomy_confidence: float = 0.85
    merge: float = 0.86
    reject: float = 0.72
    max_exact_block: int = 400
    window: int = 100


@dataclass(frozen=True)
class CategoryRate:
    expected: float
    tolerated: tuple[float, ...] = ()

    @property
    def accepted(self) -> tuple[float, ...]:
        return (self.expected, *self.tolerated)


@dataclass(frozen=True)
class Family:
    expected: float
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class Suffix:
    value: str
    target_field: str
    extracted_value: str


@dataclass(frozen=True)
class RuleSet:
    """Everything that the rules read.  Order in the tables is significant."""

    paths: tuple[tuple[str, ...], ...]
    keywords: dict[str, tuple[str, ...]]
    legal_rates: tuple[float, ...]
    categories: dict[str, CategoryRate]
    families: dict[str, Family]
    suffixes: tuple[Suffix, ...]
    thresholds: Thresholds = field(default_factory=Thresholds)

    @classmethod
    def load(cls, folder: str | Path = HERE, **thresholds: Any) -> RuleSet:
        """Reads the three tables; a file that holds no mapping raises ValueError."""
        taxonomy, vat, labels = (_mapping(Path(folder) / name) for name in ("taxonomy.yaml", "vat_rules.yaml", "label_suffixes.yaml"))
        return cls(
            paths=tuple(tuple(p) for p in taxonomy["paths"]),
            keywords={k: tuple(str(t).upper() for t in v) for k, v in taxonomy["keywords"].items()},
            legal_rates=tuple(float(r) for r in vat["legal_rates_fr"]),
            categories={k: CategoryRate(float(v["expected"]), tuple(map(float, v.get("tolerated") or ()))) for k, v in vat["expected_by_category"].items()},
            families={k: Family(float(v["expected"]), tuple(str(t).upper() for t in v["tokens"])) for k, v in vat["keyword_families"].items()},
            suffixes=tuple(Suffix(**s) for s in labels["suffixes"]),
            thresholds=replace(Thresholds(), **thresholds),
        )

    @cached_property
    def by_leaf(self) -> dict[str, tuple[str, ...]]:
        return {p[3]: p for p in self.paths}


def _mapping(path: Path) -> dict[str, Any]:
    content = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(content, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return content


@dataclass(frozen=True)
class Settings:
    """What a deployment sets: read from variables `SHELFWISE_<FIELD>`; a value that does not fit its type raises ValueError."""

    network: bool = False
    model: str = "none"
    max_calls: int = 500
    max_cost_usd: float = 5.0
    cache_hours: int = 24

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "SHELFWISE_") -> Settings:
        found, given = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = found.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            if kind is bool:
                if raw.lower() not in ("0", "1", "true", "false"):
                    raise ValueError(f"{prefix}{f.name.upper()} is neither true nor false: {raw!r}")
                given[f.name] = raw.lower() in ("1", "true")
            else:
                given[f.name] = kind(raw)
        return cls(**given)
