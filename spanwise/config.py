"""Configuration of a pipeline: strict, frozen, with hashes that name it."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigError

#: Settings of old files that mean nothing any more.  Fixed values.
IGNORED = {"evaluation": {"judge_enabled", "judge_model", "judge_temperature"}}


# The names and defaults below are those of the published configuration: fixed values.


@dataclass(frozen=True)
class Part:
    kind: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Retrieval:
    kind: str = "dense"
    top_k: int = 4
    fetch_k: int = 30
    k_rrf: int = 60
    deduplicate: bool = False
    dedupe_threshold: float = 0.8


@dataclass(frozen=True)
class Generator:
    kind: str = "scripted"
    prompt_template: str = "Answer from the excerpts and cite them.\n\n{{ context }}\n\n{{ question }}\n"
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Evaluation:
    hit_coverage_threshold: float = 0.5
    recall_at_k: tuple[int, ...] = (1, 3, 5, 10)
    bootstrap_resamples: int = 10_000


@dataclass(frozen=True)
class Config:
    name: str
    description: str = ""
    seed: int = 20260806
    chunker: Part = Part("fixed_size")
    embedder: Part = Part("tfidf_svd")
    retrieval: Retrieval = Retrieval()
    generator: Generator = Generator()
    evaluation: Evaluation = Evaluation()

    @property
    def config_hash(self) -> str:
        return short_hash(dataclasses.asdict(self))

    @property
    def pipeline_hash(self) -> str:
        """Of what changes the output only: not of name, description and evaluation."""
        full = dataclasses.asdict(self)
        return short_hash({k: full[k] for k in ("chunker", "embedder", "retrieval", "generator", "seed")})


def canonical_json(value: Any) -> str:
    """One text for equal values, whatever the order of keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def short_hash(value: Any, digits: int = 12) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()[:digits]


def merged(base: Mapping, over: Mapping) -> dict:
    """*base* with the values of *over*; mappings are merged key by key, all else is replaced."""
    both = {k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}
    return {**base, **both}


_TYPES = {"chunker": Part, "embedder": Part, "retrieval": Retrieval, "generator": Generator, "evaluation": Evaluation}


def _build(cls: type, raw: Mapping, where: str) -> Any:
    names = {f.name for f in dataclasses.fields(cls)}
    if unknown := set(raw) - names:
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
    try:
        return cls(**values)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def parse_config(raw: Mapping, where: str = "config") -> Config:
    raw = {k: {x: y for x, y in v.items() if x not in IGNORED.get(k, ())} if isinstance(v, Mapping) else v for k, v in raw.items()}
    parts = {k: _build(cls, raw[k] or {}, f"{where}: {k}") for k, cls in _TYPES.items() if k in raw}
    return _build(Config, {**raw, **parts}, where)


def load_config(path: str | Path) -> Config:
    """A YAML configuration.  It may extend one other file, which extends none; unknown keys are errors."""
    import yaml

    path = Path(path)

    def read(p: Path) -> dict:
        if not p.exists():
            raise ConfigError(f"no such configuration: {p}")
        return yaml.safe_load(p.read_text("utf-8")) or {}

    raw = read(path)
    if parent := raw.pop("extends", None):
        base = read(path.parent / parent)
        if "extends" in base:
            raise ConfigError(f"{parent} extends a file too; one level is allowed")
        raw = merged(base, raw)
    return parse_config(raw, path.name)
