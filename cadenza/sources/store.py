"""Models and saved queries as YAML files in a folder."""

from __future__ import annotations

import dataclasses
from pathlib import Path
from typing import Any

import yaml

from ..semantics import Model, Query


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value):
        out = {}
        for f in dataclasses.fields(value):
            v = getattr(value, f.name)
            default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else None
            if f.name not in ("frame", "aggregated", "origins") and v != default:
                out[f.name] = _plain(v)
        return out
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def save(engine, folder: str) -> None:
    for kind, things in (("models", engine.models), ("queries", engine.saved)):
        (Path(folder) / kind).mkdir(parents=True, exist_ok=True)
        for name, thing in things.items():
            (Path(folder) / kind / f"{name}.yaml").write_text(yaml.safe_dump(_plain(thing), sort_keys=False, allow_unicode=True))


def load(engine, folder: str) -> None:
    for path in sorted((Path(folder) / "models").glob("*.yaml")):
        engine.add(Model.of(yaml.safe_load(path.read_text())))
    for path in sorted((Path(folder) / "queries").glob("*.yaml")):
        engine.saved[path.stem] = tuple(Query.of(q) for q in yaml.safe_load(path.read_text()))
