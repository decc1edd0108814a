"""Settings of linking, retrieval and evaluation, from defaults, a YAML file or a mapping."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    proposition_k: int = 100
    entity_k: int = 20
    proposition_threshold: float = 0.85
    entity_threshold: float = 0.8
    group_size: int = 20
    beam_depth: int = 6
    beam_width: int = 4
    semantic_weight: float = 0.4
    bridge_weight: float = 0.3
    mmr_weight: float = 0.7
    anchor_k: int = 10
    top_documents: int = 5
    context_documents: int = 20
    max_rounds: int = 5
    max_attempts: int = 2

    @classmethod
    def of(cls, values: dict[str, Any]) -> Settings:
        """Known keys of a mapping, nested sections included; later sections win."""
        flat: dict[str, Any] = {}

        def walk(node: dict[str, Any]) -> None:
            for key, value in node.items():
                if isinstance(value, dict):
                    walk(value)
                else:
                    flat[key] = value

        walk(values)
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in flat.items() if k in names})

    @classmethod
    def load(cls, path: str) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f) or {})

    def save(self, path: str) -> None:
        import yaml

        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(dataclasses.asdict(self), f)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A mapping with the values of ``over`` in place of those of ``base``, section by section."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out
