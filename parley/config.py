"""Typed configuration with a fallback for each field (CP-25) and prompt templates (SC-27)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from parley.operators.runs import BUDGETS


@dataclass(frozen=True)
class Config:
    model: str = "gpt-4o-mini"
    retry_attempts: int = 3
    retry_base_ms: int = 400
    log_bytes: int = 5_242_880
    log_backups: int = 5
    budgets: dict = field(default_factory=lambda: dict(BUDGETS))
    #: USD for 1000 tokens in and out by model; a deployment adds its own models.
    prices: dict = field(default_factory=lambda: {"gpt-4o-mini": (0.00015, 0.0006)})


def load(text: str | None) -> Config:
    """The configuration of a JSON text; a field that is absent or of the wrong type keeps its default,
    and a text that is no JSON object gives the defaults."""
    try:
        raw = json.loads(text or "")
    except ValueError:
        raw = {}
    base = Config()
    if not isinstance(raw, dict):
        return base
    known = {f.name: getattr(base, f.name) for f in fields(Config)}
    return Config(**{k: raw[k] if k in raw and type(raw[k]) is type(v) else v for k, v in known.items()})


def fill(template: str, values: dict[str, str]) -> str:
    """{{name}} replaced by its value; an unknown name by nothing."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values.get(m[1], "")), template)
