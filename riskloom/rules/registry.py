"""Finds the rule plug-ins: the built-in ones plus whatever installed packages declare as entry points."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from importlib import metadata

from riskloom.rules import risk, validation

VALIDATION_GROUP = "riskloom.validation_rules"
RISK_GROUP = "riskloom.risk_rules"


def _installed(group: str) -> list:
    return [entry.load()() for entry in metadata.entry_points(group=group)]


def _ordered(found: list, kind: str, required: bool) -> list:
    if required and not found:
        raise RuntimeError(f"no {kind} rule found; refusing to run without any")
    names = [rule.name for rule in found]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"{kind} rule names must be unique: {', '.join(repeated)}")
    return sorted(found, key=lambda rule: rule.name)


def validation_rules(extra: Iterable = (), *, built_in: bool = True, required: bool = True) -> list:
    """Validation rules sorted by name; the order fixes the order of codes in a dead letter."""
    found = [cls() for cls in validation.BUILT_IN] if built_in else []
    return _ordered(found + _installed(VALIDATION_GROUP) + list(extra), "validation", required)


def risk_rules(
    settings: Mapping[str, str] | None = None, extra: Iterable = (), *, built_in: bool = True, required: bool = True
) -> list:
    """Risk rules sorted by name and configured; the order fixes the order of reasons in a result."""
    found = [cls() for cls in risk.BUILT_IN] if built_in else []
    rules = _ordered(found + _installed(RISK_GROUP) + list(extra), "risk", required)
    for rule in rules:
        rule.configure(settings or {})
    return rules
