"""Layered configuration: defaults, files over them, checks (CFG-1 to CFG-4, SRC-13, NDG-9)."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Strategy:
    enabled: bool = True
    protected_tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class Purge(Strategy):
    turns: int = 4


@dataclass(frozen=True)
class Compress:
    permission: str = "allow"
    max_context: int | str = 150_000
    min_context: int | str = 50_000
    model_max: dict[str, int | str] = field(default_factory=dict)
    model_min: dict[str, int | str] = field(default_factory=dict)
    nudge_frequency: float = 5
    iteration_threshold: float = 15
    protected_tools: tuple[str, ...] = ()
    protect_user_messages: bool = False
    nudge_force: str = "soft"


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    debug: bool = False
    manual: bool = False
    automatic_strategies: bool = True
    allow_subagents: bool = False
    protect_turns: int = 0
    protected_paths: tuple[str, ...] = ()
    compress: Compress = field(default_factory=Compress)
    deduplicate: Strategy = field(default_factory=Strategy)
    purge_errors: Purge = field(default_factory=Purge)


def parse_jsonc(text: str) -> dict[str, Any]:
    """SRC-13: JSON with comments and trailing commas; strings are left as they are."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", bare))


def merge(base: Any, layer: dict[str, Any]) -> Any:
    """CFG-2: scalars override, lists are united in order, nested parts merge; unknown keys are left out."""
    known = {f.name for f in fields(base)}
    new: dict[str, Any] = {}
    for key, value in layer.items():
        if key not in known:
            continue
        old = getattr(base, key)
        if is_dataclass(old):
            new[key] = merge(old, value)
        elif isinstance(old, tuple):
            new[key] = tuple(dict.fromkeys([*old, *value]))
        elif isinstance(old, dict):
            new[key] = {**old, **value}
        else:
            new[key] = value
    return replace(base, **new)


def load(*layers: dict[str, Any]) -> Config:
    """CFG-1: layers over the defaults, the last one strongest."""
    out = Config()
    for layer in layers:
        out = merge(out, layer)
    return out


def unknown_keys(layer: dict[str, Any], base: Any = None, at: str = "") -> list[str]:
    """CFG-4: keys that no setting has; maps of models are not searched."""
    base = Config() if base is None else base
    known, out = {f.name: getattr(base, f.name) for f in fields(base)}, []
    for key, value in layer.items():
        path = f"{at}{key}"
        if key not in known:
            out.append(path)
        elif is_dataclass(known[key]) and isinstance(value, dict):
            out += unknown_keys(value, known[key], f"{path}.")
    return out


def type_errors(layer: dict[str, Any], base: Any = None, at: str = "") -> list[str]:
    """CFG-3: values of another type than the default, or out of range."""
    base = Config() if base is None else base
    known, out = {f.name: getattr(base, f.name) for f in fields(base)}, []
    for key, value in layer.items():
        path = f"{at}{key}"
        if key not in known:
            continue
        old = known[key]
        if is_dataclass(old):
            out += type_errors(value, old, f"{path}.") if isinstance(value, dict) else [f"{path}: object expected"]
        elif key == "nudge_force":
            out += [] if value in ("soft", "strong") else [f"{path}: soft or strong expected"]
        elif key == "permission":
            out += [] if value in ("ask", "allow", "deny") else [f"{path}: ask, allow or deny expected"]
        elif key in ("max_context", "min_context"):
            out += [] if _limit(value) else [f"{path}: number or percentage expected"]
        elif isinstance(old, bool):
            out += [] if isinstance(value, bool) else [f"{path}: boolean expected"]
        elif isinstance(old, int | float):
            out += [] if isinstance(value, int | float) and not isinstance(value, bool) and value >= 0 else [f"{path}: number from 0 expected"]
        elif key in ("model_max", "model_min"):
            limits = value.items() if isinstance(value, dict) else []
            out += [] if isinstance(value, dict) else [f"{path}: object expected"]
            out += [f"{path}.{k}: number or percentage expected" for k, v in limits if not _limit(v)]
        elif isinstance(old, str):
            out += [] if isinstance(value, str) else [f"{path}: string expected"]
        elif isinstance(old, tuple):
            out += [] if isinstance(value, list | tuple) and all(isinstance(x, str) for x in value) else [f"{path}: list of strings expected"]
    return out


def _limit(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, str) and re.fullmatch(r"\d+(\.\d+)?%", value) is not None


def at_least_one(x: float | None) -> int:
    """NDG-9: a frequency or threshold as a whole number from 1."""
    return max(1, int(x or 1))


def as_dict(config: Config) -> dict[str, Any]:
    return asdict(config)
