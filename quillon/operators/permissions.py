"""Ordered permission rules, of which the last match wins: PRD-8 to PRD-14.

Rules are configuration, so they are flattened and compiled on the driver; what
runs over rows is one CASE of regex tests.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import wildcard_regex

ACTIONS = ("ask", "allow", "deny")
#: Permissions as configured: an action, or actions by pattern, for each permission name.
Permissions = Mapping[str, str | Mapping[str, str]]


class Rule(NamedTuple):
    permission: str
    pattern: str
    action: str


def flatten_rules(*configs: Permissions | None) -> list[Rule]:
    """PRD-10: the rules of several configurations in order; unknown actions leave."""
    out = []
    for config in configs:
        for permission, value in (config or {}).items():
            patterns = {"*": value} if isinstance(value, str) else value
            out += [Rule(permission, p, a) for p, a in patterns.items() if a in ACTIONS]
    return out


def wildcard_match(value: str, pattern: str) -> bool:
    """PRD-8 on the driver."""
    return re.match(wildcard_regex(pattern).replace(r"\z", r"\Z"), value.replace("\\", "/")) is not None


def wildcard_column(value: Column, pattern: str) -> Column:
    """PRD-8 over rows: ``*`` anything, ``?`` one character; a last `` *`` may be missing."""
    return F.lit(True) if pattern == "*" else F.regexp_replace(value, F.lit(r"\\"), F.lit("/")).rlike(wildcard_regex(pattern))


def last_match(permission: Column, target: Column, rules: list[Rule]) -> Column:
    """PRD-9: pattern and action of the last rule whose permission and pattern match; null without one."""
    out: Column | None = None
    for rule in reversed(rules):
        hit = wildcard_column(permission, rule.permission) & wildcard_column(target, rule.pattern)
        said = F.struct(F.lit(rule.pattern).alias("pattern"), F.lit(rule.action).alias("action"))
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return F.lit(None).cast("struct<pattern:string,action:string>") if out is None else out


def disabled_by_rules(permission: str, rules: list[Rule]) -> bool:
    """PRD-11: whether the last rule that names the permission denies it for every target."""
    named = [r for r in rules if wildcard_match(permission, r.permission)]
    return bool(named) and (named[-1].pattern, named[-1].action) == ("*", "deny")


def effective(base: str, override: str | None, permission: str, everyone: Permissions | None = None, agents: Mapping[str, Permissions] | None = None, agent: str | None = None) -> str:
    """PRD-12, PRD-14: an override beats the configuration; a base of deny stays, and so do rules that deny: everyone's and then the agent's."""
    chosen = override or base
    if base == "deny" or chosen == "deny":
        return "deny"
    return "deny" if disabled_by_rules(permission, flatten_rules(everyone, (agents or {}).get(agent or ""))) else chosen


def effective_by_agent(agent: Column, base: str, permission: str, everyone: Permissions | None, agents: Mapping[str, Permissions]) -> Column:
    """PRN-20: the effective permission of each row's agent; one test for each configured agent."""
    out = F.lit(effective(base, None, permission, everyone))
    for name in agents:
        out = F.when(agent == name, effective(base, None, permission, everyone, agents, name)).otherwise(out)
    return out


def has_explicit(config: Permissions | None, tool: str) -> bool:
    """PRD-13: whether a configuration names the tool itself."""
    return tool in (config or {})
