"""Rulesets: which rules run, at which severity."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from lintmill.rules.catalog import RULES, SEVERITIES, preset

LEVELS = ("error", "warning", "info", "inherit", "none")
_RANK = {"error": 1, "warning": 2, "info": 3, "information": 3, "hint": 4}


class ConfigError(ValueError):
    """A setting, ruleset or path that can't be used."""


@dataclass(frozen=True)
class Ruleset:
    """Levels by rule id.  As a whitelist, rules that are not listed are off."""

    levels: dict[str, str] = field(default_factory=dict)
    whitelist: bool = True

    @staticmethod
    def of_preset(name: str) -> "Ruleset":
        return Ruleset(dict.fromkeys(sorted(preset(name)), "inherit"))

    @staticmethod
    def of_rule(rule: str) -> "Ruleset":
        """A single rule, whatever the base says."""
        if rule not in RULES:
            raise ConfigError(f"unknown rule {rule}")
        return Ruleset({rule: "inherit"})

    @staticmethod
    def of_json(text: str) -> "Ruleset":
        """``{"rules": [{"id": .., "severity": ..}]}``; a later entry of the same id wins."""
        levels = {}
        for r in json.loads(text).get("rules", []):
            level = (r.get("severity") or "inherit").lower()
            if level not in LEVELS:
                raise ConfigError(f"unknown severity {level}")
            levels[r["id"]] = level
        return Ruleset(levels)

    def with_plugins(self, ids: list[str]) -> "Ruleset":
        """Rules of plug-ins take part in a whitelist unless it says otherwise."""
        return Ruleset({**dict.fromkeys(ids, "inherit"), **self.levels}, self.whitelist) if self.whitelist else self

    def with_overrides(self, overrides: dict[str, str]) -> "Ruleset":
        """Levels of a configuration come last."""
        for level in overrides.values():
            if level.lower() not in LEVELS:
                raise ConfigError(f"unknown severity {level}")
        return Ruleset({**self.levels, **{k: v.lower() for k, v in overrides.items()}}, self.whitelist)

    def enabled(self, rule: str) -> bool:
        level = self.levels.get(rule, "none" if self.whitelist else "inherit")
        return level != "none"

    def severity(self, rule: str) -> int | None:
        """The severity that the ruleset imposes, None to inherit."""
        return _RANK.get(self.levels.get(rule, "inherit"))


def resolve(
    rule: str | None = None,
    preset_name: str | None = None,
    ruleset: Ruleset | None = None,
    config_preset: str | None = None,
    config_ruleset: Ruleset | None = None,
    overrides: dict[str, str] | None = None,
    plugins: list[str] | None = None,
) -> Ruleset:
    """The first that is given, in this order, else ``recommended``; then plug-ins and overrides (a single rule stands alone)."""
    if rule is not None:
        return Ruleset.of_rule(rule)
    if preset_name is not None:
        base = Ruleset.of_preset(preset_name)
    elif ruleset is not None:
        base = ruleset
    elif config_preset is not None:
        base = Ruleset.of_preset(config_preset)
    elif config_ruleset is not None:
        base = config_ruleset
    else:
        base = Ruleset.of_preset("recommended")
    return base.with_plugins(plugins or []).with_overrides(overrides or {})


def severity_rank(name: str) -> int:
    return _RANK[name.lower()] if name.lower() in _RANK else SEVERITIES[name.lower()]
