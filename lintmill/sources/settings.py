"""Configuration files: discovery, layering of formatting options, editor settings."""

from __future__ import annotations

import configparser
import fnmatch
import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from lintmill.formatting.formatter import FormatOptions

CONFIG_DIR = ".lintmill"
CONFIG_NAME = "lintmill.json"
COMPAT_LEVELS = (100, 110, 120, 130, 140, 150, 160)


@dataclass(frozen=True)
class Config:
    compat_level: int = 150
    preset: str | None = None
    ruleset: str | None = None
    rules: dict[str, str] = field(default_factory=dict)
    plugins: tuple = ()
    formatting: dict = field(default_factory=dict)


def parse_config(text: str) -> Config:
    raw = json.loads(text)
    level = raw.get("compatLevel", 150)
    if level not in COMPAT_LEVELS:
        raise ValueError(f"compatLevel must be one of {COMPAT_LEVELS}")
    return Config(level, raw.get("preset"), raw.get("ruleset"), dict(raw.get("rules") or {}), tuple(raw.get("plugins") or ()), dict(raw.get("formatting") or {}))


def find_config(explicit: str | None, cwd: str, home: str) -> Path | None:
    """The explicit file, else the one of the working directory, else the one of the home directory."""
    if explicit:
        return Path(explicit)
    for base in (cwd, home):
        p = Path(base) / CONFIG_DIR / CONFIG_NAME
        if p.is_file():
            return p
    return None


def editor_settings(text: str, path: str) -> dict:
    """Indentation and line end that an editor configuration gives a path; later sections win."""
    p = configparser.ConfigParser(strict=False)
    p.read_string("[__top__]\n" + text)
    out: dict = {}
    name = path.rsplit("/", 1)[-1]
    for section in p.sections():
        patterns = [section]
        if "{" in section and "}" in section:
            head, rest = section.split("{", 1)
            body, tail = rest.split("}", 1)
            patterns = [head + x + tail for x in body.split(",")]
        if section != "__top__" and any(fnmatch.fnmatch(name, q) or fnmatch.fnmatch(path, q) for q in patterns):
            out.update(p[section])
    mapped: dict = {}
    if out.get("indent_style") in ("tab", "space"):
        mapped["indent_style"] = "tabs" if out["indent_style"] == "tab" else "spaces"
    size = out.get("indent_size", "")
    if size == "tab":
        size = out.get("tab_width", "")
    if size.isdigit():
        mapped["indent_size"] = int(size)
    if out.get("end_of_line") in ("lf", "crlf"):
        mapped["line_ending"] = out["end_of_line"]
    return mapped


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def layered_options(config: dict, editor: dict, command: dict) -> tuple[FormatOptions, dict[str, str]]:
    """(options, where each came from): defaults, then configuration, then editor settings, then the command line."""
    o = FormatOptions()
    known = {f.name for f in fields(FormatOptions)}
    source = dict.fromkeys(known, "default")
    for name, layer in (("config", config), ("editor", editor), ("command", command)):
        for k, v in layer.items():
            k = _snake(k)
            if k in known and v is not None:
                o = replace(o, **{k: v})
                source[k] = name
    return o, source


def starter_config() -> str:
    """The file that a new project starts with."""
    return json.dumps({"compatLevel": 150, "preset": "recommended", "rules": {}, "plugins": [], "formatting": {}}, indent=2)


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def print_config(config: Config) -> str:
    """The configuration in force, as JSON."""
    return json.dumps({_camel(f.name): getattr(config, f.name) for f in fields(Config)}, indent=2, default=list)


def print_format_config(options: FormatOptions, source: dict[str, str]) -> str:
    """The formatting options in force and where each came from, as JSON."""
    return json.dumps({_camel(f.name): {"value": getattr(options, f.name), "source": source[f.name]} for f in fields(FormatOptions)}, indent=2)
