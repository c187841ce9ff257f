"""Findings of one script: rules, directives, severities, fixes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from lintmill.rules import checks
from lintmill.rules.catalog import RULES, Rule
from lintmill.rules.model import TOO_DEEP, Finding, Script
from lintmill.rules.rulesets import Ruleset
from lintmill.syntax import lexer as L
from lintmill.syntax.dialects import too_new

PREFIX = "lintmill"
PLUGIN_API = 2


@dataclass(frozen=True)
class Options:
    """What a run needs on every executor; small and picklable."""

    ruleset: Ruleset = field(default_factory=lambda: Ruleset.of_preset("recommended"))
    compat: int = 150
    threshold: int = 4
    prefix: str = PREFIX
    plugins: tuple = ()  # (Rule, function of Script -> findings)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_plan"}

    def __setstate__(self, state):
        self.__dict__.update(state)


@dataclass
class Diagnostic:
    code: str
    severity: int
    category: str
    fixable: bool
    message: str
    start: tuple[int, int]
    end: tuple[int, int]
    parse_error: bool
    start_offset: int
    end_offset: int
    edits: list | None


def directives(s: Script, prefix: str = PREFIX) -> list[tuple[str | None, int, int | None]]:
    """(rule id or None for all, first line, line before which it ends or None) in order of opening.

    Disable directives of the same id nest; an enable closes the innermost; one that closes
    nothing is ignored; what stays open runs to the end.
    """
    pattern = re.compile(rf"^\s*{re.escape(prefix)}-(disable|enable)(?=[\s:]|$)\s*([^:]*)(?::.*)?$", re.IGNORECASE | re.DOTALL)
    open_: dict[str | None, list[int]] = {}
    out: list[tuple[str | None, int, int | None]] = []
    for tok, at in zip(s.lexemes, s.offsets):
        two = tok[:2]
        if two == "--":
            body = tok[2:]
        elif two == "/*":
            body = tok[2:-2] if tok.endswith("*/") else tok[2:]
        else:
            continue
        m = pattern.match(body)
        if not m:
            continue
        line = s.position(at)[0]
        ids = [x.strip().lower() for x in m.group(2).split(",") if x.strip()] or [None]
        for rule in ids:
            stack = open_.setdefault(rule, [])
            if m.group(1).lower() == "disable":
                out.append((rule, line, None))
                stack.append(len(out) - 1)
            elif stack:
                k = stack.pop()
                out[k] = (rule, out[k][1], line)
    return out


def suppressed(code: str, line: int, ranges: Iterable[tuple[str | None, int, int | None]]) -> bool:
    return any((r is None or r == code.lower()) and a <= line and (z is None or line < z) for r, a, z in ranges)


def _plan(options: Options) -> tuple[set[str], dict[str, list[tuple[str, Callable]]]]:
    """(rules that run, their checks by node type); made once per options object."""
    plan = options.__dict__.get("_plan")
    if plan is None:
        active = {r.id for r in RULES.values() if options.ruleset.enabled(r.id) and options.compat >= r.min_compat}
        by_type = {t: [(r, f) for r, f in fs if r in active] for t, fs in checks.NODE_CHECKS.items()}
        plan = (active, {t: fs for t, fs in by_type.items() if fs})
        object.__setattr__(options, "_plan", plan)
    return plan


def raw_findings(s: Script, options: Options) -> Iterable[Finding]:
    """Findings of all enabled rules; a rule that raises yields an error at the start of the script."""

    active, by_type = _plan(options)
    out: list[Finding] = []
    for b in s.batches:
        for n in b.nodes:
            for rule, f in by_type.get(n.type, ()):
                try:
                    out.extend(_of(b, rule, x) for x in f(b, n))
                except Exception as e:  # noqa: BLE001 - one rule must not stop the others
                    out.append(_broken(rule, e))
        for rule, f in checks.BATCH_CHECKS:
            if rule in active:
                try:
                    out.extend(_of(b, rule, x) for x in f(b))
                except Exception as e:  # noqa: BLE001
                    out.append(_broken(rule, e))
    for rule, f in checks.SCRIPT_CHECKS:
        if rule in active:
            out.extend(_whole(s, rule, f))
    for r, f in options.plugins:
        if options.ruleset.enabled(r.id):
            out.extend(_whole(s, r.id, f))
    return out


def _whole(s: Script, rule: str, f: Callable) -> list[Finding]:
    try:
        found = list(f(s))
    except Exception as e:  # noqa: BLE001
        return [_broken(rule, e)]
    for x in found:
        x.rule = rule
    return found


def _of(b, rule: str, x: checks.At) -> Finding:
    return Finding(rule, b.start(x.a), b.end(x.z), x.message, x.edits, x.severity)


def _broken(rule: str, e: Exception) -> Finding:
    return Finding(rule, 0, 0, f"The rule failed: {type(e).__name__}: {e}", None, 1)


def parse_errors(s: Script) -> list[Finding]:
    if s.open:
        at = len(s.text) - len(s.lexemes[-1])
        return [Finding("parse-error", at, len(s.text), f"The {s.open} is not closed.", None, 1)]
    newer = []
    for b in s.batches:
        late = too_new(b.t, b.k, s.compat) if b.error is None else None
        if late:
            newer.append(Finding("parse-error", b.start(late[0]), b.end(late[0]), f"Syntax of compatibility level {late[1]}.", None, 1))
    return newer + [
        Finding("parser-exception" if b.error[1] == TOO_DEEP else "parse-error", b.start(b.error[0]), b.end(b.error[0]), b.error[1], None, 1)
        for b in s.batches
        if b.error is not None
    ]


def diagnose(text: str | None, path: str | None, options: Options, script: Script | None = None) -> list[Diagnostic]:
    """Diagnostics of a script, sorted by position.  Parse errors are neither filtered nor suppressed."""
    s = script or Script(path, text or "", options.compat)
    ranges = directives(s, options.prefix)
    plugin_rules = {r.id: r for r, _ in options.plugins}
    out = [_diagnostic(s, f, Rule("parse-error", "Syntax", "", 1, False, 100), 1, True) for f in parse_errors(s)]
    for f in raw_findings(s, options):
        r = RULES.get(f.rule) or plugin_rules[f.rule]
        severity = options.ruleset.severity(f.rule) or f.severity or r.severity
        if severity > options.threshold:
            continue
        d = _diagnostic(s, f, r, severity, False)
        if not suppressed(f.rule, d.start[0], ranges):
            out.append(d)
    out.sort(key=lambda d: (d.start, d.end, d.code))
    return out


def _diagnostic(s: Script, f: Finding, r: Rule, severity: int, parse_error: bool) -> Diagnostic:
    return Diagnostic(
        f.rule, severity, r.category, r.fixable, f.message, s.position(f.start), s.position(f.end), parse_error, f.start, f.end, f.edits
    )


# -- fixes -------------------------------------------------------------------

NO_EDITS, BAD_RANGE, SELF_OVERLAP, CONFLICT = (
    "No edits.", "Invalid edit range.", "Overlapping edits in a single fix.", "Conflicts with another fix.",
)


def overlaps(s1: int, e1: int, s2: int, e2: int) -> bool:
    """Half-open ranges overlap; two equal empty ranges do, too."""
    return (s1 < e2 and s2 < e1) or (s1 == e1 == s2 == e2)


def apply_fixes(text: str, fixes: list[tuple[str, int, int, list | None]]) -> tuple[str, list[str], list[tuple[str, str]]]:
    """Greedy and conflict-free: ``fixes`` are (rule, start, end, edits).  Gives (text, applied rules, skipped (rule, reason))."""
    taken: list[tuple[int, int, str]] = []
    applied, skipped = [], []
    for rule, _, _, edits in sorted(fixes, key=lambda f: (f[1], f[2], f[0])):
        if not edits:
            skipped.append((rule, NO_EDITS))
        elif any(not 0 <= a <= z <= len(text) for a, z, _ in edits):
            skipped.append((rule, BAD_RANGE))
        elif any(overlaps(*edits[i][:2], *edits[j][:2]) for i in range(len(edits)) for j in range(i)):
            skipped.append((rule, SELF_OVERLAP))
        elif any(overlaps(a, z, x, y) for a, z, _ in edits for x, y, _ in taken):
            skipped.append((rule, CONFLICT))
        else:
            taken.extend(edits)
            applied.append(rule)
    for a, z, new in sorted(taken, key=lambda e: (e[0], e[1]), reverse=True):
        text = text[:a] + new + text[z:]
    return text, applied, skipped


def fix(text: str, path: str | None, options: Options) -> tuple[str, list[str], list[tuple[str, str]]]:
    """One round of fixes of the diagnostics that are reported."""
    return fix_found(text, diagnose(text, path, options))


def fix_found(text: str, found: list) -> tuple[str, list[str], list[tuple[str, str]]]:
    """One round of fixes of given diagnostics."""
    return apply_fixes(text, [(d.code, d.start_offset, d.end_offset, d.edits) for d in found if d.fixable and not d.parse_error and d.edits])


def line_break(text: str) -> str:
    m = re.search(r"\r\n|\r|\n", text)
    return m.group() if m else "\n"


def tokens(text: str) -> Iterable[tuple[int, str, str, int, int, int, int]]:
    """(index, class, text, line, column, length in UTF-16 units, offset) of every lexeme."""
    lexemes, _ = L.split(text)
    starts = L.line_starts(text)
    at = line = 0
    for i, tok in enumerate(lexemes):
        while line + 1 < len(starts) and starts[line + 1] <= at:
            line += 1
        yield i, L.token_class(tok), tok, line, L.utf16_len(text[starts[line] : at]), L.utf16_len(tok), at
        at += len(tok)
