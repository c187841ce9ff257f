import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintmill.plans.generated import FIXES
from lintmill.plans.rule_cases import CASES, expected
from lintmill.rules import engine
from lintmill.rules.catalog import PRESETS, RULES, Rule, preset
from lintmill.rules.engine import Options, diagnose
from lintmill.rules.plugins import DISABLED, NOT_FOUND, REJECTED, SUCCESS, VERSION, Registry
from lintmill.rules.rulesets import Ruleset, resolve

STRICT = engine.Options(ruleset=Ruleset.of_preset("strict"))


@pytest.mark.parametrize("rule", sorted(CASES))
def test_cases(rule):
    for marked in CASES[rule]:
        text, places = expected(marked)
        found = engine.diagnose(text.replace("{k}", "7"), "x.sql", engine.Options(ruleset=Ruleset.of_rule(rule)))
        assert sorted(d.start for d in found) == sorted(places), marked


@pytest.mark.parametrize("rule", sorted(FIXES))
def test_fixes(rule):
    o = engine.Options(ruleset=Ruleset.of_rule(rule))
    for before, after in FIXES[rule]:
        new, applied, _ = engine.fix(before.replace("{k}", "7"), "x.sql", o)
        assert new == after.replace("{k}", "7")
        assert bool(applied) == (before != after)


def test_presets_nest():
    sizes = [len(preset(p)) for p in PRESETS]
    assert sizes == [14, 43, 87, 107, 130]
    names = list(PRESETS)
    assert all(preset(a) < preset(b) for a, b in zip(names, names[1:]))
    assert sum(r.fixable for r in RULES.values()) == 14


@pytest.mark.parametrize("text", ["", " \n", ";", "SELECT", "-- x", "SELECT 'a", "[", "/*", "GO\nGO", "𝔖", "﻿SELECT 1", "SELECT N'𝔖', x y FROM t z"])
def test_no_rule_fails(text):
    assert not [d for d in engine.diagnose(text, None, STRICT) if "rule failed" in d.message]


def test_random_fragments():
    rng = random.Random(3)
    words = [w for cases in CASES.values() for m in cases for w in expected(m)[0].split()]
    for _ in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 15)))
        assert not [d for d in engine.diagnose(text, None, STRICT) if "rule failed" in d.message], text


def test_columns_count_utf16_units():
    d = engine.diagnose("SELECT N'𝔖', * FROM dbo.t;", "x", engine.Options(ruleset=Ruleset.of_rule("avoid-select-star")))
    assert d[0].start == (0, 14)


@given(*[st.integers(0, 8)] * 4)
@settings(max_examples=200, deadline=None)
def test_overlap_is_symmetric(a, b, c, d):
    s1, e1, s2, e2 = min(a, b), max(a, b), min(c, d), max(c, d)
    assert engine.overlaps(s1, e1, s2, e2) == engine.overlaps(s2, e2, s1, e1)
    assert engine.overlaps(s1, e1, s1, e1)
    if e1 == s2 and s1 < e1 and s2 < e2:
        assert not engine.overlaps(s1, e1, s2, e2)


def test_fix_reasons():
    text, applied, skipped = engine.apply_fixes("abcdef", [("r1", 0, 2, [(0, 2, "X")]), ("r2", 1, 3, [(1, 3, "Y")]), ("r3", 4, 5, []), ("r4", 5, 9, [(5, 9, "")]), ("r5", 3, 4, [(3, 5, ""), (4, 6, "")])])
    assert text == "Xcdef" and applied == ["r1"]
    assert dict(skipped) == {"r2": engine.CONFLICT, "r3": engine.NO_EDITS, "r4": engine.BAD_RANGE, "r5": engine.SELF_OVERLAP}


def test_directives_nest_per_rule():
    from lintmill.rules.model import Script

    s = Script("x", "-- lintmill-disable a\n-- lintmill-disable a, b\n-- lintmill-enable a\n-- lintmill-enable c\n-- lintmill-enable b: why\n-- lintmill-disablex")
    assert engine.directives(s) == [("a", 0, None), ("a", 1, 2), ("b", 1, 4)]


def test_ruleset_precedence():
    assert resolve().enabled("avoid-select-star") and not resolve().enabled("avoid-print-statement")
    assert resolve(rule="avoid-print-statement", preset_name="strict").enabled("avoid-print-statement")
    r = Ruleset.of_json('{"rules": [{"id": "a", "severity": "error"}, {"id": "a", "severity": "none"}, {"id": "b"}]}')
    assert not r.enabled("a") and r.enabled("b") and not r.enabled("c")
    assert resolve(ruleset=r, overrides={"a": "info"}).severity("a") == 3
    assert resolve(ruleset=r, plugins=["p"]).enabled("p")


def test_compatibility_level_gates():
    sql = "SELECT STRING_AGG(a, ',') FROM dbo.t;"
    r = Ruleset.of_rule("string-agg-without-order-by")
    assert engine.diagnose(sql, "x", engine.Options(ruleset=r, compat=140)) and not engine.diagnose(sql, "x", engine.Options(ruleset=r, compat=130))


def test_plugins(tmp_path):
    reg = Registry()
    rule = Rule("own", "Style", "", 2, False, 100)
    assert reg.register("a", 1, [(rule, lambda s: [])]) == VERSION
    assert reg.register("b", 2, [(rule, lambda s: [])]) == SUCCESS
    assert reg.load("/abs.py", str(tmp_path), allowed=True) == REJECTED
    assert reg.load("../up.py", str(tmp_path), allowed=True) == REJECTED
    assert reg.load("no.py", str(tmp_path), allowed=True) == NOT_FOUND
    assert reg.load("no.py", str(tmp_path)) == DISABLED
    (tmp_path / "ok.py").write_text("from lintmill.rules.catalog import Rule\nAPI = 2\nRULES = [(Rule('own2', 'Style', '', 2, False, 100), lambda s: [])]\n")
    assert reg.load("ok.py", str(tmp_path), allowed=True) == SUCCESS


def test_plugins_have_modules_of_their_own(tmp_path):
    for name, level in (("one", 1), ("two", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "helper_of_rules.py").write_text(f"LEVEL = {level}\n")
        (tmp_path / name / "rules.py").write_text(
            "from helper_of_rules import LEVEL\nfrom lintmill.rules.catalog import Rule\nAPI = 2\n"
            f"RULES = [(Rule('own-{name}', 'Style', '', LEVEL, False, 100), lambda s: [])]\n"
        )
    reg = Registry()
    before = list(sys.path)
    assert [reg.load(f"{n}/rules.py", str(tmp_path), allowed=True) for n in ("one", "two")] == [SUCCESS, SUCCESS]
    assert [r.severity for r, _ in reg.rules] == [1, 2]
    assert sys.path == before and "helper_of_rules" not in sys.modules


@pytest.mark.parametrize(
    "text, level",
    [
        ("CREATE OR ALTER VIEW v AS SELECT 1 AS a;", 130), ("DROP TABLE IF EXISTS dbo.t;", 130), ("SELECT a AT TIME ZONE 'UTC' AS b FROM dbo.t;", 130),
        ("SELECT a FROM dbo.t WHERE a IS NOT DISTINCT FROM b;", 160), ("SELECT IIF(a > 1, 2, 3) AS b FROM dbo.t;", 110),
        ("SELECT a FROM dbo.t ORDER BY a OFFSET 5 ROWS FETCH NEXT 5 ROWS ONLY;", 110), ("SELECT TRIM(LEADING 'x' FROM a) AS b FROM dbo.t;", 160), ("SELECT a FROM dbo.t;", 100),
        ("SELECT [IIF] AS a, 'AT TIME ZONE' AS b FROM dbo.t;", 100), ("DROP TABLE dbo.t;", 100),
    ],
)
def test_levels_know_their_syntax(text, level):
    for compat in (100, 110, 120, 130, 140, 150, 160):
        found = [d for d in diagnose(text, "a.sql", Options(compat=compat)) if d.parse_error]
        assert bool(found) == (compat < level), (text, compat, found)


#: Rules that look at more than a batch, so that text behind a GO changes what they find.
WIDER = {"duplicate-go", "set-xact-abort", "uncommitted-transaction"}


@pytest.mark.parametrize("rule", sorted(CASES))
def test_cases_in_other_surroundings(rule):
    from lintmill.plans.generated import _AT_START

    options = Options(ruleset=Ruleset.of_rule(rule))

    def found(text, shift=0):
        ds = [d for d in diagnose(text, "a.sql", options) if not d.parse_error]
        return [((d.start[0] + shift, d.start[1]), (d.end[0] + shift, d.end[1])) for d in ds]

    seen = 0
    for marked in CASES[rule]:
        text, places = expected(marked)
        text = text.replace("{k}", "7")
        assert [a for a, _ in found(text)] == sorted(places)
        seen += len(places)
        assert found(text.replace("\r\n", "\n").replace("\n", "\r\n")) == found(text)
        if rule not in _AT_START:
            assert found("/* c (\n */\n" + text) == found(text, 2)
            assert found("SELECT a\nFROM dbo.t;\nGO\n" + text) == found(text, 3)
        if rule not in WIDER | _AT_START:
            assert found(text + "\nGO\nSELECT a\nFROM dbo.t AS t;\n") == found(text)
            assert found(text + "\nGO\n" + text) == found(text) + found(text, text.count("\n") + 2)
    assert seen
