"""The rule catalogue: id, category, severity, smallest preset, fixable, least compatibility level (fixed values).

Presets nest: S security-only, P pragmatic, R recommended, L strict-logic, C strict.
"""

from __future__ import annotations

from dataclasses import dataclass

PRESETS = {"security-only": "S", "pragmatic": "SP", "recommended": "SPR", "strict-logic": "SPRL", "strict": "SPRLC"}
SEVERITIES = {"none": 0, "error": 1, "warning": 2, "information": 3, "hint": 4}
LABELS = {1: "Error", 2: "Warning", 3: "Information", 4: "Hint"}
_SEVERITY = {"E": 1, "W": 2, "I": 3}

_TABLE = """
Correctness
aggregate-in-where-clause P E
avoid-ambiguous-datetime-literal P W
avoid-atat-identity P W
avoid-between-for-datetime-range P W
avoid-float-for-decimal R W
avoid-legacy-join-syntax P E
avoid-named-constraint-in-temp-table P E
avoid-nolock R W
avoid-not-in-with-null P W
avoid-null-comparison P E fix
avoid-set-rowcount P W
avoid-top-without-order-by-in-select-into P E
duplicate-insert-column P E
duplicate-select-column R W
escape-keyword-identifier R W fix
group-by-column-mismatch P W
having-column-mismatch P W
insert-select-column-name-mismatch P I
order-by-in-subquery P W
require-column-list-for-insert-select S W
require-column-list-for-insert-values S W
require-parentheses-for-mixed-and-or P W
semantic-alias-scope-violation R W
semantic-cte-name-conflict P E
semantic-data-type-length P E fix
semantic-duplicate-alias S E
semantic-insert-column-count-mismatch S E
semantic-join-condition-always-true P W
semantic-join-table-not-referenced-in-on R W
semantic-left-join-filtered-by-where P W
semantic-return-after-statements R W
semantic-set-variable L W
semantic-undefined-alias S E
semantic-unicode-string R E fix
string-agg-without-order-by R W 140
stuff-without-order-by R W
union-type-mismatch P W
unreachable-case-when P W
Performance
avoid-correlated-subquery-in-select R W
avoid-cursors R W
avoid-full-text-search L I
avoid-implicit-conversion-in-predicate R W
avoid-information-schema L I
avoid-linked-server L I
avoid-non-sargable-predicate R W
avoid-objectproperty L W
avoid-optional-parameter-pattern R W
avoid-or-on-different-columns L I
avoid-query-hints R W
avoid-scalar-udf-in-query R W
avoid-select-distinct L I
avoid-select-into L I
avoid-select-star R W
avoid-top-100-percent-order-by R W
avoid-top-in-dml R W
avoid-upper-lower-in-predicate L W
like-leading-wildcard R W
prefer-exists-over-in-subquery R I
prefer-utc-datetime L W
require-data-compression L I
top-without-order-by P W
Safety
avoid-merge S W
cross-database-transaction S W
dangerous-ddl S W
dml-without-where S E
require-drop-if-exists L I
Security
avoid-dangerous-procedures S W
avoid-exec-dynamic-sql S W
avoid-execute-as S W
avoid-openrowset-opendatasource S W
require-parameterized-sp-executesql S W
Schema
avoid-deprecated-types P W
avoid-heap-table L W
duplicate-column-definition P E
duplicate-foreign-key-column R W
duplicate-index-column R W
duplicate-index-definition R W
duplicate-table-function-column P E
duplicate-table-variable-column P E
duplicate-view-column P E
require-primary-key-or-unique-constraint L W
require-table-description L I
Transactions
avoid-catch-swallowing R W
avoid-transaction-without-commit P E
require-save-transaction-in-nested R I
require-throw-or-raiserror-in-catch R I
require-try-catch-for-transaction R W
set-ansi R W
set-ansi-padding R W
set-ansi-warnings R W
set-arithabort R W
set-concat-null-yields-null R W
set-nocount R I
set-quoted-identifier R W
set-transaction-isolation-level R I
set-xact-abort R W
uncommitted-transaction L W
Style
avoid-magic-convert-style-for-datetime C I
avoid-order-by-ordinal R I
duplicate-empty-line C I
duplicate-go C I
nested-block-comments C W
normalize-execute-keyword C I fix
normalize-inequality-operator L I fix
normalize-procedure-keyword C I fix
normalize-transaction-keyword C I fix
prefer-coalesce-over-nested-isnull C I
prefer-concat-over-plus C I 110
prefer-concat-with-nullable L I 110
prefer-concat-ws C I 140
prefer-json-functions C I 130
prefer-string-agg-over-stuff C I 140
prefer-trim-over-ltrim-rtrim C I 140
prefer-try-convert-patterns C I
prefer-unicode-string-literals R I fix
qualified-select-columns L I
require-as-for-column-alias C I fix
require-as-for-table-alias C I fix
require-begin-end-for-while C W
require-begin-end-lenient C W
require-begin-end-strict C I fix
require-explicit-join C W
require-explicit-join-type C W fix
require-qualified-columns-everywhere R W
require-schema-qualify-exec R W
semantic-case-sensitive-variables L I
semantic-multi-table-alias R W
semantic-schema-qualify R W
semicolon-termination C I fix
Debug
avoid-print-statement C I
"""


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    tier: str
    severity: int
    fixable: bool
    min_compat: int


def _read() -> dict[str, Rule]:
    out: dict[str, Rule] = {}
    category = ""
    for line in _TABLE.split("\n"):
        parts = line.split()
        if len(parts) == 1:
            category = parts[0]
        elif parts:
            level = next((int(p) for p in parts if p.isdigit()), 100)
            out[parts[0]] = Rule(parts[0], category, parts[1], _SEVERITY[parts[2]], "fix" in parts, level)
    return out


RULES: dict[str, Rule] = _read()


def preset(name: str) -> frozenset[str]:
    """Rule ids of a preset."""
    return frozenset(r.id for r in RULES.values() if r.tier in PRESETS[name])
