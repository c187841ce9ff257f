"""The checks.  Each is a generator registered for node types, batches or whole scripts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from lintmill.rules.model import (
    Batch, Finding, Script, ancestors, flatten, in_predicate, joins, output_name, own_nodes, ref_name, string_value, unquote,
)
from lintmill.syntax.parser import Node

NODE_CHECKS: dict[str, list[tuple[str, Callable]]] = {}
BATCH_CHECKS: list[tuple[str, Callable]] = []
SCRIPT_CHECKS: list[tuple[str, Callable]] = []

# fixed values
AGGREGATES = frozenset(
    "COUNT SUM AVG MIN MAX COUNT_BIG STDEV STDEVP VAR VARP STRING_AGG GROUPING GROUPING_ID CHECKSUM_AGG APPROX_COUNT_DISTINCT".split()
)
SOFT_KEYWORDS = frozenset(
    """VALUE TYPE DATE TIME NAME STATUS COUNT SUM FIRST LAST MIN MAX AVG YEAR MONTH DAY HOUR MINUTE SECOND LEVEL STATE DATA ROLE
    LANGUAGE OUTPUT INPUT ABSOLUTE RELATIVE PATH CONTENT DOCUMENT ROWCOUNT""".split()
)
DANGEROUS_PROCEDURES = frozenset(
    """xp_cmdshell xp_regread xp_regwrite xp_regdeletekey xp_regdeletevalue xp_regaddmultistring xp_regremovemultistring sp_oacreate
    sp_oamethod sp_oagetproperty sp_oasetproperty sp_oadestroy sp_oageterrorinfo""".split()
)
SYSTEM_PROCEDURES = frozenset(
    """sp_executesql sp_xml_preparedocument sp_xml_removedocument sp_prepare sp_execute sp_unprepare sp_describe_first_result_set
    sp_describe_undeclared_parameters sp_getapplock sp_releaseapplock sp_addmessage sp_dropmessage xp_cmdshell xp_sendmail""".split()
)
BANNED_TABLE_HINTS = frozenset("FORCESEEK FORCESCAN INDEX NOEXPAND FASTFIRSTROW SPATIAL_WINDOW_MAX_CELLS".split())
DATETIME_FUNCTIONS = frozenset("GETDATE GETUTCDATE SYSDATETIME SYSUTCDATETIME SYSDATETIMEOFFSET CURRENT_TIMESTAMP".split())
DATETIME_TYPES = frozenset("DATETIME DATETIME2 SMALLDATETIME DATETIMEOFFSET".split())
UTC_NAMES = {"GETDATE": "GETUTCDATE()", "SYSDATETIME": "SYSUTCDATETIME()", "CURRENT_TIMESTAMP": "GETUTCDATE()", "SYSDATETIMEOFFSET": "SYSUTCDATETIME()"}
LENGTH_TYPES = {"VARCHAR": 50, "NVARCHAR": 50, "VARBINARY": 50, "CHAR": 1, "NCHAR": 1, "BINARY": 1}
DEPRECATED_TYPES = {"TEXT": "VARCHAR(MAX)", "NTEXT": "NVARCHAR(MAX)", "IMAGE": "VARBINARY(MAX)"}
DATEPART_FIRST = frozenset("DATEADD DATEDIFF DATEDIFF_BIG DATENAME DATEPART DATETRUNC DATE_BUCKET".split())
TYPE_CATEGORY = {
    **dict.fromkeys("INT BIGINT SMALLINT TINYINT BIT DECIMAL NUMERIC MONEY SMALLMONEY FLOAT REAL".split(), "numeric"),
    **dict.fromkeys("CHAR VARCHAR NCHAR NVARCHAR TEXT NTEXT".split(), "string"),
    **dict.fromkeys("DATE TIME DATETIME DATETIME2 SMALLDATETIME DATETIMEOFFSET".split(), "datetime"),
    **dict.fromkeys("BINARY VARBINARY IMAGE".split(), "binary"),
    "UNIQUEIDENTIFIER": "uniqueidentifier",
}


def on(rule: str, *types: str):
    def register(f):
        for t in types:
            NODE_CHECKS.setdefault(t, []).append((rule, f))
        return f

    return register


def on_batch(rule: str):
    def register(f):
        BATCH_CHECKS.append((rule, f))
        return f

    return register


def on_script(rule: str):
    def register(f):
        SCRIPT_CHECKS.append((rule, f))
        return f

    return register


class At:
    """A finding on tokens a..z of a batch."""

    __slots__ = ("a", "z", "message", "edits", "severity")

    def __init__(self, a: int, z: int, message: str, edits=None, severity=None):
        self.a, self.z, self.message, self.edits, self.severity = a, z, message, edits, severity


def node_at(n: Node, message: str, **k) -> At:
    return At(n.a, n.b, message, **k)


def first(n: Node, message: str, **k) -> At:
    return At(n.a, n.a, message, **k)


def pair(n: Node, message: str) -> At:
    return At(n.a, min(n.a + 1, n.b), message)


def is_temp(name: str) -> bool:
    return name.startswith("#")


def call_name(n: Node) -> str:
    return n.d.get("name", "") if n.type == "call" and len(n.parts) == 1 else ""


def type_name(b: Batch, t: Node | None) -> str:
    return b.parts(t)[-1].upper() if t is not None and t.parts else ""


def duplicates(items, key) -> Iterator:
    """Items whose key occurred before; the first occurrence is not one."""
    seen = set()
    for x in items:
        k = key(x)
        if k is None:
            continue
        k = k.lower()
        if k in seen:
            yield x
        seen.add(k)


def contains_column(n: Node) -> bool:
    """Whether a column lies in the expression through calls, casts, operators and parentheses."""
    if n.type == "column":
        return True
    if n.type == "call":
        args = n.args or []
        if call_name(n) in DATEPART_FIRST:
            args = args[1:]
        return any(contains_column(x) for x in args)
    if n.type == "binary":
        return contains_column(n.left) or contains_column(n.right)
    return n.type == "paren" and contains_column(n.operand)


def is_string(b: Batch, n: Node) -> bool:
    return n.type == "literal" and n.kind == "STR"


# -- correctness -------------------------------------------------------------


@on("aggregate-in-where-clause", "where")
def _(b: Batch, n: Node):
    if n.cond is None or any(p.type == "subquery" for p, _ in ancestors(n)):
        return  # within a subquery an aggregate may belong to the outer query
    for x in [n.cond, *own_nodes(n, ("subquery", "select"))]:
        if x.type == "call" and call_name(x) in AGGREGATES and x.over is None:
            yield node_at(x, f"Aggregate {call_name(x)} cannot stand in WHERE; use HAVING.")


_SLASH_DATE = re.compile(r"^\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$")


@on_batch("avoid-ambiguous-datetime-literal")
def _(b: Batch):
    for i, k in enumerate(b.k):
        t = b.t[i]
        if (k == "STR" and _SLASH_DATE.match(string_value(t))) or (k == "QID" and t[0] == '"' and _SLASH_DATE.match(unquote(t))):
            yield At(i, i, "The reading of a slash date depends on the session language; use an ISO literal.")


@on_batch("avoid-atat-identity")
def _(b: Batch):
    for i, t in enumerate(b.t):
        if t.upper() == "@@IDENTITY":
            yield At(i, i, "@@IDENTITY also returns keys that triggers made; use SCOPE_IDENTITY().")


def _asks_the_clock(b: Batch, n: Node) -> bool:
    """A datetime function in calls, operators or parentheses."""
    if n.type == "parameterless_call":
        return b.is_word(n.a, "CURRENT_TIMESTAMP")
    if n.type == "call":
        return call_name(n) in DATETIME_FUNCTIONS - {"SYSDATETIMEOFFSET"} or (n.data_type is None and any(_asks_the_clock(b, x) for x in n.args))
    if n.type == "binary":
        return _asks_the_clock(b, n.left) or _asks_the_clock(b, n.right)
    return n.type == "paren" and _asks_the_clock(b, n.operand)


@on("avoid-between-for-datetime-range", "between")
def _(b: Batch, n: Node):
    if not in_predicate(n):
        return
    for x in (n.left, n.low, n.high):
        name = b.parts(x)[-1] if x.type == "column" else b.t[x.a] if x.type == "variable" else ""
        cast = x.type == "call" and call_name(x) in ("CAST", "CONVERT") and type_name(b, x.data_type) in DATETIME_TYPES | {"TIME"}
        if "time" in name.lower() or cast or _asks_the_clock(b, x):
            yield At(n.at, n.at, "BETWEEN includes its end and misses fractions of it; use >= and <.")
            return


@on("avoid-float-for-decimal", "data_type")
def _(b: Batch, n: Node):
    if type_name(b, n) in ("FLOAT", "REAL"):
        yield node_at(n, "Approximate type; use DECIMAL for exact values.")


@on_script("avoid-legacy-join-syntax")
def _(s: Script):
    for b in s.batches:
        for i, t in enumerate(b.t):
            two = b.t[i + 1] if i + 1 < len(b.t) else ""
            if t == "*=" and b.k[i - 1] not in ("VAR",) and not (i > 1 and b.is_word(i - 2, "SET", "SELECT")):
                yield Finding("", b.start(i), b.end(i), "Legacy outer join; use LEFT JOIN.")
            elif t == "=" and two == "*" and b.at[i + 1] == b.at[i] + 1:
                yield Finding("", b.start(i), b.end(i + 1), "Legacy outer join; use RIGHT JOIN.")


@on("avoid-named-constraint-in-temp-table", "create_table")
def _(b: Batch, n: Node):
    if not is_temp(b.parts(n.d["name"])[-1]):
        return
    for e in n.elements or []:
        for c in [e, *(e.constraints or [])]:
            if c.type == "constraint" and c.d.get("name") is not None:
                yield node_at(c, "A named constraint of a temporary table collides between sessions.")


@on("avoid-nolock", "table_hint")
def _(b: Batch, n: Node):
    if n.text == "NOLOCK":
        yield node_at(n, "NOLOCK reads uncommitted rows.")


@on("avoid-nolock", "set_isolation")
def _(b: Batch, n: Node):
    if n.level == "READ UNCOMMITTED":
        yield node_at(n, "READ UNCOMMITTED reads uncommitted rows.")


@on("avoid-not-in-with-null", "in")
def _(b: Batch, n: Node):
    if n.negated is not None and n.subquery is not None and in_predicate(n):
        yield At(n.negated, n.at, "NOT IN is never true once the subquery returns a NULL; use NOT EXISTS.")


def _is_null(n: Node) -> bool:
    return n.type == "literal" and n.kind == "NULL"


@on("avoid-null-comparison", "comparison")
def _(b: Batch, n: Node):
    if n.op not in ("=", "<>", "!="):
        return
    left, right = _is_null(n.left), _is_null(n.right)
    if not (left or right):
        return
    edits = None
    if left != right:
        keep = n.right if left else n.left
        edits = [(b.start(n.a), b.end(n.b), b.text(keep) + (" IS NULL" if n.op == "=" else " IS NOT NULL"))]
    yield node_at(n, "A comparison with NULL is never true; use IS [NOT] NULL.", edits=edits)


@on("avoid-set-rowcount", "set_rowcount")
def _(b: Batch, n: Node):
    if b.t[min(n.a + 2, n.b)] != "0":
        yield node_at(n, "SET ROWCOUNT is deprecated; use TOP.")


@on("avoid-top-without-order-by-in-select-into", "select_statement")
def _(b: Batch, n: Node):
    q = n.query
    if q.type == "select" and q.top is not None and q.into is not None and q.order is None:
        yield node_at(q.top, "TOP into a table without ORDER BY takes arbitrary rows.")


@on("duplicate-insert-column", "insert")
def _(b: Batch, n: Node):
    for c in duplicates(n.columns or [], lambda c: b.parts(c)[-1]):
        yield node_at(c, "The column is listed twice.")


@on("duplicate-select-column", "select")
def _(b: Batch, n: Node):
    for x in duplicates(n.d["items"], lambda x: output_name(b, x)):
        yield node_at(x, "The output column name occurs twice.")


def _soft(b: Batch, i: int) -> bool:
    return b.k[i] != "QID" and b.t[i].upper() in SOFT_KEYWORDS


@on("escape-keyword-identifier", "table", "column", "column_definition")
def _(b: Batch, n: Node):
    if n.type == "table":
        ids = [n.d["name"].parts[-1]]
    elif n.type == "column":
        if n.up is not None and n.up.type == "call" and call_name(n.up) in DATEPART_FIRST and n.up.args and n.up.args[0] is n:
            return
        ids = [p for p in n.parts if p is not None]
    else:
        ids = [n.d["name"]]
    for p in ids:
        if _soft(b, p.a):
            t = b.t[p.a]
            yield node_at(p, f"'{t}' is a keyword in places; write [{t}].", edits=[(b.start(p.a), b.end(p.a), f"[{t}]")])


def _grouping_columns(b: Batch, group: Node) -> tuple[list[list[str]], set[str]]:
    cols, texts = [], set()
    stack = list(group.d["items"])
    while stack:
        x = stack.pop()
        if x.type == "grouping":
            stack.extend(x.d["items"])
            continue
        e = x.expr if x.type == "group_item" else x
        texts.add(b.signature(e))
        if e.type == "column":
            cols.append([p.lower() for p in b.parts(e)])
    return cols, texts


def _ungrouped(b: Batch, e: Node, cols, texts, out: list[Node]):
    if b.signature(e) in texts:
        return
    if e.type == "column":
        parts = [p.lower() for p in b.parts(e)]
        for g in cols:
            if g[-1] == parts[-1] and (len(g) < 2 or len(parts) < 2 or g[-2] == parts[-2]):
                return
        out.append(e)
        return
    if e.type in ("subquery", "select"):
        return
    if e.type == "call":
        if e.over is not None or call_name(e) in AGGREGATES:
            return
        args = e.args or []
        if call_name(e) in DATEPART_FIRST:
            args = args[1:]
        for x in args:
            _ungrouped(b, x, cols, texts, out)
        return
    for x in e.kids():
        _ungrouped(b, x, cols, texts, out)


def _once(b: Batch, found: list[Node]) -> Iterator[Node]:
    seen = set()
    for c in found:
        k = b.signature(c)
        if k not in seen:
            seen.add(k)
            yield c


@on("group-by-column-mismatch", "select")
def _(b: Batch, n: Node):
    if n.group is None:
        return
    cols, texts = _grouping_columns(b, n.group)
    found: list[Node] = []
    for item in n.d["items"]:
        if item.type == "select_item":
            _ungrouped(b, item.expr, cols, texts, found)
    for c in _once(b, found):
        yield node_at(c, "The column is neither aggregated nor in GROUP BY.")


@on("having-column-mismatch", "select")
def _(b: Batch, n: Node):
    if n.having is None or n.group is None:
        return
    cols, texts = _grouping_columns(b, n.group)
    found: list[Node] = []
    _ungrouped(b, n.having.cond, cols, texts, found)
    for c in _once(b, found):
        yield node_at(c, "The column of HAVING is neither aggregated nor in GROUP BY.")


@on("insert-select-column-name-mismatch", "insert")
def _(b: Batch, n: Node):
    q = n.query
    if not n.columns or q is None or q.type != "select" or len(q.d["items"]) != len(n.columns):
        return
    items = q.d["items"]
    if any(x.type != "select_item" or x.expr.type != "column" for x in items):
        return
    for c, x in zip(n.columns, items):
        if b.parts(c)[-1].lower() != (output_name(b, x) or "").lower():
            yield node_at(c, "The column takes a column of another name.")
            return


@on("order-by-in-subquery", "select", "set_operation")
def _(b: Batch, n: Node):
    if n.order is None or n.top is not None or n.offset or n.d.get("for") in ("XML", "JSON"):
        return
    p = n.up
    while p is not None and p.type == "query_paren":
        p = p.up
    if p is not None and p.type not in ("select_statement", "insert", "declare_cursor"):
        yield node_at(n.order, "ORDER BY without TOP or OFFSET has no effect in a subquery.")


@on("require-column-list-for-insert-select", "insert")
def _(b: Batch, n: Node):
    if n.query is not None and not n.columns:
        yield first(n, "INSERT ... SELECT without a column list.")


@on("require-column-list-for-insert-values", "insert")
def _(b: Batch, n: Node):
    if n.rows is not None and not n.columns:
        yield first(n, "INSERT ... VALUES without a column list.")


@on("require-parentheses-for-mixed-and-or", "bool_binary")
def _(b: Batch, n: Node):
    for c in (n.left, n.right):
        if c.type == "bool_binary" and c.op != n.op:
            yield node_at(n, "AND and OR are mixed without parentheses.")


@on("semantic-alias-scope-violation", "select")
def _(b: Batch, n: Node):
    leaves = list(flatten(n.from_))
    names = [(ref_name(b, r) or "").lower() for r in leaves]
    for i, r in enumerate(leaves):
        if r.type != "derived_table" or (r.up is not None and r.up.type == "join" and "APPLY" in r.up.kind):
            continue
        later = set(names[i + 1 :]) - set(names[: i + 1]) - {""}
        inner = {(ref_name(b, x) or "").lower() for q in r.query.walk() if q.type == "select" for x in flatten(q.from_)}
        for c in r.query.walk():
            if c.type == "column" and len(c.parts) >= 2:
                q = b.parts(c)[-2].lower()
                if q in later and q not in inner:
                    yield node_at(c, f"'{q}' is declared after this derived table.")


def _ctes(n: Node) -> list[Node]:
    return n.ctes or []


@on("semantic-cte-name-conflict", "select_statement", "insert", "update", "delete", "merge")
def _(b: Batch, n: Node):
    ctes = _ctes(n)
    if not ctes:
        return
    for c in duplicates(ctes, lambda c: b.name(c.d["name"])):
        yield node_at(c.d["name"], "The CTE name occurs twice.")
    names = {b.name(c.d["name"]).lower() for c in ctes}
    refs: list[Node] = []
    if n.type == "select_statement" and n.query is not None:
        refs = list(flatten(n.query.from_))
    elif n.from_ is not None:
        refs = list(flatten(n.from_))
    elif n.query is not None:
        refs = list(flatten(n.query.from_))
    for r in refs:
        if r.alias is not None and b.name(r.alias).lower() in names:
            if not (r.type == "table" and b.parts(r.d["name"])[-1].lower() == b.name(r.alias).lower() and len(r.d["name"].parts) == 1):
                yield node_at(r.alias, "The alias equals the name of a CTE.")
        elif r.type == "table" and len(r.d["name"].parts) > 1 and b.parts(r.d["name"])[-1].lower() in names:
            yield node_at(r.d["name"].parts[-1], "The table has the name of a CTE.")


@on("semantic-data-type-length", "data_type")
def _(b: Batch, n: Node):
    size = LENGTH_TYPES.get(type_name(b, n))
    if size is not None and not n.args and n.up is not None and n.up.type in ("declaration", "column_definition", "parameter"):
        yield node_at(n, "The type has no length.", edits=[(b.end(n.b), b.end(n.b), f"({size})")])


def _scope_refs(n: Node) -> list[Node]:
    if n.type in ("select",):
        return list(flatten(n.from_))
    if n.type in ("update", "delete"):
        return list(flatten(n.from_))
    return [n.target, *flatten([n.source])]


@on("semantic-duplicate-alias", "select", "update", "delete", "merge")
def _(b: Batch, n: Node):
    for r in duplicates(_scope_refs(n), lambda r: ref_name(b, r)):
        yield node_at(r, "The alias or table name occurs twice in the same scope.")


def _branches(q: Node) -> Iterator[Node]:
    if q.type == "set_operation":
        yield from _branches(q.left)
        yield from _branches(q.right)
    elif q.type == "query_paren":
        yield from _branches(q.query)
    elif q.type == "select":
        yield q


@on("semantic-insert-column-count-mismatch", "insert")
def _(b: Batch, n: Node):
    if not n.columns:
        return
    want = len(n.columns)
    if n.rows:
        bad = any(len(r.values) != want for r in n.rows)
    elif n.query is not None:
        bad = any(
            all(x.type == "select_item" for x in q.d["items"]) and len(q.d["items"]) != want for q in _branches(n.query)
        )
    else:
        bad = False
    if bad:
        yield first(n, "The number of values differs from the number of columns.")


def _comparisons(n: Node) -> Iterator[Node]:
    if n.type == "bool_binary":
        yield from _comparisons(n.left)
        yield from _comparisons(n.right)
    elif n.type == "bool_paren":
        yield from _comparisons(n.operand)
    elif n.type == "comparison":
        yield n


@on("semantic-join-condition-always-true", "join")
def _(b: Batch, n: Node):
    if n.d.get("on") is None:
        return
    for c in _comparisons(n.d["on"]):
        if c.op != "=":
            continue
        if c.left.type == c.right.type and c.left.type in ("literal", "column") and b.signature(c.left) == b.signature(c.right):
            yield node_at(c, "The join condition is always true.")


@on("semantic-join-table-not-referenced-in-on", "join")
def _(b: Batch, n: Node):
    if n.d.get("on") is None or n.kind not in ("INNER", "LEFT", "RIGHT"):
        return
    name = ref_name(b, n.right)
    if name is None:
        return
    on_ = n.d["on"]
    quals = {b.parts(c)[-2].lower() for c in [on_, *own_nodes(on_)] if c.type == "column" and len(c.parts) >= 2}
    if name.lower() not in quals:
        yield node_at(on_, f"The condition doesn't name '{name}'.")


def _tables_of(b: Batch, n: Node) -> set[str]:
    return {b.parts(c)[-2].lower() for c in n.walk() if c.type == "column" and len(c.parts) >= 2}


def _rejects_null(b: Batch, n: Node) -> set[str]:
    if n.type == "bool_binary":
        x, y = _rejects_null(b, n.left), _rejects_null(b, n.right)
        return x | y if n.op == "AND" else x & y
    if n.type in ("bool_paren", "not"):
        return _rejects_null(b, n.operand)
    if n.type == "comparison":
        return _tables_of(b, n.left) | _tables_of(b, n.right)
    if n.type in ("in", "like", "between"):
        return _tables_of(b, n.left)
    return set()


@on("semantic-left-join-filtered-by-where", "select_statement")
def _(b: Batch, n: Node):
    q = n.query
    if q.type != "select" or q.where is None or q.where.cond is None:
        return
    hit = _rejects_null(b, q.where.cond)
    for j in joins(q.from_):
        name = ref_name(b, j.right)
        if j.kind == "LEFT" and name is not None and name.lower() in hit:
            yield node_at(j.right, "WHERE removes the rows that LEFT JOIN keeps.")


@on("semantic-return-after-statements", "block", "create_procedure", "create_function")
def _(b: Batch, n: Node):
    seen = False
    for s in n.body or []:
        if seen:
            yield node_at(s, "The statement after RETURN is never reached.")
        if s.type == "return":
            seen = True


@on("semantic-set-variable", "set_variable")
def _(b: Batch, n: Node):
    yield first(n, "Assign with SELECT.")


_SCOPES = ("select", "update", "delete", "merge", "insert")


def _visible(b: Batch, n: Node) -> set[str]:
    """Names that may qualify a column at n: those of every enclosing scope."""
    out = set()
    for p, c in ancestors(n):
        if p.type == "select":
            out |= {(ref_name(b, r) or "").lower() for r in flatten(p.from_)}
        elif p.type in ("update", "delete"):
            out |= {(ref_name(b, r) or "").lower() for r in flatten(p.from_)} | {(ref_name(b, p.target) or "").lower()}
            if c.type == "output":
                out |= {"inserted", "deleted"}
        elif p.type == "merge":
            out |= {(ref_name(b, r) or "").lower() for r in [p.target, *flatten([p.source])]}
            if c.type == "output":
                out |= {"inserted", "deleted"}
        elif p.type == "insert":
            if c.type == "output":
                out.add("inserted")
        elif p.type == "create_table":
            return {"*"}
    return out


@on("semantic-undefined-alias", "column")
def _(b: Batch, n: Node):
    parts = b.parts(n)
    if len(parts) < 2 or not parts[-2]:
        return
    if not any(p.type in _SCOPES for p, _ in ancestors(n)):
        return
    if any(p.type == "method_table" or p.type == "rowset" for p, _ in ancestors(n)):
        return
    seen = _visible(b, n)
    if "*" not in seen and parts[-2].lower() not in seen:
        yield node_at(n.parts[-2], f"'{parts[-2]}' is not declared in this statement.")


@on_script("semantic-unicode-string")
def _(s: Script):
    types: dict[str, tuple[Batch, Node]] = {}
    for b in s.batches:
        for n in b.nodes:
            if n.type in ("declaration", "parameter") and n.type_ is not None:
                types[b.t[n.a].lower()] = (b, n.type_)
            elif n.type == "set_variable" and n.var is not None and is_string(b, n.expr):
                at = types.get(b.t[n.var].lower())
                lit = b.t[n.expr.a]
                if at is None or string_value(lit).isascii():
                    continue
                tb, t = at
                kind = type_name(tb, t)
                if kind in ("VARCHAR", "CHAR"):
                    edit = (tb.start(t.a), tb.end(t.a), ("n" if tb.t[t.a].islower() else "N") + tb.t[t.a])
                    yield Finding("", b.start(n.expr.a), b.end(n.expr.a), f"The literal doesn't fit into {kind}.", [edit])


@on("string-agg-without-order-by", "call")
def _(b: Batch, n: Node):
    if call_name(n) == "STRING_AGG" and n.within is None:
        yield node_at(n, "STRING_AGG without WITHIN GROUP has no order.")


def _for_clause(n: Node) -> Node | None:
    """The query of a call's first argument if it is a subquery with FOR."""
    if n.args and n.args[0].type == "subquery":
        q = n.args[0].query
        if q is not None and q.d.get("for"):
            return q
    return None


@on("stuff-without-order-by", "call")
def _(b: Batch, n: Node):
    if call_name(n) == "STUFF":
        for x in n.args:
            q = x.query if x.type == "subquery" else None
            if q is not None and q.type == "select" and q.d.get("for") == "XML" and q.d.get("for_mode") == "PATH" and q.order is None:
                yield node_at(n.parts[0], "The concatenation has no ORDER BY.")
                return


def _category(b: Batch, e: Node) -> str | None:
    while e.type in ("paren", "unary"):
        e = e.operand
    if e.type == "literal":
        if e.kind == "STR":
            return "string"
        if e.kind == "NUM":
            return "binary" if b.t[e.a][:2].lower() == "0x" else "numeric"
        return None
    if e.type == "call" and e.data_type is not None:
        return TYPE_CATEGORY.get(type_name(b, e.data_type))
    return None


def _last_branch(q: Node) -> Node | None:
    while q is not None and q.type != "select":
        q = q.right if q.type == "set_operation" else q.query
    return q


@on("union-type-mismatch", "set_operation")
def _(b: Batch, n: Node):
    if n.op != "UNION":
        return
    left, right = _last_branch(n.left), _last_branch(n.right)
    if left is None or right is None:
        return
    for x, y in zip(left.d["items"], right.d["items"]):
        if x.type == "select_item" and y.type == "select_item":
            p, q = _category(b, x.expr), _category(b, y.expr)
            if p and q and p != q:
                yield node_at(y, f"The column is {q} here and {p} in the branch before.")


@on("unreachable-case-when", "case")
def _(b: Batch, n: Node):
    seen = set()
    for w in n.whens:
        k = b.signature(w)
        if k in seen:
            yield At(w.a - 1, n.thens[n.whens.index(w)].b, "The condition occurs before; this branch is never taken.")
        seen.add(k)


# -- performance -------------------------------------------------------------


@on("avoid-correlated-subquery-in-select", "subquery")
def _(b: Batch, n: Node):
    item = n.up
    while item is not None and item.type not in ("select_item", "select_set", "select", "where", "subquery"):
        item = item.up
    if item is None or item.type not in ("select_item", "select_set"):
        return
    outer = item.up
    if outer is None or outer.type != "select" or n.query is None:
        return
    names = {(ref_name(b, r) or "").lower() for r in flatten(outer.from_)} - {""}
    local = {(ref_name(b, r) or "").lower() for q in n.query.walk() if q.type == "select" for r in flatten(q.from_)}
    for c in n.query.walk():
        if c.type == "column" and len(c.parts) >= 2:
            q = b.parts(c)[-2].lower()
            if q in names and q not in local:
                yield node_at(n, "The subquery runs once per row; use a join.")
                return


@on("avoid-cursors", "declare_cursor")
def _(b: Batch, n: Node):
    if b.is_word(n.a, "DECLARE"):
        yield first(n, "A cursor works row by row.")


@on("avoid-full-text-search", "fulltext_predicate")
def _(b: Batch, n: Node):
    yield node_at(n, "Full-text search.")


@on("avoid-full-text-search", "rowset")
def _(b: Batch, n: Node):
    if n.kind in ("CONTAINSTABLE", "FREETEXTTABLE"):
        yield node_at(n, "Full-text search.")


@on("avoid-implicit-conversion-in-predicate", "comparison")
def _(b: Batch, n: Node):
    if in_predicate(n):
        for x in (n.left, n.right):
            if x.type == "call" and x.data_type is not None and call_name(x) in ("CAST", "CONVERT") and any(contains_column(y) for y in x.args):
                yield node_at(x, "A converted column can't use an index.")


@on("avoid-information-schema", "table")
def _(b: Batch, n: Node):
    parts = b.parts(n.d["name"])
    if len(parts) >= 2 and parts[-2].upper() == "INFORMATION_SCHEMA":
        yield node_at(n, "Use the catalog views of sys.")


@on("avoid-linked-server", "object_name")
def _(b: Batch, n: Node):
    if len(n.parts) == 4 and n.parts[0] is not None:
        yield node_at(n, "A four-part name reaches a linked server.")


#: Calls that the language has as expressions of their own, no functions (fixed values).
_OWN_EXPRESSIONS = frozenset("COALESCE NULLIF IIF LEFT RIGHT PARSE TRY_PARSE".split())


@on("avoid-non-sargable-predicate", "comparison")
def _(b: Batch, n: Node):
    if in_predicate(n):
        for x in (n.left, n.right):
            if x.type == "call" and x.data_type is None and contains_column(x) and call_name(x) not in _OWN_EXPRESSIONS:
                yield node_at(x, "A function over a column can't use an index.")


@on("avoid-objectproperty", "call")
def _(b: Batch, n: Node):
    if call_name(n) == "OBJECTPROPERTY":
        yield node_at(n, "Use the catalog views of sys.")


def _unwrap(n: Node) -> Node:
    while n.type in ("bool_paren", "paren"):
        n = n.operand
    return n


@on("avoid-optional-parameter-pattern", "bool_binary")
def _(b: Batch, n: Node):
    if n.op != "OR" or not in_predicate(n):
        return
    x, y = _unwrap(n.left), _unwrap(n.right)
    for p, q in ((x, y), (y, x)):
        if p.type == "is_null" and not p.negated and p.operand.type == "variable" and q.type == "comparison" and q.op == "=":
            v = b.t[p.operand.a].lower()
            sides = (q.left, q.right)
            if any(s.type == "variable" and b.t[s.a].lower() == v for s in sides) and any(s.type == "column" for s in sides):
                yield node_at(n, "An optional parameter in OR spoils the plan.")
                return


@on("avoid-optional-parameter-pattern", "comparison")
def _(b: Batch, n: Node):
    if n.op != "=" or not in_predicate(n):
        return
    for x, y in ((n.left, n.right), (n.right, n.left)):
        if x.type == "column" and y.type == "call" and call_name(y) in ("ISNULL", "COALESCE") and len(y.args) >= 2:
            if y.args[0].type == "variable" and y.args[1].type == "column" and b.parts(y.args[1])[-1].lower() == b.parts(x)[-1].lower():
                yield node_at(n, "An optional parameter through ISNULL spoils the plan.")
                return


def _bases(b: Batch, n: Node) -> set[str]:
    return {b.parts(c)[-1].lower() for c in [n.left, n.right] if c.type == "column"}


@on("avoid-or-on-different-columns", "bool_binary")
def _(b: Batch, n: Node):
    left, right = _unwrap(n.left), _unwrap(n.right)
    if n.op == "OR" and left.type == "comparison" and right.type == "comparison" and in_predicate(n):
        x, y = _bases(b, left), _bases(b, right)
        if x and y and not x & y:
            yield node_at(n, "OR over different columns can't use one index.")


@on("avoid-query-hints", "table_hint")
def _(b: Batch, n: Node):
    if n.text in BANNED_TABLE_HINTS:
        yield node_at(n, f"Table hint {n.text} binds the optimizer.")


@on("avoid-query-hints", "query_hint")
def _(b: Batch, n: Node):
    words = [x.upper() for x in b.t[n.a : n.b + 1]]
    if words[0] in ("RECOMPILE", "MAXRECURSION", "LABEL") or words[:2] in (["OPTIMIZE", "FOR"], ["TABLE", "HINT"]):
        return
    yield node_at(n, f"Query hint {words[0]} binds the optimizer.")


@on("avoid-scalar-udf-in-query", "call")
def _(b: Batch, n: Node):
    if len(n.parts) >= 2 and any(p.type == "select_statement" for p, _ in ancestors(n)):
        yield node_at(n, "A scalar function runs once per row.")


@on("avoid-select-distinct", "select")
def _(b: Batch, n: Node):
    if n.distinct:
        yield At(n.distinct, n.distinct, "DISTINCT may hide a wrong join.")


@on("avoid-select-into", "select")
def _(b: Batch, n: Node):
    if n.into is not None:
        yield node_at(n.into, "SELECT INTO makes a table without a definition.")


@on("avoid-select-star", "select_star")
def _(b: Batch, n: Node):
    if n.qualifier is None and not any(p.type == "exists" for p, _ in ancestors(n)):
        yield node_at(n, "List the columns instead of *.")


@on("avoid-top-100-percent-order-by", "select")
def _(b: Batch, n: Node):
    if n.top is not None and n.top.percent and n.order is not None and n.top.expr.type == "literal" and b.t[n.top.expr.a] == "100":
        yield node_at(n.top, "TOP 100 PERCENT doesn't keep an order.")


@on("avoid-top-in-dml", "update", "delete")
def _(b: Batch, n: Node):
    if n.top is not None:
        yield node_at(n.top, "TOP takes arbitrary rows here.")


@on("avoid-upper-lower-in-predicate", "comparison")
def _(b: Batch, n: Node):
    if in_predicate(n):
        for x in (n.left, n.right):
            if call_name(x) in ("UPPER", "LOWER") and contains_column(x):
                yield node_at(x, "UPPER or LOWER over a column can't use an index.")


@on("like-leading-wildcard", "like")
def _(b: Batch, n: Node):
    if in_predicate(n) and is_string(b, n.right) and string_value(b.t[n.right.a])[:1] in ("%", "_", "["):
        yield node_at(n, "A leading wildcard can't use an index.")


def _filters_null(b: Batch, n: Node, column: str) -> bool:
    if n.type == "bool_binary":
        x, y = _filters_null(b, n.left, column), _filters_null(b, n.right, column)
        return (x or y) if n.op == "AND" else (x and y)
    if n.type == "bool_paren":
        return _filters_null(b, n.operand, column)
    return n.type == "is_null" and bool(n.negated) and n.operand.type == "column" and b.parts(n.operand)[-1].lower() == column


@on("prefer-exists-over-in-subquery", "in")
def _(b: Batch, n: Node):
    if n.subquery is None or not in_predicate(n):
        return
    q = n.subquery.query
    if q.type == "select" and len(q.d["items"]) == 1 and q.where is not None and q.where.cond is not None:
        x = q.d["items"][0]
        if x.type == "select_item" and x.expr.type == "column" and _filters_null(b, q.where.cond, b.parts(x.expr)[-1].lower()):
            return
    yield At(n.negated if n.negated is not None else n.at, n.at, "EXISTS treats NULL as expected and may stop early.")


@on("prefer-utc-datetime", "call", "parameterless_call")
def _(b: Batch, n: Node):
    name = call_name(n) if n.type == "call" else b.t[n.a].upper()
    if name in UTC_NAMES:
        yield node_at(n, f"Local time; use {UTC_NAMES[name]}.")


@on("require-data-compression", "create_table")
def _(b: Batch, n: Node):
    if not any(b.is_word(i, "DATA_COMPRESSION") for i in n.d["options"]):
        yield node_at(n.d["name"].parts[-1], "The table has no DATA_COMPRESSION option.")


@on("top-without-order-by", "select")
def _(b: Batch, n: Node):
    if n.top is not None and n.order is None and not (n.top.expr.type == "literal" and b.t[n.top.expr.a] == "0"):
        yield node_at(n.top, "TOP without ORDER BY takes arbitrary rows.")



# -- safety ------------------------------------------------------------------


@on("avoid-merge", "merge")
def _(b: Batch, n: Node):
    yield At(n.keyword_at, n.keyword_at, "MERGE has known defects.")


@on_script("cross-database-transaction")
def _(s: Script):
    depth = 0
    databases: set[str] = set()
    found: list[tuple[Batch, Node]] = []
    for b in s.batches:
        for n in b.nodes:
            if n.type == "begin_tran":
                depth += 1
            elif n.type in ("commit", "rollback") and depth:
                depth -= 1
                if not depth:
                    for fb, f in found:
                        yield Finding("", fb.start(f.a), fb.end(f.b), "The transaction writes to more than one database.")
                    databases, found = set(), []
            elif depth and n.type in ("insert", "update", "delete"):
                here = {p[-3].lower() for t in n.walk() if t.type == "table" and len(p := b.parts(t.d["name"])) >= 3 and p[-3]}
                databases |= here
                if here and len(databases) > 1:
                    found.append((b, n))
    for fb, f in found:
        yield Finding("", fb.start(f.a), fb.end(f.b), "The transaction writes to more than one database.")


_DROPS = ("DATABASE", "TABLE", "PROCEDURE", "VIEW", "FUNCTION")


@on("dangerous-ddl", "drop", "truncate", "alter_table")
def _(b: Batch, n: Node):
    if n.type == "drop":
        if n.kind not in _DROPS:
            return
        if n.kind == "TABLE" and all(is_temp(b.parts(x)[-1]) for x in n.names):
            return
        yield first(n, f"DROP {n.kind} destroys data or code.", severity=3 if n.if_exists else None)
    elif n.type == "truncate":
        yield first(n, "TRUNCATE TABLE removes all rows.")
    elif n.action == "DROP":
        yield first(n, "ALTER TABLE ... DROP removes data.", severity=3 if n.if_exists else None)


@on("dml-without-where", "update", "delete")
def _(b: Batch, n: Node):
    if n.where is not None:
        return
    t = n.target
    if t.type == "variable_table" or (t.type == "table" and is_temp(b.parts(t.d["name"])[-1])):
        return
    if t.type == "table" and n.from_:
        name = b.parts(t.d["name"])[-1].lower()
        if any(r.alias is not None and b.name(r.alias).lower() == name for r in flatten(n.from_)):
            return
    if any(j.kind == "INNER" for j in joins(n.from_)):
        return
    yield At(n.keyword_at, n.keyword_at, f"{n.type.upper()} without WHERE touches all rows.")


@on("require-drop-if-exists", "drop")
def _(b: Batch, n: Node):
    if n.kind in ("TABLE", "PROCEDURE", "VIEW", "FUNCTION") and not n.if_exists:
        if n.kind == "TABLE" and all(is_temp(b.parts(x)[-1]) for x in n.names):
            return
        yield pair(n, "DROP without IF EXISTS fails where the object is missing.")


# -- security ----------------------------------------------------------------


@on("avoid-dangerous-procedures", "execute")
def _(b: Batch, n: Node):
    if n.proc is not None and b.parts(n.proc)[-1].lower() in DANGEROUS_PROCEDURES:
        yield node_at(n.proc.parts[-1], "The procedure reaches outside the database.")


@on("avoid-exec-dynamic-sql", "execute")
def _(b: Batch, n: Node):
    if n.strings is not None:
        yield first(n, "EXEC of a string invites injection; use sp_executesql with parameters.")


@on("avoid-execute-as", "execute_as")
def _(b: Batch, n: Node):
    if n.kind != "CALLER":
        yield first(n, "EXECUTE AS changes the rights.")


@on("avoid-execute-as", "execute_as_option")
def _(b: Batch, n: Node):
    if not b.is_word(n.b, "CALLER"):
        yield node_at(n, "EXECUTE AS changes the rights.")


@on("avoid-openrowset-opendatasource", "rowset")
def _(b: Batch, n: Node):
    if n.kind in ("OPENROWSET", "OPENDATASOURCE"):
        yield first(n, f"{n.kind} opens an ad hoc connection.")


@on("require-parameterized-sp-executesql", "execute")
def _(b: Batch, n: Node):
    if n.proc is None or b.parts(n.proc)[-1].lower() != "sp_executesql":
        return
    if len(n.args) <= 1:
        yield node_at(n.proc.parts[-1], "sp_executesql without parameters.")


# -- schema ------------------------------------------------------------------


@on("avoid-deprecated-types", "data_type")
def _(b: Batch, n: Node):
    name = type_name(b, n)
    if name in DEPRECATED_TYPES:
        yield node_at(n, f"{name} is deprecated; use {DEPRECATED_TYPES[name]}.")


def _constraints(n: Node) -> Iterator[tuple[Node, Node | None]]:
    """(constraint or index, column it stands at)."""
    for e in n.elements or []:
        if e.type in ("constraint", "inline_index"):
            yield e, None
        for c in e.constraints or []:
            yield c, e


@on("avoid-heap-table", "create_table")
def _(b: Batch, n: Node):
    if n.elements is None or is_temp(b.parts(n.d["name"])[-1]):
        return
    explicit = [c for c, _ in _constraints(n) if c.d.get("clustered") is True]
    for c, _ in _constraints(n):
        if c.d.get("kind") == "PRIMARY" and c.d.get("clustered") is None and not explicit:
            return
    if not explicit:
        yield first(n, "The table has no clustered index.")


def _columns(n: Node) -> list[Node]:
    return [e for e in n.elements or [] if e.type == "column_definition"]


@on("duplicate-column-definition", "create_table")
def _(b: Batch, n: Node):
    for c in duplicates(_columns(n), lambda c: b.name(c.d["name"])):
        yield node_at(c, "The column is defined twice.")


@on("duplicate-foreign-key-column", "create_table")
def _(b: Batch, n: Node):
    for c, _ in _constraints(n):
        if c.d.get("kind") == "FOREIGN" and c.columns:
            for x in duplicates(c.columns, b.name):
                yield node_at(x, "The column occurs twice in the foreign key.")


@on("duplicate-index-column", "create_table")
def _(b: Batch, n: Node):
    for c, _ in _constraints(n):
        if (c.type == "inline_index" or c.d.get("kind") in ("PRIMARY", "UNIQUE")) and c.columns:
            for x in duplicates(c.columns, lambda x: b.name(x.d["name"])):
                yield node_at(x, "The column occurs twice in the index.")


@on("duplicate-index-definition", "create_table")
def _(b: Batch, n: Node):
    seen = set()
    for c, col in _constraints(n):
        if not (c.type == "inline_index" or c.d.get("kind") in ("PRIMARY", "UNIQUE")):
            continue
        if c.columns:
            key = tuple((b.name(x.d["name"]).lower(), bool(x.desc)) for x in c.columns)
        elif col is not None:
            key = ((b.name(col.d["name"]).lower(), False),)
        else:
            continue
        if key in seen:
            yield node_at(c, "An index of the same columns exists already.")
        seen.add(key)


@on("duplicate-table-function-column", "create_function")
def _(b: Batch, n: Node):
    if n.returns_table is not None:
        cols = [e for e in n.returns_table if e.type == "column_definition"]
        for c in duplicates(cols, lambda c: b.name(c.d["name"])):
            yield node_at(c, "The output column is defined twice.")
    elif n.query is not None and n.query.type == "select":
        for x in duplicates(n.query.d["items"], lambda x: output_name(b, x)):
            yield node_at(x, "The output column occurs twice.")


@on("duplicate-table-variable-column", "declare_table")
def _(b: Batch, n: Node):
    for c in duplicates(_columns(n), lambda c: b.name(c.d["name"])):
        yield node_at(c, "The column is defined twice.")


@on("duplicate-view-column", "create_view")
def _(b: Batch, n: Node):
    if n.columns:
        for c in duplicates(n.columns, b.name):
            yield node_at(c, "The view column occurs twice.")
    elif n.query.type == "select":
        for x in duplicates(n.query.d["items"], lambda x: output_name(b, x)):
            yield node_at(x, "The view column occurs twice.")


@on("require-primary-key-or-unique-constraint", "create_table")
def _(b: Batch, n: Node):
    if n.elements is None or is_temp(b.parts(n.d["name"])[-1]):
        return
    if not any(c.d.get("kind") in ("PRIMARY", "UNIQUE") or c.d.get("unique") for c, _ in _constraints(n)):
        yield node_at(n.d["name"].parts[-1], "The table has no key.")


@on_script("require-table-description")
def _(s: Script):
    tables: list[tuple[Batch, Node]] = []
    described: set[tuple] = set()
    for b in s.batches:
        for n in b.nodes:
            if n.type == "create_table" and n.elements is not None and not is_temp(b.parts(n.d["name"])[-1]):
                tables.append((b, n))
            elif n.type == "execute" and n.proc is not None and b.parts(n.proc)[-1].lower() == "sp_addextendedproperty":
                args = {}
                order = ("name", "value", "level0type", "level0name", "level1type", "level1name", "level2type", "level2name")
                for i, a in enumerate(n.args):
                    key = b.t[a.d["name"]][1:].lower() if a.d["name"] is not None else order[i] if i < len(order) else ""
                    v = a.value
                    args[key] = (string_value(b.t[v.a]) if b.t[v.a][-1:] == "'" else unquote(b.t[v.a])).lower()
                if args.get("name") == "ms_description" and args.get("level1type") == "table":
                    described.add((args.get("level0name", "dbo"), args.get("level1name"), args.get("level2name")))
    for b, n in tables:
        parts = b.parts(n.d["name"])
        schema = parts[-2].lower() if len(parts) > 1 and parts[-2] else "dbo"
        table = parts[-1].lower()
        if (schema, table, None) not in described:
            p = n.d["name"].parts[-1]
            yield Finding("", b.start(p.a), b.end(p.b), "The table has no MS_Description.")
        for c in _columns(n):
            i = c.d["name"]
            if (schema, table, b.name(i).lower()) not in described:
                yield Finding("", b.start(i.a), b.end(i.b), "The column has no MS_Description.")


# -- transactions ------------------------------------------------------------


def _has(nodes: list[Node], *types: str) -> bool:
    return any(x.type in types for s in nodes for x in s.walk())


@on("avoid-catch-swallowing", "try_catch")
def _(b: Batch, n: Node):
    if any(p.type == "try_catch" for p, _ in ancestors(n)):
        return
    if not _has(n.handler, "throw", "raiserror"):
        yield At(n.catch_at, n.catch_at + 1, "CATCH swallows the error.")


def _nonzero_return(b: Batch, nodes: list[Node]) -> bool:
    return any(x.type == "return" and x.expr is not None and b.text(x.expr).strip() != "0" for s in nodes for x in s.walk())


@on("require-throw-or-raiserror-in-catch", "try_catch")
def _(b: Batch, n: Node):
    if not _has(n.handler, "throw", "raiserror") and not _nonzero_return(b, n.handler):
        yield At(n.catch_at, n.catch_at + 1, "CATCH passes no error on.")


def _module_groups(b: Batch) -> Iterator[list[Node]]:
    """Nodes by procedure or function, and those of the batch outside of them; nothing without a transaction."""
    if not any(n.type == "begin_tran" for n in b.nodes):
        return
    outside: list[Node] = []
    groups: dict[int, list[Node]] = {}
    for n in b.nodes:
        owner = next((p for p, _ in ancestors(n) if p.type in ("create_procedure", "create_function")), None)
        (outside if owner is None else groups.setdefault(id(owner), [])).append(n)
    yield outside
    yield from groups.values()


@on_batch("avoid-transaction-without-commit")
def _(b: Batch):
    for g in _module_groups(b):
        begins = [n for n in g if n.type == "begin_tran"]
        if begins and not any(n.type in ("commit", "rollback") for n in g):
            for n in begins:
                yield pair(n, "The transaction is neither committed nor rolled back.")


@on_batch("require-save-transaction-in-nested")
def _(b: Batch):
    for g in _module_groups(b):
        depth, saved = 0, False
        for n in g:
            if n.type == "begin_tran":
                if depth and not saved:
                    yield pair(n, "A nested transaction without SAVE TRANSACTION.")
                depth += 1
            elif n.type == "save_tran":
                saved = True
            elif n.type in ("commit", "rollback"):
                depth = max(0, depth - 1)


@on("require-try-catch-for-transaction", "begin_tran")
def _(b: Batch, n: Node):
    if not any(p.type == "try_catch" for p, _ in ancestors(n)):
        yield first(n, "The transaction is outside TRY ... CATCH.")


def _preamble(rule: str, test: Callable[[Node], bool], what: str):
    @on_script(rule)
    def check(s: Script):
        statements = list(s.statements())
        module = any(n.type in ("create_procedure", "create_function") and n.verb == "CREATE" for _, n in statements)
        if not (module or len(statements) >= 3):
            return
        if not any(test(n) for _, n in statements[:10]):
            yield Finding("", 0, 0, f"The script doesn't start with {what}.")

    return check


for _rule, _option in (
    ("set-ansi", "ANSI_NULLS"),
    ("set-ansi-padding", "ANSI_PADDING"),
    ("set-ansi-warnings", "ANSI_WARNINGS"),
    ("set-arithabort", "ARITHABORT"),
    ("set-concat-null-yields-null", "CONCAT_NULL_YIELDS_NULL"),
    ("set-nocount", "NOCOUNT"),
    ("set-quoted-identifier", "QUOTED_IDENTIFIER"),
):
    _preamble(_rule, lambda n, o=_option: n.type == "set_option" and bool(n.on) and o in n.names, f"SET {_option} ON")
_preamble("set-transaction-isolation-level", lambda n: n.type == "set_isolation", "SET TRANSACTION ISOLATION LEVEL")


@on_script("set-xact-abort")
def _(s: Script):
    def switches_on(n: Node) -> bool:
        return n.type == "set_option" and bool(n.on) and "XACT_ABORT" in (n.names or [])

    # inside modules and blocks a setting anywhere at batch level counts, at batch level one before
    anywhere = any(switches_on(n) for _, n in s.statements())
    seen = False
    for b in s.batches:
        for n in b.nodes:
            if switches_on(n):
                seen = True
            elif n.type == "begin_tran" and not seen and not (anywhere and n.up is not None and n.up.type != "batch"):
                yield Finding("", b.start(n.a), b.end(n.a), "SET XACT_ABORT ON is missing before the transaction.")


@on_script("uncommitted-transaction")
def _(s: Script):
    begins, commits, rollbacks = [], [], []
    for b in s.batches:
        for n in b.nodes:
            if n.type in ("begin_tran", "commit", "rollback"):
                line = s.position(b.start(n.a))[0]
                {"begin_tran": begins, "commit": commits, "rollback": rollbacks}[n.type].append((line, b, n))
    used: set[tuple[str, int]] = set()
    for line, b, n in begins:
        for kind, ends in (("c", commits), ("r", rollbacks)):
            k = next((i for i, e in enumerate(ends) if (kind, i) not in used and e[0] > line), None)
            if k is not None:
                used.add((kind, k))
                break
        else:
            yield Finding("", b.start(n.a), b.end(min(n.a + 1, n.b)), "No COMMIT or ROLLBACK follows.")


# -- style -------------------------------------------------------------------


@on("avoid-magic-convert-style-for-datetime", "call")
def _(b: Batch, n: Node):
    if call_name(n) not in ("CONVERT", "TRY_CONVERT") or len(n.args) < 2 or n.args[1].type != "literal" or n.args[1].kind != "NUM":
        return
    kind = type_name(b, n.data_type)
    x = n.args[0]
    if kind in ("DATE", "TIME", *DATETIME_TYPES) or call_name(x) in DATETIME_FUNCTIONS or x.type == "parameterless_call":
        yield node_at(n, "A style number says little; name it or use FORMAT.")


@on("avoid-order-by-ordinal", "order_item")
def _(b: Batch, n: Node):
    if n.expr.type == "literal" and n.expr.kind == "NUM" and b.t[n.expr.a].isdigit() and not _in_over(n):
        yield node_at(n.expr, "Order by a name, not by a position.")


def _in_over(n: Node) -> bool:
    return any(p.type == "over" for p, _ in ancestors(n))


@on_script("duplicate-empty-line")
def _(s: Script):
    lines = re.split(r"\r\n|\r|\n", s.text)
    start = None
    for i, line in enumerate([*lines, "x"]):
        if not line.strip():
            if start is None:
                start = i
            continue
        if start is not None and i - start > 1:
            at = s.lines[start + 1] if start + 1 < len(s.lines) else len(s.text)
            yield Finding("", at, at, "More than one empty line.")
        start = None


@on_script("duplicate-go")
def _(s: Script):
    before = False
    for i, start in enumerate(s.lines):
        end = s.lines[i + 1] if i + 1 < len(s.lines) else len(s.text)
        line = s.text[start:end].strip()
        if not line or line.startswith("--"):
            continue
        go = line.upper() == "GO"
        if go and before:
            yield Finding("", start, start + 2, "GO follows GO.")
        before = go


@on_script("nested-block-comments")
def _(s: Script):
    for tok, at in zip(s.lexemes, s.offsets):
        if tok[:2] == "/*" and "/*" in tok[2:]:
            yield Finding("", at, at + len(tok), "A block comment within a block comment.")


@on_batch("normalize-execute-keyword")
def _(b: Batch):
    for i, k in enumerate(b.k):
        if k == "EXEC" and not (i and b.t[i - 1] == "."):
            yield At(i, i, "Write EXECUTE.", edits=[(b.start(i), b.end(i), "EXECUTE")])


@on("normalize-inequality-operator", "comparison")
def _(b: Batch, n: Node):
    if n.op == "!=":
        end = b.end(n.op_at) if b.t[n.op_at] == "!=" else b.end(n.op_at + 1)
        yield node_at(n, "Write <>.", edits=[(b.start(n.op_at), end, "<>")])


@on_batch("normalize-procedure-keyword")
def _(b: Batch):
    for i, k in enumerate(b.k):
        if k == "PROC" and i and b.k[i - 1] in ("CREATE", "ALTER", "DROP"):
            yield At(i, i, "Write PROCEDURE.", edits=[(b.start(i), b.end(i), "PROCEDURE")])


@on("normalize-transaction-keyword", "begin_tran", "save_tran", "commit", "rollback")
def _(b: Batch, n: Node):
    for i in range(n.a, n.b + 1):
        if b.k[i] == "TRAN":
            yield At(i, i, "Write TRANSACTION.", edits=[(b.start(i), b.end(i), "TRANSACTION")])
            return
        if b.k[i] in ("TRANSACTION", "WORK"):
            return
    if n.type in ("commit", "rollback"):
        yield At(n.a, n.a, "Write TRANSACTION.", edits=[(b.end(n.a), b.end(n.a), " TRANSACTION")])


@on("prefer-coalesce-over-nested-isnull", "call")
def _(b: Batch, n: Node):
    if call_name(n) == "ISNULL" and any(call_name(x) == "ISNULL" for x in n.args or []):
        yield node_at(n, "Use COALESCE.")


def _chain(n: Node) -> list[Node]:
    """Operands of a + chain; a parenthesis is one operand."""
    if n.type == "binary" and n.op == "+":
        return _chain(n.left) + _chain(n.right)
    return [n]


def _operands(n: Node) -> Iterator[Node]:
    """Operands of nested binary operators of any kind."""
    if n.type == "binary":
        yield from _operands(n.left)
        yield from _operands(n.right)
    else:
        yield n


def _outermost(n: Node) -> bool:
    return not (n.up is not None and n.up.type == "binary" and n.up.op == "+")


@on("prefer-concat-over-plus", "binary")
def _(b: Batch, n: Node):
    if n.op == "+" and _outermost(n) and any(call_name(x) in ("ISNULL", "COALESCE") for x in _operands(n)):
        yield node_at(n, "Use CONCAT.")


@on("prefer-concat-with-nullable", "binary")
def _(b: Batch, n: Node):
    if n.op == "+" and any(call_name(x) in ("ISNULL", "COALESCE", "CAST", "CONVERT") for x in _operands(n)):
        yield node_at(n, "Use CONCAT.")


@on("prefer-concat-ws", "binary")
def _(b: Batch, n: Node):
    if n.op != "+":
        return
    literals = [string_value(b.t[x.a]) for x in _chain(n) if is_string(b, x)]
    short = [x for x in literals if len(x) <= 3]
    if len(literals) >= 3 and len(set(short)) < len(short):
        yield node_at(n, "Use CONCAT_WS.")


#: Character sequences that only JSON texts have (fixed values).
_JSON_MARKS = ('":', "':", '{"', '"}', "[{", "}]", "},{", ',"')
_BRACKETS = re.compile(r"\[([^\]]*)\]")


def _character_class(v: str) -> bool:
    """Brackets as in a LIKE pattern: pairs without any structural character of JSON."""
    inner = _BRACKETS.findall(v)
    return bool(inner) and not any(c in x for x in inner for c in '":{},')


def _looks_like_json(v: str) -> bool:
    return any(m in v for m in _JSON_MARKS) or ("{" in v and "}" in v) or ("[" in v and "]" in v and not _character_class(v))


def _literals(b: Batch, n: Node) -> Iterator[str]:
    if is_string(b, n):
        yield string_value(b.t[n.a])
    elif n.type == "binary":
        yield from _literals(b, n.left)
        yield from _literals(b, n.right)
    elif n.type == "call":
        for x in n.args or []:
            yield from _literals(b, x)


@on("prefer-json-functions", "call")
def _(b: Batch, n: Node):
    if call_name(n) not in ("CHARINDEX", "SUBSTRING", "PATINDEX", "STUFF", "REPLACE"):
        return
    texts = [v for x in n.args or [] for v in _literals(b, x)]
    joined = "".join(texts)
    braces = "{" in joined and "}" in joined
    brackets = "[" in joined and "]" in joined and any(("[" in v or "]" in v) and not _character_class(v) for v in texts)
    if any(_looks_like_json(v) for v in texts) or braces or brackets:
        yield node_at(n, "Use the JSON functions.")


@on("prefer-trim-over-ltrim-rtrim", "call")
def _(b: Batch, n: Node):
    inner = {"LTRIM": "RTRIM", "RTRIM": "LTRIM"}.get(call_name(n))
    if inner and len(n.args) == 1 and call_name(n.args[0]) == inner:
        yield node_at(n, "Use TRIM.")


@on("prefer-string-agg-over-stuff", "call")
def _(b: Batch, n: Node):
    if call_name(n) == "STUFF" and _for_clause(n) is not None:
        yield node_at(n, "Use STRING_AGG.")


@on("prefer-try-convert-patterns", "case")
def _(b: Batch, n: Node):
    if n.operand is not None:
        return
    for w, t in zip(n.whens, n.thens):
        tested = (x for c in _comparisons(w) for x in (c.left, c.right))
        if any(call_name(x) in ("ISNUMERIC", "ISDATE") for x in tested) and any(call_name(x) in ("CAST", "CONVERT") for x in t.walk()):
            yield At(n.a, n.a, "Use TRY_CONVERT or TRY_CAST.")
            return


_NARROW = ("CHAR", "VARCHAR", "TEXT")
_BYTES = ("BINARY", "VARBINARY", "IMAGE")


def _needs_no_unicode(b: Batch, n: Node, types: dict[str, str]) -> bool:
    """Whether a literal stands where its encoding matters, so that it must stay as it is."""
    p = n.up
    if p.type == "comparison":
        other = p.right if p.left is n else p.left
        if not is_string(b, other):
            return True
    if p.type == "like" and p.right is n:
        return True
    if p.type in ("declaration", "parameter") and p.value is n and type_name(b, p.type_) in _NARROW:
        return True
    if p.type == "set_variable" and p.expr is n and p.var is not None and types.get(b.t[p.var].lower()) in _NARROW:
        return True
    if p.type == "select_set" and p.expr is n and types.get(b.t[p.a].lower()) in _NARROW:
        return True
    for p, c in ancestors(n):
        if p.type in ("insert", "update", "merge", "execute") or (p.type == "in" and c is not p.left):
            return True
        if p.type == "call":
            if p.data_type is None:
                if call_name(p) not in _OWN_EXPRESSIONS:
                    return True
            elif call_name(p) in ("CAST", "CONVERT") and c is p.args[0] and type_name(b, p.data_type) in _NARROW + _BYTES:
                return True
    return False


@on_script("prefer-unicode-string-literals")
def _(s: Script):
    types: dict[str, str] = {}
    for b in s.batches:
        for n in b.nodes:
            if n.type in ("declaration", "parameter") and n.type_ is not None:
                types[b.t[n.a].lower()] = type_name(b, n.type_)
            elif is_string(b, n) and b.t[n.a][0] not in "nN" and n.up is not None and not _needs_no_unicode(b, n, types):
                at = b.start(n.a)
                yield Finding("", at, b.end(n.a), "The literal isn't Unicode; write N'...'.", [(at, at, "N")])


def _many_tables(q: Node) -> bool:
    return sum(1 for _ in flatten(q.from_)) > 1


def _bare_columns(b: Batch, n: Node) -> Iterator[Node]:
    for c in [n, *own_nodes(n)]:
        if c.type == "column" and len(c.parts) == 1:
            up = c.up
            if up is not None and up.type == "call" and call_name(up) in DATEPART_FIRST and up.args and up.args[0] is c:
                continue
            yield c


@on("qualified-select-columns", "select")
def _(b: Batch, n: Node):
    if _many_tables(n):
        for item in n.d["items"]:
            if item.type in ("select_item", "select_set"):
                for c in _bare_columns(b, item.expr):
                    yield node_at(c, "Qualify the column with its table.")


@on("require-as-for-column-alias", "select_item")
def _(b: Batch, n: Node):
    if n.alias is not None and n.alias_form == "":
        at = b.start(n.alias.a)
        yield node_at(n.alias, "Write AS before the alias.", edits=[(at, at, "AS ")])


@on("require-as-for-table-alias", "table", "derived_table")
def _(b: Batch, n: Node):
    if n.alias is not None and n.alias_form == "":
        at = b.start(n.alias.a)
        yield node_at(n.alias, "Write AS before the alias.", edits=[(at, at, "AS ")])


@on("require-begin-end-for-while", "while")
def _(b: Batch, n: Node):
    if n.body.type != "block":
        yield first(n, "The body of WHILE needs BEGIN ... END.")


_FLOW = ("return", "break", "continue", "throw")


@on("require-begin-end-lenient", "if")
def _(b: Batch, n: Node):
    if n.then.type not in ("block", *_FLOW):
        yield first(n, "The body of IF needs BEGIN ... END.")
    if n.else_ is not None and n.else_.type not in ("block", "if", *_FLOW):
        yield At(n.else_at, n.else_at, "The body of ELSE needs BEGIN ... END.")


def _wrap(b: Batch, body: Node) -> list[tuple[int, int, str]]:
    text = b.script.text
    start, end = b.start(body.a), b.end(body.b)
    line = text.rfind("\n", 0, start) + 1
    indent = re.match(r"[ \t]*", text[line:start]).group() if text[line:start].strip() == "" else ""
    brk = "\r\n" if "\r\n" in text else "\n"
    outer = indent[:-4] if indent.endswith("    ") else indent[:-1] if indent.endswith("\t") else indent
    head = f"BEGIN{brk}{indent or '    '}"
    after = "" if text[end : end + 1].isspace() or end >= len(text) else brk
    if text[line:start].strip() == "" and indent:
        return [(start - len(indent), start, outer + head), (end, end, f"{brk}{outer}END{after}")]
    return [(start, start, head), (end, end, f"{brk}{outer}END{after}")]


@on("require-begin-end-strict", "if")
def _(b: Batch, n: Node):
    if n.then.type != "block":
        yield first(n, "The body of IF needs BEGIN ... END.", edits=_wrap(b, n.then))
    if n.else_ is not None and n.else_.type not in ("block", "if"):
        yield At(n.else_at, n.else_at, "The body of ELSE needs BEGIN ... END.", edits=_wrap(b, n.else_))


@on("require-explicit-join", "select")
def _(b: Batch, n: Node):
    for r in (n.from_ or [])[1:]:
        yield node_at(r, "Join with JOIN, not with a comma.")


@on("require-explicit-join-type", "join")
def _(b: Batch, n: Node):
    if n.join_at is None:
        return
    hinted = n.join_at > n.at and b.k[n.join_at - 1] in ("LOOP", "HASH", "MERGE", "REMOTE")
    if n.kind == "INNER" and not n.explicit:
        i = n.join_at - 1 if hinted else n.join_at
        at = b.start(i)
        yield At(n.join_at, n.join_at, "Write INNER JOIN.", edits=[(at, at, "INNER ")])
    elif n.kind in ("LEFT", "RIGHT", "FULL") and not n.outer:
        i = n.join_at - 1 if hinted else n.join_at
        at = b.start(i)
        yield At(n.join_at, n.join_at, f"Write {n.kind} OUTER JOIN.", edits=[(at, at, "OUTER ")])


@on("require-qualified-columns-everywhere", "select")
def _(b: Batch, n: Node):
    if not _many_tables(n):
        return
    places = [n.where, n.order, *(j.d.get("on") for j in joins(n.from_))]
    for p in places:
        if p is not None:
            for c in _bare_columns(b, p):
                yield node_at(c, "Qualify the column with its table.")


@on("require-schema-qualify-exec", "execute")
def _(b: Batch, n: Node):
    if n.proc is None or len(n.proc.parts) != 1:
        return
    name = b.parts(n.proc)[-1]
    if not is_temp(name) and name.lower() not in SYSTEM_PROCEDURES:
        yield node_at(n.proc, "Qualify the procedure with its schema.")


@on_script("semantic-case-sensitive-variables")
def _(s: Script):
    declared: dict[str, str] = {}
    for b in s.batches:
        places = set()
        for n in b.nodes:
            if n.type in ("declaration", "parameter", "declare_table"):
                declared.setdefault(b.t[n.a].lower(), b.t[n.a])
                places.add(n.a)
        for i, k in enumerate(b.k):
            if k == "VAR" and i not in places and not b.t[i].startswith("@@"):
                if i and b.k[i - 1] in ("EXEC", "EXECUTE") and i + 1 < len(b.k) and b.k[i + 1] != "=":
                    continue
                want = declared.get(b.t[i].lower())
                if want is not None and want != b.t[i] and not _is_argument_name(b, i):
                    yield Finding("", b.start(i), b.end(i), f"The variable is declared as {want}.")


def _is_argument_name(b: Batch, i: int) -> bool:
    """@name of ``EXEC p @name = value``: a parameter of the other procedure."""
    return i + 1 < len(b.k) and b.k[i + 1] == "=" and any(n.type == "exec_arg" and n.a == i and n.d["name"] is not None for n in b.nodes)


@on("semantic-multi-table-alias", "select_statement")
def _(b: Batch, n: Node):
    q = n.query
    if q.type != "select" or not any(True for _ in joins(q.from_)):
        return
    for p in [*q.d["items"], q.where, q.group, q.having, q.order, *(j.d.get("on") for j in joins(q.from_))]:
        if p is not None:
            for c in _bare_columns(b, p):
                yield node_at(c, "Qualify the column with its table.")


@on("semantic-schema-qualify", "table")
def _(b: Batch, n: Node):
    parts = b.parts(n.d["name"])
    if len(parts) == 1 and not is_temp(parts[0]) and not parts[0].startswith("@"):
        yield node_at(n.d["name"], "Qualify the table with its schema.")


@on_script("semicolon-termination")
def _(s: Script):
    for b, n in s.statements():
        if n.type != "label" and b.t[n.b] != ";":
            end = b.end(n.b)
            yield Finding("", b.start(n.b), end, "The statement doesn't end with a semicolon.", [(end, end, ";")])


@on("avoid-print-statement", "print")
def _(b: Batch, n: Node):
    yield first(n, "PRINT is for debugging.")

