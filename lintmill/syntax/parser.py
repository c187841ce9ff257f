"""Recursive-descent parser for T-SQL batches.

Input is the list of significant lexemes of a text (no white space, no comments) and
the kind of each.  A kind is the upper-case word for words the grammar knows, ``ID``
for other names, ``QID`` for quoted names, ``VAR``, ``STR``, ``NUM``, or the operator
itself.  Decisions look at most ``LOOK`` kinds past what a statement consumes and at
nothing else, so a statement's verdict depends on its kinds alone; ``StatementMemo``
uses that to recognise statements whose shape was already parsed.

Nodes carry first and last token index, so every rule can compute exact ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

from lintmill.syntax.lexer import is_trivia
from lintmill.syntax.words import KEYWORDS, RESERVED, STARTERS

LOOK = 4
_MAX_KINDS = 200_000


class ParseError(Exception):
    def __init__(self, at: int, message: str):
        super().__init__(message)
        self.at, self.message = at, message


class Node:
    """A syntax node: type, first and last token, attributes (nodes, lists of nodes, plain values)."""

    __slots__ = ("type", "a", "b", "d", "up")

    def __init__(self, type_: str, a: int, b: int, d: dict):
        self.type, self.a, self.b, self.d, self.up = type_, a, b, d, None

    def __getattr__(self, name):
        try:
            return self.d[name]
        except KeyError:
            return None

    def __getstate__(self):
        return (self.type, self.a, self.b, self.d)

    def __repr__(self):
        return f"{self.type}[{self.a}..{self.b}]"

    def kids(self) -> Iterator["Node"]:
        for v in self.d.values():
            if v.__class__ is Node:
                yield v
            elif v.__class__ is list:
                for x in v:
                    if x.__class__ is Node:
                        yield x

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(list(n.kids())))


class _Kinds(dict):
    """Kind of a lexeme; "" for trivia without and "\\n" for white space with a line break.

    Words and operators are remembered, lexemes that seldom repeat are not.
    """

    def __missing__(self, tok: str) -> str:
        c = tok[0]
        if c == "'" or (c in "nN" and tok[1:2] == "'"):
            return "STR"
        if "0" <= c <= "9" or (c == "." and len(tok) > 1) or (c == "$" and tok[1:2].isdigit()):
            return "NUM"
        if tok[:2] in ("--", "/*"):
            return "--"
        if c == "[" or c == '"':
            return "QID" if len(tok) > 2 else "BAD"
        if is_trivia(tok):
            k = "\n" if "\n" in tok or "\r" in tok else ""
        elif c == "@":
            k = "VAR" if len(tok) > 1 else "BAD"
        elif c == "#" or c == "$":
            k = "ID" if len(tok) > 1 else "BAD"
        elif c == "_" or c.isalpha():
            u = tok.upper()
            k = u if u in KEYWORDS or u == "GO" else "ID"
        else:
            k = tok
        if len(self) >= _MAX_KINDS:
            self.clear()
        self[tok] = k
        return k


KINDS = _Kinds()
_TRIVIA = frozenset({"", "\n", "--"})


def kind_of(tok: str) -> str:
    """The grammar kind of one lexeme."""
    k = KINDS[tok]
    return "ID" if k == "GO" else k


def separators(lexemes: list[str], kinds: list[str]) -> list[tuple[int, int]]:
    """(GO, lexeme after it and its count) of each line that separates batches; any other GO becomes a name in ``kinds``."""
    cuts = []
    if "GO" in kinds:
        n = len(kinds)
        for i, k in enumerate(kinds):
            if k != "GO":
                continue
            j = i - 1
            while j >= 0 and kinds[j] == "" :
                j -= 1
            alone = j < 0 or kinds[j] == "\n" or (kinds[j] == "--" and ("\n" in lexemes[j] or "\r" in lexemes[j]))
            e = i + 1
            if alone:
                while e < n and kinds[e] == "":
                    e += 1
                if e < n and kinds[e] == "NUM" and lexemes[e].isdigit():
                    e += 1
                    while e < n and kinds[e] == "":
                        e += 1
                if e < n and kinds[e] == ";":
                    e += 1
                    while e < n and kinds[e] == "":
                        e += 1
                alone = e >= n or kinds[e] == "\n" or lexemes[e][:2] == "--"
            if alone:
                cuts.append((i, e))
            else:
                kinds[i] = "ID"
    return cuts


def batches(lexemes: list[str]) -> list[tuple[int, int, list[str], list[str]]]:
    """Split lexemes into batches at lines that hold only GO and perhaps a count.

    A batch is (first lexeme, lexeme after the last, significant lexemes, their kinds).
    """
    kinds = list(map(KINDS.__getitem__, lexemes))
    cuts = separators(lexemes, kinds)
    out = []
    start = 0
    for i, e in [*cuts, (len(kinds), len(kinds))]:
        ks = kinds[start:i] if cuts else kinds
        if ks:
            mask = [k not in _TRIVIA for k in ks]
            sig = list(compress(ks, mask))
            if sig:
                out.append((start, i, list(compress(lexemes[start:i] if cuts else lexemes, mask)), sig))
        start = e
    return out


_NAMES = frozenset({"ID", "QID"}) | (KEYWORDS - RESERVED)
_LITERALS = frozenset({"STR", "NUM"})
_SIMPLE_END = frozenset({",", ")", ";", "EOF"})
_COMPARE = frozenset({"=", "<", ">", "<>", "!=", "<=", ">=", "!<", "!>", "*="})
_ADDITIVE = frozenset({"+", "-", "&", "|", "^", "||"})
_MULTIPLICATIVE = frozenset({"*", "/", "%"})
_ASSIGN = frozenset({"=", "+=", "-=", "*=", "/=", "%=", "&=", "^=", "|="})
_PAREN_FREE = frozenset("CURRENT_TIMESTAMP CURRENT_USER SESSION_USER SYSTEM_USER USER CURRENT_DATE CURRENT_TIME".split())
_CALL_WORDS = frozenset("LEFT RIGHT COALESCE NULLIF CONVERT TRY_CONVERT IDENTITY UPDATE CONTAINS FREETEXT OPENXML".split())
_ROWSET_CALLS = frozenset(
    "OPENROWSET OPENQUERY OPENDATASOURCE OPENXML CONTAINSTABLE FREETEXTTABLE SEMANTICKEYPHRASETABLE SEMANTICSIMILARITYTABLE SEMANTICSIMILARITYDETAILSTABLE".split()
)
_JOIN_HINTS = frozenset({"LOOP", "HASH", "MERGE", "REMOTE"})
_STATEMENT_LIKE = STARTERS | {"END", "ELSE", "EOF", ";", "GO"}


class Parser:
    def __init__(self, toks: list[str], kinds: list[str], memo: "StatementMemo | None" = None):
        self.t, self.k, self.i, self.memo = toks, kinds + ["EOF"] * (LOOK + 1), 0, memo

    # -- helpers -------------------------------------------------------------
    def fail(self, message: str | None = None):
        i = self.i
        near = self.t[i] if i < len(self.t) else "end of batch"
        raise ParseError(i, message or f"Incorrect syntax near '{near}'.")

    def want(self, kind: str) -> int:
        if self.k[self.i] != kind:
            self.fail()
        self.i += 1
        return self.i - 1

    def take(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def word(self, text: str) -> bool:
        """Take a word that is no keyword of the grammar, by its text."""
        i = self.i
        if self.k[i] in _NAMES and self.k[i] != "QID" and self.t[i].upper() == text:
            self.i += 1
            return True
        return False

    def is_word(self, text: str, off: int = 0) -> bool:
        i = self.i + off
        return self.k[i] in _NAMES and self.k[i] != "QID" and i < len(self.t) and self.t[i].upper() == text

    def node(self, type_: str, a: int, /, **d) -> Node:
        return Node(type_, a, self.i - 1, d)

    def name(self) -> Node:
        if self.k[self.i] not in _NAMES:
            self.fail()
        self.i += 1
        return Node("ident", self.i - 1, self.i - 1, {})

    def multipart(self, most: int = 4) -> Node:
        """a.b.c, a..c, .a; a part may be missing between dots."""
        a = self.i
        parts: list = []
        while self.k[self.i] == ".":
            parts.append(None)
            self.i += 1
        parts.append(self.name())
        while self.k[self.i] == ".":
            self.i += 1
            while self.k[self.i] == ".":
                parts.append(None)
                self.i += 1
            parts.append(self.name())
        if len(parts) > most:
            self.fail()
        return self.node("object_name", a, parts=parts)

    def comma_list(self, item) -> list:
        out = [item()]
        while self.k[self.i] == ",":
            self.i += 1
            out.append(item())
        return out

    def paren_list(self, item) -> list:
        self.want("(")
        out = self.comma_list(item)
        self.want(")")
        return out

    # -- expressions ---------------------------------------------------------
    def scalar(self) -> Node:
        i = self.i
        k = self.k
        if k[i] in _LITERALS and k[i + 1] in _SIMPLE_END:
            self.i = i + 1
            return Node("literal", i, i, {"kind": k[i]})
        n = self.expr(1)
        if n.d.get("bool"):
            self.i = n.b + 1
            self.fail("An expression of non-boolean type is expected.")
        return n

    def condition(self) -> Node:
        n = self.expr(0)
        if not n.d.get("bool"):
            self.fail("An expression of non-boolean type specified in a context where a condition is expected.")
        return n

    def expr(self, scalar_only: int) -> Node:
        left = self.conjunction(scalar_only)
        while self.k[self.i] == "OR" and not scalar_only:
            op = self.i
            self.i += 1
            right = self.conjunction(0)
            if not (left.d.get("bool") and right.d.get("bool")):
                self.fail()
            left = self.node("bool_binary", left.a, bool=True, op="OR", op_at=op, left=left, right=right)
        return left

    def conjunction(self, scalar_only: int) -> Node:
        left = self.negation(scalar_only)
        while self.k[self.i] == "AND" and not scalar_only:
            op = self.i
            self.i += 1
            right = self.negation(0)
            if not (left.d.get("bool") and right.d.get("bool")):
                self.fail()
            left = self.node("bool_binary", left.a, bool=True, op="AND", op_at=op, left=left, right=right)
        return left

    def negation(self, scalar_only: int) -> Node:
        if self.k[self.i] == "NOT" and not scalar_only:
            a = self.i
            self.i += 1
            n = self.negation(0)
            if not n.d.get("bool"):
                self.fail()
            return self.node("not", a, bool=True, operand=n)
        return self.predicate(scalar_only)

    def predicate(self, scalar_only: int) -> Node:
        k = self.k
        a = self.i
        kind = k[a]
        if not scalar_only:
            if kind == "EXISTS":
                self.i += 1
                return self.node_sub("exists", a)
            if kind in ("CONTAINS", "FREETEXT") and k[a + 1] == "(":
                self.i += 1
                args = self.any_args()
                return self.node("fulltext_predicate", a, bool=True, args=args)
            if kind == "UPDATE" and k[a + 1] == "(":
                self.i += 2
                self.name()
                self.want(")")
                return self.node("update_call", a, bool=True)
        left = self.additive()
        if scalar_only:
            return left
        kind = k[self.i]
        if left.d.get("bool"):
            return left
        if kind in _COMPARE or (kind in ("<", ">") and k[self.i + 1] == "="):
            op = self.i
            self.i += 1
            text = kind
            if kind in "<>!" and k[self.i] in ("=", ">") and (kind != ">" or k[self.i] == "="):
                text += k[self.i]
                self.i += 1
            elif kind == "=" and k[self.i] == "*":
                text = "=*"
                self.i += 1
            if k[self.i] in ("ALL", "ANY", "SOME"):
                self.i += 1
                sub = self.subquery()
                return self.node("quantified", a, bool=True, left=left, subquery=sub)
            right = self.additive()
            if right.d.get("bool"):
                self.fail()
            return self.node("comparison", a, bool=True, op=text, op_at=op, left=left, right=right)
        if kind == "!" and k[self.i + 1] in ("=", "<", ">"):
            op = self.i
            self.i += 2
            right = self.additive()
            return self.node("comparison", a, bool=True, op="!" + k[op + 1], op_at=op, left=left, right=right)
        negated = None
        if kind == "NOT" and k[self.i + 1] in ("IN", "LIKE", "BETWEEN"):
            negated = self.i
            self.i += 1
            kind = k[self.i]
        if kind == "IS":
            self.i += 1
            neg = self.take("NOT")
            if self.take("DISTINCT"):
                self.want("FROM")
                right = self.additive()
                return self.node("distinct_predicate", a, bool=True, left=left, right=right)
            self.want("NULL")
            return self.node("is_null", a, bool=True, operand=left, negated=neg)
        if kind == "IN":
            at = self.i
            self.i += 1
            if k[self.i] == "(" and k[self.i + 1] in ("SELECT", "WITH") or (k[self.i] == "(" and self.paren_query()):
                sub = self.subquery()
                return self.node("in", a, bool=True, left=left, subquery=sub, negated=negated, at=at)
            values = self.paren_list(self.scalar)
            return self.node("in", a, bool=True, left=left, values=values, negated=negated, at=at)
        if kind == "LIKE":
            at = self.i
            self.i += 1
            right = self.additive()
            if self.take("ESCAPE"):
                self.additive()
            return self.node("like", a, bool=True, left=left, right=right, negated=negated, at=at)
        if kind == "BETWEEN":
            at = self.i
            self.i += 1
            low = self.additive()
            self.want("AND")
            high = self.additive()
            return self.node("between", a, bool=True, left=left, low=low, high=high, negated=negated, at=at)
        return left

    def node_sub(self, type_: str, a: int) -> Node:
        sub = self.subquery()
        return self.node(type_, a, bool=True, subquery=sub)

    def paren_query(self) -> bool:
        """Whether the parenthesis at i opens, after any more parentheses, a query."""
        j = self.i
        while self.k[j] == "(":
            j += 1
        return self.k[j] == "SELECT"

    def subquery(self) -> Node:
        a = self.i
        self.want("(")
        q = self.query(nested=True)
        self.want(")")
        return self.node("subquery", a, query=q)

    def additive(self) -> Node:
        left = self.multiplicative()
        k = self.k
        while k[self.i] in _ADDITIVE:
            op = self.i
            self.i += 1
            right = self.multiplicative()
            if left.d.get("bool") or right.d.get("bool"):
                self.fail()
            left = self.node("binary", left.a, op=k[op], op_at=op, left=left, right=right)
        return left

    def multiplicative(self) -> Node:
        left = self.unary()
        k = self.k
        while k[self.i] in _MULTIPLICATIVE:
            op = self.i
            self.i += 1
            right = self.unary()
            if left.d.get("bool") or right.d.get("bool"):
                self.fail()
            left = self.node("binary", left.a, op=k[op], op_at=op, left=left, right=right)
        return left

    def unary(self) -> Node:
        k = self.k
        a = self.i
        if k[a] in ("-", "+", "~"):
            self.i += 1
            n = self.unary()
            if n.d.get("bool"):
                self.fail()
            return self.node("unary", a, operand=n, op=k[a])
        n = self.primary()
        while True:
            kind = k[self.i]
            if kind == "COLLATE":
                self.i += 1
                self.name()
                n = Node("collate", n.a, self.i - 1, {"operand": n})
            elif kind == "AT" and self.is_word("TIME", 1) and k[self.i + 2] == "ZONE":
                self.i += 3
                z = self.unary()
                n = Node("at_time_zone", n.a, self.i - 1, {"operand": n, "zone": z})
            elif kind == "." and n.type in ("subquery", "call", "paren", "variable"):
                self.i += 1
                self.name()
                if k[self.i] == "(":
                    args = self.call_args()
                    n = Node("method_call", n.a, self.i - 1, {"target": n, "args": args})
                else:
                    n = Node("property", n.a, self.i - 1, {"target": n})
            elif kind == "::" and n.type == "column":
                self.i += 1
                self.name()
                if k[self.i] == "(":
                    args = self.call_args()
                    n = Node("method_call", n.a, self.i - 1, {"args": args})
            else:
                return n

    def primary(self) -> Node:
        k = self.k
        a = self.i
        kind = k[a]
        if kind in _LITERALS:
            self.i += 1
            return Node("literal", a, a, {"kind": kind})
        if kind == "VAR":
            self.i += 1
            return Node("variable", a, a, {})
        if kind == "NULL":
            self.i += 1
            return Node("literal", a, a, {"kind": "NULL"})
        if kind == "(":
            if self.paren_query() and self.is_query_paren():
                return self.subquery()
            self.i += 1
            n = self.expr(0)
            self.want(")")
            if n.d.get("bool"):
                return Node("bool_paren", a, self.i - 1, {"bool": True, "operand": n})
            return Node("paren", a, self.i - 1, {"operand": n})
        if kind == "CASE":
            return self.case()
        if kind in _PAREN_FREE and k[a + 1] != "(":
            self.i += 1
            return Node("parameterless_call", a, a, {})
        if kind == "*":
            self.fail()
        if kind == "DEFAULT":
            self.i += 1
            return Node("default", a, a, {})
        if k[a + 1] == "(":
            if kind in _NAMES or kind in _CALL_WORDS:
                return self.call(a)
        if kind in ("IDENTITYCOL", "ROWGUIDCOL"):
            self.i += 1
            return Node("column", a, a, {"parts": [Node("ident", a, a, {})]})
        if kind == "NEXT" and k[a + 1] == "VALUE" and k[a + 2] == "FOR":
            self.i += 3
            self.multipart()
            if k[self.i] == "OVER":
                self.over()
            return self.node("next_value", a)
        if kind not in _NAMES and kind != ".":
            self.fail()
        parts: list = []
        while k[self.i] == ".":
            parts.append(None)
            self.i += 1
        parts.append(self.name())
        while k[self.i] == ".":
            self.i += 1
            while k[self.i] == ".":
                parts.append(None)
                self.i += 1
            if k[self.i] in ("IDENTITYCOL", "ROWGUIDCOL"):
                parts.append(Node("ident", self.i, self.i, {}))
                self.i += 1
                break
            if k[self.i] in _CALL_WORDS and k[self.i + 1] == "(":
                parts.append(Node("ident", self.i, self.i, {}))
                self.i += 1
            else:
                parts.append(self.name())
            if k[self.i] == "(":
                return self.call(a, parts)
        if len(parts) > 5:
            self.fail()
        return self.node("column", a, parts=parts)

    def is_query_paren(self) -> bool:
        """``((SELECT 1))`` and ``(SELECT 1) + 1`` alike start with a query; a scalar parenthesis around one does too."""
        return self.k[self.i + 1] in ("SELECT", "WITH") or self.balanced_query()

    def balanced_query(self) -> bool:
        # "((select ...) union (select ...))" is a query, "((select 1) + 1)" a scalar expression
        depth, j = 0, self.i + 1
        k = self.k
        while k[j] != "EOF":
            if k[j] == "(":
                depth += 1
            elif k[j] == ")":
                depth -= 1
                if depth == 0:
                    return k[j + 1] in ("UNION", "EXCEPT", "INTERSECT", "ORDER")
            j += 1
        return False

    def case(self) -> Node:
        k = self.k
        a = self.i
        self.i += 1
        operand = None
        if k[self.i] != "WHEN":
            operand = self.scalar()
        whens, thens = [], []
        while self.take("WHEN"):
            whens.append(self.scalar() if operand is not None else self.condition())
            self.want("THEN")
            thens.append(self.scalar())
        if not whens:
            self.fail()
        els = None
        if self.take("ELSE"):
            els = self.scalar()
        self.want("END")
        return self.node("case", a, operand=operand, whens=whens, thens=thens, else_=els)

    def any_args(self) -> list:
        """Arguments of constructs with their own argument forms: columns, *, lists, LANGUAGE n."""
        self.want("(")
        out = []
        depth = 1
        while depth:
            kind = self.k[self.i]
            if kind == "EOF" or kind == ";":
                self.fail()
            if kind == "(":
                depth += 1
            elif kind == ")":
                depth -= 1
                if depth == 0:
                    break
            self.i += 1
        self.want(")")
        return out

    def call_args(self) -> list:
        self.want("(")
        if self.take(")"):
            return []
        out = self.comma_list(self.argument)
        self.want(")")
        return out

    def argument(self) -> Node:
        k = self.k
        i = self.i
        if k[i] == "*":
            self.i += 1
            return Node("star", i, i, {})
        if k[i] == "SELECT":
            q = self.query(nested=True)
            return self.node("subquery", i, query=q)
        return self.scalar()

    def call(self, a: int, parts: list | None = None) -> Node:
        k = self.k
        if parts is None:
            at = self.i
            self.i += 1
            parts = [Node("ident", at, at, {})]
        name_at = parts[-1].a
        name = self.t[name_at].upper() if k[name_at] != "QID" else ""
        d: dict = {"parts": parts, "name": name}
        if len(parts) == 1 and name in ("CAST", "TRY_CAST"):
            self.want("(")
            d["args"] = [self.scalar()]
            self.want("AS")
            d["data_type"] = self.data_type()
            self.want(")")
        elif len(parts) == 1 and name in ("CONVERT", "TRY_CONVERT"):
            self.want("(")
            d["data_type"] = self.data_type()
            self.want(",")
            d["args"] = self.comma_list(self.scalar)
            self.want(")")
        elif len(parts) == 1 and name in ("PARSE", "TRY_PARSE"):
            self.want("(")
            d["args"] = [self.scalar()]
            self.want("AS")
            d["data_type"] = self.data_type()
            if self.take("USING"):
                self.scalar()
            self.want(")")
        elif len(parts) == 1 and name == "IIF":
            self.want("(")
            cond = self.condition()
            self.want(",")
            x = self.scalar()
            self.want(",")
            y = self.scalar()
            self.want(")")
            d["args"] = [cond, x, y]
        elif len(parts) == 1 and name in ("TRIM",):
            self.want("(")
            for w in ("LEADING", "TRAILING", "BOTH"):
                if self.is_word(w) and k[self.i + 1] not in (",", ")", "."):
                    self.i += 1
                    break
            d["args"] = [self.scalar()]
            if self.take("FROM"):
                d["args"].append(self.scalar())
            self.want(")")
        elif len(parts) == 1 and name in ("JSON_OBJECT", "JSON_ARRAY"):
            self.want("(")
            args = []
            while k[self.i] != ")":
                if k[self.i] in ("NULL", "ID") and k[self.i + 1] == "ON":
                    self.i += 2
                    self.want("NULL")
                    break
                args.append(self.scalar())
                if self.take(":"):
                    args.append(self.scalar())
                if not self.take(","):
                    if k[self.i] in ("NULL", "ID") and k[self.i + 1] == "ON":
                        self.i += 2
                        self.want("NULL")
                    break
            self.want(")")
            d["args"] = args
        elif name == "IDENTITY" and len(parts) == 1:
            self.want("(")
            d["data_type"] = self.data_type()
            while self.take(","):
                self.scalar()
            self.want(")")
            d["args"] = []
        else:
            self.want("(")
            if self.take("DISTINCT"):
                d["distinct"] = True
            elif k[self.i] == "ALL":
                self.i += 1
            if self.take(")"):
                d["args"] = []
            else:
                d["args"] = self.comma_list(self.argument)
                self.want(")")
        if k[self.i] == "WITHIN" and k[self.i + 1] == "GROUP":
            self.i += 2
            self.want("(")
            d["within"] = self.order_by()
            self.want(")")
        if k[self.i] in ("ID",) and self.t[self.i].upper() in ("IGNORE", "RESPECT") and self.is_word("NULLS", 1):
            self.i += 2
        if k[self.i] == "OVER":
            d["over"] = self.over()
        return self.node("call", a, **d)

    def over(self) -> Node:
        k = self.k
        a = self.want("OVER")
        if k[self.i] in _NAMES:
            self.i += 1
            return self.node("over", a)
        self.want("(")
        d: dict = {}
        if k[self.i] in _NAMES and k[self.i] not in ("PARTITION", "ROWS", "RANGE"):
            self.i += 1
        if k[self.i] == "PARTITION" and k[self.i + 1] == "BY":
            self.i += 2
            d["partition"] = self.comma_list(self.scalar)
        if k[self.i] == "ORDER":
            d["order"] = self.order_by()
        if k[self.i] in ("ROWS", "RANGE"):
            self.i += 1
            if self.take("BETWEEN"):
                self.frame_bound()
                self.want("AND")
                self.frame_bound()
            else:
                self.frame_bound()
        self.want(")")
        return self.node("over", a, **d)

    def frame_bound(self):
        k = self.k
        if k[self.i] == "UNBOUNDED":
            self.i += 1
            if k[self.i] not in ("PRECEDING", "FOLLOWING"):
                self.fail()
            self.i += 1
        elif k[self.i] == "CURRENT":
            self.i += 1
            self.want("ROW")
        else:
            self.scalar()
            if k[self.i] not in ("PRECEDING", "FOLLOWING"):
                self.fail()
            self.i += 1

    def data_type(self) -> Node:
        k = self.k
        a = self.i
        if k[a] == "NATIONAL":
            self.i += 1
            self.name()
            if k[self.i] == "VARYING":
                self.i += 1
            parts = [Node("ident", a + 1, a + 1, {})]
        elif k[a] == "DOUBLE":
            self.i += 1
            self.word("PRECISION")
            parts = [Node("ident", a, a, {})]
        elif k[a] == "CURSOR":
            self.i += 1
            parts = [Node("ident", a, a, {})]
        else:
            parts = self.multipart(3).d["parts"]
            if k[self.i] == "VARYING":
                self.i += 1
        args = None
        if k[self.i] == "(":
            self.i += 1
            args = []
            while True:
                at = self.i
                if k[at] == "MAX" or k[at] == "NUM" or (k[at] == "ID") or k[at] in ("CONTAINED", "QID") or self.is_word("DOCUMENT") or self.is_word("CONTENT"):
                    self.i += 1
                    args.append(Node("literal", at, at, {"kind": k[at]}))
                    if k[at] != "NUM" and k[self.i] in _NAMES or k[self.i] == ".":
                        while k[self.i] in _NAMES or k[self.i] == ".":
                            self.i += 1
                else:
                    self.fail()
                if not self.take(","):
                    break
            self.want(")")
        return self.node("data_type", a, parts=parts, args=args)

    # -- queries -------------------------------------------------------------
    def order_by(self) -> Node:
        a = self.want("ORDER")
        self.want("BY")
        items = self.comma_list(self.order_item)
        return self.node("order_by", a, items=items)

    def order_item(self) -> Node:
        a = self.i
        e = self.scalar()
        desc = False
        if self.k[self.i] in ("ASC", "DESC"):
            desc = self.k[self.i] == "DESC"
            self.i += 1
        return self.node("order_item", a, expr=e, desc=desc)

    def query(self, nested: bool = False) -> Node:
        """Query expression with set operations, ORDER BY, OFFSET and FOR."""
        a = self.i
        if nested and self.k[a] == "WITH" and self.k[a + 1] == "XMLNAMESPACES":
            self.with_clause()
        q = self.query_term()
        k = self.k
        while k[self.i] in ("UNION", "EXCEPT"):
            op = k[self.i]
            self.i += 1
            all_ = self.take("ALL") if op == "UNION" else False
            r = self.query_term()
            q = self.node("set_operation", a, op=op, all=all_, left=q, right=r)
        self.query_tail(q, a)
        return q

    def query_tail(self, q: Node, a: int):
        k = self.k
        if k[self.i] == "ORDER":
            q.d["order"] = self.order_by()
            if k[self.i] == "OFFSET":
                self.i += 1
                self.scalar()
                if not (self.word("ROWS") or self.word("ROW")):
                    self.fail()
                q.d["offset"] = True
                if k[self.i] == "FETCH":
                    self.i += 1
                    if not (self.word("NEXT") or self.word("FIRST")):
                        self.fail()
                    self.scalar()
                    if not (self.word("ROWS") or self.word("ROW")):
                        self.fail()
                    if not self.word("ONLY"):
                        self.fail()
            q.b = self.i - 1
        if k[self.i] == "FOR" and k[self.i + 1] in ("XML", "JSON", "BROWSE"):
            self.i += 1
            q.d["for"] = k[self.i]
            self.i += 1
            if q.d["for"] != "BROWSE":
                q.d["for_mode"] = self.t[self.i].upper() if self.i < len(self.t) else ""
                self.for_options()
            q.b = self.i - 1

    def for_options(self):
        k = self.k
        while True:
            if k[self.i] not in _NAMES:
                self.fail()
            self.i += 1
            if k[self.i] == "(":
                self.i += 1
                if k[self.i] not in _LITERALS:
                    self.fail()
                self.i += 1
                self.want(")")
            elif k[self.i - 1] in ("ELEMENTS",) and self.is_word("XSINIL") or self.is_word("ABSENT"):
                self.i += 1
            elif self.is_word("BASE64"):
                self.i += 1
            if not self.take(","):
                return

    def query_term(self) -> Node:
        a = self.i
        q = self.query_primary()
        while self.k[self.i] == "INTERSECT":
            self.i += 1
            r = self.query_primary()
            q = self.node("set_operation", a, op="INTERSECT", all=False, left=q, right=r)
        return q

    def query_primary(self) -> Node:
        a = self.i
        if self.k[a] == "(":
            self.i += 1
            q = self.query()
            self.want(")")
            return self.node("query_paren", a, query=q)
        return self.select_core()

    def select_core(self) -> Node:
        k = self.k
        a = self.want("SELECT")
        d: dict = {}
        if k[self.i] == "DISTINCT":
            d["distinct"] = self.i
            self.i += 1
        elif k[self.i] == "ALL":
            self.i += 1
        if k[self.i] == "TOP":
            d["top"] = self.top()
        d["items"] = self.comma_list(self.select_item)
        if k[self.i] == "INTO":
            into_at = self.i
            self.i += 1
            d["into"] = self.multipart()
            d["into_at"] = into_at
            if k[self.i] == "ON" and k[self.i + 1] in _NAMES:
                self.i += 2
        if k[self.i] == "FROM":
            at = self.i
            self.i += 1
            d["from_"] = self.comma_list(self.table_source)
            d["from_at"] = at
        if k[self.i] == "WHERE":
            at = self.i
            self.i += 1
            c = self.condition()
            d["where"] = self.node("where", at, cond=c)
        if k[self.i] == "GROUP":
            at = self.i
            self.i += 1
            self.want("BY")
            self.take("ALL")
            items = self.comma_list(self.group_item)
            if k[self.i] == "WITH" and k[self.i + 1] in ("CUBE", "ROLLUP"):
                self.i += 2
            d["group"] = self.node("group_by", at, items=items)
        if k[self.i] == "HAVING":
            at = self.i
            self.i += 1
            c = self.condition()
            d["having"] = self.node("having", at, cond=c)
        if k[self.i] == "WINDOW" and k[self.i + 1] in _NAMES and k[self.i + 2] == "AS":
            self.i += 1
            while True:
                self.name()
                self.want("AS")
                self.i -= 1
                self.k[self.i] = "OVER"  # same inside as OVER (...)
                self.over()
                if not self.take(","):
                    break
        return self.node("select", a, **d)

    def top(self) -> Node:
        a = self.want("TOP")
        if self.k[self.i] == "(":
            self.i += 1
            e = self.scalar()
            self.want(")")
        elif self.k[self.i] in ("NUM", "VAR"):
            e = Node("literal" if self.k[self.i] == "NUM" else "variable", self.i, self.i, {"kind": self.k[self.i]})
            self.i += 1
        else:
            self.fail()
        pct = self.take("PERCENT")
        if self.k[self.i] == "WITH" and self.k[self.i + 1] == "TIES":
            self.i += 2
        return self.node("top", a, expr=e, percent=pct)

    def select_item(self) -> Node:
        k = self.k
        a = self.i
        if k[a] == "*":
            self.i += 1
            return Node("select_star", a, a, {"qualifier": None})
        if k[a] == "VAR" and k[a + 1] in _ASSIGN:
            op = k[a + 1]
            self.i += 2
            e = self.scalar()
            return self.node("select_set", a, expr=e, op=op)
        if k[a] in _NAMES or k[a] == "STR":
            if k[a + 1] == "=":
                self.i += 2
                e = self.scalar()
                return self.node("select_item", a, expr=e, alias=Node("ident", a, a, {}), alias_form="=")
        # qualified star: name(.name)* . *
        j = a
        while k[j] in _NAMES and k[j + 1] == ".":
            j += 2
            if k[j] == "*":
                parts = [Node("ident", x, x, {}) for x in range(a, j, 2)]
                self.i = j + 1
                return Node("select_star", a, j, {"qualifier": parts})
        e = self.scalar()
        alias, form = self.column_alias()
        return self.node("select_item", a, expr=e, alias=alias, alias_form=form)

    def column_alias(self):
        k = self.k
        if k[self.i] == "AS":
            self.i += 1
            if k[self.i] == "STR" or k[self.i] in _NAMES:
                self.i += 1
                return Node("ident", self.i - 1, self.i - 1, {}), "AS"
            self.fail()
        if k[self.i] == "STR" or (k[self.i] in _NAMES and not self.starts_here()):
            self.i += 1
            return Node("ident", self.i - 1, self.i - 1, {}), ""
        return None, None

    def starts_here(self) -> bool:
        """Whether the contextual word at i goes on with the clause or starts a statement instead of naming an alias."""
        k, i = self.k, self.i
        kind = k[i]
        if kind in ("ID", "QID"):
            return kind == "ID" and k[i + 1] == ":" and k[i + 2] != ":"
        nxt = k[i + 1]
        if kind == "THROW":
            return nxt in (";", "NUM", "VAR", "EOF", "END")
        if kind in ("OUTPUT", "USING"):
            return True
        if kind == "WINDOW":
            return nxt in _NAMES
        if kind in ("ENABLE", "DISABLE"):
            return nxt == "TRIGGER"
        if kind == "OFFSET":
            return nxt in ("NUM", "VAR", "(")
        if kind == "GET" or kind == "SEND" or kind == "RECEIVE" or kind == "MOVE":
            return nxt in ("CONVERSATION", "TOP", "ON", "DIALOG")
        return False

    def group_item(self) -> Node:
        k = self.k
        a = self.i
        if k[a] in ("CUBE", "ROLLUP") and k[a + 1] == "(":
            self.i += 1
            items = self.paren_list(self.group_item)
            return self.node("grouping", a, kind=k[a], items=items)
        if k[a] == "GROUPING" and k[a + 1] == "SETS":
            self.i += 2
            items = self.paren_list(self.group_item)
            return self.node("grouping", a, kind="SETS", items=items)
        if k[a] == "(" and k[a + 1] == ")":
            self.i += 2
            return self.node("grouping", a, kind="TOTAL", items=[])
        if k[a] == "(":
            # composite (a, b) or a parenthesised expression
            self.i += 1
            items = self.comma_list(self.scalar)
            self.want(")")
            if len(items) > 1:
                return self.node("grouping", a, kind="COMPOSITE", items=items)
            self.i = a
        e = self.scalar()
        return self.node("group_item", a, expr=e)

    # -- FROM ----------------------------------------------------------------
    def table_source(self) -> Node:
        k = self.k
        a = self.i
        left = self.table_primary()
        while True:
            kind = k[self.i]
            at = self.i
            if kind == "CROSS":
                self.i += 1
                if self.take("APPLY"):
                    right = self.table_primary()
                    left = self.node("join", a, kind="CROSS APPLY", left=left, right=right, at=at)
                else:
                    self.want("JOIN")
                    right = self.table_primary()
                    left = self.node("join", a, kind="CROSS", left=left, right=right, at=at)
                continue
            if kind == "OUTER" and k[self.i + 1] == "APPLY":
                self.i += 2
                right = self.table_primary()
                left = self.node("join", a, kind="OUTER APPLY", left=left, right=right, at=at)
                continue
            if kind in ("PIVOT", "UNPIVOT"):
                left = self.pivot(left, a)
                continue
            jt, outer = "INNER", False
            j = self.i
            explicit = False
            if kind == "INNER":
                j += 1
                explicit = True
            elif kind in ("LEFT", "RIGHT", "FULL"):
                jt = kind
                j += 1
                if k[j] == "OUTER":
                    outer = True
                    j += 1
            if k[j] in _JOIN_HINTS and k[j + 1] == "JOIN" and (j > self.i):
                j += 1
            if k[j] != "JOIN":
                if j > self.i:
                    self.i = j
                    self.fail()
                return left
            join_at = j
            self.i = j + 1
            right = self.table_source()
            self.want("ON")
            c = self.condition()
            left = self.node("join", a, kind=jt, outer=outer, explicit=explicit, left=left, right=right, on=c, at=at, join_at=join_at)

    def pivot(self, left: Node, a: int) -> Node:
        k = self.k
        un = k[self.i] == "UNPIVOT"
        self.i += 1
        self.want("(")
        if un:
            self.name()
            self.want("FOR")
            self.name()
        else:
            self.comma_list(self.select_item)
            self.want("FOR")
            self.multipart()
        self.want("IN")
        self.paren_list(self.multipart)
        self.want(")")
        alias, form = self.table_alias(required=False)
        return self.node("pivot", a, source=left, alias=alias, unpivot=un)

    def table_alias(self, required: bool = False):
        k = self.k
        if self.take("AS"):
            n = self.name()
            return n, "AS"
        if k[self.i] in _NAMES and not self.starts_here():
            n = self.name()
            return n, ""
        if required:
            self.fail()
        return None, None

    def table_primary(self) -> Node:
        k = self.k
        a = self.i
        kind = k[a]
        if kind == "(":
            if self.paren_query() and self.is_query_paren():
                sub = self.subquery()
                alias, form = self.table_alias(required=True)
                cols = self.paren_list(self.name) if k[self.i] == "(" else None
                return self.node("derived_table", a, query=sub.d["query"], alias=alias, alias_form=form, columns=cols)
            if k[a + 1] == "VALUES":
                self.i += 2
                rows = self.comma_list(lambda: self.row_value())
                self.want(")")
                alias, form = self.table_alias(required=True)
                cols = self.paren_list(self.name) if k[self.i] == "(" else None
                return self.node("values_table", a, rows=rows, alias=alias, alias_form=form, columns=cols)
            if k[a + 1] in ("INSERT", "UPDATE", "DELETE", "MERGE"):
                self.i += 1
                s = self.dml()
                self.want(")")
                alias, form = self.table_alias(required=True)
                cols = self.paren_list(self.name) if k[self.i] == "(" else None
                return self.node("dml_table", a, statement=s, alias=alias, columns=cols)
            self.i += 1
            t = self.table_source()
            self.want(")")
            return self.node("join_paren", a, source=t)
        if kind == "VAR":
            self.i += 1
            if k[self.i] == "." and k[self.i + 1] in _NAMES:
                self.i += 2
                self.call_args()
                alias, form = self.table_alias()
                if k[self.i] == "(":
                    self.paren_list(self.name)
                return self.node("method_table", a, alias=alias)
            alias, form = self.table_alias()
            return self.node("variable_table", a, alias=alias, alias_form=form)
        if kind in _ROWSET_CALLS:
            self.i += 1
            args_at = self.i
            self.any_args()
            if kind == "OPENDATASOURCE":
                while self.take("."):
                    while self.take("."):
                        pass
                    self.name()
            if kind == "OPENXML" and k[self.i] == "WITH":
                self.i += 1
                if k[self.i] == "(":
                    self.any_args()
                else:
                    self.multipart()
            alias, form = self.table_alias()
            cols = self.paren_list(self.name) if k[self.i] == "(" else None
            return self.node("rowset", a, kind=kind, alias=alias, alias_form=form, args_at=args_at, columns=cols)
        name = self.multipart()
        if k[self.i] == "(" :
            legacy = k[self.i + 1] in ("ID",) and self.t[self.i + 1].upper() in ("NOLOCK", "UPDLOCK", "READPAST", "TABLOCK", "TABLOCKX", "ROWLOCK", "HOLDLOCK", "READUNCOMMITTED", "PAGLOCK", "XLOCK")
            if legacy or k[self.i + 1] == "HOLDLOCK":
                hints = self.table_hints(False)
                alias, form = self.table_alias()
                return self.node("table", a, name=name, alias=alias, alias_form=form, hints=hints)
            args = self.call_args()
            base = self.t[name.d["parts"][-1].a].upper()
            if base == "OPENJSON" and k[self.i] == "WITH" and k[self.i + 1] == "(":
                self.i += 2
                while True:
                    self.name()
                    self.data_type()
                    if k[self.i] == "STR":
                        self.i += 1
                    if self.take("AS"):
                        self.want("JSON")
                    if not self.take(","):
                        break
                self.want(")")
            alias, form = self.table_alias()
            cols = self.paren_list(self.name) if alias is not None and k[self.i] == "(" else None
            return self.node("function_table", a, name=name, args=args, alias=alias, alias_form=form, columns=cols)
        if k[self.i] == "FOR" and k[self.i + 1] == "SYSTEM_TIME":
            self.i += 2
            self.system_time()
        if k[self.i] == "FOR" and self.is_word("PATH", 1):
            self.i += 2
        alias, form = self.table_alias()
        if k[self.i] == "TABLESAMPLE":
            self.i += 1
            self.word("SYSTEM")
            self.any_args()
            if self.word("REPEATABLE"):
                self.any_args()
        hints = []
        if k[self.i] == "WITH" and k[self.i + 1] == "(":
            self.i += 1
            hints = self.table_hints(True)
        elif k[self.i] == "(" and alias is not None and k[self.i + 1] in ("ID", "HOLDLOCK", "INDEX"):
            hints = self.table_hints(False)
        elif k[self.i] == "HOLDLOCK":
            self.i += 1
        return self.node("table", a, name=name, alias=alias, alias_form=form, hints=hints)

    def system_time(self):
        k = self.k
        if self.take("AS"):
            self.want("OF")
            self.scalar()
        elif self.take("ALL"):
            pass
        elif self.take("FROM"):
            self.scalar()
            self.want("TO")
            self.scalar()
        elif self.take("BETWEEN"):
            self.scalar()
            self.want("AND")
            self.scalar()
        elif k[self.i] == "CONTAINED":
            self.i += 1
            self.want("IN")
            self.any_args()
        else:
            self.fail()

    def table_hints(self, with_: bool) -> list:
        self.want("(")
        out = []
        while True:
            a = self.i
            kind = self.k[a]
            if kind in _NAMES or kind in ("HOLDLOCK", "INDEX"):
                self.i += 1
                if self.k[self.i] == "(":
                    self.any_args()
                elif self.take("="):
                    if self.k[self.i] == "(":
                        self.any_args()
                    else:
                        self.i += 1
            else:
                self.fail()
            out.append(self.node("table_hint", a, text=self.t[a].upper()))
            self.take(",")
            if self.take(")"):
                return out

    def row_value(self) -> Node:
        a = self.want("(")
        k = self.k
        values = []
        while True:
            i = self.i
            if k[i] in _LITERALS and k[i + 1] in (",", ")"):
                values.append(Node("literal", i, i, {"kind": k[i]}))
                self.i = i + 2
                if k[i + 1] == ")":
                    break
                continue
            values.append(self.scalar())
            if self.take(")"):
                break
            self.want(",")
        return self.node("row", a, values=values)

    # -- statements ----------------------------------------------------------
    def script(self) -> Node:
        """One batch."""
        body = self.statements(("EOF",))
        if self.k[self.i] != "EOF":
            self.fail()
        return Node("batch", 0, self.i - 1, {"body": body})

    def statements(self, stop: tuple) -> list:
        out = []
        k = self.k
        while True:
            while k[self.i] == ";":
                self.i += 1
            if k[self.i] in stop:
                return out
            if k[self.i] == "EOF":
                self.fail()
            out.append(self.statement())

    def statement(self) -> Node:
        memo = self.memo
        a = self.i
        if memo is not None:
            end = memo.find(self.k, a)
            if end:
                self.i = end
                return Node("seen", a, end - 1, {})
        n = self.statement_core()
        if self.k[self.i] == ";":
            self.i += 1
            n.b = self.i - 1
            n.d["semicolon"] = True
        if memo is not None and n.type not in _COMPOUND:
            memo.add(self.k, a, self.i)
        return n

    def statement_core(self) -> Node:
        k = self.k
        a = self.i
        kind = k[a]
        f = _STATEMENTS.get(kind)
        if f is not None:
            return f(self, a)
        if kind in _NAMES:
            if k[a + 1] == ":" and kind != "QID":
                self.i += 2
                return self.node("label", a)
            if kind in ("ENABLE", "DISABLE") and k[a + 1] == "TRIGGER":
                return self.loose(a, "trigger_switch")
            if kind in ("SEND", "RECEIVE", "GET", "MOVE") and k[a + 1] in ("ON", "TOP", "CONVERSATION", "*", "(", "DIALOG"):
                return self.loose(a, "service_broker")
            if a == 0 or self.first_of_batch(a):
                return self.exec_body(a, False)
        if kind == "(" :
            if self.paren_query():
                return self.select_statement(a)
        self.fail()

    def first_of_batch(self, a: int) -> bool:
        return all(x == ";" for x in self.k[:a])

    def select_statement(self, a: int, ctes: list | None = None) -> Node:
        q = self.query()
        option = self.option_clause()
        return self.node("select_statement", a, ctes=ctes, query=q, option=option)

    def option_clause(self):
        if self.k[self.i] == "OPTION":
            a = self.i
            self.i += 1
            self.want("(")
            hints = []
            depth = 0
            start = self.i
            while True:
                kind = self.k[self.i]
                if kind == "EOF" or kind == ";":
                    self.fail()
                if kind == "(":
                    depth += 1
                elif kind == ")":
                    if depth == 0:
                        break
                    depth -= 1
                elif kind == "," and depth == 0:
                    hints.append(Node("query_hint", start, self.i - 1, {}))
                    start = self.i + 1
                self.i += 1
            if start == self.i:
                self.fail()
            hints.append(Node("query_hint", start, self.i - 1, {}))
            self.want(")")
            return self.node("option", a, hints=hints)
        return None

    def with_clause(self) -> list:
        self.want("WITH")
        k = self.k
        ctes = []
        while True:
            if k[self.i] == "XMLNAMESPACES":
                self.i += 1
                self.any_args()
            elif self.is_word("CHANGE_TRACKING_CONTEXT"):
                self.i += 1
                self.any_args()
            else:
                a = self.i
                name = self.name()
                cols = self.paren_list(self.name) if k[self.i] == "(" else None
                self.want("AS")
                self.want("(")
                q = self.query(nested=True)
                self.want(")")
                ctes.append(self.node("cte", a, name=name, columns=cols, query=q))
            if not self.take(","):
                return ctes

    def s_with(self, a: int) -> Node:
        ctes = self.with_clause()
        kind = self.k[self.i]
        if kind == "SELECT" or kind == "(":
            return self.select_statement(a, ctes)
        if kind in ("INSERT", "UPDATE", "DELETE", "MERGE"):
            n = self.dml(a)
            n.d["ctes"] = ctes
            return n
        self.fail()

    def s_select(self, a: int) -> Node:
        return self.select_statement(a)

    def dml(self, a: int | None = None) -> Node:
        a = self.i if a is None else a
        kind = self.k[self.i]
        f = {"INSERT": self.s_insert, "UPDATE": self.s_update, "DELETE": self.s_delete, "MERGE": self.s_merge}.get(kind)
        if f is None:
            self.fail()
        return f(a)

    def dml_target(self) -> Node:
        k = self.k
        a = self.i
        if k[a] == "VAR":
            self.i += 1
            return self.node("variable_table", a)
        if k[a] in _ROWSET_CALLS:
            self.i += 1
            self.any_args()
            while self.take("."):
                while self.take("."):
                    pass
                self.name()
            return self.node("rowset", a, kind=k[a])
        name = self.multipart()
        hints = []
        if k[self.i] == "WITH" and k[self.i + 1] == "(":
            self.i += 1
            hints = self.table_hints(True)
        return self.node("table", a, name=name, alias=None, hints=hints)

    def output_clause(self):
        if self.k[self.i] == "OUTPUT":
            a = self.i
            self.i += 1
            items = self.comma_list(self.select_item)
            if self.take("INTO"):
                self.dml_target()
                if self.k[self.i] == "(":
                    self.paren_list(self.name)
                if self.k[self.i] == "OUTPUT":
                    self.i += 1
                    self.comma_list(self.select_item)
            return self.node("output", a, items=items)
        return None

    def s_insert(self, a: int) -> Node:
        k = self.k
        self.want("INSERT")
        d: dict = {"keyword_at": self.i - 1}
        if k[self.i] == "BULK":
            return self.loose(a, "insert_bulk")
        if k[self.i] == "TOP":
            d["top"] = self.top()
        d["into"] = self.take("INTO")
        d["target"] = self.dml_target()
        if k[self.i] == "(" and not self.paren_query():
            d["columns"] = self.paren_list(self.multipart)
        d["output"] = self.output_clause()
        if k[self.i] == "VALUES":
            self.i += 1
            d["rows"] = self.comma_list(self.row_value)
        elif k[self.i] == "DEFAULT":
            self.i += 1
            self.want("VALUES")
            d["default_values"] = True
        elif k[self.i] in ("EXEC", "EXECUTE"):
            d["exec"] = self.s_exec(self.i)
        elif k[self.i] == "SELECT" or k[self.i] == "(":
            d["query"] = self.query()
        elif k[self.i] in ("MERGE", "DELETE", "UPDATE", "WITH"):
            self.fail()
        else:
            self.fail()
        d["option"] = self.option_clause()
        return self.node("insert", a, **d)

    def set_clause(self) -> Node:
        k = self.k
        a = self.i
        if k[a] == "VAR":
            self.i += 1
            if k[self.i] not in _ASSIGN:
                self.fail()
            self.i += 1
            if k[self.i] in _NAMES and k[self.i + 1] in _ASSIGN:
                col = self.multipart()
                self.i += 1
                e = self.scalar()
                return self.node("assignment", a, column=col, expr=e)
            e = self.scalar()
            if k[self.i] == "=":
                self.i += 1
                e = self.scalar()
            return self.node("assignment", a, column=None, expr=e)
        col = self.multipart()
        if k[self.i] == "(":
            self.call_args()
            return self.node("assignment", a, column=col, expr=None)
        if k[self.i] not in _ASSIGN:
            self.fail()
        self.i += 1
        e = self.scalar()
        return self.node("assignment", a, column=col, expr=e)

    def where_clause(self):
        if self.k[self.i] == "WHERE":
            at = self.i
            self.i += 1
            if self.k[self.i] == "CURRENT" and self.k[self.i + 1] == "OF":
                self.i += 2
                self.word("GLOBAL")
                if self.k[self.i] == "VAR":
                    self.i += 1
                else:
                    self.name()
                return self.node("where", at, cond=None)
            c = self.condition()
            return self.node("where", at, cond=c)
        return None

    def s_update(self, a: int) -> Node:
        k = self.k
        at = self.want("UPDATE")
        if k[self.i] == "STATISTICS":
            return self.loose(a, "update_statistics")
        d: dict = {"keyword_at": at}
        if k[self.i] == "TOP":
            d["top"] = self.top()
        d["target"] = self.dml_target()
        self.want("SET")
        d["sets"] = self.comma_list(self.set_clause)
        d["output"] = self.output_clause()
        if self.take("FROM"):
            d["from_"] = self.comma_list(self.table_source)
        d["where"] = self.where_clause()
        d["option"] = self.option_clause()
        return self.node("update", a, **d)

    def s_delete(self, a: int) -> Node:
        k = self.k
        d: dict = {"keyword_at": self.want("DELETE")}
        if k[self.i] == "TOP":
            d["top"] = self.top()
        self.take("FROM")
        d["target"] = self.dml_target()
        d["output"] = self.output_clause()
        if self.take("FROM"):
            d["from_"] = self.comma_list(self.table_source)
        d["where"] = self.where_clause()
        d["option"] = self.option_clause()
        return self.node("delete", a, **d)

    def s_merge(self, a: int) -> Node:
        k = self.k
        d: dict = {"keyword_at": self.want("MERGE")}
        if k[self.i] == "TOP":
            d["top"] = self.top()
        self.take("INTO")
        t = self.dml_target()
        alias, form = self.table_alias()
        t.d["alias"], t.d["alias_form"] = alias, form
        t.b = self.i - 1
        d["target"] = t
        self.want("USING")
        d["source"] = self.table_source()
        self.want("ON")
        d["on"] = self.condition()
        actions = []
        while k[self.i] == "WHEN":
            w = self.i
            self.i += 1
            self.take("NOT")
            self.want("MATCHED")
            if self.take("BY"):
                if not (self.word("TARGET") or self.word("SOURCE")):
                    self.fail()
            cond = self.condition() if self.take("AND") else None
            self.want("THEN")
            if self.take("UPDATE"):
                self.want("SET")
                act = {"sets": self.comma_list(self.set_clause)}
            elif self.take("DELETE"):
                act = {}
            elif self.take("INSERT"):
                act = {}
                if k[self.i] == "(":
                    act["columns"] = self.paren_list(self.multipart)
                if self.take("DEFAULT"):
                    self.want("VALUES")
                else:
                    self.want("VALUES")
                    act["row"] = self.row_value()
            else:
                self.fail()
            actions.append(self.node("merge_action", w, cond=cond, **act))
        if not actions:
            self.fail()
        d["actions"] = actions
        d["output"] = self.output_clause()
        d["option"] = self.option_clause()
        if k[self.i] != ";":
            self.fail("A MERGE statement must be terminated by a semi-colon (;).")
        return self.node("merge", a, **d)

    # control flow
    def s_if(self, a: int) -> Node:
        self.i += 1
        c = self.condition()
        then = self.statement()
        els = None
        at = None
        if self.k[self.i] == "ELSE":
            at = self.i
            self.i += 1
            els = self.statement()
        return self.node("if", a, cond=c, then=then, else_=els, else_at=at)

    def s_while(self, a: int) -> Node:
        self.i += 1
        c = self.condition()
        body = self.statement()
        return self.node("while", a, cond=c, body=body)

    def s_begin(self, a: int) -> Node:
        k = self.k
        self.i += 1
        kind = k[self.i]
        if kind in ("TRAN", "TRANSACTION") or (kind == "DISTRIBUTED" and k[self.i + 1] in ("TRAN", "TRANSACTION")):
            if kind == "DISTRIBUTED":
                self.i += 1
            self.i += 1
            self.tran_name()
            if k[self.i] == "WITH" and self.is_word("MARK", 1):
                self.i += 2
                if k[self.i] == "STR":
                    self.i += 1
            return self.node("begin_tran", a)
        if kind == "TRY":
            self.i += 1
            body = self.statements(("END",))
            self.want("END")
            self.want("TRY")
            self.take(";")
            self.want("BEGIN")
            catch_at = self.i - 1
            self.want("CATCH")
            handler = self.statements(("END",))
            self.want("END")
            self.want("CATCH")
            return self.node("try_catch", a, body=body, handler=handler, catch_at=catch_at)
        if kind in ("DIALOG", "CONVERSATION"):
            return self.loose(a, "service_broker")
        if kind == "ATOMIC" or self.is_word("ATOMIC"):
            self.i += 1
            self.want("WITH")
            self.any_args()
        body = self.statements(("END",))
        if not body:
            self.fail()
        self.want("END")
        if k[self.i] == "CONVERSATION":
            self.i -= 1
            return self.loose(a, "service_broker")
        return self.node("block", a, body=body)

    def tran_name(self):
        if self.k[self.i] == "VAR" or (self.k[self.i] in _NAMES and not self.starts_here()):
            self.i += 1

    def s_commit(self, a: int) -> Node:
        k = self.k
        self.i += 1
        work = False
        if k[self.i] in ("TRAN", "TRANSACTION"):
            self.i += 1
            self.tran_name()
            if k[self.i] == "WITH" and k[self.i + 1] == "(":
                self.i += 1
                self.any_args()
        elif k[self.i] == "WORK":
            work = True
            self.i += 1
        return self.node("commit" if k[a] == "COMMIT" else "rollback", a, work=work)

    def s_save(self, a: int) -> Node:
        self.i += 1
        if self.k[self.i] not in ("TRAN", "TRANSACTION"):
            self.fail()
        self.i += 1
        if self.k[self.i] != "VAR":
            self.name()
        else:
            self.i += 1
        return self.node("save_tran", a)

    def s_print(self, a: int) -> Node:
        self.i += 1
        e = self.scalar()
        return self.node("print", a, expr=e)

    def s_raiserror(self, a: int) -> Node:
        k = self.k
        self.i += 1
        if k[self.i] == "(":
            args = self.paren_list(self.scalar)
            if len(args) < 3:
                self.fail()
            if k[self.i] == "WITH":
                self.i += 1
                while True:
                    if not (self.word("LOG") or self.word("NOWAIT") or self.word("SETERROR")):
                        self.fail()
                    if not self.take(","):
                        break
        elif k[self.i] in ("NUM", "VAR"):
            self.i += 1
            if k[self.i] in ("STR", "VAR"):
                self.i += 1
            while self.take(","):
                self.scalar()
        else:
            self.fail()
        return self.node("raiserror", a)

    def s_throw(self, a: int) -> Node:
        k = self.k
        self.i += 1
        if k[self.i] in ("NUM", "VAR"):
            self.i += 1
            for kinds in (("STR", "VAR"), ("NUM", "VAR")):
                self.want(",")
                if k[self.i] not in kinds:
                    self.fail()
                self.i += 1
            return self.node("throw", a, args=True)
        return self.node("throw", a)

    def s_return(self, a: int) -> Node:
        k = self.k
        self.i += 1
        e = None
        if k[self.i] not in _STATEMENT_LIKE and not (k[self.i] in _NAMES and (self.starts_here() or k[self.i + 1] == ":")) or k[self.i] == "(":
            e = self.scalar()
        return self.node("return", a, expr=e)

    def s_simple(self, a: int) -> Node:
        self.i += 1
        return self.node(self.k[a].lower(), a)

    def s_goto(self, a: int) -> Node:
        self.i += 1
        self.name()
        return self.node("goto", a)

    def s_waitfor(self, a: int) -> Node:
        self.i += 1
        if self.k[self.i] == "(":
            self.any_args()
            if self.take(","):
                self.word("TIMEOUT")
                self.scalar()
        elif self.word("DELAY") or self.word("TIME"):
            if self.k[self.i] not in ("STR", "VAR"):
                self.fail()
            self.i += 1
        else:
            self.fail()
        return self.node("waitfor", a)

    def s_declare(self, a: int) -> Node:
        k = self.k
        self.i += 1
        if k[self.i] in _NAMES:
            return self.declare_cursor(a)
        items = self.comma_list(self.declaration)
        return self.node("declare", a, items=items)

    def declaration(self) -> Node:
        k = self.k
        a = self.want("VAR")
        self.take("AS")
        if k[self.i] == "TABLE":
            self.i += 1
            cols = self.table_elements()
            return self.node("declare_table", a, elements=cols)
        if k[self.i] == "CURSOR":
            self.i += 1
            if self.take("="):
                self.fail()
            return self.node("declaration", a, type_=None, value=None)
        t = self.data_type()
        if self.take("NOT"):
            self.want("NULL")
        elif self.take("NULL"):
            pass
        v = None
        if self.take("="):
            v = self.scalar()
        return self.node("declaration", a, type_=t, value=v)

    def declare_cursor(self, a: int) -> Node:
        k = self.k
        self.name()
        self.cursor_words()
        self.want("CURSOR")
        return self.cursor_rest(a)

    def cursor_words(self):
        while self.k[self.i] in _NAMES and self.k[self.i] != "QID":
            self.i += 1

    def cursor_rest(self, a: int) -> Node:
        self.cursor_words()
        self.want("FOR")
        if self.k[self.i] == "WITH":
            self.with_clause()
        q = self.query()
        self.option_clause()
        if self.k[self.i] == "FOR":
            self.i += 1
            if self.take("READ"):
                if not self.word("ONLY"):
                    self.fail()
            elif self.take("UPDATE"):
                if self.take("OF"):
                    self.comma_list(self.name)
            else:
                self.fail()
        return self.node("declare_cursor", a, query=q)

    def s_set(self, a: int) -> Node:
        k = self.k
        self.i += 1
        kind = k[self.i]
        if kind == "VAR":
            self.i += 1
            at = self.i
            if k[at] == "." and k[at + 1] in _NAMES:
                self.i += 2
                if k[self.i] == "(":
                    self.call_args()
                    return self.node("set_variable", a, expr=None)
            if k[self.i] not in _ASSIGN:
                self.fail()
            self.i += 1
            if k[self.i] == "CURSOR":
                self.i += 1
                n = self.cursor_rest(a)
                return n
            e = self.scalar()
            return self.node("set_variable", a, expr=e, var=a + 1)
        if kind == "TRANSACTION":
            self.i += 1
            if not (self.word("ISOLATION") and self.word("LEVEL")):
                self.fail()
            start = self.i
            if self.take("READ"):
                if not (self.word("UNCOMMITTED") or self.word("COMMITTED")):
                    self.fail()
            elif self.word("REPEATABLE"):
                self.want("READ")
            elif not (self.word("SNAPSHOT") or self.word("SERIALIZABLE")):
                self.fail()
            return self.node("set_isolation", a, level=" ".join(x.upper() for x in self.t[start : self.i]))
        if kind == "IDENTITY_INSERT":
            self.i += 1
            self.multipart()
            if k[self.i] not in ("ON", "OFF"):
                self.fail()
            self.i += 1
            return self.node("set_option", a, names=["IDENTITY_INSERT"], on=k[self.i - 1] == "ON")
        if kind in ("ROWCOUNT", "TEXTSIZE"):
            self.i += 1
            if k[self.i] == "-":
                self.i += 1
            if k[self.i] not in ("NUM", "VAR"):
                self.fail()
            self.i += 1
            return self.node("set_rowcount" if kind == "ROWCOUNT" else "set_option", a, names=[kind], on=None)
        if kind == "STATISTICS":
            self.i += 1
            self.comma_list(self.name)
            if k[self.i] not in ("ON", "OFF"):
                self.fail()
            self.i += 1
            return self.node("set_option", a, names=["STATISTICS"], on=k[self.i - 1] == "ON")
        if kind == "OFFSETS":
            self.i += 1
        if kind in _NAMES:
            names = [self.t[self.i].upper()]
            self.i += 1
            while self.take(","):
                names.append(self.t[self.i].upper())
                self.name()
            if k[self.i] in ("ON", "OFF"):
                on = k[self.i] == "ON"
                self.i += 1
                return self.node("set_option", a, names=names, on=on)
            if k[self.i] in _LITERALS or k[self.i] == "VAR" or (k[self.i] in _NAMES and not self.starts_here()):
                self.i += 1
                return self.node("set_option", a, names=names, on=None)
            if k[self.i] == "-" and k[self.i + 1] == "NUM":
                self.i += 2
                return self.node("set_option", a, names=names, on=None)
        self.fail()

    # EXEC
    def s_exec(self, a: int) -> Node:
        self.i += 1
        if self.k[self.i] == "AS":
            self.i += 1
            k = self.k
            if self.word("CALLER") or self.word("OWNER") or self.word("SELF"):
                kind = self.t[self.i - 1].upper()
            elif k[self.i] == "USER" or k[self.i] == "LOGIN":
                kind = k[self.i]
                self.i += 1
                self.want("=")
                self.scalar()
            else:
                self.fail()
            if self.k[self.i] == "WITH" and self.k[self.i + 1] in _NAMES:
                self.i += 2
                if self.k[self.i] == "INTO":
                    self.i += 1
                    self.want("VAR")
                if self.word("REVERT"):
                    pass
            return self.node("execute_as", a, kind=kind)
        return self.exec_body(a, True)

    def exec_body(self, a: int, keyword: bool) -> Node:
        k = self.k
        d: dict = {"keyword": keyword}
        if k[self.i] == "(" and keyword:
            self.i += 1
            args = self.comma_list(self.exec_string)
            self.want(")")
            if k[self.i] == "AS":
                self.i += 1
                if k[self.i] not in ("USER", "LOGIN"):
                    self.fail()
                self.i += 1
                self.want("=")
                self.scalar()
            if self.k[self.i] == "AT":
                self.i += 1
                self.word("DATA_SOURCE")
                self.name()
            return self.node("execute", a, strings=args, **d)
        if k[self.i] == "VAR" and k[self.i + 1] == "=" and keyword:
            self.i += 2
        if k[self.i] == "VAR" and keyword:
            self.i += 1
            d["proc_var"] = True
        else:
            d["proc"] = self.multipart()
            if k[self.i] == ";" and k[self.i + 1] == "NUM":
                self.i += 2
        args = []
        if self.exec_arg_starts():
            args = self.comma_list(self.exec_arg)
        d["args"] = args
        if k[self.i] == "WITH" and (k[self.i + 1] in ("RECOMPILE",) or self.is_word("RESULT", 1)):
            self.i += 2
            if self.k[self.i - 1] != "RECOMPILE":
                if not self.word("SETS"):
                    self.fail()
                if k[self.i] == "(":
                    self.any_args()
                elif not (self.word("NONE") or self.word("UNDEFINED")):
                    self.fail()
        if k[self.i] == "AT" and k[self.i + 1] in _NAMES:
            self.i += 2
        return self.node("execute", a, **d)

    def exec_string(self) -> Node:
        return self.scalar()

    def exec_arg_starts(self) -> bool:
        kind = self.k[self.i]
        if kind in ("VAR", "STR", "NUM", "NULL", "DEFAULT", "-", "+"):
            return True
        if kind in _NAMES:
            return not (kind == "AT" or self.starts_here())
        return False

    def exec_arg(self) -> Node:
        k = self.k
        a = self.i
        name = None
        if k[a] == "VAR" and k[a + 1] == "=":
            name = a
            self.i += 2
        kind = k[self.i]
        if kind in ("-", "+"):
            self.i += 1
            self.want("NUM")
            v = self.node("literal", a, kind="NUM")
        elif kind in ("VAR", "STR", "NUM", "NULL", "DEFAULT"):
            v = Node({"VAR": "variable", "DEFAULT": "default"}.get(kind, "literal"), self.i, self.i, {"kind": kind})
            self.i += 1
        elif kind in _NAMES:
            v = self.node("ident", self.i)
            self.i += 1
            v.b = self.i - 1
            if k[self.i] == "." and k[self.i + 1] in _NAMES:
                self.fail()
        else:
            self.fail()
        out = False
        if k[self.i] in ("OUTPUT", "OUT"):
            self.i += 1
            out = True
        if k[self.i] in ("+", "-", "*", "/", "("):
            self.fail()
        return self.node("exec_arg", a, name=name, value=v, output=out)

    # cursors and the like
    def s_cursor(self, a: int) -> Node:
        k = self.k
        self.i += 1
        if k[self.i] in ("SYMMETRIC", "MASTER", "ALL") or (k[a] == "OPEN" and k[self.i] == "SYMMETRIC"):
            return self.loose(a, "key_statement")
        if k[a] == "FETCH":
            for w in ("NEXT", "PRIOR", "FIRST", "LAST"):
                if k[self.i] == w and k[self.i + 1] == "FROM":
                    self.i += 1
            if k[self.i] in ("ABSOLUTE", "RELATIVE") and k[self.i + 1] != "INTO":
                self.i += 1
                self.scalar()
            self.take("FROM")
        if k[self.i] == "GLOBAL" and (k[self.i + 1] in _NAMES):
            self.i += 1
        if k[self.i] == "VAR":
            self.i += 1
        else:
            self.name()
        if k[a] == "FETCH" and self.take("INTO"):
            self.comma_list(lambda: self.want("VAR"))
        return self.node(k[a].lower() + "_cursor", a)

    def s_truncate(self, a: int) -> Node:
        self.i += 1
        self.want("TABLE")
        n = self.multipart()
        if self.k[self.i] == "WITH":
            self.i += 1
            self.any_args()
        return self.node("truncate", a, name=n)

    def s_use(self, a: int) -> Node:
        self.i += 1
        self.name()
        return self.node("use", a)

    def loose(self, a: int, type_: str) -> Node:
        """A statement checked only for balance and for a plausible run of names, values, lists and options."""
        k = self.k
        if self.i <= a:
            self.i = a + 1
        start = self.i
        last = k[self.i - 1]
        while True:
            kind = k[self.i]
            if kind in ("EOF", ";", ")"):
                break
            if kind == "(":
                self.balanced()
                last = ")"
                continue
            if kind in STARTERS and last not in ("FOR", ",", "TO", "=", "ON", "BY", "AFTER", "OF", "WITH", "AS", "ALTER", "GRANT", "DENY", "REVOKE", "ADD", "DROP", "CREATE", "ENABLE", "DISABLE"):
                if kind not in ("WITH", "SET", "ADD", "OPEN", "CLOSE", "BULK", "CHECKPOINT") or last in (";",):
                    break
            if kind in ("END", "ELSE") or kind == "BAD" or kind in ("{", "}", "`", "!", "?", "\\"):
                break
            if kind in ("=", ",") and last in ("=", ","):
                self.fail()
            last = kind
            self.i += 1
        if self.i == start and a + 1 == start:
            self.fail()
        if last in ("=", ",", "WITH", "TO", "BY", "ON", "FOR", "(", "."):
            if not (last == "ON" and k[self.i - 2] in ("=", "ID", "QID") or last == "ON"):
                self.fail()
        return self.node(type_, a)

    def balanced(self):
        self.want("(")
        depth = 1
        k = self.k
        while depth:
            kind = k[self.i]
            if kind in ("EOF", ";", "BAD"):
                self.fail()
            if kind == "(":
                depth += 1
            elif kind == ")":
                depth -= 1
                if k[self.i - 1] in (",", "="):
                    self.fail()
            self.i += 1

    def s_loose(self, a: int) -> Node:
        return self.loose(a, self.k[a].lower())

    # DDL
    def s_create(self, a: int) -> Node:
        k = self.k
        self.i += 1
        or_alter = False
        if k[a] == "CREATE" and k[self.i] == "OR" and k[self.i + 1] == "ALTER":
            self.i += 2
            or_alter = True
        kind = k[self.i]
        if kind in ("PROC", "PROCEDURE", "FUNCTION", "VIEW", "TRIGGER") and not self.first_of_batch(a):
            self.fail(f"'{k[a]} {kind}' must be the first statement in a query batch.")
        if kind in ("PROC", "PROCEDURE"):
            return self.procedure(a, or_alter)
        if kind == "FUNCTION":
            return self.function(a, or_alter)
        if kind == "VIEW":
            return self.view(a, or_alter)
        if kind == "TRIGGER":
            return self.trigger(a, or_alter)
        if or_alter:
            self.fail()
        if kind == "TABLE":
            return self.create_table(a) if k[a] == "CREATE" else self.alter_table(a)
        if kind in ("UNIQUE", "CLUSTERED", "NONCLUSTERED", "INDEX") or (self.is_word("COLUMNSTORE") and k[a] == "CREATE") or kind in ("PRIMARY", "SPATIAL", "XML") and k[a] == "CREATE":
            if k[a] == "CREATE":
                return self.create_index(a)
            return self.loose(a, "alter_index")
        if kind == "SCHEMA" and k[a] == "CREATE":
            self.i += 1
            if self.take("AUTHORIZATION"):
                self.name()
            else:
                self.name()
                if self.take("AUTHORIZATION"):
                    self.name()
            return self.node("create_schema", a)
        if kind == "TYPE" and k[a] == "CREATE":
            self.i += 1
            self.multipart()
            if self.take("FROM"):
                self.data_type()
                if self.take("NOT"):
                    self.want("NULL")
                else:
                    self.take("NULL")
            elif self.take("AS"):
                self.want("TABLE")
                self.table_elements()
                if k[self.i] == "WITH":
                    self.i += 1
                    self.any_args()
            elif self.take("EXTERNAL"):
                return self.loose(a, "create_type")
            else:
                self.fail()
            return self.node("create_type", a)
        if kind == "SYNONYM" and k[a] == "CREATE":
            self.i += 1
            self.multipart()
            self.want("FOR")
            self.multipart()
            return self.node("create_synonym", a)
        if kind in _DDL_OBJECTS or (kind in _NAMES and self.t[self.i].upper() in _DDL_OBJECTS):
            if k[self.i + 1] in ("EOF", ";", ")", ",", "="):
                self.i += 1
                self.fail()
            self.i += 1
            return self.loose(a, "ddl")
        self.fail()

    def parameters(self) -> list:
        k = self.k
        paren = self.take("(")
        out = []
        if paren and self.take(")"):
            return out
        if not paren and k[self.i] != "VAR":
            return out
        while True:
            a = self.want("VAR")
            self.take("AS")
            t = self.data_type()
            if self.take("VARYING"):
                pass
            if self.take("NOT"):
                self.want("NULL")
            else:
                self.take("NULL")
            v = None
            if self.take("="):
                v = self.scalar() if k[self.i] not in _NAMES or k[self.i + 1] in ("(", ".") else self.name()
            out_ = False
            while k[self.i] in ("OUTPUT", "OUT", "READONLY"):
                out_ = True
                self.i += 1
            out.append(self.node("parameter", a, type_=t, value=v, output=out_))
            if not self.take(","):
                break
        if paren:
            self.want(")")
        return out

    def module_options(self):
        opts = []
        if self.k[self.i] == "WITH":
            self.i += 1
            while True:
                a = self.i
                if self.k[self.i] in ("EXEC", "EXECUTE"):
                    self.i += 1
                    self.want("AS")
                    if self.k[self.i] == "STR" or self.k[self.i] in _NAMES:
                        self.i += 1
                    else:
                        self.fail()
                    opts.append(self.node("execute_as_option", a))
                elif self.is_word("RETURNS"):
                    self.i += 1
                    self.want("NULL")
                    self.want("ON")
                    self.want("NULL")
                    self.word("INPUT")
                elif self.is_word("CALLED"):
                    self.i += 1
                    self.want("ON")
                    self.want("NULL")
                    self.word("INPUT")
                elif self.is_word("INLINE"):
                    self.i += 1
                    self.want("=")
                    self.i += 1
                else:
                    self.name()
                if not self.take(","):
                    break
        return opts

    def procedure(self, a: int, or_alter: bool) -> Node:
        kw = self.i
        self.i += 1
        k = self.k
        name = self.multipart(3)
        if k[self.i] == ";" and k[self.i + 1] == "NUM":
            self.i += 2
        params = self.parameters()
        opts = self.module_options()
        if self.take("FOR"):
            self.want("REPLICATION")
        self.want("AS")
        if self.take("EXTERNAL"):
            return self.loose(a, "create_procedure")
        body = self.statements(("EOF",))
        if not body:
            self.fail()
        return self.node("create_procedure", a, verb=k[a], or_alter=or_alter, name=name, params=params, body=body, keyword_at=kw, options=opts)

    def function(self, a: int, or_alter: bool) -> Node:
        self.i += 1
        k = self.k
        name = self.multipart(3)
        if k[self.i] != "(":
            self.fail()
        params = self.parameters()
        if not self.word("RETURNS"):
            self.fail()
        d: dict = {}
        if k[self.i] == "TABLE":
            self.i += 1
            if k[self.i] == "(":
                d["returns_table"] = self.table_elements()
            d["tvf"] = True
        elif k[self.i] == "VAR":
            self.i += 1
            self.want("TABLE")
            d["returns_table"] = self.table_elements()
            d["tvf"] = True
        else:
            d["returns"] = self.data_type()
        opts = self.module_options()
        if self.take("ORDER"):
            self.any_args()
        self.take("AS")
        if self.take("EXTERNAL"):
            return self.loose(a, "create_function")
        if k[self.i] == "RETURN" and d.get("tvf") and "returns_table" not in d:
            at = self.i
            self.i += 1
            ctes = None
            paren = 0
            while k[self.i] == "(":
                if k[self.i + 1] in ("SELECT", "WITH", "("):
                    paren += 1
                    self.i += 1
                else:
                    break
            if k[self.i] == "WITH":
                ctes = self.with_clause()
            q = self.query()
            for _ in range(paren):
                self.want(")")
            d["query"] = q
            d["ctes"] = ctes
            self.take(";")
            if k[self.i] not in ("EOF",):
                self.fail()
            return self.node("create_function", a, name=name, params=params, verb=k[a], options=opts, body=[], **d)
        body = self.statements(("EOF",))
        if not body:
            self.fail()
        return self.node("create_function", a, name=name, params=params, verb=k[a], body=body, options=opts, **d)

    def view(self, a: int, or_alter: bool) -> Node:
        k = self.k
        self.i += 1
        name = self.multipart(3)
        cols = self.paren_list(self.name) if k[self.i] == "(" else None
        self.module_options()
        self.want("AS")
        ctes = self.with_clause() if k[self.i] == "WITH" else None
        q = self.query()
        if k[self.i] == "WITH" and k[self.i + 1] == "CHECK":
            self.i += 2
            self.want("OPTION")
        rest = self.i
        while k[rest] == ";":
            rest += 1
        if k[rest] != "EOF":
            self.i = rest
            self.fail("A view must be the only statement in the batch.")
        return self.node("create_view", a, name=name, columns=cols, query=q, ctes=ctes, verb=k[a])

    def trigger(self, a: int, or_alter: bool) -> Node:
        k = self.k
        self.i += 1
        name = self.multipart(3)
        self.want("ON")
        if self.take("ALL"):
            self.word("SERVER")
        elif k[self.i] == "DATABASE":
            self.i += 1
        else:
            self.multipart(3)
        opts = self.module_options()
        if k[self.i] in ("FOR", "AFTER"):
            self.i += 1
        elif self.word("INSTEAD"):
            self.want("OF")
        else:
            self.fail()
        while True:
            if k[self.i] in ("INSERT", "UPDATE", "DELETE") or k[self.i] in _NAMES:
                self.i += 1
            else:
                self.fail()
            if not self.take(","):
                break
        if k[self.i] == "WITH" and self.is_word("APPEND", 1):
            self.i += 2
        if self.take("NOT"):
            self.want("FOR")
            self.want("REPLICATION")
        self.want("AS")
        body = self.statements(("EOF",))
        if not body:
            self.fail()
        return self.node("create_trigger", a, name=name, body=body, verb=k[a], options=opts)

    def create_table(self, a: int) -> Node:
        k = self.k
        self.i += 1
        name = self.multipart()
        d: dict = {}
        if k[self.i] == "AS" and (self.is_word("NODE", 1) or self.is_word("EDGE", 1) or self.is_word("FILETABLE", 1)):
            self.i += 2
        if k[self.i] == "(":
            d["elements"] = self.table_elements()
        elif k[self.i - 1] not in ("NODE", "EDGE") and self.t[self.i - 1].upper() != "FILETABLE":
            self.fail()
        if k[self.i] == "AS" and (self.is_word("NODE", 1) or self.is_word("EDGE", 1)):
            self.i += 2
        options_at = self.i
        while True:
            if k[self.i] == "ON" and (k[self.i + 1] in _NAMES or k[self.i + 1] in ("PRIMARY", "DEFAULT", "STR")):
                self.i += 2
                if k[self.i] == "(":
                    self.paren_list(self.name)
            elif self.is_word("TEXTIMAGE_ON") or self.is_word("FILESTREAM_ON"):
                self.i += 1
                if k[self.i] not in _NAMES and k[self.i] not in ("PRIMARY", "DEFAULT", "STR"):
                    self.fail()
                self.i += 1
            elif k[self.i] == "WITH" and k[self.i + 1] == "(":
                self.i += 1
                self.balanced()
            else:
                break
        return self.node("create_table", a, name=name, options=range(options_at, self.i), **d)

    def table_elements(self) -> list:
        self.want("(")
        out = []
        while True:
            out.append(self.table_element())
            if self.take(","):
                if self.k[self.i] == ")":
                    self.i += 1
                    return out
                continue
            if self.k[self.i] in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "INDEX"):
                continue
            self.want(")")
            return out

    def table_element(self) -> Node:
        k = self.k
        a = self.i
        kind = k[a]
        if kind in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "DEFAULT"):
            return self.constraint(table=True)
        if kind == "INDEX":
            return self.inline_index()
        if kind == "PERIOD" and k[a + 1] == "FOR":
            self.i += 2
            self.word("SYSTEM_TIME")
            self.any_args()
            return self.node("period", a)
        return self.column_definition()

    def column_definition(self) -> Node:
        k = self.k
        a = self.i
        name = self.name()
        d: dict = {"name": name, "constraints": []}
        if k[self.i] == "AS":
            self.i += 1
            d["computed"] = self.scalar()
            if self.word("PERSISTED"):
                pass
        else:
            if k[self.i] in (",", ")") and self.t[a].upper() in ("TIMESTAMP", "ROWVERSION"):
                return self.node("column_definition", a, **d)
            d["type_"] = self.data_type()
        while True:
            kind = k[self.i]
            at = self.i
            if kind == "NOT" and k[at + 1] == "FOR":
                self.i += 2
                self.want("REPLICATION")
            elif kind == "NOT":
                self.i += 1
                self.want("NULL")
                d["not_null"] = True
            elif kind == "NULL":
                self.i += 1
            elif kind == "IDENTITY":
                self.i += 1
                d["identity"] = True
                if k[self.i] == "(":
                    self.paren_list(self.scalar)
            elif kind == "COLLATE":
                self.i += 1
                self.name()
            elif kind == "ROWGUIDCOL" or kind in ("SPARSE", "PERSISTED", "HIDDEN"):
                self.i += 1
            elif self.is_word("FILESTREAM"):
                self.i += 1
            elif kind == "MASKED" or kind == "ENCRYPTED":
                self.i += 1
                self.want("WITH")
                self.any_args()
            elif kind == "GENERATED":
                self.i += 1
                if not self.word("ALWAYS"):
                    self.fail()
                self.want("AS")
                self.name()
                if k[self.i] in _NAMES:
                    self.i += 1
            elif kind in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "REFERENCES", "CHECK", "DEFAULT"):
                d["constraints"].append(self.constraint(table=False))
            elif kind == "INDEX":
                d["constraints"].append(self.inline_index())
            else:
                break
        return self.node("column_definition", a, **d)

    def index_columns(self) -> list:
        def item():
            a = self.i
            n = self.name()
            desc = False
            if self.k[self.i] in ("ASC", "DESC"):
                desc = self.k[self.i] == "DESC"
                self.i += 1
            return self.node("index_column", a, name=n, desc=desc)

        return self.paren_list(item)

    def clustering(self):
        if self.k[self.i] in ("CLUSTERED", "NONCLUSTERED"):
            self.i += 1
            c = self.k[self.i - 1] == "CLUSTERED"
            if self.word("HASH"):
                pass
            return c
        return None

    def index_tail(self):
        k = self.k
        while True:
            if k[self.i] == "WITH":
                self.i += 1
                if k[self.i] == "(":
                    self.balanced()
                else:
                    while True:
                        if k[self.i] == "FILLFACTOR" or k[self.i] in _NAMES:
                            self.i += 1
                        else:
                            self.fail()
                        if self.take("="):
                            self.i += 1
                        if not self.take(","):
                            break
            elif k[self.i] == "ON" and (k[self.i + 1] in _NAMES or k[self.i + 1] in ("PRIMARY", "DEFAULT", "STR")):
                self.i += 2
                if k[self.i] == "(":
                    self.paren_list(self.name)
            elif self.is_word("FILESTREAM_ON"):
                self.i += 2
            else:
                return

    def constraint(self, table: bool) -> Node:
        k = self.k
        a = self.i
        d: dict = {}
        if self.take("CONSTRAINT"):
            d["name"] = self.name()
        kind = k[self.i]
        if kind in ("PRIMARY", "UNIQUE"):
            self.i += 1
            if kind == "PRIMARY":
                self.want("KEY")
            d["kind"] = kind
            d["clustered"] = self.clustering()
            if k[self.i] == "(":
                d["columns"] = self.index_columns()
            elif table:
                self.fail()
            self.index_tail()
            while self.word("NOT"):
                pass
        elif kind in ("FOREIGN", "REFERENCES"):
            d["kind"] = "FOREIGN"
            if kind == "FOREIGN":
                self.i += 1
                self.want("KEY")
                if k[self.i] == "(":
                    d["columns"] = self.paren_list(self.name)
                elif table:
                    self.fail()
            self.want("REFERENCES")
            self.multipart()
            if k[self.i] == "(":
                self.paren_list(self.name)
            while k[self.i] == "ON" and k[self.i + 1] in ("DELETE", "UPDATE"):
                self.i += 2
                if self.word("NO"):
                    if not self.word("ACTION"):
                        self.fail()
                elif self.take("SET"):
                    if k[self.i] not in ("NULL", "DEFAULT"):
                        self.fail()
                    self.i += 1
                else:
                    self.want("CASCADE")
            if k[self.i] == "NOT" and k[self.i + 1] == "FOR":
                self.i += 2
                self.want("REPLICATION")
        elif kind == "CHECK":
            d["kind"] = "CHECK"
            self.i += 1
            if k[self.i] == "NOT":
                self.i += 1
                self.want("FOR")
                self.want("REPLICATION")
            self.want("(")
            self.condition()
            self.want(")")
        elif kind == "DEFAULT":
            d["kind"] = "DEFAULT"
            self.i += 1
            self.scalar()
            if table and self.take("FOR"):
                self.name()
                if k[self.i] == "WITH" and k[self.i + 1] == "VALUES":
                    self.i += 2
            elif k[self.i] == "WITH" and k[self.i + 1] == "VALUES":
                self.i += 2
        elif kind == "NOT" and "name" in d:
            self.i += 1
            self.want("NULL")
            d["kind"] = "NOT NULL"
        elif kind == "NULL" and "name" in d:
            self.i += 1
            d["kind"] = "NULL"
        else:
            self.fail()
        return self.node("constraint", a, table=table, **d)

    def inline_index(self) -> Node:
        k = self.k
        a = self.want("INDEX")
        n = self.name()
        d: dict = {"name": n}
        if self.take("UNIQUE"):
            d["unique"] = True
        d["clustered"] = self.clustering()
        if self.is_word("COLUMNSTORE"):
            self.i += 1
        if k[self.i] == "(":
            d["columns"] = self.index_columns()
        if self.word("INCLUDE"):
            self.paren_list(self.name)
        if k[self.i] == "WHERE":
            self.i += 1
            self.condition()
        self.index_tail()
        return self.node("inline_index", a, **d)

    def create_index(self, a: int) -> Node:
        k = self.k
        d: dict = {}
        if k[self.i] in ("PRIMARY", "SPATIAL", "XML"):
            return self.loose(a, "ddl")
        if self.take("UNIQUE"):
            d["unique"] = True
        d["clustered"] = self.clustering()
        columnstore = self.word("COLUMNSTORE")
        self.want("INDEX")
        d["name"] = self.name()
        self.want("ON")
        d["table"] = self.multipart(3)
        if k[self.i] == "(":
            d["columns"] = self.index_columns()
        elif not columnstore:
            self.fail()
        if self.word("INCLUDE"):
            self.paren_list(self.name)
        if k[self.i] == "WHERE":
            self.i += 1
            self.condition()
        self.index_tail()
        return self.node("create_index", a, **d)

    def alter_table(self, a: int) -> Node:
        k = self.k
        self.i += 1
        name = self.multipart()
        d: dict = {"name": name}
        if k[self.i] == "WITH" and k[self.i + 1] in ("CHECK", "NOCHECK"):
            self.i += 2
        kind = k[self.i]
        if kind == "ADD":
            self.i += 1
            if k[self.i] == "COLUMN":
                self.fail()
            d["elements"] = self.comma_list(self.table_element)
            d["action"] = "ADD"
        elif kind == "ALTER":
            self.i += 1
            self.want("COLUMN")
            self.name()
            if k[self.i] in ("ADD", "DROP"):
                return self.loose(a, "alter_table")
            self.data_type()
            while True:
                if self.take("COLLATE"):
                    self.name()
                elif self.take("NOT"):
                    self.want("NULL")
                elif self.take("NULL") or self.word("SPARSE"):
                    pass
                elif k[self.i] == "WITH" and k[self.i + 1] == "(":
                    self.i += 1
                    self.balanced()
                else:
                    break
            d["action"] = "ALTER"
        elif kind == "DROP":
            d["drop_at"] = self.i
            self.i += 1

            def dropped():
                if not (self.take("COLUMN") or self.take("CONSTRAINT")):
                    if k[self.i] == "PERIOD":
                        self.i += 1
                        self.want("FOR")
                if k[self.i] == "IF":
                    self.i += 1
                    self.want("EXISTS")
                    d["if_exists"] = True
                return self.name()

            d["dropped"] = self.comma_list(dropped)
            if k[self.i] == "WITH" and k[self.i + 1] == "(":
                self.i += 1
                self.balanced()
            d["action"] = "DROP"
        elif kind in ("CHECK", "NOCHECK") or kind in ("ENABLE", "DISABLE", "SET", "REBUILD", "SWITCH"):
            n = self.loose(a, "alter_table")
            n.d.update(d)
            n.d["action"] = kind
            return n
        else:
            self.fail()
        return self.node("alter_table", a, **d)

    def s_drop(self, a: int) -> Node:
        k = self.k
        self.i += 1
        kind = k[self.i]
        if kind in ("TABLE", "PROC", "PROCEDURE", "VIEW", "FUNCTION", "TRIGGER", "DATABASE", "SCHEMA", "TYPE", "SYNONYM", "SEQUENCE", "USER", "LOGIN", "ROLE", "DEFAULT", "RULE"):
            if kind == "DATABASE" and k[self.i + 1] in ("AUDIT", "ENCRYPTION") or (kind == "DATABASE" and self.is_word("SCOPED", 1)):
                return self.loose(a, "ddl")
            kw = self.i
            self.i += 1
            ie = False
            if k[self.i] == "IF":
                self.i += 1
                self.want("EXISTS")
                ie = True
            names = self.comma_list(self.multipart)
            if self.take("ON"):
                if self.take("ALL"):
                    self.word("SERVER")
                elif k[self.i] == "DATABASE":
                    self.i += 1
                else:
                    self.fail()
            return self.node("drop", a, kind="PROCEDURE" if kind == "PROC" else kind, if_exists=ie, names=names, keyword_at=kw)
        if kind == "INDEX":
            self.i += 1
            if k[self.i] == "IF":
                self.i += 1
                self.want("EXISTS")

            def one():
                n = self.multipart()
                if self.take("ON"):
                    self.multipart()
                if k[self.i] == "WITH" and k[self.i + 1] == "(":
                    self.i += 1
                    self.balanced()
                return n

            names = self.comma_list(one)
            return self.node("drop", a, kind="INDEX", names=names)
        if kind in _NAMES or kind in _DDL_OBJECTS:
            self.i += 1
            if k[self.i] in ("EOF", ";", "=", ","):
                self.fail()
            return self.loose(a, "ddl")
        self.fail()


_DDL_OBJECTS = frozenset(
    """LOGIN USER ROLE DATABASE CREDENTIAL MASTER SYMMETRIC ASYMMETRIC CERTIFICATE SERVER SEQUENCE STATISTICS APPLICATION
    AGGREGATE ASSEMBLY AVAILABILITY BROKER CONTRACT CRYPTOGRAPHIC ENDPOINT EVENT EXTERNAL FULLTEXT MESSAGE PARTITION QUEUE
    REMOTE RESOURCE ROUTE RULE DEFAULT SEARCH SECURITY SELECTIVE SERVICE WORKLOAD XML COLUMN AUTHORIZATION SCHEMA TYPE
    SYNONYM""".split()
)
_COMPOUND = frozenset(
    "if while block try_catch create_procedure create_function create_trigger create_view label execute create_schema".split()
)
_STATEMENTS = {
    "SELECT": Parser.s_select,
    "WITH": Parser.s_with,
    "INSERT": Parser.s_insert,
    "UPDATE": Parser.s_update,
    "DELETE": Parser.s_delete,
    "MERGE": Parser.s_merge,
    "IF": Parser.s_if,
    "WHILE": Parser.s_while,
    "BEGIN": Parser.s_begin,
    "COMMIT": Parser.s_commit,
    "ROLLBACK": Parser.s_commit,
    "SAVE": Parser.s_save,
    "PRINT": Parser.s_print,
    "RAISERROR": Parser.s_raiserror,
    "THROW": Parser.s_throw,
    "RETURN": Parser.s_return,
    "BREAK": Parser.s_simple,
    "CONTINUE": Parser.s_simple,
    "CHECKPOINT": Parser.s_simple,
    "RECONFIGURE": Parser.s_loose,
    "REVERT": Parser.s_simple,
    "GOTO": Parser.s_goto,
    "WAITFOR": Parser.s_waitfor,
    "DECLARE": Parser.s_declare,
    "SET": Parser.s_set,
    "EXEC": Parser.s_exec,
    "EXECUTE": Parser.s_exec,
    "OPEN": Parser.s_cursor,
    "CLOSE": Parser.s_cursor,
    "FETCH": Parser.s_cursor,
    "DEALLOCATE": Parser.s_cursor,
    "TRUNCATE": Parser.s_truncate,
    "USE": Parser.s_use,
    "CREATE": Parser.s_create,
    "ALTER": Parser.s_create,
    "DROP": Parser.s_drop,
    "GRANT": Parser.s_loose,
    "DENY": Parser.s_loose,
    "REVOKE": Parser.s_loose,
    "BACKUP": Parser.s_loose,
    "RESTORE": Parser.s_loose,
    "DBCC": Parser.s_loose,
    "KILL": Parser.s_loose,
    "BULK": Parser.s_loose,
    "ADD": Parser.s_loose,
    "SETUSER": Parser.s_loose,
    "SHUTDOWN": Parser.s_loose,
    "READTEXT": Parser.s_loose,
    "WRITETEXT": Parser.s_loose,
    "UPDATETEXT": Parser.s_loose,
    "LINENO": Parser.s_loose,
}


class StatementMemo:
    """Shapes of statements that parsed, as a trie over kinds; bounded in size, exact in result.

    A path is the kinds of one statement and of the ``LOOK`` kinds after it.  Only leaf
    statements are kept, and only if they don't depend on what precedes them.
    """

    def __init__(self, most: int = 400_000):
        self.root: dict = {}
        self.size, self.most = 0, most

    def find(self, kinds: list[str], i: int) -> int:
        at = self.root
        j = i
        try:
            while True:
                at = at[kinds[j]]
                j += 1
                if 0 in at:
                    n = at[0].get(tuple(kinds[j : j + LOOK]))
                    if n:
                        return j
        except (KeyError, IndexError):
            return 0

    def add(self, kinds: list[str], a: int, end: int) -> None:
        if self.size > self.most:
            self.root, self.size = {}, 0
        at = self.root
        for x in kinds[a:end]:
            nxt = at.get(x)
            if nxt is None:
                nxt = at[x] = {}
                self.size += 1
            at = nxt
        at.setdefault(0, {})[tuple(kinds[end : end + LOOK])] = True
