"""Credentials embedded in source code (problem 1).

Method.  A text is tokenized lexically.  A literal is flagged if it is assigned or passed to
a credential-named identifier (``PASSWORD = '..'``, ``@apiKey NVARCHAR(200) = N'..'``,
``exec p @rmtpassword = '..'``, ``VALUES (N'webhook.secret', N'..')``, ``SET Val = N'..' WHERE
Name = N'ftp_pass'``, an argument of a procedure or function that takes a secret, a JSON member, an
XML attribute or element) and is no placeholder.  Literals and comments are also searched for credentials
that carry their own mark: connection strings, logins in addresses, Basic and Bearer headers,
signatures, tokens of known form, private keys.  Redaction replaces only the value: quotes,
escapes and everything else stay, so a text parses as before.

What is no credential: empty values, masks, placeholders (``<..>``, ``$(..)``, ``${..}``,
``%..%``, ``#{..}#``, ``{{..}}``), variables, hashes, row ids, public keys, settings about
credentials (``password.min.length``, ``PasswordHash``), logins without a secret.

Defined results: null text gives no row; equal rows are searched alike and each stays; texts
are searched whole; further columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from lintmill.arrow import map_lists
from lintmill.llm.script_text import language_of
from lintmill.syntax import lexer as L

REPLACEMENT = "REDACTED"

#: Words that make the last part of a name credential-like (fixed values).
_SECRET_LAST = frozenset(
    "password passwd pwd pass passphrase passcode secret token apikey credential credentials cred creds pw psw sas "
    "kennwort passwort geheimnis contraseña contrasena clave motdepasse senha wachtwoord hasło haslo пароль 密码 口令 パスワード".split()
)
#: First words of two-word names whose last word is "key".
_KEY_KINDS = frozenset(
    "api access secret private shared account encryption signing auth master storage service client app license webhook hmac sas".split()
)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|[0-9]+")
#: Procedures and functions that take a secret by position, and which arguments (zero-based) it may be (fixed values).
_POSITIONS = {
    "sp_addlogin": (1,), "sp_password": (0, 1), "sp_addlinkedsrvlogin": (4,), "sp_setapprole": (1,), "sp_addapprole": (1,), "sp_approlepassword": (1,),
    "sp_change_users_login": (3,), "sp_adddistributor": (2,), "encryptbypassphrase": (0,), "decryptbypassphrase": (0,), "pwdencrypt": (0,), "pwdcompare": (0,),
}
_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\$\(.*\)|\$\{.*\}|%[\w.]+%|#\{.*\}#?|\{\{.*\}\}|\{\w*\}|\[[\w .-]+\]|@\w+|\$\w+|:\w+|\?|"
    r"[*xX#._\-•\s]+|.*\*{3,}.*|"
    r"(?:your|my|the|enter|insert|change|replace|some|put)[-_ ]?.*(?:here|password|secret|token|key|me|it|this)|"
    r"changeme|change_me|placeholder|redacted|removed|masked|hidden|none|null|nil|undefined|n/?a|tbd|todo|example|dummy|"
    r"password|passwd|secret|token|true|false|default|env|vault|test)$",
    re.IGNORECASE | re.DOTALL,
)
_HASH = re.compile(
    r"^(?:0x[0-9a-f]*|\$2[abxy]?\$\d\d\$.*|\$(?:1|5|6|argon2\w*|pbkdf2\w*)\$.*|(?:md5|sha\d+|bcrypt|\{s?sha\d*\})[:$}].*)$", re.IGNORECASE | re.DOTALL
)
_GUID = re.compile(r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}?$")
_URL_START = re.compile(r"^[a-z][a-z0-9+.-]*://", re.IGNORECASE)

_VALUE = r"""(?:''(?P<q0>[^'\r\n]+)''|'(?P<q1>[^'\r\n]*)'|"(?P<q2>[^"\r\n]*)"|(?P<bare>[^;'"&\s<>,)]+(?:\)[^;'"&\s<>,)]*)?))"""
_CONNECTION = re.compile(
    r"(?<![\w$@.-])(?P<name>(?:[A-Za-z]+[ _.-]?)??(?:password|passwd|pwd|passphrase|secret|token|apikey|api[_-]key|access[_-]key|"
    r"accountkey|sharedaccesskey|client[_-]?secret))\s*(?<![=:])=\s*[nN]?" + _VALUE,
    re.IGNORECASE,
)
_COLON = re.compile(
    r"(?<![\w$@.\"-])(?P<name>(?:[A-Za-z]+[ _.-])??(?:password|passwd|pwd|passphrase|secret|token|apikey|api[_ -]key|access[_ -]key))\s*:\s+" + _VALUE,
    re.IGNORECASE,
)
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@'\"<>]*:(?P<value>[^\s/'\"<>]+?)@(?=[\w\[])")
_LOGIN = re.compile(r"\b(?:login|logon|user|account|credentials?|creds?)\b:?\s+[\w.\\@-]+\s*/\s*(?P<value>\S+)", re.IGNORECASE)
_HEADER = re.compile(r"\b(?P<kind>basic|bearer)\s+(?P<value>[A-Za-z0-9+/=_.~-]{8,})", re.IGNORECASE)
_COMMAND = re.compile(r"\b(?:sqlcmd|osql|isql|bcp|sqlpackage)\b[^\r\n]*?\s-P\s*(?P<value>[^\s'\"]+)", re.IGNORECASE)
_OPEN_END = re.compile(
    r"(?:^|[^\w])(?:(?P<name>(?:[A-Za-z]+[ _.-]?)??(?:password|passwd|pwd|passphrase|secret|token|apikey|api[_-]key|accountkey|sharedaccesskey))\s*=|(?:bearer|basic)\s)\s*['\"]?$",
    re.IGNORECASE,
)
_SIGNATURE = re.compile(r"(?<![A-Za-z])(?:sig|signature|x-amz-signature)=(?P<value>[A-Za-z0-9%+/=_-]{16,})", re.IGNORECASE)
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_-])(?P<value>gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|"
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,}|sk_(?:live|test)_\w{10,}|SG\.[\w-]{16,}\.[\w-]{16,}|"
    r"npm_[A-Za-z0-9]{20,}|(?:[a-z]{2,5}[-_]){1,2}(?=[A-Za-z0-9]*[0-9])(?=[A-Za-z0-9]*[A-Z])(?=[A-Za-z0-9]*[a-z])[A-Za-z0-9]{24,})(?![A-Za-z0-9])"
)
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_JSON_PAIR = re.compile(r'"(?P<name>[^"\\\r\n]+)"\s*:\s*"(?P<value>[^"\\]*(?:\\.[^"\\]*)*)"', re.DOTALL)
_JSON_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"?|[{}\[\],:]', re.DOTALL)
_XML_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[^<>"']|"[^"<]*"|'[^'<]*'|["'])*>?|[^<]+""", re.DOTALL)
_XML_MEMBER = re.compile(r"""\s(?P<name>[\w.:-]+)\s*=\s*(?:"(?P<q2>[^"<]*)"|'(?P<q1>[^'<]*)')""")
_XML_NAME = re.compile(r"<([\w.:-]+)")


def is_secret_name(name: str) -> bool:
    """Whether an identifier names a credential itself, not something about one."""
    name = name.strip("[]\"@#$:'` ")
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return False
    last = parts[-1]
    if last in ("value", "text", "string", "plain") and len(parts) > 1:
        parts.pop()
        last = parts[-1]
    if last in _SECRET_LAST:
        return not (last in ("pass", "token") and len(parts) > 1 and parts[-2] in ("no", "by", "first", "second", "per", "next", "count"))
    joined = "".join(parts)
    if any(joined.endswith(w) for w in ("password", "passwd", "secret", "apikey", "accesskey", "passphrase", "authtoken", "accesstoken")):
        return True
    return last == "key" and len(parts) > 1 and parts[-2] in _KEY_KINDS


def is_key_name(name: str) -> bool:
    """``key``, ``auth`` alone: a credential only if the value looks random."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    return bool(parts) and (parts[-1] in ("key", "auth", "authorization", "sig", "signature") or "".join(parts) in ("authkey",))


def looks_random(v: str) -> bool:
    """Long, without blanks, of mixed classes: not a word, number, path or address."""
    if len(v) < 16 or any(c.isspace() for c in v) or _GUID.match(v) or _URL_START.match(v):
        return False
    classes = any(c.islower() for c in v) + any(c.isupper() for c in v) + any(c.isdigit() for c in v)
    return classes >= 3 or (classes == 2 and any(c.isdigit() for c in v) and len(v) >= 24)


def is_value(v: str) -> bool:
    """A literal secret, not a placeholder, hash, variable or row id."""
    v = v.strip()
    if not v or _PLACEHOLDER.match(v) or _HASH.match(v) or _GUID.match(v):
        return False
    return not any(c in v for c in ("$(", "${", "#{", "{{", "%("))


def _basic(v: str) -> bool:
    try:
        raw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("latin-1")
    except (binascii.Error, ValueError):
        return False
    user, colon, secret = raw.partition(":")
    return bool(colon) and is_value(secret)


def _held(m: re.Match) -> str:
    """The group of ``_VALUE`` that matched."""
    return next(g for g in ("q0", "q1", "q2", "bare") if m.group(g) is not None)


def marked(text: str, base: int = 0) -> Iterator[tuple[int, int]]:
    """Spans of values in a text that carry their own mark."""
    low = text.lower()
    if "-----begin" in low:
        for m in _PRIVATE.finditer(text):
            e = _PRIVATE_END.search(text, m.end())
            yield base + m.start(), base + (e.end() if e else len(text))
    if "=" in low and ("p" in low or "secret" in low or "token" in low or "key" in low):
        for m in _CONNECTION.finditer(text):
            g = _held(m)
            if is_secret_name(m.group("name")) and is_value(m.group(g)) and not (g == "bare" and m.group(g)[0] in "@+"):
                yield base + m.start(g), base + m.end(g)
    if ":" in low:
        for m in _COLON.finditer(text):
            g = _held(m)
            v = m.group(g)
            if is_value(v) and (g != "bare" or any(c.isdigit() for c in v) and any(c.isalpha() for c in v)):
                yield base + m.start(g), base + m.end(g)
        if "://" in low:
            for m in _ADDRESS.finditer(text):
                if is_value(m.group("value")):
                    yield base + m.start("value"), base + m.end("value")
    if "/" in low:
        for m in _LOGIN.finditer(text):
            v = m.group("value").rstrip(".,;)")
            if is_value(v) and not v.startswith("*") and (any(c.isdigit() for c in v) or any(not c.isalnum() for c in v)):
                yield base + m.start("value"), base + m.start("value") + len(v)
    if "bearer" in low or "basic" in low:
        for m in _HEADER.finditer(text):
            v = m.group("value")
            ok = _basic(v) if m.group("kind").lower() == "basic" else looks_random(v)
            if ok and is_value(v):
                yield base + m.start("value"), base + m.end("value")
    if "-p" in low and ("sql" in low or "bcp" in low):
        for m in _COMMAND.finditer(text):
            if is_value(m.group("value")):
                yield base + m.start("value"), base + m.end("value")
    if "sig" in low:
        for m in _SIGNATURE.finditer(text):
            if looks_random(m.group("value")):
                yield base + m.start("value"), base + m.end("value")
    if "_" in low or "-" in low or "akia" in low or "asia" in low or "eyj" in low or "aiza" in low or "sg." in low:
        for m in _KNOWN.finditer(text):
            yield base + m.start("value"), base + m.end("value")
    if '"' in low and ":" in low:
        for m in _JSON_PAIR.finditer(text):
            v = m.group("value")
            if is_secret_name(m.group("name")) and is_value(v) or is_key_name(m.group("name")) and looks_random(v):
                if not any(c.isspace() for c in v):
                    yield base + m.start("value"), base + m.end("value")


def _whole(v: str) -> bool:
    """A literal that as a whole may be a secret: no sentence, no connection string."""
    return not ((v.count(" ") >= 2 and not v.strip().isupper()) or _URL_START.match(v) or (";" in v and "=" in v) or v.lstrip()[:1] in "{<")


def _content(tok: str) -> tuple[int, str]:
    start = 2 if tok[0] in "nN" else 1
    return start, tok[start:-1] if tok[-1:] == "'" and len(tok) > start else tok[start:]


def tsql_spans(text: str) -> list[tuple[int, int]]:
    """Spans of credential values in a T-SQL text."""
    lexemes, _ = L.split(text)
    out: list[tuple[int, int]] = []
    sig: list[tuple[str, int]] = []  # significant lexemes so far
    pos = 0
    in_key = False  # a private key goes on in the line comments that follow
    for tok in lexemes:
        c = tok[0]
        if c in L.TRIVIA_FIRST:
            pos += len(tok)
            continue
        two = tok[:2]
        if two == "--" or two == "/*":
            if in_key and two == "--":
                a = len(tok) - len(tok.lstrip("-").lstrip())
                end = _PRIVATE_END.search(tok)
                if end:
                    a = min(a, end.start())  # the line's own dashes
                if a < len(tok):
                    out.append((pos + a, pos + (end.end() if end else len(tok.rstrip()))))
                in_key = not end
            else:
                out.extend(marked(tok, pos))
                begin = list(_PRIVATE.finditer(tok)) if two == "--" else []
                in_key = bool(begin) and not _PRIVATE_END.search(tok, begin[-1].end())
            pos += len(tok)
            continue
        in_key = False
        if c == "'" or (c in "nN" and two[1:] == "'"):
            off, v = _content(tok)
            found = list(marked(v, pos + off))
            if v and not found and _whole(v):
                name = _name_before(sig)
                if name is not None and (
                    is_secret_name(name) and is_value(v) or is_key_name(name) and looks_random(v) and is_value(v)
                ):
                    if not (name.lower().endswith("token") and " " in v.strip()) and not _is_prefix(v):
                        found = [(pos + off, pos + off + len(v))]
            out.extend(found)
        sig.append((tok, pos))
        pos += len(tok)
    return _merge(out + _column_values(sig) + _joined_values(sig) + _keyed_values(sig) + _passed_values(sig))


def _is_literal(tok: str) -> bool:
    return tok[-1:] == "'" and (tok[0] == "'" or tok[:2] in ("N'", "n'"))


def _span(tok: str, at: int) -> tuple[int, int]:
    off, v = _content(tok)
    return at + off, at + off + len(v)


_STATEMENT_WORDS = frozenset("UPDATE SET ; GO SELECT INSERT DELETE MERGE EXEC EXECUTE DECLARE CREATE ALTER DROP WITH IF WHILE BEGIN END PRINT".split())
_NUMBERED = re.compile(r"-\d+$")  # an id of a row, whatever its letters


def _keyed_values(sig: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Values of rows whose name is a credential's: UPDATE t SET Val = N'..' WHERE Name = N'smtp.password'."""
    out = []
    values: list[tuple[str, int]] = []
    where = False
    n = len(sig)
    for i, (tok, _) in enumerate(sig):
        word = tok.upper()
        if word in _STATEMENT_WORDS:
            if word != "SET" or where:
                values, where = [], False
        elif word == "WHERE":
            where = True
        elif tok == "=" and 0 < i < n - 1 and _is_literal(sig[i + 1][0]):
            v = _content(sig[i + 1][0])[1]
            if not where:
                if not sig[i - 1][0].startswith("@"):
                    values.append(sig[i + 1])
            elif is_secret_name(v) and not _NUMBERED.search(v):
                out += [_span(*x) for x in values if is_value(_content(x[0])[1]) and _whole(_content(x[0])[1])]
    return out


def _passed_values(sig: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Literals passed by position: EXEC sp_addlogin N'app', N'..'; EXEC dbo.SetPassword N'..'; ENCRYPTBYPASSPHRASE(N'..', @x); OPENROWSET('p', 's';'u';'..')."""
    out = []
    n = len(sig)
    for i, (tok, _) in enumerate(sig):
        low = tok.strip('[]"').lower()
        if low in ("exec", "execute"):
            j = i + 1
            if j + 1 < n and sig[j][0].startswith("@") and sig[j + 1][0] == "=":
                j += 2
            name = None
            while j < n and (sig[j][0] == "." or sig[j][0][0] in '["_#' or sig[j][0][0].isalpha()) and not _is_literal(sig[j][0]):
                if sig[j][0] != ".":
                    if name is not None and sig[j - 1][0] != ".":
                        break
                    name = sig[j][0].strip('[]"')
                j += 1
            if name is None:
                continue
            args: list[tuple[str, int] | None] = []
            while j < n:
                if _is_literal(sig[j][0]):
                    args.append(sig[j])
                elif sig[j][0].startswith("@") and j + 1 < n and sig[j + 1][0] == "=":
                    break  # named from here on
                else:
                    args.append(None)
                j += 1
                if j >= n or sig[j][0] != ",":
                    break
                j += 1
            known = _POSITIONS.get(name.lower())
            if known is None and is_secret_name(name):
                known = tuple(k for k in range(len(args) - 1, -1, -1) if args[k] is not None)[:1]  # the last literal
            picked = [args[k] for k in known or () if k < len(args)]
        elif low in _POSITIONS and i + 2 < n and sig[i + 1][0] == "(":
            picked = [sig[i + 2] if _is_literal(sig[i + 2][0]) else None]
        elif low == "openrowset" and i + 8 < n and sig[i + 5][0] == sig[i + 7][0] == ";":
            picked = [x if _is_literal(x[0]) else None for x in sig[i + 8 : i + 9]]
        else:
            continue
        out += [_span(*x) for x in picked if x is not None and is_value(_content(x[0])[1]) and _whole(_content(x[0])[1])]
    return out


def _joined_values(sig: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Values joined from literals: N'..;Password=' + N'abc' + N'def' + N';'."""
    out = []
    n = len(sig)
    for i in range(n - 2):
        tok = sig[i][0]
        if tok[-1:] != "'" or sig[i + 1][0] != "+" or sig[i + 2][0][-1:] != "'":
            continue
        _, v = _content(tok)
        if not _OPEN_END.search(v):
            continue
        j, parts = i + 2, []
        while j < n and sig[j][0][-1:] == "'":
            off, part = _content(sig[j][0])
            stop = re.search(r"[;'\"&\s]", part)
            end = stop.start() if stop else len(part)
            if end:
                parts.append((sig[j][1] + off, part[:end]))
            if stop or j + 1 >= n or sig[j + 1][0] != "+":
                break
            j += 2
        if parts and is_value("".join(p for _, p in parts)):
            out.extend((at, at + len(p)) for at, p in parts)
    return out


def _is_prefix(v: str) -> bool:
    return v.strip().lower() in ("bearer", "basic", "token")


def _name_before(sig: list[tuple[str, int]]) -> str | None:
    """Identifier that the literal after ``sig`` is assigned or passed to."""
    n = len(sig)
    if n < 2:
        return None
    last = sig[-1][0]
    if last == "=":
        at = n - 2
        prev = sig[at][0]
        if prev == ")":  # type with arguments: @x NVARCHAR(200) = '..'
            while at >= 0 and sig[at][0] != "(":
                at -= 1
            at -= 1
            if at < 1:
                return None
            prev = sig[at][0]
        if at >= 1 and not prev.startswith("@") and sig[at - 1][0].startswith("@"):
            return sig[at - 1][0]
        if at >= 2 and sig[at - 1][0].upper() == "AS" and sig[at - 2][0].startswith("@"):
            return sig[at - 2][0]
        return prev
    if last == ",":  # a name and its value side by side
        prev = sig[-2][0]
        if prev[-1:] == "'" and (n >= 3 and sig[-3][0] in ("(", ",")):
            _, v = _content(prev)
            if v and " " not in v and ("." in v or "_" in v or "-" in v or ":" in v or v.isidentifier()):
                return v if is_secret_name(v) else None
    if last.upper() == "BY" and sig[-2][0].upper() == "IDENTIFIED":
        return "password"
    return None


def _column_values(sig: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """Literals inserted into credential-named columns: INSERT INTO t (.., Password, ..) VALUES (..)."""
    out = []
    n = len(sig)
    for i in range(n):
        if sig[i][0].upper() != "VALUES" or i < 2 or sig[i - 1][0] != ")":
            continue
        names, j = [], i - 2
        while j >= 0 and sig[j][0] != "(":
            if sig[j][0] != ",":
                names.append(sig[j][0])
            j -= 1
        names.reverse()
        wanted = {k for k, x in enumerate(names) if is_secret_name(x)}
        if not wanted:
            continue
        j = i + 1
        while j < n and sig[j][0] == "(":
            depth, k, j = 1, 0, j + 1
            while j < n and depth:
                t, at = sig[j]
                if t == "(":
                    depth += 1
                elif t == ")":
                    depth -= 1
                elif t == "," and depth == 1:
                    k += 1
                elif depth == 1 and k in wanted and t[-1:] == "'" and sig[j + 1][0] in (",", ")"):
                    off, v = _content(t)
                    if is_value(v) and _whole(v):
                        out.append((at + off, at + off + len(v)))
                j += 1
            if j < n and sig[j][0] == ",":
                j += 1
    return out


def _named(name: str | None, v: str) -> bool:
    """Whether the name that a value bears in markup makes it a credential."""
    return bool(name) and (is_secret_name(name) and is_value(v) and _whole(v) or is_key_name(name) and looks_random(v) and is_value(v))


def _json_spans(text: str) -> Iterator[tuple[int, int]]:
    """String by string: values of credential-named members, lists of them too, and what carries its own mark."""
    names: list[str | None] = [None]  # of the open containers' values
    name = None
    at = 0
    tokens = list(_JSON_TOKEN.finditer(text))
    for k, m in enumerate(tokens):
        gap = text[at : m.start()]
        if gap.strip():  # numbers and words, comments, which some dialects allow
            yield from marked(gap, at)
        at = m.end()
        c = m.group()[0]
        if c == '"':
            a, b = m.start() + 1, m.end() - (len(m.group()) > 1 and m.group()[-1] == '"')
            if k + 1 < len(tokens) and tokens[k + 1].group() == ":" and not text[m.end() : tokens[k + 1].start()].strip():
                name = text[a:b]
                yield from marked(name, a)
                continue
            found = list(marked(text[a:b], a))
            yield from found
            if not found and not any(ch.isspace() for ch in text[a:b].strip()) and _named(name, text[a:b]):
                yield a, b
        elif c in "[{":
            names.append(name if c == "[" else None)
            name = names[-1]
        elif c in "]}":
            if len(names) > 1:
                names.pop()
            name = None
        elif c == ",":
            name = names[-1]
    yield from marked(text[at:], at)


def _xml_spans(text: str, base: int = 0, depth: int = 0) -> Iterator[tuple[int, int]]:
    """Token by token: attributes in any order, contents of elements, and what carries its own mark; comments may hold elements."""
    open_: list[str] = []
    for m in _XML_TOKEN.finditer(text):
        tok, at = m.group(), base + m.start()
        if tok.startswith(("<!--", "<![CDATA[")):
            yield from marked(tok, at)
            if depth == 0 and "<" in tok[4:]:
                yield from ((a, b) for a, b in _xml_spans(tok[4:], at + 4, 1) if b - a)
            continue
        if tok[0] != "<":
            yield from marked(tok, at)
            if open_ and tok.strip() and _named(open_[-1], tok.strip()):
                lead = len(tok) - len(tok.lstrip())
                yield at + lead, at + len(tok.rstrip())
            continue
        yield from marked(tok, at)
        members = [(a.group("name"), "q2" if a.group("q2") is not None else "q1", a) for a in _XML_MEMBER.finditer(tok)]
        names = [a.group(g) for own, g, a in members if own.lower() in ("key", "name")]
        for own, g, a in members:
            v = a.group(g)
            if _named(own, v) or own.lower() in ("value", "val") and any(_named(x, v) for x in names):
                yield at + a.start(g), at + a.end(g)
        e = _XML_NAME.match(tok)
        if e and not tok.endswith("/>"):
            open_.append(e.group(1))
        elif tok.startswith("</") and open_:
            open_.pop()


def markup_spans(text: str, language: str) -> list[tuple[int, int]]:
    """Spans of credential values in a JSON or XML text."""
    return _merge(list(_xml_spans(text) if language == "xml" else _json_spans(text)))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans(text: str | None, path: str | None) -> list[tuple[int, int]]:
    """Spans of all credential values of a script."""
    if not text:
        return []
    lang = language_of(path)
    return tsql_spans(text) if lang == "tsql" else markup_spans(text, lang)


def _replacement(value: str) -> str:
    """What stands for a value: of a private key the frame lines stay, with line breaks only where it had some."""
    begin = _PRIVATE.match(value)
    end = _PRIVATE_END.search(value)
    if not begin and not end:
        return REPLACEMENT
    body = value[begin.end() if begin else 0 : end.start() if end else len(value)]
    if body.strip():
        lead = re.match(r"(?:\s|\\[nrt])*", body).group()
        body = lead + REPLACEMENT + re.search(r"(?:(?:\\[nrt])|\s)*$", body[len(lead) :]).group()
    return (begin.group() if begin else "") + body + (end.group() if end else "")


def redact(text: str, found: list[tuple[int, int]]) -> str:
    """The text with only the values replaced."""
    out, at = [], 0
    for a, b in found:
        out += [text[at:a], _replacement(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


_BREAK = re.compile(r"\r\n|\r|\n")


def line_numbers(text: str, offsets: list[int]) -> list[int]:
    """Zero-based lines of ascending offsets."""
    out, line, at = [], 0, 0
    for o in offsets:
        line += sum(1 for _ in _BREAK.finditer(text, at, o))
        if o and text[o - 1] == "\r" and text[o : o + 1] == "\n":
            line -= 1  # the break ends after this offset
        out.append(line)
        at = o
    return out


_NEXT_LINE = re.compile(r"\s*--+[ \t]*")  # between two lines of a private key in line comments
_CONTINUED = re.compile(r"'\s*\+\s*[nN]?'")  # between two parts of a joined value


def _find_rows(ids, paths, texts):
    for i, path, text in zip(ids, paths, texts):
        found = spans(text, path)
        if found:
            before, in_key = 0, False
            for (a, b), n in zip(found, line_numbers(text, [a for a, _ in found])):
                goes_on = in_key and _NEXT_LINE.fullmatch(text, before, a) or _CONTINUED.fullmatch(text, before, a)
                yield i, n, a, b - a, goes_on is not None and bool(goes_on)
                in_key = bool(_PRIVATE.match(text, a, b) or in_key and goes_on) and not _PRIVATE_END.search(text, a, b)
                before = b


def _redact_rows(ids, paths, texts):
    for i, path, text in zip(ids, paths, texts):
        found = spans(text, path)
        if found:
            yield i, redact(text, found), len(found)


def find_credentials(scripts: DataFrame) -> DataFrame:
    """Each place: ``script_id, line_no, start, length, continued`` (zero-based); one pass, no shuffle.

    A value joined from several literals gives a place for each of them, continued from the second on.
    """
    return map_lists(scripts, ["script_id", "file_path", "text"], _find_rows, "script_id long, line_no long, start long, length long, continued boolean")


def credential_lines(scripts: DataFrame) -> DataFrame:
    """One row per line on which a value starts."""
    return find_credentials(scripts).where("not continued").select("script_id", "line_no").distinct()


def redact_credentials(scripts: DataFrame) -> DataFrame:
    """``script_id, redacted, places`` of each script that holds a credential; one pass, no shuffle."""
    return map_lists(scripts, ["script_id", "file_path", "text"], _redact_rows, "script_id long, redacted string, places int")
