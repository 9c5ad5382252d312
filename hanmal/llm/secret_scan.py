"""Secrets found by the names they are assigned to (operator 7).

The lexer walks over a text token by token: comments, literals (with prefixes, escapes, triple quotes), names, operators, brackets and
elements of markup. So a quote in a comment opens no literal, and an operator in a literal belongs to the literal alone; the
contents of comments and literals are lexed as texts of their own, as both may hold settings. At each assignment (=, :=, =>, :, +=,
?=, #define, define()) the tokens of the statement give the target: a name, dotted or dashed name, "json key", table["key"], annotated
or typed name, array, element, env or ini line, or the name that stands in a pair such as name: X, value: Y. The expression after it is
read: literals, bare configuration values, block scalars, and joins of these by +, by juxtaposition, or by interpolation
(f"{a}", "${a}", $a). Names keep the value they were last given in their scope (braces, or the indented body of def and class), so constants
are propagated into later expressions that can see them. Each name-literal pair is scored: how sensitive the last part of the
target is, times how much the literal looks like a credential rather than a word, a placeholder or a reference.

The whole text is lexed, and no length of name, line or literal is too long. A name is sensitive only if it holds one of the words of SENSITIVE, so
documents without any of them, or without an operator, are dropped before Python sees them. Findings carry offsets, a masked literal and
its SHA-256, never the literal.

Defined results: null and empty texts have no findings; findings of rows with a null doc_id are reported with it; repeated rows and
repeated assignments are findings of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, require

THRESHOLD = 0.5
#: Literals and comments within each other that are opened.
DEEPEST = 50
_QUOTED = r'''"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|(?<!\w)'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`'''
TOKEN = re.compile(
    rf"""(?P<space>[^\S\n]+)|(?P<newline>\n)
|(?P<define>\#[ \t]*define[ \t]+(?P<macro>\w+)[ \t]+(?=["\'\w])|\bdefine[ \t]*\([ \t]*(?P<dq>["\'])(?P<const>\w+)(?P=dq)[ \t]*,[ \t]*)
|(?P<comment>/\*(?:(?!\*/)[\s\S])*(?:\*/)?|<!--(?:(?!-->)[\s\S])*(?:-->)?|(?<![^\s;{{}}(),])(?:\#|//|--(?=[ \t]))[^\n]*|(?<![^\n]);[^\n]*)
|(?P<literal>(?:(?<![\w$])[bBrRfFuU]{{1,2}}(?=["\']))?(?:{_QUOTED.replace("#", chr(92) + "#").replace(" ", chr(92) + " ")}))
|(?P<element><(?P<tag>[A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>(?P<inner>[^<>]*)</(?P=tag)\s*>)
|(?P<name>[$@]?[^\W\d][\w$]*(?:(?:\.|->|::|\?\.|-(?=[^\W\d]))[$]?[^\W\d][\w$]*)*)
|(?P<other>={{2,3}}|=~|[!<>*/%&|^\-]=|::|:(?=[/\\])|<[-=]|->)
|(?P<op>:=|=>|\+=|\|\|=|\?\??=|=|:)
|(?P<bracket>[\[\](){{}}<>,;])|(?P<rest>[\s\S])""",
    re.VERBOSE,
)
LITERAL = re.compile(r"""(?P<prefix>[bBrRfFuU]{0,2})(?P<quote>\"\"\"|'''|"|'|`)""")
BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>#&]+""")
LINE_VALUE = re.compile(r"""[^\s"'`{}\[\]()<>,;#][^\s"'`<>]*""")
JOIN = re.compile(r"\s*\+(?![=+])|[ \t]*\.\.[ \t]*")
BLOCK = re.compile(r"[ \t]*[|>][+\-\d]{0,2}[ \t]*(?:#[^\n]*)?\n")
NAME = re.compile(r"\$?[A-Za-z_][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
HOLE = re.compile(r"\$?\{\s*([A-Za-z_][\w.]*)\s*\}|\$([A-Za-z_]\w*)")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
PARTS = re.compile(r"\.|->|::|\?\.|/")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----")
SENSITIVE = {"password": 1.0, "passwords": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "pass": 0.8, "passcode": 0.9, "secret": 1.0, "secrets": 0.9, "token": 0.95, "tokens": 0.6, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.75, "authorization": 0.75, "bearer": 0.85, "signature": 0.6, "key": 0.6, "salt": 0.6, "pin": 0.6, "cookie": 0.5}
#: Names whose literals may be words: nothing else is assigned to them.
PLAIN = {"password", "passwords", "passwd", "passphrase", "passcode", "pwd", "secret"}
#: Every word of SENSITIVE, and every name that is one when written together, holds one of these.
STEMS = "(?i)pass|pwd|secret|token|key|credential|auth|bearer|signature|salt|pin|cookie"
#: Words that make a following "key" sensitive, and words that say before or after a sensitive one that the value is something else.
KEY_KINDS = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "client", "service", "auth", "ssh", "aws", "deploy", "shared", "storage"}
NOT_AFTER = {"public", "primary", "foreign", "cache", "sort", "partition", "min", "max", "num", "total", "no", "has", "is", "use", "enable", "foreign"}
HARMLESS = {"count", "max", "min", "length", "len", "size", "type", "url", "uri", "path", "file", "filename", "name", "header", "expiry", "expires", "ttl", "id", "field", "column", "index", "limit", "prompt", "hint", "label", "placeholder", "policy", "env", "format", "pattern", "regex", "status", "required", "enabled", "provider", "algorithm"}
#: Ends of names that are sensitive whatever their last word is.
WHOLE_ENDS = {"accesskeyid": 0.95, "apikey": 1.0, "secretkey": 1.0, "accesskey": 0.95, "authtoken": 0.95, "privatekey": 1.0, "clientsecret": 1.0, "apikeyid": 0.95}
LABELS, VALUES = {"name", "key", "property", "variable"}, {"value", "default", "val", "content", "defaultvalue"}
TYPE = re.compile(r"[\w\[\].<>|?&*, ]+")
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|none|null|nil|true|false|undefined|todo|tbd|redacted|hidden|masked|empty|string|str|bytes|password|secret|token|changeme|change[_-]me|.*\b(?:your|example|sample|dummy|placeholder|insert)[_\- ].*|your.*|<.*>|\{\{.*|(?:(?:\$\{[^}]*\}|\$\([^)]*\)|\$[a-z_]\w*+|%\(\w+\)[a-z]|%[a-z_]\w*+%|%[sdr])[\s:/@.,_\-]*+)+|os\.environ.*|process\.env.*|getenv.*|env\(.*)$")


@dataclass(frozen=True)
class Pair:
    name: str
    literal: str
    begin: int
    end: int
    propagated: bool
    quoted: bool = False


def _words(name: str) -> list[str]:
    return [w.lower() for w in WORD.findall(name.replace("-", "_"))]


def last_part(name: str) -> str:
    return PARTS.split(name)[-1]


def name_score(name: str) -> float:
    """How surely what is assigned to name is a secret, by the words of its last part."""
    words = _words(last_part(name))
    joined = "".join(words)
    best = max((v for k, v in WHOLE_ENDS.items() if joined.endswith(k)), default=0.0)
    if best:
        return best
    for i, w in enumerate(words):
        s = SENSITIVE.get(w, 0.0)
        if w == "key" and i and words[i - 1] in KEY_KINDS:
            s = 0.95
        if i and words[i - 1] in NOT_AFTER:
            s *= 0.3
        if any(x in HARMLESS for x in words[i + 1 :]):
            s *= 0.3
        best = max(best, s)
    return best


def entropy(s: str) -> float:
    """Bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def literal_score(s: str, name: str = "", quoted: bool = False) -> float:
    """How much s looks like a credential."""
    if PEM.search(s):
        return 1.0
    if not s.strip() or PLACEHOLDER.match(s):
        return 0.0
    words = _words(last_part(name))
    if "pin" in words and re.fullmatch(r"\d{4,12}", s):
        return 1.0
    plain = 0.55 if quoted and not PLAIN.isdisjoint(words) else 0.0
    return plain if len(set(s)) < 3 else max(_looks(s), plain)


def _looks(s: str) -> float:
    kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w\s]"))
    if re.search(r"\s", s):  # several words: a phrase, unless each piece of it is a credential's
        return 0.55 if kinds >= 3 and min(map(_looks, s.split())) >= 0.15 else 0.15
    if re.fullmatch(r"[A-Za-z_.\-]+", s) and not (re.search("[a-z]", s) and re.search("[A-Z]", s) and entropy(s) > 3.8 and len(s) >= 16):
        return 0.3 if len(s) >= 8 else 0.15
    bits = entropy(s) * len(s)
    return min(1.0, 0.35 + 0.15 * (kinds >= 3) + min(bits, 80) / 100)


class Lexer:
    """The name-literal pairs of one text, in order."""

    def __init__(self, text: str, depth: int = 0):
        self.text, self.depth = text, depth
        #: Kind and indentation of each open scope, and the values of its names.
        self.scopes: list[tuple[str, int, dict[str, str]]] = [("file", -1, {})]
        self.out: list[Pair] = []
        self.label: str | None = None

    def lookup(self, key: str) -> str | None:
        return next((k[key] for _, _, k in reversed(self.scopes) if key in k), None)

    def assign(self, key: str, value: str) -> None:
        at = self.scopes[0][2] if key.startswith(("self.", "this.")) else self.scopes[-1][2]
        at[key] = value

    def pairs(self) -> list[Pair]:
        text, before = self.text, []  # before: the tokens of the statement so far
        fresh = True  # at the start of a line
        for m in TOKEN.finditer(text):
            kind, word = m.lastgroup, m.group()
            if kind in ("macro", "dq", "const"):
                kind = "define"
            elif kind in ("tag", "inner"):
                kind = "element"
            if fresh and kind not in ("space", "newline", "comment"):
                self.enter(m.start())
                fresh = False
            if kind == "newline":
                fresh, before = True, []
            elif kind == "comment":
                self.inside(m.start() + len(word) - len(word.lstrip("#/;-!*<")), m.end())
            elif kind == "literal":
                before.append((kind, m))
                quote = LITERAL.match(word)
                self.inside(m.start() + quote.end(), m.end() - len(quote["quote"]))
            elif kind == "element":
                self.inside(m.start() + 1, m.start("inner"))
                if m["inner"].strip():
                    self.pair(m["tag"].rpartition(":")[2], m["inner"].strip(), m.start("inner"), m.end("inner"), False, True)
            elif kind == "name":
                before.append((kind, m))
            elif kind == "define":
                self.read(m["macro"] or m["const"], m, "=")
                before = []
            elif kind == "op":
                if (name := self.target(before)) is not None:
                    self.read(name, m, word)
                before.append((kind, m))
            elif kind == "bracket":
                if word == "{":
                    self.scopes.append(("brace", -1, {}))
                elif word == "}":
                    self.leave()
                before = before + [(word, m)] if word in "[]<>" else []
            elif kind == "rest" and word in "&*|?":
                before.append((word, m))
        return self.out

    def enter(self, at: int) -> None:
        """Ends bodies that are indented deeper than the line that begins at `at`, and opens one for def and class."""
        line = self.text.rfind("\n", 0, at) + 1
        indent = at - line
        while self.scopes[-1][0] == "body" and self.scopes[-1][1] >= indent:
            self.scopes.pop()
        if re.compile(r"(?:async[ \t]+)?(?:def|class)[ \t]+\w").match(self.text, at):
            self.scopes.append(("body", indent, {}))

    def leave(self) -> None:
        self.label = None
        for k in range(len(self.scopes) - 1, 0, -1):
            if self.scopes[k][0] == "brace":
                del self.scopes[k:]
                return

    def inside(self, begin: int, end: int) -> None:
        """The pairs of a comment, of a literal's content, or of an element's attributes."""
        part = self.text[begin:end]
        if ("=" in part or ":" in part) and re.search(STEMS, part) and self.depth < DEEPEST:
            self.out += [replace(p, begin=p.begin + begin, end=p.end + begin) for p in Lexer(part, self.depth + 1).pairs()]

    def pair(self, name: str, value: str, begin: int, end: int, propagated: bool, quoted: bool) -> None:
        base = "".join(_words(last_part(name)))
        if base in VALUES and self.label:
            name = self.label
        elif base in LABELS:
            self.label = value
        elif base not in VALUES:
            self.label = None
        self.out.append(Pair(name, value, begin, end, propagated, quoted))

    def read(self, name: str, op: re.Match, word: str) -> None:
        """The pair of this target and the expression after the operator."""
        if (block := word == ":" and self.block(op.end(), name)) or (got := self.expression(op.end(), word, self.alone(op))) is None:
            return
        value, begin, end, propagated = got
        key = name.lstrip("$")
        if word == "+=":
            old = self.lookup(key)
            value, propagated = (old or "") + value, propagated or old is not None
        self.assign(key, value)
        self.pair(name, value, begin, end, propagated, self.text[begin - 1] in "\"'`" or self.setting(op, end))

    def block(self, at: int, name: str) -> bool:
        """Whether a block scalar follows; its pair is added."""
        if not (m := BLOCK.match(self.text, at)):
            return False
        line = self.text[self.text.rfind("\n", 0, at) + 1 : at]
        indent = len(line) - len(line.lstrip(" -"))
        end = m.end()
        for row in re.compile(r"[^\n]*(?:\n|\Z)").finditer(self.text, m.end()):
            if row.group() == "" or (row.group().strip() and len(row.group()) - len(row.group().lstrip(" ")) <= indent):
                break
            end = row.end()
        value = "\n".join(x.strip() for x in self.text[m.end() : end].splitlines()).strip()
        if value:
            self.pair(name, value, m.end(), end, False, True)
        return bool(value)

    def alone(self, op: re.Match) -> bool:
        """Whether all before the operator on its line is a name, as in settings files."""
        line = self.text[self.text.rfind("\n", 0, op.start()) + 1 : op.start()]
        return op.group() == "=" and re.fullmatch(r"[ \t]*(?:export[ \t]+|set[ \t]+)?[\w.\-]+[ \t]*", line) is not None

    def setting(self, op: re.Match, end: int) -> bool:
        """Whether a bare value is all of a line NAME=value, as in an environment file."""
        rest = self.text[op.end() : end]
        return self.alone(op) and not self.text[op.start() - 1].isspace() and not rest[:1].isspace() and self.text[end : end + 1] in ("", "\n", "\r")

    def target(self, before: list[tuple[str, re.Match]]) -> str | None:
        """The name that an operator after these tokens assigns to."""
        if not before:
            return None
        kinds = [k for k, _ in before]
        kind, m = before[-1]
        colon = max((i for i, (k, x) in enumerate(before) if k == "op" and x.group() == ":"), default=0)
        if colon and kinds[colon - 1] in ("name", "literal") and "op" not in kinds[colon + 1 :] and kind != "literal" and TYPE.fullmatch(self.text[before[colon][1].end() : m.end()]):
            return self.target(before[:colon])  # an annotated name
        if kind == "]":
            opens = max((i for i, k in enumerate(kinds) if k == "["), default=0)
            if not opens:
                return None
            if kinds[opens + 1 :] == ["literal", "]"]:
                outer = self.target(before[:opens])
                inner = self.content(before[opens + 1][1].group())
                return f"{outer}.{inner}" if outer else inner
            return self.target(before[:opens])
        if kind == "literal":
            return self.content(m.group())
        if kind == "name":
            if len(before) > 2 and kinds[-2] == "name" and before[-3][1].group() in ("var", "const", "let", "val"):
                return before[-2][1].group()  # var name type = ...
            return m.group().rstrip(".-").lstrip("@")
        return None

    @staticmethod
    def content(literal: str) -> str:
        quote = LITERAL.match(literal)
        return literal[quote.end() : -len(quote["quote"])]

    def expression(self, at: int, op: str, alone: bool = False) -> tuple[str, int, int, bool] | None:
        """Value, begin, end, and whether a known name went into it."""
        parts: list[str] = []
        first = last = None
        propagated, joined = False, True
        while True:
            while at < len(self.text) and self.text[at] in " \t(" + ("\r\n" if parts and joined else ""):
                at += 1
            m = LITERAL.match(self.text, at)
            if m:
                end = self.close(m.end(), m["quote"])
                if end is None:
                    break
                value, used = self.fill(self.text[m.end() : end], m["prefix"], m["quote"])
                propagated |= used
                if first is None:
                    first = m.end()
                at = last = end
                at += len(m["quote"])
            elif not joined:
                break
            else:
                m = NAME.match(self.text, at)
                known = self.lookup(m.group().lstrip("$")) if m else None
                if known is not None and not (op == ":" and not parts):
                    value, end, propagated = known, m.end(), True
                elif parts:
                    break
                elif op == ":" and self.text.startswith("!!", at) and (m := re.compile(r"!![\w]+[ \t]+").match(self.text, at)):
                    at = m.end()  # a type tag
                    continue
                elif m := (LINE_VALUE if alone else BARE).match(self.text, at):
                    value, used = self.fill(m.group(), "", "")
                    value = value.rstrip(".") if op == ":" else value.rstrip(",;") if alone else value
                    propagated |= used
                    end = m.end()
                else:
                    break
                if first is None:
                    first = at
                at = last = end
            parts.append(value)
            m = JOIN.match(self.text, at)
            joined = m is not None
            if m:
                at = m.end()
        return ("".join(parts), first, last, propagated) if parts else None

    def close(self, at: int, quote: str) -> int | None:
        """Where the literal opened before `at` ends; one-line quotes end in their line."""
        while True:
            end = self.text.find(quote, at)
            if end < 0 or (len(quote) == 1 and quote != "`" and "\n" in self.text[at:end]):
                return None
            back = end
            while back > at and self.text[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                return end
            at = end + 1

    def fill(self, raw: str, prefix: str, quote: str) -> tuple[str, bool]:
        """A literal's value with escapes and holes of known names resolved."""
        used = False

        def known(m: re.Match) -> str:
            nonlocal used
            value = self.lookup(m[1] or m[2])
            if value is None or (m.group()[0] == "{" and "f" not in prefix.lower()):
                return m.group()
            used = True
            return value

        if "\\" in raw and "r" not in prefix.lower():
            raw = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), raw)
        if ("$" in raw and quote != "'") or "f" in prefix.lower():
            raw = HOLE.sub(known, raw)
        return raw, used


def findings(text: str | None, threshold: float = THRESHOLD) -> list[tuple[Pair, float]]:
    """Pairs whose score reaches the threshold."""
    out = []
    for p in Lexer(text).pairs() if text and re.search(STEMS, text) else ():
        by_name = name_score(p.name)
        score = by_name * literal_score(p.literal, p.name, p.quoted) if by_name else 0.0
        if score >= threshold:
            out.append((p, score))
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, name, begin, end, masked, sha256, entropy, propagated and score of each finding."""
    require(docs, "doc_id", "text")

    def fn(cols: list[list]) -> dict:
        rows = [(i, p.name, p.begin, p.end, p.literal[:4] + "…", hashlib.sha256(p.literal.encode()).hexdigest(), entropy(p.literal), p.propagated, s) for i, t in zip(*cols, strict=True) for p, s in findings(t, threshold)]
        names = ("doc_id", "name", "begin", "end", "masked", "sha256", "entropy", "propagated", "score")
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    schema = "doc_id long, name string, begin int, end int, masked string, sha256 string, entropy double, propagated boolean, score double"
    src = docs.where((F.col("text").contains("=") | F.col("text").contains(":") | F.col("text").contains("define") | F.col("text").contains("</")) & F.col("text").rlike(STEMS))
    return map_rows(src, [F.col("doc_id").cast("long"), "text"], fn, schema)
