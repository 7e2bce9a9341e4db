"""Go: a tokenizer with automatic semicolons, and a walk over the top-level declarations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .base import Symbol, register

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<op>\.\.\.|<-|:=|&\^=?|<<=?|>>=?|[&|]{2}|\+\+|--|[-+*/%&|^=!<>]=|.)""",
    re.S,
)
_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    text: str
    kind: str
    line: int


def tokens_of(source: str) -> list[Token]:
    out: list[Token] = []
    line = 1

    def end_line():
        if out and (out[-1].kind in ("name", "number", "string") and out[-1].text not in ("func", "type", "var", "const", "import", "package", "struct", "interface", "map", "chan") or out[-1].text in _ENDS):
            out.append(Token(";", "op", out[-1].line))

    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "line" or kind == "comment" and "\n" in text:
            end_line()
        elif kind not in ("space", "comment"):
            out.append(Token(text, kind, line + (0)))
        line += text.count("\n")
    end_line()
    return out


class _Reader:
    """A cursor over tokens."""

    def __init__(self, tokens: list[Token]):
        self.tokens, self.i = tokens, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i] if self.i < len(self.tokens) else Token("", "end", self.tokens[-1].line if self.tokens else 1)

    def peek(self, k: int = 1) -> str:
        return self.tokens[self.i + k].text if self.i + k < len(self.tokens) else ""

    def take(self) -> Token:
        t = self.now
        self.i += 1
        return t

    def group(self) -> list[Token]:
        """The tokens between a bracket and its partner; the cursor ends up behind it."""
        stack, first = [_PAIRS[self.take().text]], self.i
        while stack and self.i < len(self.tokens):
            t = self.take().text
            if t in _PAIRS:
                stack.append(_PAIRS[t])
            elif t == stack[-1]:
                stack.pop()
        return self.tokens[first : self.i - (0 if stack else 1)]

    def statement(self) -> list[Token]:
        """The tokens up to the next semicolon outside of brackets."""
        first = self.i
        while self.now.kind != "end" and self.now.text != ";":
            if self.now.text in _PAIRS:
                self.group()
            else:
                self.take()
        found = self.tokens[first : self.i]
        self.take()
        return found


def split(tokens: list[Token], by: str) -> list[list[Token]]:
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t.text in _PAIRS) - (t.text in _PAIRS.values())
        if t.text == by and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def expression(tokens: list[Token]) -> str:
    """An expression or type on one line; bodies of structs, interfaces and literals are left out."""
    r, out = _Reader([t for t in tokens if t.text != ";"]), []
    while r.now.kind != "end":
        t = r.now.text
        if t in ("struct", "interface") and r.peek() == "{":
            r.take()
            r.group()
            out.append(t + "{...}")
        elif t == "func" and r.peek() == "(":
            r.take()
            out.append("func" + parameters(r.group()) + results(r))
        elif t == "map" and r.peek() == "[":
            r.take()
            out.append(f"map[{expression(r.group())}]")
        elif t == "{":
            r.group()
            out.append("{...}")
        elif t in ("(", "["):
            inner = split(r.group(), ",")
            out.append(t + ", ".join(map(expression, inner)) + _PAIRS[t])
        elif t == "chan":
            r.take()
            arrow = r.now.text == "<-"
            if arrow:
                r.take()
            out.append("chan<- " if arrow else "chan ")
        else:
            r.take()
            binary = t in ("+", "-", "*", "/", "|", "&", "<<", ">>", "==", "%", "^") and out and not out[-1].endswith(("(", "[", " ", "*", "&", "...", "]"))
            out.append(f" {t} " if binary else t)
    return "".join(out)


def parameters(tokens: list[Token]) -> str:
    """A parameter list: names in front of their types, as in the source."""
    parts = split([t for t in tokens if t.text != ";"], ",")
    named = any(len(p) > 1 and p[0].kind == "name" and p[0].text not in ("func", "map", "chan", "struct", "interface") and p[1].text not in (".", "[") or len(p) > 3 and p[0].kind == "name" and p[1].text == "[" and _is_named_array(p) for p in parts)
    if not named:
        return "(" + ", ".join(map(expression, parts)) + ")"
    out = []
    for p in parts:
        out.append(p[0].text + (" " + expression(p[1:]) if len(p) > 1 else ""))
    return "(" + ", ".join(out) + ")"


def _is_named_array(p: list[Token]) -> bool:
    r = _Reader(p[1:])
    r.group()
    return r.now.kind != "end"


def results(r: _Reader) -> str:
    """Results behind a parameter list, always in parentheses."""
    if r.now.text == "(":
        inner = r.group()
        return " " + parameters(inner) if inner else ""
    first = r.i
    while r.now.kind != "end" and r.now.text not in ("{", ";", ",", ")"):
        if r.now.text in ("struct", "interface") and r.peek() == "{":
            r.take()
            r.group()
        elif r.now.text in _PAIRS:
            r.group()
        else:
            r.take()
    found = r.tokens[first : r.i]
    return f" ({expression(found)})" if found else ""


def _function(r: _Reader) -> Symbol | None:
    start = r.take().line
    receiver = None
    if r.now.text == "(":
        inner = r.group()
        receiver = parameters(inner)[1:-1]
    if r.now.kind != "name":
        r.statement()
        return None
    name = r.take().text
    if r.now.text == "[":
        r.group()
    given = parameters(r.group()) if r.now.text == "(" else "()"
    sig = f"func {receiver} {name}" if receiver else f"func {name}"
    sig += given + results(r)
    if r.now.text == "{":
        r.group()
    end = r.tokens[min(r.i, len(r.tokens)) - 1].line
    if r.now.text == ";":
        r.take()
    return Symbol(name, "method" if receiver else "func", start, end, sig)


def _type(spec: list[Token]) -> Symbol:
    name, rest = spec[0].text, spec[1:]
    sig = f"type {name}"
    if rest and rest[0].text == "[" and len(rest) > 2 and rest[1].kind == "name" and rest[2].text not in ("]",):
        r = _Reader(rest)
        sig += parameters(r.group())
        rest = rest[r.i :]
    if rest and rest[0].text == "=":
        rest = rest[1:]
    return Symbol(name, "type", spec[0].line, _end(spec), f"{sig} {expression(rest)}".rstrip())


def _end(spec: list[Token]) -> int:
    return spec[-1].line + spec[-1].text.count("\n")


def _values(kind: str, spec: list[Token]) -> list[Symbol]:
    names, i = [], 0
    while i < len(spec) and spec[i].kind == "name":
        names.append(spec[i].text)
        i += 1
        if i < len(spec) and spec[i].text == ",":
            i += 1
        else:
            break
    kinds, depth = [], 0
    for t in spec[i:]:
        if t.text == "=" and not depth:
            break
        depth += (t.text in _PAIRS) - (t.text in _PAIRS.values())
        kinds.append(t)
    sig = f"{kind} {', '.join(names)}" + (f" {expression(kinds)}" if kinds else "")
    return [Symbol(n, kind, spec[0].line, _end(spec), sig) for n in names]


def _specs(r: _Reader) -> list[list[Token]]:
    r.take()
    if r.now.text != "(":
        return [s] if (s := r.statement()) else []
    inner = _Reader(r.group())
    found = []
    while inner.now.kind != "end":
        if s := inner.statement():
            found.append(s)
    if r.now.text == ";":
        r.take()
    return found


def parse(path: str, text: str, aliases: dict) -> tuple[list[Symbol], list[str]]:
    """What can be read of a file, also of a broken one."""
    r = _Reader(tokens_of(text))
    symbols: list[Symbol] = []
    imports: list[str] = []
    while r.now.kind != "end":
        word = r.now.text
        if word == "func":
            found = _function(r)
            symbols += [found] if found else []
        elif word == "import":
            imports += [p for s in _specs(r) if (p := s[-1].text.strip('"')) and s[-1].kind == "string"]
        elif word == "type":
            symbols += [_type(s) for s in _specs(r) if s[0].kind == "name"]
        elif word in ("var", "const"):
            symbols += [v for s in _specs(r) if s[0].kind == "name" for v in _values(word, s)]
        else:
            r.statement()
    return symbols, imports


register("go", ("go",), parse)
