"""Symbols and imports of the TypeScript family: a tokenizer, and a reader that walks over statements and members."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from ..functions.text import CODE_EXTENSIONS
from ..sources.aliases import resolve_alias
from .base import Symbol, register

SIGNATURE_BYTES = 200

_LEX = re.compile(
    r"""(?P<gap>(?:[^\S\n]|//[^\n]*)+)|(?P<line>\n)|(?P<comment>/\*(?:.*?\*/|.*\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")"""
    r"""|(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|\?\?|&&|\|\||[=!<>+*%&|^/-]=+|.)""",
    re.S,
)
_CHUNK = re.compile(r"(?:\\.|[^\\`$]|\$(?!\{))*", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Names behind which an expression starts, so that a slash opens a regular expression there.
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "${": "}"}, {")", "]", "}"}
#: Signs that leave a statement open at the end of a line, and those that carry one on from the next.
_OPERATORS = set("= | & : , . ? + - * / < % ! ~ ^ => ?? && || ... ?.".split()) | {"==", "===", "!=", "!==", "<=", "+=", "-=", "*=", "/=", "|=", "&="}
_CARRY_ON = set("| & . ? : = + * / % < > => ?? && || ?. ) ] , == === != !== <= >= += -=".split()) | {"extends", "keyof", "as", "satisfies", "instanceof", "in"}
_MODIFIERS = {"public", "private", "protected", "static", "async", "abstract", "override", "readonly", "declare", "accessor", "get", "set"}
_NOT_MEMBERS = {"if", "for", "while", "switch", "catch", "return", "do", "else", "new", "typeof", "function", "case", "with"}


@dataclass(slots=True)
class Token:
    text: str
    kind: str
    line: int
    fresh: bool  # the first of its line
    gap: bool  # something lies between it and the one before

    @property
    def shown(self) -> str:
        """As in a signature: literals are empty."""
        return {"string": self.text[0] * 2, "regex": "//" + self.text.rpartition("/")[2]}.get(self.kind, self.text)


def tokens_of(source: str) -> list[Token]:
    """All tokens but comments. A template's marks are tokens of their own, and so are those of its expressions."""
    out: list[Token] = []
    inside: list[int] = []  # for each open template expression the braces that are open in it
    at, line, fresh, gap = 0, 1, True, False

    def put(text: str, kind: str):
        nonlocal fresh, gap
        out.append(Token(text, kind, line, fresh, gap))
        fresh = gap = False

    def template(start: int) -> int:
        """From a template's text to the end of the template or to its next expression."""
        nonlocal line
        end = _CHUNK.match(source, start).end()
        line += source.count("\n", start, end)
        if source.startswith("${", end):
            put("${", "mark")
            inside.append(0)
            return end + 2
        if end < len(source):
            put("`", "mark")
        return end + 1

    while at < len(source):
        if source[at] == "`":
            put("`", "mark")
            at = template(at + 1)
            continue
        if source[at] == "}" and inside and not inside[-1]:
            inside.pop()
            put("}", "mark")
            at = template(at + 1)
            continue
        last = out[-1] if out else None
        value = last and (last.kind in ("number", "string", "regex") or last.kind == "name" and last.text not in _BEFORE_VALUE or last.text in (")", "]") or last.text in ("`", "}") and last.kind == "mark")
        if source[at] == "/" and not value and (m := _REGEX.match(source, at)):
            put(m.group(), "regex")
            at = m.end()
            continue
        m = _LEX.match(source, at)
        text, kind, at = m.group(), m.lastgroup, m.end()
        if kind in ("gap", "line", "comment"):
            line += text.count("\n")
            fresh, gap = fresh or "\n" in text, True
            continue
        if inside and text in "{}":
            inside[-1] += 1 if text == "{" else -1
        put(text, kind)
        line += text.count("\n")
    return out


# -- imports ----------------------------------------------------------------

_EXTENSION = re.compile(r"\.(?:" + "|".join(CODE_EXTENSIONS) + ")$", re.I)


def file_key(path: str) -> str:
    return re.sub(r"/index$", "", _EXTENSION.sub("", path))


def import_key(importer: str, spec: str, aliases: dict) -> str:
    """What a specifier means: a file's key if it is relative or an alias, else itself."""
    if spec.startswith("."):
        return file_key(posixpath.normpath(posixpath.join(posixpath.dirname(importer), spec)))
    target = resolve_alias(spec, aliases)
    return spec if target is None else file_key(target)


def specifiers(tokens: list[Token]) -> list[str]:
    """What a source imports, in order: ``from`` of import and export statements, ``import()`` and ``require()``."""
    found: list[str] = []
    stated = False  # inside a statement that may name a source
    for i, t in enumerate(tokens):
        before = tokens[i - 1] if i else None
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        if t.kind == "name" and t.text in ("import", "export") and (t.fresh or before is None or before.text in (";", "}")):
            # an export of a declaration names none
            stated = bool(after) and after.kind != "string" and (t.text == "import" or after.text in ("{", "*", "type"))
        elif t.text == ";":
            stated = False
        if t.kind != "string":
            continue
        called = i > 1 and before.text == "(" and tokens[i - 2].text in ("import", "require")
        named = stated and before.text == "from"
        if called or named:
            found.append(t.text[1:-1])
        if named:
            stated = False
    return found


def imports_in(path: str, text: str, aliases: dict, tokens: list[Token] | None = None) -> list[str]:
    """Import keys in order of first appearance; a bare side-effect import isn't one."""
    keys = (import_key(path, s, aliases) for s in specifiers(tokens_of(text) if tokens is None else tokens))
    return list(dict.fromkeys(k for k in keys if k))


# -- declarations -----------------------------------------------------------


class _Reader:
    """A cursor over tokens that gathers symbols."""

    def __init__(self, tokens: list[Token], first_line: int):
        self.tokens, self.i, self.first_line, self.found = tokens, 0, first_line, []

    def text(self, k: int = 0) -> str:
        return self.tokens[self.i + k].text if 0 <= self.i + k < len(self.tokens) else ""

    def is_name(self, k: int = 0) -> bool:
        return 0 <= self.i + k < len(self.tokens) and self.tokens[self.i + k].kind == "name"

    def fresh(self, k: int = 0) -> bool:
        return self.i + k >= len(self.tokens) or self.tokens[self.i + k].fresh

    def group(self) -> None:
        """Over a bracket and all up to its partner."""
        stack = [_OPEN[self.text()]]
        self.i += 1
        while stack and self.i < len(self.tokens):
            t = self.text()
            if t in _OPEN:
                stack.append(_OPEN[t])
            elif t in _CLOSE and t in stack:
                while stack.pop() != t:  # what a broken file has left open
                    pass
            self.i += 1

    def angles(self) -> None:
        """Over type parameters."""
        depth = 0
        while self.i < len(self.tokens):
            t = self.text()
            if t in _OPEN:
                self.group()
                continue
            depth += (t == "<") - t.count(">") * (t in (">", ">=", ">>"))
            self.i += 1
            if depth <= 0:
                return

    def body(self) -> bool:
        """To the block of a declaration, past its types; False where the statement ends without one."""
        while self.i < len(self.tokens):
            t, before = self.text(), self.text(-1)
            if t == "{":
                if before not in _OPERATORS and before not in ("extends", "keyof"):
                    return True
                self.group()  # an object type
            elif t in _OPEN:
                self.group()
            elif t in (";", "}") or self.fresh() and before not in _OPERATORS and before != "(" and t not in _CARRY_ON and t != "implements":
                return False
            elif t == "<":
                self.angles()
            else:
                self.i += 1
        return False

    def rest(self, separators: tuple[str, ...] = (";",)) -> None:
        """To the end of a statement: a semicolon, or a line that neither its last sign nor the next one's first carries on."""
        begun = False
        while self.i < len(self.tokens):
            t = self.text()
            if t in separators:
                self.i += 1
                return
            if t in _CLOSE or begun and self.fresh() and self.text(-1) not in _OPERATORS and t not in _CARRY_ON:
                return
            begun = True
            if t in _OPEN:
                self.group()
            else:
                self.i += 1

    def put(self, start: int, name: str, kind: str) -> None:
        first, last, words = self.tokens[start], self.tokens[min(self.i, len(self.tokens)) - 1], []
        for t in self.tokens[start:]:
            if t.line != first.line or t.text == "{" and t.kind == "op":
                break
            words.append((" " if t.gap and words else "") + t.shown)
        sig = "".join(words).strip()
        data = sig.encode()
        sig = sig if len(data) <= SIGNATURE_BYTES else data[:SIGNATURE_BYTES].decode(errors="ignore") + "..."
        self.found.append((start, Symbol(name, kind, self.first_line + first.line, self.first_line + last.line, sig)))

    def whole(self, start: int, name: str, kind: str, inner=None) -> None:
        """A declaration with a block, or without one; ``inner`` reads what the block holds."""
        if self.body():
            if inner is None:
                self.group()
            else:
                self.i += 1
                inner()
                self.i += 1
        elif self.text() == ";":
            self.i += 1
        self.put(start, name, kind)

    def arrow(self) -> bool:
        """Whether a function's value starts here."""
        mark = self.i
        if self.text() == "async" and not self.fresh(1):
            self.i += 1
        found = self.text() == "function"
        if not found:
            if self.text() == "<":
                self.angles()
            if self.text() == "(":
                self.group()
                if self.text() == ":":
                    while self.i < len(self.tokens) and self.text() not in ("=>", ";", "=") and not (self.fresh() and self.text(-1) not in _OPERATORS):
                        self.group() if self.text() in _OPEN else self.angles() if self.text() == "<" else setattr(self, "i", self.i + 1)
            elif self.is_name():
                self.i += 1
            found = self.text() == "=>"
        self.i = mark
        return found

    def declaration(self) -> bool:
        """Read one if it starts here; else nothing moves."""
        start = self.i
        while self.text() in ("export", "default", "declare", "abstract", "async") and (self.text() != "async" or self.text(1) == "function"):
            self.i += 1
        word = self.text()
        if word == "const" and self.text(1) == "enum":
            self.i += 1
            word = "enum"
        if word == "function":
            self.i += 2 if self.text(1) == "*" else 1
            if self.is_name():
                name = self.text()
                self.i += 1
                if self.text() == "<":
                    self.angles()
                self.whole(start, name, "func")
                return True
        elif self.is_name(1) and not self.fresh(1):
            name = self.text(1)
            if word in ("class", "interface") and name not in ("extends", "implements"):
                self.i += 2
                if self.text() == "<":
                    self.angles()
                self.whole(start, name, "type", self.members)
                return True
            if word in ("enum", "namespace", "module"):
                self.i += 2
                while self.text() == "." and self.is_name(1):
                    self.i += 2
                if self.text() == "{":
                    self.whole(start, name, "type", None if word == "enum" else self.scope)
                    return True
            if word == "type" and self.text(2) in ("=", "<", ";"):
                self.i += 2
                if self.text() == "<":
                    self.angles()
                self.rest()
                self.put(start, name, "type")
                return True
            if word in ("const", "let", "var"):
                self.i += 2
                if self.text() == ":":
                    while self.i < len(self.tokens) and self.text() not in ("=", ";") and not (self.fresh() and self.text(-1) not in _OPERATORS):
                        self.group() if self.text() in _OPEN else setattr(self, "i", self.i + 1)
                if self.text() == "=":
                    self.i += 1
                    kind = "func" if self.arrow() else "const" if word == "const" else "var"
                    self.rest()
                    self.put(start, name, kind)
                    return True
        self.i = start
        return False

    def scope(self) -> None:
        """Declarations up to the bracket that closes this scope; blocks that aren't a function's are looked into."""
        depth = 0
        while self.i < len(self.tokens):
            t, before = self.text(), self.text(-1) if self.i else ";"
            if self.is_name() and (self.fresh() or before in (";", "{", "}")) and self.declaration():
                continue
            if t in ("{", "${"):
                depth += 1
            elif t == "}":
                if not depth:
                    return
                depth -= 1
            self.i += 1

    def members(self) -> None:
        """Methods up to the bracket that closes a class or an interface."""
        while self.i < len(self.tokens) and self.text() != "}":
            start = self.i
            while self.text().startswith("@") and self.is_name():
                self.i += 1
                while self.text() == "." and self.is_name(1):
                    self.i += 2
                if self.text() == "(":
                    self.group()
                start = self.i
            while self.text() in _MODIFIERS and (self.is_name(1) or self.text(1) in ("*", "[")):
                self.i += 1
            if self.text() == "*":
                self.i += 1
            name, named = self.text(), self.is_name()
            if named:
                self.i += 1
                if self.text() == "?":
                    self.i += 1
                if self.text() == "<":
                    self.angles()
                if self.text() == "(" and not name.startswith("#") and name not in _NOT_MEMBERS:
                    self.whole(start, name, "method")
                    continue
            if self.text() == "{":
                self.group()  # a static block
            elif named or self.text() not in _CLOSE:
                before = self.i
                self.rest((";", ","))
                if self.i == before and self.i == start:
                    self.i += 1
            elif self.i == start:
                self.i += 1


def symbols_in(text: str, first_line: int = 0, tokens: list[Token] | None = None) -> list[Symbol]:
    """Symbols outside function bodies and values; first_line is added to line numbers, for scripts inside other files."""
    reader = _Reader(tokens_of(text) if tokens is None else tokens, first_line)
    while reader.i < len(reader.tokens):
        reader.scope()
        reader.i += 1  # a bracket too many
    return [s for _, s in sorted(reader.found, key=lambda x: x[0])]


def parse(path: str, text: str, aliases: dict) -> tuple[list[Symbol], list[str]]:
    tokens = tokens_of(text)
    return symbols_in(text, tokens=tokens), imports_in(path, text, aliases, tokens)


register("typescript", CODE_EXTENSIONS[:8], parse)
