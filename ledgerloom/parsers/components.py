"""Svelte and Astro components: TypeScript in script blocks and front matter."""

from __future__ import annotations

import re

from .base import Symbol, register
from .typescript import imports_in, symbols_in

_OPEN, _CLOSE = re.compile(r"<\s*script\b[^>]*>", re.I), re.compile(r"</\s*script\s*>", re.I)


def script_blocks(text: str) -> list[tuple[int, str]]:
    """(number of lines before its first one, code) of each script; a script on one line keeps that line's number."""
    lines, blocks, at = text.split("\n"), [], 0
    while at < len(lines):
        opened = _OPEN.search(lines[at])
        if not opened:
            at += 1
            continue
        rest = lines[at][opened.end() :]
        if closed := _CLOSE.search(rest):
            blocks.append((at, rest[: closed.start()]))
            at += 1
            continue
        first, code = at + 1, []
        at += 1
        while at < len(lines) and not (closed := _CLOSE.search(lines[at])):
            code.append(lines[at])
            at += 1
        if at < len(lines) and lines[at][: closed.start()].strip():
            code.append(lines[at][: closed.start()])
        blocks.append((first, "\n".join(code)))
        at += 1
    return blocks


def front_matter(text: str) -> list[tuple[int, str]]:
    """The fence that opens an Astro file, if it is closed and holds something."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return []
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
    return [(1, "\n".join(lines[1:end]))] if end > 1 else []


def _parse(path: str, blocks: list[tuple[int, str]], aliases: dict) -> tuple[list[Symbol], list[str]]:
    # a key that several blocks import appears once per block
    return [s for first, code in blocks for s in symbols_in(code, first)], [k for _, code in blocks for k in imports_in(path, code, aliases)]


register("svelte", ("svelte",), lambda path, text, aliases: _parse(path, script_blocks(text), aliases))
register("astro", ("astro",), lambda path, text, aliases: _parse(path, front_matter(text) + script_blocks(text), aliases))
