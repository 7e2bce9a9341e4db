"""Path aliases of TypeScript projects, from configuration files with comments and trailing commas."""

from __future__ import annotations

import json
import os
import posixpath
import re

_STRIP = re.compile(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', re.S)
_TRAILING = re.compile(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', re.S)


def strip_jsonc(text: str) -> str:
    """Plain JSON: comments and trailing commas outside of strings go."""
    keep = lambda m: m[1] or ""
    return _TRAILING.sub(keep, _STRIP.sub(keep, text))


def load_aliases(root: str) -> dict[str, str]:
    """pattern -> target below the root, from tsconfig.json, else jsconfig.json; only a pattern's first target counts."""
    for name in ("tsconfig.json", "jsconfig.json"):
        try:
            with open(os.path.join(root, name), encoding="utf-8") as f:
                options = json.loads(strip_jsonc(f.read())).get("compilerOptions") or {}
        except (OSError, ValueError, AttributeError):
            continue
        base = options.get("baseUrl") or "."
        return {p: posixpath.normpath(posixpath.join(base, t[0])) for p, t in (options.get("paths") or {}).items() if t}
    return {}


def resolve_alias(spec: str, aliases: dict[str, str]) -> str | None:
    """The target of a specifier: an exact pattern first, else the wildcard with the longest prefix (then the smallest
    pattern). A wildcard whose prefix and suffix would overlap doesn't match."""
    if spec in aliases:
        return aliases[spec]
    best = None
    for pattern, target in aliases.items():
        prefix, star, suffix = pattern.partition("*")
        if star and len(spec) >= len(prefix) + len(suffix) and spec.startswith(prefix) and spec.endswith(suffix):
            rank = (-len(prefix), pattern)
            if best is None or rank < best[0]:
                best = (rank, posixpath.normpath(target.replace("*", spec[len(prefix) : len(spec) - len(suffix)], 1)))
    return best[1] if best else None
