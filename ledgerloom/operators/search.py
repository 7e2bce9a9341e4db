"""Full-text search: a query language compiled to a column over token arrays.

Grammar: terms (all must occur, in any column and order), "phrases", prefix*, AND, OR, NOT, column:term, parentheses and
NEAR(a b, n). Tokens are runs of letters and digits, in lower case and without diacritics. Whatever the query, it is one
filter over one scan; a materialised token table (``tokenise``) saves the splitting. ``sources.search_index`` answers the same
queries from an inverted index.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("summary", "reason")
# characters that lose a diacritic: a Latin letter with one mark, by their decompositions
_MARKED = {chr(c): d[0].lower() for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and d[0].isascii()}
_FROM, _TO = "".join(_MARKED), "".join(_MARKED.values())


class SearchError(ValueError):
    """The query can't be read."""


def fold(text: str) -> str:
    """A query's words as ``tokens`` has them: lower case, without marks; letters of every script stay."""
    return "".join(_MARKED.get(c, c) for c in text.lower() if not unicodedata.category(c).startswith("M"))


def tokens(c: Column | str) -> Column:
    """array<string> of the tokens of a text, in order."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(F.lower(F.coalesce(c, F.lit(""))), _FROM, _TO)
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{M}", ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokenise(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The input with ``<column>_tokens`` for each column, for tables that are searched often."""
    return df.withColumns({f"{c}_tokens": tokens(c) for c in columns})


_LEX = re.compile(r'\s*(?:(?P<near>NEAR\s*\()|(?P<par>[()])|(?P<phrase>"(?:[^"]|"")*")\s*(?P<pstar>\*)?|(?P<word>[^\W_]+(?:_[^\W_]*)*)(?P<star>\*)?|(?P<colon>:)|(?P<comma>,))')


def _lexed(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.strip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise SearchError(f"syntax error near {query[at:at + 10]!r}")
        at = m.end()
        if m["near"]:
            out.append(("near", ""))
        elif m["phrase"] is not None:
            out.append(("phrase*" if m["pstar"] else "phrase", m["phrase"][1:-1].replace('""', '"')))
        elif m["word"]:
            word = m["word"]
            out.append((word, "") if word in ("AND", "OR", "NOT") else ("prefix" if m["star"] else "term", word))
        else:
            out.append((m["par"] or m["colon"] or m["comma"], ""))
    return out


class _Parser:
    """The tree of a query: ("term", words, last is a prefix, columns), ("near", [(words, prefix)], distance, columns), or ("and" | "or" |
    "not", left, right)."""

    def __init__(self, query: str, columns: tuple[str, ...]):
        self.lexed, self.i, self.columns = _lexed(query), 0, tuple(columns)

    def kind(self, k: int = 0) -> str:
        return self.lexed[self.i + k][0] if self.i + k < len(self.lexed) else ""

    def take(self, kind: str | None = None) -> str:
        if not self.kind() or kind and self.kind() != kind:
            raise SearchError(f"expected {kind or 'more'}, found {self.kind() or 'the end'}")
        self.i += 1
        return self.lexed[self.i - 1][1]

    def whole(self) -> tuple:
        found = self.either(self.columns)
        if self.kind():
            raise SearchError(f"unexpected {self.kind()}")
        return found

    def either(self, cols) -> tuple:
        out = self.both(cols)
        while self.kind() == "OR":
            self.take()
            out = ("or", out, self.both(cols))
        return out

    def both(self, cols) -> tuple:
        out = self.without(cols)
        while self.kind() == "AND":
            self.take()
            out = ("and", out, self.without(cols))
        return out

    def without(self, cols) -> tuple:
        out = self.side_by_side(cols)
        while self.kind() == "NOT":
            self.take()
            out = ("not", out, self.side_by_side(cols))
        return out

    def side_by_side(self, cols) -> tuple:
        """Terms without a word between them bind tightest, then NOT, AND, OR."""
        out = self.one(cols)
        while self.kind() not in ("", ")", "OR", ",", "NOT", "AND"):
            out = ("and", out, self.one(cols))
        return out

    def one(self, cols) -> tuple:
        if self.kind() == "(":
            self.take()
            out = self.either(cols)
            self.take(")")
            return out
        if self.kind() == "near":
            self.take()
            return self.near(cols)
        if self.kind() == "term" and self.kind(1) == ":":
            name = self.take()
            self.take(":")
            if name not in cols:
                raise SearchError(f"no such column: {name}")
            return self.one((name,))
        kind = self.kind()
        if kind not in ("term", "prefix", "phrase", "phrase*"):
            raise SearchError(f"unexpected {kind or 'end'}")
        return ("term", re.findall(r"[^\W_]+", fold(self.take())), kind in ("prefix", "phrase*"), cols)

    def near(self, cols) -> tuple:
        groups, distance = [], 10
        while self.kind() not in (")", ","):
            kind = self.kind()
            groups.append((re.findall(r"[^\W_]+", fold(self.take())), kind in ("prefix", "phrase*")))
        if self.kind() == ",":
            self.take()
            distance = int(self.take("term"))
        self.take(")")
        return ("near", groups, distance, cols)


def parse(query: str, columns: tuple[str, ...] = COLUMNS) -> tuple:
    return _Parser(query, columns).whole()


def evaluated(tree: tuple, term, near) -> Column:
    """A tree as a column; ``term`` and ``near`` make one of a leaf."""
    kind = tree[0]
    if kind == "term":
        return term(*tree[1:]) if tree[1] else F.lit(False)
    if kind == "near":
        return near(*tree[1:])
    left, right = (evaluated(t, term, near) for t in tree[1:])
    return left | right if kind == "or" else left & right if kind == "and" else left & ~right


def starts_of(t: Column, words: list[str], prefix: bool) -> Column:
    """Positions (from 0) at which the words follow each other."""
    at = F.sequence(F.lit(0), F.size(t) - 1)

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(words):
            token = F.coalesce(F.get(t, i + k), F.lit(""))
            ok = ok & (F.startswith(token, F.lit(w)) if prefix and k == len(words) - 1 else token == w)
        return ok

    return F.when(F.size(t) > 0, F.filter(at, here)).otherwise(F.array().cast("array<int>"))


def follows(t: Column, words: list[str], prefix: bool) -> Column:
    if len(words) == 1:
        return F.exists(t, lambda x: F.startswith(x, F.lit(words[0]))) if prefix else F.array_contains(t, words[0])
    return F.size(starts_of(t, words, prefix)) > 0


def within(sets: list[tuple[Column, int]], distance: int) -> Column:
    """All groups (their starts and lengths), with at most ``distance`` tokens between the end of the first and the start of the last."""

    def reach(k: int, low: Column, high: Column) -> Column:
        if k == len(sets):
            return high - low <= distance
        starts, n = sets[k]
        return F.exists(starts, lambda s: reach(k + 1, F.least(low, s + n), F.greatest(high, s)))

    starts, n = sets[0]
    return F.exists(starts, lambda s: reach(1, s + n, s))


def matches(query: str, columns: tuple[str, ...] = COLUMNS, tokenised: bool = False) -> Column:
    """A query as one condition over the texts, or over their tokens."""
    of = {c: F.col(f"{c}_tokens") if tokenised else tokens(c) for c in columns}

    def any_of(cols, test) -> Column:
        out = F.lit(False)
        for c in cols:
            # a one-element transform names the tokens, so they are split once a row
            out = out | F.element_at(F.transform(F.array(of[c]), test), 1)
        return out

    return evaluated(
        parse(query, columns),
        lambda words, prefix, cols: any_of(cols, lambda t: follows(t, words, prefix)),
        lambda groups, distance, cols: any_of(cols, lambda t: within([(starts_of(t, w, p), len(w)) for w, p in groups], distance)),
    )


def search(changes: DataFrame, query: str, limit: int = 20, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The newest rows that a query meets. Rows of equal time come in the order of their ids, newest first."""
    tokenised = all(f"{c}_tokens" in changes.columns for c in columns)
    found = changes.where(matches(query, columns, tokenised))
    order = [F.col("recorded_at").desc(), F.col("id").desc()]
    return found.orderBy(*order).limit(limit)
