"""Digests: HMAC-SHA256 of payloads, and as column expressions signed payloads, diff hashes, names of repositories."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signed fields of a row, in the order of the payload.
SIGNED = ("prev_hmac", "file_path", "branch", "source", "summary", "reason", "diff_stat", "diff_hash", "agent_id", "recorded_at")


def hmac_sha256(payload: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text's UTF-8. A pandas function over payloads holds the key, so no plan, UI or event log shows it,
    as the pads of a column expression would."""

    @F.pandas_udf("string")
    def signed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _hmac.new(key, t.encode(), hashlib.sha256).hexdigest())

    return signed(payload.cast("string"))


def json_string(c: Column) -> Column:
    """A JSON string as web-safe encoders write it: control characters, quotes and the three HTML signs escaped."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    for ch in [*map(chr, range(32)), "<", ">", "&", "\u2028", "\u2029"]:
        out = F.replace(out, F.lit(ch), F.lit(short.get(ch, f"\\u{ord(ch):04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def signed_payload(prefix: str = "") -> Column:
    """The JSON text that a row's HMAC covers."""
    parts: list[Column] = []
    for i, name in enumerate(SIGNED):
        value = F.col(prefix + name)
        text = F.coalesce(value, F.lit(0)).cast("string") if name == "recorded_at" else json_string(F.coalesce(value, F.lit("")))
        parts += [F.lit(("," if i else "{") + f'"{name}":'), text]
    return F.concat(*parts, F.lit("}"))


def derive_key(salt: bytes, email: str) -> bytes:
    """The signing key of a person; the salt's own without an address."""
    return _hmac.new(salt, email.encode(), hashlib.sha256).digest()


def diff_hash(diff: Column) -> Column:
    return F.sha2(F.regexp_replace(diff, r"^\s+|\s+$", "").cast("binary"), 256)


def repository_id(path: Column) -> Column:
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 32)
