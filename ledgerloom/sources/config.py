"""Settings: defaults, a JSON file, the environment; anything unsafe is refused."""

from __future__ import annotations

import ipaddress
import json
import os
import socket
from dataclasses import dataclass, field, fields
from urllib.parse import urlparse

from ..functions.text import STATE_DIR

PREFIX = "LEDGERLOOM_"
ALLOW_REMOTE = PREFIX + "SUMMARISER_ALLOW_REMOTE"
KNOWN_LANGUAGES = ("go", "typescript", "svelte", "astro")


@dataclass
class Summariser:
    enabled: bool = False
    endpoint: str = "http://127.0.0.1:11434"
    model: str = "qwen2.5:3b-instruct"
    timeout_ms: int = 3000
    max_diff_bytes: int = 4096


@dataclass
class Index:
    enabled: bool = True
    languages: list[str] = field(default_factory=lambda: ["go"])
    max_bytes: int = 200 << 20
    max_file_size: int = 1 << 20
    parse_timeout_ms: int = 5000
    wikilinks: bool = False


@dataclass
class Config:
    summariser: Summariser = field(default_factory=Summariser)
    index: Index = field(default_factory=Index)


def truthy(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes", "on")


def is_loopback(endpoint: str) -> bool:
    """Every address that the endpoint's host stands for is this machine."""
    host = urlparse(endpoint).hostname
    if not host:
        return False
    try:
        found = {a[4][0] for a in socket.getaddrinfo(host, None)}
    except OSError:
        return False
    return bool(found) and all(ipaddress.ip_address(a.partition("%")[0]).is_loopback for a in found)


def load(root: str, env: dict | None = None) -> Config:
    """Settings of a repository; a broken file or a bad value is an error, a missing file isn't."""
    env = os.environ if env is None else env
    config = Config()
    try:
        with open(os.path.join(root, STATE_DIR, "config.json"), encoding="utf-8") as f:
            given = json.load(f)
    except FileNotFoundError:
        given = {}
    for part in ("summariser", "index"):
        target = getattr(config, part)
        for f in fields(target):
            if f.name in given.get(part, {}):
                setattr(target, f.name, given[part][f.name])
            text = env.get(f"{PREFIX}{part}_{f.name}".upper(), "")
            kind = type(getattr(target, f.name))
            if text and kind is bool:
                setattr(target, f.name, truthy(text))
            elif text and kind is int and text.isdigit() and int(text) > 0:
                setattr(target, f.name, int(text))
            elif text and kind is str:
                setattr(target, f.name, text)
    validate(config, env)
    return config


def validate(config: Config, env: dict) -> None:
    s, i = config.summariser, config.index
    if s.enabled:
        if urlparse(s.endpoint).scheme not in ("http", "https"):
            raise ValueError(f"not an HTTP endpoint: {s.endpoint}")
        if not truthy(env.get(ALLOW_REMOTE, "")) and not is_loopback(s.endpoint):
            raise ValueError(f"{s.endpoint} isn't on this machine; set {ALLOW_REMOTE} to allow it")
        if not s.model or s.timeout_ms <= 0 or s.max_diff_bytes <= 0:
            raise ValueError("the summariser needs a model and positive limits")
    if i.enabled:
        if unknown := set(i.languages) - set(KNOWN_LANGUAGES):
            raise ValueError(f"no parser for {sorted(unknown)}")
        if min(i.max_bytes, i.max_file_size, i.parse_timeout_ms) <= 0:
            raise ValueError("limits of the index have to be positive")
