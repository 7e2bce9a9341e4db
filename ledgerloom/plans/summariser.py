"""A text model around which nothing can go wrong: a time limit, a breaker, and only safe lines come out."""

from __future__ import annotations

import json
import queue
import threading
import urllib.request
from collections.abc import Callable

from ..functions.secrets import safe_summary
from ..sources.config import Summariser

#: Failures in a row after which a model isn't asked again by this object.
BREAKER = 3
RESPONSE_BYTES = 1 << 20


class GuardedSummariser:
    """``ask(prompt) -> text`` for one diff at a time; None where there is no usable text."""

    def __init__(self, ask: Callable[[str], str], settings: Summariser | None = None):
        self.ask, self.settings, self.failures = ask, settings or Summariser(), 0

    @property
    def open(self) -> bool:
        return self.failures >= BREAKER

    def __call__(self, path: str, diff: str) -> str | None:
        if self.open:
            return None
        cut = diff.encode()[: self.settings.max_diff_bytes].decode(errors="ignore")
        prompt = f"Say in one plain sentence what this change to {path} does.\n\n{cut}"
        answers: queue.SimpleQueue = queue.SimpleQueue()

        def work() -> None:
            try:
                answers.put((True, self.ask(prompt)))
            except Exception:  # whatever a model's client throws counts as a failure
                answers.put((False, None))

        threading.Thread(target=work, daemon=True).start()
        try:
            good, text = answers.get(timeout=self.settings.timeout_ms / 1000)
        except queue.Empty:
            good, text = False, None
        self.failures = 0 if good else self.failures + 1
        return safe_summary(text) if good else None


def over_http(settings: Summariser) -> GuardedSummariser:
    """A model behind the settings' endpoint, which ``config.validate`` has judged."""

    def ask(prompt: str) -> str:
        body = json.dumps({"model": settings.model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(settings.endpoint.rstrip("/") + "/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=settings.timeout_ms / 1000) as answer:
            data = answer.read(RESPONSE_BYTES + 1)
        if len(data) > RESPONSE_BYTES:
            raise ValueError("the answer is too long")
        return json.loads(data)["response"]

    return GuardedSummariser(ask, settings)
