"""Parsers register themselves when the package is imported, on executors too."""

from . import components, golang, typescript  # noqa: F401
