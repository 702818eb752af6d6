"""Importing this module registers every query."""

from __future__ import annotations

from . import capture_queries, chat_queries, event_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
