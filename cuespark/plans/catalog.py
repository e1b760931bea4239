"""All registered queries in one place."""

from __future__ import annotations

from . import cue_queries, file_queries, quality_queries, speech_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
