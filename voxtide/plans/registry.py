"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from voxtide.plans import core_queries, eval_queries, layer_queries, speech_queries, transcribe_queries


def _modules() -> list:
    return [core_queries, speech_queries, layer_queries, eval_queries, transcribe_queries]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
