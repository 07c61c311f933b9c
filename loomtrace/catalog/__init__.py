"""Named queries over the driver's tables, each with its SQL counterpart where SQL can say it."""
from __future__ import annotations

from loomtrace.catalog.registry import REGISTRY, Tables


def load() -> dict:
    from loomtrace.catalog import activity, ledger, prompts, readers, scoring, transcripts  # noqa: F401  (registration)
    return REGISTRY


__all__ = ["load", "Tables"]
