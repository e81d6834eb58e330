"""Registered queries over the supplied tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from trackscan.queries import frames, registry, scene, streams  # noqa: F401

FLAGSHIP = "public_decision_status"


def queries() -> dict[str, Callable]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
