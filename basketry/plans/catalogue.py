"""Everything registered, in the order of the operator inventory."""

from __future__ import annotations

import importlib

from basketry.plans import registry

PARTS = (
    "sources_and_scalars",
    "joins_and_reports",
    "sequences_and_vectors",
    "recommenders",
    "lists_and_people",
    "models_and_streams",
)


def _load() -> None:
    for part in PARTS:
        importlib.import_module(f"basketry.plans.{part}")


def queries():
    _load()
    return dict(registry.QUERIES)


def checks():
    _load()
    return registry.checks()
