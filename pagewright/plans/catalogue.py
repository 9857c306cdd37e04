"""All registered queries of the document operators, each with its SQL twin."""

from __future__ import annotations

import importlib

from .registry import Query

NAMES = ("search", "pages", "objects", "geometry", "overlap", "labels", "viewer", "forms", "images", "metadata", "redaction", "signatures", "folds", "notes", "parsing", "jobs")
BOOKS = tuple(importlib.import_module(f"{__package__}.{name}").book for name in NAMES)


def queries() -> dict[str, Query]:
    return {name: f for book in BOOKS for name, f in book.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
