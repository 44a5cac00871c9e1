"""The registered queries: each applies operators to whole driver tables. Importing all() fills the registry."""

from __future__ import annotations

import importlib

MODULES = ("metadata", "texts", "chunks", "search", "ranking", "routing", "evidence", "grades", "evaluation", "curation", "artifacts", "answers", "assembly", "grids", "streams")


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
