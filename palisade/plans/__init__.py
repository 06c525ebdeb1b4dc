"""Registered queries, grouped by subject."""

from importlib import import_module

MODULES = ["corpus_text", "evidence", "sessions", "marts", "assets", "pages", "semantic", "dataset", "privacy", "streams"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"palisade.plans.{name}")
