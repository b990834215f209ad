"""Loads every module that registers queries."""

from importlib import import_module

MODULES = [
    "pattern_queries", "question_queries", "text_queries", "profile_queries", "clean_queries", "report_queries", "model_queries",
    "source_queries",
]


def load() -> None:
    for name in MODULES:
        import_module(f"tablewright.catalogue.{name}")
