"""Registered queries of the library, by topic."""

from importlib import import_module

TOPICS = ("retrieval", "answers", "files", "operations", "streams", "pieces", "plugins")


def _modules():
    return [import_module(f"{__name__}.{topic}") for topic in TOPICS]


def all_queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: q for m in _modules() for name, q in m.ORACLE.items()}
