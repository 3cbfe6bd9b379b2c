"""All registered queries and their SQL."""

from importlib import import_module

SECTIONS = ("sources", "features", "algebra", "relations", "encoding", "decoding", "similarity", "metrics", "statistics", "fragments", "streams")


def load():
    """(queries, sql) of every section."""
    from braidvec.catalog.registry import QUERIES, SQL

    for section in SECTIONS:
        import_module(f"braidvec.catalog.{section}")
    return QUERIES, SQL
