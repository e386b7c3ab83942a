"""Operators for preparing training text. Nothing else in the library imports this subpackage."""


def load():
    """Queries of this subpackage and the SQL that checks them: ``(queries, checks)``."""
    from weftline.llm import registry

    return dict(registry.QUERIES), dict(registry.SQL)
