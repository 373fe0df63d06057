"""Composite jobs and the query registry."""

import importlib

MODULES = [
    "browse_queries", "item_queries", "tree_queries", "watch_queries", "caption_queries", "ingest_queries", "detect_queries", "frame_queries",
    "enrich_queries", "stream_queries",
]


def load():
    """All registered queries and their SQL, importing each query module once."""
    for name in MODULES:
        importlib.import_module(f"shelf.plans.{name}")
    from shelf.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
