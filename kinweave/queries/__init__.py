"""The registry of graph queries: name -> query, name -> DuckDB SQL."""

from kinweave.queries import evaluation, graph, mentions, pages, resolution, text  # noqa: F401
from kinweave.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
