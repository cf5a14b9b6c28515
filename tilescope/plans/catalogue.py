"""All registered queries; importing the modules registers them."""

import importlib

from tilescope.plans.registry import ORACLES, QUERIES

MODULES = ("metric_queries", "ranking_queries", "quality_queries", "error_queries", "tile_queries",
           "map_queries", "embedding_queries", "io_queries")
for _name in MODULES:
    importlib.import_module(f"tilescope.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
