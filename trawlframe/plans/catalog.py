"""Every query of the crawl engine by name, with its DuckDB counterpart."""

from __future__ import annotations

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
