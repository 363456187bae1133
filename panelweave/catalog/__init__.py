"""The registered queries: importing the modules registers them."""

from . import evaluation, graphs, tables, windows
from .registry import QUERIES, SQL

FLAGSHIP = "R-13_ic"
__all__ = ["FLAGSHIP", "QUERIES", "SQL", "evaluation", "graphs", "tables", "windows"]
