"""Queries and SQL of the llm subpackage, by name."""

from rinkline.llm.queries import QUERIES
from rinkline.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
