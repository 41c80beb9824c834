"""All queries and their SQL."""

from __future__ import annotations

from . import checks, indexes, prompts, streams, tasks, web, workflow
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "checks", "indexes", "prompts", "streams", "tasks", "web", "workflow"]
