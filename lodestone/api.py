"""The public functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lodestone.engine import IndexResponse, Request, Response, Result, index, query, search, stats
from lodestone.operators.filters import Filters
from lodestone.output import SCHEMA_VERSION as OUTPUT_SCHEMA_VERSION

__all__ = ["OUTPUT_SCHEMA_VERSION", "Filters", "IndexResponse", "Request", "Response", "Result", "SparkSession", "index", "query", "search", "stats"]
